"""Classic netCDF files (CDF-1 and CDF-2) in plain Python: enough to write forecasts and to read grids.

Layout by the public format specification: a header of dimensions, attributes
and variables, then the data of each variable, big-endian. The record dimension
is read, but files are written without one.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# External types of the format.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    dims: tuple[str, ...]
    data: np.ndarray
    attrs: dict = field(default_factory=dict)


@dataclass
class Dataset:
    dims: dict[str, int] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)

    def add(self, name: str, dims: tuple[str, ...], data, **attrs) -> None:
        data = np.asarray(data)
        for d, n in zip(dims, data.shape):
            if self.dims.setdefault(d, n) != n:
                raise ValueError(f"dimension {d} is {self.dims[d]}, not {n}")
        self.variables[name] = Variable(dims, data, attrs)


def _code(a: np.ndarray) -> int:
    kind = a.dtype.kind + str(a.dtype.itemsize)
    if kind in ("i8", "u4", "u2", "u1", "b1"):
        return _CODES["i4"]
    if a.dtype.kind in "SU":
        return _CODES["S1"]
    return _CODES[kind]


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 4)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + _padded(raw)


def _attributes(attrs: dict) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", _ATTRIBUTES, len(attrs))
    for k, v in attrs.items():
        if isinstance(v, str):
            raw = v.encode()
            out += _name(k) + struct.pack(">ii", 2, len(raw)) + _padded(raw)
        else:
            a = np.atleast_1d(np.asarray(v))
            code = _code(a)
            out += _name(k) + struct.pack(">ii", code, a.size) + _padded(a.astype(_TYPES[code]).tobytes())
    return out


def dumps(ds: Dataset) -> bytes:
    """A data set as the bytes of a file with 64-bit offsets."""
    ids = {d: i for i, d in enumerate(ds.dims)}
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", _DIMENSIONS, len(ids)) if ids else struct.pack(">ii", 0, 0)
    for d, n in ds.dims.items():
        head += _name(d) + struct.pack(">i", n)
    head += _attributes(ds.attrs)
    blocks, entries = [], []
    for name, v in ds.variables.items():
        code = _code(v.data)
        raw = _padded(np.ascontiguousarray(v.data).astype(_TYPES[code]).tobytes())
        entries.append(_name(name) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", ids[d]) for d in v.dims) + _attributes(v.attrs) + struct.pack(">ii", code, min(len(raw), 2**31 - 4)))
        blocks.append(raw)
    head += struct.pack(">ii", _VARIABLES, len(entries)) if entries else struct.pack(">ii", 0, 0)
    at = len(head) + sum(len(e) + 8 for e in entries)
    for e, raw in zip(entries, blocks):
        head += e + struct.pack(">q", at)
        at += len(raw)
    return head + b"".join(blocks)


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 4

    def number(self, kind: str = ">i") -> int:
        (out,) = struct.unpack_from(kind, self.raw, self.at)
        self.at += struct.calcsize(kind)
        return out

    def text(self) -> str:
        n = self.number()
        out = self.raw[self.at : self.at + n].decode()
        self.at += n + -n % 4
        return out

    def attributes(self) -> dict:
        self.number()
        out = {}
        for _ in range(self.number()):
            name, code, n = self.text(), self.number(), self.number()
            size = n * np.dtype(_TYPES[code]).itemsize
            raw = self.raw[self.at : self.at + size]
            self.at += size + -size % 4
            if code == 2:
                out[name] = raw.decode("utf-8", "replace")
            else:
                a = np.frombuffer(raw, _TYPES[code])
                out[name] = a[0].item() if n == 1 else a.tolist()
        return out


def loads(raw: bytes) -> Dataset:
    """A data set from the bytes of a classic file; ValueError where they are something else."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    c, wide = _Cursor(raw), raw[3] == 2
    records = max(c.number(), 0)
    c.number()
    dims = [(c.text(), c.number()) for _ in range(c.number())]
    attrs = c.attributes()
    c.number()
    found = []
    for _ in range(c.number()):
        name = c.text()
        ids = [c.number() for _ in range(c.number())]
        own, code, size = c.attributes(), c.number(), c.number()
        found.append((name, ids, own, code, size, c.number(">q" if wide else ">i")))
    out = Dataset({n: k or records for n, k in dims}, {}, attrs)
    step = sum(f[4] for f in found if f[1] and dims[f[1][0]][1] == 0)
    for name, ids, own, code, size, begin in found:
        shape = [dims[i][1] or records for i in ids]
        kind = np.dtype(_TYPES[code])
        if ids and dims[ids[0]][1] == 0:
            each = int(np.prod(shape[1:], dtype=int))
            data = np.stack([np.frombuffer(raw, kind, each, begin + k * step) for k in range(records)]) if records else np.zeros(0, kind)
        else:
            data = np.frombuffer(raw, kind, int(np.prod(shape, dtype=int)), begin)
        native = data if code == 2 else data.astype(kind.newbyteorder("="))
        out.variables[name] = Variable(tuple(dims[i][0] for i in ids), native.reshape(shape), own)
    return out


def values(v: Variable) -> np.ndarray:
    """Doubles with the packing undone; fill values and what lies outside the valid range are NaN."""
    raw = v.data.astype(float)
    bad = ~np.isfinite(raw)
    for k in ("_FillValue", "missing_value"):
        if k in v.attrs:
            bad |= raw == v.attrs[k]
    lo, hi = v.attrs.get("valid_range", (v.attrs.get("valid_min", -np.inf), v.attrs.get("valid_max", np.inf)))
    bad |= (raw < lo) | (raw > hi)
    return np.where(bad, np.nan, raw * v.attrs.get("scale_factor", 1.0) + v.attrs.get("add_offset", 0.0))
