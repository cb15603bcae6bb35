"""GeoTIFF files in plain Python: written as float bands in one strip each, read with or without deflate, in strips or tiles."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tags and codes of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _DESCRIPTION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
_PLANAR, _PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 284, 317, 322, 323, 324, 325, 339
_SCALE, _TIEPOINT, _KEYS, _ASCII, _METADATA, _NODATA = 33550, 33922, 34735, 34737, 42112, 42113
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_PACKS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_NONE, _DEFLATE, _OLD_DEFLATE = 1, 8, 32946


def dumps(bands: np.ndarray, left: float, top: float, dx: float, dy: float, projection: str = "", nodata: float = -9999.0, description: str = "", metadata: dict | None = None) -> bytes:
    """Bands ``(band, y, x)`` with their upper-left corner and cell size; missing cells hold ``nodata``. Deflated."""
    bands = np.where(np.isfinite(bands), bands, nodata).astype("<f4")
    n, height, width = bands.shape
    strips = [zlib.compress(b.tobytes(), 6) for b in bands]
    items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in (metadata or {}).items())
    entries: dict[int, tuple[int, list | bytes]] = {
        _WIDTH: (4, [width]),
        _HEIGHT: (4, [height]),
        _BITS: (3, [32] * n),
        _COMPRESSION: (3, [_DEFLATE]),
        _PHOTOMETRIC: (3, [1]),
        _DESCRIPTION: (2, (description or " ").encode() + b"\0"),
        _OFFSETS: (4, [0] * n),
        _SAMPLES: (3, [n]),
        _ROWS: (4, [height]),
        _COUNTS: (4, [len(s) for s in strips]),
        _PLANAR: (3, [2]),
        _FORMAT: (3, [3] * n),
        _SCALE: (12, [dx, dy, 0.0]),
        _TIEPOINT: (12, [0.0, 0.0, 0.0, left, top, 0.0]),
        _KEYS: (3, [1, 1, 0, 3, 1024, 0, 1, 1 if projection and "longlat" not in projection else 2, 1025, 0, 1, 1, 1026, 34737, len(projection) + 1, 0]),
        _ASCII: (2, (projection + "|").encode() + b"\0"),
        _METADATA: (2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"),
        _NODATA: (2, repr(nodata).encode() + b"\0"),
    }
    at = 8 + 2 + 12 * len(entries) + 4
    extra, directory = b"", {}
    for tag in sorted(entries):
        kind, v = entries[tag]
        raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_PACKS[kind]}", *v)
        if len(raw) > 4:
            directory[tag] = (kind, len(raw) // _SIZES[kind], at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            directory[tag] = (kind, len(raw) // _SIZES[kind], raw.ljust(4, b"\0"))
    first = at + len(extra)
    places = [first + sum(len(s) for s in strips[:k]) for k in range(n)]
    raw = struct.pack(f"<{n}I", *places)
    if n == 1:
        directory[_OFFSETS] = (4, 1, raw)
    else:
        shift = directory[_OFFSETS][2] - at
        extra = extra[:shift] + raw + extra[shift + len(raw) :]
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(directory))
    for tag, (kind, count, where) in directory.items():
        out += struct.pack("<HHI", tag, kind, count) + (where if isinstance(where, bytes) else struct.pack("<I", where))
    return out + struct.pack("<I", 0) + extra + b"".join(strips)


def loads(raw: bytes) -> tuple[np.ndarray, dict]:
    """Bands ``(band, y, x)`` as doubles (nodata is NaN) and left, top, dx, dy, projection, description of the first image."""
    if raw[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    e = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", raw, 4)
    (count,) = struct.unpack_from(e + "H", raw, at)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(e + "HHI", raw, at + 2 + 12 * k)
        where = at + 2 + 12 * k + 8
        if n * _SIZES.get(kind, 1) > 4:
            (where,) = struct.unpack_from(e + "I", raw, where)
        if kind == 2:
            tags[tag] = (raw[where : where + n].split(b"\0")[0].decode("utf-8", "replace"),)
        elif kind in _PACKS:
            tags[tag] = struct.unpack_from(f"{e}{n}{_PACKS[kind]}", raw, where)
    width, height, samples = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    bits, form, way = tags.get(_BITS, (1,))[0], tags.get(_FORMAT, (1,))[0], tags.get(_COMPRESSION, (1,))[0]
    if way not in (_NONE, _DEFLATE, _OLD_DEFLATE):
        raise ValueError(f"compression {way} isn't supported")
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)).newbyteorder(e)
    planar = tags.get(_PLANAR, (1,))[0] == 2
    tiled = _TILE_OFFSETS in tags
    bw, bh = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if tiled else (width, min(tags.get(_ROWS, (height,))[0], height))
    offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
    across, down = -(-width // bw), -(-height // bh)
    depth = 1 if planar else samples
    out = np.zeros((samples, height, width))
    for k, (offset, size) in enumerate(zip(offsets, counts)):
        band, rest = divmod(k, across * down) if planar else (0, k)
        y, x = rest // across * bh, rest % across * bw
        part = raw[offset : offset + size]
        if way != _NONE:
            part = zlib.decompress(part)
        rows = bh if tiled else min(bh, height - y)
        block = np.frombuffer(part, kind, rows * bw * depth).reshape(rows, bw, depth)
        if tags.get(_PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, 1, dtype=kind)
        h, w = min(rows, height - y), min(bw, width - x)
        for d in range(depth):
            out[band + d, y : y + h, x : x + w] = block[:h, :w, d]
    meta = {"description": tags.get(_DESCRIPTION, ("",))[0].strip(), "projection": tags.get(_ASCII, ("",))[0].rstrip("|") or None}
    if _SCALE in tags and _TIEPOINT in tags:
        dx, dy = tags[_SCALE][:2]
        i, j, _, x, y, _ = tags[_TIEPOINT][:6]
        meta |= {"left": x - i * dx, "top": y + j * dy, "dx": dx, "dy": dy}
    if _NODATA in tags:
        out[out == float(np.float32(float(tags[_NODATA][0]))) if form == 3 and bits == 32 else out == float(tags[_NODATA][0])] = np.nan
    return out, meta
