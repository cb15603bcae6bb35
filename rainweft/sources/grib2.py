"""One field of a GRIB2 file on a latitude-longitude grid, in simple or PNG packing, in plain Python."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _signed(raw: int, bits: int) -> int:
    """Sign-and-magnitude number of the format."""
    top = 1 << (bits - 1)
    return -(raw & (top - 1)) if raw & top else raw


def png_codes(raw: bytes) -> np.ndarray:
    """Codes of a greyscale or RGB(A) PNG without interlace; several bytes of a pixel make one number."""
    at, idat, head = 8, b"", None
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if interlace or depth not in (1, 2, 4, 8, 16):
        raise ValueError("this kind of PNG isn't supported")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = max(1, channels * depth // 8)
    stride = (width * channels * depth + 7) // 8
    data = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, stride + 1)
    rows = np.zeros((height, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(height):
        way, line = int(data[y, 0]), data[y, 1:]
        if way == 0:
            now = line.copy()
        elif way == 2:
            now = line + before
        elif way == 1:
            now = np.concatenate([np.cumsum(line[k::step], dtype=np.uint8)[:, None] for k in range(step)], 1).ravel() if stride % step == 0 else line
        else:
            now = line.astype(int)
            for x in range(stride):
                a, b, c = (int(now[x - step]) if x >= step else 0), int(before[x]), (int(before[x - step]) if x >= step else 0)
                if way == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                now[x] = (int(line[x]) + guess) & 255
            now = now.astype(np.uint8)
        rows[y] = before = now
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)
    per = rows.reshape(height, width, step).astype(np.int64)
    return (per << (8 * np.arange(step - 1, -1, -1))).sum(2)


def loads(raw: bytes) -> tuple[np.ndarray, dict]:
    """The first field, north up, and its latitudes, longitudes and time; points without value are NaN."""
    if raw[:4] != b"GRIB" or raw[7] != 2:
        raise ValueError("not a GRIB2 file")
    at, meta, bitmap = 16, {}, None
    while raw[at : at + 4] != b"7777":
        size, number = struct.unpack_from(">IB", raw, at)
        s = raw[at : at + size]
        if number == 1:
            meta["time"] = struct.unpack_from(">HBBBBB", s, 12)
        elif number == 3:
            (template,) = struct.unpack_from(">H", s, 12)
            if template != 0:
                raise ValueError(f"grid template {template} isn't supported")
            nx, ny = struct.unpack_from(">II", s, 30)
            la1, lo1 = struct.unpack_from(">II", s, 46)
            la2, lo2, di, dj = struct.unpack_from(">IIII", s, 55)
            mode = s[71]
            meta |= {"nx": nx, "ny": ny, "lat1": _signed(la1, 32) / 1e6, "lon1": lo1 / 1e6, "lat2": _signed(la2, 32) / 1e6, "lon2": lo2 / 1e6, "dlon": di / 1e6, "dlat": dj / 1e6}
            meta["earth"] = s[14]
        elif number == 5:
            points, template = struct.unpack_from(">IH", s, 5)
            reference, binary, decimal = struct.unpack_from(">fHH", s, 11)
            binary, decimal, bits = _signed(binary, 16), _signed(decimal, 16), s[19]
        elif number == 6 and s[5] == 0:
            bitmap = np.unpackbits(np.frombuffer(s, np.uint8, offset=6))[: nx * ny].astype(bool)
        elif number == 7:
            body = s[5:]
            if template == 41:
                codes = png_codes(body).ravel()
            elif template == 0:
                if bits == 0:
                    codes = np.zeros(points, np.int64)
                else:
                    flat = np.unpackbits(np.frombuffer(body, np.uint8))[: points * bits].reshape(points, bits).astype(np.int64)
                    codes = (flat << np.arange(bits - 1, -1, -1)).sum(1)
            else:
                raise ValueError(f"packing {template} isn't supported")
            values = (reference + codes * 2.0**binary) / 10.0**decimal
            break
        at += size
    field = np.full(nx * ny, np.nan)
    if bitmap is None:
        field[:] = values
    else:
        field[bitmap] = values[: int(bitmap.sum())]
    field = field.reshape(ny, nx)
    if mode & 0x40:  # rows from the south
        field = field[::-1]
        meta["lat1"], meta["lat2"] = meta["lat2"], meta["lat1"]
    return field[:, ::-1] if mode & 0x80 else field, meta
