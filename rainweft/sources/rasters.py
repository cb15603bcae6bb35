"""Readers of radar composites.

Files are scanned as binary rows, so listing, pruning by path and parallelism
are Spark's; each file is decoded in an Arrow batch to one frame row. PGM,
RADOLAN, GeoTIFF, GRIB2 and classic netCDF files need no further library; formats
that do raise MissingOptionalDependency where it is absent.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweft.errors import DataModelError, MissingOptionalDependency
from rainweft.functions import projections
from rainweft.sources import geotiff, grib2, netcdf3

META = "projection string, x1 double, y1 double, x2 double, y2 double, xpixelsize double, ypixelsize double, cartesian_unit string, yorigin string, institution string, unit string, transform string, accutime double, threshold double, zerovalue double, zr_a double, zr_b double"
FRAME = f"path string, ts timestamp_ntz, ny int, nx int, data array<double>, quality array<double>, meta struct<{', '.join(x.replace(' ', ':') for x in META.split(', '))}>, error string"
_META_NAMES = [x.split()[0] for x in META.split(", ")]
_META_TYPE = pa.struct([(x.split()[0], pa.float64() if x.endswith("double") else pa.string()) for x in META.split(", ")])


def lowest_wet(values: np.ndarray) -> float:
    """Smallest finite value above the minimum, the minimum where the field is constant, NaN where nothing is finite."""
    good = values[np.isfinite(values)]
    if not good.size:
        return float("nan")
    above = good[good > good.min()]
    return float(above.min() if above.size else good.min())


def extent_of(projection: str, ny: int, nx: int, dx: float, dy: float, corner: tuple[float, float], origin: str = "lower") -> dict:
    """Extent of a grid from the longitude and latitude of its lower-left (or upper-left) outer corner."""
    x, y = (float(v) for v in projections.Projection(projection).forward(*corner))
    bottom = y if origin == "lower" else y - ny * dy
    return {"projection": projection, "x1": x, "y1": bottom, "x2": x + nx * dx, "y2": bottom + ny * dy, "xpixelsize": dx, "ypixelsize": dy}


# The Swiss grid.
SWISS = {
    "projection": "+proj=somerc +lon_0=7.43958333333333 +lat_0=46.9524055555556 +k_0=1 +x_0=600000 +y_0=200000 +ellps=bessel +towgs84=674.374,15.056,405.346,0,0,0,0 +units=m +no_defs",
    "x1": 255000.0, "y1": -160000.0, "x2": 965000.0, "y2": 480000.0, "xpixelsize": 1000.0, "ypixelsize": 1000.0, "cartesian_unit": "m", "yorigin": "upper",
}
# Lower-left corners (km) of the composites on the polar grid of the German service, by number of rows and columns.
POLAR = "+proj=stere +lat_0=90 +lat_ts=60 +lon_0=10 +a=6370040 +b=6370040 +units=m +no_defs"
POLAR_CORNERS = {(900, 900): (-523.4622, -4658.645), (1100, 900): (-443.462, -4758.645), (1500, 1400): (-673.462, -5008.645)}


def polar_geodata(ny: int, nx: int, size: float = 1000.0) -> dict:
    """Geodata of a composite on the polar grid; without extent where its size is unknown."""
    out = {"projection": POLAR, "xpixelsize": size, "ypixelsize": size, "cartesian_unit": "m", "yorigin": "lower"}
    if (ny, nx) in POLAR_CORNERS:
        x, y = (1000.0 * v for v in POLAR_CORNERS[ny, nx])
        out |= {"x1": x, "y1": y, "x2": x + nx * size, "y2": y + ny * size}
    return out


def coordinate_range(wanted: tuple[float, float] | None, full: np.ndarray) -> tuple[float, float]:
    """A wanted range in ascending order, the full one where none is given; outside of it an error."""
    lo, hi = float(np.min(full)), float(np.max(full))
    if wanted is None:
        return lo, hi
    a, b = sorted(wanted)
    if b < lo or a > hi:
        raise DataModelError(f"the range {a}..{b} lies outside {lo}..{hi}")
    return a, b


def read_pgm(raw: bytes, **_) -> tuple[np.ndarray, None, dict]:
    """8-bit PGM (plain or gzipped) of reflectivity: dBZ = (v - 64) / 2; the header's last comment names the missing code."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head: dict[str, list[str]] = {}
    at, tokens, last = 0, [], None
    while len(tokens) < 4:
        end = raw.index(b"\n", at)
        line = raw[at:end].decode("latin-1").strip()
        at = end + 1
        if line.startswith("#"):
            words = line[1:].split()
            if words:
                head.setdefault(words[0], words[1:])
                last = words
        else:
            tokens += line.split()
    kind, nx, ny = tokens[0], int(tokens[1]), int(tokens[2])
    codes = np.frombuffer(raw, np.uint8, nx * ny, len(raw) - nx * ny) if kind == "P5" else np.array(raw[at:].split(), float)
    codes = codes.reshape(ny, nx).astype(float)
    missing = 255.0
    for w in head.get("missing", []) + (last or []):
        if re.fullmatch(r"\d+", w):
            missing = float(w)
    data = np.where(codes == missing, np.nan, (codes - 64.0) / 2.0)
    meta = {**_pgm_geodata(head, ny, nx), "yorigin": "upper", "institution": "fmi", "unit": "dBZ", "transform": "dB", "accutime": 5.0, "zr_a": 223.0, "zr_b": 1.53, "cartesian_unit": "m"}
    return data, None, meta


def _pgm_geodata(head: dict[str, list[str]], ny: int, nx: int) -> dict:
    """Projection and extent from the comments of the header: corners are longitude and latitude of the outer ones."""
    out = {"projection": head.get("projection", ["stereographic"])[0], "xpixelsize": 999.674, "ypixelsize": 999.620}
    try:
        if "type" in head or "centrallongitude" in head or "centrallatitude" in head:
            number = lambda k, d: float(head.get(k, [d])[0])
            text = f"+proj=stere +lon_0={number('centrallongitude', 25.0)} +lat_0=90 +lat_ts={number('truelatitude', 60.0)} +a=6371288 +b=6371288"
            grid = projections.Projection(text)
            (x1, y1), (x2, y2) = (tuple(float(v) for v in grid.forward(*map(float, head[k][:2]))) for k in ("bottomleft", "topright"))
            out = {"projection": text, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "xpixelsize": (x2 - x1) / nx, "ypixelsize": (y2 - y1) / ny}
    except (KeyError, ValueError, IndexError):
        pass  # a header without corners has no extent
    return out


def info_bits(codes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Two-byte codes without their flags, and the flags: secondary (13), no data (14), negative (15), clutter (16)."""
    names = {"secondary": 12, "nodata": 13, "negative": 14, "clutter": 15}
    flags = {k: (codes >> b) & 1 == 1 for k, b in names.items()}
    return codes & 0x0FFF, flags


def read_radolan(raw: bytes, **_) -> tuple[np.ndarray, None, dict]:
    """RADOLAN binary composite: text header up to ETX, then one- or two-byte values from the lower left."""
    end = raw.index(b"\x03")
    head, body = raw[:end].decode("latin-1"), raw[end + 1 :]
    product = head[:2]
    size = re.search(r"GP\s*(\d+)\s*x\s*(\d+)", head)
    ny, nx = int(size.group(1)), int(size.group(2))
    scale = re.search(r"PR\s*E([+-]\d+)", head)
    factor = 10.0 ** int(scale.group(1)) if scale else 1.0
    step = re.search(r"INT\s*(\d+)", head)
    if len(body) >= 2 * ny * nx:
        values, flags = info_bits(np.frombuffer(body, "<u2", ny * nx).astype(np.int64))
        data = np.where(flags["negative"], -values, values) * factor
        data = np.where(flags["nodata"] | (values == 2500) & flags["nodata"], np.nan, data)
        data = np.where(flags["clutter"], 0.0, data)
    else:
        codes = np.frombuffer(body, np.uint8, ny * nx)
        data = np.where(codes >= 250, np.nan, codes / 2.0 - 32.5)
    unit = "dBZ" if product in ("RX", "WX", "EX") else "mm"
    meta = {**polar_geodata(ny, nx), "institution": "Deutscher Wetterdienst", "unit": unit, "transform": "dB" if unit == "dBZ" else None, "accutime": float(step.group(1)) if step else 5.0, "zr_a": 200.0, "zr_b": 1.6}
    return data.reshape(ny, nx).astype(float), None, meta


def _needs(library: str) -> Callable:
    try:
        return __import__(library)
    except ImportError as e:
        raise MissingOptionalDependency(f"this format needs {library}") from e


def unpacked(raw: np.ndarray, gain: float, offset: float, nodata: float, undetect: float, dry: float | None = None) -> np.ndarray:
    """Stored codes to values: nodata is missing, undetect is ``dry`` (missing where None)."""
    out = raw.astype(float) * gain + offset
    out = np.where(raw == undetect, np.nan if dry is None else dry, out)
    return np.where(raw == nodata, np.nan, out)


def _attributes(group) -> dict:
    return {k: (v.decode() if isinstance(v, bytes) else v) for k, v in group.attrs.items()}


def _minutes(what: dict) -> float | None:
    """Minutes between the start and end stated in a group."""
    try:
        a, b = (datetime.strptime(str(what[f"{k}date"]) + str(what[f"{k}time"]), "%Y%m%d%H%M%S") for k in ("start", "end"))
    except (KeyError, ValueError):
        return None
    return (b - a).total_seconds() / 60 or None


def odim_tree(group) -> dict:
    """A file as nested dictionaries: groups, data sets as arrays, attributes under ``attrs``."""
    out: dict = {"attrs": _attributes(group)}
    for name in group:
        out[name] = odim_tree(group[name]) if hasattr(group[name], "keys") else group[name][...]
    return out


def odim_field(tree: dict, qty: str, dry: Callable[[str, float], float | None]) -> tuple[np.ndarray, np.ndarray | None, dict]:
    """The field of a quantity in an ODIM tree with quality, geodata and accumulation time.

    What a data group doesn't state is taken from its data set, then from the root.
    """
    root = tree.get("what", {}).get("attrs", {})
    for name in sorted(k for k in tree if k.startswith("dataset")):
        outer = tree[name]
        for inner in sorted(k for k in outer if k.startswith("data") and isinstance(outer[k], dict)):
            what = root | outer.get("what", {}).get("attrs", {}) | outer[inner].get("what", {}).get("attrs", {})
            if what.get("quantity") != qty:
                continue
            data = unpacked(np.asarray(outer[inner]["data"]), what["gain"], what["offset"], what["nodata"], what["undetect"], dry(qty, what["offset"]))
            quality = None
            for where in (outer[inner], outer):
                for q in sorted(k for k in where if k.startswith("quality") and isinstance(where[k], dict)):
                    own = where[q].get("what", {}).get("attrs", {})
                    if quality is None and "data" in where[q]:
                        quality = unpacked(np.asarray(where[q]["data"]), own.get("gain", 1.0), own.get("offset", 0.0), own.get("nodata", np.nan), own.get("undetect", np.nan))
            where = tree.get("where", {}).get("attrs", {}) | outer.get("where", {}).get("attrs", {})
            meta = {"projection": where.get("projdef"), "xpixelsize": where.get("xscale"), "ypixelsize": where.get("yscale"), "yorigin": "upper", "cartesian_unit": "m"}
            meta |= {"unit": {"RATE": "mm/h", "ACRR": "mm", "DBZH": "dBZ"}[qty], "transform": "dB" if qty == "DBZH" else None, "accutime": _minutes(what) or 5.0, "institution": str(root.get("source", "")) or None}
            how = tree.get("how", {}).get("attrs", {}) | outer.get("how", {}).get("attrs", {})
            meta |= {"zr_a": float(how.get("zr_a", 200.0)), "zr_b": float(how.get("zr_b", 1.6))}
            if {"LL_lon", "LL_lat", "UR_lon", "UR_lat"} <= set(where) and where.get("projdef"):
                try:
                    grid = projections.Projection(meta["projection"])
                    x, y = grid.forward([where["LL_lon"], where["UR_lon"]], [where["LL_lat"], where["UR_lat"]])
                    meta |= {"x1": float(x[0]), "x2": float(x[1]), "y1": float(y[0]), "y2": float(y[1])}
                    meta["xpixelsize"] = meta["xpixelsize"] or (meta["x2"] - meta["x1"]) / data.shape[1]
                    meta["ypixelsize"] = meta["ypixelsize"] or (meta["y2"] - meta["y1"]) / data.shape[0]
                except ValueError:
                    pass  # a projection without formulas here has no extent
            return data, quality, meta
    raise ValueError(f"no data set holds {qty}")


def _hdf5(dry: Callable[[str, float], float | None], **fixed) -> Callable:
    """ODIM files: the data set of the wanted quantity with its gain, offset, nodata and undetect."""

    def read(raw: bytes, qty: str = "RATE", **_) -> tuple[np.ndarray, np.ndarray | None, dict]:
        h5py = _needs("h5py")
        with h5py.File(io.BytesIO(raw), "r") as f:
            data, quality, meta = odim_field(odim_tree(f), qty, dry)
        return data, quality, meta | fixed

    return read


def _knmi(raw: bytes, qty: str = "ACRR", accutime: float = 5.0, **_):
    h5py = _needs("h5py")
    with h5py.File(io.BytesIO(raw), "r") as f:
        codes = f["image1"]["image_data"][...]
    data = np.where(codes == 65535, np.nan, codes / 100.0) if qty == "ACRR" else np.where(codes == 255, np.nan, codes * 0.5 - 32.0)
    return data, None, {"unit": "mm" if qty == "ACRR" else "dBZ", "transform": None if qty == "ACRR" else "dB", "accutime": accutime, "yorigin": "upper", "institution": "KNMI", "cartesian_unit": "km"}


def _gif(raw: bytes, product: str = "AQC", accutime: float = 5.0, **_):
    image = _needs("PIL.Image")
    codes = np.array(image.open(io.BytesIO(raw)), float) if hasattr(image, "open") else np.array(image.Image.open(io.BytesIO(raw)), float)
    data = np.where(codes == 255, np.nan, np.where(codes < 1, 0.0, (10 ** ((codes - 71.5) / 20.0) / 316.0) ** (1 / 1.5)))
    return data, None, {"unit": "mm", "accutime": accutime, "yorigin": "upper", "institution": "MeteoSwiss", **SWISS, "zr_a": 316.0, "zr_b": 1.5, "product": product}


def opened_netcdf(raw: bytes) -> netcdf3.Dataset:
    """A netCDF file of any kind as a classic data set; other than classic ones need netCDF4."""
    if raw[:3] == b"CDF":
        return netcdf3.loads(raw)
    nc = _needs("netCDF4")
    out = netcdf3.Dataset()
    with nc.Dataset("memory", memory=raw) as f:
        f.set_auto_maskandscale(False)
        out.dims = {k: len(v) for k, v in f.dimensions.items()}
        out.attrs = {k: f.getncattr(k) for k in f.ncattrs()}
        for k, v in f.variables.items():
            out.variables[k] = netcdf3.Variable(v.dimensions, v[...], {a: v.getncattr(a) for a in v.ncattrs()})
    return out


# Unit, transform of the variables that hold rain.
_RAIN = {"precip_intensity": ("mm/h", None), "precip_accum": ("mm", None), "hourly_precip_accum": ("mm", None), "reflectivity": ("dBZ", "dB"), "precipitation": ("mm", None), "rain_amount": ("mm", None), "crr_intensity": ("mm/h", None), "crr": ("mm/h", None)}


def netcdf_geodata(ds: netcdf3.Dataset, ny: int, nx: int) -> dict:
    """Projection, extent and cell size from coordinates and a grid mapping."""
    out: dict = {"cartesian_unit": "m"}
    mapped = next((v.attrs for v in ds.variables.values() if "grid_mapping_name" in v.attrs), None)
    projection = next((v.attrs[k] for v in ds.variables.values() for k in ("proj4", "proj_string") if k in v.attrs), None) or ds.attrs.get("gdal_projection")
    out["projection"] = projection or (projections.from_grid_mapping(mapped) if mapped else None)
    for axis, n in (("x", nx), ("y", ny)):
        names = {"x": ("xc", "x", "nx", "lon", "longitude"), "y": ("yc", "y", "ny", "lat", "latitude")}[axis]
        v = next((ds.variables[k] for k in names if k in ds.variables and ds.variables[k].data.shape == (n,)), None)
        if v is None or n < 2:
            continue
        c = v.data.astype(float) * (1000.0 if v.attrs.get("units") in ("km", "kilometers") else 1.0)
        size = abs(float(c[1] - c[0]))
        out |= {f"{axis}1": float(c.min()) - size / 2, f"{axis}2": float(c.max()) + size / 2, f"{axis}pixelsize": size}
        if axis == "y":
            out["yorigin"] = "upper" if c[0] > c[-1] else "lower"
    return out


def _netcdf(variables: tuple[str, ...], institution: str | None = None) -> Callable:
    def read(raw: bytes, extent: tuple[float, float, float, float] | None = None, **_):
        ds = opened_netcdf(raw)
        name = next((v for v in variables if v in ds.variables), None)
        if name is None:
            raise ValueError(f"none of {variables} is in the file")
        data = np.squeeze(netcdf3.values(ds.variables[name]))
        if data.ndim != 2:
            raise ValueError("the file holds several fields; see read_forecast_files")
        geo = netcdf_geodata(ds, *data.shape)
        quality = next((np.squeeze(netcdf3.values(ds.variables[k])) for k in (f"{name}_quality", "crr_quality", "quality") if k in ds.variables), None)
        if extent is not None and "x1" in geo and "y1" in geo:
            left, right = coordinate_range(extent[:2], np.array([geo["x1"], geo["x2"]]))
            bottom, top = coordinate_range(extent[2:], np.array([geo["y1"], geo["y2"]]))
            xs = geo["x1"] + (np.arange(data.shape[1]) + 0.5) * geo["xpixelsize"]
            ys = geo["y1"] + (np.arange(data.shape[0]) + 0.5) * geo["ypixelsize"]
            ys = ys[::-1] if geo.get("yorigin") == "upper" else ys
            x, y = np.flatnonzero((xs > left) & (xs < right)), np.flatnonzero((ys > bottom) & (ys < top))
            data = data[np.ix_(y, x)]
            quality = quality[np.ix_(y, x)] if quality is not None else None
            geo |= {"x1": xs[x[0]] - geo["xpixelsize"] / 2, "x2": xs[x[-1]] + geo["xpixelsize"] / 2, "y1": ys[y].min() - geo["ypixelsize"] / 2, "y2": ys[y].max() + geo["ypixelsize"] / 2}
        time = lambda k: float(np.ravel(ds.variables[k].data)[0]) / (60.0 if "sec" in str(ds.variables[k].attrs.get("units", "sec")) else 1.0) if k in ds.variables else None
        start, end = time("start_time"), time("valid_time")
        unit, transform = _RAIN.get(name, ("mm/h", None))
        if institution is None and ds.variables[name].attrs.get("units") in ("mm/h", "mm", "dBZ"):
            unit = ds.variables[name].attrs["units"]
        return data, quality, {"yorigin": "upper"} | geo | {"unit": unit, "transform": transform, "institution": institution or ds.attrs.get("institution"), "accutime": end - start if start is not None and end is not None else None}

    return read


def _tiff(raw: bytes, **_):
    """Reflectivity codes as in the PGM form: dBZ = (v - 64) / 2, 255 missing."""
    bands, geo = geotiff.loads(raw)
    data = np.where(bands[0] == 255, np.nan, (bands[0] - 64.0) / 2.0)
    ny, nx = data.shape
    meta = {"projection": geo["projection"], "yorigin": "upper", "institution": "Finnish Meteorological Institute", "unit": "dBZ", "transform": "dB", "accutime": 5.0, "zr_a": 223.0, "zr_b": 1.53, "cartesian_unit": "m"}
    if "dx" in geo:
        meta |= {"x1": geo["left"], "x2": geo["left"] + nx * geo["dx"], "y2": geo["top"], "y1": geo["top"] - ny * geo["dy"], "xpixelsize": geo["dx"], "ypixelsize": geo["dy"]}
    return data, None, meta


def _grib(raw: bytes, extent: tuple[float, float, float, float] | None = None, window_size: int = 4, **_):
    """Rain rates of a latitude-longitude mosaic; -3 is missing, blocks of ``window_size`` cells are averaged."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    field, g = grib2.loads(raw)
    data = np.where(field == -3, np.nan, field)
    ny, nx = data.shape
    lons, lats = g["lon1"] + g["dlon"] * np.arange(nx), g["lat1"] - g["dlat"] * np.arange(ny)
    lons = np.where(lons > 180, lons - 360, lons)
    if extent is not None:
        left, right = coordinate_range(extent[:2], lons)
        bottom, top = coordinate_range(extent[2:], lats)
        x, y = np.flatnonzero((lons >= left) & (lons <= right)), np.flatnonzero((lats >= bottom) & (lats <= top))
        data, lons, lats = data[np.ix_(y, x)], lons[x], lats[y]
    w = max(1, window_size)
    ny, nx = data.shape[0] // w, data.shape[1] // w
    blocks = data[: ny * w, : nx * w].reshape(ny, w, nx, w)
    there = np.isfinite(blocks)
    with np.errstate(invalid="ignore"):
        data = np.where(there, blocks, 0.0).sum((1, 3)) / np.where(there.any((1, 3)), there.sum((1, 3)), np.nan)
    dx, dy = g["dlon"] * w, g["dlat"] * w
    x1, y2 = float(lons[0] - g["dlon"] / 2), float(lats[0] + g["dlat"] / 2)
    meta = {"projection": "+proj=longlat +ellps=IAU76", "x1": x1, "x2": x1 + nx * dx, "y1": y2 - ny * dy, "y2": y2, "xpixelsize": dx, "ypixelsize": dy, "cartesian_unit": "degrees", "yorigin": "upper", "institution": "NOAA National Severe Storms Laboratory", "unit": "mm/h", "accutime": 2.0, "zr_a": 200.0, "zr_b": 1.6}
    return data, None, meta


def _missing(library: str) -> Callable:
    def read(raw: bytes, **_):
        _needs(library)
        raise MissingOptionalDependency(f"no decoder over {library} is built in")

    return read


FORMATS: dict[str, Callable] = {
    "fmi_pgm": read_pgm,
    "dwd_radolan": read_radolan,
    "odim_hdf5": _hdf5(lambda q, offset: -30.0 if q == "DBZH" else offset),
    "opera_hdf5": _hdf5(lambda q, offset: -30.0 if q == "DBZH" else offset),
    "dwd_hdf5": _hdf5(lambda q, offset: -32.5 if q == "DBZH" else offset),
    "mch_hdf5": _hdf5(lambda q, offset: None, **SWISS, institution="MeteoSwiss", zr_a=316.0, zr_b=1.5),
    "knmi_hdf5": _knmi,
    "mch_gif": _gif,
    "mch_metranet": _missing("metranet"),
    "bom_rf3": _netcdf(("precipitation", "rain_amount"), "Commonwealth of Australia, Bureau of Meteorology"),
    "saf_crri": _netcdf(("crr_intensity", "crr"), "Agencia Estatal de Meteorologia"),
    "nowcast_netcdf": _netcdf(("precip_intensity", "precip_accum", "hourly_precip_accum", "reflectivity")),
    "mrms_grib": _grib,
    "fmi_geotiff": _tiff,
}
_LIBRARY = {"odim_hdf5": "h5py", "opera_hdf5": "h5py", "dwd_hdf5": "h5py", "mch_hdf5": "h5py", "knmi_hdf5": "h5py", "mch_gif": "PIL", "mch_metranet": "metranet"}


def _time_of(path: str, pattern: str | None) -> datetime | None:
    if not pattern:
        return None
    try:
        return datetime.strptime(path.rsplit("/", 1)[-1][: len(datetime(2000, 1, 1).strftime(pattern))], pattern)
    except ValueError:
        return None


def read_frames(spark: SparkSession, path: str | list[str], fmt: str, time_pattern: str | None = None, glob: str | None = None, times: tuple[datetime, datetime] | None = None, **options) -> DataFrame:
    """One row per file: path, ts (by ``time_pattern`` over the file name), ny, nx, data, quality, meta, error.

    With ``times`` (first and last, both included) only files named so are opened.
    Values that aren't finite are null; threshold and zerovalue are taken from the
    field. A file that can't be decoded gives a row with null data and the reason
    in ``error``.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt in _LIBRARY:
        _needs(_LIBRARY[fmt])
    decode = FORMATS[fmt]
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if times and time_pattern:  # the listing is the driver's anyway; contents of other files aren't read
        listed = [r["path"] for r in reader.load(path).select("path").toLocalIterator()]
        path = [p for p in listed if (at := _time_of(p, time_pattern)) and times[0] <= at <= times[1]]
        if not path:
            return spark.createDataFrame([], FRAME)
    files = reader.load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                ts, error = _time_of(p, time_pattern), None
                try:
                    data, quality, meta = decode(raw, **options)
                except MissingOptionalDependency:
                    raise
                except Exception as e:  # whatever a broken file brings about is its row's error
                    data, quality, meta, error = None, None, {}, f"{type(e).__name__}: {e}"
                if data is not None:
                    least = np.nanmin(data) if np.isfinite(data).any() else np.nan
                    meta = {"threshold": lowest_wet(data), "zerovalue": float(least), **meta}
                full = {k: meta.get(k) for k in _META_NAMES}
                size = [pa.array([None if data is None else data.shape[k]], pa.int32()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([ts], pa.timestamp("us")), *size, _list(data), _list(quality), pa.array([full], _META_TYPE), pa.array([error], pa.string())],
                    names=["path", "ts", "ny", "nx", "data", "quality", "meta", "error"],
                )

    return files.mapInArrow(run, FRAME)


def _list(raster: np.ndarray | None) -> pa.Array:
    """One list of the cells of a raster, those that aren't finite null; a null where there is no raster."""
    if raster is None:
        return pa.array([None], pa.list_(pa.float64()))
    flat = np.asarray(raster, float).ravel()
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, mask=~np.isfinite(flat)))


def archive(spark: SparkSession, spine: DataFrame, files: DataFrame) -> DataFrame:
    """Times of a spine with their file's frame; missing ones have null data. ``files`` comes from read_frames."""
    return spine.join(files.drop("path", "error"), "ts", "left").orderBy("ts")


def importers_info(spark: SparkSession) -> DataFrame:
    """``(name, library, available)`` of every format."""
    rows = []
    for name in FORMATS:
        library = _LIBRARY.get(name)
        try:
            if library:
                __import__(library)
            ok = True
        except ImportError:
            ok = False
        rows.append((name, library, ok))
    return spark.createDataFrame(rows, "name string, library string, available boolean")
