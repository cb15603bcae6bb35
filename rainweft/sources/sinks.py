"""Writers of forecasts: Parquet by lead time, netCDF and GeoTIFF files, and rain tables for runoff models as text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweft.errors import DirectoryNotEmpty
from rainweft.functions import projections
from rainweft.sources import geotiff, netcdf3
from rainweft.sources.rasters import opened_netcdf


def write_forecast(forecast: DataFrame, path: str, fmt: str = "parquet", incremental: str | None = None, **options) -> None:
    """Write ``(case, member, lead, ny, nx, data)`` rows.

    fmt ``parquet`` partitions by lead (or by ``incremental``: timestep or
    member); ``kineros`` writes one text block per cell and member; ``netcdf``
    and ``geotiff`` write files, see ``forecast_files``.
    """
    if incremental not in (None, "timestep", "member"):
        raise ValueError(f"unknown incremental mode {incremental}")
    if fmt == "parquet":
        by = {"member": "member"}.get(incremental or "", "lead")
        forecast.write.mode("append" if incremental else "errorifexists").partitionBy(by).parquet(path)
    elif fmt == "kineros":
        if incremental:
            raise ValueError("this text format can't be written incrementally")
        kineros_blocks(forecast, **options).write.partitionBy("member").text(path)
    elif fmt in ("netcdf", "geotiff"):
        if fmt == "geotiff" and incremental == "member":
            raise ValueError("a GeoTIFF holds all members of a time")
        save_files(forecast_files(forecast, fmt, incremental, **options), path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def kineros_blocks(forecast: DataFrame, unit: str = "mm", step_minutes: float = 5.0) -> DataFrame:
    """``(member, value)``: per cell a block of cumulated depths over the lead times."""
    if unit not in ("mm", "mm/h"):
        raise ValueError("unit must be mm or mm/h")
    cells = forecast.select("member", "lead", "nx", F.posexplode("data").alias("pos", "v"))
    per = cells.groupBy("member", "pos", "nx").agg(F.array_sort(F.collect_list(F.struct("lead", "v"))).alias("s"))
    factor = 1.0 if unit == "mm" else step_minutes / 60.0
    upto = lambda i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0.0), lambda a, e: a + F.coalesce(e["v"], F.lit(0.0)) * factor)
    lines = F.transform("s", lambda e, i: F.format_string("%10.2f %10.2f", e["lead"] * step_minutes, upto(i)))
    head = F.format_string("BEGIN RG%03d\n  X = %d, Y = %d\n  N = %d\n  TIME  DEPTH\n", F.col("pos") + 1, (F.col("pos") % F.col("nx")).cast("int"), (F.col("pos") / F.col("nx")).cast("int"), F.size("s"))
    return per.select("member", F.concat(head, F.array_join(lines, "\n"), F.lit("\nEND\n")).alias("value"))


def ensure_empty(spark: SparkSession, path: str) -> None:
    """Raises DirectoryNotEmpty where the folder holds files."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path) and len(fs.listStatus(fs_path)):
        raise DirectoryNotEmpty(path)


def store_model(levels: DataFrame, path: str) -> None:
    """Append a decomposed model run, partitioned by ``analysis_time``."""
    levels.write.mode("append").partitionBy("analysis_time").parquet(path)


def load_model(spark: SparkSession, path: str, analysis_time: str, start: int, steps: int) -> DataFrame:
    """Valid steps ``start .. start + steps`` of one stored run; IndexError beyond its horizon."""
    run = spark.read.parquet(path).where(F.col("analysis_time") == analysis_time)
    part = run.where(F.col("t").between(start, start + steps))
    if part.agg(F.count_distinct("t")).first()[0] < steps + 1:
        raise IndexError("the stored run doesn't reach that far")
    return part


def file_name(prefix: str, start: datetime | None, minutes: float | None = None, member: int | None = None, extension: str = "nc") -> str:
    """Name of a forecast's file: prefix, start, and lead minutes or member where a file holds but one."""
    parts = [prefix, start.strftime("%Y%m%d%H%M") if start else "", f"{round(minutes):03d}" if minutes is not None else "", f"m{member:03d}" if member is not None else ""]
    return "_".join(p for p in parts if p) + "." + extension


def forecast_files(
    forecast: DataFrame, fmt: str, incremental: str | None = None, prefix: str = "nowcast", start: datetime | None = None, step_minutes: float = 5.0, meta: dict | None = None, packing: tuple[float, float] | None = None, keys: Sequence[str] = ("case",)
) -> DataFrame:
    """``(name, content)``: the files of a forecast, made on the executors.

    netcdf: dimensions ens_number, time, y, x; a file per case, per case and lead
    (``timestep``) or per case and member. geotiff: a file per case and lead, a
    band per member. meta: unit, projection, extent and so on of the grid;
    packing: scale and offset of 2-byte integers. A case is put together in one
    row, so its members and leads must fit a task; missing cells are fill values.
    """
    meta = meta or {}
    by = [*keys, *({"timestep": ["lead"], "member": ["member"]}.get(incremental or "", []) if fmt == "netcdf" else ["lead"])]
    packed = F.array_sort(F.collect_list(F.struct("member", "lead", "data")))
    rows = forecast.groupBy(*by).agg(F.max("ny").alias("ny"), F.max("nx").alias("nx"), packed.alias("fields"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents = [], []
            for r in b.to_pylist():
                members, leads = sorted({f["member"] for f in r["fields"]}), sorted({f["lead"] for f in r["fields"]})
                cube = np.full((len(members), len(leads), r["ny"], r["nx"]), np.nan)
                for f in r["fields"]:
                    cube[members.index(f["member"]), leads.index(f["lead"])] = np.array(f["data"], float).reshape(r["ny"], r["nx"])
                tag = prefix + "".join(f"-{r[k]}" for k in keys)
                if fmt == "geotiff":
                    contents.append(_tiff(cube[:, 0], leads[0] * step_minutes, start, meta))
                    names.append(file_name(tag, start, leads[0] * step_minutes, extension="tif"))
                else:
                    contents.append(netcdf3.dumps(_dataset(cube, members, [x * step_minutes for x in leads], start, meta, packing)))
                    names.append(file_name(tag, start, leads[0] * step_minutes if incremental == "timestep" else None, members[0] if incremental == "member" else None))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


def _coordinates(meta: dict, ny: int, nx: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell centres; rows as they are stored (from the top where the origin is the upper one)."""
    dx, dy = meta.get("xpixelsize", 1.0), meta.get("ypixelsize", 1.0)
    x = meta.get("x1", 0.0) + (np.arange(nx) + 0.5) * dx
    y = meta.get("y1", 0.0) + (np.arange(ny) + 0.5) * dy
    return x, y[::-1] if meta.get("yorigin", "upper") == "upper" else y


# Variable, long name of a unit.
_NAMED = {"mm/h": ("precip_intensity", "instantaneous precipitation rate"), "mm": ("precip_accum", "accumulated precipitation"), "dBZ": ("reflectivity", "equivalent reflectivity factor")}


def _dataset(cube: np.ndarray, members: list[int], minutes: list[float], start: datetime | None, meta: dict, packing: tuple[float, float] | None) -> netcdf3.Dataset:
    ds = netcdf3.Dataset(attrs={"Conventions": "CF-1.7", "title": "precipitation nowcast", "institution": meta.get("institution") or "", "references": ""})
    x, y = _coordinates(meta, *cube.shape[2:])
    ds.add("ens_number", ("ens_number",), np.array(members, "i4"), long_name="ensemble member", units="1")
    ds.add("time", ("time",), np.array(minutes, float), long_name="lead time", units=f"minutes since {(start or datetime(1970, 1, 1)):%Y-%m-%d %H:%M:%S}")
    ds.add("y", ("y",), y, axis="Y", standard_name="projection_y_coordinate", units=meta.get("cartesian_unit", "m"))
    ds.add("x", ("x",), x, axis="X", standard_name="projection_x_coordinate", units=meta.get("cartesian_unit", "m"))
    if meta.get("projection"):
        ds.add("projection", (), np.array(0, "i4"), proj4=meta["projection"], **(projections.to_grid_mapping(meta["projection"]) or {}))
    name, text = _NAMED.get(meta.get("unit", "mm/h"), _NAMED["mm/h"])
    attrs: dict = {"long_name": text, "units": meta.get("unit", "mm/h"), "coordinates": "y x", "grid_mapping": "projection"}
    for k in ("accutime", "threshold", "zerovalue", "zr_a", "zr_b"):
        if meta.get(k) is not None:
            attrs[k] = float(meta[k])
    if packing:
        scale, offset = packing
        codes = np.where(np.isfinite(cube), np.clip(np.round((cube - offset) / scale), -32767, 32767), -32768).astype("i2")
        ds.add(name, ("ens_number", "time", "y", "x"), codes, scale_factor=float(scale), add_offset=float(offset), _FillValue=np.int16(-32768), **attrs)
    else:
        ds.add(name, ("ens_number", "time", "y", "x"), np.where(np.isfinite(cube), cube, -9999.0).astype("f4"), _FillValue=np.float32(-9999.0), **attrs)
    return ds


def _tiff(bands: np.ndarray, minutes: float, start: datetime | None, meta: dict) -> bytes:
    ny = bands.shape[1]
    dx, dy = meta.get("xpixelsize", 1.0), meta.get("ypixelsize", 1.0)
    top = meta.get("y2", meta.get("y1", 0.0) + ny * dy)
    bands = bands if meta.get("yorigin", "upper") == "upper" else bands[:, ::-1]
    valid = (start + timedelta(minutes=minutes)).isoformat() if start else ""
    return geotiff.dumps(bands, meta.get("x1", 0.0), top, dx, dy, meta.get("projection") or "", metadata={"unit": meta.get("unit", "mm/h"), "lead_minutes": minutes, "valid": valid})


def save_files(files: DataFrame, path: str) -> int:
    """Write ``(name, content)`` rows as files of a folder that all executors reach; a file appears whole or not at all. Returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"  # a second attempt of a task replaces the first's file
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    return files.mapInArrow(run, "name string").count()


def read_forecast_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, member, lead, ny, nx, data, unit)``: every field of exported netCDF files; lead in minutes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                ds = opened_netcdf(raw)
                name = next(n for n, _ in _NAMED.values() if n in ds.variables)
                cube = netcdf3.values(ds.variables[name])
                m, t, ny, nx = cube.shape
                flat = cube.reshape(-1)
                data = pa.ListArray.from_arrays(pa.array(np.arange(m * t + 1, dtype=np.int32) * ny * nx), pa.array(flat, mask=~np.isfinite(flat)))
                many = lambda v, kind: pa.array([v] * (m * t), kind)
                yield pa.RecordBatch.from_arrays(
                    [many(p, pa.string()), pa.array(np.repeat(ds.variables["ens_number"].data, t), pa.int32()), pa.array(np.tile(ds.variables["time"].data.astype(float), m)), many(ny, pa.int32()), many(nx, pa.int32()), data, many(ds.variables[name].attrs.get("units"), pa.string())],
                    names=["path", "member", "lead", "ny", "nx", "data", "unit"],
                )

    return files.mapInArrow(run, "path string, member int, lead double, ny int, nx int, data array<double>, unit string")
