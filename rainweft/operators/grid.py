"""Rasters as cell rows ``(keys..., t, y, x, v)`` and as one array per row; null is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainweft.functions.transforms import missing_to_null
from rainweft.workspace import require

N = 32
STEPS = 30


def full_grid(spark: SparkSession, nt: int, ny: int, nx: int) -> DataFrame:
    """Every cell of a ``nt`` x ``ny`` x ``nx`` raster, made on the executors."""
    i = spark.range(nt * ny * nx).withColumnRenamed("id", "i")
    return i.select((F.col("i") / (ny * nx)).cast("int").alias("t"), (F.col("i") / nx % ny).cast("int").alias("y"), (F.col("i") % nx).cast("int").alias("x"))


def densify(cells: DataFrame, grid: DataFrame, fill: float | None = None) -> DataFrame:
    """Cells on the whole grid; absent ones are null or ``fill``."""
    v = F.col("v") if fill is None else F.coalesce("v", F.lit(fill))
    return grid.join(cells, ["t", "y", "x"], "left").select("t", "y", "x", v.alias("v"))


def observed(events: DataFrame, n: int = N, steps: int = STEPS) -> DataFrame:
    """A daily raster derived from an event table: the sum of value per cell, 0 where no event is."""
    e = require(events, "ts", "user_id", "event_id", "value")
    cells = e.groupBy(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), (F.col("user_id") % n).cast("int").alias("y"), (F.col("event_id") % n).cast("int").alias("x")
    ).agg(F.sum("value").alias("v"))
    return densify(cells, full_grid(events.sparkSession, steps, n, n), 0.0).select("t", "y", "x", F.round("v", 6).alias("v"))


def import_cells(cells: DataFrame, fill: float | None = None, dtype: str = "double") -> DataFrame:
    """Non-finite values to null (or ``fill``) and a cast, as after every reader."""
    if dtype not in ("float32", "float64", "single", "double"):
        raise ValueError(f"unknown dtype {dtype}")
    return cells.withColumn("v", missing_to_null(F.col("v"), fill).cast("float" if dtype in ("float32", "single") else "double"))


def to_tensor(cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """One row per raster: ``(keys..., ny, nx, data)``, row by row; the cells must be dense."""
    packed = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    out = cells.groupBy(*keys).agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"), packed.alias("p"))
    return out.select(*keys, "ny", "nx", F.transform("p", lambda s: s["v"]).alias("data"))


def to_cells(tensors: DataFrame, keys: Sequence[str] = ("t",), data: str = "data") -> DataFrame:
    """Back to cell rows."""
    e = tensors.select(*keys, "nx", F.posexplode(data).alias("pos", "v"))
    return e.select(*keys, (F.col("pos") / F.col("nx")).cast("int").alias("y"), (F.col("pos") % F.col("nx")).cast("int").alias("x"), "v")


def strict_avg(v: Column) -> Column:
    """Mean that is null as soon as one value is."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))


def strict_sum(v: Column) -> Column:
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def aggregate_time(cells: DataFrame, n: int, method: str = "mean", ignore_missing: bool = False) -> DataFrame:
    """Blocks of ``n`` frames: mean (rates) or sum (depths); ``t`` is the last frame of the block.

    Frames of an unfinished last block are an error of the caller; see ``check_divides``.
    """
    agg = {("mean", False): strict_avg, ("sum", False): strict_sum, ("mean", True): F.avg, ("sum", True): F.sum}[method, ignore_missing]
    block = (F.col("t") / n).cast("int")
    return cells.groupBy(block.alias("b"), "y", "x").agg(agg(F.col("v")).alias("v")).select((F.col("b") * n + n - 1).alias("t"), "y", "x", "v")


def aggregate_space(cells: DataFrame, ny: int, nx: int, method: str = "mean", ignore_missing: bool = False) -> DataFrame:
    """Blocks of ``ny`` x ``nx`` cells."""
    agg = {("mean", False): strict_avg, ("sum", False): strict_sum, ("mean", True): F.avg, ("sum", True): F.sum}[method, ignore_missing]
    return cells.groupBy("t", (F.col("y") / ny).cast("int").alias("y"), (F.col("x") / nx).cast("int").alias("x")).agg(agg(F.col("v")).alias("v"))


_METHODS = {
    "mean": strict_avg, "sum": strict_sum, "nanmean": F.avg, "nansum": F.sum, "min": F.min, "max": F.max, "median": lambda v: F.percentile(v, 0.5),
}


def aggregate_fields(cells: DataFrame, windows: dict[str, int], method: str = "mean", trim: bool = False, sizes: dict[str, int] | None = None) -> DataFrame:
    """Blocks along any of t, y and x; each axis counts blocks from 0.

    mean and sum are null as soon as a cell is, the nan- forms, min, max and
    median skip missing cells. sizes: lengths of the axes; a window that doesn't
    divide its axis is an error, with ``trim`` the cells of the rest are left out.
    """
    if method not in _METHODS:
        raise ValueError(f"unknown method {method}; there are {sorted(_METHODS)}")
    for axis, n in windows.items():
        if sizes and axis in sizes:
            whole = check_divides(sizes[axis], n, trim)
            cells = cells.where(F.col(axis) < whole * n)
    block = [(F.floor(F.col(a) / windows[a]).cast("int") if a in windows else F.col(a)).alias(a) for a in ("t", "y", "x")]
    return cells.groupBy(*block).agg(_METHODS[method](F.col("v")).alias("v"))


def check_divides(length: int, window: int, trim: bool = False) -> int:
    """Number of whole windows; unless ``trim``, the window must divide the length."""
    if window <= 0 or (length % window and not trim):
        raise ValueError(f"{window} doesn't divide {length}")
    return length // window


def clip_domain(cells: DataFrame, geodata: dict, extent: tuple[float, float, float, float], zerovalue: float = 0.0, steps: int = STEPS) -> DataFrame:
    """Cells whose centre lies strictly inside (left, right, bottom, top); outside the old domain zerovalue."""
    left, right, bottom, top = extent
    dx, dy = geodata["xpixelsize"], geodata["ypixelsize"]
    x0, y0 = geodata["x1"], geodata["y1"]
    xs = [i for i in range(int((left - x0) / dx) - 1, int((right - x0) / dx) + 2) if left < x0 + (i + 0.5) * dx < right]
    ys = [i for i in range(int((bottom - y0) / dy) - 1, int((top - y0) / dy) + 2) if bottom < y0 + (i + 0.5) * dy < top]
    if geodata.get("yorigin", "lower") == "upper":
        rows = round((geodata["y2"] - y0) / dy)
        ys = sorted(rows - 1 - i for i in ys)
    grid = full_grid(cells.sparkSession, steps, len(ys), len(xs)).select("t", (F.col("y") + ys[0]).alias("y"), (F.col("x") + xs[0]).alias("x"))
    inside = cells.where(F.col("y").between(ys[0], ys[-1]) & F.col("x").between(xs[0], xs[-1]))
    joined = grid.join(inside.withColumn("old", F.lit(True)), ["t", "y", "x"], "left")
    return joined.select("t", (F.col("y") - ys[0]).alias("y"), (F.col("x") - xs[0]).alias("x"), F.when(F.col("old"), F.col("v")).otherwise(zerovalue).alias("v"))


def square_domain(cells: DataFrame, ny: int, nx: int, method: str = "pad", fill: float = 0.0, steps: int = STEPS) -> DataFrame:
    """Padded (with ``fill``) or cropped about the centre to a square."""
    if method not in ("pad", "crop"):
        raise ValueError(method)
    side = max(ny, nx) if method == "pad" else min(ny, nx)
    oy, ox = abs(side - ny) // 2, abs(side - nx) // 2
    if method == "crop":
        return cells.where(F.col("y").between(oy, oy + side - 1) & F.col("x").between(ox, ox + side - 1)).select("t", (F.col("y") - oy).alias("y"), (F.col("x") - ox).alias("x"), "v")
    moved = cells.select("t", (F.col("y") + oy).alias("y"), (F.col("x") + ox).alias("x"), "v", F.lit(True).alias("old"))
    grid = full_grid(cells.sparkSession, steps, side, side)
    return grid.join(moved, ["t", "y", "x"], "left").select("t", "y", "x", F.when(F.col("old"), F.col("v")).otherwise(fill).alias("v"))


def unsquare_domain(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    """Undoes a padding to a square."""
    side = max(ny, nx)
    oy, ox = (side - ny) // 2, (side - nx) // 2
    return cells.where(F.col("y").between(oy, oy + ny - 1) & F.col("x").between(ox, ox + nx - 1)).select("t", (F.col("y") - oy).alias("y"), (F.col("x") - ox).alias("x"), "v")


def centred_coordinates(spark: SparkSession, ny: int, nx: int) -> DataFrame:
    """Index distance of every cell from the central one."""
    g = full_grid(spark, 1, ny, nx)
    return g.select("y", "x", (F.col("y") - ny // 2).alias("cy"), (F.col("x") - nx // 2).alias("cx"))


def rain_share(cells: DataFrame, threshold: float) -> DataFrame:
    """``(t, wet, dry)``: share of cells above the threshold; missing ones count as not above."""
    wet = F.avg(F.when(F.col("v") > threshold, 1.0).otherwise(0.0))
    return cells.groupBy("t").agg(wet.alias("wet"))


def no_rain(cells: DataFrame, threshold: float, most: float = 0.0) -> DataFrame:
    """``(t, wet, norain)`` with norain where the wet share doesn't pass ``most``."""
    return rain_share(cells, threshold).select("t", "wet", (F.col("wet") <= most).alias("norain"))


def after_last_dry(cells: DataFrame, threshold: float, most: float = 0.0) -> DataFrame:
    """The frames after the last dry one, which an autoregressive start needs."""
    dry = no_rain(cells, threshold, most).where("norain").agg(F.max("t").alias("last"))
    return cells.where(F.coalesce(F.col("t") > dry.scalar(), F.lit(True)))


def lowest_wet_value(cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Smallest value above the minimum of each raster, the minimum itself where it is constant."""
    least = Window.partitionBy(*keys)
    w = cells.withColumn("m", F.min("v").over(least))
    return w.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("v") > F.col("m"), F.col("v"))), F.min("m")).alias("threshold"))


def close_rain_gap(cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Removes the jump between no rain and the weakest rain: wet cells are lowered by it, then all by the minimum."""
    t = lowest_wet_value(cells, keys).withColumnRenamed("threshold", "thr")
    least = cells.groupBy(*keys).agg(F.min("v").alias("m"))
    j = cells.join(t, list(keys)).join(least, list(keys))
    gap = F.when(F.col("v") > F.col("m"), F.col("thr") - F.col("m")).otherwise(0.0)
    return j.withColumn("v", F.col("v") - gap - F.col("m")).select(*cells.columns)


def date_spine(spark: SparkSession, moment: str, step_minutes: int, before: int, after: int) -> DataFrame:
    """``(k, ts)``: the times of an archive query, ascending."""
    at = F.lit(moment).cast("timestamp_ntz")
    return spark.range(before + after + 1).select(
        (F.col("id") - before).cast("int").alias("k"), F.timestamp_add("MINUTE", ((F.col("id") - before) * step_minutes).cast("int"), at).alias("ts")
    )


def read_series(spine: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames at the times of a spine; a missing one has null data. The least threshold holds for all."""
    f = require(frames, "ts", "data", "threshold")
    least = spine.select("ts").join(f, "ts").agg(F.min("threshold"))
    return spine.join(f, "ts", "left").select("k", "ts", "data", least.scalar().alias("threshold"))


# Strftime directives as patterns of date_format.
_STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def formatted(ts: Column, pattern: str) -> Column:
    """A time in a strftime pattern; text between directives stands as it is."""
    parts, text, i = [], "", 0
    while i < len(pattern):
        code = _STRFTIME.get(pattern[i : i + 2])
        if code:
            if text:
                parts.append(F.lit(text))
            parts.append(F.date_format(ts, code))
            text, i = "", i + 2
        else:
            text, i = text + pattern[i], i + 1
    return F.concat(*parts, F.lit(text))


def expected_paths(spine: DataFrame, root: str, path_pattern: str, file_pattern: str, extension: str) -> DataFrame:
    """``(k, ts, folder, name)``: where an archive keeps the file of each time; ``name`` may hold ``*`` and ``?``."""
    folder = F.concat_ws("/", F.lit(root.rstrip("/")), formatted(F.col("ts"), path_pattern)) if path_pattern else F.lit(root.rstrip("/"))
    return spine.select("k", "ts", folder.alias("folder"), F.concat(formatted(F.col("ts"), file_pattern), F.lit("." + extension)).alias("name"))


def found_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``(k, ts, path)``: the listed file of each time, the first by name where a pattern fits several, null where none is there.

    ``files`` has ``path``. Files are joined on their folder, so only those of the
    asked folders meet their patterns.
    """
    f = files.select("path", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("file"))
    quoted = F.regexp_replace("name", r"([.+^$()\[\]{}|\\])", r"\\$1")
    like = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    j = expected.withColumn("pattern", F.concat(F.lit("^"), like, F.lit("$"))).join(f, "folder", "left")
    fits = F.when(F.expr("file rlike pattern"), F.col("path"))
    return j.groupBy("k", "ts").agg(F.min(fits).alias("path"))
