"""Storm cells carried from frame to frame by overlap joins.

``labels`` is ``(t, y, x, id)`` with one row per cell pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainweft.workspace import dropped, written


def cell_table(labels: DataFrame, field: DataFrame) -> DataFrame:
    """``(t, id, cen_y, cen_x, max_ref, area)``; centres are rounded half to even."""
    j = labels.join(field, ["t", "y", "x"])
    return j.groupBy("t", "id").agg(F.bround(F.avg("y")).cast("int").alias("cen_y"), F.bround(F.avg("x")).cast("int").alias("cen_x"), F.max("v").alias("max_ref"), F.count("*").alias("area"))


def cell_profiles(labels: DataFrame, field: DataFrame) -> DataFrame:
    """``cell_table`` with the places ``ys`` and ``xs`` of each cell's pixels, row by row."""
    p = F.array_sort(F.collect_list(F.struct("y", "x")))
    places = labels.groupBy("t", "id").agg(F.transform(p, lambda c: c["y"]).alias("ys"), F.transform(p, lambda c: c["x"]).alias("xs"))
    return cell_table(labels, field).join(places, ["t", "id"])


def advect_cells(labels: DataFrame, flow: DataFrame, ny: int, nx: int) -> DataFrame:
    """Pixels of each cell moved by the rounded mean flow under it, kept inside the raster, to the next frame."""
    j = labels.join(flow, ["y", "x"])
    w = Window.partitionBy("t", "id")
    u, v = F.bround(F.avg("u").over(w)).cast("int"), F.bround(F.avg("v").over(w)).cast("int")
    clamp = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    return j.select((F.col("t") + 1).alias("t"), "id", clamp(F.col("y") + v, ny).alias("y"), clamp(F.col("x") + u, nx).alias("x"))


def match_cells(advected: DataFrame, labels: DataFrame, share: float = 0.4) -> DataFrame:
    """``(t, id, next_id, overlap)``: the next frame's cell that a moved one covers most, if by ``share`` of it."""
    a = advected.distinct()
    size = a.groupBy("t", "id").agg(F.count("*").alias("size"))
    o = a.join(labels.withColumnRenamed("id", "next_id"), ["t", "y", "x"]).groupBy("t", "id", "next_id").agg(F.count("*").alias("n"))
    o = o.join(size, ["t", "id"]).withColumn("overlap", F.col("n") / F.col("size"))
    first = F.row_number().over(Window.partitionBy("t", "id").orderBy(F.desc("overlap"), "next_id"))
    return o.withColumn("r", first).where((F.col("r") == 1) & (F.col("overlap") >= share)).select("t", "id", "next_id", "overlap")


def splits(advected: DataFrame, labels: DataFrame, share: float = 0.1) -> DataFrame:
    """Cells that a moved one covers by more than ``share`` where there are several."""
    a = advected.distinct()
    size = a.groupBy("t", "id").agg(F.count("*").alias("size"))
    o = a.join(labels.withColumnRenamed("id", "next_id"), ["t", "y", "x"]).groupBy("t", "id", "next_id").agg(F.count("*").alias("n"))
    o = o.join(size, ["t", "id"]).where(F.col("n") / F.col("size") > share)
    return o.withColumn("k", F.count("*").over(Window.partitionBy("t", "id"))).where("k > 1").select("t", "id", "next_id")


def couple_tracks(cells: DataFrame, least: int = 3) -> DataFrame:
    """Tracks of ``(track, t, ...)`` rows with at least ``least`` frames."""
    return cells.groupBy("track").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).where(F.col("n") >= least)


def overlaps(advected: DataFrame, labels: DataFrame) -> DataFrame:
    """``(t, id, next_id, n, overlap)``: pixels that a moved cell shares with each cell of the next frame, and their share of it."""
    a = advected.distinct()
    size = a.groupBy("t", "id").agg(F.count("*").alias("size"))
    o = a.join(labels.withColumnRenamed("id", "next_id"), ["t", "y", "x"]).groupBy("t", "id", "next_id").agg(F.count("*").alias("n"))
    return o.join(size, ["t", "id"]).select("t", "id", "next_id", "n", (F.col("n") / F.col("size")).alias("overlap"))


def links(shared: DataFrame, match_share: float = 0.4, merge_share: float = 0.1, split_share: float = 0.1) -> DataFrame:
    """``(t, id, next_id, kind)`` of ``overlaps``: how cells of frame t - 1 go on in frame t.

    kind ``carried``: the cell goes on as next_id, at most one on either side;
    ``merged``: it runs into next_id, which goes on from a cell that shares more
    pixels with it (from ``merge_share`` up); ``split``: next_id breaks off a cell
    that goes on elsewhere (more than ``split_share``). Ties go to the lower id.
    """
    out = Window.partitionBy("t", "id").orderBy(F.desc("overlap"), "next_id")
    s = shared.withColumn("_r", F.row_number().over(out))
    best = (F.col("_r") == 1) & (F.col("overlap") >= match_share)
    s = s.withColumn("_best", best)
    s = s.withColumn("_first", F.row_number().over(Window.partitionBy("t", "next_id", "_best").orderBy(F.desc("n"), "id")))
    s = s.withColumn("_taken", F.max(F.when(F.col("_best"), 1).otherwise(0)).over(Window.partitionBy("t", "next_id")))
    kind = (
        F.when(F.col("_best") & (F.col("_first") == 1), "carried")
        .when((F.col("_r") == 1) & (F.col("_taken") == 1) & (F.col("overlap") >= merge_share), "merged")
        .when((F.col("_r") > 1) & (F.col("_taken") == 0) & (F.col("overlap") > split_share), "split")
    )
    return s.withColumn("kind", kind).where("kind is not null").select("t", "id", "next_id", "kind")


ROOT = 1 << 32  # a track is named by the frame of its first cell, times this, plus the cell's id


def tracks(labels: DataFrame, flow: DataFrame, ny: int, nx: int, least: int = 1, **shares) -> DataFrame:
    """``(track, t, id)``: every cell with the track it belongs to; tracks shorter than ``least`` frames go.

    Cells are moved by the flow under them and matched by overlap; a cell takes
    the track of the one cell that is carried into it, and else begins a track.
    Chains of carried cells are followed by doubling, so a track of n frames
    takes log2(n) joins, whatever the number of cells.
    """
    cells = labels.select("t", "id").distinct()
    carried = links(overlaps(advect_cells(labels, flow, ny, nx), labels), **shares).where("kind = 'carried'")
    before = carried.select("t", F.col("next_id").alias("id"), (F.col("t") - 1).alias("pt"), F.col("id").alias("pid"))
    chain = written(cells.join(before, ["t", "id"], "left").select("t", "id", F.coalesce("pt", "t").alias("pt"), F.coalesce("pid", "id").alias("pid")), "chain")
    while True:
        up = chain.select(F.col("t").alias("pt"), F.col("id").alias("pid"), F.col("pt").alias("gt"), F.col("pid").alias("gid"))
        longer = written(chain.join(up, ["pt", "pid"]).select("t", "id", F.col("gt").alias("pt"), F.col("gid").alias("pid"), (F.col("gt") != F.col("pt")).alias("moved")), "chain")
        dropped(chain)
        chain = longer
        if chain.where("moved").isEmpty():
            break
    found = chain.select((F.col("pt").cast("bigint") * ROOT + F.col("pid")).alias("track"), "t", "id")
    if least <= 1:
        return found
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("track"))).where(F.col("_n") >= least).drop("_n")
