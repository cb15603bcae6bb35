"""Moving windows over rasters: separable boxes by window frames, other shapes by moved copies.

A box of width ``s`` about a cell reaches ``s // 2`` back and ``s - 1 - s // 2``
ahead. Windows are partitioned by raster row, then by column, so no task holds a
raster; shapes that aren't boxes send each cell to its neighbours (as many as
the shape has places) and add up, with partial sums before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pass(cells: DataFrame, columns: Sequence[str], size: int, along: str, across: str, keys: Sequence[str], agg) -> DataFrame:
    w = Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-(size // 2), size - 1 - size // 2)
    rest = [c for c in cells.columns if c not in columns]
    return cells.select(*rest, *[agg(c).over(w).alias(c) for c in columns])


def box_sum(cells: DataFrame, columns: Sequence[str], size: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Sum over a square box; outside the raster is 0, missing cells count nothing."""
    return _pass(_pass(cells, columns, size, "x", "y", keys, F.sum), columns, size, "y", "x", keys, F.sum)


def box_mean(cells: DataFrame, columns: Sequence[str], size: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Mean over the full box, zero outside the raster."""
    out = box_sum(cells, columns, size, keys)
    return out.select(*[(F.col(c) / float(size * size)).alias(c) if c in columns else F.col(c) for c in out.columns])


def box_max(cells: DataFrame, column: str, size: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    return _pass(_pass(cells, [column], size, "x", "y", keys, F.max), [column], size, "y", "x", keys, F.max)


def box_min(cells: DataFrame, column: str, size: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    return _pass(_pass(cells, [column], size, "x", "y", keys, F.min), [column], size, "y", "x", keys, F.min)


def opening(cells: DataFrame, thr: float, size: int = 3, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Sets wet cells that a binary opening with a square removes to the raster's minimum."""
    wet = F.when(F.coalesce(F.col("v") > thr, F.lit(False)), 1).otherwise(0)
    marked = cells.withColumn("w0", wet).withColumn("w", wet).withColumn("least", F.min("v").over(Window.partitionBy(*keys)))
    opened = box_max(box_min(marked, "w", size, keys), "w", size, keys)
    return opened.select(*keys, "y", "x", F.when((F.col("w0") == 1) & (F.col("w") == 0), F.col("least")).otherwise(F.col("v")).alias("v"))


def ellipse_offsets(size: int) -> list[tuple[int, int]]:
    """Places of an ellipse in a square of ``size`` cells, row by row; of three cells it is a cross."""
    c, r = size // 2, size // 2
    out = []
    for i in range(size):
        dy = i - r
        dx = int(round(c * ((r * r - dy * dy) / (r * r)) ** 0.5)) if r and abs(dy) <= r else 0
        out += [(dy, j - c) for j in range(max(c - dx, 0), min(c + dx + 1, size))]
    return out


def elliptic_opening(cells: DataFrame, thr: float, size: int = 3, keys: Sequence[str] = ("t",)) -> DataFrame:
    """As ``opening`` with an ellipse; what lies outside the raster erodes nothing."""
    at = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ellipse_offsets(size)])
    wet = F.when(F.coalesce(F.col("v") > thr, F.lit(False)), 1).otherwise(0)
    marked = cells.select(*keys, "y", "x", "v", wet.alias("w"))

    def spread(source: DataFrame, value: str, agg, name: str) -> DataFrame:
        moved = source.withColumn("o", F.explode(at))
        return moved.groupBy(*keys, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x")).agg(agg(value).alias(name))

    eroded = marked.join(spread(marked.select(*keys, "y", "x", "w"), "w", F.min, "e"), [*keys, "y", "x"])
    opened = eroded.join(spread(eroded.select(*keys, "y", "x", "e"), "e", F.max, "o_"), [*keys, "y", "x"])
    least = cells.groupBy(*keys).agg(F.min("v").alias("least"))
    return opened.join(least, list(keys)).select(*keys, "y", "x", F.when((F.col("w") == 1) & (F.col("o_") == 0), F.col("least")).otherwise(F.col("v")).alias("v"))


def disc_offsets(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def gaussian_offsets(sigma: float, cutoff: float = 3.0) -> list[tuple[int, int, float]]:
    from math import exp

    r = int(cutoff * sigma + 0.5)
    w = [(dy, dx, exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    total = sum(x for _, _, x in w)
    return [(dy, dx, x / total) for dy, dx, x in w]


def weighted_mean(cells: DataFrame, offsets: Sequence[tuple], keys: Sequence[str] = ("t",)) -> DataFrame:
    """Normalised convolution: ``sum(w v) / sum(w)`` over the present neighbours of each cell.

    Cells whose own value is missing get the mean of their neighbours too; where
    none is present the result is null.
    """
    places = F.array(*[F.struct(F.lit(int(o[0])).alias("dy"), F.lit(int(o[1])).alias("dx"), F.lit(float(o[2]) if len(o) > 2 else 1.0).alias("w")) for o in offsets])
    sent = cells.where("v is not null").select(*keys, "y", "x", "v", F.explode(places).alias("o"))
    sent = sent.select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("v") * F.col("o.w")).alias("wv"), F.col("o.w").alias("w"))
    blank = cells.select(*keys, "y", "x", F.lit(0.0).alias("wv"), F.lit(0.0).alias("w"), F.lit(1).alias("own"))
    both = blank.unionByName(sent.withColumn("own", F.lit(0)))
    out = both.groupBy(*keys, "y", "x").agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"), F.max("own").alias("own")).where("own = 1")
    return out.select(*keys, "y", "x", F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("v"))


def lagrangian_probability(advected: DataFrame, thr: float, radius: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Share of cells from thr up within a disc (a square below radius 5); missing cells stay missing."""
    offsets = [(0, 0)] if radius <= 0 else disc_offsets(radius / 2) if radius >= 5 else [(dy, dx) for dy in range(-(radius // 2), radius - radius // 2) for dx in range(-(radius // 2), radius - radius // 2)]
    event = advected.withColumn("v", F.when(F.col("v").isNotNull(), F.when(F.col("v") >= thr, 1.0).otherwise(0.0)))
    mean = weighted_mean(event, offsets, keys).withColumnRenamed("v", "pr")
    return event.join(mean, [*keys, "y", "x"]).select(*keys, "y", "x", F.when(F.col("v").isNotNull(), F.least(F.greatest(F.col("pr"), F.lit(0.0)), F.lit(1.0))).alias("pr"))


def dilated_mask(cells: DataFrame, thr: float, steps: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Graded mask: 1 where wet, falling by 1/(steps+1) with each unit dilation (distance along axes), 0 beyond."""
    r = steps
    places = [(dy, dx, abs(dy) + abs(dx)) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]
    arr = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(r + 1 - d) / (r + 1)).alias("m")) for a, b, d in places])
    sent = cells.where(F.col("v") >= thr).select(*keys, "y", "x", F.explode(arr).alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.m").alias("m"))
    best = sent.groupBy(*keys, "y", "x").agg(F.max("m").alias("m"))
    return cells.select(*keys, "y", "x").join(best, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("m", F.lit(0.0)).alias("m"))


def moving_correlation(pairs: DataFrame, size: int, keys: Sequence[str] = ("t",), least: int = 3, flat: float = 1e-8) -> DataFrame:
    """Correlation of p and o in a box about each cell; null with fewer than ``least`` pairs or without spread."""
    both = F.col("p").isNotNull() & F.col("o").isNotNull()
    s = {"n": F.lit(1.0), "sp": F.col("p"), "so": F.col("o"), "spp": F.col("p") * F.col("p"), "soo": F.col("o") * F.col("o"), "spo": F.col("p") * F.col("o")}
    sums = box_sum(pairs.select(*keys, "y", "x", *[F.when(both, c).otherwise(0.0).alias(k) for k, c in s.items()]), list(s), size, keys)
    n = F.col("n")
    dp = F.sqrt(F.greatest(F.col("spp") / n - F.pow(F.col("sp") / n, F.lit(2.0)), F.lit(0.0)))
    do = F.sqrt(F.greatest(F.col("soo") / n - F.pow(F.col("so") / n, F.lit(2.0)), F.lit(0.0)))
    cov = F.col("spo") / n - F.col("sp") * F.col("so") / (n * n)
    return sums.select(*keys, "y", "x", F.when((n >= least) & (dp > flat) & (do > flat), cov / (dp * do)).alias("corr"))
