"""Rank joins: distributions matched, masked and blended by order.

Ranks over whole rasters are taken per raster (its keys); ties are broken by
place ``(y, x)``, which leaves the multiset of results unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_cdf(first: DataFrame, target: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Gives ``first`` the distribution of ``target`` by rank.

    Missing values and rasters of unequal size raise when the result is computed,
    as a rank has no meaning there; a raster that only one side has gives no rows.

    Cells at the minimum of ``first`` get the minimum of ``target``. If fewer
    cells are wet in ``first``, the weakest wet values of the target go unused;
    if more are, the surplus becomes its minimum.
    """
    w = Window.partitionBy(*keys)
    a = first.withColumn("least", F.min("v").over(w)).withColumn("rank", F.row_number().over(w.orderBy("v", "y", "x")))
    b = target.select(*keys, F.col("v").alias("tv"), F.row_number().over(w.orderBy("v", "y", "x")).alias("rank"), F.min("v").over(w).alias("tleast"))
    sizes = first.groupBy(*keys).agg(F.count("*").alias("_n"), F.count("v").alias("_there")).join(target.groupBy(*keys).agg(F.count("*").alias("_tn"), F.count("v").alias("_tthere")), list(keys))
    wrong = F.raise_error(F.lit("rasters with missing values or of unequal size can't be matched by rank"))
    sizes = sizes.select(*keys, F.when((F.col("_n") == F.col("_there")) & (F.col("_tn") == F.col("_tthere")) & (F.col("_n") == F.col("_tn")), F.lit(True)).otherwise(wrong.cast("boolean")).alias("_ok"))
    j = a.join(sizes, list(keys)).where("_ok").join(b, [*keys, "rank"])
    return j.select(*keys, "y", "x", F.when(F.col("v") <= F.col("least"), F.col("tleast")).otherwise(F.col("tv")).alias("v"))


def empirical_cdf(cells: DataFrame, edges: Sequence[float]) -> DataFrame:
    """``(edge, cdf)``: cumulated histogram times bin width, scaled to 1, 0 at the first edge. Bins are closed below."""
    width = F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:])])
    e = F.array(*[F.lit(float(x)) for x in edges])
    number = F.size(F.filter(e, lambda x: x <= F.col("v"))) - 1
    last = F.when(F.col("v") == edges[-1], len(edges) - 2).otherwise(number)
    h = cells.where((F.col("v") >= edges[0]) & (F.col("v") <= edges[-1])).groupBy(last.cast("int").alias("b")).agg(F.count("*").alias("h"))
    bins = cells.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("b")).join(h, "b", "left")
    area = F.coalesce("h", F.lit(0)) * F.element_at(width, F.col("b") + 1)
    w = Window.partitionBy(F.lit(1)).orderBy("b")  # as many rows as bins
    c = bins.select("b", F.try_divide(F.sum(area).over(w), F.sum(area).over(Window.partitionBy(F.lit(1)))).alias("cdf"))
    zero = cells.sparkSession.range(1).select(F.lit(float(edges[0])).alias("edge"), F.lit(0.0).alias("cdf"))
    return zero.unionAll(c.select(F.element_at(e, F.col("b") + 2).alias("edge"), "cdf"))


def interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear function of fixed points, constant beyond its ends."""
    out = F.lit(float(ys[-1]))
    for k in range(len(xs) - 1, 0, -1):
        a, b, fa, fb = float(xs[k - 1]), float(xs[k]), float(ys[k - 1]), float(ys[k])
        out = F.when(x < b, fa + (x - a) * ((fb - fa) / (b - a) if b > a else 0.0)).otherwise(out)
    return F.when(x.isNull(), None).when(x <= float(xs[0]), float(ys[0])).otherwise(out)


def probability_match(v: Column, edges1: Sequence[float], cdf1: Sequence[float], edges2: Sequence[float], cdf2: Sequence[float]) -> Column:
    """Maps a value through one CDF and back through the inverse of another."""
    return interpolated(interpolated(v, edges1, cdf1), cdf2, edges2)


def percentile_mask(cells: DataFrame, share: float, keys: Sequence[str] = ("t",)) -> DataFrame:
    """1 for the largest values that make up ``share`` of the raster, ties upward included."""
    w = Window.partitionBy(*keys)
    r = cells.withColumn("n", F.count("v").over(w)).withColumn("r", F.rank().over(w.orderBy(F.desc("v"))))
    return r.select(*keys, "y", "x", F.when((F.col("r") <= F.floor(F.col("n") * share)) & F.col("v").isNotNull(), 1).otherwise(0).alias("mask"))


def resample(first: DataFrame, second: DataFrame, share: float, seed: int = 42, keys: Sequence[str] = ("t",), draw: Column | None = None) -> DataFrame:
    """``(keys, rank, v)``: both sorted downward; each rank takes the first with probability ``share``.

    draw: numbers from 0 to 1 over keys and rank, a seeded hash of them by default.
    """
    w = Window.partitionBy(*keys)
    a = first.select(*keys, F.row_number().over(w.orderBy(F.desc("v"), "y", "x")).alias("rank"), F.col("v").alias("a"))
    b = second.select(*keys, F.row_number().over(w.orderBy(F.desc("v"), "y", "x")).alias("rank"), F.col("v").alias("b"))
    draw = F.pmod(F.xxhash64(*keys, "rank", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24) if draw is None else draw
    j = a.join(b, [*keys, "rank"]).select(*keys, "rank", F.when(draw < share, F.col("a")).otherwise(F.col("b")).alias("v"))
    return j.select(*keys, F.row_number().over(w.orderBy(F.desc("v"), "rank")).alias("rank"), "v")


def ranked_salience(pairs: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Dense rank of the scaled difference of nowcast ``p`` and model ``o``, from 0 to 1."""
    w = Window.partitionBy(*keys)
    n = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
    d = pairs.withColumn("d", F.round(n("p") - n("o"), 12))
    r = d.withColumn("r", F.dense_rank().over(w.orderBy("d")))
    return r.select(*keys, "y", "x", "p", "o", (F.col("r") / F.max("r").over(w)).alias("salience"))


def salient_weight(weight: float, salience: Column) -> Column:
    """Weight of the nowcast after its salience: strong differences keep it longer."""
    w, s = F.lit(float(weight)), salience
    ws = s * w * w
    wn = (1 - s) * (1 - w) * (1 - w)
    return F.when((ws + wn) > 0, F.sqrt(ws) * F.sqrt(ws) / (ws + wn)).otherwise(w)


def normal_scores(cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Normal quantile of rank / (n + 1) of the values other than 0, which stay 0; ties by place."""
    from rainweft.functions.normal import inverse_normal

    w = Window.partitionBy(*keys, "wet")
    r = cells.withColumn("wet", F.col("v") != 0)
    r = r.withColumn("q", F.row_number().over(w.orderBy("v", "y", "x")) / (F.count("*").over(w) + 1.0))
    return r.select(*keys, "y", "x", F.when(F.col("wet"), inverse_normal(F.col("q"))).otherwise(F.col("v")).alias("v"))
