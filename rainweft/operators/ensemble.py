"""Statistics over ensemble members, cell by cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainweft.operators.grid import strict_avg

CELL = ("t", "y", "x")


def lagged_ensemble(obs: DataFrame, members: int) -> DataFrame:
    """Members made of earlier frames: member m at t is the frame t - m. One pass, no join."""
    m = F.explode(F.sequence(F.lit(1), F.lit(members))).alias("member")
    last = obs.agg(F.max("t"))
    e = obs.select("t", "y", "x", "v", m).select("member", (F.col("t") + F.col("member")).cast("int").alias("t"), "y", "x", "v")
    return e.where((F.col("t") >= members) & (F.col("t") <= last.scalar()))


def ensemble_mean(ens: DataFrame, thr: float | None = None, ignore_missing: bool = False, keys: Sequence[str] = CELL) -> DataFrame:
    """Member mean; values below ``thr`` count as missing and are skipped."""
    if thr is not None:
        return ens.groupBy(*keys).agg(F.avg(F.when(F.col("v") >= thr, F.col("v"))).alias("v"))
    return ens.groupBy(*keys).agg((F.avg("v") if ignore_missing else strict_avg(F.col("v"))).alias("v"))


def exceedance(ens: DataFrame, thrs: Sequence[float], ignore_missing: bool = False, keys: Sequence[str] = CELL) -> DataFrame:
    """Share of members from each threshold up; null as soon as a member is missing unless ignored."""
    cols = []
    for thr in thrs:
        yes = F.when(F.col("v").isNotNull(), F.when(F.col("v") >= thr, 1.0).otherwise(0.0))
        cols.append((F.avg(yes) if ignore_missing else strict_avg(yes)).alias(f"p{len(cols)}"))
    wide = ens.groupBy(*keys).agg(*cols)
    packed = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("thr"), F.col(f"p{i}").alias("p")) for i, t in enumerate(thrs)])).alias("e")
    return wide.select(*keys, packed).select(*keys, "e.thr", "e.p")


def band_depth(ens: DataFrame, normalise: bool = False, keys: Sequence[str] = CELL) -> DataFrame:
    """Modified band depth of every member: how often it lies within the bands of pairs of members.

    Ties rank by member number; cells with a missing member are left out.
    """
    size = Window.partitionBy(*keys)
    r = ens.withColumn("n", F.count("v").over(size)).withColumn("k", F.count(F.lit(1)).over(size)).where("n = k")
    r = r.withColumn("r", F.row_number().over(size.orderBy("v", "member")))
    inside = (F.col("n") - F.col("r")) * (F.col("r") - 1) + F.col("n") - 1
    depth = r.groupBy("member").agg(F.avg(F.try_divide(inside.cast("double"), F.col("n") * (F.col("n") - 1) / 2.0)).alias("depth"))
    if not normalise:
        return depth
    ends = depth.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return depth.select("member", F.try_divide(F.col("depth") - lo, hi - lo).alias("depth"))
