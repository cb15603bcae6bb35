"""Tables behind analyses and figures: velocity errors over lead time, value classes, arrows and track lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Lower limits of the classes of rain rate (mm/h), depth (mm) and reflectivity (dBZ).
CLASSES = {
    "mm/h": (0.08, 0.16, 0.25, 0.4, 0.63, 1.0, 1.6, 2.5, 4.0, 6.3, 10.0, 16.0, 25.0, 40.0, 63.0, 100.0, 160.0),
    "mm": (0.08, 0.16, 0.25, 0.4, 0.63, 1.0, 1.6, 2.5, 4.0, 6.3, 10.0, 16.0, 25.0, 40.0, 63.0, 100.0, 160.0),
    "dBZ": tuple(float(k) for k in range(10, 65, 5)),
}


def velocity_errors(flows: DataFrame, lags: Sequence[int]) -> DataFrame:
    """``(lag, n, s_par, ss_par, s_perp, ss_perp)``: sums of the differences between flows ``lag`` steps apart.

    ``flows`` is (t, y, x, u, v). Differences are split along and across the
    earlier flow; cells where that is zero don't count. Sums of several periods
    are added up by ``verification.merge_states``.
    """
    later = flows.select("y", "x", F.col("t").alias("t2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    each = flows.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).withColumn("t2", F.col("t") + F.col("lag"))
    j = each.join(later, ["t2", "y", "x"])
    size = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    du, dv = F.col("u2") - F.col("u"), F.col("v2") - F.col("v")
    d = j.where(size > 0).select("lag", ((du * F.col("u") + dv * F.col("v")) / size).alias("a"), ((dv * F.col("u") - du * F.col("v")) / size).alias("b"))
    return d.groupBy("lag").agg(F.count("*").alias("n"), F.sum("a").alias("s_par"), F.sum(F.col("a") * F.col("a")).alias("ss_par"), F.sum("b").alias("s_perp"), F.sum(F.col("b") * F.col("b")).alias("ss_perp"))


def velocity_deviations(errors: DataFrame) -> DataFrame:
    """``(lag, par, perp)``: standard deviations of the differences."""
    sd = lambda k: F.sqrt(F.greatest(F.col(f"ss_{k}") / F.col("n") - F.pow(F.col(f"s_{k}") / F.col("n"), F.lit(2.0)), F.lit(0.0)))
    return errors.select("lag", sd("par").alias("par"), sd("perp").alias("perp"))


def fitted_growth(minutes: Sequence[float], deviations: Sequence[float]) -> tuple[float, float, float]:
    """a, b and c of ``a * t**b + c`` nearest to deviations at lead times; for each b the rest is linear."""
    t, y = np.asarray(minutes, float), np.asarray(deviations, float)

    def solved(b: float) -> tuple[float, float, float]:
        m = np.stack([t**b, np.ones_like(t)], 1)
        (a, c), *_ = np.linalg.lstsq(m, y, rcond=None)
        return float(((m @ [a, c] - y) ** 2).sum()), float(a), float(c)

    grid = np.linspace(0.02, 1.5, 149)
    for _ in range(4):  # finer about the best
        best = min(grid, key=lambda b: solved(b)[0])
        step = grid[1] - grid[0]
        grid = np.linspace(max(best - step, 1e-3), best + step, 41)
    _, a, c = solved(best)
    return a, float(best), c


def value_classes(cells: DataFrame, limits: Sequence[float]) -> DataFrame:
    """Adds ``class``: how many of the ascending limits a value reaches, 0 below the first, null for a missing value."""
    n = F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x <= F.col("v")))
    return cells.withColumn("class", F.when(F.col("v").isNotNull(), n))


def arrows(flow: DataFrame, step: int) -> DataFrame:
    """Flow at every ``step``-th cell from half a step on, with speed and direction (degrees from x to y)."""
    at = lambda c: F.pmod(F.col(c) - step // 2, F.lit(step)) == 0
    return flow.where(at("y") & at("x")).withColumn("speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).withColumn("direction", F.degrees(F.atan2("v", "u")))


def track_lines(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """``(track, n, line)``: centres of a track's cells in order of time, as an array of (t, x, y)."""
    j = tracks.join(cells.select("t", "id", "cen_x", "cen_y"), ["t", "id"])
    return j.groupBy("track").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", F.col("cen_x").alias("x"), F.col("cen_y").alias("y")))).alias("line"))


def even_steps(times: DataFrame, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, step, even)``: seconds between a group's times, and whether they are the same throughout; null for one time."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(at)
    gap = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.lag(at).over(w).cast("timestamp"))
    g = times.withColumn("_gap", gap)
    return g.groupBy(*keys).agg(F.min("_gap").alias("step"), (F.min("_gap") == F.max("_gap")).alias("even"))
