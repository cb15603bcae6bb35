"""Blending of nowcasts with model forecasts, and the skill it rests on."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainweft.operators.ranks import ranked_salience, salient_weight

# Default correlation of a model with observations per cascade level, large scales first.
DEFAULT_SKILL = (0.99, 0.95, 0.848, 0.65, 0.37, 0.19, 0.09, 0.04)
# Decay times (minutes) of the regression of model skill on lead time, per level.
REGRESSION = ((130.0, 165.0, 120.0, 55.0, 50.0, 15.0, 15.0, 10.0), (155.0, 220.0, 200.0, 75.0, 10e4, 10e4, 10e4, 10e4))
LEAST_SKILL = 1e-4


def linear_weight(lead: Column, start: float, end: float) -> Column:
    """Weight of the model: 0 up to start, 1 from end on."""
    return F.least(F.greatest((lead - start) / float(end - start), F.lit(0.0)), F.lit(1.0))


def linear_blend(pairs: DataFrame, start: float, end: float, fill_from_model: bool = True) -> DataFrame:
    """Rows with nowcast ``p``, model ``o`` and ``lead`` to one value ``v``; a missing nowcast gives way to the model (or 0)."""
    w = linear_weight(F.col("lead"), start, end)
    p = F.coalesce("p", "o") if fill_from_model else F.coalesce("p", F.lit(0.0))
    return pairs.withColumn("v", (1 - w) * p + w * F.coalesce("o", F.lit(0.0))).drop("p", "o")


def salient_blend(pairs: DataFrame, weight: float, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Blend of one lead time in which strong differences weigh more; ``weight`` is the nowcast's."""
    s = ranked_salience(pairs, keys)
    w = salient_weight(weight, F.col("salience"))
    return s.select(*keys, "y", "x", (w * F.col("p") + (1 - w) * F.col("o")).alias("v"))


def default_skill(spark: SparkSession, n_levels: int = 6, n_models: int = 1) -> DataFrame:
    """``(model, level, skill)``; levels beyond the table get the least skill."""
    rows = [(m, k, DEFAULT_SKILL[k] if k < len(DEFAULT_SKILL) else LEAST_SKILL) for m in range(n_models) for k in range(n_levels)]
    return spark.createDataFrame(rows, "model int, level int, skill double")


def daily_skill(skills: DataFrame) -> DataFrame:
    """Running record to one mean per day: ``(valid, model, level, skill)`` to ``(day, model, level, skill)``."""
    return skills.groupBy(F.to_date("valid").alias("day"), "model", "level").agg(F.avg("skill").alias("skill"))


def climatological_skill(daily: DataFrame, window: int = 30) -> DataFrame:
    """Geometric mean over the last ``window`` days of each model and level."""
    r = F.row_number().over(Window.partitionBy("model", "level").orderBy(F.desc("day")))
    return daily.withColumn("r", r).where(F.col("r") <= window).groupBy("model", "level").agg(F.exp(F.avg(F.log(F.greatest("skill", F.lit(LEAST_SKILL))))).alias("skill"))


def spatial_correlation(pairs: DataFrame, keys: Sequence[str] = ("level",)) -> DataFrame:
    """Correlation of model and observation per level over the present cells; without one the least skill."""
    c = F.corr("p", "o")
    return pairs.groupBy(*keys).agg(F.coalesce(F.when(~F.isnan(c), c), F.lit(LEAST_SKILL)).alias("skill"))


def model_skill_at(lead: Column, now: Column, climatology: Column, level: Column) -> Column:
    """Skill of the model at a lead time: from today's value towards the climatological one."""
    p1, p2 = (F.element_at(F.array(*[F.lit(x) for x in row]), F.least(level + 1, F.lit(len(row)))) for row in REGRESSION)
    q = F.exp(-lead / p1) * (2 - F.exp(-lead / p2))
    return q * now + (1 - q) * climatology


def extrapolation_skill(phi: Sequence[float], now: float = 1.0, before: float = 1.0, steps: int = 1) -> list[float]:
    """Skill of the nowcast over the steps, by the recursion of its own process."""
    a, b, out = now, before, []
    for _ in range(steps):
        a, b = (phi[0] * a + (phi[1] * b if len(phi) > 2 else 0.0)), a
        out.append(a)
    return out


def bps_weights(skills: DataFrame) -> DataFrame:
    """``(level, component, skill)`` to weights per component and the noise's (component -1).

    With several components each weighs by its skill and its share of explained
    over unexplained variance; a single one weighs its skill, and noise the rest.
    """
    c = F.least(F.greatest("skill", F.lit(1e-4)), F.lit(0.99999))
    w = Window.partitionBy("level")
    r = skills.withColumn("c", c).withColumn("r", c * c / (1 - c * c))
    r = r.withColumn("n", F.count("*").over(w)).withColumn("w", F.when(F.col("n") == 1, F.col("c")).otherwise(F.col("c") * F.sqrt(F.col("r") / F.sum("r").over(w))))
    noise = r.groupBy("level").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.sqrt(F.greatest(1 - F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("e"))
    noise = noise.select("level", F.lit(-1).alias("component"), F.when(F.col("n") == 1, 1 - F.col("c")).otherwise(F.col("e")).alias("weight"))
    return r.select("level", F.col("component").cast("int").alias("component"), F.col("w").alias("weight")).unionAll(noise)


def spn_weights(correlations: Sequence[float], covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights from correlations with truth and the covariance of the components; and the noise's."""
    c = np.asarray(correlations, float)
    w = np.linalg.solve(np.asarray(covariance, float), c)
    return w, float(np.sqrt(max(0.0, 1.0 - w @ c)))


def end_weight(weight: Column, is_model: Column, step: Column, start: int, last: int) -> Column:
    """Moves the weights linearly to the model alone between a start step and the last."""
    f = F.least(F.greatest((step - start) / float(last - start), F.lit(0.0)), F.lit(1.0))
    return weight * (1 - f) + F.when(is_model, f).otherwise(0.0)


def blended_moments(components: DataFrame) -> DataFrame:
    """``(level, component, mu, sigma, weight)`` to the weighted means per level."""
    w = F.sum("weight")
    return components.groupBy("level").agg(F.try_divide(F.sum(F.col("mu") * F.col("weight")), w).alias("mu"), F.try_divide(F.sum(F.col("sigma") * F.col("weight")), w).alias("sigma"))


def blend_fields(fields: DataFrame, weights: DataFrame, keys: Sequence[str], values: Sequence[str], normalise: bool = True) -> DataFrame:
    """Weighted sum over components of fields (flows, cascade levels); weights per component and any shared keys."""
    on = [c for c in weights.columns if c != "weight"]
    j = fields.join(weights, on)
    total = F.sum("weight") if normalise else F.lit(1.0)
    return j.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col("weight")), total).alias(c) for c in values])


def recompose(levels: DataFrame, keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Sum over levels of ``v * sigma + mu``."""
    return levels.groupBy(*keys).agg(F.sum(F.col("v") * F.col("sigma") + F.col("mu")).alias("v"))


def members_for_nowcast(n_nowcast: int, n_model: int) -> list[tuple[int, int]]:
    """Pairs (member, model member), the fewer repeated in turn."""
    n = max(n_nowcast, n_model)
    return [(i % n_nowcast, i % n_model) for i in range(n)]


def wet_in_both(first: DataFrame, second: DataFrame, thr: float, least: int) -> DataFrame:
    """Cells where both ensembles have at least ``least`` members from thr up."""
    wet = lambda e: e.groupBy("t", "y", "x").agg(F.sum(F.when(F.col("v") >= thr, 1).otherwise(0)).alias("k")).where(F.col("k") >= least).drop("k")
    return wet(first).join(wet(second), ["t", "y", "x"])


def filter_covariance(ens: DataFrame, inflation: float = 1.0, offset: float = 0.0) -> DataFrame:
    """``(i, j, cov)`` of ``(member, i, v)``: the sample covariance of components, inflated, offset on the diagonal."""
    w = Window.partitionBy("i")
    c = ens.withColumn("d", F.col("v") - F.avg("v").over(w))
    a, b = c.select("member", "i", F.col("d").alias("a")), c.select("member", F.col("i").alias("j"), F.col("d").alias("b"))
    n = F.count("*") - 1
    return a.join(b, "member").groupBy("i", "j").agg((F.try_divide(F.sum(F.col("a") * F.col("b")), n) * inflation).alias("cov")).select("i", "j", (F.col("cov") + F.when(F.col("i") == F.col("j"), offset).otherwise(0.0)).alias("cov"))


def blending_ratios(correlations: DataFrame) -> DataFrame:
    """``(level, component, ratio)``: explained over unexplained variance, bounded away from 1."""
    c = F.least(F.greatest(F.col("skill"), F.lit(1e-5)), F.lit(0.99999))
    return correlations.select("level", "component", (c * c / (1 - c * c)).alias("ratio"))


def wet_enough(nowcast: DataFrame, model: DataFrame, thr: float, least: int) -> DataFrame:
    """``(t, y, x, both)``: whether both ensembles have ``least`` members from thr up at a cell, for every cell of either."""
    wet = lambda e, n: e.groupBy("t", "y", "x").agg(F.count_if(F.col("v") >= thr).alias(n))
    j = wet(nowcast, "a").join(wet(model, "b"), ["t", "y", "x"], "full")
    return j.select("t", "y", "x", ((F.coalesce("a", F.lit(0)) >= least) & (F.coalesce("b", F.lit(0)) >= least)).alias("both"))


def matching_share(background: DataFrame, analysis: DataFrame, observed: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, share)``: how far an analysis has moved from the background towards the observations, between 0 and 1.

    The three hold ``(keys, member, i, v)``; shares of the members are averaged.
    """
    on = [*keys, "member", "i"]
    j = background.select(*on, F.col("v").alias("b")).join(analysis.select(*on, F.col("v").alias("a")), on).join(observed.select(*on, F.col("v").alias("o")), on)
    m = j.groupBy(*keys, "member").agg(F.sum(F.col("a") - F.col("b")).alias("da"), F.sum(F.col("o") - F.col("b")).alias("do"))
    share = F.when(F.col("do") != 0, F.least(F.greatest(F.col("da") / F.col("do"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return m.groupBy(*keys).agg(F.avg(share).alias("share"))


def binned_leads(leads: DataFrame) -> DataFrame:
    """``(bin, leads)``: lead times gathered by the whole step that they follow, ascending."""
    return leads.groupBy(F.floor("lead").cast("int").alias("bin")).agg(F.array_sort(F.collect_list("lead")).alias("leads"))


def stacked_levels(levels: DataFrame, keys: Sequence[str] = ("case",)) -> DataFrame:
    """``(keys, level, stack)`` of ``(keys, t, level, data)``: the frames of each level side by side, oldest first."""
    p = F.array_sort(F.collect_list(F.struct("t", "data")))
    return levels.groupBy(*keys, "level").agg(F.transform(p, lambda s: s["data"]).alias("stack"))
