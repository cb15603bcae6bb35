"""Forecast verification as mergeable aggregates.

Every score has three parts: ``*_state`` aggregates pairs into counters or
moments, ``merge_states`` adds states of several batches, ``*_scores`` turns a
state into scores. ``p`` is the forecast and ``o`` the observation; a null is a
missing value. Categorical events are ``v > thr``, spatial and probabilistic
ones ``v >= thr``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainweft.operators.neighbourhood import box_mean


def _sum_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of several batches, unioned, added up per key; for all states of sums (``merge_moments`` is for moments)."""
    sums = [c for c in states.columns if c not in keys]
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: NaN for 0 / 0, infinite for other values over 0."""
    over_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b != 0, a / b).when(b == 0, over_zero)


# -- categorical ----------------------------------------------------------------------------------


def contingency_state(pairs: DataFrame, thr: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """hits, misses, false alarms and correct rejections; a missing value is no event. thr may be a column, for several at once."""
    p, o = F.coalesce(F.col("p") > thr, F.lit(False)), F.coalesce(F.col("o") > thr, F.lit(False))
    return pairs.groupBy(*keys).agg(_sum_if(p & o).alias("h"), _sum_if(~p & o).alias("m"), _sum_if(p & ~o).alias("f"), _sum_if(~p & ~o).alias("r"))


def categorical_scores(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """POD FAR FA ACC CSI BIAS HSS HK GSS SEDI MCC F1; without a base FAR, HSS, GSS, SEDI and MCC are null, the others NaN (BIAS infinite where only the forecast has events)."""
    h, m, f, r = (F.col(c).cast("double") for c in "hmfr")
    n = h + m + f + r
    pod, fa = quotient(h, h + m), quotient(f, f + r)
    chance = ratio((h + m) * (h + f) + (r + m) * (r + f), n)
    random_hits = ratio((h + m) * (h + f), n)
    sedi = F.when((pod > 0) & (pod < 1) & (fa > 0) & (fa < 1), (F.log(fa) - F.log(pod) + F.log(1 - pod) - F.log(1 - fa)) / (F.log(fa) + F.log(pod) + F.log(1 - pod) + F.log(1 - fa)))
    scores = {
        "pod": pod, "far": ratio(f, h + f), "fa": fa, "acc": quotient(h + r, n), "csi": quotient(h, h + m + f), "bias": quotient(h + f, h + m),
        "hss": ratio(h + r - chance, n - chance), "hk": pod - fa, "gss": ratio(h - random_hits, h + m + f - random_hits), "sedi": sedi,
        "mcc": ratio(h * r - f * m, F.sqrt((h + f) * (h + m) * (r + f) * (r + m))), "f1": quotient(2 * h, 2 * h + f + m),
    }
    return state.select(*keys, *[c.alias(k) for k, c in scores.items()])


# -- continuous -----------------------------------------------------------------------------------


def conditioned(pairs: DataFrame, conditioning: str | None = None, thr: float = 0.0) -> DataFrame:
    """single: forecast or observation above thr; double: both."""
    p, o = F.coalesce(F.col("p") > thr, F.lit(False)), F.coalesce(F.col("o") > thr, F.lit(False))
    if conditioning is None:
        return pairs
    if conditioning not in ("single", "double"):
        raise ValueError(conditioning)
    return pairs.where(p | o if conditioning == "single" else p & o)


def moment_state(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number, means and central moments of the pairs of which both values are there; see ``merge_moments``."""
    p, o = F.col("p"), F.col("o")
    both = pairs.where(p.isNotNull() & o.isNotNull())
    n = F.count("*")
    s = {"n": n, "mp": F.avg(p), "mo": F.avg(o), "cpp": F.var_pop(p) * n, "coo": F.var_pop(o) * n, "cpo": F.covar_pop(p, o) * n, "sae": F.sum(F.abs(p - o)), "sss": F.sum((p - o) * (p - o)), "spl": F.sum((p + o) * (p + o))}
    return both.groupBy(*keys).agg(*[c.alias(k) for k, c in s.items()])


def merge_moments(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moment states of several batches, unioned, to one per key; central moments are moved to the common mean, so no digits are lost."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # one row per batch and key
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    s = states.where("n > 0").withColumn("gp", mean("mp")).withColumn("go", mean("mo"))
    dp, do, n = F.col("mp") - F.col("gp"), F.col("mo") - F.col("go"), F.col("n")
    moved = {"cpp": F.col("cpp") + n * dp * dp, "coo": F.col("coo") + n * do * do, "cpo": F.col("cpo") + n * dp * do}
    return s.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("gp").alias("mp"), F.max("go").alias("mo"), *[F.sum(c).alias(k) for k, c in moved.items()], *[F.sum(c).alias(c) for c in ("sae", "sss", "spl")])


def continuous_scores(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ME MAE MSE NMSE RMSE corr_p beta1 beta2 RV DRMSE."""
    n = F.col("n")
    mp, mo = F.col("mp"), F.col("mo")
    vp, vo, cov = F.col("cpp") / n, F.col("coo") / n, F.col("cpo") / n
    mse, me = F.col("sss") / n, mp - mo
    scores = {
        "me": me, "mae": F.col("sae") / n, "mse": mse, "nmse": ratio(mse, F.col("spl") / n), "rmse": F.sqrt(mse), "corr_p": ratio(cov, F.sqrt(vp) * F.sqrt(vo)),
        "beta1": ratio(cov, vp), "beta2": ratio(cov, vo), "rv": 1 - ratio(mse, vo), "drmse": F.sqrt(F.greatest(mse - me * me, F.lit(0.0))),
    }
    return state.select(*keys, *[c.alias(k) for k, c in scores.items()])


def spearman(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation; ties share their mean rank. Ranks come from counts per value, not from one long sort."""
    both = pairs.where("p is not null and o is not null")

    def ranks(c: str) -> DataFrame:
        counts = both.groupBy(*keys, c).agg(F.count("*").alias("k"))
        upto = F.sum("k").over(Window.partitionBy(*keys).orderBy(c))
        return counts.select(*keys, c, (upto - (F.col("k") - 1) / 2.0).alias(f"r{c}"))

    joined = both.join(ranks("p"), [*keys, "p"]).join(ranks("o"), [*keys, "o"])
    return joined.groupBy(*keys).agg(F.corr("rp", "ro").alias("corr_s"))


def scatter(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half the spread between the 16th and 84th weighted percentile of 10 log10(p/o), weighted by o."""
    e = pairs.where("p > 0 and o > 0").select(*keys, (10 * F.log10(F.col("p") / F.col("o"))).alias("e"), F.col("o").alias("w"))
    e = e.groupBy(*keys, "e").agg(F.sum("w").alias("w"))
    side = Window.partitionBy(*keys).orderBy("e")
    e = e.withColumn("c", F.sum("w").over(side) / F.sum("w").over(Window.partitionBy(*keys)))
    e = e.withColumn("c0", F.lag("c").over(side)).withColumn("e0", F.lag("e").over(side))

    def at(q: float) -> Column:
        inside = (F.col("c") >= q) & (F.coalesce(F.col("c0"), F.lit(-1.0)) < q)
        value = F.when(F.col("c0").isNull(), F.col("e")).otherwise(F.col("e0") + (q - F.col("c0")) / (F.col("c") - F.col("c0")) * (F.col("e") - F.col("e0")))
        return F.max(F.when(inside, value))

    return e.groupBy(*keys).agg(((at(0.84) - at(0.16)) / 2).alias("scatter"))


# -- probabilistic --------------------------------------------------------------------------------


def member_arrays(ens: DataFrame, obs: DataFrame) -> DataFrame:
    """``(t, y, x, f, o)``: sorted members of every cell with its observation; cells lacking a value are left out."""
    f = ens.groupBy("t", "y", "x").agg(F.array_sort(F.collect_list("v")).alias("f"), F.count(F.lit(1)).alias("k"))
    return f.where(F.size("f") == F.col("k")).join(obs.select("t", "y", "x", F.col("v").alias("o")).where("o is not null"), ["t", "y", "x"]).drop("k")


def crps_state(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum and number of the continuous ranked probability scores of cells with sorted members ``f``.

    A gap between neighbouring members counts only where the observation lies
    strictly on one side of it or strictly inside, so an observation equal to a
    member adds nothing on its two gaps.
    """
    n = F.size("f")
    i = F.sequence(F.lit(1), n - 1)
    lo, hi, o = (lambda k: F.element_at("f", k)), (lambda k: F.element_at("f", k + 1)), F.col("o")

    def gap(k):
        p, q = F.pow(k / n, F.lit(2.0)), F.pow(1 - k / n, F.lit(2.0))
        inside = (o - lo(k)) * p + (hi(k) - o) * q
        return F.when(o > hi(k), (hi(k) - lo(k)) * p).when((o > lo(k)) & (o < hi(k)), inside).when(o < lo(k), (hi(k) - lo(k)) * q).otherwise(0.0)

    middle = F.when(n > 1, F.aggregate(F.transform(i, gap), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)
    first, last = F.element_at("f", 1), F.element_at("f", -1)
    ends = F.when(o < first, first - o).when(o > last, o - last).otherwise(0.0)
    return cells.groupBy(*keys).agg(F.sum(middle + ends).alias("s"), F.count("*").alias("n"))


def probability_pairs(ens: DataFrame, obs: DataFrame, thr: float) -> DataFrame:
    """``(t, y, x, pf, o)``: share of members from thr up, with the observation."""
    pf = ens.groupBy("t", "y", "x").agg(F.avg(F.when(F.col("v") >= thr, 1.0).otherwise(0.0)).alias("pf"))
    return pf.join(obs.select("t", "y", "x", F.col("v").alias("o")), ["t", "y", "x"]).where("o is not null")


def reliability_state(pairs: DataFrame, thr: float, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Per probability bin: number of pairs, of events, and the sum of probabilities. Bins are closed above."""
    width = (1.0 + 2e-6) / n_bins
    b = F.greatest(F.ceil((F.col("pf") + 1e-6) / width) - 1, F.lit(0)).cast("int")
    return pairs.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), _sum_if(F.col("o") >= thr).alias("events"), F.sum("pf").alias("sp"))


def reliability(state: DataFrame, min_count: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Observed frequency and mean probability of the bins with enough pairs in all batches together."""
    return state.where(F.col("n") >= min_count).select(*keys, "bin", "n", (F.col("events") / F.col("n")).alias("obs_freq"), (F.col("sp") / F.col("n")).alias("mean_prob"))


def roc_state(pairs: DataFrame, thr: float, n_thresholds: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Contingency counts for evenly spaced probability thresholds, the thresholds exploded map-side."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_thresholds - 1)), lambda k: F.struct(k.alias("k"), (k / (n_thresholds - 1.0)).alias("thr"))))
    # counts per probability first: there are few, and the explosion then costs nothing
    few = pairs.groupBy(*keys, "pf", (F.col("o") >= thr).alias("event")).agg(F.count("*").alias("c"))
    e = few.select(*keys, "pf", "event", "c", grid.alias("g")).select(*keys, "event", "c", F.col("g.k").alias("k"), F.col("g.thr").alias("pthr"), (F.col("pf") >= F.col("g.thr")).alias("yes"))
    s = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    return e.groupBy(*keys, "k", "pthr").agg(s(F.col("yes") & F.col("event")).alias("h"), s(~F.col("yes") & F.col("event")).alias("m"), s(F.col("yes") & ~F.col("event")).alias("f"), s(~F.col("yes") & ~F.col("event")).alias("r"))


def roc_curve(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """POD and POFD per threshold."""
    return state.select(*keys, "k", "pthr", ratio(F.col("h"), F.col("h") + F.col("m")).alias("pod"), ratio(F.col("f"), F.col("f") + F.col("r")).alias("pofd"))


def roc_area(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the curve, closed at (0,0) and (1,1); the curve has a few points only."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("k")
    c = curve.select(*keys, "k", "pod", "pofd", F.lead("pod", 1, 0.0).over(w).alias("pod1"), F.lead("pofd", 1, 0.0).over(w).alias("pofd1"))
    area = F.sum((F.col("pofd") - F.col("pofd1")) * (F.col("pod") + F.col("pod1")) / 2)
    start = F.max(F.when(F.col("k") == 0, (1 - F.col("pofd")) * (1 + F.col("pod")) / 2))
    return c.groupBy(*keys).agg((area + start).alias("area"))


# -- ensembles ------------------------------------------------------------------------------------


def rank_histogram(cells: DataFrame, x_min: float | None = None, keys: Sequence[str] = (), normalise: bool = False) -> DataFrame:
    """``(keys, rank, n[, share])``: members below the observation; ties take the lowest rank.

    With ``x_min``, cells where observation and all members lie below it are left
    out and values below it are set just under it.
    """
    c = cells
    if x_min is not None:
        c = c.where((F.col("o") >= x_min) | (F.element_at("f", -1) >= x_min))
        low = lambda v: F.when(v < x_min, F.lit(x_min - 1.0)).otherwise(v)
        c = c.select(*keys, F.transform("f", low).alias("f"), low(F.col("o")).alias("o"))
    rank = F.size(F.filter("f", lambda v: v < F.col("o")))
    h = c.groupBy(*keys, rank.alias("rank")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # members + 1 rows a key
    return h.withColumn("share", F.col("n") / F.sum("n").over(all_)) if normalise else h


def ensemble_skill(ens: DataFrame, obs: DataFrame, thr: float, score: str) -> DataFrame:
    """Mean over members of a categorical score against the observation."""
    pairs = ens.select("member", "t", "y", "x", F.col("v").alias("p")).join(obs.select("t", "y", "x", F.col("v").alias("o")), ["t", "y", "x"])
    return categorical_scores(contingency_state(pairs, thr, ["member"]), ["member"]).agg(F.avg(score).alias("skill"))


def ensemble_spread(ens: DataFrame, score: str = "rmse") -> DataFrame:
    """Mean of a continuous score over all pairs of members, paired inside each cell's array."""
    a = ens.groupBy("t", "y", "x").agg(F.array_sort(F.collect_list(F.struct("member", "v"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda i: F.transform(F.filter("m", lambda j: j["member"] > i["member"]), lambda j: F.struct(i["member"].alias("a"), j["member"].alias("b"), i["v"].alias("p"), j["v"].alias("o")))))
    e = a.select(F.explode(pairs).alias("e")).select("e.*")
    return continuous_scores(moment_state(e, ["a", "b"]), ["a", "b"]).agg(F.avg(score).alias("spread"))


# -- spatial --------------------------------------------------------------------------------------


def fss_state(pairs: DataFrame, thr: float, scale: int, keys: Sequence[str] = ()) -> DataFrame:
    """The three sums of the fractions skill score; a missing value is no event."""
    i = lambda c: F.when(F.coalesce(F.col(c) >= thr, F.lit(False)), 1.0).otherwise(0.0).alias(c)
    b = box_mean(pairs.select("t", "y", "x", i("p"), i("o")), ["p", "o"], scale)
    p, o = F.col("p"), F.col("o")
    return b.groupBy(*keys).agg(F.sum(p * p).alias("spp"), F.sum(p * o).alias("spo"), F.sum(o * o).alias("soo"))


def fss_scores(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    a = F.col("spp") + F.col("soo")
    return state.select(*keys, (1 - ratio(a - 2 * F.col("spo"), a)).alias("fss"))


def binary_mse_state(pairs: DataFrame, thr: float, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Haar energies of the difference of the two event fields per scale (2^k cells), and the base rate.

    Scale k holds what averaging over 2^k cells keeps and over 2^(k+1) loses; the last is the mean field.
    """
    e = lambda c: F.when(F.coalesce(F.col(c) >= thr, F.lit(False)), 1.0).otherwise(0.0)
    more = [k for k in keys if k != "t"]
    z = pairs.select(*more, "t", "y", "x", (e("p") - e("o")).alias("z"), e("o").alias("e"))
    cols = [F.avg("z").over(Window.partitionBy(*more, "t", F.shiftright("y", k), F.shiftright("x", k))).alias(f"b{k}") for k in range(levels + 1)]
    b = z.select(*keys, "e", *cols)
    scales = [F.avg(F.pow(F.col(f"b{k}") - F.col(f"b{k + 1}"), F.lit(2.0))).alias(f"m{k}") for k in range(levels)]
    row = b.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("e").alias("eps"), *scales, F.avg(F.pow(F.col(f"b{levels}"), F.lit(2.0))).alias(f"m{levels}"))
    packed = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"m{k}").alias("mse")) for k in range(levels + 1)]))
    return row.select(*keys, "n", "eps", packed.alias("s")).select(*keys, "s.level", "s.mse", "eps", "n")


def binary_mse_merge(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """States of several batches, unioned, to one: energies and base rates weighted by their cells."""
    n = F.sum("n")
    return states.groupBy(*keys, "level").agg((F.sum(F.col("mse") * F.col("n")) / n).alias("mse"), (F.sum(F.col("eps") * F.col("n")) / n).alias("eps"), n.alias("n"))


def binary_mse_scores(state: DataFrame, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    base = 2 * F.col("eps") * (1 - F.col("eps")) / (levels + 1)
    return state.select(*keys, "level", (1 - quotient(F.col("mse"), base)).alias("skill"))


def intensity_scale_state(pairs: DataFrame, thrs: Sequence[float], scales: Sequence[int], frame: Sequence[str] = ("t",)) -> DataFrame:
    """``(thr, scale, spp, spo, soo)`` for every threshold and scale in one pass over the pairs.

    Event counts are cumulated along both axes once per threshold, and every
    scale reads its boxes as differences of four corners of that summed table.
    States of batches (and the counts behind them) add up by ``merge_states``.
    """
    yes = lambda c: F.when(F.coalesce(F.col(c) >= F.col("thr"), F.lit(False)), 1.0).otherwise(0.0)
    each = pairs.select(*frame, "y", "x", "p", "o", F.explode(F.array(*[F.lit(float(t)) for t in thrs])).alias("thr"))
    packed = each.select(*frame, "thr", F.struct("y", "x", yes("p").alias("p"), yes("o").alias("o")).alias("c")).groupBy(*frame, "thr").agg(F.collect_list("c").alias("cells"))

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                c = batch.column("cells")[i].values
                y, x, p, o = (c.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                tables = []
                for v in (p, o):
                    raster = np.zeros((y.max() + 1, x.max() + 1))
                    raster[y, x] = v
                    tables.append(np.pad(raster.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
                ny, nx = (n - 1 for n in tables[0].shape)
                for scale in scales:
                    lo, hi = scale // 2, scale - 1 - scale // 2
                    a, b = np.maximum(np.arange(ny) - lo, 0), np.minimum(np.arange(ny) + hi, ny - 1) + 1
                    c0, d0 = np.maximum(np.arange(nx) - lo, 0), np.minimum(np.arange(nx) + hi, nx - 1) + 1
                    f, g = ((t[b][:, d0] - t[a][:, d0] - t[b][:, c0] + t[a][:, c0]) / scale**2 for t in tables)
                    for col, v in zip(out, (batch.column("thr")[i].as_py(), scale, (f * f).sum(), (f * g).sum(), (g * g).sum())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.float64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.float64()) for c in out[2:]]], names=["thr", "scale", "spp", "spo", "soo"])

    return merge_states(packed.mapInArrow(run, "thr double, scale int, spp double, spo double, soo double"), ["thr", "scale"])


def intensity_scale(pairs: DataFrame, thrs: Sequence[float], scales: Sequence[int]) -> DataFrame:
    """``(thr, scale, fss)`` over a table of thresholds and scales."""
    return fss_scores(intensity_scale_state(pairs, thrs, scales), ["thr", "scale"])


def sal_amplitude(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Relative difference of the domain means."""
    s = pairs.groupBy(*keys).agg(F.avg("p").alias("mp"), F.avg("o").alias("mo"))
    return s.select(*keys, ratio(F.col("mp") - F.col("mo"), 0.5 * (F.col("mp") + F.col("mo"))).alias("amplitude"))


def sal_location1(pairs: DataFrame, ny: int, nx: int, keys: Sequence[str] = ()) -> DataFrame:
    """Distance of the two centres of mass as a share of the domain's diagonal."""
    mass = lambda c, x: F.try_divide(F.sum(F.col(c) * F.col(x)), F.sum(c))
    s = pairs.groupBy(*keys).agg(*[mass(c, x).alias(c + x) for c in "po" for x in "yx"])
    d = F.sqrt(F.pow(F.col("py") - F.col("oy"), F.lit(2.0)) + F.pow(F.col("px") - F.col("ox"), F.lit(2.0)))
    return s.select(*keys, (d / float((ny * ny + nx * nx) ** 0.5)).alias("l1"))


def lifetime(scores: DataFrame, rule: str = "1/e", keys: Sequence[str] = ()) -> DataFrame:
    """Lifetime of a score ``s`` over lead time ``lead``.

    ``trapz`` integrates; ``1/e`` interpolates the first fall to 1/e (never: the
    last lead time; at once: the first).
    """
    w = Window.partitionBy(*keys).orderBy("lead")
    d = scores.withColumn("s0", F.lag("s").over(w)).withColumn("t0", F.lag("lead").over(w))
    if rule == "trapz":
        return d.groupBy(*keys).agg(F.sum((F.col("lead") - F.col("t0")) * (F.col("s") + F.col("s0")) / 2).alias("lifetime"))
    if rule != "1/e":
        raise ValueError(rule)
    e = F.exp(F.lit(-1.0))
    hit = F.when(F.col("s") <= e, F.when(F.col("s0").isNull(), F.col("lead")).otherwise(F.col("t0") + (F.col("s0") - e) / (F.col("s0") - F.col("s")) * (F.col("lead") - F.col("t0"))))
    return d.withColumn("hit", hit).groupBy(*keys).agg(F.coalesce(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("lead"))), F.max("lead").cast("double")).alias("lifetime"))
