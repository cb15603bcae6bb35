"""Queries over verification and ensemble operators, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from rainweft.operators import ensemble as E
from rainweft.operators import verification as V
from rainweft.plans.common import ENS_SQL, N, PAIR_SQL, ens, obs, pairs, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


CAT = """
select {keys} {r}(h / (h + m)) pod, {r}(f / nullif(h + f, 0)) far, {r}(f / (f + r)) fa, {r}((h + r) / n) acc, {r}(h / (h + m + f)) csi, {r}((h + f) / (h + m)) bias,
  {r}((h + r - e) / nullif(n - e, 0)) hss, {r}(h / (h + m) - f / (f + r)) hk, {r}((h - q) / nullif(h + m + f - q, 0)) gss,
  case when h > 0 and m > 0 and f > 0 and r > 0 then {r}((ln(f/(f+r)) - ln(h/(h+m)) + ln(1 - h/(h+m)) - ln(1 - f/(f+r))) / (ln(f/(f+r)) + ln(h/(h+m)) + ln(1 - h/(h+m)) + ln(1 - f/(f+r)))) end sedi,
  {r}((h * r - f * m) / nullif(sqrt((h + f) * (h + m) * (r + f) * (r + m)), 0)) mcc, {r}(2 * h / (2 * h + f + m)) f1
from (select *, h + m + f + r n, ((h + m) * (h + f) + (r + m) * (r + f)) / (h + m + f + r) e, (h + m) * (h + f) / (h + m + f + r) q from cont)
"""


def _cat_sql(keys: str) -> str:
    text = CAT.format(keys=keys + "," if keys else "", r="ROUND6")
    return _round6(text)


def _round6(text: str) -> str:
    """ROUND6(x) to round(x, 6), with matching brackets."""
    while "ROUND6(" in text:
        i = text.index("ROUND6(")
        depth, j = 1, i + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        text = f"{text[:i]}(round({text[i + 7 : j - 1]}, 6) + 0.0){text[j:]}"
    return text


def _cont(key: str, source: str = "pair", thr: str = "thr") -> str:
    s = lambda cond: f"cast(sum(case when {cond} then 1 else 0 end) as double)"
    return f"""cont as (select {key}, {s(f'p > {thr} and o > {thr}')} h, {s(f'not p > {thr} and o > {thr}')} m, {s(f'p > {thr} and not o > {thr}')} f, {s(f'not p > {thr} and not o > {thr}')} r from {source} group by {key})"""


THRS = (50.0, 100.0, 200.0)


def _flagship(spark, d):
    p = pairs(spark, d)
    each = F.explode(F.array(*[F.lit(t) for t in THRS])).alias("thr")
    return V.categorical_scores(V.contingency_state(p.select(each, "p", "o"), F.col("thr"), ["thr"]), ["thr"])


add("flagship_categorical", _flagship, f"with {PAIR_SQL}, both_ as (select *, unnest([50.0, 100.0, 200.0]::double[]) thr from pair), {_cont('thr', 'both_')} {_cat_sql('thr')}")
add("categorical_by_frame", lambda s, d: V.categorical_scores(V.contingency_state(pairs(s, d), 40.0, ["t"]), ["t"]), f"with {PAIR_SQL}, {_cont('t', thr='40')} {_cat_sql('t')}")


def _merged(s, d):
    p = pairs(s, d)
    batches = [V.contingency_state(p.where(F.col("t") % 3 == k), 40.0) for k in range(3)]
    return V.categorical_scores(V.merge_states(reduce(lambda a, b: a.unionByName(b), batches), []))


add("categorical_merged", _merged, f"with {PAIR_SQL}, {_cont('1 as one', thr='40').replace('group by 1 as one', '')} {_cat_sql('')}")

CONT = _round6("""
select {keys} ROUND6(mp - mo) me, ROUND6(mae) mae, ROUND6(mse) mse, ROUND6(mse / (spl)) nmse, ROUND6(sqrt(mse)) rmse, ROUND6(cov / (sqrt(vp) * sqrt(vo))) corr_p, ROUND6(cov / vp) beta1,
  ROUND6(cov / vo) beta2, ROUND6(1 - mse / vo) rv, ROUND6(sqrt(mse - (mp - mo) ** 2)) drmse
from (select {keys} avg(p) mp, avg(o) mo, var_pop(p) vp, var_pop(o) vo, covar_pop(p, o) cov, avg((p - o) ** 2) mse, avg((p + o) ** 2) spl, avg(abs(p - o)) mae from pair {where} {group})
""")


def _cont_sql(where: str = "", key: str = "") -> str:
    return f"with {PAIR_SQL} " + CONT.format(keys=key + "," if key else "", where=where, group=f"group by {key}" if key else "")


# square roots, since means of hundredths over 1,024 cells often end in a 5 at the seventh place
_ROOTS = lambda s, d: pairs(s, d).withColumn("p", F.sqrt("p")).withColumn("o", F.sqrt("o"))
add("continuous_by_frame", lambda s, d: V.continuous_scores(V.moment_state(_ROOTS(s, d), ["t"]), ["t"]), _cont_sql(key="t").replace("from pair ", "from (select t, sqrt(p) p, sqrt(o) o from pair) "))
for _how, _where in (("single", "where p > 10 or o > 10"), ("double", "where p > 10 and o > 10")):
    add(f"continuous_{_how}", lambda s, d, how=_how: V.continuous_scores(V.moment_state(V.conditioned(pairs(s, d), how, 10.0))), _cont_sql(_where))
add(
    "spearman", lambda s, d: V.spearman(pairs(s, d), ["t"]),
    f"""with {PAIR_SQL}, r as (select t, rank() over (partition by t order by p) + (count(*) over (partition by t, p) - 1) / 2.0 rp, rank() over (partition by t order by o) + (count(*) over (partition by t, o) - 1) / 2.0 ro from pair)
    select t, round(corr(rp, ro), 6) corr_s from r group by t""",
)
add(
    "scatter", lambda s, d: V.scatter(pairs(s, d)),
    f"""with {PAIR_SQL}, e as (select 10 * log10(p / o) e, sum(o) w from pair where p > 0 and o > 0 group by 1),
    c as (select e, sum(w) over (order by e) / sum(w) over () c from e), l as (select *, lag(c) over (order by e) c0, lag(e) over (order by e) e0 from c)
    select round((max(case when c >= 0.84 and coalesce(c0, -1) < 0.84 then coalesce(e0 + (0.84 - c0) / (c - c0) * (e - e0), e) end) - max(case when c >= 0.16 and coalesce(c0, -1) < 0.16 then coalesce(e0 + (0.16 - c0) / (c - c0) * (e - e0), e) end)) / 2, 6) scatter from l""",
)

# -- probabilistic


def _cells(s, d):
    return V.member_arrays(ens(s, d), obs(s, d))


add(
    "crps", lambda s, d: V.crps_state(_cells(s, d), ["t"]).select("t", F.col("s").alias("crps_sum"), "n"),
    f"""with {ENS_SQL}, g as (select t, y, x, o, f, unnest(range(1, len(f))) k from arr),
    gaps as (select t, y, x, sum(case when o > f[k+1] then (f[k+1] - f[k]) * (k / 5.0) ** 2 when o > f[k] and o < f[k+1] then (o - f[k]) * (k / 5.0) ** 2 + (f[k+1] - o) * (1 - k / 5.0) ** 2 when o < f[k] then (f[k+1] - f[k]) * (1 - k / 5.0) ** 2 else 0 end) s from g group by 1, 2, 3)
    select t, round(sum(s + case when o < f[1] then f[1] - o when o > f[5] then o - f[5] else 0 end), 6) crps_sum, count(*) n from gaps join arr using (t, y, x) group by t""",
)
PF = f"{ENS_SQL}, pf as (select e.t, e.y, e.x, avg(case when e.v >= 40 then 1.0 else 0.0 end) pf, any_value(o.v) o from ens e join obs o on e.t = o.t and e.y = o.y and e.x = o.x group by 1, 2, 3)"
add(
    "reliability", lambda s, d: V.reliability(V.reliability_state(V.probability_pairs(ens(s, d), obs(s, d), 40.0), 40.0)),
    f"with {PF} select cast(greatest(ceil((pf + 1e-6) / ((1.0 + 2e-6) / 10)) - 1, 0) as integer) bin, count(*) n, round(avg(case when o >= 40 then 1.0 else 0.0 end), 6) obs_freq, round(avg(pf), 6) mean_prob from pf group by 1 having count(*) >= 10",
)
ROC = f"""{PF}, k as (select cast(range as integer) k, range / 9.0 pthr from range(10)),
c as (select k, pthr, sum(case when pf >= pthr and o >= 40 then 1 else 0 end) h, sum(case when pf < pthr and o >= 40 then 1 else 0 end) m, sum(case when pf >= pthr and o < 40 then 1 else 0 end) f, sum(case when pf < pthr and o < 40 then 1 else 0 end) r from pf, k group by 1, 2),
roc as (select k, pthr, h / (h + m) pod, f / (f + r) pofd from c)"""


def _roc(s, d):
    return V.roc_curve(V.roc_state(V.probability_pairs(ens(s, d), obs(s, d), 40.0), 40.0))


add("roc_curve", _roc, f"with {ROC} select k, round(pthr, 6) pthr, round(pod, 6) pod, round(pofd, 6) pofd from roc")
add(
    "roc_area", lambda s, d: V.roc_area(_roc(s, d)),
    f"with {ROC}, l as (select k, pod, pofd, lead(pod, 1, 0) over (order by k) pod1, lead(pofd, 1, 0) over (order by k) pofd1 from roc) select round(sum((pofd - pofd1) * (pod + pod1) / 2) + max(case when k = 0 then (1 - pofd) * (1 + pod) / 2 end), 6) area from l",
)
add("rank_histogram", lambda s, d: V.rank_histogram(_cells(s, d)), f"with {ENS_SQL} select cast(len(list_filter(f, lambda v: v < o)) as integer) as rank, count(*) n from arr group by 1")
add(
    "rank_histogram_wet", lambda s, d: V.rank_histogram(_cells(s, d), 20.0),
    f"with {ENS_SQL} select cast(len(list_filter(f, lambda v: (case when v < 20 then 19 else v end) < (case when o < 20 then 19 else o end))) as integer) as rank, count(*) n from arr where o >= 20 or f[5] >= 20 group by 1",
)
add(
    "ensemble_skill", lambda s, d: V.ensemble_skill(ens(s, d), obs(s, d), 40.0, "csi"),
    f"with {ENS_SQL} select round(avg(csi), 6) skill from (select member, sum(case when e.v > 40 and o.v > 40 then 1 else 0 end) / sum(case when e.v > 40 or o.v > 40 then 1 else 0 end) csi from ens e join obs o on e.t = o.t and e.y = o.y and e.x = o.x group by member)",
)
add(
    "ensemble_spread", lambda s, d: V.ensemble_spread(ens(s, d)),
    f"with {ENS_SQL} select round(avg(r), 6) spread from (select a.member, b.member, sqrt(avg((a.v - b.v) ** 2)) r from ens a join ens b on a.t = b.t and a.y = b.y and a.x = b.x and a.member < b.member group by 1, 2)",
)
add("ensemble_mean", lambda s, d: E.ensemble_mean(ens(s, d)), f"with {ENS_SQL} select t, y, x, round(avg(v), 6) v from ens group by 1, 2, 3")
add("ensemble_mean_above", lambda s, d: E.ensemble_mean(ens(s, d), 20.0), f"with {ENS_SQL} select t, y, x, round(avg(case when v >= 20 then v end), 6) v from ens group by 1, 2, 3")
add(
    "exceedance", lambda s, d: E.exceedance(ens(s, d), (20.0, 80.0)),
    f"with {ENS_SQL} select t, y, x, thr, round(avg(case when v >= thr then 1.0 else 0.0 end), 6) p from ens, (values (20.0::double), (80.0::double)) q(thr) group by 1, 2, 3, 4",
)
BAND = f"{ENS_SQL}, r as (select member, row_number() over (partition by t, y, x order by v, member) r from ens), depth as (select member, avg(((5 - r) * (r - 1) + 4) / 10.0) d from r group by member)"
add("band_depth", lambda s, d: E.band_depth(ens(s, d)), f"with {BAND} select member, round(d, 6) depth from depth")
add("band_depth_normalised", lambda s, d: E.band_depth(ens(s, d), True), f"with {BAND} select member, round((d - min(d) over ()) / (max(d) over () - min(d) over ()), 6) depth from depth")

# -- spatial


def _fss_sql(thr: float, s: int) -> str:
    f = lambda c, along, across: f"sum({c}) over (partition by t, {across} order by {along} range between {s // 2} preceding and {s - 1 - s // 2} following)"
    return f"""(select 1 - (spp - 2 * spo + soo) / (spp + soo) fss from (select sum(p * p) spp, sum(p * o) spo, sum(o * o) soo from (
      select {f('p', 'y', 'x')} / {s * s}.0 p, {f('o', 'y', 'x')} / {s * s}.0 o from (select t, y, x, {f('p', 'x', 'y')} p, {f('o', 'x', 'y')} o from (
      select t, y, x, case when p >= {thr} then 1.0 else 0.0 end p, case when o >= {thr} then 1.0 else 0.0 end o from pair)))))"""


add("fss", lambda s, d: V.fss_scores(V.fss_state(pairs(s, d), 40.0, 5)), f"with {PAIR_SQL} select round(fss, 6) fss from {_fss_sql(40.0, 5)}")
add(
    "intensity_scale", lambda s, d: V.intensity_scale(pairs(s, d), (20.0, 80.0), (1, 4, 9)),
    f"with {PAIR_SQL} " + " union all ".join(f"select {t}::double thr, {k} scale, round(fss, 6) fss from {_fss_sql(t, k)}" for t in (20.0, 80.0) for k in (1, 4, 9)),
)
_B = ", ".join(f"avg(z) over (partition by t, y // {2**k}, x // {2**k}) b{k}" for k in range(4))
add(
    "binary_mse", lambda s, d: V.binary_mse_scores(V.binary_mse_state(pairs(s, d), 40.0, 3), 3),
    f"""with {PAIR_SQL}, z as (select t, y, x, case when p >= 40 then 1.0 else 0.0 end - case when o >= 40 then 1.0 else 0.0 end z, case when o >= 40 then 1.0 else 0.0 end e from pair),
    b as (select e, {_B} from z), m as (select avg(e) eps, [avg((b0-b1)**2), avg((b1-b2)**2), avg((b2-b3)**2), avg(b3**2)] ms from b)
    select cast(k as integer) as level, round(1 - ms[k + 1] / (2 * eps * (1 - eps) / 4), 6) skill from m, (select range k from range(4))""",
)
add("sal_amplitude", lambda s, d: V.sal_amplitude(pairs(s, d), ["t"]), f"with {PAIR_SQL} select t, round((avg(p) - avg(o)) / (0.5 * (avg(p) + avg(o))), 6) amplitude from pair group by t")
add(
    "sal_location1", lambda s, d: V.sal_location1(pairs(s, d), N, N, ["t"]),
    f"with {PAIR_SQL} select t, round(sqrt((sum(p*y)/sum(p) - sum(o*y)/sum(o))**2 + (sum(p*x)/sum(p) - sum(o*x)/sum(o))**2) / sqrt({2 * N * N}.0), 6) l1 from pair group by t",
)


def _curve(s, d):
    """A score that falls with lead time: correlation scaled to 1 at the first lead."""
    o = obs(s, d).where("v > 0").groupBy("t").agg(F.avg("v").alias("m"))
    return o.select(F.col("t").alias("lead"), (F.exp(-F.col("t") / 7.0) * (1 + F.sin(F.col("m")) / 20)).alias("s"))


CURVE = f"{PAIR_SQL}, curve as (select t as lead_, exp(-t / 7.0) * (1 + sin(avg(v)) / 20) s from obs where v > 0 group by t), l as (select *, lag(s) over (order by lead_) s0, lag(lead_) over (order by lead_) t0 from curve)"
add("lifetime_trapz", lambda s, d: V.lifetime(_curve(s, d), "trapz"), f"with {CURVE} select round(sum((lead_ - t0) * (s + s0) / 2), 6) lifetime from l")
add(
    "lifetime_crossing", lambda s, d: V.lifetime(_curve(s, d)),
    f"with {CURVE}, h as (select lead_, case when s0 is null then lead_ else t0 + (s0 - exp(-1)) / (s0 - s) * (lead_ - t0) end hit from l where s <= exp(-1)) select round(coalesce((select hit from h order by lead_ limit 1), (select max(lead_) from curve)), 6) lifetime",
)
