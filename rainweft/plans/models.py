"""Queries over autoregressive models, scores per key, object scores, tracks and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweft.operators import analysis as Y
from rainweft.operators import blending as B
from rainweft.operators import forecast as P
from rainweft.operators import grid as G
from rainweft.operators import joins as J
from rainweft.operators import neighbourhood as H
from rainweft.operators import objects as O
from rainweft.operators import reprojection as X
from rainweft.operators import scattered as S
from rainweft.operators import series as A
from rainweft.operators import tracking as K
from rainweft.operators import verification as V
from rainweft.operators.ensemble import lagged_ensemble
from rainweft.plans.common import ENS_SQL, FLOW_SQL, MODEL_SQL, OBS_SQL, PAIR_SQL, PTS_SQL, N, ens, flow, model, obs, pairs, points, read, rounded
from rainweft.plans.forecasts import plain, tensors
from rainweft.plans.scores import _round6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLES[name] = _round6(sql)


# -- autoregressive models


def _halves(s, d):
    """The raster in two cases that end at different frames."""
    o = obs(s, d).withColumn("case", (F.col("t") / 15).cast("int"))
    return o.where("t < 13 or t >= 15")


_HALF = f"{OBS_SQL}, half as (select t // 15 as c, * from obs where t < 13 or t >= 15)"
_LAGS = "l as (select c, t, y, x, v x0, lag(v) over w x1, lag(v, 2) over w x2 from half window w as (partition by c, y, x order by t))"
_PHI = """ROUND6((e * s01 - b * s02) / (a * e - b * b)) phi_1, ROUND6((a * s02 - b * s01) / (a * e - b * b)) phi_2,
  ROUND6(sqrt(greatest(s00 - (e * s01 - b * s02) / (a * e - b * b) * s01 - (a * s02 - b * s01) / (a * e - b * b) * s02, 0) / s00)) phi_0"""
_SUMS = "sum(x0 * x0) s00, sum(x0 * x1) s01, sum(x0 * x2) s02, sum(x1 * x1) a, sum(x1 * x2) b, sum(x2 * x2) e"
add("lag_correlation_by_case", lambda s, d: A.lag_correlations(_halves(s, d), (1, 2), ["case"]), f'with {_HALF}, m as (select c, max(t) m from half group by c) select cast(a.c as integer) "case", cast(a.t - b.t as integer) lag, ROUND6(corr(a.v, b.v)) gamma from half a join m on a.c = m.c and a.t = m.m join half b on a.c = b.c and a.y = b.y and a.x = b.x and b.t between a.t - 2 and a.t - 1 group by 1, 2')
add("ar_ols", lambda s, d: A.ols_fits(_halves(s, d), 2, ["case"]), f'with {_HALF}, {_LAGS}, s as (select c, {_SUMS} from l where x2 is not null group by c) select cast(c as integer) "case", {_PHI} from s')
add("ar_ols_differenced", lambda s, d: A.ols_fits(obs(s, d), 2, d=1), f"with {OBS_SQL}, half as (select 0 c, t, y, x, v - lag(v) over (partition by y, x order by t) v from obs), {_LAGS}, s as (select {_SUMS} from l where x2 is not null) select {_PHI} from s")
add("ar_ols_ridge", lambda s, d: A.ols_fits(obs(s, d), 1, lam=100.0), f"with {OBS_SQL}, half as (select 0 c, * from obs), {_LAGS}, s as (select sum(x0 * x0) s00, sum(x0 * x1) s01, sum(x1 * x1) + 100 s11 from l where x1 is not null) select ROUND6(s01 / s11) phi_1, ROUND6(sqrt(greatest(s00 - s01 / s11 * s01, 0) / s00)) phi_0 from s")
for _window, _weight, _reach in (("gaussian", "exp(-((k.range / 2.0) ** 2) / 2)", 6), ("uniform", "1.0", 2)):
    _k = f"k as (select range, {_weight} w from range(-{_reach}, {_reach + 1}) k)"
    _names = ("s00", "s01", "s02", "a", "b", "e")
    add(
        f"ar_ols_localized_{_window}", lambda s, d, w=_window: A.ols_fits_localized(obs(s, d), 2, 2.0, window=w),
        f"with {OBS_SQL}, half as (select 0 c, * from obs), {_LAGS}, o as (select y, x, {_SUMS} from l where x2 is not null group by y, x), {_k}, "
        f"v as (select o.y + k.range y, x, {', '.join(f'sum({n} * w) {n}' for n in _names)} from o, k group by 1, 2 having y between 0 and 31), "
        f"s as (select y, v.x + k.range x, {', '.join(f'sum({n} * w) {n}' for n in _names)} from v, k group by 1, 2 having x between 0 and 31) select cast(y as integer) y, cast(x as integer) x, {_PHI} from s",
    )


def _gammas(s, d):
    g1, g2 = (A.moving_lag_correlations(obs(s, d), k, 3.0).withColumnRenamed("gamma", f"gamma_{k}") for k in (1, 2))
    return g1.join(g2, ["y", "x"])


_MOVING = ", ".join(
    f"""g{k} as (select y, x, case when aa / n - (a / n) ** 2 > 1e-12 and bb / n - (b / n) ** 2 > 1e-12 then (ab / n - a * b / (n * n)) / sqrt((aa / n - (a / n) ** 2) * (bb / n - (b / n) ** 2)) end gamma_{k} from (
  select y, v.x + k.range x, sum(n * w) n, sum(a * w) a, sum(b * w) b, sum(aa * w) aa, sum(bb * w) bb, sum(ab * w) ab from (
    select o.y + k.range y, o.x, sum(w) n, sum(o.v * w) a, sum(q.v * w) b, sum(o.v * o.v * w) aa, sum(q.v * q.v * w) bb, sum(o.v * q.v * w) ab
    from obs o join obs q on o.y = q.y and o.x = q.x and o.t = 29 and q.t = {29 - k}, k group by 1, 2 having o.y + k.range between 0 and 31) v, k group by 1, 2 having v.x + k.range between 0 and 31))"""
    for k in (1, 2)
)
_GSQL = f"with {OBS_SQL}, k as (select range, exp(-((range / 3.0) ** 2) / 2) w from range(-9, 10)), {_MOVING}, g as (select g1.y, g1.x, gamma_1, gamma_2 from g1 join g2 using (y, x))"
add("lag_correlation_moving", lambda s, d: _gammas(s, d), f"{_GSQL} select cast(y as integer) y, cast(x as integer) x, ROUND6(gamma_1) gamma_1, ROUND6(gamma_2) gamma_2 from g")
add("ar_yule_walker_localized", lambda s, d: A.yule_walker_localized(_gammas(s, d)), f"{_GSQL}, p as (select *, gamma_1 * (1 - gamma_2) / (1 - gamma_1 ** 2) p1, (gamma_2 - gamma_1 ** 2) / (1 - gamma_1 ** 2) p2 from g) select cast(y as integer) y, cast(x as integer) x, ROUND6(p1) phi_1, ROUND6(p2) phi_2, ROUND6(sqrt(greatest(1 - gamma_1 * p1 - gamma_2 * p2, 0))) phi_0 from p")
_VAR = lambda s, d: obs(s, d).withColumn("var", F.lit(0)).unionByName(model(s, d).withColumn("var", F.lit(1)))
_VSQL = f"{OBS_SQL}, {MODEL_SQL}, vars as (select 0 var, t, y, x, v from obs union all select 1, t, y, x, v from model)"
_VLAG = "e as (select a.var, l.range as lag, a.t, a.y, a.x, b.v from vars a, range(0, 3) l, vars b where a.t >= 2 and b.var = a.var and b.y = a.y and b.x = a.x and b.t = a.t - l.range)"
add("var_ols_sums", lambda s, d: A.var_sums(_VAR(s, d), 2), f"with {_VSQL}, {_VLAG} select a.var a_var, cast(a.lag as integer) a_lag, b.var b_var, cast(b.lag as integer) b_lag, ROUND6(sum(a.v * b.v)) s, count(*) n from e a join e b using (t, y, x) group by 1, 2, 3, 4")
_V1 = "o as (select a.y, a.x, sum(p.u * p.u) uu, sum(p.u * p.w) uw, sum(p.w * p.w) ww, sum(p.u * n.u) un, sum(p.w * n.u) wn, sum(p.u * n.w) um, sum(p.w * n.w) wm from grid a join z p on p.t = a.t and p.y = a.y and p.x = a.x join z n on n.t = a.t + 1 and n.y = a.y and n.x = a.x group by 1, 2)"
_V1N = ("uu", "uw", "ww", "un", "wn", "um", "wm")
add(
    "var_ols_localized", lambda s, d: A.var_fits_localized(_VAR(s, d), 1, 2.0, 2, window="uniform").select("y", "x", *[F.element_at("phi", k + 1).alias(f"phi_{k // 2}{k % 2}") for k in range(4)]),
    f"with {_VSQL}, z as (select o.t, o.y, o.x, o.v u, m.v w from obs o join model m using (t, y, x)), {_V1}, k as (select range from range(-2, 3)), "
    f"v as (select o.y + k.range y, x, {', '.join(f'sum({n}) {n}' for n in _V1N)} from o, k group by 1, 2 having y between 0 and 31), s as (select y, v.x + k.range x, {', '.join(f'sum({n}) {n}' for n in _V1N)} from v, k group by 1, 2 having x between 0 and 31) "
    "select cast(y as integer) y, cast(x as integer) x, ROUND6((ww * un - uw * wn) / (uu * ww - uw * uw)) phi_00, ROUND6((uu * wn - uw * un) / (uu * ww - uw * uw)) phi_01, ROUND6((ww * um - uw * wm) / (uu * ww - uw * uw)) phi_10, ROUND6((uu * wm - uw * um) / (uu * ww - uw * uw)) phi_11 from s",
)

# -- scores per key and merged

_CELLS = lambda s, d: V.member_arrays(ens(s, d), obs(s, d))
add("rank_histogram_by_frame", lambda s, d: V.rank_histogram(_CELLS(s, d), keys=["t"], normalise=True), f"with {ENS_SQL}, h as (select t, cast(len(list_filter(f, lambda v: v < o)) as integer) as rank, count(*) n from arr group by 1, 2) select t, rank, n, ROUND6(n / sum(n) over (partition by t)) share from h")
_PP = lambda s, d: V.probability_pairs(ens(s, d), obs(s, d), 40.0)
_PPSQL = f"{ENS_SQL}, pp as (select e.t, e.y, e.x, avg(case when e.v >= 40 then 1.0 else 0.0 end) pf, any_value(o.v) o from ens e join obs o on e.t = o.t and e.y = o.y and e.x = o.x group by 1, 2, 3)"
add("reliability_by_frame", lambda s, d: V.reliability(V.reliability_state(_PP(s, d), 40.0, 5, ["t"]), 10, ["t"]), f"with {_PPSQL}, b as (select *, cast(greatest(ceil((pf + 1e-6) / ((1 + 2e-6) / 5)) - 1, 0) as integer) bin from pp) select t, bin, count(*) n, ROUND6(avg(case when o >= 40 then 1.0 else 0.0 end)) obs_freq, ROUND6(avg(pf)) mean_prob from b group by 1, 2 having count(*) >= 10")
add("roc_area_by_frame", lambda s, d: V.roc_area(V.roc_curve(V.roc_state(_PP(s, d), 40.0, 5, ["t"]), ["t"]), ["t"]), f"""with {_PPSQL}, c as (
  select t, k.range k, sum(case when pf >= k.range / 4.0 and o >= 40 then 1.0 else 0 end) h, sum(case when pf < k.range / 4.0 and o >= 40 then 1.0 else 0 end) m,
    sum(case when pf >= k.range / 4.0 and o < 40 then 1.0 else 0 end) f, sum(case when pf < k.range / 4.0 and o < 40 then 1.0 else 0 end) r from pp, range(5) k group by 1, 2),
  p as (select t, k, h / (h + m) pod, f / (f + r) pofd from c), l as (select *, lead(pod, 1, 0) over w pod1, lead(pofd, 1, 0) over w pofd1 from p window w as (partition by t order by k))
  select t, ROUND6(sum((pofd - pofd1) * (pod + pod1) / 2) + max(case when k = 0 then (1 - pofd) * (1 + pod) / 2 end)) area from l group by t""")


def _merged_moments(s, d):
    p = pairs(s, d).select("t", F.sqrt("p").alias("p"), F.sqrt("o").alias("o"), F.pmod(F.col("x"), F.lit(3)).alias("part"))
    return V.continuous_scores(V.merge_moments(V.moment_state(p, ["t", "part"]).drop("part"), ["t"]), ["t"]).select("t", "me", "mse", "corr_p", "rv")


add("continuous_merged", _merged_moments, f"with {PAIR_SQL} select t, ROUND6(avg(p - o)) me, ROUND6(avg((p - o) ** 2)) mse, ROUND6(corr(p, o)) corr_p, ROUND6(1 - avg((p - o) ** 2) / var_pop(o)) rv from (select t, sqrt(p) p, sqrt(o) o from pair) group by t")


def _merged_energies(s, d):
    p = pairs(s, d)
    parts = V.binary_mse_state(p.where("t < 10"), 40.0, 3).unionByName(V.binary_mse_state(p.where("t >= 10"), 40.0, 3))
    return V.binary_mse_scores(V.binary_mse_merge(parts), 3)


_BLOCK = lambda k: f"avg(z) over (partition by t, y // {2**k}, x // {2**k}) b{k}"
add("binary_mse_merged", _merged_energies, f"""with {PAIR_SQL}, z as (select t, y, x, (case when p >= 40 then 1.0 else 0 end) - (case when o >= 40 then 1.0 else 0 end) z, case when o >= 40 then 1.0 else 0 end e from pair),
  b as (select e, {', '.join(map(_BLOCK, range(4)))} from z), m as (select avg(e) eps, avg((b0 - b1) ** 2) m0, avg((b1 - b2) ** 2) m1, avg((b2 - b3) ** 2) m2, avg(b3 ** 2) m3 from b)
  select cast(l.range as integer) as level, ROUND6(1 - [m0, m1, m2, m3][l.range + 1] / (2 * eps * (1 - eps) / 4)) skill from m, range(4) l""")


def _merged_fss(s, d):
    p = pairs(s, d)
    parts = V.fss_state(p.where("t < 10"), 40.0, 5).unionByName(V.fss_state(p.where("t >= 10"), 40.0, 5))
    return V.fss_scores(V.merge_states(parts, []))


_EV = lambda c: f"case when {c} >= 40 then 1.0 else 0 end"
_ROW = lambda c, over: f"sum({c}) over (partition by t, {over[0]} order by {over[1]} range between 2 preceding and 2 following) / 5 {c}"
add("fss_merged", _merged_fss, f"with {PAIR_SQL}, e as (select t, y, x, {_EV('p')} p, {_EV('o')} o from pair), a as (select t, y, x, {_ROW('p', 'yx')}, {_ROW('o', 'yx')} from e), b as (select {_ROW('p', 'xy')}, {_ROW('o', 'xy')} from a) select ROUND6(1 - sum((p - o) ** 2) / sum(p * p + o * o)) fss from b")

# -- objects and tracks

_FACTOR = 0.8
_FIELD = lambda c: f"w{c} as (select t, quantile_cont({c}, 0.95) * {_FACTOR} thr from (select *, min({c}) over (partition by t) least from pair) where {c} > least group by t), m{c} as (select pair.t, y, x, {c} v from pair join w{c} using (t) where {c} >= thr)"
# connected cells: the closure of neighbourhood within the mask
_REACH = lambda c: f"""r{c} as (select t, y, x, y * 32 + x root from m{c} union select m.t, m.y, m.x, r{c}.root from r{c} join m{c} m on m.t = r{c}.t and abs(m.y - r{c}.y) <= 1 and abs(m.x - r{c}.x) <= 1),
  l{c} as (select t, y, x, min(root) id from r{c} group by 1, 2, 3),
  ob_{c} as (select t, id, sum(v) total, max(v) peak, count(*) area, sum(v * y) / sum(v) cy, sum(v * x) / sum(v) cx from l{c} join m{c} using (t, y, x) group by 1, 2)"""  # noqa: E731
_SCORE = lambda c: f"""v{c} as (select t, sum(total * total / peak) / sum(total) volume from ob_{c} group by t), c{c} as (select t, sum({c} * y) / sum({c}) my, sum({c} * x) / sum({c}) mx from pair group by t),
  d{c} as (select t, sum(total * sqrt((cy - my) ** 2 + (cx - mx) ** 2)) / sum(total) distance from ob_{c} join c{c} using (t) group by t)"""  # noqa: E731
_SALSQL = f"with recursive {PAIR_SQL}, {', '.join(f(c) for c in 'po' for f in (_FIELD, _REACH, _SCORE))}"
_OBJ = lambda s, d, c: O.object_cells(pairs(s, d).select("t", "y", "x", F.col(c).alias("v")), factor=_FACTOR)
add("object_table", lambda s, d: O.object_table(_OBJ(s, d, "o")).drop("id"), f"{_SALSQL} select t, ROUND6(total) total, ROUND6(peak) peak, area, ROUND6(cy) cy, ROUND6(cx) cx from ob_o")
add("sal_structure", lambda s, d: O.sal_structure(*[O.object_table(_OBJ(s, d, c)) for c in "po"]), f"{_SALSQL} select t, ROUND6((vp.volume - vo.volume) / (0.5 * (vp.volume + vo.volume))) structure from vp full join vo using (t)")
add("sal", lambda s, d: O.sal(pairs(s, d), N, N, factor=_FACTOR), f"""{_SALSQL}, a as (select t, (avg(p) - avg(o)) / (0.5 * (avg(p) + avg(o))) amplitude from pair group by t)
  select t, ROUND6((vp.volume - vo.volume) / (0.5 * (vp.volume + vo.volume))) structure, ROUND6(amplitude) amplitude, ROUND6((sqrt((cp.my - co.my) ** 2 + (cp.mx - co.mx) ** 2) + 2 * abs(do_.distance - dp.distance)) / sqrt(2 * 32 * 32)) as location
  from a join vp using (t) join vo using (t) join cp using (t) join co using (t) join dp using (t) join "do" do_ using (t)""")
ORACLES = {k: v.replace("do as (", '"do" as (') for k, v in ORACLES.items()}
add("sal_split", lambda s, d: O.sal(pairs(s, d), N, N, split=True))
_LABELS = lambda s, d: obs(s, d).where("v > 30").select("t", "y", "x", (F.col("y").cast("int") / 8).cast("int").alias("by"), (F.col("x") / 8).cast("int").alias("bx")).select("t", "y", "x", (F.col("by") * 4 + F.col("bx") + 1).alias("id"))
_TRACK = f"""{OBS_SQL}, lab as (select t, y, x, cast(y // 8 * 4 + x // 8 + 1 as integer) id from obs where v > 30), {FLOW_SQL},
  adv as (select distinct t + 1 t, id, least(greatest(y + cast(round_even(avg(flow.v) over w, 0) as integer), 0), {N - 1}) y, least(greatest(x + cast(round_even(avg(u) over w, 0) as integer), 0), {N - 1}) x from lab join flow using (y, x) window w as (partition by t, id)),
  sz as (select t, id, count(*) s from adv group by 1, 2), sh as (select a.t, a.id, l.id next_id, count(*) n, count(*) / any_value(s) overlap from adv a join lab l on a.t = l.t and a.y = l.y and a.x = l.x join sz on sz.t = a.t and sz.id = a.id group by 1, 2, 3),
  r as (select *, row_number() over (partition by t, id order by overlap desc, next_id) r from sh), b as (select *, r = 1 and overlap >= 0.3 best from r),
  f as (select *, row_number() over (partition by t, next_id, best order by n desc, id) fst, max(case when best then 1 else 0 end) over (partition by t, next_id) taken from b),
  k as (select t, id, next_id, case when best and fst = 1 then 'carried' when r = 1 and taken = 1 and overlap >= 0.1 then 'merged' when r > 1 and taken = 0 and overlap > 0.1 then 'split' end kind from f)"""
add("cell_links", lambda s, d: K.links(K.overlaps(K.advect_cells(_LABELS(s, d), flow(s), N, N), _LABELS(s, d)), 0.3), f"with {_TRACK} select cast(t as integer) t, id, next_id, kind from k where kind is not null")
add("tracks", lambda s, d: K.tracks(_LABELS(s, d), flow(s), N, N, 3, match_share=0.3), f"""with recursive {_TRACK}, c as (select distinct t, id from lab), p as (select t, next_id id, t - 1 pt, id pid from k where kind = 'carried'),
  chain as (select c.t, c.id, c.t * 4294967296 + c.id track from c left join p using (t, id) where p.pt is null union all select p.t, p.id, chain.track from chain join p on p.pt = chain.t and p.pid = chain.id),
  n as (select *, count(*) over (partition by track) n from chain) select cast(track as bigint) track, t, id from n where n >= 3""")

# -- joins and groupings

_PROBE = lambda s, d: read(s, d, "nowcast_runs").select("run_id", "source", F.col("issuetime").alias("ts"))
_FRAMES = lambda s, d: read(s, d, "radar_frames").select("source", "ts", "frame_id")
add("asof_join", lambda s, d: J.asof_join(_PROBE(s, d), _FRAMES(s, d), "ts", ["frame_id"], ["source"]), "select r.run_id, r.source, r.issuetime ts, (select arg_max(frame_id, (f.ts, frame_id)) from radar_frames f where f.source is not distinct from r.source and f.ts <= r.issuetime) frame_id from nowcast_runs r")
add("asof_join_within", lambda s, d: J.asof_join(_PROBE(s, d), _FRAMES(s, d), "ts", ["frame_id"], ["source"], "3 days"), "select r.run_id, r.source, r.issuetime ts, (select arg_max(frame_id, (f.ts, frame_id)) from radar_frames f where f.source is not distinct from r.source and f.ts <= r.issuetime and f.ts >= r.issuetime - interval 3 days) frame_id from nowcast_runs r")
_SETS = [["event_type", "day"], ["event_type"], ["day"], []]
add("grouping_sets", lambda s, d: J.grouped_by_sets(read(s, d, "events").withColumn("day", F.to_date("ts")), _SETS, {"n": F.count("*"), "mean": F.avg("value")}), "with e as (select *, cast(ts as date) as day from events) select case grouping(event_type) * 2 + grouping(day) when 0 then 0 when 1 then 1 when 2 then 2 else 3 end as level, event_type, day, count(*) n, ROUND6(avg(value)) mean from e group by grouping sets ((event_type, day), (event_type), (day), ())")
_WET = lambda df, thr: df.where(F.col("v") > thr)
_WSQL = f"with {OBS_SQL}, {MODEL_SQL}, a as (select t, y, x, v from obs where v > 100), b as (select t, y, x, v from model where v > 20)"
add("cells_in_both", lambda s, d: J.in_both(_WET(obs(s, d), 100), _WET(model(s, d), 20), ["t", "y", "x"]), f"{_WSQL} select t, y, x from a intersect select t, y, x from b")
add("cells_only_first", lambda s, d: J.only_first(_WET(obs(s, d), 100), _WET(model(s, d), 20), ["t", "y", "x"]), f"{_WSQL} select t, y, x from a except select t, y, x from b")
add("cells_with_partner", lambda s, d: J.having_partner(_WET(obs(s, d), 100), _WET(model(s, d), 20), ["y", "x"]), f"{_WSQL} select t, y, x, v from a semi join b using (y, x)")
add("cells_without_partner", lambda s, d: J.having_partner(_WET(obs(s, d), 100), _WET(model(s, d), 20), ["t", "y", "x"], False), f"{_WSQL} select t, y, x, v from a anti join b using (t, y, x)")
_SPINE = lambda s: G.date_spine(s, "2024-02-28 23:40:00", 10, 3, 4)
_PATHS = "e as (select cast(range as integer) k, timestamp '2024-02-28 23:40:00' + to_minutes(cast(range * 10 as integer)) ts from range(-3, 5)), p as (select *, '/arc/' || strftime(ts, '%Y/%m%d') folder, 'R' || strftime(ts, '%y%j%H%M') || '?.tif' as name from e)"
add("archive_paths", lambda s, d: G.expected_paths(_SPINE(s), "/arc/", "%Y/%m%d", "R%y%j%H%M?", "tif"), f"with {_PATHS} select k, ts, folder, name from p")


def _found(s, d):
    made = G.expected_paths(_SPINE(s), "/arc", "%Y/%m%d", "R%y%j%H%M", "tif").where("k <> 1")
    each = F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("xx")))
    files = made.select("folder", F.regexp_replace("name", "[.]tif$", "").alias("stem"), each.alias("mark")).select(F.concat("folder", F.lit("/"), "stem", "mark", F.lit(".tif")).alias("path"))
    return G.found_files(G.expected_paths(_SPINE(s), "/arc", "%Y/%m%d", "R%y%j%H%M?", "tif"), files)


add("archive_files", _found, f"with {_PATHS} select k, ts, case when k <> 1 then folder || '/R' || strftime(ts, '%y%j%H%M') || 'a.tif' end as path from p")

# -- blending and forecast helpers

add("blending_ratios", lambda s, d: B.blending_ratios(s.range(18).select((F.col("id") / 3).cast("int").alias("level"), (F.col("id") % 3).cast("int").alias("component"), (1.1 - F.col("id") * 0.07).alias("skill"))), "with c as (select cast(range // 3 as integer) as level, cast(range % 3 as integer) component, least(greatest(1.1 - range * 0.07, 1e-5), 0.99999) c from range(18)) select level, component, ROUND6(c * c / (1 - c * c)) ratio from c")
_MENS = "mens as (select m.range as member, o.t + m.range t, o.y, o.x, o.v from model o, range(1, 6) m where o.t + m.range between 5 and 29)"
add("lien_criterion", lambda s, d: B.wet_enough(ens(s, d), lagged_ensemble(model(s, d), 5), 30.0, 2).groupBy("t", "both").agg(F.count("*").alias("n")), f"with {ENS_SQL}, {MODEL_SQL}, {_MENS}, a as (select t, y, x, count(*) filter (v >= 30) a from ens group by 1, 2, 3), b as (select t, y, x, count(*) filter (v >= 30) b from mens group by 1, 2, 3) select cast(t as integer) t, coalesce(a, 0) >= 2 and coalesce(b, 0) >= 2 as both, count(*) n from a full join b using (t, y, x) group by 1, 2")
_COMP = lambda e, f: e.select("t", "member", (F.col("y") * N + F.col("x")).alias("i"), f.alias("v"))
add("matching_share", lambda s, d: B.matching_share(_COMP(ens(s, d), F.col("v")), _COMP(ens(s, d), F.col("v") + F.col("member")), _COMP(ens(s, d), 2 * F.col("v") + F.col("y"))), f"with {ENS_SQL}, m as (select t, member, sum(v + member - v) da, sum(2 * v + y - v) dd from ens group by 1, 2) select t, ROUND6(avg(case when dd <> 0 then least(greatest(da / dd, 0), 1) else 0 end)) share from m group by t")
add("binned_leads", lambda s, d: B.binned_leads(s.range(25).select((F.col("id") * 0.37).alias("lead"))).select("bin", F.explode("leads").alias("lead")), "select cast(floor(range * 0.37) as integer) bin, ROUND6(range * 0.37) as lead from range(25)")
add("stacked_levels", lambda s, d: B.stacked_levels(obs(s, d).select(F.lit(0).alias("case"), "t", F.col("y").alias("level"), "x", "v").groupBy("case", "t", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda c: c["v"]).alias("data"))).select("level", F.posexplode("stack").alias("t", "data")).select("level", "t", F.posexplode("data").alias("x", "v")), f"with {OBS_SQL} select y as level, t, x, v from obs")
_MASKS = lambda s, d: G.to_tensor(obs(s, d).withColumn("case", F.lit(0)), ("case", "t"))
add("mask_window", lambda s, d: G.to_cells(P.mask_windows(_MASKS(s, d), 4.0, 5.0)), f"with {OBS_SQL}, d as (select o.t, o.y, o.x, min(sqrt((o.y - f.y) ** 2 + (o.x - f.x) ** 2)) d from obs o join obs f on o.t = f.t and f.v < 5 and (o.v >= 5 and abs(o.y - f.y) <= 4 and abs(o.x - f.x) <= 4 or o.y = f.y and o.x = f.x) group by 1, 2, 3) select t, y, x, ROUND6(case when coalesce(d, 4) >= 4 then 1 else 0.5 * (1 - cos(pi() * d / 4)) end) v from obs left join d using (t, y, x)")


def _bands(s, d):
    import numpy as np

    from rainweft.kernels import spectral

    w = spectral.band_weights((32, 32), 6)
    rows = [(int(k), int(i), int(j), float(w[k, i, j])) for k, i, j in np.ndindex(w.shape)]
    return s.createDataFrame(rows, "level int, ky int, kx int, w double")


add("band_weights", _bands, """with q as (select 16 ** (1 / 6.0) q), k as (select a.range ky, b.range kx, sqrt((case when a.range >= 16 then a.range - 32 else a.range end) ** 2 + b.range ** 2) r from range(32) a, range(17) b),
  w as (select l.range lv, ky, kx, case when r = 0 then case when l.range = 0 then 1.0 else 0.0 end else exp(-((ln(r) / ln(q) - ln((q ** l.range + q ** (l.range + 1)) / 2) / ln(q)) ** 2) / 0.5) end w from k, q, range(6) l)
  select cast(lv as integer) as level, cast(ky as integer) ky, cast(kx as integer) kx, ROUND6(w / sum(w) over (partition by ky, kx)) w from w""")
add("soft_mask", lambda s, d: G.to_cells(P.soft_masks(_MASKS(s, d), 100.0, 4, blur=1)), f"with {OBS_SQL}, d as (select o.t, o.y, o.x, min(sqrt((o.y - f.y) ** 2 + (o.x - f.x) ** 2)) d from obs o join obs f on o.t = f.t and f.v >= 100 and abs(o.y - f.y) <= 4 and abs(o.x - f.x) <= 4 group by 1, 2, 3) select t, y, x, ROUND6(coalesce((select count(*) from range(1, 11) k where d <= 4.0 * k.range / 10) / 10.0, 0)) v from obs left join d using (t, y, x)")
add("noise_adjustments", lambda s, d: P.noise_adjustments(tensors(s, d), -10.0, 5, 4).groupBy("level").agg(F.avg("factor").alias("factor")))
add("rainfarm_smoothed", lambda s, d: P.downscaled(_MASKS(s, d).withColumn("data", F.transform("data", lambda v: v + 1.0)), 4, alpha=2.0, kernel="gaussian", fusion=True).select("t", F.explode("data").alias("v")).groupBy("t").agg(F.avg("v").alias("mean"), F.count("*").alias("n")))
_SRC = {"projection": "+proj=merc +lon_0=0", "x1": 0.0, "y1": 0.0, "xpixelsize": 1000.0, "ypixelsize": 1000.0, "yorigin": "upper"}
_DST = {"projection": "+proj=merc +lon_0=0", "x1": -1700.0, "y1": 5200.0, "xpixelsize": 1500.0, "ypixelsize": 2500.0, "yorigin": "lower"}
add("reproject_grids", lambda s, d: G.to_cells(X.reproject_grids(G.to_tensor(obs(s, d)), _SRC, _DST, (12, 20))), f"with {OBS_SQL}, g as (select cast(a.range as integer) y, cast(b.range as integer) x, 31 - floor((5200 + (a.range + 0.5) * 2500) / 1000) sy, floor((-1700 + (b.range + 0.5) * 1500) / 1000) sx from range(12) a, range(20) b), f as (select distinct t from obs) select f.t, g.y, g.x, o.v from f cross join g left join obs o on o.t = f.t and o.y = g.sy and o.x = g.sx")


# -- further aggregates and analyses

_HOLES = lambda s, d: obs(s, d).withColumn("v", F.when(F.col("v") > 5, F.col("v")))
_HSQL = f"{OBS_SQL}, holes as (select t, y, x, case when v > 5 then v end v from obs)"
add("aggregate_fields_nanmean", lambda s, d: G.aggregate_fields(_HOLES(s, d), {"t": 3, "x": 4}, "nanmean"), f"with {_HSQL} select cast(t // 3 as integer) t, y, cast(x // 4 as integer) x, ROUND6(avg(v)) v from holes group by 1, 2, 3")
add("aggregate_fields_sum", lambda s, d: G.aggregate_fields(_HOLES(s, d), {"y": 2, "x": 2}, "sum"), f"with {_HSQL} select t, cast(y // 2 as integer) y, cast(x // 2 as integer) x, case when count(v) = 4 then ROUND6(sum(v)) end v from holes group by 1, 2, 3")
add("aggregate_fields_trimmed", lambda s, d: G.aggregate_fields(obs(s, d), {"y": 5, "x": 5}, "median", True, {"y": N, "x": N}), f"with {OBS_SQL} select t, cast(y // 5 as integer) y, cast(x // 5 as integer) x, ROUND6(median(v)) v from obs where y < 30 and x < 30 group by 1, 2, 3")
_ELL = ", ".join(f"({a}, {b})" for a, b in H.ellipse_offsets(5))
add("elliptic_opening", lambda s, d: H.elliptic_opening(obs(s, d), 1.0, 5), f"with {OBS_SQL}, k(dy, dx) as (values {_ELL}), w as (select t, y, x, v, case when v > 1 then 1 else 0 end w from obs), e as (select a.t, a.y, a.x, min(b.w) e from w a, k, w b where b.t = a.t and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3), o as (select a.t, a.y, a.x, max(b.e) o from e a, k, e b where b.t = a.t and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3) select w.t, w.y, w.x, ROUND6(case when w.w = 1 and o.o = 0 then min(w.v) over (partition by w.t) else w.v end) v from w join o using (t, y, x)")
add("outliers_nd", lambda s, d: S.global_outliers_nd(points(s, d), 2.0, ["u", "v"]).select("id", "outlier"), f"with {PTS_SQL}, g as (select avg(u) ma, avg(v) mb, var_samp(u) va, var_samp(v) vb, covar_samp(u, v) c from pts) select id, sqrt((vb * (u - ma) ** 2 - 2 * c * (u - ma) * (v - mb) + va * (v - mb) ** 2) / (va * vb - c * c)) > 2 outlier from pts, g")
add("cell_profiles", lambda s, d: K.cell_profiles(_LABELS(s, d), obs(s, d)).select("t", "id", "cen_y", "cen_x", "max_ref", "area", F.array_join("ys", " ").alias("ys"), F.array_join("xs", " ").alias("xs")), f"with {OBS_SQL}, lab as (select t, y, x, v, cast(y // 8 * 4 + x // 8 + 1 as integer) id from obs where v > 30) select t, id, cast(round_even(avg(y), 0) as integer) cen_y, cast(round_even(avg(x), 0) as integer) cen_x, ROUND6(max(v)) max_ref, count(*) area, string_agg(y, ' ' order by y, x) ys, string_agg(x, ' ' order by y, x) xs from lab group by 1, 2")
add("lag_correlation_spectral", lambda s, d: P.spectral_lags(P.rolling_stacks(plain(s, d).drop("case"), 3), (1, 2)), f'with {OBS_SQL} select a.t as "case", cast(a.t - b.t as integer) lag, ROUND6(corr(a.v, b.v)) gamma from obs a join obs b on a.y = b.y and a.x = b.x and b.t between a.t - 2 and a.t - 1 where a.t >= 2 group by 1, 2')
_FLOWS = lambda s, d: obs(s, d).select("t", "y", "x", (F.col("v") / 10 + 1).alias("u"), F.sin(F.col("t") + F.col("y")).alias("v"))
_FSQL = f"{OBS_SQL}, f as (select t, y, x, v / 10 + 1 u, sin(t + y) v from obs), e as (select b.t - a.t lag, ((b.u - a.u) * a.u + (b.v - a.v) * a.v) / sqrt(a.u ** 2 + a.v ** 2) a, ((b.v - a.v) * a.u - (b.u - a.u) * a.v) / sqrt(a.u ** 2 + a.v ** 2) b from f a join f b on a.y = b.y and a.x = b.x and b.t - a.t in (1, 3, 6))"
add("velocity_errors", lambda s, d: Y.velocity_deviations(Y.velocity_errors(_FLOWS(s, d), (1, 3, 6))), f"with {_FSQL} select cast(lag as integer) lag, ROUND6(stddev_pop(a)) par, ROUND6(stddev_pop(b)) perp from e group by 1")
add("value_classes", lambda s, d: Y.value_classes(obs(s, d), Y.CLASSES["mm/h"]).groupBy("t", "class").agg(F.count("*").alias("n")), f"with {OBS_SQL} select t, cast(len(list_filter([{', '.join(map(str, Y.CLASSES['mm/h']))}]::double[], lambda q: q <= v)) as integer) as class, count(*) n from obs group by 1, 2")
add("flow_arrows", lambda s, d: Y.arrows(flow(s), 8), f"with {FLOW_SQL} select y, x, u, v, ROUND6(sqrt(u * u + v * v)) speed, ROUND6(degrees(atan2(v, u))) direction from flow where y % 8 = 4 and x % 8 = 4")
add("even_steps", lambda s, d: Y.even_steps(read(s, d, "radar_frames").select("source", "ts").distinct(), "ts", ["source"]), "with f as (select distinct source, ts from radar_frames), g as (select source, epoch(ts) - epoch(lag(ts) over (partition by source order by ts)) g from f) select source, cast(min(g) as bigint) step, min(g) = max(g) as even from g group by source")
