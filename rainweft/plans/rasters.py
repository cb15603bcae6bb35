"""Queries over projection, grid, neighbourhood, rank, point, series, blending and tracking operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rainweft.functions import transforms as T
from rainweft.operators import blending as B
from rainweft.operators import grid as G
from rainweft.operators import neighbourhood as H
from rainweft.operators import ranks as R
from rainweft.operators import scattered as S
from rainweft.operators import series as A
from rainweft.operators import tracking as K
from rainweft.operators.ensemble import lagged_ensemble
from rainweft.plans.common import ENS_SQL, FLOW_SQL, MODEL_SQL, OBS_SQL, PAIR_SQL, PTS_SQL, N, ens, flow, model, obs, pairs, points, read, rounded
from rainweft.plans.scores import _round6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLES[name] = _round6(sql)


def cells(expressions):
    """A query that gives expressions of v per cell; columns are made when it runs."""

    def build(s, d):
        return obs(s, d).select("t", "y", "x", *[c.alias(k) for k, c in expressions(F.col("v")).items()])

    return build


# -- units and transforms
add("to_rainrate", cells(lambda v: dict(v=T.to_rainrate(v, "mm", None, 5.0), z=T.to_rainrate(v / 10, "dBZ", "dB"), r=T.to_rainrate(v / 100, "mm/h", "log"))), f"with {OBS_SQL} select t, y, x, ROUND6(v * 12) v, ROUND6((10 ** (v / 100) / 200) ** (1 / 1.6)) z, ROUND6(exp(v / 100)) r from obs")
add("to_raindepth", cells(lambda v: dict(v=T.to_raindepth(v, "mm/h", None, 10.0), z=T.to_raindepth(v / 10, "dBZ", "dB", 10.0))), f"with {OBS_SQL} select t, y, x, ROUND6(v / 6) v, ROUND6((10 ** (v / 100) / 200) ** (1 / 1.6) / 6) z from obs")
add("to_reflectivity", cells(lambda v: dict(v=T.to_reflectivity(v, "mm/h"))), f"with {OBS_SQL} select t, y, x, case when v <= 0 then -15 else ROUND6(10 * log10(200 * v ** 1.6)) end v from obs")
add("db_transform", cells(lambda v: dict(v=T.db_transform(v, 0.1, -15.0), back=T.db_inverse(T.db_transform(v, 0.1, -15.0), -10.0))), f"with {OBS_SQL} select t, y, x, case when v < 0.1 then -15 else ROUND6(10 * log10(v)) end v, case when v < 0.1 then 0 else ROUND6(10 ** (10 * log10(v) / 10)) end back from obs")
add("boxcox_transform", cells(lambda v: dict(v=T.boxcox_transform(v, 0.1), power=T.boxcox_transform(v, 0.1, 0.5))), f"with {OBS_SQL} select t, y, x, case when v < 0.1 then ROUND6(ln(0.1) - 1) else ROUND6(ln(v)) end v, case when v < 0.1 then ROUND6((sqrt(0.1) - 1) / 0.5 - 1) else ROUND6((v ** 0.5 - 1) / 0.5) end as power from obs")
add("boxcox_inverse", cells(lambda v: dict(v=T.boxcox_inverse(v / 100, 0.5), power=T.boxcox_inverse(v / 100, 0.5, 0.5))), f"with {OBS_SQL} select t, y, x, case when exp(v / 100) < exp(0.5) then 0 else ROUND6(exp(v / 100)) end v, case when (0.5 * v / 100 + 1) ** 2 < 1.25 ** 2 then 0 else ROUND6((0.5 * v / 100 + 1) ** 2) end as power from obs")
add("sqrt_transform", cells(lambda v: dict(v=T.sqrt_transform(v), back=T.sqrt_inverse(T.sqrt_transform(v)))), f"with {OBS_SQL} select t, y, x, ROUND6(sqrt(v)) v, ROUND6(sqrt(v) * sqrt(v)) back from obs")
add("import_cells", lambda s, d: G.import_cells(read(s, d, "precip_cells").select("reading_id", F.col("precip").alias("v")).distinct()), "select distinct reading_id, ROUND6(case when isfinite(precip) then precip end) v from (select reading_id, precip from precip_cells)")

# -- grids
add("aggregate_time", lambda s, d: G.aggregate_time(obs(s, d), 5), f"with {OBS_SQL} select cast(t // 5 * 5 + 4 as integer) t, y, x, ROUND6(avg(v)) v from obs group by 1, 2, 3")
add("aggregate_time_sum", lambda s, d: G.aggregate_time(obs(s, d), 6, "sum"), f"with {OBS_SQL} select cast(t // 6 * 6 + 5 as integer) t, y, x, ROUND6(sum(v)) v from obs group by 1, 2, 3")
add("aggregate_space", lambda s, d: G.aggregate_space(obs(s, d), 4, 4), f"with {OBS_SQL} select t, cast(y // 4 as integer) y, cast(x // 4 as integer) x, ROUND6(avg(v)) v from obs group by 1, 2, 3")
_GEO = {"x1": 0.0, "y1": 0.0, "x2": N * 1000.0, "y2": N * 1000.0, "xpixelsize": 1000.0, "ypixelsize": 1000.0, "yorigin": "upper"}
add("clip_domain", lambda s, d: G.clip_domain(obs(s, d), _GEO, (4000.0, 20000.0, 8000.0, 36000.0), 0.0), f"with {OBS_SQL}, out_ as (select cast(a.range as integer) t, cast(b.range as integer) y, cast(c.range as integer) x from range(30) a, range(28) b, range(16) c) select o.t, o.y, o.x, ROUND6(coalesce(i.v, 0)) v from out_ o left join obs i on i.t = o.t and i.y = o.y - 4 and i.x = o.x + 4")
_OBLONG = lambda s, d: G.aggregate_space(obs(s, d), 1, 2, "sum")
_OSQL = f"{OBS_SQL}, oblong as (select t, y, cast(x // 2 as integer) x, sum(v) v from obs group by 1, 2, 3)"
add("square_domain_pad", lambda s, d: G.square_domain(_OBLONG(s, d), N, N // 2), f"with {_OSQL} select g.t, g.y, g.x, ROUND6(coalesce(o.v, 0)) v from grid g left join oblong o on g.t = o.t and g.y = o.y and g.x = o.x + 8")
add("square_domain_crop", lambda s, d: G.square_domain(_OBLONG(s, d), N, N // 2, "crop"), f"with {_OSQL} select t, cast(y - 8 as integer) y, x, ROUND6(v) v from oblong where y between 8 and 23")
add("square_domain_inverse", lambda s, d: G.unsquare_domain(G.square_domain(_OBLONG(s, d), N, N // 2), N, N // 2), f"with {_OSQL} select t, y, x, ROUND6(v) v from oblong")
add("centred_coordinates", lambda s, d: G.centred_coordinates(s, N, N - 1), f"select cast(a.range as integer) y, cast(b.range as integer) x, cast(a.range - {N // 2} as integer) cy, cast(b.range - {(N - 1) // 2} as integer) cx from range({N}) a, range({N - 1}) b")
add("check_norain", lambda s, d: G.no_rain(obs(s, d), 40.0, 0.2), f"with {OBS_SQL} select t, ROUND6(avg(case when v > 40 then 1.0 else 0.0 end)) wet, avg(case when v > 40 then 1.0 else 0.0 end) <= 0.2 as norain from obs group by t")
add("after_last_dry", lambda s, d: G.after_last_dry(obs(s, d), 40.0, 0.115).groupBy("t").agg(F.count("*").alias("n")), f"with {OBS_SQL}, dry as (select max(t) l from (select t from obs group by t having avg(case when v > 40 then 1.0 else 0.0 end) <= 0.115)) select t, count(*) n from obs, dry where l is null or t > l group by t")
add("lowest_wet_value", lambda s, d: G.lowest_wet_value(obs(s, d)), f"with {OBS_SQL}, m as (select t, min(v) m from obs group by t) select t, ROUND6(coalesce(min(case when v > m then v end), min(m))) threshold from obs join m using (t) group by t")
add("close_rain_gap", lambda s, d: G.close_rain_gap(obs(s, d)), f"with {OBS_SQL}, m as (select t, min(v) m from obs group by t), k as (select t, min(v) thr, min(m) m from obs join m using (t) where v > m group by t) select t, y, x, ROUND6(case when v > m then v - (thr - m) else v end - m) v from obs join k using (t)")
add("find_by_date", lambda s, d: G.date_spine(s, "2024-01-10 12:00:00", 15, 4, 2), "select cast(range as integer) k, timestamp '2024-01-10 12:00:00' + to_minutes(cast(range * 15 as integer)) ts from range(-4, 3)")
add("read_timeseries", lambda s, d: G.read_series(G.date_spine(s, "2021-03-05 00:00:00", 60, 3, 200), read(s, d, "radar_frames").groupBy("ts").agg(F.min("frame_id").alias("data"), F.min("meta.threshold").alias("threshold"))), "with f as (select ts, min(frame_id) as data, min(meta.threshold) thr from radar_frames group by ts), s as (select cast(range as integer) k, timestamp '2021-03-05' + to_minutes(cast(range * 60 as integer)) ts from range(-3, 201)) select k, s.ts, data, ROUND6((select min(thr) from s join f on s.ts = f.ts)) threshold from s left join f on s.ts = f.ts")

# -- neighbourhoods
_BOX = lambda f, c, size, src: f"(select t, y, x, w0, least, {f}({c}) over (partition by t, x order by y range between {size // 2} preceding and {size - 1 - size // 2} following) {c} from (select t, y, x, w0, least, {f}({c}) over (partition by t, y order by x range between {size // 2} preceding and {size - 1 - size // 2} following) {c} from {src}))"
add("morphological_opening", lambda s, d: H.opening(obs(s, d), 5.0, 3), f"with {OBS_SQL}, mk as (select t, y, x, v, case when v > 5 then 1 else 0 end w0, case when v > 5 then 1 else 0 end w, min(v) over (partition by t) least from obs), op as (select * from {_BOX('max', 'w', 3, _BOX('min', 'w', 3, 'mk'))}) select obs.t, obs.y, obs.x, ROUND6(case when op.w0 = 1 and op.w = 0 then op.least else obs.v end) v from obs join op using (t, y, x)")
_GAUSS = H.gaussian_offsets(1.0, 2.0)
_GSQL = ", ".join(f"({a}, {b}, {w!r}::double)" for a, b, w in _GAUSS)
add("gaussian_mean", lambda s, d: H.weighted_mean(obs(s, d).withColumn("v", F.when(F.col("v") > 5, F.col("v"))), _GAUSS), f"with {OBS_SQL}, o as (select t, y, x, case when v > 5 then v end v from obs), k(dy, dx, w) as (values {_GSQL}), s as (select t, y + dy y, x + dx x, sum(v * w) wv, sum(w) w from o, k where v is not null group by 1, 2, 3) select o.t, o.y, o.x, ROUND6(wv / w) v from o left join s on o.t = s.t and o.y = s.y and o.x = s.x")
_D = H.disc_offsets(3.0)
_DSQL = ", ".join(f"({a}, {b})" for a, b in _D)
add("lagrangian_probability", lambda s, d: H.lagrangian_probability(obs(s, d), 40.0, 6), f"with {OBS_SQL}, o as (select t, y, x, case when v >= 40 then 1.0 else 0.0 end e from obs), k(dy, dx) as (values {_DSQL}) select a.t, a.y, a.x, ROUND6(avg(b.e)) pr from o a, k, o b where a.t = b.t and b.y = a.y + dy and b.x = a.x + dx group by 1, 2, 3")
add("dilated_mask", lambda s, d: H.dilated_mask(obs(s, d), 250.0, 3), f"with {OBS_SQL}, k as (select a.range dy, b.range dx, (4 - abs(a.range) - abs(b.range)) / 4.0 m from range(-3, 4) a, range(-3, 4) b where abs(a.range) + abs(b.range) <= 3), s as (select t, y + dy y, x + dx x, max(m) m from obs, k where v >= 250 group by 1, 2, 3) select obs.t, obs.y, obs.x, ROUND6(coalesce(s.m, 0)) m from obs left join s on obs.t = s.t and obs.y = s.y and obs.x = s.x")
_W = lambda c, a, b: f"sum({c}) over (partition by t, {b} order by {a} range between 3 preceding and 3 following) {c}"
_CC = ("n", "p", "o", "pp", "oo", "po")
add("moving_correlation", lambda s, d: H.moving_correlation(pairs(s, d), 7), f"with {PAIR_SQL}, a as (select t, y, x, 1.0 n, p, o, p * p pp, o * o oo, p * o po from pair), b as (select t, y, x, {', '.join(_W(c, 'x', 'y') for c in _CC)} from a), c as (select t, y, x, {', '.join(_W(c, 'y', 'x') for c in _CC)} from b) select t, y, x, case when sqrt(greatest(pp/n - (p/n)**2, 0)) > 1e-8 and sqrt(greatest(oo/n - (o/n)**2, 0)) > 1e-8 then ROUND6((po/n - p*o/(n*n)) / (sqrt(pp/n - (p/n)**2) * sqrt(oo/n - (o/n)**2))) end corr from c")
_RAD = lambda: F.sqrt(F.pow(F.col("y") - (N - 1) / 2, F.lit(2.0)) + F.pow(F.col("x") - (N - 1) / 2, F.lit(2.0))) / N
add("taper_windows", lambda s, d: G.full_grid(s, 1, N, N).select("y", "x", T.hann(_RAD()).alias("hann"), T.tukey(_RAD()).alias("tukey")), f"with g as (select cast(a.range as integer) y, cast(b.range as integer) x, sqrt((a.range - 15.5) ** 2 + (b.range - 15.5) ** 2) / {N} r from range({N}) a, range({N}) b) select y, x, case when r > 0.5 then 0 else ROUND6(0.5 * (1 - cos(2 * pi() * (r + 0.5)))) end hann, case when r < 0.4 then 1 when r > 0.5 then 0 else ROUND6(0.5 * (1 + cos(pi() * (r / 0.1 - 4)))) end tukey from g")

# -- ranks
add("match_cdf", lambda s, d: R.match_cdf(obs(s, d), model(s, d)), f"with {OBS_SQL}, {MODEL_SQL}, a as (select *, min(v) over (partition by t) least, row_number() over (partition by t order by v, y, x) r from obs), b as (select t, v tv, min(v) over (partition by t) tl, row_number() over (partition by t order by v, y, x) r from model) select t, y, x, ROUND6(case when v <= least then tl else tv end) v from a join b using (t, r)")
add("percentile_mask", lambda s, d: R.percentile_mask(obs(s, d), 0.15), f"with {OBS_SQL} select t, y, x, case when rank() over (partition by t order by v desc) <= floor(count(*) over (partition by t) * 0.15) then 1 else 0 end mask from obs")
_EDGES = [0.0, 1.0, 5.0, 20.0, 80.0, 200.0, 1000.0]
_ES = "[" + ", ".join(f"{e}::double" for e in _EDGES) + "]"
add("empirical_cdf", lambda s, d: R.empirical_cdf(obs(s, d), _EDGES), f"with {OBS_SQL}, e as (select {_ES} e), h as (select least(len(list_filter(e, lambda q: q <= v)), 6) b, count(*) h from obs, e where v between 0 and 1000 group by 1), k as (select range b from range(1, 7)), c as (select k.b, coalesce(h, 0) * (e[k.b + 1] - e[k.b]) area from k left join h on h.b = k.b, e) select e[b + 1] as edge, ROUND6(sum(area) over (order by b) / sum(area) over ()) cdf from c, e union all select 0, 0")
add("probability_match", cells(lambda v: dict(v=R.probability_match(v, [0, 10, 100], [0, 0.7, 1], [0, 1, 3], [0, 0.5, 1]))), f"with {OBS_SQL}, q as (select t, y, x, case when v <= 0 then 0 when v < 10 then v * 0.07 when v < 100 then 0.7 + (v - 10) * (0.3 / 90) else 1 end p from obs) select t, y, x, ROUND6(case when p <= 0 then 0 when p < 0.5 then p * 2 when p < 1 then 1 + (p - 0.5) * 4 else 3 end) v from q")
_SAL = f"{PAIR_SQL}, d as (select *, round(p / max(p) over (partition by t) - o / max(o) over (partition by t), 12) d from pair), s as (select *, dense_rank() over (partition by t order by d) r from d), sal as (select t, y, x, p, o, r / max(r) over (partition by t) s from s)"
add("ranked_salience", lambda s, d: R.ranked_salience(pairs(s, d)), f"with {_SAL} select t, y, x, ROUND6(p) p, ROUND6(o) o, ROUND6(s) salience from sal")
add("salient_blending", lambda s, d: B.salient_blend(pairs(s, d), 0.37), f"with {_SAL} select t, y, x, ROUND6(s * 0.1369 / (s * 0.1369 + (1 - s) * 0.3969) * p + (1 - s * 0.1369 / (s * 0.1369 + (1 - s) * 0.3969)) * o) v from sal")
add("resample_distributions", lambda s, d: R.resample(obs(s, d), model(s, d), 1.0).select("t", "rank", "v"), f"with {OBS_SQL} select t, row_number() over (partition by t order by v desc, y, x) as rank, v from obs")
# A rational approximation of the normal quantile, good to nine digits.
_TAIL, _MID = "sqrt(-2 * ln(least(q, 1 - q)))", "(q - 0.5)"
_QUANTILE = f"""case when least(q, 1 - q) < 0.02425 then (case when q < 0.5 then 1 else -1 end)
    * (((((-7.784894002430293e-03 * {_TAIL} - 3.223964580411365e-01) * {_TAIL} - 2.400758277161838) * {_TAIL} - 2.549732539343734) * {_TAIL} + 4.374664141464968) * {_TAIL} + 2.938163982698783)
    / ((((7.784695709041462e-03 * {_TAIL} + 3.224671290700398e-01) * {_TAIL} + 2.445134137142996) * {_TAIL} + 3.754408661907416) * {_TAIL} + 1)
  else (((((-3.969683028665376e+01 * {_MID} ** 2 + 2.209460984245205e+02) * {_MID} ** 2 - 2.759285104469687e+02) * {_MID} ** 2 + 1.383577518672690e+02) * {_MID} ** 2 - 3.066479806614716e+01) * {_MID} ** 2 + 2.506628277459239) * {_MID}
    / (((((-5.447609879822406e+01 * {_MID} ** 2 + 1.615858368580409e+02) * {_MID} ** 2 - 1.556989798598866e+02) * {_MID} ** 2 + 6.680131188771972e+01) * {_MID} ** 2 - 1.328068155288572e+01) * {_MID} ** 2 + 1) end"""
add("resample_mixed", lambda s, d: R.resample(obs(s, d), model(s, d), 0.6, draw=F.pmod(F.col("rank") * 7919 + F.col("t") * 104729, F.lit(1000)) / 1000.0), f"with {OBS_SQL}, {MODEL_SQL}, a as (select t, row_number() over (partition by t order by v desc, y, x) r, v a from obs), b as (select t, row_number() over (partition by t order by v desc, y, x) r, v b from model), j as (select t, r, case when (r * 7919 + t * 104729) % 1000 / 1000.0 < 0.6 then a else b end v from a join b using (t, r)) select t, cast(row_number() over (partition by t order by v desc, r) as integer) as rank, v from j")
add("normal_quantile", lambda s, d: R.normal_scores(obs(s, d)).select("t", "y", "x", F.round("v", 5).alias("v")), f"with {OBS_SQL}, r as (select *, row_number() over (partition by t, v <> 0 order by v, y, x) / (count(*) over (partition by t, v <> 0) + 1.0) q from obs) select t, y, x, round(case when v = 0 then v else {_QUANTILE} end, 5) + 0.0 v from r")

# -- points
add("decluster", lambda s, d: S.decluster(points(s, d), 10.0, 2), f"with {PTS_SQL} select cast(floor(x / 10) as bigint) bx_, cast(floor(y / 10) as bigint) by_, ROUND6(median(x)) x, ROUND6(median(y)) y, ROUND6(median(u)) u, ROUND6(median(v)) v from pts group by 1, 2 having count(*) >= 2")
add("outliers_global", lambda s, d: S.global_outliers(points(s, d), 1.5, "u").select("id", "outlier"), f"with {PTS_SQL} select id, abs(u - avg(u) over ()) / stddev_pop(u) over () > 1.5 outlier from pts")
add("outliers_mahalanobis", lambda s, d: S.global_outliers_2d(points(s, d), 2.0).select("id", "outlier"), f"with {PTS_SQL}, g as (select avg(u) ma, avg(v) mb, var_samp(u) va, var_samp(v) vb, covar_samp(u, v) c from pts) select id, sqrt((vb * (u - ma) ** 2 - 2 * c * (u - ma) * (v - mb) + va * (v - mb) ** 2) / (va * vb - c * c)) > 2 outlier from pts, g")
add("outliers_local", lambda s, d: S.local_outliers(points(s, d), 2.0, 8, 10.0).select("id", "outlier"), f"with {PTS_SQL}, n as (select a.id, b.u w, row_number() over (partition by a.id order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) r from pts a join pts b on a.id <> b.id), s as (select id, avg(w) m, stddev_pop(w) s from n where r <= 8 group by id) select pts.id, coalesce(s > 0 and abs(u - m) / s > 2, false) outlier from pts left join s on s.id = pts.id")
add("idw_interpolation", lambda s, d: S.idw(points(s, d), G.full_grid(s, 1, N, N), "u", 20, 0.5, 0.5, 20.0), f"with {PTS_SQL}, g as (select cast(a.range as integer) y, cast(b.range as integer) x from range({N}) a, range({N}) b), n as (select g.y, g.x, u, sqrt((g.x - pts.x) ** 2 + (g.y - pts.y) ** 2) d, row_number() over (partition by g.y, g.x order by sqrt((g.x - pts.x) ** 2 + (g.y - pts.y) ** 2), id) r from g cross join pts), s as (select y, x, sum(u / (d + 0.5) ** 0.5) / sum(1 / (d + 0.5) ** 0.5) v from n where r <= 20 group by 1, 2) select g.y, g.x, ROUND6(v) v from g left join s on g.y = s.y and g.x = s.x")
add("nearest_cell", lambda s, d: S.idw(points(s, d), G.full_grid(s, 1, N, N), "u", 1, 0.5, 0.5, 4.0), f"with {PTS_SQL}, g as (select cast(a.range as integer) y, cast(b.range as integer) x from range({N}) a, range({N}) b), n as (select g.y, g.x, u, row_number() over (partition by g.y, g.x order by sqrt((g.x - pts.x) ** 2 + (g.y - pts.y) ** 2), id) r from g cross join pts) select g.y, g.x, ROUND6(u) v from g left join n on g.y = n.y and g.x = n.x and r = 1")

add("idw_far", lambda s, d: S.idw(points(s, d).where("x > 60 and y > 60"), G.full_grid(s, 1, N, N), "u", 5, 0.5, 0.5, 8.0), f"with {PTS_SQL}, g as (select cast(a.range as integer) y, cast(b.range as integer) x from range({N}) a, range({N}) b), n as (select g.y, g.x, u, sqrt((g.x - pts.x) ** 2 + (g.y - pts.y) ** 2) d, row_number() over (partition by g.y, g.x order by sqrt((g.x - pts.x) ** 2 + (g.y - pts.y) ** 2), id) r from g cross join pts where pts.x > 60 and pts.y > 60), s as (select y, x, sum(u / (d + 0.5) ** 0.5) / sum(1 / (d + 0.5) ** 0.5) v from n where r <= 5 group by 1, 2) select g.y, g.x, ROUND6(v) v from g left join s on g.y = s.y and g.x = s.x")
add("rbf_interpolation", lambda s, d: S.rbf_nearest(S.decluster(points(s, d), 8.0).select((F.col("bx_") * 1000 + F.col("by_")).alias("id"), "x", "y", "u"), G.full_grid(s, 1, N, N), "u", 20, 10.0, 0.0, 20.0).select(F.count("*").alias("n"), F.count("v").alias("there")), f"select {N * N} n, {N * N} there")

# -- series
add("lag_correlation", lambda s, d: A.lag_correlations(obs(s, d), (1, 2)), f"with {OBS_SQL} select cast(29 - b.t as integer) lag, ROUND6(corr(a.v, b.v)) gamma from obs a join obs b on a.y = b.y and a.x = b.x where a.t = 29 and b.t in (27, 28) group by 1")
add("lag_correlation_differenced", lambda s, d: A.lag_correlations(obs(s, d), (1, 2), differenced=True), f"with {OBS_SQL}, d as (select t, y, x, v - lag(v) over (partition by y, x order by t) v from obs) select cast(29 - b.t as integer) lag, ROUND6(corr(a.v, b.v)) gamma from d a join d b on a.y = b.y and a.x = b.x where a.t = 29 and b.t in (27, 28) group by 1")
add("ar_parameters", lambda s, d: A.lag_correlations(obs(s, d), (1, 2)).groupBy().pivot("lag", [1, 2]).agg(F.first("gamma")).select(*[c.alias(k) for k, c in zip(("phi1", "phi2", "phi0"), T.ar2_parameters(F.col("1"), T.adjusted_lag2(F.col("1"), F.col("2"))))]), f"with {OBS_SQL}, c as (select corr(a.v, b.v) g1, corr(a.v, c.v) g from obs a join obs b using (y, x) join obs c using (y, x) where a.t = 29 and b.t = 28 and c.t = 27), j as (select g1, greatest(g, 2 * g1 * g - 1, (3 * g1 * g1 - 2 + 2 * (1 - g1 * g1) ** 1.5) / (g1 * g1)) g2 from c) select ROUND6(g1 * (1 - g2) / (1 - g1 * g1)) phi1, ROUND6((g2 - g1 * g1) / (1 - g1 * g1)) phi2, ROUND6(sqrt(1 - g1 * (g1 * (1 - g2) / (1 - g1 * g1)) - g2 * ((g2 - g1 * g1) / (1 - g1 * g1)))) phi0 from j")
add("ar_ols_sums", lambda s, d: A.ols_sums(obs(s, d), 2), f"with {OBS_SQL}, l as (select v x0, lag(v) over w x1, lag(v, 2) over w x2 from obs window w as (partition by y, x order by t)) select count(*) n, " + ", ".join(f"ROUND6(sum(x{i} * x{j})) s{i}{j}" for i in range(3) for j in range(i, 3)) + " from l where x2 is not null")
add("iterate_ar", lambda s, d: A.iterate_ar(obs(s, d), (0.6, 0.2, 0.5)), f"with {OBS_SQL} select 30 t, y, x, ROUND6(sum(case t when 29 then 0.6 * v when 28 then 0.2 * v else 0 end)) v from obs group by y, x")
_VAR = lambda s, d: obs(s, d).withColumn("var", F.lit(0)).unionByName(model(s, d).withColumn("var", F.lit(1)))
_VSQL = f"{OBS_SQL}, {MODEL_SQL}, vars as (select 0 var, * from obs union all select 1, * from model)"
add("lag_correlation_multivariate", lambda s, d: A.cross_correlations(_VAR(s, d), (0, 1)), f"with {_VSQL} select cast(29 - b.t as integer) lag, a.var i, b.var j, ROUND6(corr(a.v, b.v)) gamma from vars a join vars b on a.y = b.y and a.x = b.x where a.t = 29 and b.t >= 28 group by 1, 2, 3")


def _var(s, d):
    import numpy as np

    return A.iterate_var(_VAR(s, d), [np.array([[0.5, 0.1], [0.2, 0.3]])])


add("iterate_var", _var, f"with {_VSQL}, c(i, var, c) as (values (0, 0, 0.5), (0, 1, 0.1), (1, 0, 0.2), (1, 1, 0.3)) select c.i var, y, x, ROUND6(sum(v * c)) v from vars join c using (var) where t = 29 group by 1, 2, 3")

# -- blending
_NWP = lambda s, d: obs(s, d).withColumnRenamed("v", "p").join(model(s, d).withColumnRenamed("v", "o"), ["t", "y", "x"]).withColumn("p", F.when(F.col("p") > 0, F.col("p")))
add("linear_blending", lambda s, d: B.linear_blend(_NWP(s, d).withColumn("lead", F.col("t") * 5.0), 30.0, 90.0).drop("lead"), f"with {OBS_SQL}, {MODEL_SQL}, w as (select o.t, o.y, o.x, case when o.v > 0 then o.v end p, m.v m, least(greatest((o.t * 5 - 30) / 60.0, 0), 1) w from obs o join model m using (t, y, x)) select t, y, x, ROUND6((1 - w) * coalesce(p, m) + w * m) v from w")
add("default_skill", lambda s, d: B.default_skill(s, 8, 2), "select cast(m.range as integer) model, cast(l.range as integer) as level, [0.99, 0.95, 0.848, 0.65, 0.37, 0.19, 0.09, 0.04][l.range + 1]::double skill from range(2) m, range(8) l")
_SK = lambda s, d: read(s, d, "events").select(F.col("ts").alias("valid"), (F.col("user_id") % 2).alias("model"), (F.col("event_id") % 6).alias("level"), (F.col("value") / 500).alias("skill"))
_DAILY = "d as (select cast(ts as date) as day, user_id % 2 model, event_id % 6 as level, avg(value / 500) skill from events group by 1, 2, 3)"
add("daily_skill", lambda s, d: B.daily_skill(_SK(s, d)), f"with {_DAILY} select day, model, level, ROUND6(skill) skill from d")
add("climatological_skill", lambda s, d: B.climatological_skill(B.daily_skill(_SK(s, d)), 20), f"with {_DAILY}, r as (select *, row_number() over (partition by model, level order by day desc) r from d) select model, level, ROUND6(exp(avg(ln(greatest(skill, 1e-4))))) skill from r where r <= 20 group by 1, 2")
add("spatial_correlation", lambda s, d: B.spatial_correlation(pairs(s, d).withColumn("level", F.col("t") % 6)), f"with {PAIR_SQL} select t % 6 as level, ROUND6(coalesce(corr(p, o), 1e-4)) skill from pair group by 1")
add("model_skill_at_lead", lambda s, d: s.range(48).select((F.col("id") % 6).cast("int").alias("level"), (F.col("id") / 6).cast("int").alias("k")).select("level", "k", B.model_skill_at(F.col("k") * 15.0, F.lit(0.8), F.lit(0.3), F.col("level")).alias("skill")), "with g as (select cast(range % 6 as integer) as level, cast(range // 6 as integer) k from range(48)), q as (select *, exp(-k * 15.0 / [130.0, 165.0, 120.0, 55.0, 50.0, 15.0][level + 1]) * (2 - exp(-k * 15.0 / [155.0, 220.0, 200.0, 75.0, 100000.0, 100000.0][level + 1])) q from g) select level, k, ROUND6(q * 0.8 + (1 - q) * 0.3) skill from q")
_COMP = lambda s: s.range(18).select((F.col("id") / 3).cast("int").alias("level"), (F.col("id") % 3).cast("int").alias("component"), (0.9 - F.col("id") * 0.04).alias("skill"))
_CSQL = "c as (select cast(range // 3 as integer) as level, cast(range % 3 as integer) component, 0.9 - range * 0.04 skill from range(18))"
add("bps_weights", lambda s, d: B.bps_weights(_COMP(s)), f"with {_CSQL}, r as (select *, skill * sqrt((skill ** 2 / (1 - skill ** 2)) / sum(skill ** 2 / (1 - skill ** 2)) over (partition by level)) w from c) select level, component, ROUND6(w) weight from r union all select level, -1, ROUND6(sqrt(1 - sum(w * w))) from r group by level")
add("end_weights", lambda s, d: _COMP(s).select("level", "component", B.end_weight(F.col("skill"), F.col("component") == 1, F.col("level"), 2, 5).alias("weight")), f"with {_CSQL}, f as (select *, least(greatest((level - 2) / 3.0, 0), 1) f from c) select level, component, ROUND6(skill * (1 - f) + case when component = 1 then f else 0 end) weight from f")
add("blended_moments", lambda s, d: B.blended_moments(_COMP(s).select("level", "component", (F.col("component") + 1.0).alias("mu"), (F.col("level") + 0.5).alias("sigma"), F.col("skill").alias("weight"))), f"with {_CSQL} select level, ROUND6(sum((component + 1) * skill) / sum(skill)) mu, ROUND6(sum((level + 0.5) * skill) / sum(skill)) sigma from c group by level")
add("blend_flows", lambda s, d: B.blend_fields(flow(s).withColumn("src", F.lit(0)).unionByName(flow(s).select("y", "x", (F.col("u") * F.col("y")).alias("u"), (F.col("v") + 1).alias("v"), F.lit(1).alias("src"))), s.range(2).select(F.col("id").cast("int").alias("src"), (0.3 + 0.4 * F.col("id")).alias("weight")), ["y", "x"], ["u", "v"]), f"with {FLOW_SQL} select y, x, ROUND6((0.3 * u + 0.7 * u * y) / 1.0) u, ROUND6((0.3 * v + 0.7 * (v + 1)) / 1.0) v from flow")
add("recompose", lambda s, d: B.recompose(obs(s, d).select(F.col("t").alias("level"), "y", "x", "v", (F.col("t") + 1.0).alias("mu"), (F.col("t") / 2.0).alias("sigma"))), f"with {OBS_SQL} select y, x, ROUND6(sum(v * t / 2.0 + t + 1)) v from obs group by 1, 2")
add("wet_in_both", lambda s, d: B.wet_in_both(ens(s, d), lagged_ensemble(model(s, d), 5), 60.0, 2).groupBy("t").agg(F.count("*").alias("n")), f"with {ENS_SQL}, {MODEL_SQL}, mens as (select m.range as member, o.t + m.range t, o.y, o.x, o.v from model o, range(1, 6) m where o.t + m.range between 5 and 29), a as (select t, y, x from ens where v >= 60 group by 1, 2, 3 having count(*) >= 2), b as (select t, y, x from mens where v >= 60 group by 1, 2, 3 having count(*) >= 2) select t, count(*) n from a join b using (t, y, x) group by t")
add("filter_covariance", lambda s, d: B.filter_covariance(ens(s, d).select(((F.col("t") * N + F.col("y")) * 10 + F.col("member")).alias("member"), F.col("x").alias("i"), (F.col("v") / 100).alias("v")), 1.0371, 0.01), f"with {ENS_SQL}, e as (select (t * 32 + y) * 10 + member as member, x i, v / 100 v from ens) select a.i, b.i j, ROUND6(covar_samp(a.v, b.v) * 1.0371 + case when a.i = b.i then 0.01 else 0 end) cov from e a join e b using (member) group by 1, 2")

# -- tracking
_LAB = lambda s, d: obs(s, d).where("v > 30").select("t", "y", "x", (F.col("y").cast("int") / 8).cast("int").alias("by"), (F.col("x") / 8).cast("int").alias("bx")).select("t", "y", "x", (F.col("by") * 4 + F.col("bx") + 1).alias("id"))
_LSQL = f"{OBS_SQL}, lab as (select t, y, x, cast(y // 8 * 4 + x // 8 + 1 as integer) id from obs where v > 30), {FLOW_SQL}"
add("cell_table", lambda s, d: K.cell_table(_LAB(s, d), obs(s, d)), f"with {_LSQL} select t, id, cast(round_even(avg(y), 0) as integer) cen_y, cast(round_even(avg(x), 0) as integer) cen_x, ROUND6(max(v)) max_ref, count(*) area from lab join obs using (t, y, x) group by 1, 2")
_ADV = f"{_LSQL}, adv as (select cast(t + 1 as integer) t, id, least(greatest(y + cast(round_even(avg(flow.v) over w, 0) as integer), 0), {N - 1}) y, least(greatest(x + cast(round_even(avg(u) over w, 0) as integer), 0), {N - 1}) x from lab join flow using (y, x) window w as (partition by t, id))"
add("advect_cells", lambda s, d: K.advect_cells(_LAB(s, d), flow(s), N, N), f"with {_ADV} select t, id, y, x from adv")
_OV = f"{_ADV}, a as (select distinct t, id, y, x from adv), o as (select a.t, a.id, lab.id next_id, count(*) n from a join lab on a.t = lab.t and a.y = lab.y and a.x = lab.x group by 1, 2, 3), sz as (select t, id, count(*) s from a group by 1, 2), ov as (select o.t, o.id, next_id, n / s overlap from o join sz using (t, id))"
add("match_cells", lambda s, d: K.match_cells(K.advect_cells(_LAB(s, d), flow(s), N, N), _LAB(s, d), 0.1), f"with {_OV}, r as (select *, row_number() over (partition by t, id order by overlap desc, next_id) r from ov) select t, id, next_id, ROUND6(overlap) overlap from r where r = 1 and overlap >= 0.1")
add("split_cells", lambda s, d: K.splits(K.advect_cells(_LAB(s, d), flow(s), N, N), _LAB(s, d), 0.02), f"with {_OV}, k as (select *, count(*) over (partition by t, id) k from ov where overlap > 0.02) select t, id, next_id from k where k > 1")
add("couple_tracks", lambda s, d: K.couple_tracks(_LAB(s, d).select(F.col("id").alias("track"), "t").distinct(), 3), f"with {_LSQL}, c as (select distinct id track, t from lab) select track, count(*) n, min(t) as first, max(t) as last from c group by track having count(*) >= 3")
