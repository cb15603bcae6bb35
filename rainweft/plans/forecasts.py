"""Queries over forecast kernels, sources and streams, with SQL where a result has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rainweft import registry
from rainweft.operators import forecast as P
from rainweft.operators import grid as G
from rainweft.operators.ensemble import lagged_ensemble
from rainweft.plans.common import OBS_SQL, ens, model, obs, read, rounded
from rainweft.plans.scores import _round6
from rainweft.streaming import series as Z

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLES[name] = _round6(sql)


def tensors(s, d):
    """Three cases of ten frames each, in dB."""
    from rainweft.functions.transforms import db_transform

    o = obs(s, d).select((F.col("t") / 10).cast("int").alias("case"), (F.col("t") % 10).alias("t"), "y", "x", db_transform(F.col("v"), 0.1, -15.0).alias("v"))
    return G.to_tensor(o, ("case", "t"))


def plain(s, d):
    return G.to_tensor(obs(s, d).withColumn("case", F.lit(0)), ("case", "t"))


def stacks(s, d, n: int = 3):
    """A stack for every frame that has ``n - 1`` before it; case is the frame's t."""
    return P.rolling_stacks(_daily(obs(s, d)), n)


def _daily(cells):
    from rainweft.functions.transforms import db_transform

    return G.to_tensor(cells.withColumn("v", db_transform(F.col("v"), 0.1, -15.0)))


def flows(s, d, method: str = "lucaskanade"):
    return P.motion_fields(stacks(s, d, 9 if method == "darts" else 3), method)


def summary(f):
    """Per case, member and lead: mean, spread and wet share of a forecast."""
    c = f.select("case", "member", "lead", F.explode("data").alias("v"))
    return c.groupBy("case", "member", "lead").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), F.avg(F.when(F.col("v") > -10, 1.0).otherwise(0.0)).alias("wet"), F.count("v").alias("present"))


add("tensor_round_trip", lambda s, d: G.to_cells(G.to_tensor(obs(s, d))), f"with {OBS_SQL} select t, y, x, v from obs")
_DB = f"{OBS_SQL}, db as (select t, y, x, case when v < 0.1 then -15 else 10 * log10(v) end v from obs)"
# the shift of largest correlation, refined by a parabola along either axis
_SHIFT = f"""with {_DB}, k as (select range as n from range(-12, 13)),
  every as (select b.t as t, p.n dy, q.n dx, corr(a.v, b.v) c from db a join k p on true join k q on true join db b on b.t = a.t + 1 and b.y = a.y + p.n and b.x = a.x + q.n group by 1, 2, 3),
  c as (select * from every where c is not null and not isnan(c)),
  m as (select * from (select *, row_number() over (partition by t order by c desc, dy, dx) r from c) where r = 1),
  n as (select m.t, m.dy, m.dx, m.c, (select c from c where c.t = m.t and c.dy = m.dy - 1 and c.dx = m.dx) y0, (select c from c where c.t = m.t and c.dy = m.dy + 1 and c.dx = m.dx) y1,
    (select c from c where c.t = m.t and c.dy = m.dy and c.dx = m.dx - 1) x0, (select c from c where c.t = m.t and c.dy = m.dy and c.dx = m.dx + 1) x1 from m)
  select t as "case", ROUND6(dx + case when x0 + x1 - 2 * c < 0 then 0.5 * (x0 - x1) / (x0 + x1 - 2 * c) else 0 end) u, ROUND6(dy + case when y0 + y1 - 2 * c < 0 then 0.5 * (y0 - y1) / (y0 + y1 - 2 * c) else 0 end) v, 1024 n from n where t >= 2"""
for _m in ("constant", "lucaskanade", "darts", "proesmans", "vet", "farneback"):
    add(f"motion_{_m}", lambda s, d, m=_m: flows(s, d, m).select("case", F.explode(F.arrays_zip("u", "v")).alias("f")).groupBy("case").agg(F.avg("f.u").alias("u"), F.avg("f.v").alias("v"), F.count("*").alias("n")), _SHIFT if _m == "constant" else None)
_LAST = f'with {_DB}, l as (select t, avg(v) m, stddev_pop(v) sd, avg(case when v > -10 then 1.0 else 0.0 end) wet, count(v) n from db group by t) select t as "case", 0 as member, cast(k.range as double) as lead, ROUND6(m) mean, ROUND6(sd) spread, ROUND6(wet) wet, n present from l, range(1, 4) k where t >= 2'
for _m in ("extrapolation", "eulerian", "sprog", "anvil", "linda"):
    add(f"nowcast_{_m}", lambda s, d, m=_m: summary(P.nowcasts(stacks(s, d), flows(s, d), [1, 2, 3], m)), _LAST if _m == "eulerian" else None)
add("nowcast_steps", lambda s, d: summary(P.nowcasts(stacks(s, d), flows(s, d), [1, 2, 3], "steps", members=4)))
add("nowcast_sseps", lambda s, d: summary(P.nowcasts(stacks(s, d), flows(s, d), [1, 2, 3], "sseps", members=4, window=16)))
_ZERO = lambda s, d: P.motion_fields(P.frame_stacks(plain(s, d), 3), "none")


def _shift(s, d):
    f = _ZERO(s, d).select("case", "ny", "nx", F.transform("u", lambda _: F.lit(2.0)).alias("u"), F.transform("v", lambda _: F.lit(-1.0)).alias("v"))
    got = P.nowcasts(P.frame_stacks(plain(s, d), 1), f, [1, 2], "extrapolation")
    return G.to_cells(got, ("lead",))


add("semilagrangian_shift", _shift, f"with {OBS_SQL} select cast(l.range as double) as lead, g.y, g.x, o.v from range(1, 3) l, (select distinct y, x from grid) g left join obs o on o.t = 29 and o.y = g.y + l.range and o.x = g.x - 2 * l.range")


def _still(s, d):
    got = P.nowcasts(P.frame_stacks(plain(s, d), 1), _ZERO(s, d), [1, 2, 3], "eulerian")
    return G.to_cells(got, ("lead",)).withColumn("lead", F.col("lead").cast("int"))


add("eulerian_persistence", _still, f"with {OBS_SQL} select cast(l.range as integer) as lead, y, x, v from obs, range(1, 4) l where t = 29")


def _half(s, d):
    """Half a cell to the left and a quarter down: every value is a mean of four."""
    f = _ZERO(s, d).select("case", "ny", "nx", F.transform("u", lambda _: F.lit(-0.5)).alias("u"), F.transform("v", lambda _: F.lit(0.25)).alias("v"))
    return G.to_cells(P.nowcasts(P.frame_stacks(plain(s, d), 1), f, [1], "extrapolation"), ("lead",))


add("semilagrangian_fraction", _half, f"with {OBS_SQL}, f as (select * from obs where t = 29) select cast(1 as double) as lead, g.y, g.x, ROUND6(case when g.y > 0 and g.x < 31 then 0.25 * (0.5 * a.v + 0.5 * b.v) + 0.75 * (0.5 * c.v + 0.5 * e.v) end) v from (select distinct y, x from grid) g left join f a on a.y = g.y - 1 and a.x = g.x left join f b on b.y = g.y - 1 and b.x = g.x + 1 left join f c on c.y = g.y and c.x = g.x left join f e on e.y = g.y and e.x = g.x + 1")


def _spread(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("case"), F.lit(0).alias("t"), F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.col("embedding").cast("array<double>").alias("data"))
    return P.decomposed(e, 3).select("case", "level", F.round("mu", 5).alias("mu"), F.round("sigma", 5).alias("sigma"))


add("cascade_levels", _spread, """with c as (select vec_id, (i - 1) // 8 y, (i - 1) % 8 x, embedding[i]::double v from embeddings, (select range i from range(1, 65))),
  k as (select a.range - 4 ky, b.range - 4 kx, sqrt((a.range - 4) ** 2 + (b.range - 4) ** 2) r from range(8) a, range(8) b),
  p as (select vec_id, ky, kx, any_value(r) r, sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) re, sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) im from c, k group by 1, 2, 3),
  q as (select 4 ** (1 / 3.0) q), w as (select ky, kx, l.range lv, exp(-((ln(r) / ln(q) - ln((q ** l.range + q ** (l.range + 1)) / 2) / ln(q)) ** 2) / 0.5) w from k, q, range(3) l where r > 0),
  n as (select ky, kx, lv, w / sum(w) over (partition by ky, kx) w from w)
  select vec_id as "case", cast(l.range as integer) as level, round(sum(case when r = 0 and l.range = 0 then re / 64 else 0 end), 5) + 0.0 mu, round(sqrt(sum(case when r > 0 then n.w ** 2 * (re ** 2 + im ** 2) else 0 end)) / 64, 5) + 0.0 sigma
  from p cross join range(3) l left join n on n.ky = p.ky and n.kx = p.kx and n.lv = l.range group by 1, 2""")


def _cascade(s, d):
    lev = P.decomposed(plain(s, d), 5)
    e = lev.select("t", "level", "nx", "mu", "sigma", F.posexplode("data").alias("pos", "v"))
    e = e.select("t", (F.col("pos") / F.col("nx")).cast("int").alias("y"), (F.col("pos") % F.col("nx")).cast("int").alias("x"), (F.col("v") * F.col("sigma") + F.col("mu")).alias("w"))
    return e.groupBy("t", "y", "x").agg(F.round(F.sum("w"), 4).alias("v"))


add("cascade_recomposed", _cascade, f"with {OBS_SQL} select t, y, x, round(v, 4) + 0.0 v from obs")


def _spectrum(s, d):
    e = read(s, d, "embeddings").select(F.col("vec_id").alias("case"), F.lit(0).alias("t"), F.lit(8).alias("ny"), F.lit(8).alias("nx"), F.col("embedding").cast("array<double>").alias("data"))
    return P.radial_spectra(e).select("case", "k", F.round("power", 5).alias("power"))


add(
    "radial_spectrum", _spectrum,
    """with c as (select vec_id, (i - 1) // 8 y, (i - 1) % 8 x, embedding[i]::double v from embeddings, (select range i from range(1, 65))),
    k as (select a.range - 4 ky, b.range - 4 kx from range(8) a, range(8) b),
    p as (select vec_id, ky, kx, (sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) ** 2 + sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) ** 2) / 64 p from c, k group by 1, 2, 3)
    select vec_id as case, cast(round_even(sqrt(ky * ky + kx * kx), 0) as integer) k, round(avg(p), 5) + 0.0 as power from p where round_even(sqrt(ky * ky + kx * kx), 0) < 4 group by 1, 2""".replace("as case,", 'as "case",'),
)


def _fine(s, d):
    f = P.downscaled(plain(s, d).withColumn("data", F.transform("data", lambda v: v + 1.0)), 4, alpha=2.0)
    return G.aggregate_space(G.to_cells(f), 4, 4).select("t", "y", "x", F.round("v", 4).alias("v"))


add("rainfarm_block_means", _fine, f"with {OBS_SQL} select t, y, x, round(v + 1, 4) + 0.0 v from obs")
add("features_shitomasi", lambda s, d: P.point_features(tensors(s, d), "shitomasi"))
add("features_blob", lambda s, d: P.point_features(tensors(s, d), "blob"))
add("features_tstorm", lambda s, d: P.storm_cells(tensors(s, d), least=10.0, most=48.0, rise=3.0, min_size=4, min_peak=15.0, distance=3.0).select("case", "t", "id", "cen_x", "cen_y", "max_ref", "area"))


def _nwp_stack(s, d):
    return P.rolling_stacks(_daily(model(s, d)), 3)


add("blending_steps", lambda s, d: summary(P.blended_steps(stacks(s, d), flows(s, d), _nwp_stack(s, d), [1, 2, 3], -10.0, (0.95, 0.9, 0.7, 0.5, 0.3, 0.1), members=3)))


def _runs(s, d, steps: int = 4, models: int = 2):
    """Model fields of the case's own frame and the ones after it, of two models a frame apart."""
    daily = _daily(model(s, d))
    out = None
    for m in range(models):
        for k in range(steps):
            part = daily.select((F.col("t") - k - m).alias("case"), F.lit(m).alias("model"), F.lit(k).alias("step"), "data")
            out = part if out is None else out.unionAll(part)
    return out.where("case >= 2 and case < 26")


def _cases(df):
    return df.where("case >= 2 and case < 26")


add("blending_steps_full", lambda s, d: summary(P.blended_forecast(_cases(stacks(s, d)), flows(s, d), _runs(s, d), [1, 2, 2.5], -10.0, members=3)))
add("blending_steps_spn", lambda s, d: summary(P.blended_forecast(_cases(stacks(s, d)), flows(s, d), _runs(s, d), [1, 2, 3], -10.0, members=2, blend_all=True, options={"weights_method": "spn"}, full_model_from=2)))
add("model_skills", lambda s, d: P.model_skills(_cases(stacks(s, d)), None, _runs(s, d).where("step = 0").drop("step"), -10.0).groupBy("model", "level").agg(F.avg("skill").alias("skill")))
add("enkf_forecast", lambda s, d: summary(P.kalman_forecast(_cases(stacks(s, d)), flows(s, d), _runs(s, d).where("step > 0"), [1, 2, 3], -10.0, members=4)))


def _enkf(s, d):
    a = G.to_tensor(ens(s, d).withColumnRenamed("t", "case"), ("case", "member"))
    b = G.to_tensor(lagged_ensemble(model(s, d), 5).withColumnRenamed("t", "case"), ("case", "member"))
    return P.kalman_corrected(a, b, 5.0).select("case", "member", F.explode("data").alias("v")).groupBy("case", "member").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


add("blending_pca_enkf", _enkf)
add("registry", lambda s, d: registry.to_df(s))


def _stream(s, d):
    path = f"{d}/events.parquet"
    raw = Z.read_stream(s, path, s.read.parquet(path).schema)
    return Z.drained(Z.tumbling(raw, "ts", "value", ["event_type"], "1 hour", "1 day"), "update", ["window_end", "event_type"])


add("stream_tumbling", _stream, "select time_bucket(interval 1 hour, ts) + interval 1 hour window_end, event_type, count(value) n, ROUND6(sum(value)) total, ROUND6(avg(value)) mean from events group by 1, 2")


def _stateful(s, d):
    path = f"{d}/events.parquet"
    raw = Z.read_stream(s, path, s.read.parquet(path).schema)
    return Z.drained(Z.persistence(raw, "event_type", "ts", "value")).groupBy("key").agg(F.count("*").alias("n"), F.sum("forecast").alias("total"))


add("stream_nowcast", _stateful, "with l as (select event_type as key, lag(value, 1, 0) over w a, lag(value, 2, 0) over w b from events window w as (partition by event_type order by ts)) select key, count(*) n, ROUND6(sum(0.8 * a + 0.1 * b)) total from l group by key")


def _events(s, d):
    path = f"{d}/events.parquet"
    return Z.read_stream(s, path, s.read.parquet(path).schema)


add("stream_contingency", lambda s, d: Z.drained(Z.contingency(_events(s, d).withColumn("f", F.col("user_id") % 500), "ts", "f", "value", ["event_type"], 100.0, "1 day"), "update", ["window_end", "event_type"]), "with e as (select *, user_id % 500 f from events) select cast(cast(ts as date) + 1 as timestamp) window_end, event_type, count(*) filter (f > 100 and value > 100) h, count(*) filter (not f > 100 and value > 100) m, count(*) filter (f > 100 and not value > 100) f, count(*) filter (not f > 100 and not value > 100) r from e group by 1, 2")
add("stream_sliding", lambda s, d: Z.drained(Z.sliding(_events(s, d), "ts", "value", ["event_type"], "2 hours", "1 hour", "1 day"), "update", ["window_end", "event_type"]), "with w as (select *, time_bucket(interval 1 hour, ts) + to_hours(cast(k.range as integer)) window_end from events, range(1, 3) k) select window_end, event_type, count(value) n, ROUND6(sum(value)) total, ROUND6(avg(value)) mean from w group by 1, 2")
add("stream_sessions", lambda s, d: Z.drained(Z.sessions(_events(s, d), "ts", ["event_type"], "30 minutes", "1 day").withColumnRenamed("last", "until"), "append").groupBy("event_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("n")), "with g as (select event_type, ts, ts - lag(ts) over w gap, max(ts) over () - interval 1 day as mark from events window w as (partition by event_type order by ts)), i as (select *, sum(case when gap is null or gap >= interval 30 minutes then 1 else 0 end) over (partition by event_type order by ts) s from g), e as (select event_type, s, count(*) n, max(ts) + interval 30 minutes until, any_value(mark) mark from i group by 1, 2) select event_type, count(*) sessions, cast(sum(n) as bigint) n from e where until <= mark group by 1")
add("stream_recent_frames", lambda s, d: Z.drained(Z.recent_frames(_events(s, d), "event_type", "ts", "value", 3)).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.element_at("stack", 1) + 2 * F.element_at("stack", 3)).alias("total")), "with l as (select event_type as key, value, lag(value, 2) over (partition by event_type order by ts) a from events) select key, count(*) n, ROUND6(sum(a + 2 * value)) total from l where a is not null group by key")
