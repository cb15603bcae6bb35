"""Rasters derived from the flat test tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweft.operators.ensemble import lagged_ensemble
from rainweft.operators.grid import N, STEPS, full_grid, observed

MEMBERS = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(read(spark, sf_dir, "events"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence: the frame before as forecast ``p`` of each observation ``o``."""
    o = obs(spark, sf_dir)
    p = o.select((F.col("t") + 1).alias("t"), "y", "x", F.col("v").alias("p"))
    return o.select("t", "y", "x", F.col("v").alias("o")).join(p, ["t", "y", "x"])


def ens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lagged_ensemble(obs(spark, sf_dir), MEMBERS)


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second raster, from order lines."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    c = li.groupBy((F.col("l_orderkey") % STEPS).cast("int").alias("t"), (F.col("l_suppkey") % N).cast("int").alias("y"), (F.col("l_partkey") % N).cast("int").alias("x")).agg(F.sum("l_quantity").alias("s"))
    return full_grid(spark, STEPS, N, N).join(c, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("s", F.lit(0.0)).alias("v"))


def flow(spark: SparkSession) -> DataFrame:
    g = full_grid(spark, 1, N, N)
    return g.select("y", "x", ((F.col("x") % 3 - 1) * 1.5).alias("u"), ((F.col("y") % 3 - 1) * 1.5).alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y"), (F.col("c_acctbal") / 1000).alias("u"), ((k * 7 % 100) / 10).alias("v"))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places, without negative zeros."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


GRID_SQL = f"grid as (select cast(a.range as integer) t, cast(b.range as integer) y, cast(c.range as integer) x from range({STEPS}) a, range({N}) b, range({N}) c)"
OBS_SQL = f"""{GRID_SQL},
raw as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) t, cast(user_id % {N} as integer) y, cast(event_id % {N} as integer) x, sum(value) v from events group by 1, 2, 3),
obs as (select grid.t, grid.y, grid.x, round(coalesce(raw.v, 0), 6) v from grid left join raw on grid.t = raw.t and grid.y = raw.y and grid.x = raw.x)"""
PAIR_SQL = f"""{OBS_SQL},
pair as (select a.t, a.y, a.x, b.v p, a.v o from obs a join obs b on b.t = a.t - 1 and a.y = b.y and a.x = b.x)"""
ENS_SQL = f"""{OBS_SQL},
ens as (select cast(m.range as integer) as member, cast(o.t + m.range as integer) t, o.y, o.x, o.v from obs o, range(1, {MEMBERS + 1}) m where o.t + m.range between {MEMBERS} and {STEPS - 1}),
arr as (select e.t, e.y, e.x, list_sort(list(e.v)) f, any_value(o.v) o from ens e join obs o on e.t = o.t and e.y = o.y and e.x = o.x group by 1, 2, 3)"""
MODEL_SQL = f"""mraw as (select cast(l_orderkey % {STEPS} as integer) t, cast(l_suppkey % {N} as integer) y, cast(l_partkey % {N} as integer) x, sum(l_quantity) v from lineitem group by 1, 2, 3),
model as (select grid.t, grid.y, grid.x, coalesce(mraw.v, 0) v from grid left join mraw on grid.t = mraw.t and grid.y = mraw.y and grid.x = mraw.x)"""
FLOW_SQL = f"flow as (select cast(b.range as integer) y, cast(c.range as integer) x, (c.range % 3 - 1) * 1.5 u, (b.range % 3 - 1) * 1.5 v from range({N}) b, range({N}) c)"
PTS_SQL = "pts as (select c_custkey id, cast(c_custkey % 97 as double) x, cast(c_custkey % 89 as double) y, c_acctbal / 1000 u, (c_custkey * 7 % 100) / 10.0 v from customer)"
