"""Queries p4, p6, p7 and p8 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweft.llm import percentiles
from rainweft.llm.encoding import encode_corpus
from rainweft.llm.leakage import find_leaks
from rainweft.llm.splitting import split_documents
from rainweft.workspace import written


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of precip per institution and per institution and day (day null: all days)."""
    kin = spark.read.parquet(f"{sf_dir}/radar_sources.parquet").select("source", F.col("institution").alias("own"))
    cells = spark.read.parquet(f"{sf_dir}/precip_cells.parquet").select("reading_id", "source", "institution", "ts", "precip")
    cells = cells.join(F.broadcast(kin), "source", "left")  # radar_sources: 30 rows, fixed
    cells = cells.select("reading_id", F.coalesce("institution", "own").alias("institution"), F.to_date("ts").alias("day"), "precip")
    by_day = written(percentiles.value_counts(cells, ["institution", "day"], "precip", key="reading_id"), "counts")
    whole = written(percentiles.merge_counts(by_day, ["institution"]), "counts").select("institution", F.lit(None).cast("date").alias("day"), "v", "c", F.lit("all").alias("span"))
    daily = by_day.select("institution", "day", "v", "c", F.lit("day").alias("span"))
    found = percentiles.percentiles(daily.unionByName(whole), ["span", "institution", "day"])
    return found.select("span", "institution", "day", "n", "per_mille", F.round("value", 6).alias("value"), "rank_error")


P4_SQL = """
with once as (
  select p.reading_id, any_value(coalesce(p.institution, s.institution)) institution, cast(any_value(p.ts) as date) as day, any_value(p.precip) v
  from precip_cells p left join radar_sources s on p.source = s.source group by p.reading_id),
good as (select * from once where v is not null and not isnan(v) and not isinf(v)),
both_ as (select 'day' as span, institution, day, v from good union all select 'all', institution, cast(null as date), v from good),
ranked as (
  select *, row_number() over (partition by span, institution, day order by v) as rn, count(*) over (partition by span, institution, day) as n from both_),
wanted as (select unnest([10, 50, 250, 500, 750, 900, 950, 990, 999]) as per_mille)
select span, institution, day, n, cast(per_mille as integer) as per_mille, round(v, 6) as value, cast(0 as double) as rank_error
from ranked join wanted on rn = greatest(1, (n * per_mille + 999) // 1000)
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_documents(spark, sf_dir))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/eval_items.parquet"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(_documents(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_documents(_documents(spark, sf_dir), with_ids=False)
    return pieces.where(F.col("piece_no") == 1).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_percentiles, p6_ids, p7_found, p7_leaks, p8_found, p8_pieces)}
ORACLES: dict[str, str] = {"p4_percentiles": P4_SQL}
