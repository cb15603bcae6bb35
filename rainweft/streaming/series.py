"""Frames and readings as streams: tumbling accumulations, sessions and a stateful nowcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from rainweft.workspace import shared_dir


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Files under ``path`` as a stream; a pattern, so that a single file serves as well as a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def tumbling(stream: DataFrame, time: str, value: str, keys: list[str], window: str, delay: str) -> DataFrame:
    """Sum, mean and count per window, labelled by its end; rows later than ``delay`` are left out."""
    s = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    g = s.groupBy(F.window("_at", window), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Runs of rows without a gap, the stream form of cell tracks."""
    s = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    g = s.groupBy(F.session_window("_at", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("first"), F.col("w.end").cast("timestamp_ntz").alias("last"), *keys, "n")


def persistence(stream: DataFrame, key: str, time: str, value: str, phi: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """``(key, ts, value, forecast)``: a one-step autoregressive forecast whose state is the last two values of a key."""

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a, b = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for v in rows["value"]:
            out.append(phi[0] * a + phi[1] * b)
            a, b = (float(v), a) if pd.notna(v) else (a, b)
        state.update((a, b))
        yield pd.DataFrame({"key": k[0], "ts": rows["ts"].values, "value": rows["value"].values, "forecast": out})

    s = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return s.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, value double, forecast double", "a double, b double", "append", "NoTimeout")


def contingency(stream: DataFrame, time: str, forecast: str, observed: str, keys: list[str], thr: float, delay: str, window: str = "1 day") -> DataFrame:
    """Running hits, misses, false alarms and correct rejections per window and keys, a score's state in update mode."""
    s = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    p, o = (F.coalesce(F.col(c) > thr, F.lit(False)) for c in (forecast, observed))
    g = s.groupBy(F.window("_at", window), *keys).agg(F.count_if(p & o).alias("h"), F.count_if(~p & o).alias("m"), F.count_if(p & ~o).alias("f"), F.count_if(~p & ~o).alias("r"))
    return g.select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, "h", "m", "f", "r")


def sliding(stream: DataFrame, time: str, value: str, keys: list[str], window: str, step: str, delay: str) -> DataFrame:
    """Sum, mean and count over windows that begin every ``step``, labelled by their end."""
    s = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    g = s.groupBy(F.window("_at", window, step), *keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys, "n", "total", "mean")


def recent_frames(stream: DataFrame, key: str, time: str, value: str, n: int = 3) -> DataFrame:
    """``(key, ts, stack)``: each value with the n - 1 before it of its key, oldest first; the state is those values.

    Rows of one micro-batch are put in order of time; rows that come in a later
    micro-batch with an earlier time are stacked where they come. A key's first
    n - 1 rows give none.
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "value"])
        at, stacks = [], []
        for ts, v in zip(rows["ts"], rows["value"]):
            held = [*held, float(v)][-n:]
            if len(held) == n:
                at.append(ts)
                stacks.append(held)
        state.update((held,))
        yield pd.DataFrame({"key": [k[0]] * len(at), "ts": pd.Series(at, dtype="datetime64[ns]"), "stack": stacks})

    s = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return s.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, stack array<double>", "held array<double>", "append", "NoTimeout")


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now into a table and return it; in update mode the last row per key counts."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/rainweft-stream-{uuid.uuid4().hex}"

    def sink(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/table")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("_epoch", IntegerType())])).parquet(f"{base}/table")
    if mode == "update" and keys:
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_epoch").alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])
    return out.drop("_epoch")
