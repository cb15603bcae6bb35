"""Joins and groupings that the other operators share: nearest in time, several groupings at once, set operations on cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, at: str, values: Sequence[str], keys: Sequence[str] = (), within: str | None = None) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the latest row of ``right`` at or before it, of the same keys.

    Both sides are laid out by key and day, the last row of each day is handed to
    the days after it, and so a key with a third of all rows is spread over its
    days; nothing is paired that doesn't match. Rows of ``left`` without an
    earlier partner, or with none within the interval ``within``, keep nulls; of
    several partners at one time the greatest values count; null keys match each
    other, rows of ``right`` without a time match nothing.
    """
    names = [f"_{v}" for v in values]
    k = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))]
    packed = F.struct(F.col(at), *[F.col(v).alias(n) for v, n in zip(values, names)])
    r = right.where(F.col(at).isNotNull()).select(*k, F.col(at).alias("_at"), packed.alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    l = left.select(*k, F.col(at).alias("_at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))  # noqa: E741
    both = r.unionAll(l).withColumn("_day", F.to_date("_at"))
    w = Window.partitionBy(*on, "_day").orderBy("_at", F.col("_l").isNotNull(), "_r")
    near = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = both.groupBy(*on, "_day").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_at", "_r"))).alias("_last"))
    upto = Window.partitionBy(*on).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # a row per key and day
    spans = spans.select(*[F.col(c).alias(f"s{c}") for c in on], F.col("_day").alias("s_day"), F.last(F.col("_last")["_r"], True).over(upto).alias("_before"))
    match = F.col("_day").eqNullSafe(F.col("s_day"))
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"s{c}"))
    found = both.withColumn("_near", near).where("_l is not null").join(spans, match).withColumn("_take", F.coalesce("_near", "_before"))
    if within:
        found = found.withColumn("_take", F.when(F.col("_take")[at] >= F.col("_at") - F.expr(f"interval {within}"), F.col("_take")))
    return found.select("_l.*", *[F.col("_take")[n].alias(v) for v, n in zip(values, names)])


def grouped_by_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: dict) -> DataFrame:
    """Aggregates over several groupings in one pass: a row's columns outside its grouping are null; ``level`` numbers the grouping."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    number = F.lit(None).cast("int")
    marks = F.grouping_id(*every)
    for i, s in enumerate(sets):
        mark = sum(0 if c in s else 1 << (len(every) - 1 - k) for k, c in enumerate(every))
        number = F.coalesce(number, F.when(marks == mark, F.lit(i)))
    return out.agg(number.alias("level"), *[c.alias(k) for k, c in aggregates.items()]).select("level", *every, *aggregates)


def in_both(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that both sides have."""
    return first.select(*keys).intersect(second.select(*keys))


def only_first(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of the first side that the second lacks."""
    return first.select(*keys).exceptAll(second.select(*keys).distinct()).distinct()


def having_partner(first: DataFrame, second: DataFrame, keys: Sequence[str], partner: bool = True) -> DataFrame:
    """Rows of the first side with (or without) a row of equal keys on the second; columns stay in their order."""
    return first.join(second.select(*keys).distinct(), list(keys), "left_semi" if partner else "left_anti").select(*first.columns)
