"""Percentiles by multi-select against sorting: exactness, error bounds, partial results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rainweft.llm")
from rainweft.llm import percentiles


def brute_percentiles(rows):
    groups = {}
    for g, v in rows:
        if v is not None and math.isfinite(v):
            groups.setdefault(g, []).append(v)
    return {(g, k): sorted(vs)[max(1, (len(vs) * k + 999) // 1000) - 1] for g, vs in groups.items() for k in percentiles.PER_MILLE}


@pytest.mark.parametrize("few", [40, 512])
def test_percentiles_exact(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.random() * 10, 0.0, -0.0, 1.5, None, float("nan"), float("inf")])) for _ in range(800)]
    df = spark.createDataFrame([(i, g, v, 1) for i, (g, v) in enumerate(rows)], "id bigint, g string, p double, c int").repartition(6)
    got = percentiles.percentiles(percentiles.value_counts(df, ["g"], "p"), ["g"], few=few).collect()
    assert {(r.g, r.per_mille): r.value for r in got} == brute_percentiles(rows)
    assert all(r.rank_error == 0 for r in got)


def test_percentiles_bounded_error_and_merge(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)] + [(5, "a", values[5])], "id bigint, g string, p double")
    parts = [percentiles.value_counts(df.where(F.col("id") % 3 == k), ["g"], "p", key="id") for k in range(3)]
    merged = percentiles.merge_counts(parts[0].union(parts[1]).union(parts[2]), ["g"])
    exact = {r.per_mille: r.value for r in percentiles.percentiles(merged, ["g"], few=400).collect()}
    assert exact == {k: v for (_, k), v in brute_percentiles([("a", v) for v in values]).items()}
    rough = percentiles.percentiles(merged, ["g"], few=16, rank_error=0.02).collect()
    order = sorted(values)
    for r in rough:
        low = np.searchsorted(order, r.value, "left") + 1
        assert r.n == 4000 and abs(low - max(1, (4000 * r.per_mille + 999) // 1000)) <= 0.02 * 4000 + 1 and r.rank_error <= 0.02


def test_percentiles_empty(spark):
    df = spark.createDataFrame([], "id bigint, g string, p double")
    assert percentiles.percentiles(percentiles.value_counts(df, ["g"], "p"), ["g"]).count() == 0


def test_error_bound_with_uneven_weights(spark):
    cells = [("a", float(k), 1000 if k < 20 else 1) for k in range(2000)]
    counts = spark.createDataFrame(cells, "g string, v double, c bigint").repartition(3)
    n = sum(c for *_, c in cells)
    upto = np.cumsum([c for *_, c in cells])
    for few in (8, 512):
        for r in percentiles.percentiles(counts, ["g"], few=few, rank_error=0.01).collect():
            want = max(1, math.ceil(n * r.per_mille / 1000))
            at = int(r.value)
            first, last = (upto[at - 1] if at else 0) + 1, upto[at]
            assert max(0, first - want, want - last) <= 0.01 * n and r.rank_error <= 0.01


def test_percentiles_of_skewed_and_wide_values(spark):
    rng = random.Random(9)
    rows = [("hot", rng.lognormvariate(0, 30)) for _ in range(6000)] + [("hot", 1.0)] * 3000 + [(f"g{k % 40}", rng.random()) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, p double").repartition(5)
    got = percentiles.percentiles(percentiles.value_counts(df, ["g"], "p"), ["g"], few=16).collect()
    assert {(r.g, r.per_mille): r.value for r in got} == brute_percentiles(rows)


def test_summaries_of_days_add_up(spark):
    rng = random.Random(4)
    rows = [(day, "a" if k % 3 else None, rng.gauss(day, 2)) for day in range(4) for k in range(1500 * (1 + day))]
    df = spark.createDataFrame(rows, "day int, g string, p double").repartition(5)
    daily = percentiles.summaries(percentiles.value_counts(df, ["day", "g"], "p"), ["day", "g"], parts=200)
    assert daily.groupBy("day", "g").count().agg(F.max("count")).first()[0] <= 200
    assert daily.agg(F.sum("c")).first()[0] == len(rows)
    for r in percentiles.percentiles(percentiles.merge_counts(daily, ["g"]), ["g"]).collect():
        mine = sorted(v for _, g, v in rows if g == r.g)
        assert r.n == len(mine)
        want = max(1, math.ceil(len(mine) * r.per_mille / 1000))
        assert abs(np.searchsorted(mine, r.value, "left") + 1 - want) <= len(mine) / 200 + 1


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 9.0, 9, "x")] * 5 + [(2, "a", 2.0, 9.0, 9, "x")], "id int, g string, p double, v double, c int, gid string")
    got = percentiles.percentiles(percentiles.value_counts(df, ["g"], "p", key="id"), ["g"]).collect()
    assert all(r.n == 2 and r.value == 2.0 for r in got) and len(got) == len(percentiles.PER_MILLE)
