"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return c


def rows(df):
    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, str):
            return v
        return round(float(v), 6) + 0.0 if hasattr(v, "__float__") else str(v)[:19].removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES)[:: int(os.environ.get("QUERY_STEP", "1"))])
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and u == pytest.approx(v, rel=1e-9, abs=1.5e-6)) for u, v in zip(x, y)), (x, y)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
