"""Wrappers, settings, registry, analyses and the entry's own parts."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path
from types import SimpleNamespace
from zipimport import zipimporter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rainweft import config, registry, workspace, wrappers
from rainweft.errors import DataModelError
from rainweft.kernels import nowcast
from rainweft.operators import analysis, grid, joins, neighbourhood, scattered


def test_checked_frames():
    f = wrappers.checked_frames(2, 3)(lambda frames: len(frames))
    assert f(np.zeros((2, 4, 4))) == 2
    for wrong in (np.zeros((4, 4)), np.zeros((1, 4, 4)), np.zeros((4, 4, 4))):
        with pytest.raises(ValueError):
            f(wrong)
    with pytest.raises(ValueError, match="frames are needed"):
        nowcast.sprog(np.zeros((2, 8, 8)), np.zeros((2, 8, 8)), [1], 0.1)
    with pytest.raises(ValueError, match="belong together"):
        nowcast.anvil(np.zeros((4, 8, 8)), np.zeros((2, 8, 9)), [1], 0.1)


def test_cached_results():
    calls = []
    f = wrappers.cached(2)(lambda x: calls.append(x) or x * 2)
    assert [f(1, key="a"), f(5, key="a"), f(2, key="b"), f(3, key="c"), f(4), f(9, key="a")] == [2, 2, 4, 6, 8, 18] and calls == [1, 2, 3, 4, 9]


def test_renamed_and_documented():
    f = wrappers.renamed_arguments({"old": "new"}, "2.0")(lambda new=0: new)
    with pytest.warns(FutureWarning):
        assert f(old=3) == 3
    with pytest.raises(TypeError):
        f(old=1, new=2)
    assert "more" in wrappers.documented(lambda: None, "more").__doc__


def test_point_interpolator():
    f = wrappers.point_interpolator(lambda p, v, x, y: np.zeros((v.shape[1], len(y), len(x))) + 7)
    x, y = np.arange(3), np.arange(2)
    assert f(np.zeros((0, 2)), np.zeros((0, 1)), x, y).shape == (1, 2, 3)
    assert (f([[0, 0]], [5.0], x, y) == 5).all() and (f([[0, 0], [1, 1]], [5.0, 5.0], x, y) == 5).all() and (f([[0, 0], [1, 1]], [[5.0], [6.0]], x, y) == 7).all()
    for p, v in (([[0, 0]], [np.nan]), ([[0, 0, 1]], [1.0]), ([[0, 0]], [1.0, 2.0])):
        with pytest.raises(ValueError):
            f(p, v, x, y)


def test_settings_by_name(tmp_path):
    s = config.Settings()
    s["outputs"] = {"a": 1}
    assert s["outputs"] == {"a": 1} and s["silent_import"] is False
    with pytest.raises(KeyError):
        s["nothing"] = 1
    (tmp_path / "rc").write_text('{"outputs": 3}')
    with pytest.raises(DataModelError, match="wrong type"):
        config.load(tmp_path / "rc")


def test_registry_kinds():
    for kind, name in (("noise", "nested"), ("tracking", "TDATING"), ("extrapolation", "semilagrangian"), ("deterministic", "sal"), ("exporter", "netcdf"), ("filter", "uniform"), ("utils", "reprojection")):
        assert callable(registry.get_method(name, kind))


def test_growth_of_velocity_errors():
    t = np.array([5.0, 10, 15, 20, 30, 45, 60])
    a, b, c = analysis.fitted_growth(t, 10.88 * t**0.23 - 7.68)
    assert np.allclose(a * t**b + c, 10.88 * t**0.23 - 7.68, atol=1e-3) and b == pytest.approx(0.23, abs=0.02)


def test_analysis_edges(spark):
    flow = spark.createDataFrame([(0, 0, 0, 0.0, 0.0), (1, 0, 0, 1.0, 1.0), (2, 0, 0, 2.0, 1.0)], "t int, y int, x int, u double, v double")
    got = analysis.velocity_errors(flow, (1,)).first()
    assert got.n == 1 and got.s_par == pytest.approx(1 / 2**0.5) and got.s_perp == pytest.approx(-1 / 2**0.5)
    cells = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, 0.0), (0, 0, 2, 1.0), (0, 0, 3, 500.0)], "t int, y int, x int, v double")
    assert [r["class"] for r in analysis.value_classes(cells, analysis.CLASSES["mm/h"]).orderBy("x").collect()] == [None, 0, 6, 17]
    times = spark.createDataFrame([("a", 0), ("a", 5), ("a", 10), ("b", 0), ("b", 5), ("b", 11), ("c", 3)], "k string, m int").withColumn("ts", F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01").cast("timestamp_ntz")))
    assert {r.k: (r.step, r.even) for r in analysis.even_steps(times, "ts", ["k"]).collect()} == {"a": (300, True), "b": (300, False), "c": (None, None)}
    lines = analysis.track_lines(spark.createDataFrame([(7, 0, 1), (7, 1, 2)], "track long, t int, id int"), spark.createDataFrame([(1, 2, 5, 6), (0, 1, 3, 4)], "t int, id int, cen_x int, cen_y int")).first()
    assert [tuple(p) for p in lines.line] == [(0, 3, 4), (1, 5, 6)]


def test_aggregated_fields(spark):
    cells = spark.createDataFrame([(0, 0, x, float(x) if x != 2 else None) for x in range(7)], "t int, y int, x int, v double")
    row = lambda how, **k: [r.v for r in grid.aggregate_fields(cells, {"x": 2}, how, **k).orderBy("x").collect()]
    assert row("mean") == [0.5, None, 4.5, 6.0] and row("nansum") == [1.0, 3.0, 9.0, 6.0] and row("max", trim=True, sizes={"x": 7}) == [1.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        row("mean", sizes={"x": 7})
    with pytest.raises(ValueError):
        row("mode")


def test_elliptic_opening(spark):
    assert neighbourhood.ellipse_offsets(3) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)] and len(neighbourhood.ellipse_offsets(5)) == 17
    v = [[0, 0, 0, 0, 0, 0], [0, 5, 0, 0, 5, 0], [0, 0, 0, 5, 5, 5], [0, 0, 0, 0, 5, 0]]
    cells = spark.createDataFrame([(0, y, x, float(a)) for y, row in enumerate(v) for x, a in enumerate(row)], "t int, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in neighbourhood.elliptic_opening(cells, 1.0, 3).collect()}
    assert got[1, 1] == 0.0 and all(got[p] == 5.0 for p in ((1, 4), (2, 3), (2, 4), (2, 5), (3, 4))) and len(got) == 24


def test_outliers_of_many_values(spark):
    rng = np.random.RandomState(1)
    a = rng.standard_normal((300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    a[0] = (9, -9, 9)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(a)], "id int, u double, v double, w double")
    d = np.einsum("ni,ij,nj->n", a - a.mean(0), np.linalg.inv(np.cov(a.T)), a - a.mean(0)) ** 0.5
    got = {r.id: r.outlier for r in scattered.global_outliers_nd(df, 3.0, ["u", "v", "w"]).collect()}
    assert got == {k: bool(x > 3) for k, x in enumerate(d)} and got[0]
    same = df.withColumn("w", F.col("u"))
    assert not any(r.outlier for r in scattered.global_outliers_nd(same, 3.0, ["u", "v", "w"]).collect())


def test_grouping_sets_of_empty_and_null(spark):
    df = spark.createDataFrame([("a", 1, 2.0), (None, 1, 4.0)], "g string, h int, v double")
    got = sorted((r.level, r.g or "", r.h or 0, r.s) for r in joins.grouped_by_sets(df, [["g", "h"], ["h"], []], {"s": F.sum("v")}).collect())
    assert got == [(0, "", 1, 4.0), (0, "a", 1, 2.0), (1, "", 1, 6.0), (2, "", 0, 6.0)]


def test_intermediate_tables_can_be_deleted(spark):
    before = set(workspace._live)
    t = workspace.written(spark.range(3), "gone")
    assert t.count() == 3 and len(workspace._live) == len(before) + 1
    workspace.dropped(t)
    assert workspace._live == before
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(t.inputFiles()[0]).count()


def test_entry_keeps_to_local_sessions(spark):
    entry.ship(spark)  # nothing to send
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_archive_stays_for_executors():
    sent = []
    context = SimpleNamespace(master="spark://host:7077", applicationId="app-archive", addPyFile=sent.append)
    for _ in range(2):
        entry.ship(SimpleNamespace(sparkContext=context))
    assert len(sent) == 1  # once per application, and the file is still there when an executor asks for it
    assert zipimporter(sent[0]).find_spec("rainweft") and zipimporter(f"{sent[0]}/rainweft").find_spec("workspace")


def test_entry_loaded_again_ships_nothing_twice():
    sent = []

    def load():
        spec = spec_from_file_location("entry_again", entry.__file__)
        found = module_from_spec(spec)
        spec.loader.exec_module(found)
        return found

    contexts = [SimpleNamespace(master="spark://host:7077", applicationId=f"app-{i}", addPyFile=sent.append) for i in range(2)]
    for context in contexts:
        for _ in range(3):
            load().ship(SimpleNamespace(sparkContext=context))
    assert len(sent) == 2 and len({Path(p).name for p in sent}) == 2  # one for each application, and Spark refuses one name from two folders


def test_partners_keep_the_order_of_columns(spark):
    a, b = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "t int, y int, x int"), spark.createDataFrame([(2, 3)], "y int, x int")
    for partner, row in ((True, (1, 2, 3)), (False, (4, 5, 6))):
        got = joins.having_partner(a, b, ["x", "y"], partner)
        assert got.columns == ["t", "y", "x"] and [tuple(r) for r in got.collect()] == [row]
