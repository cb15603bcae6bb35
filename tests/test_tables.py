"""The operators over readings, headers and units: edge cases and brute force."""

import json
import math
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweft.errors import DataModelError
from rainweft.operators import anomalies, regular_grid, schema_drift, units
from rainweft.workspace import written

T0 = datetime(2024, 1, 1)


# -- regular series ---------------------------------------------------------------------------------

RUNS = "run_id bigint, source string, obs_start timestamp_ntz, issuetime timestamp_ntz, accutime double, precip string"
READINGS = "reading_id bigint, run_id bigint, source string, obs_timestamp timestamp_ntz, received_at timestamp_ntz, precip double, accutime string"
SOURCES = "source string, institution string, accutime double"


def minutes(k):
    return T0 + timedelta(minutes=k)


def series(spark, runs, readings, sources=(("a", "i", 10.0),), **how):
    return regular_grid.regular_series(spark.createDataFrame(runs, RUNS), spark.createDataFrame(readings, READINGS), spark.createDataFrame(list(sources), SOURCES), **how)


def test_series_slots_and_marks(spark):
    runs = [(1, "a", T0, minutes(40), None, "x"), (1, "a", T0, minutes(40), None, "x"), (2, "a", T0, minutes(10), 5.0, "x"), (3, "b", T0, minutes(10), None, "x"), (4, "a", minutes(5), T0, 5.0, "x")]
    readings = [
        (1, 1, "a", minutes(1), minutes(2), 1.0, "x"), (1, 1, "a", minutes(1), minutes(2), 1.0, "x"), (2, 1, "a", minutes(15), minutes(2), 3.0, "x"),
        (3, 1, "a", minutes(30), minutes(2), None, "x"), (4, 1, "a", None, minutes(2), 2.0, "x"), (5, 1, "a", minutes(300), minutes(2), 2.0, "x"),
        (6, 1, "a", minutes(40), minutes(2), float("nan"), "x"), (7, 9, "a", minutes(1), minutes(2), 1.0, "x"), (8, 1, "a", minutes(1), minutes(9), 5.0, "x"),
        (9, 1, "a", minutes(-6), minutes(9), 5.0, "x"),
    ]
    got = {(r.run_id, r.slot_no): r for r in series(spark, runs, readings).collect()}
    assert sorted(got) == [(1, k) for k in range(5)] + [(2, k) for k in range(3)]
    assert [got[1, k].filled for k in range(5)] == [False, True, False, True, True]  # halfway goes to the later slot
    assert got[1, 0].precip == 5.0 and got[1, 0].n_readings == 1  # the later revision of a time counts
    assert all(got[1, k].precip is not None for k in range(5))
    assert all(got[2, k].filled and got[2, k].precip is None for k in range(3))


def test_series_empty(spark):
    assert series(spark, [], []).count() == 0
    assert series(spark, [(1, "a", T0, minutes(20), 10.0, "x")], []).where("filled").count() == 3


def test_series_blocks_keep_all_slots(spark):
    runs = [(1, "a", T0, minutes(999), 1.0, "x")]
    readings = [(k, 1, "a", minutes(k), minutes(k), math.sin(k / 20) + 2, "x") for k in range(1000) if k % 7]
    got = series(spark, runs, readings, block=64).toPandas().sort_values("slot_no")
    assert got.slot_no.tolist() == list(range(1000)) and got.filled.sum() == len(range(0, 1000, 7))


def test_series_blocks_see_their_neighbours(spark):
    def one(n, there, block):
        readings = [(k, 1, "a", minutes(k), minutes(k), math.sin(k / 6) + 2, "x") for k in range(n) if there(k)]
        return series(spark, [(1, "a", T0, minutes(n - 1), 1.0, "x")], readings, block=block).toPandas().sort_values("slot_no")

    got = one(400, lambda k: k < 40 or k >= 360, 64)  # several blocks without any reading
    assert got.slot_no.tolist() == list(range(400)) and got.precip.notna().all() and got.filled.sum() == 320
    middle = got.precip.to_numpy()[150:250]  # nothing near: from the last reading before to the first after
    assert np.allclose(middle, np.interp(np.arange(150, 250), [39, 360], [math.sin(39 / 6) + 2, math.sin(60) + 2]))
    for n in (193, 195):  # a last block of one slot and of three; gaps over the edges of blocks
        got = one(n, lambda k: k % 64 not in (0, 1, 2, 63), 64)
        assert got.slot_no.tolist() == list(range(n))
        assert np.abs(got.precip.to_numpy()[:190] - np.sin(np.arange(190) / 6) - 2).max() < 0.1


def test_imputation_recovers_a_wave():
    x = np.sin(np.arange(200) / 6) + 2
    y = x.copy()
    y[[20, 50, 51, 52, 53, 120]] = np.nan
    assert np.abs(regular_grid.impute(y) - x).max() < 0.05
    assert np.isnan(regular_grid.impute(np.full(5, np.nan))).all()
    rng = np.random.RandomState(2)
    walks = np.abs(np.cumsum(rng.normal(0, 0.3, (60, 40)), 1))
    holes = np.where(rng.random_sample(walks.shape) < 0.2, np.nan, walks)
    got, converged = regular_grid.impute_stack(holes)
    off = lambda x: np.sqrt(((x - walks)[np.isnan(holes)] ** 2).mean())
    straight = np.stack([regular_grid._start(h, {}) for h in holes])
    assert off(got) < 1.3 * off(straight) < off(np.nanmean(holes, 1, keepdims=True)) / 2 and converged.mean() > 0.5
    assert np.array_equal(got[7], regular_grid.impute(holes[7]), equal_nan=True)  # each as if alone
    assert regular_grid.impute(np.array([1.0, np.nan, 3.0])).tolist() == [1.0, 2.0, 3.0]


# -- header drift -----------------------------------------------------------------------------------

HEADERS = "file_id bigint, feed_id bigint, ts timestamp_ntz, header_json string, path string"


def brute_changes(rows):
    feeds, out = {}, set()
    for r in {x[0]: x for x in rows}.values():
        feeds.setdefault(r[1], []).append(r)
    for rs in feeds.values():
        last, prev = {}, None
        for fid, _, _, text, _ in sorted(rs, key=lambda r: (r[2], r[0])):
            try:
                found = json.loads(text)
            except (TypeError, ValueError):
                continue
            if not isinstance(found, dict):
                continue
            flat: dict = {}
            schema_drift._leaves(found, "", flat)
            cur = {}
            for p, v in flat.items():
                a = schema_drift.attribute(p)
                k = schema_drift._kind(v) or last.get(a)
                cur[a] = (p, k)
                last[a] = k or last.get(a)
            if prev is not None:
                for a, (p, k) in cur.items():
                    if a not in prev:
                        out.add((fid, p, "added"))
                        continue
                    if p != prev[a][0]:
                        out.add((fid, p, "renamed"))
                    if k and prev[a][1] and k != prev[a][1]:
                        out.add((fid, p, "retyped"))
                out |= {(fid, prev[a][0], "removed") for a in prev if a not in cur}
            prev = cur
    return out


def test_changes_of_every_kind(spark):
    texts = ['{"gain": 1, "offset": 2}', '{"gain": 1', '{"scale_factor": "1", "offset": 2, "task": "t"}', None, "[1]", '{"what": {"gain": null}, "task": "t"}', '{"what": {"gain": [3]}, "Task": "t"}']
    rows = [(k, 1, minutes(k), t, "x") for k, t in enumerate(texts)] + [(0, 1, minutes(0), texts[0], "x")]
    got = {tuple(r) for r in schema_drift.changes(spark.createDataFrame(rows, HEADERS)).collect()}
    assert got == {(2, "scale_factor", "renamed"), (2, "scale_factor", "retyped"), (2, "task", "added"), (5, "what.gain", "renamed"), (5, "offset", "removed"), (6, "what.gain", "retyped"), (6, "Task", "renamed")}


def test_changes_match_brute_force_over_blocks(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        h = {rng.choice(["gain", "Gain", "scale_factor"]): rng.choice([1, "1", [1], None])}
        if rng.random() < 0.6:
            h["offset"] = rng.choice([1, None, True])
        text = json.dumps({"what": h}) if rng.random() < 0.3 else json.dumps(h)
        rows.append((k, k % 3 or None, T0 + timedelta(hours=5 * k), text if rng.random() < 0.9 else text[:-2], "x"))
    got = [tuple(r) for r in schema_drift.changes(spark.createDataFrame(rows, HEADERS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows)


def test_headers_empty_and_table(spark):
    assert schema_drift.changes(spark.createDataFrame([], HEADERS)).count() == 0
    rows = [(1, 1, T0, '{"gain": "0.5", "OFFSET": [2], "nodata": "x", "simulated": true, "qty": "RATE"}', "p"), (2, 1, T0, "{", "p")]
    got = schema_drift.consistent_table(spark.createDataFrame(rows, HEADERS)).orderBy("file_id").collect()
    assert (got[0].gain, got[0].offset, got[0].nodata, got[0].simulated, got[0].quantity) == (0.5, 2.0, None, True, "RATE")
    assert not got[1].readable and got[1].gain is None
    assert json.loads(got[0].more) == {"nodata": "x"} and got[1].more is None


def test_table_keeps_every_field(spark):
    texts = ['{"gain": "0,5", "site": {"height": 12, "Name": "A", "open": true}, "list": [1, 2]}', '{"gain": [1, 2], "site": {"height": "n/a", "open": null}, "quantity": [7]}', '{"what": {"gain": 2}, "how": {"gain": 3}}']
    rows = [(k, 1, minutes(k), t, "p") for k, t in enumerate(texts)]
    got = schema_drift.consistent_table(spark.createDataFrame(rows * 2, HEADERS)).orderBy("file_id").collect()
    assert [r.gain for r in got] == [0.5, None, 3.0] and [r.height for r in got] == ["12", "n/a", None] and [r.open for r in got] == [True, None, None]
    assert got[0].name == "A" and got[0].list == "[1, 2]" and json.loads(got[1].more) == {"gain": "[1, 2]"} and got[1].quantity == "7"
    assert got[2]["what.gain"] == 2.0


def test_lifespans_join_over_days(spark):
    rows = [(k, 1, T0 + timedelta(hours=9 * k), '{"gain": null}' if k in (0, 1, 8) else '{"gain": 1}' if k != 5 else '{"Gain": 1}', "x") for k in range(10)]
    got = sorted((r.first_no, r.field_path, r.kind, r.first_file, r.last_file, r.n_files) for r in schema_drift.lifespans(spark.createDataFrame(rows, HEADERS)).collect())
    assert got == [(1, "gain", "number", 0, 4, 5), (6, "Gain", "number", 5, 5, 1), (7, "gain", "number", 6, 9, 4)]


# -- implausible readings ---------------------------------------------------------------------------

CELLS = "reading_id bigint, source string, institution string, member int, t int, y int, x int, ts timestamp_ntz, precip double, step double, fault string"


def cell_rows(n=20, steps=60, seed=5):
    rng = np.random.RandomState(seed)
    rows, rid, truth = [], 0, {}
    for s in range(n):
        v = 2 + np.cumsum(rng.uniform(-0.1, 0.1, steps)).clip(-1.5, 5)
        fault = {}
        if s % 4 == 0:
            v[30], fault[30] = 40.0, "spike"
        if s % 4 == 1:
            v[20:22] = 35.0, 34.0
            fault |= {20: "spike", 21: "spike"}
        if s % 4 == 2:
            v[40:48] = v[40]
            fault |= {k: "stuck" for k in range(40, 48)}
        if s % 4 == 3:
            v[5], v[6], v[7] = -1.0, np.inf, 1500.0
            fault |= {k: "impossible" for k in (5, 6, 7)}
        for t in range(steps):
            value = float(v[t]) if t != 50 else (None if s % 2 else float("nan"))
            rows.append((rid, "a" if s < n // 2 else "b", None, 0, t, s, 0, minutes(t), value, 0.0, "x"))
            if t in fault:
                truth[rid] = fault[t]
            rid += 1
    return rows, truth


def test_faults_found(spark):
    rows, truth = cell_rows()
    rows = rows + rows[::7]
    random.Random(1).shuffle(rows)
    got = anomalies.score_readings(spark.createDataFrame(rows, CELLS)).collect()
    assert {r.reading_id: r.fault for r in got if r.fault} == truth
    assert len({r.reading_id for r in got}) == len(got)  # rows stored twice count once


def test_faults_of_edges(spark):
    assert anomalies.score_readings(spark.createDataFrame([], CELLS)).count() == 0
    rows = [(1, None, None, None, None, None, None, None, 3.0, 0.0, "x"), (2, "c", None, 0, 0, 0, 0, T0, None, 0.0, "x"), (3, "c", None, 0, 1, 0, 0, T0, -2.0, 0.0, "x")]
    got = {r.reading_id: r.fault for r in anomalies.score_readings(spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {1: None, 3: "impossible"}


@pytest.mark.parametrize("share", [0.2, 1 / 3, 0.5])
def test_every_stuck_reading_is_found(spark, share):
    rng = np.random.RandomState(11)
    rows, truth = [], {}
    for s in range(100):
        v = rng.gamma(0.5, 4.0, 40) + 0.1
        for k in range(int(4 * share * 100)):
            if k % 100 == s:  # stretches of ten, spread over the series
                at = 10 * (k // 100)
                v[at : at + 10] = v[at] + 50 * (k // 100)
                truth |= {40 * s + t: "stuck" for t in range(at, at + 10)}
        rows += [(40 * s + t, "a", None, 0, t, s, 0, minutes(t), float(v[t]), 0.0, "x") for t in range(40)]
    assert len(truth) == int(4 * share * 100) * 10
    got = anomalies.score_readings(spark.createDataFrame(rows, CELLS)).where("fault = 'stuck'").collect()
    assert {r.reading_id: r.fault for r in got} == truth


def test_many_sources_go_by_shuffle(spark, monkeypatch):
    rows, truth = cell_rows(8)
    rows = [(r[0], f"{r[1]}{r[5] % 3}", *r[2:]) for r in rows]
    cells = spark.createDataFrame(rows, CELLS)
    key = lambda r: (r.reading_id, r.source, r.fault, None if r.score is None else round(r.score, 9))
    few = sorted(map(key, anomalies.score_readings(cells).collect()))
    monkeypatch.setattr(anomalies, "SENT", 0)
    assert sorted(map(key, anomalies.score_readings(cells).collect())) == few


def test_readings_without_series(spark):
    rows = [(k, None if k % 2 else "a", None, 0, None if k % 3 == 0 else k, 0, None, T0, 5.0, 0.0, "x") for k in range(40)]
    got = anomalies.score_readings(spark.createDataFrame(rows, CELLS)).collect()
    assert len(got) == 40 and not [r for r in got if r.fault]


def test_faults_of_a_long_stuck_source(spark):
    rng = np.random.RandomState(3)
    rows, truth = [], {}
    for s in range(40):
        v = rng.gamma(0.5, 4.0, 60) + 0.1
        v[10:40] = v[10]  # half of the source stands still
        for t in range(60):
            rid = 60 * s + t
            rows.append((rid, "a", None, 0, t, s, 0, minutes(t), float(v[t]), 0.0, "x"))
            if 10 <= t < 40:
                truth[rid] = "stuck"
    got = anomalies.score_readings(spark.createDataFrame(rows, CELLS)).collect()
    assert {r.reading_id: r.fault for r in got if r.fault == "stuck"} == truth
    assert all(r.score is not None for r in got)


def test_faults_of_a_source_of_many_spikes(spark):
    rng = np.random.RandomState(8)
    rows, truth = [], {}
    for s in range(60):
        v = 2 + np.cumsum(rng.uniform(-0.1, 0.1, 60)).clip(-1.5, 5)
        high = range(4 + s % 5, 58, 10) if s < 40 else ()  # "a": one reading in ten, "b": none
        for t in high:
            v[t], truth[60 * s + t] = 30.0 + rng.uniform(0, 20), "spike"
        rows += [(60 * s + t, "a" if s < 40 else "b", None, 0, t, s, 0, minutes(t), float(v[t]), 0.0, "x") for t in range(60)]
    cells = spark.createDataFrame(rows, CELLS)
    got = anomalies.score_readings(cells).where("fault is not null").collect()
    assert {r.reading_id: r.fault for r in got} == truth
    steps = {r.source: r.step for r in anomalies.normal_steps(written(anomalies.series_features(cells), "features")).collect()}
    assert 0.08 < steps["a"] <= 0.1 + 1e-9 and 0.08 < steps["b"] <= 0.1 + 1e-9


def test_faults_independent_of_batches(spark):
    rows, truth = cell_rows(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.reading_id: r.fault for r in anomalies.score_readings(spark.createDataFrame(rows, CELLS)).where("fault is not null").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == truth


# -- units ------------------------------------------------------------------------------------------


def test_stated_units():
    assert units.stated_unit(" MM/H ", None) == "mm/h"
    assert units.stated_unit("kg m^-2 s^-1", None) == "kg/m2/s"
    assert units.stated_unit("n/a", "rerun; rain depth in inches") == "inch"
    assert units.stated_unit(None, "rain depth in mm; stored as the square root") == "mm"
    assert units.stated_unit("", "ref. batch 12") is None
    assert units.stated_transform("none", "values are dB") == "db" and units.stated_transform(None, "rerun") is None
    assert units.stated_time(None, "accumulated over 900 s", 5.0) == 15.0 and units.stated_time(None, "15-minute total", 5.0) == 15.0 and units.stated_time(None, "x", 5.0) == 5.0
    assert units.stated_relation(None, None, "Z = 300 * R^1.4") == (300.0, 1.4) and units.stated_relation(None, None, "Z-R relation a=316 b=1.5") == (316.0, 1.5)


@pytest.mark.parametrize(
    ("unit", "transform", "expected"),
    [("mm/h", "none", 1.0), ("mm", "none", 12.0), ("mm/h", "db", 1.25892541), ("mm", "db", 15.10710494), ("dbz", "db", 0.04210719), ("mm/h", "log", 2.71828183), ("mm", "log", 32.61938194), ("mm", "sqrt", 12.0)],
)
def test_rates_of_one(unit, transform, expected):
    assert units.to_rate(1.0, unit, transform, 5.0, 200.0, 1.6) == pytest.approx(expected)


NO = float("nan")


def read_frames(unit=None, transform=None, threshold=NO, zero=0.0, peak=NO, minutes=5.0, **known):
    reference = {"floor": -1.0, "level": 0.7, "spread": 0.7, "gap_none": 0.0, "gap_sqrt": 0.0, "gap_db": 5.0, "gap_log": 1.0} | known
    facts = {"threshold": threshold, "zero": zero, "peak": peak, "minutes": minutes, "a": 200.0, "b": 1.6}
    got = units.best_readings([unit], [transform], {k: np.array([v]) for k, v in facts.items()}, {k: np.array([v]) for k, v in reference.items()})
    return tuple(got[k][0] for k in ("unit", "transform", "unique", "misfit"))


def test_identities_decide_what_nobody_states():
    assert read_frames(threshold=7.0103, zero=2.0103)[:3] == ("dbz", "db", True)
    assert read_frames(threshold=0.1)[:3] == ("mm/h", "none", True)
    found = read_frames(threshold=0.1 / 12)  # a mm is a kg/m2
    assert found[0] in ("mm", "kg/m2") and not found[2]
    assert not read_frames(threshold=0.1, minutes=60.0)[2]  # an hour's depth is a rate


def test_nothing_is_invented():
    assert not read_frames(threshold=0.5)[2]
    unit, _, unique, misfit = read_frames("mm/h", "none", threshold=25.0)
    assert unit == "mm/h" and not unique and misfit > 2
    assert read_frames("mm", "none", threshold=0.1 / 12)[::2] == ("mm", True)
    assert not read_frames()[2] and not read_frames(threshold=0.1, floor=NO)[2]
    assert not read_frames("kg/m2/s", "none", threshold=1e3)[2]  # a factor beyond a thousand overrules, and is marked
    assert read_frames("m/s", "none", threshold=0.1)[0] == "mm/h"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_hidden_units_are_found_or_marked(spark):
    f, s = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("radar_frames", "radar_sources"))
    first = units.resolve_units(f, s).where("unit_stated and above and unique")
    truth = {r.frame_id: r for r in first.collect()}
    hide = (F.col("frame_id") % 3 == 0) & F.col("minutes").isNotNull()
    meta = F.col("meta")
    for name, value in {"unit": None, "transform": None, "accutime": F.col("minutes"), "zr_a": F.col("a"), "zr_b": F.col("b")}.items():
        meta = meta.withField(name, F.when(hide, value).otherwise(F.col(f"meta.{name}")))
    hidden = f.join(first.select("frame_id", "minutes", F.col("zr_a").alias("a"), F.col("zr_b").alias("b")), "frame_id").withColumn("meta", meta).withColumn("note", F.when(~hide, F.col("note")))
    got = [r for r in units.resolve_units(hidden, s).where("frame_id % 3 = 0").collect() if r.frame_id in truth]
    unique = [r for r in got if r.unique]
    assert len(got) > 80 and len(unique) > len(got) / 2
    assert all((r.unit, r.transform) == (truth[r.frame_id].unit, truth[r.frame_id].transform) for r in unique)  # no false unique
    right = sum(abs(math.log10(r.peak / truth[r.frame_id].peak)) < 0.001 for r in got)
    assert right >= 0.95 * len(got)


FRAMES = "frame_id bigint, source string, ny int, nx int, data array<double>, meta struct<unit:string,transform:string,accutime:double,threshold:double,zerovalue:double,zr_a:double,zr_b:double>, note string, unit string, peak double"


def test_frames(spark):
    nan = float("nan")
    rows = [
        (1, "a", 1, 3, [12.0, None, nan], ("mm", None, None, 0.01, 0.0, None, None), "15-minute total", "x", 0.0),
        (1, "a", 1, 3, [12.0, None, nan], ("mm", None, None, 0.01, 0.0, None, None), "15-minute total", "x", 0.0),
        (2, "z", 1, 1, [nan], ("mm", None, 5.0, 0.01, 0.0, None, None), None, "x", 0.0),
        (3, None, 0, 0, None, None, None, None, None),
        (4, "a", 1, 2, [20.0, 2.01], ("dBZ", None, 5.0, 7.0103, 2.01, None, None), None, "x", 0.0),
    ]
    f, s = spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("a", "i", 10.0)], SOURCES)
    got = {r.frame_id: r for r in units.resolve_units(f, s).collect()}
    assert len(got) == 4 and got[1].peak == pytest.approx(48.0) and got[2].peak is None and not got[3].unit_stated
    rates = {r.frame_id: r.rate for r in units.to_rain_rate(f, s).collect()}
    assert rates[1][0] == pytest.approx(48.0) and rates[1][1:] == [None, None] and rates[4][0] == pytest.approx((100 / 200) ** (1 / 1.6)) and rates[4][1] == 0.0
    assert units.resolve_units(f.limit(0), s).count() == 0


def test_threshold_tells_an_unstated_time(spark):
    rows = [
        (1, "z", 1, 1, [3.0], ("mm", None, None, 0.1 * 10 / 60, 0.0, None, None), None, "x", 0.0),
        (2, None, 1, 1, [3.0], ("mm", None, None, 0.1 * 15 / 60, 0.0, None, None), None, "x", 0.0),
        (3, "z", 1, 1, [3.0], ("mm", None, None, 0.0, 0.0, None, None), None, "x", 0.0),
        (4, "z", 1, 1, [3.0], ("mm", None, None, None, None, None, None), None, "x", 0.0),
        (5, "z", 1, 1, [3.0], ("mm/h", "none", None, 0.1, 0.0, None, None), None, "x", 0.0),
    ]
    f, s = spark.createDataFrame(rows, FRAMES), spark.createDataFrame([("a", "i", 10.0)], SOURCES)
    got = {r.frame_id: r for r in units.resolve_units(f, s).collect()}
    assert got[1].peak == pytest.approx(18.0) and got[1].minutes == 10.0 and got[1].unique
    assert got[2].peak == pytest.approx(12.0) and got[2].minutes == 15.0
    assert got[3].peak is None and got[4].peak is None  # nothing tells the time
    assert got[5].peak == pytest.approx(3.0) and got[5].minutes is None
    assert {r.frame_id: r.rate for r in units.to_rain_rate(f, s).collect()}[1][0] == pytest.approx(18.0)


def test_missing_columns_are_named(spark):
    with pytest.raises(DataModelError, match="received_at"):
        series(spark, [], []) and regular_grid.regular_series(spark.createDataFrame([], RUNS), spark.createDataFrame([], "reading_id bigint, run_id bigint, obs_timestamp timestamp_ntz, precip double"), spark.createDataFrame([], SOURCES))


def test_written_tables_are_shared(spark):
    assert spark.conf.get("spark.checkpoint.dir") in written(spark.range(5), "x").inputFiles()[0]
