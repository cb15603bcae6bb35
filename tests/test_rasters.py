"""Raster operators against closed-form values and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweft import config, registry
from rainweft.errors import DataModelError, DirectoryNotEmpty, MissingOptionalDependency
from rainweft.functions import transforms as T
from rainweft.functions.normal import normal_quantile
from rainweft.kernels import advection, assimilation, features, motion, nowcast, spectral
from rainweft.operators import ensemble, forecast, grid, neighbourhood, ranks, scattered, series, verification
from rainweft.sources import rasters, sinks


def cells(spark, a, keys=None):
    a = np.asarray(a, float)
    a = a[None] if a.ndim == 2 else a
    rows = [(t, y, x, None if np.isnan(a[t, y, x]) else float(a[t, y, x])) for t in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "t int, y int, x int, v double")


def array(df, col="v"):
    p = df.toPandas()
    out = np.full((p.t.max() + 1, p.y.max() + 1, p.x.max() + 1), np.nan)
    out[p.t, p.y, p.x] = p[col].astype(float)
    return out


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_conversions(spark):
    one_ = F.lit(1.0)
    expected = {("mm/h", None): 1, ("mm", None): 12, ("mm/h", "dB"): 1.25892541, ("mm", "dB"): 15.10710494, ("dBZ", "dB"): 0.04210719, ("mm/h", "log"): 2.71828183, ("mm", "log"): 32.61938194, ("mm", "sqrt"): 12}
    for (unit, transform), value in expected.items():
        assert one(spark, T.to_rainrate(one_, unit, transform, 5.0)) == pytest.approx(value)
    assert one(spark, T.to_raindepth(F.lit(12.0), "mm/h", None, 5.0)) == pytest.approx(1.0)
    assert one(spark, T.to_reflectivity(F.lit(0.04210719), "mm/h")) == pytest.approx(1.0, abs=1e-5)
    assert one(spark, T.boxcox_inverse(one_)) == pytest.approx(np.e) and one(spark, T.boxcox_inverse(one_, lam=1.0)) == 2.0
    assert one(spark, T.db_transform(F.lit(None).cast("double"), 0.1)) is None


def test_normal_quantiles():
    assert normal_quantile(np.array([1 / 3, 2 / 3])) == pytest.approx([-0.4307273, 0.4307273], abs=1e-6)


def test_block_aggregation(spark):
    a = np.arange(24.0).reshape(4, 6)
    assert array(grid.aggregate_space(cells(spark, a), 2, 3, "sum"))[0].tolist() == [[24, 42], [96, 114]]
    a[0, 0] = np.nan
    assert np.isnan(array(grid.aggregate_space(cells(spark, a), 2, 3, "sum"))[0, 0, 0])
    assert array(grid.aggregate_space(cells(spark, a), 2, 3, "sum", True))[0, 0, 0] == 24
    with pytest.raises(ValueError):
        grid.check_divides(5, 2)


def test_categorical_golden(spark):
    rows = [(1.0, 1.0)] * 82 + [(1.0, 0.0)] * 38 + [(0.0, 1.0)] * 23 + [(0.0, 0.0)] * 220 + [(None, None), (None, 0.0)]
    s = verification.categorical_scores(verification.contingency_state(spark.createDataFrame(rows, "p double, o double"), 0.0)).first()
    expected = {"acc": 0.83287671, "bias": 1.1428571, "pod": 0.7809524, "far": 0.316667, "fa": 0.146154, "csi": 0.573426, "hss": 0.608871, "hk": 0.6348, "gss": 0.437682, "sedi": 0.789308, "mcc": 0.611707, "f1": 0.728889}
    for k, v in expected.items():
        assert s[k] == pytest.approx(v, abs=2e-5), k


OBS = [7, 10, 9, 15, 22, 13, 17, 17, 19, 23, 0, 10, 0, 15, 0, 13, 0, 17, 0, 0]
PRED = [1, 8, 12, 13, 18, 10, 16, 19, 23, 24, 0, 0, 12, 0, 0, 0, 16, 0, 0, 0]


def test_continuous_golden(spark):
    pairs = spark.createDataFrame([(float(p), float(o)) for p, o in zip(PRED, OBS)] + [(None, 3.0)], "p double, o double")
    s = verification.continuous_scores(verification.moment_state(pairs)).first()
    expected = {"me": -1.75, "mae": 5.55, "mse": 64.15, "nmse": 0.113711, "rmse": 8.009370, "beta1": 0.498200, "beta2": 0.591673, "rv": -0.054622, "drmse": 7.815849, "corr_p": 0.542929}
    for k, v in expected.items():
        assert s[k] == pytest.approx(v, abs=1e-5), k
    assert verification.spearman(pairs).first().corr_s == pytest.approx(0.565251, abs=1e-5)
    single = verification.conditioned(pairs.where("p is not null"), "single")
    assert verification.continuous_scores(verification.moment_state(single)).first().me == pytest.approx(-2.1875)
    merged = verification.merge_states(verification.moment_state(pairs.where("o < 10")).unionByName(verification.moment_state(pairs.where("o >= 10"))), [])
    assert verification.continuous_scores(merged).first().rmse == pytest.approx(8.009370, abs=1e-5)


def test_ensemble_golden(spark):
    a = np.arange(9.0).reshape(3, 3)
    rows = [(m, 0, y, x, float(a[y, x])) for m in range(4) for y in range(3) for x in range(3)]
    e = spark.createDataFrame(rows, "member int, t int, y int, x int, v double")
    assert array(ensemble.ensemble_mean(e))[0].tolist() == a.tolist()
    assert array(ensemble.exceedance(e, [2.0]), "p")[0].tolist() == [[0, 0, 1], [1, 1, 1], [1, 1, 1]]
    gap = e.withColumn("v", F.when((F.col("member") == 3) & (F.col("x") == 0), None).otherwise(F.col("v")))
    assert np.isnan(array(ensemble.ensemble_mean(gap))[0, :, 0]).all() and array(ensemble.ensemble_mean(gap, ignore_missing=True))[0].tolist() == a.tolist()
    b = spark.createDataFrame([(m, 0, y, x, float(y * 3 + x + 1) * (m + 1)) for m in range(5) for y in range(3) for x in range(3)], "member int, t int, y int, x int, v double")
    assert [r.depth for r in ensemble.band_depth(b).orderBy("member").collect()] == pytest.approx([0.4, 0.7, 0.8, 0.7, 0.4])
    assert [r.depth for r in ensemble.band_depth(b, True).orderBy("member").collect()] == pytest.approx([0, 0.75, 1, 0.75, 0])


def test_crps_ties_add_nothing(spark):
    c = spark.createDataFrame([([0.0, 1.0, 2.0], 1.0), ([0.0, 1.0, 2.0], 3.0)], "f array<double>, o double")
    per = [verification.crps_state(c.where(F.col("o") == o)).first().s for o in (1.0, 3.0)]
    assert per[0] == 0.0 and per[1] == pytest.approx(1 / 9 + 4 / 9 + 1)


def test_neighbourhoods_against_loops(spark):
    rng = np.random.RandomState(3)
    a = rng.rand(9, 11)
    c = cells(spark, a)
    for s in (2, 3):
        want = np.array([[a[max(0, y - s // 2) : y + s - s // 2, max(0, x - s // 2) : x + s - s // 2].sum() for x in range(11)] for y in range(9)])
        assert array(neighbourhood.box_sum(c, ["v"], s))[0] == pytest.approx(want)
    a[2, 3] = np.nan
    got = array(neighbourhood.weighted_mean(cells(spark, a), neighbourhood.disc_offsets(1)))[0]
    assert got[2, 3] == pytest.approx(np.mean([a[1, 3], a[3, 3], a[2, 2], a[2, 4]])) and got.shape == a.shape
    square = np.zeros((20, 20))
    square[5:10, 5:10] = 1
    for radius in (0, 3, 6):
        p = array(neighbourhood.lagrangian_probability(cells(spark, square), 0.5, radius), "pr")[0]
        assert p.min() >= 0 and p.max() <= 1 and (radius or (p == square).all())
    assert neighbourhood.box_sum(c.limit(0), ["v"], 3).count() == 0


def test_ranks(spark):
    rng = np.random.RandomState(1)
    a, b = rng.rand(6, 6), rng.rand(6, 6)
    got = array(ranks.match_cdf(cells(spark, a), cells(spark, b)))[0]
    assert np.sort(got.ravel()) == pytest.approx(np.sort(b.ravel())) and (np.argsort(got.ravel()) == np.argsort(a.ravel())).all()
    assert array(ranks.percentile_mask(cells(spark, a), 0.25), "mask")[0].sum() == 9
    first, second = cells(spark, [[1, 3, 5, 7, 9]]), cells(spark, [[2, 4, 6, 8, 10]])
    assert [r.v for r in ranks.resample(first, second, 0.0).orderBy("rank").collect()] == [10, 8, 6, 4, 2]
    assert [r.v for r in ranks.resample(first, second, 1.0).orderBy("rank").collect()] == [9, 7, 5, 3, 1]


def test_points(spark):
    p = spark.createDataFrame([(k, float(k % 5), float(k // 5), 1.0 + (k == 12) * 50, 0.0) for k in range(25)], "id bigint, x double, y double, u double, v double")
    assert [r.id for r in scattered.local_outliers(p, 3.0, 8, 3.0).where("outlier").collect()] == []  # without spread none is marked
    assert [r.id for r in scattered.global_outliers(p, 3.0, "u").where("outlier").collect()] == [12]
    assert scattered.decluster(p, 5.0).count() == 1 and scattered.decluster(p, 5.0, 26).count() == 0
    g = grid.full_grid(spark, 1, 5, 5)
    near = scattered.rbf([(r.x, r.y, r.u) for r in p.collect()], g).where("y = 2 and x = 2").first().v
    assert near == pytest.approx(51.0, abs=1e-6)
    assert scattered.idw(p.limit(0), g, "u").where("v is not null").count() == 0


def test_autoregression():
    phi = series.yule_walker([0.8, 0.6])
    assert phi[:2] == pytest.approx([0.8889, -0.1111], abs=1e-4) and series.stationary(phi[:2]) and not series.stationary([1.1])
    assert series.undifferenced(np.array([0.5])) == pytest.approx([1.5, -0.5])
    assert series.ar_acf([0.5], 3) == pytest.approx([0.5, 0.25, 0.125])
    assert series.var_stationary([np.eye(2) * 0.5]) and not series.var_stationary([np.eye(2) * 1.5])


def test_advection_golden():
    f = np.zeros((8, 8))
    f[0, 0] = 1
    for velocity, step in ((1.0, 1.0), (10.0, 0.1)):
        got = advection.extrapolate(f, np.full((2, 8, 8), velocity) * step, [1.0])[0][0]
        assert np.isnan(got[0]).all() and np.isnan(got[:, 0]).all() and got[1, 1] == 1
    two, _ = advection.extrapolate(f, np.ones((2, 8, 8)), [1, 2])
    one_, d = advection.extrapolate(f, np.ones((2, 8, 8)), [1])
    assert np.nan_to_num(advection.extrapolate(f, np.ones((2, 8, 8)), [1], start=d)[0][0]) == pytest.approx(np.nan_to_num(two[1]))


@pytest.fixture(scope="module")
def moving():
    rng = np.random.RandomState(1)
    k = spectral.radius((64, 64))[:, :33]
    k[0, 0] = np.inf
    f = np.maximum(spectral.noise(k**-2.0, (64, 64), rng), 0) * 10
    return np.stack([np.roll(f, (t, 2 * t), (0, 1)) for t in range(4)])


@pytest.mark.parametrize(("method", "bound"), [("constant", 0.01), ("lucaskanade", 0.1), ("vet", 0.05), ("proesmans", 0.1), ("farneback", 0.28), ("darts", 0.3)])
def test_motion_converges(moving, method, bound):
    flow = motion.METHODS[method](moving)[:, 16:-16, 16:-16]
    want = np.array([2.0, 1.0])[:, None, None]
    assert np.sqrt(((flow - want) ** 2).sum(0).mean() / 5.0) < bound


def test_cascade_and_spectra(moving):
    f = moving[0]
    w = spectral.band_weights(f.shape, 6)
    assert w.sum(0) == pytest.approx(np.ones(w.shape[1:])) and spectral.recompose(*spectral.decompose(f, w)) == pytest.approx(f)
    half = np.fft.rfft2(f)
    assert spectral.spectral_mean(half, f.shape) == pytest.approx(f.mean()) and spectral.spectral_std(half, f.shape) == pytest.approx(f.std())
    fine, _ = spectral.rainfarm(f, 2, rng=np.random.RandomState(1))
    assert fine.reshape(64, 2, 64, 2).mean((1, 3)) == pytest.approx(f)
    with pytest.raises(ValueError):
        spectral.band_weights((8, 8), 2)


def test_features():
    f = np.zeros((60, 60))
    y, x = np.mgrid[0:60, 0:60]
    for cy, cx in ((15, 15), (40, 42)):
        f += 60 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 60)
    found, labels = features.storm_cells(f, min_size=20)
    assert sorted((c["cen_y"], c["cen_x"]) for c in found) == [(15, 15), (40, 42)] and labels.max() == 2
    b = features.blobs(f, 2)
    assert sorted((int(p[1]), int(p[0])) for p in b) == [(15, 15), (40, 42)]
    mask = np.zeros((6, 6), bool)
    mask[0, :3] = mask[1, 3] = mask[4:, 4:] = True
    assert features.label(mask).max() == 2 and features.label(np.zeros((3, 3), bool)).max() == 0 and features.label(np.ones((3, 3), bool)).max() == 1
    assert len(features.corners(np.zeros((20, 20)))) == 0


@pytest.mark.parametrize("method", sorted(nowcast.METHODS))
def test_nowcasts_follow_the_flow(moving, method):
    flow = np.stack([np.full((64, 64), 2.0), np.full((64, 64), 1.0)])
    got = nowcast.METHODS[method](moving[:3], flow, [1, 2], threshold=0.1, levels=4, seed=None)
    assert got.shape == (2, 64, 64)
    if method != "eulerian":
        a, b = got[0][8:-8, 8:-8], moving[3][8:-8, 8:-8]
        assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.8


def test_nowcast_members_are_seeded_and_dry_stays_dry(moving):
    flow = np.zeros((2, 64, 64))
    a, b, c = (nowcast.steps(moving[:3], flow, [1], 0.1, seed=s, levels=4) for s in (1, 1, 2))
    assert (np.nan_to_num(a) == np.nan_to_num(b)).all() and (np.nan_to_num(a) != np.nan_to_num(c)).any()
    assert nowcast.steps(np.zeros((3, 32, 32)), np.zeros((2, 32, 32)), [1, 2, 3], 0.1, seed=1).sum() == 0


def test_assimilation(moving):
    rng = np.random.RandomState(2)
    a, b = rng.normal(0, 1, (20, 4)), rng.normal(3, 0.1, (20, 4))
    new = assimilation.kalman_update(a, b)
    assert abs(new.mean() - 3) < abs(a.mean() - 3)
    got = assimilation.masked_correction(np.abs(moving[:3, :16, :16]), np.abs(moving[:3, 16:32, 16:32]), 0.1)
    assert got.shape == (3, 16, 16) and np.isfinite(got).all()
    w = assimilation.tapering(6)
    assert w.shape == (6, 6) and (np.diag(w) == 1).all()


def test_forecast_independent_of_partitions(spark, moving):
    rows = [(0, t, 64, 64, moving[t].ravel().tolist()) for t in range(3)]
    df = spark.createDataFrame(rows, "case int, t int, ny int, nx int, data array<double>")
    out = []
    for n in (1, 4):
        st = forecast.frame_stacks(df.repartition(n), 3)
        f = forecast.nowcasts(st, forecast.motion_fields(st), [1.0, 1.5], "steps", members=2, threshold=0.1, levels=4)
        out.append(sorted((r.member, r.lead, tuple(r.data)) for r in f.collect()))
    assert out[0] == out[1] and len(out[0]) == 4
    with pytest.raises(ValueError):
        forecast.nowcasts(st, st, [2, 1])


def test_readers(spark, tmp_path):
    codes = np.array([[64, 255], [66, 84]], np.uint8)
    (tmp_path / "202401010000_x.pgm").write_bytes(b"P5\n# projection stereographic\n# missingval 255\n2 2\n255\n" + codes.tobytes())
    (tmp_path / "202401010005_x.pgm").write_bytes(b"broken")
    f = {r.ts.minute: r for r in rasters.read_frames(spark, str(tmp_path), "fmi_pgm", "%Y%m%d%H%M", "*.pgm").collect()}
    assert f[0].data == [0.0, None, 1.0, 10.0] and f[0].meta.zr_a == 223.0 and f[5].data is None
    head = b"RW010000100000124BY     32VS 3SW   2.12.0PR E-01INT  60GP   2x   2MS 10<boo>\x03"
    data, _, meta = rasters.read_radolan(head + np.array([10, 2500 + (1 << 13), 5, 7 | (1 << 14)], "<u2").tobytes())
    assert data[0, 0] == pytest.approx(1.0) and np.isnan(data[0, 1]) and data[1, 1] == pytest.approx(-0.7) and meta["accutime"] == 60.0
    with pytest.raises(ValueError):
        rasters.read_frames(spark, str(tmp_path), "nothing")
    with pytest.raises(MissingOptionalDependency):
        rasters.read_frames(spark, str(tmp_path), "mch_metranet")
    assert rasters.unpacked(np.array([0, 255, 10]), 0.5, -32.0, 255, 0, -30.0).tolist()[::2] == [-30.0, -27.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 1.0, 1, 2, [6.0, None]), (0, 0, 2.0, 1, 2, [12.0, 1.0])], "case int, member int, lead double, ny int, nx int, data array<double>")
    sinks.write_forecast(df, str(tmp_path / "p"))
    assert sinks.read_forecast(spark, str(tmp_path / "p")).count() == 2
    text = sorted(r.value for r in sinks.kineros_blocks(df, "mm/h").collect())
    assert "N = 2" in text[0] and "1.50" in text[0]
    with pytest.raises(DirectoryNotEmpty):
        sinks.ensure_empty(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        sinks.write_forecast(df, str(tmp_path / "k"), "kineros", "timestep")


def test_registry_and_settings(tmp_path):
    assert registry.get_method("CSI", "deterministic") and registry.get_method("LK", "motion")
    with pytest.raises(TypeError):
        registry.get_method(None, "motion")
    with pytest.raises(ValueError):
        registry.get_method("none such", "motion")
    registry.register("diagnostic", "own", len)
    assert registry.get_method("own", "diagnostic") is len
    with pytest.raises(ValueError):
        registry.register("diagnostic", "own", len)
    (tmp_path / "rc").write_text('{"silent_import": true, // note\n "outputs": {"path": "http://x"}}')
    assert config.load(tmp_path / "rc") == config.Settings(True, {}, {"path": "http://x"})
    (tmp_path / "rc").write_text('{"other": 1}')
    with pytest.raises(DataModelError):
        config.load(tmp_path / "rc")


def test_every_frame_reaches_a_stack(spark):
    import __spark_entry__ as entry

    frames = spark.createDataFrame([(t, 1, 2, [float(t), -float(t)]) for t in range(6)], "t int, ny int, nx int, data array<double>").repartition(3)
    got = {r.case: r.stack for r in forecast.rolling_stacks(frames, 3).collect()}
    assert got == {c: [x for t in range(c - 2, c + 1) for x in (float(t), -float(t))] for c in range(2, 6)}
    assert forecast.rolling_stacks(frames.where("t <> 3"), 3).collect()[0].case == 2  # a gap makes no stack
    for name, first in (("motion_constant", 2), ("motion_darts", 8)):
        cases = [r.case for r in entry.queries()[name](spark, "/root/testdata/sf0.001").collect()]
        assert sorted(cases) == list(range(first, 30)), name


def test_registered_features_are_not_capped(spark, monkeypatch):
    from rainweft.plans import forecasts

    y, x = np.mgrid[:160, :160]
    field = sum(np.exp(-((y - 16 - 32 * a) ** 2 + (x - 16 - 32 * b) ** 2) / 32.0) for a in range(5) for b in range(5))
    df = spark.createDataFrame([(0, 0, 160, 160, [float(v) for v in field.ravel()])], "case int, t int, ny int, nx int, data array<double>")
    monkeypatch.setattr(forecasts, "tensors", lambda s, d: df)
    assert forecasts.QUERIES["features_blob"](spark, "").count() >= 25
    assert forecasts.QUERIES["features_shitomasi"](spark, "").count() >= 25


def test_registered_exporters_write(spark, tmp_path):
    from rainweft import registry

    df = spark.createDataFrame([(0, 0, 1.0, 1, 2, [1.0, 2.0])], "case int, member int, lead double, ny int, nx int, data array<double>")
    for name, write in registry.methods("exporter").items():
        write(df, str(tmp_path / name), name)
        assert any((tmp_path / name).iterdir()), name


def test_energies_without_a_base_are_not_numbers(spark):
    """Events everywhere or nowhere: the skill is what division by a base of 0 gives, as in the SQL."""
    rows = lambda p, o: spark.createDataFrame([(0, y, x, p, o) for y in range(2) for x in range(2)], "t int, y int, x int, p double, o double")
    skill = lambda p, o: [r.skill for r in verification.binary_mse_scores(verification.binary_mse_state(rows(p, o), 1.0, 1), 1).orderBy("level").collect()]
    assert all(np.isnan(v) for v in skill(2.0, 2.0)) and all(np.isnan(v) for v in skill(0.0, 0.0))
    got = skill(2.0, 0.0)
    assert np.isnan(got[0]) and got[1] == -np.inf


def test_categorical_scores_without_a_base(spark):
    """Ratios that the SQL guards are null without a base, the others NaN or infinite."""
    scores = lambda *rows: verification.categorical_scores(verification.contingency_state(spark.createDataFrame(list(rows), "p double, o double"), 1.0)).first()
    every, none, false = scores((2.0, 2.0)), scores((0.0, 0.0)), scores((2.0, 0.0))
    assert np.isnan(every.fa) and np.isnan(every.hk) and every.pod == every.acc == every.csi == every.bias == every.f1 == 1.0 and every.far == 0.0
    assert all(np.isnan(none[k]) for k in ("pod", "csi", "bias", "hk", "f1")) and none.far is None and none.fa == 0.0
    assert np.isnan(false.pod) and false.bias == np.inf and false.far == 1.0
    assert all(s[k] is None for s in (every, none) for k in ("hss", "gss", "sedi", "mcc")) and false.gss == false.hss == 0.0 and false.mcc is None
