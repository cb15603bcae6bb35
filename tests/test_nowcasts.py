"""Quality of forecasts on fields that move and slowly change, and the parts of the larger methods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweft.kernels import combined, localised, motion, nowcast, spectral
from rainweft.kernels.advection import extrapolate
from rainweft.operators import forecast

N, THR = 64, 1.0


@pytest.fixture(scope="module")
def rain():
    """Twelve frames of a field (mm/h) that moves by (2, 1) cells a step and changes slowly, and the flow."""
    rng = np.random.RandomState(3)
    noise = lambda: spectral.smooth(rng.standard_normal((N, 2 * N)), 5.0)[:, :N]
    scale = noise().std()
    g, frames = noise() / scale, []
    for _ in range(12):
        g = np.roll(g, (1, 2), (0, 1)) * 0.98 + math.sqrt(1 - 0.98**2) * noise() / scale
        frames.append(np.where(g > 0.3, np.exp(1.2 * g), 0.0))
    flow = np.stack([np.full((N, N), 2.0), np.full((N, N), 1.0)])
    return np.stack(frames), flow


def db(f):
    return np.where(f >= 0.1, 10 * np.log10(np.maximum(f, 0.1)), -15.0)


def csi(f, o, thr):
    p, q = np.nan_to_num(f, nan=-99) > thr, o > thr
    inside = np.isfinite(f)
    return (p & q & inside).sum() / ((p | q) & inside).sum()


def crps(members, o):
    inside = np.isfinite(members).all(0)  # what the flow brings in from outside is missing
    m, o = np.sort(members[:, inside], 0), o[inside]
    n = len(m)
    return float((np.abs(m - o).mean(0) - sum((2 * k - n + 1) * m[k] for k in range(n)) / n**2).mean())


def undb(f):
    return np.where(np.isnan(f), np.nan, np.where(f < -10, 0.0, 10 ** (f / 10)))


@pytest.mark.parametrize("order", [1, 2])
def test_scale_filtered_nowcast(rain, order):
    frames, flow = rain
    got = nowcast.sprog(db(frames[:8]), flow, [1, 2, 3], -10.0, levels=6, order=order)
    assert csi(got[2], db(frames[10]), -10.0) > 0.5


def test_stochastic_nowcast(rain):
    frames, flow = rain
    members = np.stack(nowcast.cascade_members(db(frames[:8]), flow, [1, 2, 3], -10.0, [1, 2, 3, 4, 5], order=2))
    still = [np.abs(frames[7] - frames[8 + k]).mean() for k in range(3)]  # what persistence misses
    assert crps(undb(members[:, 0]), frames[8]) < 0.6 and all(crps(undb(members[:, k]), frames[8 + k]) < 0.6 * still[k] for k in range(3))
    alone = nowcast.steps(db(frames[:8]), flow, [1, 2, 3], -10.0, seed=3, order=2)
    assert np.array_equal(alone, members[2], equal_nan=True)  # a member doesn't depend on its group
    local = np.stack(nowcast.SHARED["sseps"](db(frames[:8]), flow, [1], -10.0, [1, 2, 3, 4, 5], window=32))
    assert crps(undb(local[:, 0]), frames[8]) < 0.6
    adjusted = np.stack(nowcast.cascade_members(db(frames[:8]), flow, [3], -10.0, [1, 2, 3], adjust=True))
    assert crps(undb(adjusted[:, 0]), frames[10]) < still[2]
    nested = nowcast.steps(db(frames[:8]), flow, [1], -10.0, seed=1, noise="nested")
    assert np.isfinite(nested).any()


@pytest.mark.parametrize("order", [1, 2])
def test_integrated_nowcast(rain, order):
    frames, flow = rain
    got = nowcast.anvil(frames[:8], flow, [1, 2, 3], THR, levels=8, order=order)
    assert csi(got[2], frames[10], 0.1) > 0.6
    liquid = 20 * frames
    rate = nowcast.anvil(liquid[:8], flow, [1, 2, 3], THR, rate=frames[7], order=order)
    assert csi(rate[2], frames[10], 0.5) > 0.5 and np.nanmin(rate) >= 0


@pytest.mark.parametrize("order", [1, 2])
def test_localised_nowcast(rain, order):
    frames, flow = rain
    got = nowcast.linda(frames[:8], flow, [1, 2, 3], 0.1, features=6, order=order)
    assert csi(got[2], frames[10], 0.1) > 0.5
    members = np.stack([nowcast.linda(frames[:8], flow, [3], 0.1, seed=k, features=6, order=order) for k in range(5)])
    assert crps(members[:, 0], frames[10]) < 0.5 * np.abs(frames[7] - frames[10]).mean() and members.std(0)[0][np.isfinite(members).all(0)[0]].max() > 0


def test_fits_of_features():
    rng = np.random.RandomState(1)
    f = spectral.smooth(rng.standard_normal((48, 48)), 2.0)
    blurred = localised.masked_convolution(f, localised.kernel(2.0))
    w = localised.window_weights(np.array([[12.0, 12.0], [36.0, 36.0]]), f.shape, 12.0)
    for k in localised.fitted_kernels(f, blurred, w, anisotropic=False):
        y = np.arange(k.shape[0]) - k.shape[0] // 2
        assert math.sqrt((k.sum(1) * y * y).sum()) == pytest.approx(2.0, abs=0.3)
    holes = np.where(rng.random_sample(f.shape) < 0.1, np.nan, 2.0)
    assert np.allclose(localised.masked_convolution(holes, localised.kernel(1.5, 0.7, 0.5)), 2.0)
    acf = localised.parametric_acf((64, 64), 1.0, 6.0, 3.0, 0.6)
    c, long, short, angle = localised.fitted_acf(acf)
    assert long == pytest.approx(6.0, rel=0.3) and short == pytest.approx(3.0, rel=0.3) and abs((angle - 0.6 + math.pi / 2) % math.pi - math.pi / 2) < 0.2
    r = np.exp(0.4 * rng.standard_normal(20000) - 0.08)
    assert localised.lognormal_sigma(r, np.ones(20000)) == pytest.approx(0.4, abs=0.02)
    changes = [rng.standard_normal((48, 48)), rng.standard_normal((48, 48))]
    changes.append(0.5 * changes[1] + 0.2 * changes[0])
    assert np.allclose(localised.ar2_of_features(np.stack(changes), w), [0.5, 0.2], atol=1e-6)
    assert localised.window_weights(np.zeros((1, 2)), (4, 4), 2.0).min() == 1.0
    assert localised.tukey_window((20, 20), (10, 10), (5, 5))[10, 10] == 1.0 and localised.tukey_window((20, 20), (10, 10), (5, 5))[0, 0] == 0.0


def test_variational_parts(rain):
    frames, flow = rain
    assert motion.padding(100, (32, 16, 4)) == (14, 14) and motion.padding(64, (32, 16)) == (0, 0)
    image, outside = motion.warped(frames[0], flow)
    assert np.allclose(image[:-1, :-2], frames[0][1:, 2:]) and outside[:, -1].all() and not outside[:-1, :-2].any()
    moved = np.roll(frames[0], (1, 2), (0, 1))
    right, _ = motion.sector_cost(np.stack([np.full((2, 2), 2.0), np.full((2, 2), 1.0)]), np.stack([frames[0], moved]), 1.0)
    none, way = motion.sector_cost(np.zeros((2, 2, 2)), np.stack([frames[0], moved]), 1.0)
    assert right < none / 10 and np.isfinite(way).all()


def models_of(frames, start, n, members=3, seed=0):
    rng = np.random.RandomState(seed)
    return np.stack([[db(frames[start + k] * np.exp(0.2 * rng.standard_normal())) for k in range(n)] for _ in range(members)])


def test_blended_forecast(rain):
    frames, flow = rain
    nwp = models_of(frames, 7, 5)
    b = combined.Blend(db(frames[5:8]), nwp, flow, np.stack([flow] * 3), -10.0)
    assert not b.dry_forecast() and (np.diff(b.now[0]) <= 0).all() and len(b.skill_rows()) == 18
    members = np.stack([combined.blended_member(b, [1, 2, 2.5, 3], k, [k % 3]) for k in range(4)])
    assert members.shape == (4, 4, N, N) and crps(undb(members[:, 3]), frames[10]) < 0.6
    full = combined.blended_member(b, [1, 2, 3, 4], 1, [0], full_model_from=2)
    assert csi(full[3], nwp[0, 4], -10.0) > csi(full[0], nwp[0, 4], -10.0)
    for how in ({"mask": "obs"}, {"mask": "none", "matching": "mean"}, {"matching": "none"}):
        assert np.isfinite(combined.blended_member(b, [1], 1, [0, 1, 2], **how)).all()
    spn = combined.Blend(db(frames[5:8]), nwp, flow, np.stack([flow] * 3), -10.0, weights_method="spn")
    assert csi(combined.blended_member(spn, [2], 1, [0, 1, 2])[0], db(frames[9]), -10.0) > 0.5


def test_blending_of_dry_fields(rain):
    frames, flow = rain
    dry, nwp = np.full((3, N, N), -15.0), models_of(frames, 7, 4)
    both = combined.Blend(dry, np.full_like(nwp, -15.0), flow, np.stack([flow] * 3), -10.0)
    assert both.dry_forecast() and (combined.blended_member(both, [1, 2], 1) == -15.0).all()
    radar = combined.Blend(dry, nwp, 0 * flow, np.stack([flow] * 3), -10.0)
    assert radar.dry and not radar.dry_forecast() and np.allclose(radar.velocity, flow)
    assert csi(combined.blended_member(radar, [3], 1, [0])[0], nwp[0, 3], -10.0) > 0.3
    model = combined.Blend(db(frames[5:8]), np.full_like(nwp, -15.0), flow, np.stack([flow] * 3), -10.0)
    assert (combined.blended_member(model, [1], 1, [0]) > -10).any()
    missing = combined.Blend(np.where(np.arange(N) < 10, np.nan, db(frames[5:8])), nwp, flow, np.stack([flow] * 3), -10.0)
    assert np.isfinite(combined.blended_member(missing, [1, 2], 1, [0])).all()


def test_weights_of_components():
    skills = np.array([[0.9, 0.5], [0.6, 0.4]])
    w, rest = combined.component_weights(skills)
    assert np.allclose((w * w).sum(0) + rest**2, 1.0)
    one, noise = combined.component_weights(skills[:1])
    assert np.allclose(one, skills[:1]) and np.allclose(noise, 1 - skills[0])
    spn, _ = combined.component_weights(skills, "spn", np.stack([np.eye(2)] * 2))
    assert np.allclose(spn, skills)
    assert combined.end_ramp(w, 5, 3, 5)[1].tolist() == [1.0, 1.0] and np.allclose(combined.end_ramp(w, 3, 3, 5), w)
    assert combined.members_of(4, 3) == [[0], [1], [2], [0]] and combined.members_of(1, 2, True) == [[0, 1]]


def test_kalman_forecast(rain):
    frames, flow = rain
    nwp = models_of(frames, 7, 5, 4)
    models = {k: nwp[:, k] for k in (1, 2, 3)}
    got = combined.kalman_forecast(db(frames[5:8]), flow, models, [1, 2, 3], -10.0, 4)
    assert got.shape == (4, 3, N, N) and np.isfinite(got).all() and csi(got[0, 2], db(frames[10]), -10.0) > 0.4
    assert not np.array_equal(got[0], got[1])
    again = combined.kalman_forecast(db(frames[5:8]), flow, models, [1, 2, 3], -10.0, 4)
    assert np.array_equal(got, again)
    dry = combined.kalman_forecast(np.full((3, N, N), -15.0), flow, models, [2], -10.0, 4)
    assert np.array_equal(dry[:, 0], nwp[:, 2])  # the radar is dry: the models alone
    late = combined.kalman_forecast(db(frames[5:8]), flow, models, [1, 3], -10.0, 4, full_model_from=3)
    assert np.array_equal(late[:, 1], nwp[:, 3])
    assert combined.rain_case(db(frames[5:8]), nwp * 0 - 15, -10.0) == "nwp"


def test_times_of_corrections():
    assert combined.correction_steps([-10, -5, 0], [0, 15, 30, 45], 0, 30, 5) == [0, 3, 6]
    for observed, modelled in (([-10, -3, 0], [0, 15]), ([-20, -10, 0], [0, 15]), ([-5, 0], [0, 15, 20]), ([-5, 0], [2, 7])):
        with pytest.raises(ValueError):
            combined.correction_steps(observed, modelled, 0, 30, 5)


def test_members_dont_depend_on_groups(spark, rain):
    frames, flow = rain
    df = spark.createDataFrame([(0, k, N, N, [float(v) for v in db(f).ravel()]) for k, f in enumerate(frames[5:8])], "case int, t int, ny int, nx int, data array<double>")
    stacks = forecast.frame_stacks(df, 3)
    flows = stacks.select("case", "ny", "nx", *[F.transform("stack", lambda _, v=v: F.lit(v)).alias(c) for c, v in (("u", 2.0), ("v", 1.0))]).withColumns({c: F.slice(c, 1, N * N) for c in "uv"})
    runs = spark.createDataFrame([(0, m, k, [float(v) for v in f.ravel()]) for m, run in enumerate(models_of(frames, 7, 3, 2)) for k, f in enumerate(run)], "case int, model int, step int, data array<double>")
    for make in (lambda n: forecast.nowcasts(stacks, flows, [1.0, 2.0], "steps", members=3, together=n), lambda n: forecast.blended_forecast(stacks, flows, runs, [1.0, 1.5], -10.0, members=3, together=n)):
        one, many = (sorted((r.member, r.lead, tuple(r.data)) for r in make(n).collect()) for n in (1, 3))
        assert repr(one) == repr(many) and len(one) == 6
    got = forecast.kalman_forecast(stacks, flows, runs.where("step > 0"), [1, 2], -10.0, 2).collect()
    assert len(got) == 4
    skills = forecast.model_skills(stacks, flows, runs.where("step = 0").drop("step"), -10.0).collect()
    assert len(skills) == 12 and all(0 < r.skill <= 1 for r in skills)
    assert forecast.blended_forecast(stacks.limit(0), flows, runs, [1.0], -10.0).count() == 0


def test_fraction_of_a_step_is_linear(rain):
    frames, flow = rain
    a, b, c = nowcast.sprog(db(frames[:8]), 0 * flow, [1, 1.5, 2], -10.0)
    assert np.allclose(b, (a + c) / 2)
    assert np.isnan(extrapolate(frames[0], flow, [1])[0][0][0, 0])
