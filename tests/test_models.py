"""Autoregressive fits, tracks, objects, masks, joins: against plain implementations and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweft.kernels import masks, spectral
from rainweft.operators import joins, objects, ranks, scattered, series, tracking, verification

CELLS = "t int, y int, x int, v double"


def raster(spark, a, key=None):
    rows = [(*((key,) if key is not None else ()), int(t), int(y), int(x), None if np.isnan(v) else float(v)) for (t, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ("case int, " if key is not None else "") + CELLS)


def process(shape, phi, seed, n=30):
    rng = np.random.RandomState(seed)
    out = [rng.standard_normal(shape), rng.standard_normal(shape)]
    for _ in range(n):
        out.append(phi[0] * out[-1] + phi[1] * out[-2] + 0.3 * rng.standard_normal(shape))
    return np.stack(out[2:])


def test_least_squares_of_cases(spark):
    a, b = process((12, 12), (0.6, 0.2), 1), process((12, 12), (0.3, 0.1), 2, 20)
    both = raster(spark, a, 0).unionByName(raster(spark, b, 1))
    got = {r.case: r for r in series.ols_fits(both, 2, ["case"]).collect()}
    for k, v in enumerate((a, b)):
        x = np.stack([v[1:-1].ravel(), v[:-2].ravel()], 1)
        want = np.linalg.lstsq(x, v[2:].ravel(), rcond=None)[0]
        assert np.allclose([got[k].phi_1, got[k].phi_2], want)
    sums = series.ols_sums(raster(spark, a), 2, constant=True).first().asDict()
    x = np.stack([np.ones(a[2:].size), a[1:-1].ravel(), a[:-2].ravel()], 1)
    assert np.allclose(series.ols_parameters(sums, 2, constant=True)[:3], np.linalg.lstsq(x, a[2:].ravel(), rcond=None)[0])
    with pytest.raises(ValueError):
        series.ols_fits(raster(spark, a), 3)


def test_lags_end_with_each_case(spark):
    a = process((8, 8), (0.6, 0.2), 3, 10)
    both = raster(spark, a, 0).unionByName(raster(spark, a[:7], 1))
    got = {(r.case, r.lag): r.gamma for r in series.lag_correlations(both, (1,), ["case"]).collect()}
    assert got[1, 1] == pytest.approx(np.corrcoef(a[6].ravel(), a[5].ravel())[0, 1]) and got[0, 1] == pytest.approx(np.corrcoef(a[9].ravel(), a[8].ravel())[0, 1])
    assert series.lag_correlations(both.limit(0), (1,), ["case"]).count() == 0


def test_vector_fits(spark):
    rng = np.random.RandomState(5)
    phi, x = np.array([[0.5, 0.2], [0.1, 0.4]]), [rng.standard_normal((2, 9, 9))]
    for _ in range(25):
        x.append(np.einsum("ij,jyx->iyx", phi, x[-1]) + 0.3 * rng.standard_normal((2, 9, 9)))
    x = np.stack(x)
    df = raster(spark, x[:, 0]).withColumn("var", F.lit(0)).unionByName(raster(spark, x[:, 1]).withColumn("var", F.lit(1)))
    rows = [(r.a_var, r.a_lag, r.b_var, r.b_lag, r.s, r.n) for r in series.var_sums(df, 1).collect()]
    found, rest = series.var_parameters(rows, 2, 1)
    assert np.allclose(found[0], phi, atol=0.05) and np.allclose(np.diag(rest), 0.09, atol=0.02)
    near = series.var_fits_localized(df, 1, 20.0, 2, window="uniform").where("y = 4 and x = 4").first()
    assert np.allclose(np.array(near.phi).reshape(2, 2), found[0])  # a window of everything
    g = np.stack([np.eye(2)[:, :, None].repeat(3, 2), np.array([[0.5, 0.2], [0.1, 0.4]])[:, :, None].repeat(3, 2)])
    assert np.allclose(series.var_yule_walker_localized(g)[0, :, :, 1], series.var_yule_walker([g[0, :, :, 0], g[1, :, :, 0]])[0])


def test_localized_fit_of_one_process(spark):
    a = process((14, 14), (0.5, 0.2), 7, 40)
    got = series.ols_fits_localized(raster(spark, a), 2, 30.0, window="uniform").collect()
    whole = series.ols_fits(raster(spark, a), 2).first()
    assert len(got) == 196 and all(r.phi_1 == pytest.approx(whole.phi_1) for r in got)
    assert series.ols_fits_localized(raster(spark, a).limit(0), 1, 2.0).count() == 0


def test_rank_matching_refuses_missing_values(spark):
    a, b = np.array([[[np.nan, 0.0, 2.0, 3.0]]]), np.array([[[0.0, 5.0, 6.0, 7.0]]])
    for first, second in ((a, b), (b, a), (b, b[:, :, :3])):
        with pytest.raises(Exception, match="can't be matched"):
            ranks.match_cdf(raster(spark, first), raster(spark, second)).collect()
    assert sorted(r.v for r in ranks.match_cdf(raster(spark, b), raster(spark, b + 1)).collect()) == [1.0, 6.0, 7.0, 8.0]


def test_moments_keep_their_digits(spark):
    rng = np.random.RandomState(1)
    p, o = rng.standard_normal(400) + 1e8, rng.standard_normal(400) + 1e8
    df = spark.createDataFrame([(k % 5, float(x), float(y)) for k, (x, y) in enumerate(zip(p, o))], "part int, p double, o double")
    parts = verification.moment_state(df, ["part"]).drop("part")
    got = verification.continuous_scores(verification.merge_moments(parts)).first()
    assert got.corr_p == pytest.approx(np.corrcoef(p, o)[0, 1], abs=1e-6) and got.me == pytest.approx((p - o).mean(), abs=1e-6)


FLOW = [(y, x, 1.0, 0.0) for y in range(8) for x in range(12)]


def labels_of(cells):
    return [(t, y, x, k) for t, ids in enumerate(cells) for k, places in ids.items() for y, x in places]


def test_tracks_carry_merge_and_split(spark):
    box = lambda y, x, h=2, w=2: [(y + i, x + j) for i in range(h) for j in range(w)]
    frames = [
        {1: box(0, 0), 2: box(4, 0, 1, 2)},
        {7: box(0, 1), 8: box(4, 1, 1, 2)},
        {3: box(0, 2), 4: box(6, 6)},  # 8 is gone, 4 is new
        {5: [*box(0, 3), *box(6, 7)]},  # both run into one
        {6: [(0, 4), (1, 4)], 9: box(6, 8), 11: [(0, 5), (1, 5)]},  # and break up again
    ]
    labels = spark.createDataFrame(labels_of(frames), "t int, y int, x int, id int")
    flow = spark.createDataFrame(FLOW, "y int, x int, u double, v double")
    got = {(r.t, r.id): r.track for r in tracking.tracks(labels, flow, 8, 12, match_share=0.3).collect()}
    assert len(got) == 10 and got[0, 1] == got[1, 7] == got[2, 3] == got[3, 5] and got[2, 4] != got[3, 5]
    assert got[3, 5] == got[4, 9]  # the larger share of the pixels
    assert len({got[4, 6], got[4, 11], got[4, 9]}) == 3
    kinds = {(r.t, r.id, r.next_id): r.kind for r in tracking.links(tracking.overlaps(tracking.advect_cells(labels, flow, 8, 12), labels), 0.3).collect()}
    assert kinds[3, 4, 5] == "merged" and kinds[3, 3, 5] == "carried" and kinds[4, 5, 6] == "split"
    assert {r.track for r in tracking.tracks(labels, flow, 8, 12, least=3, match_share=0.3).collect()} == {got[0, 1]}
    assert tracking.tracks(labels.limit(0), flow, 8, 12).count() == 0


def test_object_scores(spark):
    o = np.zeros((1, 16, 16))
    o[0, 3:6, 3:6] = 10.0
    o[0, 10:12, 9:14] = 5.0
    pairs = lambda p: raster(spark, p).withColumnRenamed("v", "p").join(raster(spark, o).withColumnRenamed("v", "o"), ["t", "y", "x"])
    same = objects.sal(pairs(o), 16, 16).first()
    assert (same.structure, same.amplitude, same.location) == (0.0, 0.0, 0.0)
    more = objects.sal(pairs(2 * o), 16, 16).first()
    assert more.amplitude == pytest.approx(2 / 3) and more.structure == pytest.approx(0.0) and more.location == pytest.approx(0.0)
    moved = objects.sal(pairs(np.roll(o, 2, 2)), 16, 16).first()
    assert moved.location == pytest.approx(2 / np.hypot(16, 16)) and moved.structure == pytest.approx(0.0)
    found = objects.object_table(objects.object_cells(raster(spark, o))).orderBy("total").collect()
    assert [(r.total, r.peak, r.area) for r in found] == [(50.0, 5.0, 10), (90.0, 10.0, 9)]
    flat = objects.sal(pairs(0 * o), 16, 16).first()  # no object in the forecast
    assert flat.structure is None and flat.amplitude == -2.0
    assert objects.sal(pairs(o).limit(0), 16, 16).count() == 0


def test_masks_and_distances():
    rng = np.random.RandomState(1)
    m = rng.random_sample((12, 15)) > 0.3
    y, x = np.nonzero(~m)
    want = np.array([[np.sqrt(((y - i) ** 2 + (x - j) ** 2).min()) for j in range(15)] for i in range(12)])
    assert np.allclose(masks.edge_distances(m), want) and np.isinf(masks.edge_distances(np.ones((3, 3), bool))).all()
    w = masks.mask_window(m, 2.0)
    assert w[~m].max() == 0 and w.min() >= 0 and w.max() <= 1
    hill = np.zeros((20, 20), bool)
    hill[8:12, 8:12] = True
    soft = masks.soft_mask(hill, 4, blur=1)
    assert soft[9, 9] == 1 and 0 < soft[9, 14] < soft[9, 12] < 1 and soft[0, 0] == 0 and np.allclose(masks.soft_mask(hill, 4, blur=1, inverted=True), 1 - soft)
    f = rng.standard_normal((40, 40))
    shift, scale, rain = masks.shift_scale(f, np.exp, 0.3, 5.0)
    assert (rain > 0).mean() == pytest.approx(0.3, abs=0.01) and (rain**2).mean() == pytest.approx(5.0, rel=1e-3)


def test_noise_and_downscaling():
    rng = np.random.RandomState(2)
    f = rng.gamma(1.0, 2.0, (32, 32))
    nested = spectral.nested_filters(f, 2)
    noise = spectral.nested_noise(nested, f.shape, rng)
    assert nested.shape == (4, 4, 32, 17) and abs(noise.mean()) < 1e-9 and noise.std() == pytest.approx(1.0)
    assert spectral.noise_adjustments(f * 0, 1.0, 0.0, spectral.band_weights(f.shape, 4)).tolist() == [1.0] * 4
    assert (spectral.noise_adjustments(f, 1.0, 0.0, spectral.band_weights(f.shape, 4), 5) > 0).all()
    for kernel in (None, "tophat", "gaussian"):
        fine, _ = spectral.rainfarm(f, 4, alpha=2.0, rng=np.random.RandomState(1), kernel=kernel, fusion=True)
        blocks = fine.reshape(32, 4, 32, 4).mean((1, 3))
        assert fine.shape == (128, 128) and (fine >= 0).all() and blocks.mean() == pytest.approx(f.mean(), rel=1e-9 if kernel is None else 0.12)
    holes = np.where(rng.random_sample((9, 9)) < 0.2, np.nan, 3.0)
    even = spectral.balanced_average(holes, spectral.disc_kernel(4))
    assert np.array_equal(np.isnan(even), np.isnan(holes)) and np.allclose(even[~np.isnan(even)], 3.0)


def test_neighbours_at_any_distance(spark):
    rng = np.random.RandomState(6)
    xy = np.concatenate([rng.uniform(0, 4, (60, 2)), rng.uniform(900, 1000, (5, 2))])
    pts = spark.createDataFrame([(k, float(x), float(y), float(k)) for k, (x, y) in enumerate(xy)], "id int, x double, y double, u double")
    grid = spark.createDataFrame([(y, x) for y in range(0, 40, 7) for x in range(0, 40, 7)], "y int, x int")
    got = {(r.y, r.x): r.v for r in scattered.idw(pts, grid, "u", 6, reach=0.5).collect()}
    for (y, x), v in got.items():
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y)
        near = np.argsort(d, kind="stable")[:6]
        w = 1 / (d[near] + 0.5) ** 0.5
        assert v == pytest.approx((w * near).sum() / w.sum())
    assert len(got) == 36
    few = pts.where("id < 3")
    assert all(r.v is not None for r in scattered.idw(few, grid, "u", 6, reach=0.5).collect())
    assert all(r.v is None for r in scattered.idw(pts.limit(0), grid, "u", 6, reach=0.5).collect())
    some = [(float(x), float(y), float(k)) for k, (x, y) in enumerate(xy[:20])]
    whole = {(r.y, r.x): r.v for r in scattered.rbf(some, grid, epsilon=3.0).collect()}
    local = {(r.y, r.x): r.v for r in scattered.rbf_nearest(pts.where("id < 20"), grid, "u", 50, 3.0, reach=2.0).collect()}
    assert all(local[k] == pytest.approx(v, rel=1e-3, abs=1e-3) for k, v in whole.items())


def test_asof_join(spark):
    rng = np.random.RandomState(4)
    at = lambda n: [int(k) for k in rng.randint(0, 400, n)]
    left = [(k, None if k % 7 == 0 else k % 2, t) for k, t in enumerate(at(60))]
    right = [(None if k % 5 == 0 else k % 2, t, k) for k, t in enumerate(at(50))]
    stamp = lambda df: df.withColumn("ts", F.timestamp_add("HOUR", F.col("h"), F.lit("2024-01-01").cast("timestamp_ntz"))).drop("h")
    a, b = stamp(spark.createDataFrame(left, "id int, g int, h int")), stamp(spark.createDataFrame(right, "g int, h int, v int"))
    got = {r.id: r.v for r in joins.asof_join(a, b, "ts", ["v"], ["g"]).collect()}
    best = lambda g, t: max(((h, v) for k, h, v in right if k == g and h <= t), default=(0, None))
    assert got == {k: best(g, t)[1] for k, g, t in left}
    near = {r.id: r.v for r in joins.asof_join(a, b, "ts", ["v"], ["g"], "20 hours").collect()}
    assert near == {k: (best(g, t)[1] if best(g, t)[1] is not None and t - best(g, t)[0] <= 20 else None) for k, g, t in left}
    assert joins.asof_join(a.limit(0), b, "ts", ["v"], ["g"]).count() == 0
    assert {r.v for r in joins.asof_join(a, b.limit(0), "ts", ["v"], ["g"]).collect()} == {None}
