"""Forecast operators: one raster stack per row, kernels in Arrow batches.

The last few frames of a case are packed into one row, members are exploded
with their own seeds, and every member is computed alone, so a case with many
members spreads over tasks. A stack holds ``order + 1`` frames, whatever the
length of the archive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.kernels import assimilation, combined, features, masks, motion, nowcast, spectral


def frame_stacks(tensors: DataFrame, n: int, keys: Sequence[str] = ("case",)) -> DataFrame:
    """``(keys..., ny, nx, stack)``: the last ``n`` frames of each case, oldest first."""
    last = tensors.groupBy(*keys).agg(F.max("t").alias("last"))
    recent = tensors.join(last, list(keys)).where(F.col("t") > F.col("last") - n)
    packed = F.array_sort(F.collect_list(F.struct("t", "data")))
    out = recent.groupBy(*keys).agg(F.max("ny").alias("ny"), F.max("nx").alias("nx"), packed.alias("p"))
    return out.select(*keys, "ny", "nx", F.flatten(F.transform("p", lambda s: s["data"])).alias("stack"))


def rolling_stacks(tensors: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., case, ny, nx, stack)``: frames case - n + 1 .. case for every frame that has all of them, oldest first."""
    each = tensors.withColumn("case", F.explode(F.sequence(F.col("t"), F.col("t") + (n - 1))))
    packed = F.array_sort(F.collect_list(F.struct("t", "data")))
    out = each.groupBy(*keys, "case").agg(F.max("ny").alias("ny"), F.max("nx").alias("nx"), packed.alias("p")).where(F.size("p") == n)
    return out.select(*keys, "case", "ny", "nx", F.flatten(F.transform("p", lambda s: s["data"])).alias("stack"))


def _rasters(batch: pa.RecordBatch, column: str = "stack") -> Iterator[np.ndarray]:
    ny, nx = batch.column("ny").to_numpy(), batch.column("nx").to_numpy()
    col = batch.column(column)
    for i in range(batch.num_rows):
        flat = np.asarray(col[i].values.to_numpy(zero_copy_only=False), float)
        yield flat.reshape(-1, ny[i], nx[i])


def _emit(batch: pa.RecordBatch, rows: list[int], keys: Sequence[str], extra: dict[str, list]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keys], *[pa.array(v) if not isinstance(v, pa.Array) else v for v in extra.values()]], names=[*keys, *extra])


def _lists(rasters: np.ndarray) -> pa.Array:
    """One list per raster; cells that aren't finite are null."""
    flat = np.asarray(rasters, float).reshape(len(rasters), -1)
    ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), mask=~np.isfinite(flat.ravel())))


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def motion_fields(stacks: DataFrame, method: str = "lucaskanade", keys: Sequence[str] = ("case",)) -> DataFrame:
    """``(keys..., ny, nx, u, v)``: the flow of each stack."""
    if method not in motion.METHODS:
        raise ValueError(f"unknown motion method {method}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flows = [motion.METHODS[method](np.nan_to_num(s)) for s in _rasters(b)]
            yield _emit(b, list(range(b.num_rows)), [*keys, "ny", "nx"], {c: pa.array([f[k].ravel() for f in flows], pa.list_(pa.float64())) for k, c in enumerate("uv")})

    return stacks.select(*keys, "ny", "nx", "stack").mapInArrow(run, f"{_types(stacks, keys)}, ny int, nx int, u array<double>, v array<double>")


TOGETHER = 8  # members of a case that share one preparation


def nowcasts(stacks: DataFrame, flows: DataFrame, leads: Sequence[float], method: str = "steps", members: int = 1, seed: int = 1, threshold: float = -10.0, keys: Sequence[str] = ("case",), together: int = TOGETHER, **how) -> DataFrame:
    """``(keys..., member, lead, ny, nx, data)``. Each member's seed derives from ``seed`` and its number alone.

    Members go to tasks in groups of ``together``: alignment, scale decomposition
    and parameters are worked out once per group, and a case of many members is
    still spread. The result doesn't depend on the groups.
    """
    if method not in nowcast.METHODS:
        raise ValueError(f"unknown nowcast method {method}")
    if list(leads) != sorted(leads) or not leads:
        raise ValueError("leads must ascend")
    seeds = np.random.RandomState(seed).randint(0, 2**31 - 1, members).tolist()
    f = flows.select(*keys, "u", "v")
    groups = F.explode(F.sequence(F.lit(0), F.lit(max(members - 1, 0) // together)))
    rows = stacks.join(f, list(keys)).withColumn("part", groups).repartition(*keys, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b)):
                velocity = np.stack([np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float).reshape(s.shape[1:]) for c in "uv"])
                first = b.column("part")[i].as_py() * together
                mine = list(range(first, min(first + together, members)))
                shared = nowcast.SHARED.get(method)
                if shared:
                    got = shared(s, velocity, list(leads), threshold, [seeds[m] for m in mine], **how)
                else:
                    got = [nowcast.METHODS[method](s, velocity, list(leads), threshold=threshold, seed=seeds[m], **how) for m in mine]
                for m, fields in zip(mine, got):
                    yield _emit(b, [i] * len(leads), [*keys, "ny", "nx"], {"member": pa.array([m] * len(leads), pa.int32()), "lead": [float(x) for x in leads], "data": _lists(fields)})

    return rows.mapInArrow(run, f"{_types(stacks, keys)}, ny int, nx int, member int, lead double, data array<double>")


def decomposed(tensors: DataFrame, levels: int = 6, keys: Sequence[str] = ("case", "t")) -> DataFrame:
    """``(keys..., level, ny, nx, mu, sigma, data)``: normalised scale levels of each raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                parts, mu, sigma = spectral.decompose(s[0], spectral.band_weights(s.shape[1:], levels))
                yield _emit(b, [i] * levels, [*keys, "ny", "nx"], {"level": pa.array(range(levels), pa.int32()), "mu": mu.tolist(), "sigma": sigma.tolist(), "data": pa.array([p.ravel() for p in parts], pa.list_(pa.float64()))})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, ny int, nx int, level int, mu double, sigma double, data array<double>")


def spectral_lags(stacks: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("case",)) -> DataFrame:
    """``(keys..., lag, gamma)``: correlation of a stack's last frame with earlier ones, from their half spectra."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b)):
                half = np.fft.rfft2(s)
                got = [spectral.spectral_corr(half[-1], half[-1 - k], s.shape[1:]) for k in lags]
                yield _emit(b, [i] * len(got), keys, {"lag": pa.array(list(lags), pa.int32()), "gamma": pa.array(got, pa.float64())})

    return stacks.select(*keys, "ny", "nx", "stack").mapInArrow(run, f"{_types(stacks, keys)}, lag int, gamma double")


def radial_spectra(tensors: DataFrame, keys: Sequence[str] = ("case", "t")) -> DataFrame:
    """``(keys..., k, freq, power)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                freq, power = spectral.rapsd(s[0])
                yield _emit(b, [i] * len(freq), keys, {"k": pa.array(range(len(freq)), pa.int32()), "freq": freq.tolist(), "power": power.tolist()})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, k int, freq double, power double")


def storm_cells(tensors: DataFrame, keys: Sequence[str] = ("case", "t"), **how) -> DataFrame:
    """``(keys..., id, cen_x, cen_y, max_ref, area, xs, ys)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                cells, _ = features.storm_cells(s[0], **how)
                if cells:
                    kinds = {"id": pa.int32(), "cen_x": pa.int32(), "cen_y": pa.int32(), "max_ref": pa.float64(), "area": pa.int32(), "xs": pa.list_(pa.int32()), "ys": pa.list_(pa.int32())}
                    yield _emit(b, [i] * len(cells), keys, {k: pa.array([c[k] for c in cells], t) for k, t in kinds.items()})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, id int, cen_x int, cen_y int, max_ref double, area int, xs array<int>, ys array<int>")


def point_features(tensors: DataFrame, method: str = "shitomasi", keys: Sequence[str] = ("case", "t"), **how) -> DataFrame:
    """``(keys..., no, x, y)`` of corners or blobs, strongest first."""
    find = {"shitomasi": features.corners, "blob": features.blobs}[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                p = find(s[0], **how)
                if len(p):
                    yield _emit(b, [i] * len(p), keys, {"no": pa.array(range(len(p)), pa.int32()), "x": p[:, 0].tolist(), "y": p[:, 1].tolist()})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, no int, x double, y double")


def per_raster(tensors: DataFrame, kernel, keys: Sequence[str] = ("case", "t")) -> DataFrame:
    """``(keys..., ny, nx, data)``: each raster through a kernel from array to array of the same shape; missing cells are NaN there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = [kernel(s[0]) for s in _rasters(b, "data")]
                yield _emit(b, list(range(b.num_rows)), [*keys, "ny", "nx"], {"data": pa.concat_arrays([_lists(np.asarray(g)[None]) for g in got])})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, ny int, nx int, data array<double>")


def mask_windows(tensors: DataFrame, reach: float, threshold: float = 0.5, keys: Sequence[str] = ("case", "t")) -> DataFrame:
    """Tapers of the masks ``data >= threshold``: 0 outside, 1 from ``reach`` cells inside."""
    return per_raster(tensors, lambda f: masks.mask_window(np.nan_to_num(f, nan=-np.inf) >= threshold, reach), keys)


def soft_masks(tensors: DataFrame, threshold: float, padding: int, keys: Sequence[str] = ("case", "t"), **how) -> DataFrame:
    """Masks ``data >= threshold`` that fade outward over ``padding`` cells."""
    return per_raster(tensors, lambda f: masks.soft_mask(np.nan_to_num(f, nan=-np.inf) >= threshold, padding, **how), keys)


def noise_adjustments(tensors: DataFrame, threshold: float, levels: int = 6, n: int = 20, seed: int = 1, keys: Sequence[str] = ("case", "t")) -> DataFrame:
    """``(keys..., level, factor)``: by how much noise must be scaled per level; see the kernel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                f = s[0]
                least = float(np.nanmin(f)) if np.isfinite(f).any() else 0.0
                factors = spectral.noise_adjustments(np.nan_to_num(f, nan=least), threshold, least, spectral.band_weights(f.shape, levels), n, seed)
                yield _emit(b, [i] * levels, keys, {"level": pa.array(range(levels), pa.int32()), "factor": factors.tolist()})

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, level int, factor double")


def downscaled(tensors: DataFrame, factor: int, seed: int = 1, alpha: float | None = None, keys: Sequence[str] = ("case", "t"), **how) -> DataFrame:
    """``(keys..., ny, nx, alpha, data)`` on a grid ``factor`` times finer whose block means are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b, "data")):
                fine, a = spectral.rainfarm(s[0], factor, alpha, np.random.RandomState(seed), **how)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array([i])) for k in keys], pa.array([fine.shape[0]], pa.int32()), pa.array([fine.shape[1]], pa.int32()), pa.array([a]), pa.array([fine.ravel()], pa.list_(pa.float64()))], names=[*keys, "ny", "nx", "alpha", "data"])

    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{_types(tensors, keys)}, ny int, nx int, alpha double, data array<double>")


def blended_steps(stacks: DataFrame, flows: DataFrame, models: DataFrame, leads: Sequence[int], threshold: float, skill: Sequence[float], members: int = 1, seed: int = 1, keys: Sequence[str] = ("case",), **how) -> DataFrame:
    """Blend of nowcast and model; ``models`` is (keys..., stack) with one raster per lead."""
    seeds = np.random.RandomState(seed).randint(0, 2**31 - 1, members).tolist()
    rows = stacks.join(flows.select(*keys, "u", "v"), list(keys)).join(models.select(*keys, F.col("stack").alias("nwp")), list(keys))
    rows = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).repartition(*keys, "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (s, m) in enumerate(zip(_rasters(b), _rasters(b, "nwp"))):
                velocity = np.stack([np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float).reshape(s.shape[1:]) for c in "uv"])
                got = assimilation.blend_steps(s, m, velocity, list(leads), threshold, seeds[b.column("member")[i].as_py()], skill, **how)
                yield _emit(b, [i] * len(leads), [*keys, "member", "ny", "nx"], {"lead": [float(x) for x in leads], "data": pa.array([g.ravel() for g in got], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, f"{_types(stacks, keys)}, member int, ny int, nx int, lead double, data array<double>")


def blended_forecast(
    stacks: DataFrame, flows: DataFrame, models: DataFrame, leads: Sequence[float], threshold: float, members: int = 1, seed: int = 1, keys: Sequence[str] = ("case",), together: int = TOGETHER, blend_all: bool = False, options: dict | None = None, **how
) -> DataFrame:
    """``(keys..., member, lead, ny, nx, data)``: nowcast, models and noise blended scale by scale.

    models is ``(keys..., model, step, data)`` with step 0 at the time of the last
    frame; their flows are estimated from the first two steps. Each member takes
    one model in turn, or all with ``blend_all``. Members go to tasks in groups
    that share decompositions and skills. options: fields of the shared part
    (levels, order, climatology, weights_method, ...), how: of the members.
    """
    seeds = np.random.RandomState(seed).randint(0, 2**31 - 1, members).tolist()
    packed = F.array_sort(F.collect_list(F.struct("model", "step", "data")))
    runs = models.groupBy(*keys).agg(packed.alias("runs"))
    groups = F.explode(F.sequence(F.lit(0), F.lit(max(members - 1, 0) // together)))
    rows = stacks.join(flows.select(*keys, "u", "v"), list(keys)).join(runs, list(keys)).withColumn("part", groups).repartition(*keys, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b)):
                shape = s.shape[1:]
                velocity = np.stack([np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float).reshape(shape) for c in "uv"])
                cells = b.column("runs")[i].values
                model, data = cells.field(0).to_numpy(), cells.field(2)
                flat = np.stack([np.asarray(data[k].values.to_numpy(zero_copy_only=False), float).reshape(shape) for k in range(len(data))])
                nwp = np.stack([flat[model == m] for m in np.unique(model)])
                low = np.nanmin(nwp) if np.isfinite(nwp).any() else 0.0
                own_flows = np.stack([motion.dense_lucas_kanade(np.nan_to_num(m[:2], nan=low)) if len(m) > 1 else velocity for m in nwp])
                shared = combined.Blend(s, nwp, velocity, own_flows, threshold, **(options or {}))
                first = b.column("part")[i].as_py() * together
                of = combined.members_of(members, len(nwp), blend_all)
                for m in range(first, min(first + together, members)):
                    got = combined.blended_member(shared, list(leads), seeds[m], of[m], **how)
                    yield _emit(b, [i] * len(leads), [*keys, "ny", "nx"], {"member": pa.array([m] * len(leads), pa.int32()), "lead": [float(x) for x in leads], "data": _lists(got)})

    return rows.mapInArrow(run, f"{_types(stacks, keys)}, ny int, nx int, member int, lead double, data array<double>")


def model_skills(stacks: DataFrame, flows: DataFrame, models: DataFrame, threshold: float, keys: Sequence[str] = ("case",), levels: int = 6) -> DataFrame:
    """``(keys..., model, level, skill)``: how each model agrees with the last frame, for a store of daily skills.

    models is ``(keys..., model, data)``, one field each at the time of the last frame.
    """
    rows = models.select(*keys, "model", "data").join(stacks, list(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (s, m) in enumerate(zip(_rasters(b), _rasters(b, "data"))):
                weights = spectral.band_weights(s.shape[1:], levels)
                first, second = (spectral.decompose(np.nan_to_num(f, nan=np.nanmin(f) if np.isfinite(f).any() else 0.0), weights)[0] for f in (m[0], s[-1]))
                skill = combined.level_skill(first, second)
                yield _emit(b, [i] * levels, [*keys, "model"], {"level": pa.array(range(levels), pa.int32()), "skill": skill.tolist()})

    return rows.select(*keys, "model", "ny", "nx", "data", "stack").mapInArrow(run, f"{_types(stacks, keys)}, model {models.schema['model'].dataType.simpleString()}, level int, skill double")


def kalman_forecast(stacks: DataFrame, flows: DataFrame, models: DataFrame, leads: Sequence[int], threshold: float, members: int, seed: int = 1, keys: Sequence[str] = ("case",), **how) -> DataFrame:
    """``(keys..., member, lead, ny, nx, data)``: a nowcast ensemble corrected by model members as it goes.

    models is ``(keys..., model, step, data)``. The correction needs all members
    of a case at once, so a case is one row, whatever the archive holds.
    """
    packed = F.array_sort(F.collect_list(F.struct("step", "model", "data")))
    rows = stacks.join(flows.select(*keys, "u", "v"), list(keys)).join(models.groupBy(*keys).agg(packed.alias("runs")), list(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in enumerate(_rasters(b)):
                shape = s.shape[1:]
                velocity = np.stack([np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float).reshape(shape) for c in "uv"])
                cells = b.column("runs")[i].values
                step, data = cells.field(0).to_numpy(), cells.field(2)
                flat = np.stack([np.asarray(data[k].values.to_numpy(zero_copy_only=False), float).reshape(shape) for k in range(len(data))])
                got = combined.kalman_forecast(s, velocity, {int(t): flat[step == t] for t in np.unique(step)}, list(leads), threshold, members, seed, **how)
                for m in range(members):
                    yield _emit(b, [i] * len(leads), [*keys, "ny", "nx"], {"member": pa.array([m] * len(leads), pa.int32()), "lead": [float(x) for x in leads], "data": _lists(got[m])})

    return rows.mapInArrow(run, f"{_types(stacks, keys)}, ny int, nx int, member int, lead double, data array<double>")


def kalman_corrected(first: DataFrame, second: DataFrame, threshold: float, keys: Sequence[str] = ("case",), seed: int = 1) -> DataFrame:
    """Nowcast members corrected by model members: ``(keys..., member, ny, nx, data)``.

    All members of a case meet in one row, since the filter needs their joint
    covariance; a case is one raster per member, whatever the archive holds.
    """

    def packed(e: DataFrame, name: str) -> DataFrame:
        p = F.array_sort(F.collect_list(F.struct("member", "data")))
        return e.groupBy(*keys).agg(F.max("ny").alias(f"ny{name}"), F.max("nx").alias(f"nx{name}"), F.flatten(F.transform(p, lambda s: s["data"])).alias(name))

    rows = packed(first, "a").join(packed(second, "b"), list(keys)).select(*keys, F.col("nya").alias("ny"), F.col("nxa").alias("nx"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (x, m) in enumerate(zip(_rasters(b, "a"), _rasters(b, "b"))):
                got = assimilation.masked_correction(x, m, threshold, seed=seed)
                yield _emit(b, [i] * len(got), [*keys, "ny", "nx"], {"member": pa.array(range(len(got)), pa.int32()), "data": pa.array([g.ravel() for g in got], pa.list_(pa.float64()))})

    return rows.mapInArrow(run, f"{_types(first, keys)}, ny int, nx int, member int, data array<double>")
