"""Scattered points: declustering, outliers, interpolation onto grids.

Neighbour searches hash the plane into square buckets and look only at the
buckets around. Where a target finds too few points, the buckets are doubled for
it and the search goes on, so the nearest are found whatever their distance;
Spark keeps the best of each target before it shuffles the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainweft.workspace import written


def decluster(points: DataFrame, scale: float, min_samples: int = 1, values: Sequence[str] = ("u", "v")) -> DataFrame:
    """Medians of place and values per square of side ``scale`` that holds enough points."""
    by = [F.floor(F.col(c) / scale).cast("bigint").alias(f"b{c}_") for c in "xy"]
    cols = [F.percentile(F.col(c), 0.5).alias(c) for c in ("x", "y", *values)]
    return points.groupBy(*by).agg(F.count("*").alias("n"), *cols).where(F.col("n") >= min_samples).select("bx_", "by_", "x", "y", *values)


def global_outliers(points: DataFrame, thr: float, value: str) -> DataFrame:
    """Marks points whose z-score of ``value`` passes ``thr``; without spread none is."""
    m = points.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    mean, sd = m.select("m").scalar(), m.select("s").scalar()
    return points.withColumn("outlier", F.when(sd > 0, F.abs(F.col(value) - mean) / sd > thr).otherwise(F.lit(False)))


def global_outliers_2d(points: DataFrame, thr: float, a: str = "u", b: str = "v") -> DataFrame:
    """The same for two values by their Mahalanobis distance; a singular covariance marks none."""
    m = points.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("c"))
    g = {k: m.select(k).scalar() for k in ("ma", "mb", "va", "vb", "c")}
    det = g["va"] * g["vb"] - g["c"] * g["c"]
    da, db = F.col(a) - g["ma"], F.col(b) - g["mb"]
    d2 = (g["vb"] * da * da - 2 * g["c"] * da * db + g["va"] * db * db) / det
    return points.withColumn("outlier", F.when(det > 0, F.sqrt(d2) > thr).otherwise(F.lit(False)))


def global_outliers_nd(points: DataFrame, thr: float, values: Sequence[str]) -> DataFrame:
    """Marks points by their Mahalanobis distance over any number of values; a singular covariance marks none.

    Means and covariances are one aggregate; the inverse is of as many rows as there are values.
    """
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = points.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.covar_samp(values[i], values[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] if row[f"c{min(i, j)}_{max(i, j)}"] is not None else np.nan for j in range(k)] for i in range(k)], float)
    if not np.isfinite(c).all() or np.linalg.matrix_rank(c) < k:
        return points.withColumn("outlier", F.lit(False))
    inverse = np.linalg.inv(c)
    d = [F.col(v) - F.lit(float(row[f"m{i}"])) for i, v in enumerate(values)]
    d2 = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    return points.withColumn("outlier", F.coalesce(F.sqrt(F.greatest(d2, F.lit(0.0))) > thr, F.lit(False)))


def neighbours(points: DataFrame, targets: DataFrame, reach: float, target_keys: Sequence[str]) -> DataFrame:
    """Pairs of a target and the points within ``reach`` of it, by buckets of that side.

    Points carry ``(id, x, y, ...)``, targets ``target_keys`` and ``(gx, gy)``.
    """
    bucket = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = points.withColumn("o", around).withColumn("bx", bucket("x") + F.col("o.a")).withColumn("by", bucket("y") + F.col("o.b")).drop("o")
    t = targets.withColumn("bx", bucket("gx")).withColumn("by", bucket("gy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("gx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("gy"), F.lit(2.0)))
    return t.join(p, ["bx", "by"]).withColumn("d", d).where(F.col("d") <= reach).drop("bx", "by")


def nearest(points: DataFrame, targets: DataFrame, k: int, reach: float, target_keys: Sequence[str]) -> DataFrame:
    """``(target_keys, gx, gy, id, x, y, ..., d, r)``: the ``k`` nearest points of every target, r from 1 on; ties by id.

    reach is the first side of the buckets, best one in which some ``k`` points
    lie; it changes the time taken, not the result. All points come out where
    there are no more than ``k``; without points there are no rows.
    """
    enough = min(k, points.count())
    todo, found = targets.select(*target_keys, "gx", "gy"), None
    if not enough:
        return neighbours(points, todo, reach, target_keys).withColumn("r", F.lit(1)).limit(0)
    while True:
        near = neighbours(points, todo, reach, target_keys)
        near = near.withColumn("r", F.row_number().over(Window.partitionBy(*target_keys).orderBy("d", "id"))).where(F.col("r") <= enough)
        near = written(near, "near")
        full = near.where(F.col("r") == enough).select(*target_keys)
        part = near.join(full, list(target_keys), "left_semi")
        found = part if found is None else found.unionByName(part)
        todo = written(todo.join(full, list(target_keys), "left_anti"), "todo")
        if todo.isEmpty():
            return found
        reach *= 2


def local_outliers(points: DataFrame, thr: float, k: int, reach: float, value: str = "u") -> DataFrame:
    """z-score against the ``k`` nearest other points; without spread or neighbours none is marked. reach: see ``nearest``."""
    others = points.select("id", "x", "y", F.col(value).alias("w"))
    n = nearest(others, points.select(F.col("id").alias("gid"), F.col("x").alias("gx"), F.col("y").alias("gy")), k + 1, reach, ["gid"]).where("gid <> id")
    n = n.withColumn("r", F.row_number().over(Window.partitionBy("gid").orderBy("d", "id"))).where(F.col("r") <= k)
    s = n.groupBy(F.col("gid").alias("id")).agg(F.avg("w").alias("m"), F.stddev_pop("w").alias("s"))
    j = points.join(s, "id", "left")
    mark = F.coalesce(F.col("s") > 0, F.lit(False)) & F.coalesce(F.try_divide(F.abs(F.col(value) - F.col("m")), F.col("s")) > thr, F.lit(False))
    return j.withColumn("outlier", F.coalesce(mark, F.lit(False))).drop("m", "s")


def _grid_targets(grid: DataFrame) -> DataFrame:
    return grid.select(F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("x").cast("double").alias("gx"), F.col("y").cast("double").alias("gy"))


def idw(points: DataFrame, grid: DataFrame, value: str, k: int = 20, power: float = 0.5, offset: float = 0.5, reach: float = 50.0, resolution: float = 1.0) -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest points; null only where there are no points at all. reach: see ``nearest``."""
    t = _grid_targets(grid)
    n = nearest(points.select("id", "x", "y", F.col(value).alias("w")), t, k, reach, ["iy", "ix"])
    weight = 1 / F.pow(F.col("d") / resolution + offset, F.lit(float(power)))
    s = n.groupBy("iy", "ix").agg((F.sum(weight * F.col("w")) / F.sum(weight)).alias("v"))
    return t.join(s, ["iy", "ix"], "left").select(F.col("iy").alias("y"), F.col("ix").alias("x"), "v")


def rbf_nearest(points: DataFrame, grid: DataFrame, value: str, k: int = 50, epsilon: float = 1.0, smooth: float = 0.0, reach: float = 50.0) -> DataFrame:
    """Multiquadric interpolation from the ``k`` nearest points of each cell, for any number of points.

    Each cell solves its own small system, many in one call; with ``k`` from the
    number of points up the result is that of ``rbf``.
    """
    n = nearest(points.select("id", "x", "y", F.col(value).alias("w")), _grid_targets(grid), k, reach, ["iy", "ix"])
    packed = n.groupBy("iy", "ix").agg(F.array_sort(F.collect_list(F.struct("r", "x", "y", "w"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            gy, gx = b.column("iy").to_numpy().astype(float), b.column("ix").to_numpy().astype(float)
            cells = b.column("p").flatten()
            x, y, w = (cells.field(i).to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for i in (1, 2, 3))
            basis = lambda r: np.sqrt((r / epsilon) ** 2 + 1)
            system = basis(np.hypot(x[:, :, None] - x[:, None], y[:, :, None] - y[:, None])) - smooth * np.eye(x.shape[1])
            coef = np.einsum("nij,nj->ni", np.linalg.pinv(system), w)
            v = (basis(np.hypot(x - gx[:, None], y - gy[:, None])) * coef).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("iy"), b.column("ix"), pa.array(v)], names=["y", "x", "v"])

    return packed.mapInArrow(run, "y int, x int, v double")


def rbf(points: list[tuple[float, float, float]], grid: DataFrame, epsilon: float | None = None, smooth: float = 0.0) -> DataFrame:
    """Multiquadric interpolation of a point set that the caller bounds, in one dense solve on the driver.

    For more than 4,000 points use ``rbf_nearest``, which has no such system.
    """
    if len(points) > 4000:
        raise ValueError("the system of a radial basis has a row per point; use rbf_nearest")
    p = np.array(points, float)
    xy, w = p[:, :2], p[:, 2]
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    eps = epsilon or float(d[d > 0].mean()) if len(p) > 1 else 1.0
    coef = np.linalg.lstsq(np.sqrt((d / eps) ** 2 + 1) - smooth * np.eye(len(p)), w, rcond=None)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, x = b.column(0).to_numpy().astype(float), b.column(1).to_numpy().astype(float)
            r = np.hypot(x[:, None] - xy[None, :, 0], y[:, None] - xy[None, :, 1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((r / eps) ** 2 + 1) @ coef)], names=["y", "x", "v"])

    return grid.select("y", "x").mapInArrow(run, "y int, x int, v double")
