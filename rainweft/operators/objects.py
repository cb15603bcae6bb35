"""Objects of rain fields and the scores made of them: structure, amplitude and location.

Objects are connected areas above a threshold. Their detection is a kernel per
raster; what follows are aggregates over object cells ``(keys..., id, y, x, v)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweft.kernels import features
from rainweft.operators.verification import ratio, sal_amplitude, sal_location1

FACTOR, QUANTILE = 0.067, 0.95  # of the threshold: a share of a quantile of the wet values


def object_thresholds(cells: DataFrame, keys: Sequence[str] = ("t",), factor: float = FACTOR, quantile: float = QUANTILE) -> DataFrame:
    """``(keys, thr)``: factor times the quantile of the values above the raster's minimum."""
    least = cells.groupBy(*keys).agg(F.min("v").alias("_least"))
    wet = cells.join(least, list(keys)).where(F.col("v") > F.col("_least"))
    return wet.groupBy(*keys).agg((F.percentile("v", quantile) * factor).alias("thr"))


def object_cells(cells: DataFrame, keys: Sequence[str] = ("t",), factor: float = FACTOR, quantile: float = QUANTILE, split: bool = False) -> DataFrame:
    """``(keys, id, y, x, v)``: the cells of every object.

    Objects are connected by sides or corners; with ``split`` an area of several
    peaks is parted among them. Missing cells belong to none; a raster without
    wet cells has no rows. One raster is one row of the kernel.
    """
    of = object_thresholds(cells, keys, factor, quantile)
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "v")).alias("cells")).join(of, list(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = b.column("cells")[i].values
                y, x, v = (c.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                field = np.full((y.max() + 1, x.max() + 1), np.nan)
                field[y, x] = v
                thr = b.column("thr")[i].as_py()
                with np.errstate(invalid="ignore"):
                    mask = field >= thr
                labels = features.label(mask) if mask.any() else np.zeros(field.shape, int)
                if split and mask.any():
                    labels = features.storm_cells(field, least=thr, most=np.inf, rise=thr, min_size=1, min_peak=thr, distance=5)[1]
                yy, xx = np.nonzero(labels)
                if len(yy):
                    at = pa.array(np.full(len(yy), i))
                    kept = [b.column(k).take(at) for k in keys]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(labels[yy, xx].astype(np.int32)), pa.array(yy.astype(np.int32)), pa.array(xx.astype(np.int32)), pa.array(field[yy, xx])], names=[*keys, "id", "y", "x", "v"])

    types = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return packed.select(*keys, "cells", "thr").mapInArrow(run, f"{types}, id int, y int, x int, v double")


def object_table(found: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, id, total, peak, area, cy, cx)``: mass, peak, size and centre of mass of each object."""
    mass = lambda c: F.try_divide(F.sum(F.col("v") * F.col(c)), F.sum("v"))
    return found.groupBy(*keys, "id").agg(F.sum("v").alias("total"), F.max("v").alias("peak"), F.count("*").alias("area"), mass("y").alias("cy"), mass("x").alias("cx"))


def scaled_volume(objects: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, volume)``: mean of mass over peak of the objects, weighted by mass."""
    return objects.groupBy(*keys).agg(F.try_divide(F.sum(F.try_divide(F.col("total") * F.col("total"), F.col("peak"))), F.sum("total")).alias("volume"))


def weighted_distance(objects: DataFrame, centres: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, distance)``: distance of the objects from the field's centre (my, mx), weighted by mass."""
    j = objects.join(centres, list(keys))
    d = F.sqrt(F.pow(F.col("cy") - F.col("my"), F.lit(2.0)) + F.pow(F.col("cx") - F.col("mx"), F.lit(2.0)))
    return j.groupBy(*keys).agg(F.try_divide(F.sum(F.col("total") * d), F.sum("total")).alias("distance"))


def centres_of_mass(cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    mass = lambda c: F.try_divide(F.sum(F.col("v") * F.col(c)), F.sum("v"))
    return cells.groupBy(*keys).agg(mass("y").alias("my"), mass("x").alias("mx"))


def sal_structure(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, structure)`` from the object tables of forecast and observation; null where one has no object."""
    a, b = scaled_volume(first, keys).withColumnRenamed("volume", "p"), scaled_volume(second, keys).withColumnRenamed("volume", "o")
    return a.join(b, list(keys), "full").select(*keys, ratio(F.col("p") - F.col("o"), 0.5 * (F.col("p") + F.col("o"))).alias("structure"))


def sal_location2(first: DataFrame, second: DataFrame, p_cells: DataFrame, o_cells: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, l2)``: difference of the weighted distances, as a share of half the diagonal."""
    a = weighted_distance(first, centres_of_mass(p_cells, keys), keys).withColumnRenamed("distance", "p")
    b = weighted_distance(second, centres_of_mass(o_cells, keys), keys).withColumnRenamed("distance", "o")
    return a.join(b, list(keys), "full").select(*keys, (2 * F.abs(F.col("o") - F.col("p")) / float((ny * ny + nx * nx) ** 0.5)).alias("l2"))


def sal(pairs: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("t",), factor: float = FACTOR, quantile: float = QUANTILE, split: bool = False) -> DataFrame:
    """``(keys, structure, amplitude, location)`` of pairs ``(keys, y, x, p, o)``.

    Scores that need objects are null where a field has none.
    """
    p, o = (pairs.select(*keys, "y", "x", F.col(c).alias("v")) for c in "po")
    first, second = (object_table(object_cells(c, keys, factor, quantile, split), keys) for c in (p, o))
    out = sal_amplitude(pairs, keys).join(sal_structure(first, second, keys), list(keys), "left")
    out = out.join(sal_location1(pairs, ny, nx, keys), list(keys), "left").join(sal_location2(first, second, p, o, ny, nx, keys), list(keys), "left")
    return out.select(*keys, "structure", "amplitude", (F.col("l1") + F.col("l2")).alias("location"))
