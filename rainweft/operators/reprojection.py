"""Rasters brought to another grid, of another projection if need be, by the nearest cell."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rainweft.functions.projections import Projection


def source_cells(source: dict, target: dict, shape: tuple[int, int], target_shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the source cell that holds each target centre; -1 outside.

    Grids have projection, x1, y1, xpixelsize, ypixelsize and yorigin.
    """
    ny, nx = target_shape
    x = target["x1"] + (np.arange(nx) + 0.5) * target["xpixelsize"]
    y = target["y1"] + (np.arange(ny) + 0.5) * target["ypixelsize"]
    y = y[::-1] if target.get("yorigin", "upper") == "upper" else y
    gx, gy = np.meshgrid(x, y)
    if source["projection"] != target["projection"]:
        gx, gy = Projection(source["projection"]).forward(*Projection(target["projection"]).inverse(gx, gy))
    col = np.floor((gx - source["x1"]) / source["xpixelsize"])
    row = np.floor((gy - source["y1"]) / source["ypixelsize"])
    if source.get("yorigin", "upper") == "upper":
        row = shape[0] - 1 - row
    inside = (col >= 0) & (col < shape[1]) & (row >= 0) & (row < shape[0]) & np.isfinite(col) & np.isfinite(row)
    return np.where(inside, row, -1).astype(int), np.where(inside, col, -1).astype(int)


def cell_map(spark: SparkSession, source: dict, target: dict, shape: tuple[int, int], target_shape: tuple[int, int]) -> DataFrame:
    """``(y, x, sy, sx)``: the source cell of each target cell inside the source, as a table to join cell rows with."""
    row, col = source_cells(source, target, shape, target_shape)
    at = np.argwhere(row >= 0)
    return spark.createDataFrame([(int(y), int(x), int(row[y, x]), int(col[y, x])) for y, x in at], "y int, x int, sy int, sx int")


def reproject_grids(tensors: DataFrame, source: dict, target: dict, target_shape: tuple[int, int], keys: Sequence[str] = ("t",)) -> DataFrame:
    """``(keys, ny, nx, data)`` on the target grid: each cell takes the source cell that its centre lies in, null outside.

    The places are worked out once per task and shape; a raster is one gather.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                shape = (b.column("ny")[i].as_py(), b.column("nx")[i].as_py())
                if shape not in known:
                    row, col = source_cells(source, target, shape, target_shape)
                    known[shape] = np.where(row >= 0, row * shape[1] + col, -1).ravel()
                at = known[shape]
                data = b.column("data")[i].values.take(pa.array(at, mask=at < 0))
                kept = [b.column(k).slice(i, 1) for k in keys]
                size = [pa.array([n], pa.int32()) for n in target_shape]
                yield pa.RecordBatch.from_arrays([*kept, *size, pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), data)], names=[*keys, "ny", "nx", "data"])

    types = ", ".join(f"`{k}` {tensors.schema[k].dataType.simpleString()}" for k in keys)
    return tensors.select(*keys, "ny", "nx", "data").mapInArrow(run, f"{types}, ny int, nx int, data array<double>")
