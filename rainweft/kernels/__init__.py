"""Numpy kernels that run on one raster per row inside Arrow batches."""
