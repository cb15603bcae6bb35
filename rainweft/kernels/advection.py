"""Backward semi-Lagrangian advection of one raster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def bilinear(field: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float | None) -> np.ndarray:
    """Values at fractional places; beyond the raster the nearest (None) or a constant."""
    ny, nx = field.shape
    cy, cx = np.clip(y, 0, ny - 1), np.clip(x, 0, nx - 1)
    y0, x0 = np.minimum(cy.astype(int), max(ny - 2, 0)), np.minimum(cx.astype(int), max(nx - 2, 0))
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    fy, fx = cy - y0, cx - x0
    out = (field[y0, x0] * (1 - fx) + field[y0, x1] * fx) * (1 - fy) + (field[y1, x0] * (1 - fx) + field[y1, x1] * fx) * fy
    # a missing neighbour of weight 0 doesn't count
    exact = (fy == 0) & (fx == 0)
    out = np.where(exact, field[y0, x0], out)
    if outside is not None:
        out = np.where((y < 0) | (y > ny - 1) | (x < 0) | (x > nx - 1), outside, out)
    return out


def displacement(velocity: np.ndarray, steps: Sequence[float], start: np.ndarray | None = None, rounds: int = 3):
    """Cumulated backward displacement (u, v) at each lead, by mid-point rounds within unit steps."""
    _, ny, nx = velocity.shape
    gy, gx = np.mgrid[0:ny, 0:nx].astype(float)
    d = np.zeros_like(velocity) if start is None else start.copy()
    now, out = 0.0, []
    for lead in steps:
        if lead < now:
            raise ValueError("leads must ascend")
        while now < lead - 1e-9:
            dt = min(1.0, lead - now)
            inc = np.stack([bilinear(c, gy + d[1], gx + d[0], None) for c in velocity]) * dt
            for _ in range(rounds):
                inc = np.stack([bilinear(c, gy + d[1] - inc[1] / 2, gx + d[0] - inc[0] / 2, None) for c in velocity]) * dt
            d = d - inc
            now += dt
        out.append(d.copy())
    return out


def extrapolate(field: np.ndarray, velocity: np.ndarray, steps: Sequence[float], outside: float = np.nan, order: int = 1, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Field at each lead and the last displacement. order 0: nearest cell, 1: bilinear. Missing cells stay missing where they go."""
    gy, gx = np.mgrid[0 : field.shape[0], 0 : field.shape[1]].astype(float)
    ds = displacement(velocity, steps, start)
    out = []
    for d in ds:
        y, x = gy + d[1], gx + d[0]
        if order == 0:
            y, x = np.round(y), np.round(x)
        out.append(bilinear(field, y, x, outside))
    return np.stack(out), ds[-1]
