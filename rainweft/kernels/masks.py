"""Masks and distributions of one raster: distances, tapers, soft edges, shift and scale."""

from __future__ import annotations

import numpy as np

from rainweft.kernels.spectral import smooth


def edge_distances(mask: np.ndarray) -> np.ndarray:
    """Distance of every masked cell's centre from the nearest unmasked one; 0 outside the mask, infinite where all is masked."""
    ny, nx = mask.shape
    far = float(ny + nx) ** 2
    across = np.where(mask, far, 0.0)
    for x in range(1, nx):  # nearest along the row, from either side
        across[:, x] = np.minimum(across[:, x], across[:, x - 1] + 1)
    for x in range(nx - 2, -1, -1):
        across[:, x] = np.minimum(across[:, x], across[:, x + 1] + 1)
    rows = (np.arange(ny)[:, None] - np.arange(ny)[None, :]) ** 2
    square = np.min(rows[:, :, None] + np.minimum(across, far)[None] ** 2, axis=1)
    return np.where(mask.all(), np.inf, np.sqrt(square))


def mask_window(mask: np.ndarray, reach: float) -> np.ndarray:
    """Weight 0 outside the mask that rises to 1 by a cosine over ``reach`` cells inside it."""
    d = edge_distances(mask)
    return np.where(d >= reach, 1.0, 0.5 * (1 - np.cos(np.pi * np.minimum(d, reach) / reach)))


def soft_mask(mask: np.ndarray, padding: int = 0, blur: int = 9, inverted: bool = False, steps: int = 10, power: float = 1.0) -> np.ndarray:
    """A smoothed mask that fades outward over ``padding`` cells: the mean of ``steps`` growing dilations.

    blur: width of a Gaussian that rounds the outline first; with ``power`` other
    than 1 the fade isn't linear; ``inverted`` gives one minus the result.
    """
    m = np.asarray(mask, float)
    if blur > 1:
        m = (smooth(m, 0.3 * ((blur - 1) * 0.5 - 1) + 0.8) >= 0.5).astype(float)
    if padding > 0 and m.any() and not m.all():
        d = edge_distances(m == 0)
        reach = padding * np.arange(1, steps + 1) / steps
        m = np.mean([(d <= r) for r in reach], 0)
    m = m**power
    return 1 - m if inverted else m


def shift_scale(field: np.ndarray, scale_to, rain_share: float, second_moment: float, rounds: int = 60) -> tuple[float, float, np.ndarray]:
    """Shift and scale that give a transformed field a wet share and a second moment, and the field so changed.

    scale_to: function from the shifted and scaled field to rain. The shift puts
    the quantile of the dry share at 0; the scale is found by golden section on
    the distance of the second moments.
    """
    shift = -float(np.quantile(field, 1 - rain_share)) if 0 < rain_share < 1 else 0.0
    moved = field + shift

    def rain(scale: float) -> np.ndarray:
        return np.where(moved < 0, 0.0, scale_to(moved * scale))

    def miss(scale: float) -> float:
        return abs(np.log(max(float(np.mean(rain(scale) ** 2)), 1e-30)) - np.log(max(second_moment, 1e-30)))

    lo, hi = -7.0, 7.0  # powers of e
    g = (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = miss(np.exp(a)), miss(np.exp(b))
    for _ in range(rounds):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = miss(np.exp(a))
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = miss(np.exp(b))
    scale = float(np.exp((lo + hi) / 2))
    return shift, scale, rain(scale)
