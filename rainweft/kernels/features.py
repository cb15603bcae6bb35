"""Features of one raster: blobs, corners, storm cells."""

from __future__ import annotations

import numpy as np

from rainweft.kernels.spectral import smooth


def _peaks(f: np.ndarray, size: int) -> np.ndarray:
    """Places that are the largest of their square neighbourhood."""
    p = np.pad(f, size, constant_values=-np.inf)
    best = np.full_like(f, -np.inf)
    for dy in range(2 * size + 1):
        for dx in range(2 * size + 1):
            best = np.maximum(best, p[dy : dy + f.shape[0], dx : dx + f.shape[1]])
    return (f == best) & np.isfinite(f)


def blobs(field: np.ndarray, most: int | None = None, method: str = "log", threshold: float = 0.5, sigmas: tuple[float, ...] = (3, 5, 8, 12, 16, 20)) -> np.ndarray:
    """Rows (x, y, sigma) of scale-space maxima, strongest first. method: log, dog or doh."""
    f = np.nan_to_num(field, nan=np.nanmin(field))
    f = (f - f.min()) / (np.ptp(f) or 1.0) * 10
    stack = []
    for s in sigmas:
        g = smooth(f, s)
        gy, gx = np.gradient(g)
        yy, xy = np.gradient(gy)
        xx = np.gradient(gx, axis=1)
        stack.append(-(s**2) * (xx + yy) if method == "log" else (g - smooth(f, s * 1.6)) if method == "dog" else s**4 * (xx * yy - xy * xy))
    cube = np.stack(stack)
    found = []
    for k, layer in enumerate(cube):
        near = cube[max(0, k - 1) : k + 2].max(0)
        for y, x in np.argwhere(_peaks(layer, 2) & (layer >= near) & (layer > threshold)):
            found.append((layer[y, x], x, y, sigmas[k]))
    found.sort(key=lambda r: (-r[0], r[1], r[2]))
    return np.array([r[1:] for r in found[:most]], float).reshape(-1, 3)


def corners(field: np.ndarray, most: int = 1000, quality: float = 0.01, distance: int = 10, sigma: float = 2.0) -> np.ndarray:
    """Rows (x, y) where the smaller eigenvalue of the structure tensor peaks, at least ``distance`` apart; missing cells and their surroundings give none."""
    missing = ~np.isfinite(field)
    f = np.where(missing, np.nanmin(field) if (~missing).any() else 0.0, field)
    dy, dx = np.gradient(f)
    xx, yy, xy = smooth(dx * dx, sigma), smooth(dy * dy, sigma), smooth(dx * dy, sigma)
    least = 0.5 * (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy))
    if missing.any():
        least[smooth(missing.astype(float), sigma) > 1e-6] = 0
    at = np.argwhere(_peaks(least, 1) & (least > quality * least.max()) & (least > 0))
    order = np.argsort(-least[at[:, 0], at[:, 1]], kind="stable")
    kept: list[tuple[int, int]] = []
    for y, x in at[order]:
        if all((y - b) ** 2 + (x - a) ** 2 >= distance * distance for a, b in kept):
            kept.append((int(x), int(y)))
            if len(kept) == most:
                break
    return np.array(kept, float).reshape(-1, 2)


def label(mask: np.ndarray) -> np.ndarray:
    """Connected parts (eight neighbours), numbered from 1, by spreading the least number until nothing changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(lab > 0, lab, big), 1, constant_values=big)
        least = np.min([p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]] for dy in range(3) for dx in range(3)], 0)
        new = np.where(mask, least, 0)
        flat = new.ravel()
        hop = np.where(flat > 0, flat[np.maximum(flat - 1, 0)], 0).reshape(mask.shape)  # pointer jumping
        if (hop == lab).all():
            break
        lab = hop
    _, out = np.unique(lab, return_inverse=True)
    out = out.reshape(mask.shape)
    return out + (0 if (lab == 0).any() else 1)


def far_apart(peaks: np.ndarray, values: np.ndarray, distance: float) -> np.ndarray:
    """Keeps the strongest peaks that are at least ``distance`` from stronger ones."""
    kept: list[int] = []
    for i in np.argsort(-values, kind="stable"):
        if all(np.hypot(*(peaks[i] - peaks[j])) >= distance for j in kept):
            kept.append(int(i))
    return peaks[sorted(kept)]


def flood(field: np.ndarray, mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Watershed: cells of ``mask`` go to a seed, in the order of falling value."""
    out = np.zeros(field.shape, int)
    for k, (y, x) in enumerate(seeds, 1):
        out[y, x] = k
    for level in np.unique(field[mask])[::-1]:
        todo = mask & (field >= level) & (out == 0)
        while todo.any():
            p = np.pad(out, 1)
            near = np.max([p[dy : dy + field.shape[0], dx : dx + field.shape[1]] for dy in range(3) for dx in range(3)], 0)
            grow = todo & (near > 0)
            if not grow.any():
                break
            out[grow] = near[grow]
            todo &= out == 0
    return out


def storm_cells(field: np.ndarray, least: float = 35, most: float = 48, rise: float = 6, min_size: int = 50, min_peak: float = 41, distance: float = 10) -> tuple[list[dict], np.ndarray]:
    """Cells around peaks of a reflectivity field, and the raster of their numbers."""
    f = np.where(np.isfinite(field), np.minimum(field, most), -np.inf)
    areas = label(f >= least)
    out, number, cells = np.zeros(field.shape, int), 0, []
    for k in range(1, areas.max() + 1):
        area = areas == k
        if area.sum() < min_size or f[area].max() < min_peak:
            continue
        inside = np.where(area, f, -np.inf)
        peaks = np.argwhere(_peaks(smooth(np.where(area, f, least), 1.0), 2) & area & (inside >= max(min_peak, f[area].min() + rise)))
        if not len(peaks):
            peaks = np.argwhere(inside == inside.max())[:1]
        peaks = far_apart(peaks, inside[peaks[:, 0], peaks[:, 1]], distance)
        parts = flood(np.where(area, f, 0), area, peaks)
        for part in range(1, len(peaks) + 1):
            y, x = np.nonzero(parts == part)
            if not len(y):
                continue
            number += 1
            out[y, x] = number
            raw = field[y, x]
            cells.append({"id": number, "cen_x": int(np.round(x.mean())), "cen_y": int(np.round(y.mean())), "max_ref": float(raw.max()), "area": len(y), "xs": x.tolist(), "ys": y.tolist()})
    return cells, out
