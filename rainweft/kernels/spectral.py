"""Fourier kernels: spectra, scale decomposition and correlated noise on one raster."""

from __future__ import annotations

import numpy as np


def radius(shape: tuple[int, int]) -> np.ndarray:
    """Whole-number wavenumber of every place of a full, unshifted transform."""
    ky, kx = (np.fft.fftfreq(n) * n for n in shape)
    return np.hypot(ky[:, None], kx[None, :])


def rapsd(field: np.ndarray, normalise: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power averaged over rings of rounded radius."""
    power = np.abs(np.fft.fft2(field)) ** 2 / field.size
    # the shifted grid is centred at n // 2, which unshifted frequencies reproduce
    ring = np.round(radius(field.shape)).astype(int).ravel()
    n = max(field.shape) // 2 + max(field.shape) % 2
    keep = ring < n
    mean = np.bincount(ring[keep], power.ravel()[keep], n) / np.maximum(np.bincount(ring[keep], minlength=n), 1)
    if normalise:
        mean = mean / mean.sum()
    return np.arange(n) / max(field.shape), mean


def _half_weights(width: int) -> np.ndarray:
    """How often each column of a half spectrum stands in the full one."""
    w = np.full(width // 2 + 1, 2.0)
    w[0] = 1.0
    if width % 2 == 0:
        w[-1] = 1.0
    return w


def spectral_mean(half: np.ndarray, shape: tuple[int, int]) -> float:
    return float(half[0, 0].real / (shape[0] * shape[1]))


def spectral_std(half: np.ndarray, shape: tuple[int, int]) -> float:
    power = (np.abs(half) ** 2 * _half_weights(shape[1])).sum() - abs(half[0, 0]) ** 2
    return float(np.sqrt(max(power, 0.0)) / (shape[0] * shape[1]))


def spectral_corr(a: np.ndarray, b: np.ndarray, shape: tuple[int, int]) -> float:
    w = _half_weights(shape[1])
    dot = lambda p, q: float(((p * np.conj(q)).real * w).sum() - (p[0, 0] * np.conj(q[0, 0])).real)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def band_weights(shape: tuple[int, int], levels: int, scale: float = 0.5) -> np.ndarray:
    """``levels`` Gaussian bands, evenly spaced in the logarithm of the radius and summing to 1; the mean is in the first."""
    if levels < 3:
        raise ValueError("a decomposition needs three levels or more")
    r = radius(shape)[:, : shape[1] // 2 + 1]
    longest = max(shape)
    q = (0.5 * longest) ** (1.0 / levels)
    place = np.log(np.maximum(r, 1e-9)) / np.log(q)
    edges = q ** np.arange(levels + 1)
    centres = np.log((edges[:-1] + edges[1:]) / 2) / np.log(q)
    w = np.exp(-((place[None] - centres[:, None, None]) ** 2) / (2 * scale * scale))
    w[:, 0, 0] = 0.0
    w[0, 0, 0] = 1.0
    return w / w.sum(0)


def decompose(field: np.ndarray, weights: np.ndarray, normalise: bool = True, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels (normalised), their means and standard deviations."""
    half = np.fft.rfft2(field)
    levels = np.stack([np.fft.irfft2(half * w, field.shape) for w in weights])
    inside = levels if mask is None else levels[:, mask]
    axes = (1, 2) if mask is None else (1,)
    mu, sigma = inside.mean(axes), inside.std(axes)
    if normalise:
        levels = (levels - mu[:, None, None]) / np.where(sigma > 0, sigma, 1.0)[:, None, None]
    return levels, mu, sigma


def recompose(levels: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return (levels * sigma[:, None, None] + mu[:, None, None]).sum(0)


def taper(shape: tuple[int, int], alpha: float = 0.2) -> np.ndarray:
    """Tukey taper of the elliptical radius."""
    y, x = ((np.arange(n) - (n - 1) / 2) / n for n in shape)
    r = np.hypot(y[:, None], x[None, :])
    flank = 0.5 * (1 + np.cos(np.pi * (r / (alpha / 2) - 1 / alpha + 1)))
    return np.where(r < 0.5 * (1 - alpha), 1.0, np.where(r > 0.5, 0.0, flank))


def field_filter(fields: np.ndarray, tapered: bool = True) -> np.ndarray:
    """Mean Fourier amplitude of one or more fields: a filter that gives noise their texture."""
    fields = np.atleast_3d(fields.T).T if fields.ndim == 2 else fields
    w = taper(fields.shape[1:]) if tapered else 1.0
    amplitude = np.mean([np.abs(np.fft.rfft2((f - f.min()) * w)) for f in fields], 0)
    amplitude[0, 0] = 0.0
    return amplitude


def power_law_filter(field: np.ndarray) -> np.ndarray:
    """Isotropic filter from a broken power law fitted to the radial spectrum in log-log by least squares."""
    freq, power = rapsd(field - field.mean())
    good = (freq > 0) & (power > 0)
    lx, ly = np.log(freq[good]), np.log(power[good])
    best = None
    for k in range(2, max(3, len(lx) - 2)):
        a = np.stack([np.ones_like(lx), lx, np.maximum(lx - lx[min(k, len(lx) - 1)], 0)], 1)
        coef, rest, *_ = np.linalg.lstsq(a, ly, rcond=None)
        miss = float(((a @ coef - ly) ** 2).sum())
        if best is None or miss < best[0]:
            best = (miss, lx[min(k, len(lx) - 1)], coef)
    r = radius(field.shape)[:, : field.shape[1] // 2 + 1] / max(field.shape)
    lr = np.log(np.maximum(r, 1e-9))
    out = np.exp(0.5 * (best[2][0] + best[2][1] * lr + best[2][2] * np.maximum(lr - best[1], 0)))
    out[0, 0] = 0.0
    return out


def noise(amplitude: np.ndarray, shape: tuple[int, int], rng: np.random.RandomState) -> np.ndarray:
    """White noise through a filter, brought to mean 0 and deviation 1."""
    n = np.fft.irfft2(np.fft.rfft2(rng.standard_normal(shape)) * amplitude, shape)
    sd = n.std()
    return (n - n.mean()) / (sd if sd > 0 else 1.0)


def windows(n: int, size: int, overlap: float = 0.3) -> list[tuple[int, int]]:
    """Overlapping ranges that cover ``n`` places."""
    step = max(1, int(size * (1 - overlap)))
    starts = list(range(0, max(1, n - size + 1), step))
    if starts[-1] + size < n:
        starts.append(n - size)
    return [(max(0, s), min(n, s + size)) for s in starts]


def local_filters(field: np.ndarray, size: int = 128, overlap: float = 0.3, least_wet: float = 0.1, thr: float | None = None) -> list[tuple[tuple[int, int], tuple[int, int], np.ndarray]]:
    """A filter per window; windows with little rain take the whole field's."""
    thr = field.min() if thr is None else thr
    whole = field_filter(field)
    out = []
    for y in windows(field.shape[0], size, overlap):
        for x in windows(field.shape[1], size, overlap):
            mask = np.zeros(field.shape)
            mask[y[0] : y[1], x[0] : x[1]] = taper((y[1] - y[0], x[1] - x[0])) + 1e-6
            wet = (field[y[0] : y[1], x[0] : x[1]] > thr).mean()
            out.append((y, x, field_filter((field - field.min()) * mask, False) if wet > least_wet else whole))
    return out


def local_noise(filters: list, shape: tuple[int, int], rng: np.random.RandomState) -> np.ndarray:
    """One white field through each window's filter, merged by the windows' tapers."""
    white = np.fft.rfft2(rng.standard_normal(shape))
    total, weight = np.zeros(shape), np.zeros(shape)
    for y, x, amplitude in filters:
        n = np.fft.irfft2(white * amplitude, shape)
        n = (n - n.mean()) / (n.std() or 1.0)
        m = taper((y[1] - y[0], x[1] - x[0])) + 1e-6
        total[y[0] : y[1], x[0] : x[1]] += n[y[0] : y[1], x[0] : x[1]] * m
        weight[y[0] : y[1], x[0] : x[1]] += m
    out = total / weight
    return (out - out.mean()) / (out.std() or 1.0)


def smooth(field: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean with mirrored edges, separable; one shifted sum per tap."""
    if sigma <= 0:
        return field
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n = field.shape[axis]
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(field, pad, mode="symmetric" if r <= n else "reflect" if r < n else "edge")
        out = np.zeros(field.shape)
        for i, w in enumerate(k):
            out += w * (p[i : i + n] if axis == 0 else p[:, i : i + n])
        field = out
    return field


def uniform_weights(shape: tuple[int, int], levels: int = 1) -> np.ndarray:
    """One band that holds everything."""
    return np.ones((1, shape[0], shape[1] // 2 + 1))


def nested_filters(field: np.ndarray, depth: int = 3, least_wet: float = 0.1, thr: float | None = None) -> np.ndarray:
    """Amplitude filter for every cell block of a quadtree: each level halves the windows.

    A window with enough rain replaces its parent's filter for the wavelengths it
    can hold; others keep the parent's. Returns (2^depth, 2^depth, ky, kx).
    """
    thr = field.min() if thr is None else thr
    whole = field_filter(field)
    out = np.broadcast_to(whole, (1, 1, *whole.shape)).copy()
    r = radius(field.shape)[:, : field.shape[1] // 2 + 1]
    for level in range(1, depth + 1):
        n = 2**level
        out = out.repeat(2, 0).repeat(2, 1)
        ys, xs = (np.linspace(0, m, n + 1).astype(int) for m in field.shape)
        fits = r >= n  # waves that fit into the window
        for i in range(n):
            for j in range(n):
                part = field[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
                if part.size and (part > thr).mean() > least_wet:
                    mask = np.zeros(field.shape)
                    mask[ys[i] : ys[i + 1], xs[j] : xs[j + 1]] = taper(part.shape) + 1e-6
                    own = field_filter((field - field.min()) * mask, False)
                    size = out[i, j][fits].mean() / (own[fits].mean() or 1.0)
                    out[i, j] = np.where(fits, own * size, out[i, j])
    return out


def nested_noise(filters: np.ndarray, shape: tuple[int, int], rng: np.random.RandomState) -> np.ndarray:
    """One white field through the filter of each block, merged block by block."""
    white = np.fft.rfft2(rng.standard_normal(shape))
    n, m = filters.shape[:2]
    ys, xs = np.linspace(0, shape[0], n + 1).astype(int), np.linspace(0, shape[1], m + 1).astype(int)
    out = np.empty(shape)
    for i in range(n):
        for j in range(m):
            f = np.fft.irfft2(white * filters[i, j], shape)
            f = (f - f.mean()) / (f.std() or 1.0)
            out[ys[i] : ys[i + 1], xs[j] : xs[j + 1]] = f[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
    return (out - out.mean()) / (out.std() or 1.0)


def noise_adjustments(field: np.ndarray, threshold: float, least: float, weights: np.ndarray, n: int = 20, seed: int = 1, conditional: bool = True) -> np.ndarray:
    """Per level, by how much the noise must be scaled so that rain made of it varies like the field.

    Noise takes the mean and deviation of the wet values and is cut at the
    threshold; the ratio of the level deviations of field and noise is averaged
    over ``n`` seeded fields. ``conditional``: deviations over wet cells only.
    """
    wet = field >= threshold
    if not wet.any():
        return np.ones(len(weights))
    mu, sd = field[wet].mean(), field[wet].std()
    texture = field_filter(field)
    own = decompose(np.where(wet, field, least), weights, normalise=False, mask=wet if conditional else None)[2]
    ratios = []
    for k in range(n):
        f = noise(texture, field.shape, np.random.RandomState(seed + k)) * sd + mu
        f = np.where(f < threshold, least, f)
        inside = f >= threshold
        if not inside.any():
            continue
        got = decompose(f, weights, normalise=False, mask=inside if conditional else None)[2]
        ratios.append(own / np.where(got > 0, got, np.inf))
    return np.mean(ratios, 0) if ratios else np.ones(len(weights))


def gaussianised(field: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Standard normal draws in the order of the field."""
    out = np.empty(field.size)
    out[np.argsort(field.ravel(), kind="stable")] = np.sort(rng.standard_normal(field.size))
    return out.reshape(field.shape)


def disc_kernel(factor: int, kind: str = "tophat") -> np.ndarray:
    """Smoothing kernel about as wide as a coarse cell: a disc of equal area, or a Gaussian of that radius."""
    r = max(1, int(round(factor / np.sqrt(np.pi))))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    if kind == "tophat":
        k = (y * y + x * x <= r * r).astype(float)
    elif kind == "gaussian":
        k = np.exp(-(y * y + x * x) / (2.0 * (r / 2) ** 2)) * (y * y + x * x <= r * r)
    else:
        raise ValueError(kind)
    return k / k.sum()


def balanced_average(field: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Mean under a kernel over the cells that are there; missing cells stay missing."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    there = np.isfinite(field).astype(float)
    total, weight = np.zeros(field.shape), np.zeros(field.shape)
    p, q = (np.pad(v, ((ry, ry), (rx, rx))) for v in (np.where(there > 0, field, 0.0), there))
    for (dy, dx), w in np.ndenumerate(kernel):
        if w:
            total += w * p[dy : dy + field.shape[0], dx : dx + field.shape[1]]
            weight += w * q[dy : dy + field.shape[0], dx : dx + field.shape[1]]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(there > 0, total / weight, np.nan)


def fused(low: np.ndarray, high: np.ndarray, factor: int) -> np.ndarray:
    """A fine field with the large waves of a coarse one and the small waves of noise.

    Waves that the coarse grid resolves take its phase and amplitude; beyond, the
    noise's spectrum continues at the level where the coarse one ends.
    """
    shape = high.shape
    coarse = np.kron(low, np.ones((factor, factor)))
    a, b = np.fft.rfft2(coarse - coarse.mean()), np.fft.rfft2(high - high.mean())
    r = radius(shape)[:, : shape[1] // 2 + 1]
    limit = min(low.shape) / 2.0
    ring = (r > 0.7 * limit) & (r <= limit)
    scale = np.sqrt((np.abs(a[ring]) ** 2).mean() / max((np.abs(b[ring]) ** 2).mean(), 1e-30)) if ring.any() else 1.0
    return np.fft.irfft2(np.where(r <= limit, a, b * scale), shape)


def rainfarm(
    coarse: np.ndarray, factor: int, alpha: float | None = None, rng: np.random.RandomState | None = None, threshold: float | None = None, kernel: str | None = None, fusion: bool = False
) -> tuple[np.ndarray, float]:
    """Finer field whose block means are the coarse values; and the spectral slope used.

    kernel (``tophat``, ``gaussian``): the correction of block means is smoothed,
    which keeps the means only nearly but leaves no edges. fusion: large waves
    come from the coarse field, brought to a normal distribution.
    """
    rng = rng or np.random.RandomState()
    if alpha is None:
        freq, power = rapsd(gaussianised(coarse, rng) if fusion else coarse)
        good = (freq > 0) & (power > 0)
        lx, ly = np.log(freq[good]), np.log(power[good])
        inner = (lx >= lx[0] + (lx[-1] - lx[0]) / 6) & (lx <= lx[-1] - (lx[-1] - lx[0]) / 6)
        inner = inner if inner.sum() >= 2 else np.ones_like(inner)
        alpha = abs(float(np.polyfit(lx[inner], ly[inner], 1)[0]))
    shape = tuple(n * factor for n in coarse.shape)
    ky, kx = np.fft.fftfreq(shape[0]), np.fft.rfftfreq(shape[1])
    k = np.hypot(ky[:, None], kx[None, :])
    k[0, 0] = np.inf
    g = noise(k ** (-alpha / 2), shape, rng)
    if fusion:
        g = fused(gaussianised(coarse, rng), g, factor)
        g = (g - g.mean()) / (g.std() or 1.0)
    fine = np.exp(g)
    if kernel:
        near = disc_kernel(factor, kernel)
        want = balanced_average(np.kron(coarse, np.ones((factor, factor))), near)
        fine *= want / balanced_average(fine, near)
    else:
        block = fine.reshape(coarse.shape[0], factor, coarse.shape[1], factor).mean((1, 3))
        fine *= np.kron(coarse / block, np.ones((factor, factor)))
    if threshold is not None:
        fine[fine < threshold] = 0.0
    return fine, alpha
