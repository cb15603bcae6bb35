"""Parts of the feature-localised nowcast: windows about features, weighted fits, smoothing kernels and noise of a given shape."""

from __future__ import annotations

import math

import numpy as np


def window_weights(at: np.ndarray, shape: tuple[int, int], radius: float) -> np.ndarray:
    """Gaussian weight of every cell for each feature ``(x, y, ...)``; one feature weighs all cells alike."""
    if len(at) < 2:
        return np.ones((max(1, len(at)), *shape))
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    return np.exp(-((y[None] - at[:, 1, None, None]) ** 2 + (x[None] - at[:, 0, None, None]) ** 2) / (2 * radius * radius)) + 1e-12


def tukey_window(shape: tuple[int, int], centre: tuple[float, float], reach: tuple[float, float], alpha: float = 0.5) -> np.ndarray:
    """Separable window that is 1 near ``centre`` (y, x) and falls by a cosine to 0 at ``reach``."""

    def side(n: int, c: float, r: float) -> np.ndarray:
        d = np.abs(np.arange(n) - c) / max(r, 1e-9)
        flank = 0.5 * (1 + np.cos(np.pi * (d - (1 - alpha)) / alpha)) if alpha > 0 else np.zeros(n)
        return np.where(d <= 1 - alpha, 1.0, np.where(d >= 1, 0.0, flank))

    return side(shape[0], centre[0], reach[0])[:, None] * side(shape[1], centre[1], reach[1])[None]


def interpolated(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A field from one value per feature, by the features' weights."""
    good = np.isfinite(values)
    if not good.any():
        return np.zeros(weights.shape[1:])
    w = weights[good]
    return (w * values[good][:, None, None]).sum(0) / w.sum(0)


def ar1_of_features(changes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficient of each feature between the last two changes, by weighted least squares."""
    a, b = changes[-2], changes[-1]
    return np.clip((weights * a * b).sum((1, 2)) / np.maximum((weights * a * a).sum((1, 2)), 1e-12), -0.98, 0.98)


def ar2_of_features(changes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Both coefficients of each feature, kept inside the triangle of stationary processes."""
    out = []
    x1, x2, y = changes[-2], changes[-3], changes[-1]
    for w in weights:
        m = np.array([[(w * x1 * x1).sum(), (w * x1 * x2).sum()], [(w * x1 * x2).sum(), (w * x2 * x2).sum()]])
        p = np.linalg.lstsq(m, np.array([(w * x1 * y).sum(), (w * x2 * y).sum()]), rcond=1e-9)[0]
        p[1] = min(max(p[1], -0.98), 0.98)
        edge = 0.98 - p[1] if p[1] > -0.96 else 0.98
        p[0] = min(max(p[0], -edge), edge)
        out.append(p)
    return np.array(out)


def ellipse_box(angle: float, sigma1: float, sigma2: float, cutoff: float = 6.0) -> tuple[int, int]:
    """Half height and half width of the box about an ellipse of ``cutoff`` times the deviations, turned by ``angle``."""
    a, b = cutoff * sigma1, cutoff * sigma2
    c, s = math.cos(angle), math.sin(angle)
    return int(math.ceil(math.hypot(a * s, b * c))), int(math.ceil(math.hypot(a * c, b * s)))


def kernel(sigma1: float, sigma2: float | None = None, angle: float = 0.0, cutoff: float = 6.0) -> np.ndarray:
    """A Gaussian of sum 1, isotropic without ``sigma2``."""
    sigma2 = sigma1 if sigma2 is None else sigma2
    ry, rx = (max(1, r) for r in ellipse_box(angle, max(sigma1, 1e-3), max(sigma2, 1e-3), min(cutoff, 3.0)))
    y, x = np.mgrid[-ry : ry + 1, -rx : rx + 1]
    u, v = x * math.cos(angle) + y * math.sin(angle), -x * math.sin(angle) + y * math.cos(angle)
    k = np.exp(-0.5 * ((u / max(sigma1, 1e-3)) ** 2 + (v / max(sigma2, 1e-3)) ** 2))
    return k / k.sum()


def masked_convolution(field: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Mean under a kernel over the cells that are there, by the Fourier transform of a padded raster."""
    there = np.isfinite(field)
    shape = tuple(n + m - 1 for n, m in zip(field.shape, k.shape))
    spectrum = np.fft.rfft2(k, shape)
    at = tuple(slice(m // 2, m // 2 + n) for n, m in zip(field.shape, k.shape))
    conv = lambda f: np.fft.irfft2(np.fft.rfft2(f, shape) * spectrum, shape)[at]
    weight = conv(there.astype(float))
    return np.where(weight > 1e-6, conv(np.where(there, field, 0.0)) / np.maximum(weight, 1e-6), np.nan)


def composite_convolution(field: np.ndarray, kernels: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Convolutions by the kernel of each feature, merged by the features' weights."""
    total = weights.sum(0)
    return sum(w / total * np.nan_to_num(masked_convolution(field, k)) for w, k in zip(weights, kernels))


def fitted_kernels(before: np.ndarray, after: np.ndarray, weights: np.ndarray, anisotropic: bool = True, largest: float = 8.0, rounds: int = 18) -> list[np.ndarray]:
    """For each feature the kernel that brings one field nearest to the other, by weighted least squares.

    Deviations are found by golden section on a log scale; an anisotropic kernel
    tries four directions first, then stretches along the best.
    """

    def miss(k: np.ndarray, w: np.ndarray) -> float:
        return float((w * (np.nan_to_num(masked_convolution(before, k)) - after) ** 2).sum())

    def golden(cost) -> float:
        lo, hi, g = math.log(0.2), math.log(largest), (math.sqrt(5) - 1) / 2
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        fa, fb = cost(math.exp(a)), cost(math.exp(b))
        for _ in range(rounds):
            if fa <= fb:
                hi, b, fb = b, a, fa
                a = hi - g * (hi - lo)
                fa = cost(math.exp(a))
            else:
                lo, a, fa = a, b, fb
                b = lo + g * (hi - lo)
                fb = cost(math.exp(b))
        return math.exp((lo + hi) / 2)

    out = []
    for w in weights:
        s = golden(lambda v, w=w: miss(kernel(v), w))
        best = (miss(kernel(s), w), kernel(s))
        if anisotropic:
            angles = [math.pi * k / 4 for k in range(4)]
            angle = min(angles, key=lambda q: miss(kernel(s * 1.5, s / 1.5, q), w))  # noqa: B023
            long = golden(lambda v, w=w, q=angle: miss(kernel(v, s, q), w))
            found = miss(kernel(long, s, angle), w)
            if found < best[0]:
                best = (found, kernel(long, s, angle))
        out.append(best[1])
    return out


def sample_acf(field: np.ndarray) -> np.ndarray:
    """Autocorrelation by the spectrum; 1 at the origin, which is the first cell."""
    z = field - field.mean()
    a = np.fft.irfft2(np.abs(np.fft.rfft2(z)) ** 2, field.shape)
    return a / (a[0, 0] or 1.0)


def parametric_acf(shape: tuple[int, int], c: float, s1: float, s2: float, angle: float) -> np.ndarray:
    """c * exp(-r) of a turned and scaled distance r, 1 at the origin (the first cell)."""
    y, x = (np.fft.fftfreq(n) * n for n in shape)
    gx, gy = x[None, :], y[:, None]
    u, v = gx * math.cos(angle) + gy * math.sin(angle), -gx * math.sin(angle) + gy * math.cos(angle)
    a = c * np.exp(-np.sqrt((u / s1) ** 2 + (v / s2) ** 2))
    a[0, 0] = 1.0
    return a


def fitted_acf(acf: np.ndarray) -> tuple[float, float, float, float]:
    """c, both lengths and the angle of the exponential form nearest to a sampled autocorrelation.

    The quadratic form in the exponent is linear in its coefficients, so squared
    logarithms near the origin give it by least squares.
    """
    y, x = (np.fft.fftfreq(n) * n for n in acf.shape)
    gx, gy = np.broadcast_arrays(x[None, :], y[:, None])
    near = (np.hypot(gx, gy) <= max(4.0, min(acf.shape) / 8)) & (acf > 0.05) & (np.hypot(gx, gy) > 0)
    if near.sum() < 4:
        return 1.0, 1.0, 1.0, 0.0
    c = float(np.clip(acf[near][np.argsort(np.hypot(gx, gy)[near])[:4]].mean() * math.e**0.2, 0.05, 1.0))
    r2 = np.log(np.minimum(acf[near] / c, 0.999)) ** 2
    m = np.stack([gx[near] ** 2, 2 * gx[near] * gy[near], gy[near] ** 2], 1)
    a, b, d = np.linalg.lstsq(m, r2, rcond=None)[0]
    values, vectors = np.linalg.eigh(np.array([[a, b], [b, d]]))
    values = np.maximum(values, 1e-4)
    axis = vectors[:, 0]  # of the longer length
    return c, float(1 / math.sqrt(values[0])), float(1 / math.sqrt(values[1])), math.atan2(axis[1], axis[0])


def gaussian_correlation(rho: np.ndarray, sigma: float) -> np.ndarray:
    """Correlation of normal variables whose lognormal transforms (log deviation ``sigma``) correlate by ``rho``."""
    if sigma < 1e-6:
        return rho
    return np.log1p(np.maximum(rho, -0.99) * math.expm1(sigma * sigma)) / (sigma * sigma)


def lognormal_sigma(ratios: np.ndarray, weights: np.ndarray) -> float:
    """Log deviation of ratios of mean 1, weighted; the mean of the logarithms is minus half its square."""
    good = np.isfinite(ratios) & (ratios > 0) & (weights > 0)
    if good.sum() < 8:
        return float("nan")
    v = np.log(ratios[good])
    square = float((weights[good] * v * v).sum() / weights[good].sum())  # s^2 + s^4 / 4
    return math.sqrt(2 * (math.sqrt(1 + square) - 1))


def weighted_std(f: np.ndarray, w: np.ndarray) -> float:
    """Weighted deviation about 1 over the cells that aren't 1; NaN where there are none."""
    inside = np.isfinite(f) & (np.abs(f - 1) > 1e-4)
    return float(np.sqrt((w[inside] * (f[inside] - 1) ** 2).sum() / w[inside].sum())) if inside.any() and w[inside].sum() > 0 else float("nan")


def perturbation_parameters(observed: np.ndarray, hindcast: np.ndarray, weights: np.ndarray, threshold: float) -> list[dict]:
    """For each feature the log deviation and the spectrum of the error of a one-step hindcast."""
    wet = (observed > threshold) & (hindcast > threshold)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(wet, observed / hindcast, np.nan)
    out = []
    for w in weights:
        sigma = lognormal_sigma(ratio, np.where(wet, w, 0.0))
        error = np.where(wet, np.log(np.maximum(np.nan_to_num(ratio, nan=1.0), 1e-6)), 0.0) * w / w.max()
        acf = parametric_acf(observed.shape, *fitted_acf(sample_acf(error)))
        amplitude = np.sqrt(np.maximum(np.fft.rfft2(gaussian_correlation(acf, 0.0 if not np.isfinite(sigma) else sigma)).real, 0.0))
        out.append({"sigma": min(sigma, 1.5) if np.isfinite(sigma) else 0.0, "amplitude": amplitude})
    return out


def perturbations(parameters: list[dict], weights: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """A field of factors of mean 1: lognormal noise of each feature from one white field, merged by weights."""
    shape = weights.shape[1:]
    white = np.fft.rfft2(rng.standard_normal(shape))
    total, out = weights.sum(0), np.zeros(shape)
    for p, w in zip(parameters, weights):
        n = np.fft.irfft2(white * p["amplitude"], shape)
        n = (n - n.mean()) / (n.std() or 1.0)
        out += w / total * np.exp(p["sigma"] * n - p["sigma"] ** 2 / 2)
    return out


def rate_of_content(content: np.ndarray, rate: np.ndarray, smooth, radius: float, least_content: float = 10.0, least_rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept of rain rate over integrated liquid in a moving window; zero where too few cells tell.

    smooth: a moving mean of a raster of given radius.
    """
    good = ((content > least_content) & (rate > least_rate)).astype(float)
    n = smooth(good, radius)
    mean = lambda f: smooth(np.nan_to_num(f) * good, radius) / np.maximum(n, 1e-9)
    x, y = mean(content), mean(rate)
    var, cov = mean(content * content) - x * x, mean(content * rate) - x * y
    slope = np.where((n > 0.01) & (var > 1e-6), cov / np.maximum(var, 1e-6), 0.0)
    return slope, np.where(n > 0.01, y - slope * x, 0.0)
