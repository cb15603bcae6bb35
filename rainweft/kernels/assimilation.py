"""Blending of a nowcast with model forecasts for one member, and the ensemble Kalman filter in the space of principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from rainweft.kernels import spectral as S
from rainweft.kernels.advection import extrapolate
from rainweft.kernels.nowcast import _filled, aligned, ar_parameters, match

# Correlations of dry radar fields, by level and lag, taken where no rain is seen.
DRY = ((0.99805, 0.9933), (0.9933, 0.9752), (0.9752, 0.923), (0.9297, 0.750), (0.796, 0.367), (0.482, 0.069), (0.079, 0.0018), (0.0006, 0.0))


def blend_steps(frames: np.ndarray, models: np.ndarray, velocity: np.ndarray, leads: Sequence[int], threshold: float, seed: int, skill: Sequence[float], decay: float = 60.0, levels: int = 6, order: int = 2, timestep: float = 5.0) -> np.ndarray:
    """Scale-wise blend of an advected nowcast, one model forecast ``(lead, y, x)`` and noise.

    The nowcast's skill falls by its own autoregression, the model's by ``decay``
    minutes towards half of ``skill``; weights follow explained over unexplained variance.
    """
    frames, least = _filled(frames[-(order + 1) :])
    shape = frames.shape[1:]
    moved, _ = _filled(aligned(frames, velocity))
    weights = S.band_weights(shape, levels)
    parts = [S.decompose(f, weights) for f in moved]
    state, mu0, sd0 = np.stack([p[0] for p in parts]), parts[-1][1], parts[-1][2]
    dry = not (moved[-1] > threshold).any()
    if dry:
        phi = np.array([[a * (1 - b) / (1 - a * a), (b - a * a) / (1 - a * a), 0.5] for a, b in DRY[:levels]])
    else:
        phi = ar_parameters(state, order)
    rng = np.random.RandomState(seed)
    texture = S.field_filter(models[0] if dry else moved[-1])
    rho = rho_before = np.ones(levels)
    out = []
    for k, lead in enumerate(leads):
        state = np.concatenate([state[1:], sum(phi[:, j, None, None] * state[-1 - j] for j in range(order))[None]])
        rho, rho_before = phi[:, 0] * rho + (phi[:, 1] * rho_before if order > 1 else 0), rho
        ahead = extrapolate(S.recompose(state[-1], mu0, sd0), velocity, [lead])[0][0]
        ahead = np.where(np.isfinite(ahead), ahead, models[k])
        a, mu_a, sd_a = S.decompose(ahead, weights)
        b, mu_b, sd_b = S.decompose(_filled(models[k])[0], weights)
        q = np.exp(-lead * timestep / decay)
        c = np.clip(np.stack([rho, np.asarray(skill[:levels]) * (0.5 + 0.5 * q)]), 1e-4, 0.99999)
        r = c * c / (1 - c * c)
        w = c * np.sqrt(r / r.sum(0))
        e, _, _ = S.decompose(S.noise(texture, shape, rng), weights)
        mix = w[0][:, None, None] * a + w[1][:, None, None] * b + np.sqrt(np.maximum(0, 1 - (w**2).sum(0)))[:, None, None] * e
        share = w / w.sum(0)
        f = S.recompose(mix, share[0] * mu_a + share[1] * mu_b, share[0] * sd_a + share[1] * sd_b)
        total = w.mean(1)
        target = np.where(rng.random_sample(shape) < total[0] / total.sum(), ahead, models[k])
        f = match(f, target)
        out.append(np.where(f < threshold, least, f))
    return np.stack(out)


def principal(ens: np.ndarray, mask: np.ndarray | None = None) -> dict:
    """Components of an ensemble ``(member, y, x)`` over the cells of ``mask``."""
    x = ens.reshape(len(ens), -1)
    keep = np.ones(x.shape[1], bool) if mask is None else mask.ravel()
    mean = x[:, keep].mean(0)
    _, s, vt = np.linalg.svd(x[:, keep] - mean, full_matrices=False)
    return {"mean": mean, "axes": vt, "keep": keep, "explained": s**2 / max((s**2).sum(), 1e-12)}


def project(ens: np.ndarray, p: dict) -> np.ndarray:
    return (ens.reshape(len(ens), -1)[:, p["keep"]] - p["mean"]) @ p["axes"].T


def back(pcs: np.ndarray, p: dict, shape: tuple[int, int], fill: float) -> np.ndarray:
    out = np.full((len(pcs), p["keep"].size), fill)
    out[:, p["keep"]] = pcs @ p["axes"] + p["mean"]
    return out.reshape(len(pcs), *shape)


def tapering(n: int, band: int = 8) -> np.ndarray:
    """Weights of a covariance that fall with the distance of components and vanish beyond ``band``."""
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    return np.where(d < band, 0.5 * (1 + np.cos(np.pi * d / band)), 0.0)


def kalman_update(background: np.ndarray, observations: np.ndarray, inflate_bg: float = 1.0, inflate_obs: float = 1.0, offset: float = 0.01) -> np.ndarray:
    """Moves an ensemble of component vectors towards observations by the gain of the two covariances."""

    def cov(x, f):
        d = x - x.mean(0)
        return (d.T @ d / max(len(x) - 1, 1) * f + offset * np.eye(x.shape[1])) * tapering(x.shape[1])

    p, r = cov(background, inflate_bg), cov(observations, inflate_obs)
    gain = np.linalg.solve((p + r).T, p.T).T
    return background + (observations - background) @ gain.T


def masked_correction(nowcast: np.ndarray, model: np.ndarray, threshold: float, least_members: int = 1, seed: int = 0, inflation: float = 1.0) -> np.ndarray:
    """One correction of a nowcast ensemble by a model ensemble where both have rain; values follow the mix of both distributions."""
    least = float(min(nowcast.min(), model.min()))
    wet = ((nowcast >= threshold).sum(0) >= least_members) & ((model >= threshold).sum(0) >= least_members)
    if not wet.any():
        return nowcast
    p = principal(np.concatenate([nowcast, model]), wet)
    a, b = project(nowcast, p), project(model, p)
    new = kalman_update(a, b[: len(a)] if len(b) >= len(a) else b[np.arange(len(a)) % len(b)], inflation, inflation)
    field = np.where(wet, back(new, p, nowcast.shape[1:], least), nowcast)
    moved, gap = np.abs(new - a).sum(), np.abs(b[np.arange(len(a)) % len(b)] - a).sum()
    share = float(np.clip(moved / gap if gap else 0.0, 0.0, 1.0))
    rng = np.random.RandomState(seed)
    out = []
    for k, f in enumerate(field):
        pick = rng.random_sample(f.shape) < share
        out.append(match(f, np.where(pick, model[k % len(model)], nowcast[k])))
    return np.stack(out)
