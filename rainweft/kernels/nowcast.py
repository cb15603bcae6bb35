"""Nowcasts of one member from a short stack of frames.

Every method takes frames ``(t, y, x)`` (oldest first, transformed to dB or the
like, missing as NaN), a velocity and leads, and gives ``(lead, y, x)``. The
random state comes from a seed that the caller hands to each member, so results
don't depend on how members are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from rainweft.kernels import localised as L
from rainweft.kernels import spectral as S
from rainweft.kernels.advection import extrapolate
from rainweft.kernels.features import blobs

# Growth of velocity errors with lead time, along and across the flow: a * t^b + c.
PARALLEL, PERPENDICULAR = (10.88, 0.23, -7.68), (5.76, 0.31, -2.72)


def aligned(frames: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """All frames advected to the time of the last."""
    n = len(frames)
    return np.stack([f if k == n - 1 else extrapolate(f, velocity, [n - 1 - k])[0][0] for k, f in enumerate(frames)])


def match(first: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The values of ``target`` in the order of ``first``; its driest cells get the target's minimum."""
    out = np.empty(first.size)
    order = np.argsort(first.ravel(), kind="stable")
    values = np.sort(target.ravel())
    out[order] = values if len(values) == len(order) else np.quantile(values, np.linspace(0, 1, len(order)))
    return np.where(first <= first.min(), target.min(), out.reshape(first.shape))


def ar_parameters(levels: np.ndarray, order: int) -> np.ndarray:
    """Per level phi_1..phi_p and the noise scale; ``levels`` is (frame, level, y, x)."""
    out = []
    for k in range(levels.shape[1]):
        g = [float(np.nan_to_num(np.corrcoef(levels[-1, k].ravel(), levels[-1 - lag, k].ravel())[0, 1])) for lag in range(1, order + 1)]
        g[0] = min(max(g[0], -0.999), 0.999)
        if order == 1:
            out.append([g[0], np.sqrt(1 - g[0] ** 2)])
            continue
        g2 = min(max(g[1], 2 * g[0] * g[1] - 1, (3 * g[0] ** 2 - 2 + 2 * (1 - g[0] ** 2) ** 1.5) / max(g[0] ** 2, 1e-9)), 0.999)
        p1, p2 = g[0] * (1 - g2) / (1 - g[0] ** 2), (g2 - g[0] ** 2) / (1 - g[0] ** 2)
        out.append([p1, p2, np.sqrt(max(0.0, 1 - g[0] * p1 - g2 * p2))])
    return np.array(out)


def velocity_perturbation(velocity: np.ndarray, rng: np.random.RandomState, timestep: float, pixels_per_km: float, par=PARALLEL, perp=PERPENDICULAR):
    """Function of lead time in minutes: a velocity error along and across the flow, in cells per step."""
    size = np.hypot(*velocity)
    along = velocity / np.maximum(size, 1e-12)
    across = np.stack([-along[1], along[0]])
    a, b = rng.laplace(scale=1 / np.sqrt(2)), rng.laplace(scale=1 / np.sqrt(2))
    factor = 60.0 / (timestep * pixels_per_km)
    grow = lambda p, t: p[0] * t ** p[1] + p[2]
    return lambda t: (grow(par, t) * a * along + grow(perp, t) * b * across) / factor


def _filled(frames: np.ndarray) -> tuple[np.ndarray, float]:
    least = float(np.nanmin(frames)) if np.isfinite(frames).any() else 0.0
    return np.where(np.isfinite(frames), frames, least), least


def extrapolation(frames, velocity, leads, **_):
    return extrapolate(frames[-1], velocity, leads)[0]


def eulerian(frames, velocity, leads, **_):
    return np.stack([frames[-1]] * len(leads))


def _enough(frames: np.ndarray, velocity: np.ndarray, least: int) -> None:
    """Frames (t, y, x) and a flow (2, y, x) of one shape, as many frames as a method needs."""
    if frames.ndim != 3 or velocity.shape != (2, *frames.shape[1:]):
        raise ValueError(f"frames of shape {frames.shape} and a flow of shape {velocity.shape} don't belong together")
    if len(frames) < least:
        raise ValueError(f"{least} frames are needed, there are {len(frames)}")


def prepared(frames: np.ndarray, velocity: np.ndarray, threshold: float, levels: int = 6, order: int = 2, noise: str | None = "nonparametric", window: int = 0, adjust: bool = False) -> dict | None:
    """What all members of a case share: aligned and decomposed frames, autoregression, noise texture. None where it is dry.

    adjust: noise of each level is scaled so that rain made of it varies like the field.
    """
    _enough(frames, velocity, order + 1)
    outside = ~np.isfinite(frames).all(0)
    frames, least = _filled(frames[-(order + 1) :])
    if not (frames > threshold).any():
        return None
    moved, _ = _filled(aligned(frames, velocity))
    weights = S.band_weights(frames.shape[1:], levels)
    parts = [S.decompose(f, weights) for f in moved]
    stack = np.stack([p[0] for p in parts])
    phi = ar_parameters(stack, order)
    if adjust and noise:
        phi[:, -1] *= S.noise_adjustments(moved[-1], threshold, least, weights)
    texture = None
    if noise == "nested":
        texture = S.nested_filters(moved[-1], 2)
    elif noise and noise != "none":
        texture = S.local_filters(moved[-1], window) if window else (S.power_law_filter(moved[-1]) if noise == "parametric" else S.field_filter(moved[-1]))
    return {"outside": outside, "least": least, "observed": moved[-1], "weights": weights, "stack": stack, "mu": parts[-1][1], "sigma": parts[-1][2], "phi": phi, "texture": texture, "window": window, "noise": noise, "order": order, "wet": float((moved[-1] > threshold).mean())}


def _noise_of(p: dict, rng: np.random.RandomState) -> np.ndarray:
    shape = p["observed"].shape
    if p["noise"] == "nested":
        return S.nested_noise(p["texture"], shape, rng)
    return S.local_noise(p["texture"], shape, rng) if p["window"] else S.noise(p["texture"], shape, rng)


class Member:
    """The state of one member and its steps: ``advance`` moves it by one, ``field`` is the rain at its time.

    deterministic without seed. mask: ``incremental`` (rain may spread by a cell a
    step), ``obs``, ``sprog`` (as much wet area as the noise-free run has) or none.
    """

    def __init__(self, case: dict, threshold: float, seed: int | None, mask: str = "incremental", matching: str = "cdf"):
        self.case, self.threshold, self.mask, self.matching = case, threshold, mask, matching
        self.rng = np.random.RandomState(seed) if seed is not None else None
        self.levels = case["stack"]
        self.step, self.before, self.field = 0, case["observed"], case["observed"]
        self.allowed = case["observed"] >= threshold

    def advance(self) -> None:
        c = self.case
        new = sum(c["phi"][:, j, None, None] * self.levels[-1 - j] for j in range(c["order"]))
        if self.rng is not None and c["texture"] is not None:
            eps, _, _ = S.decompose(_noise_of(c, self.rng), c["weights"])
            new = new + c["phi"][:, -1, None, None] * eps
        self.levels = np.concatenate([self.levels[1:], new[None]])
        rain = _masked(S.recompose(new, c["mu"], c["sigma"]), c["observed"], self.allowed, self.threshold, c["least"], self.mask, self.matching, c["wet"])
        self.before, self.field, self.step = self.field, rain, self.step + 1
        if self.mask == "incremental":
            self.allowed = _grown(rain >= self.threshold) | self.allowed

    def at(self, lead: float) -> np.ndarray:
        """The field at a lead time of at most the state's step, linear between steps."""
        while self.step < lead - 1e-9:
            self.advance()
        share = lead - (self.step - 1)
        return self.before + (self.field - self.before) * share if share < 1 else self.field


def cascade(frames: np.ndarray, velocity: np.ndarray, leads: Sequence[float], threshold: float, levels: int = 6, order: int = 2, seed: int | None = None, mask: str = "incremental", matching: str = "cdf", timestep: float = 5.0, km: float = 1.0, perturb_velocity: bool = True, noise: str = "nonparametric", window: int = 0, adjust: bool = False, case: dict | None = None, **_) -> np.ndarray:
    """Scale-wise autoregressive nowcast: deterministic without seed, a stochastic member with one.

    case: what ``prepared`` gives, where several members share it. window > 0
    estimates the noise texture in windows of that size.
    """
    p = case or prepared(frames, velocity, threshold, levels, order, noise if seed is not None else None, window, adjust)
    if p is None:
        return np.full((len(leads), *frames.shape[1:]), _filled(frames[-(order + 1) :])[1])
    member = Member(p, threshold, seed, mask, matching)
    error = velocity_perturbation(velocity, member.rng, timestep, km) if member.rng is not None and perturb_velocity else None
    out = []
    for lead in leads:
        v = velocity + (error(lead * timestep) if error else 0.0)
        got, _ = extrapolate(member.at(lead), v, [lead])
        got = np.where(np.isfinite(got[0]), got[0], np.nan)
        out.append(np.where(p["outside"], np.nan, got) if p["outside"].any() else got)
    return np.stack(out)


def cascade_members(frames: np.ndarray, velocity: np.ndarray, leads: Sequence[float], threshold: float, seeds: Sequence[int], levels: int = 6, order: int = 2, noise: str = "nonparametric", window: int = 0, adjust: bool = False, **how) -> list[np.ndarray]:
    """Several members of a case that share its preparation; each equals ``cascade`` with its seed."""
    case = prepared(frames, velocity, threshold, levels, order, noise, window, adjust)
    return [cascade(frames, velocity, leads, threshold, levels=levels, order=order, seed=seed, noise=noise, window=window, case=case, **how) for seed in seeds]


def _grown(m: np.ndarray) -> np.ndarray:
    p = np.pad(m, 1)
    return p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]


def _masked(f, observed, allowed, threshold, least, mask, matching, wet_share):
    if mask == "incremental":
        f = np.where(_grown(allowed), f, f.min())
    elif mask == "obs":
        f = np.where(observed >= threshold, f, f.min())
    elif mask == "sprog" and 0 < wet_share < 1:
        f = np.where(f >= np.quantile(f, 1 - wet_share), f, f.min())
    if matching == "cdf":
        return match(f, observed)
    if matching == "mean":
        wet, target = f >= threshold, observed[observed >= threshold]
        if wet.any() and len(target):
            f = np.where(wet, f - f[wet].mean() + target.mean(), f)
    return np.where(f < threshold, least, f)


def sprog(frames, velocity, leads, threshold, **how):
    """Noise-free scale-wise nowcast with the wet area of its own percentile."""
    return cascade(frames, velocity, leads, threshold, **({"mask": "sprog", "matching": "mean"} | how | {"seed": None}))


def steps(frames, velocity, leads, threshold, seed=0, **how):
    """A stochastic member."""
    return cascade(frames, velocity, leads, threshold, seed=seed, **how)


def sseps(frames, velocity, leads, threshold, seed=0, window=128, **how):
    """A member whose texture is estimated in overlapping windows."""
    return cascade(frames, velocity, leads, threshold, seed=seed, window=min(window, *frames.shape[1:]), **how)


#: Methods whose members share the preparation of their case.
SHARED = {"steps": cascade_members, "sseps": lambda frames, velocity, leads, threshold, seeds, window=128, **how: cascade_members(frames, velocity, leads, threshold, seeds, window=min(window, *frames.shape[1:]), **how)}


def _local(f: np.ndarray, radius: float) -> np.ndarray:
    return S.smooth(f, radius)


def anvil(frames, velocity, leads, threshold, radius: float = 50.0, levels: int = 6, order: int = 1, rate: np.ndarray | None = None, **_):
    """Integrated autoregression of order (1, 1) or (2, 1) per scale and cell, its parameters from a moving window.

    With ``rate``, a rain-rate field of the last frame's time, the frames are
    integrated liquid and the result is rain rate by a regression in a moving
    window, never below 0; else never below the minimum.
    """
    _enough(frames, velocity, order + 2)
    frames, least = _filled(frames[-(order + 2) :])
    moved, _ = _filled(aligned(frames, velocity))
    weights = S.band_weights(moved.shape[1:], levels)
    stack = np.stack([S.decompose(f, weights, normalise=False)[0] for f in moved])
    changes = np.diff(stack, axis=0)
    r = min(radius, min(moved.shape[1:]) / 6)

    def corr(a, b):
        return np.clip(_local(a * b, r) / np.sqrt(np.maximum(_local(a * a, r) * _local(b * b, r), 1e-18)), -0.98, 0.98)

    g1 = np.stack([corr(a, b) for a, b in zip(changes[-1], changes[-2])])
    if order > 1:
        g2 = np.stack([corr(a, b) for a, b in zip(changes[-1], changes[-3])])
        g2 = np.clip(g2, 2 * g1 * g1 - 1 + 1e-3, 0.98)
        phi = [g1 * (1 - g2) / (1 - g1 * g1), (g2 - g1 * g1) / (1 - g1 * g1)]
    else:
        phi = [g1]
    line = None
    if rate is not None:
        line = L.rate_of_content(moved[-1], rate, _local, r)
    out, now, x, past = [], 0, stack[-1], [changes[-1 - k] for k in range(len(phi))]
    for lead in leads:
        while now < lead - 1e-9:
            now += 1
            past = [sum(p * c for p, c in zip(phi, past)), *past[:-1]]
            x = x + past[0]
        f = np.maximum(x.sum(0), least)
        if line is not None:
            f = np.maximum(line[0] * f + line[1], 0.0)
        out.append(extrapolate(f, velocity, [lead])[0][0])
    return np.stack(out)


def linda(frames, velocity, leads, threshold, seed=None, features: int = 20, order: int = 1, anisotropic: bool = True, perturb_velocity: bool = True, timestep: float = 5.0, km: float = 1.0, **_):
    """Feature-localised integrated autoregression with fitted smoothing; with a seed times lognormal noise of the hindcast error.

    Every feature has its own coefficients, and two kernels: one that smooths the
    change from step to step, one the field. Both are fitted on the last frames.
    """
    _enough(frames, velocity, order + 2)
    frames, least = _filled(frames[-(order + 3) :])
    moved, _ = _filled(aligned(frames, velocity))
    moved = moved - least
    at = blobs(moved[-1], features)
    ny, nx = moved.shape[1:]
    weights = L.window_weights(at, (ny, nx), max(ny, nx) / np.sqrt(max(len(at), 1)))
    changes = np.diff(moved, axis=0)
    if order > 1 and len(changes) > 2:
        per = L.ar2_of_features(changes, weights)
    else:
        per = L.ar1_of_features(changes, weights)[:, None]
    psi = [L.interpolated(per[:, k], weights) for k in range(per.shape[1])]
    of_field = L.fitted_kernels(moved[-2], moved[-1], weights, anisotropic)
    of_change = L.fitted_kernels(changes[-2], changes[-1], weights, False) if len(changes) > 1 else of_field

    def run(start: np.ndarray, past: list[np.ndarray], n: int):
        x = start
        for _ in range(n):
            past = [L.composite_convolution(sum(p * c for p, c in zip(psi, past)), of_change, weights), *past[:-1]]
            x = L.composite_convolution(np.maximum(x + past[0], 0.0), of_field, weights)
        return x, past

    recent = [changes[-1 - k] for k in range(len(psi))]
    rng = np.random.RandomState(seed) if seed is not None else None
    noise = error = None
    if rng is not None:
        earlier = [changes[-2 - k] if len(changes) > k + 1 else changes[0] for k in range(len(psi))]
        hindcast, _ = run(moved[-2], earlier, 1)
        noise = L.perturbation_parameters(moved[-1], hindcast, weights, max(threshold - least, 1e-6))
        error = velocity_perturbation(velocity, rng, timestep, km) if perturb_velocity else None
    out, now, x, past = [], 0, moved[-1], recent
    for lead in leads:
        while now < lead - 1e-9:
            now += 1
            x, past = run(x, past, 1)
        f = x if noise is None else x * L.perturbations(noise, weights, rng)
        v = velocity + (error(lead * timestep) if error else 0.0)
        out.append(extrapolate(f + least, v, [lead])[0][0])
    return np.stack(out)


METHODS = {"extrapolation": extrapolation, "lagrangian": extrapolation, "eulerian": eulerian, "sprog": sprog, "steps": steps, "sseps": sseps, "anvil": anvil, "linda": linda}
