"""Whole forecasts that combine a nowcast with model members: scale-wise blending with skill, and the ensemble Kalman combination."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from rainweft.kernels import assimilation as A
from rainweft.kernels import masks
from rainweft.kernels import spectral as S
from rainweft.kernels.advection import extrapolate
from rainweft.kernels.nowcast import Member, _filled, _grown, _noise_of, match, prepared, velocity_perturbation
from rainweft.operators.blending import DEFAULT_SKILL, LEAST_SKILL, REGRESSION


def level_skill(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two cascades per level, never rising from large scales to small."""
    c = [float(np.corrcoef(x.ravel(), y.ravel())[0, 1]) if x.std() > 0 and y.std() > 0 else LEAST_SKILL for x, y in zip(a, b)]
    return np.minimum.accumulate(np.clip(np.nan_to_num(c, nan=LEAST_SKILL), LEAST_SKILL, 0.99999))


def skill_ahead(now: np.ndarray, climatology: np.ndarray, minutes: float) -> np.ndarray:
    """Model skill at a lead time: from today's towards the climatological value."""
    p1, p2 = (np.array([row[min(k, len(row) - 1)] for k in range(len(now))]) for row in REGRESSION)
    q = np.exp(-minutes / p1) * (2 - np.exp(-minutes / p2))
    return np.clip(q * now + (1 - q) * climatology, LEAST_SKILL, 0.99999)


def component_weights(skills: np.ndarray, method: str = "bps", covariance: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (component, level) and those of the noise from skills of the same shape.

    ``bps``: by explained over unexplained variance; ``spn``: by the covariance
    (level, component, component) of the components, where noise takes the rest.
    """
    c = np.clip(skills, LEAST_SKILL, 0.99999)
    if method == "spn" and covariance is not None and len(c) > 1:
        w = np.stack([np.linalg.lstsq(covariance[k], c[:, k], rcond=1e-6)[0] for k in range(c.shape[1])], 1)
        return w, np.sqrt(np.maximum(0.0, 1 - (w * c).sum(0)))
    if len(c) == 1:
        return c, 1 - c[0]
    r = c * c / (1 - c * c)
    w = c * np.sqrt(r / r.sum(0))
    return w, np.sqrt(np.maximum(0.0, 1 - (w * w).sum(0)))


def end_ramp(weights: np.ndarray, step: float, start: float, last: float) -> np.ndarray:
    """Weights (component, level) moved linearly to the models alone between ``start`` and ``last``; the first component is the nowcast."""
    f = float(np.clip((step - start) / max(last - start, 1e-9), 0.0, 1.0))
    models = np.zeros_like(weights)
    if len(weights) > 1:
        models[1:] = 1.0 / (len(weights) - 1)
    return weights * (1 - f) + models * f


def wettest(models: np.ndarray, threshold: float) -> tuple[int, int]:
    """Model and time of the field with most cells above the threshold, the first of equals."""
    n = (models > threshold).sum((2, 3))
    return tuple(int(v) for v in np.unravel_index(np.argmax(n), n.shape))


@dataclass
class Blend:
    """What the members of a blended forecast share: nowcast case, model cascades and skills.

    models: (model, step, y, x) with step 0 the time of the last frame; flows:
    (model, 2, y, x). A dry radar takes its texture from the wettest model field
    and the models' mean flow.
    """

    frames: np.ndarray
    models: np.ndarray
    velocity: np.ndarray
    flows: np.ndarray
    threshold: float
    levels: int = 6
    order: int = 2
    timestep: float = 5.0
    km: float = 1.0
    climatology: Sequence[float] = DEFAULT_SKILL
    weights_method: str = "bps"
    adjust: bool = True
    skills: list = field(default_factory=list)

    def __post_init__(self):
        shape = self.frames.shape[1:]
        self.bands = S.band_weights(shape, self.levels)
        self.least = min(_filled(self.frames)[1], float(np.nanmin(self.models)) if np.isfinite(self.models).any() else 0.0)
        self.filled = np.where(np.isfinite(self.models), self.models, self.least)
        self.outside = ~np.isfinite(self.frames[-1])
        self.dry = not bool((np.nan_to_num(self.frames[-1], nan=self.least) > self.threshold).any())
        self.models_dry = not bool((self.filled > self.threshold).any())
        base = self.frames
        if self.dry:
            self.velocity = self.flows.mean(0) if len(self.flows) else self.velocity
            m, t = wettest(self.filled, self.threshold)
            base = np.stack([self.filled[m, t]] * (self.order + 1))
        self.case = prepared(np.where(np.isfinite(base), base, self.least), self.velocity, self.threshold, self.levels, self.order, "nonparametric", 0, self.adjust)
        if self.case is not None and self.dry:
            known = [A.DRY[min(k, len(A.DRY) - 1)] for k in range(self.levels)]
            self.case["phi"] = np.array([[a * (1 - b) / (1 - a * a), (b - a * a) / (1 - a * a), np.sqrt(max(0.0, 1 - a * a))] for a, b in known])[:, : self.order + 1]
        self.parts = [[S.decompose(f, self.bands) for f in run] for run in self.filled]
        clim = [self.climatology[k] if k < len(self.climatology) else LEAST_SKILL for k in range(self.levels)]
        self.climate = np.array(clim)
        now = self.case["stack"][-1] if self.case is not None and not self.dry else None
        self.now = [level_skill(p[0][0], now) if now is not None else self.climate for p in self.parts]

    def dry_forecast(self) -> bool:
        """Whether neither radar nor models have rain."""
        return self.case is None or (self.dry and self.models_dry)

    def extrapolation_skill(self, steps: int) -> np.ndarray:
        """Skill of the nowcast per level after some steps of its own process."""
        if self.dry:
            return np.full(self.levels, LEAST_SKILL)
        a = b = np.ones(self.levels)
        for _ in range(steps):
            a, b = self.case["phi"][:, 0] * a + (self.case["phi"][:, 1] * b if self.order > 1 else 0), a
        return np.clip(np.minimum.accumulate(a), LEAST_SKILL, 0.99999)

    def skill_rows(self) -> list[tuple[int, int, float]]:
        """(model, level, skill) of this issue, for a store of daily skills."""
        return [(m, k, float(s)) for m, row in enumerate(self.now) for k, s in enumerate(row)]


def blended_member(b: Blend, leads: Sequence[float], seed: int, own: Sequence[int] | None = None, mask: str = "incremental", matching: str = "cdf", full_model_from: float | None = None, perturb_velocity: bool = True) -> np.ndarray:
    """One member: nowcast, the models ``own`` and noise, blended level by level at each lead.

    Leads between steps are interpolated. full_model_from: step from which the
    weights move to the models alone, until the last lead.
    """
    shape = b.frames.shape[1:]
    if b.dry_forecast():
        return np.full((len(leads), *shape), b.least)
    own = list(range(len(b.models))) if own is None else list(own)
    member = Member(b.case, b.threshold, seed, "none", "none")
    rng = member.rng
    error = velocity_perturbation(b.velocity, rng, b.timestep, b.km) if perturb_velocity else None
    noise = np.stack([S.decompose(_noise_of(b.case, rng), b.bands)[0]] * b.order)
    state, phi = b.case["stack"], b.case["phi"]
    allowed = b.case["observed"] >= b.threshold
    last, fields = leads[-1], [np.where(np.isfinite(b.frames[-1]), b.frames[-1], b.least)]
    for step in range(1, int(np.ceil(last)) + 1):
        t = min(step, b.models.shape[1] - 1)
        ar = lambda x: sum(phi[:, j, None, None] * x[-1 - j] for j in range(b.order))
        state = np.concatenate([state[1:], ar(state)[None]])
        eps, _, _ = S.decompose(_noise_of(b.case, rng), b.bands)
        noise = np.concatenate([noise[1:], (ar(noise) + phi[:, -1, None, None] * eps)[None]])
        noise[-1] /= np.maximum(noise[-1].std((1, 2)), 1e-9)[:, None, None]
        skills = np.stack([b.extrapolation_skill(step), *[skill_ahead(b.now[m], b.climate, step * b.timestep) for m in own]])
        # components at this step: the nowcast is advected by the blend of the flows
        cover = None
        if b.weights_method == "spn" and own:
            flat = np.stack([b.parts[m][t][0].reshape(b.levels, -1) for m in own])
            first = state[-1].reshape(1, b.levels, -1)
            every = np.concatenate([first, flat])
            cover = np.stack([np.corrcoef(every[:, k]) if len(every) > 1 else np.ones((1, 1)) for k in range(b.levels)])
            cover = np.nan_to_num(cover) + 1e-3 * np.eye(len(every))
        w, rest = component_weights(skills, b.weights_method, cover)
        if full_model_from is not None:
            w, rest = end_ramp(w, step, full_model_from, last), rest * (1 - np.clip((step - full_model_from) / max(last - full_model_from, 1e-9), 0, 1))
        share = w[:, min(1, b.levels - 1)]
        flows = np.stack([b.velocity, *[b.flows[min(m, len(b.flows) - 1)] for m in own]]) if len(b.flows) else b.velocity[None]
        share = share[: len(flows)]
        v = (flows * share[:, None, None, None]).sum(0) / max(share.sum(), 1e-9) + (error(step * b.timestep) if error else 0.0)
        ahead = extrapolate(S.recompose(state[-1], b.case["mu"], b.case["sigma"]), v, [step])[0][0]
        seen = np.isfinite(ahead) & ~b.outside
        fill = b.filled[own[0], t] if own else np.full(shape, b.least)
        ahead = np.where(np.isfinite(ahead), ahead, fill)
        cascade, mu, sd = S.decompose(ahead, b.bands)
        parts = [(cascade, mu, sd), *[b.parts[m][t] for m in own]]
        mixed = sum(w[k][:, None, None] * p[0] for k, p in enumerate(parts)) + rest[:, None, None] * noise[-1]
        norm = w / np.maximum(w.sum(0), 1e-9)
        f = S.recompose(mixed, sum(norm[k] * p[1] for k, p in enumerate(parts)), sum(norm[k] * p[2] for k, p in enumerate(parts)))
        # outside the radar's reach the models stand alone, over a smooth edge
        if own and not seen.all():
            edge = masks.soft_mask(~seen, max(2, min(shape) // 16), blur=1)
            alone = S.recompose(np.mean([b.parts[m][t][0] for m in own], 0) + 0 * mixed, np.mean([b.parts[m][t][1] for m in own], 0), np.mean([b.parts[m][t][2] for m in own], 0))
            f = (1 - edge) * f + edge * alone
        if mask == "incremental":
            wet = _grown(allowed) | np.logical_or.reduce([b.filled[m, t] >= b.threshold for m in own] or [np.zeros(shape, bool)])
            f = np.where(wet, f, f.min())
        elif mask == "obs":
            f = np.where(b.case["observed"] >= b.threshold, f, f.min())
        if matching == "cdf":
            total = w.mean(1)
            pick = rng.random_sample(shape) * total.sum()
            target = ahead.copy()
            for k, m in enumerate(own):
                target = np.where(pick >= total[: k + 1].sum(), b.filled[m, t], target)
            f = match(f, target)
        elif matching == "mean":
            wet = f >= b.threshold
            goal = np.mean([x[x >= b.threshold].mean() for x in [ahead, *[b.filled[m, t] for m in own]] if (x >= b.threshold).any()] or [b.threshold])
            f = np.where(wet, f - f[wet].mean() + goal, f) if wet.any() else f
        f = np.where(f < b.threshold, b.least, f)
        allowed = _grown(allowed) | (f >= b.threshold)
        fields.append(f)
    out = []
    for lead in leads:
        k = int(np.floor(lead))
        part = lead - k
        out.append(fields[k] if part < 1e-9 else fields[k] * (1 - part) + fields[k + 1] * part)
    return np.stack(out)


def members_of(n_members: int, n_models: int, blend_all: bool = False) -> list[list[int]]:
    """Models of each member: all of them, or one each in turn."""
    return [list(range(n_models)) if blend_all else [k % n_models] for k in range(n_members)] if n_models else [[] for _ in range(n_members)]


# -- Kalman combination ---------------------------------------------------------------------------


def correction_steps(observed: Sequence[float], modelled: Sequence[float], issue: float, horizon: float, step: float) -> list[int]:
    """Steps after ``issue`` at which model fields are there; times in minutes.

    Observations and model times must be evenly spaced, the former by ``step``;
    model times outside the horizon don't count.
    """
    for name, times in (("observations", observed), ("model fields", modelled)):
        gaps = np.diff(sorted(times))
        if len(gaps) and not np.allclose(gaps, gaps[0]):
            raise ValueError(f"the times of the {name} aren't evenly spaced")
    if len(observed) > 1 and not np.isclose(np.diff(sorted(observed))[0], step):
        raise ValueError("the observations aren't one time step apart")
    leads = [(t - issue) / step for t in sorted(modelled) if issue <= t <= issue + horizon]
    if any(abs(x - round(x)) > 1e-6 for x in leads):
        raise ValueError("model fields must lie on time steps")
    return [round(x) for x in leads]


def rain_case(frames: np.ndarray, models: np.ndarray, threshold: float) -> str:
    """``obs`` where the radar is dry, ``nwp`` where the models are, else ``none``."""
    if not (np.nan_to_num(frames[-1], nan=-np.inf) > threshold).any():
        return "obs"
    return "none" if (np.nan_to_num(models, nan=-np.inf) > threshold).any() else "nwp"


def kalman_forecast(
    frames: np.ndarray, velocity: np.ndarray, models: dict[int, np.ndarray], leads: Sequence[int], threshold: float, members: int, seed: int = 1, levels: int = 6, order: int = 2, least_members: int = 1, inflation: float = 1.0, pool: int = 30, full_model_from: int | None = None
) -> np.ndarray:
    """``(member, lead, y, x)``: a nowcast ensemble corrected by model members at the steps that ``models`` holds.

    models: step -> (member, y, x). Members advance by their own autoregression
    with noise from a common pool, move one step with the flow, and are corrected
    in the space of principal components where both ensembles have rain; a
    corrected field starts its cascade anew. Cells that the flow brings in from
    outside are filled from a model member over a smooth edge. From
    ``full_model_from`` on the models stand alone.
    """
    every = np.concatenate([m for m in models.values()]) if models else frames[-1:][None][0]
    least = min(_filled(frames)[1], float(np.nanmin(every)) if np.isfinite(every).any() else 0.0)
    shape = frames.shape[1:]
    kind = rain_case(frames, every, threshold)
    rng = np.random.RandomState(seed)
    steps = sorted(models)

    def model_at(step: int, k: int) -> np.ndarray | None:
        near = [s for s in steps if s <= step]
        if not near:
            return None
        m = models[near[-1]]
        return np.where(np.isfinite(m[k % len(m)]), m[k % len(m)], least)

    if kind == "obs":  # nothing to advect: the models alone
        out = [[model_at(t, k) if model_at(t, k) is not None else np.full(shape, least) for t in leads] for k in range(members)]
        return np.array(out)
    case = prepared(np.where(np.isfinite(frames), frames, least), velocity, threshold, levels, order)
    if case is None:
        return np.full((members, len(leads), *shape), least)
    noise = [S.decompose(_noise_of(case, rng), case["weights"])[0] for _ in range(pool)]
    own = [np.random.RandomState(s) for s in rng.randint(0, 2**31 - 1, members)]
    states = [case["stack"].copy() for _ in range(members)]
    moments = [(case["mu"], case["sigma"]) for _ in range(members)]
    fields = np.stack([case["observed"]] * members)
    wet = np.stack([case["observed"] >= threshold] * members)
    out = np.empty((members, len(leads), *shape))
    for step in range(1, max(leads) + 1):
        if step in models and kind == "none":
            obs = np.where(np.isfinite(models[step]), models[step], least)
            obs = obs[np.arange(members) % len(obs)]
            corrected = A.masked_correction(fields, obs, threshold, least_members, int(rng.randint(2**31 - 1)), inflation)
            for k in range(members):
                if not np.array_equal(corrected[k], fields[k]):
                    part, mu, sd = S.decompose(corrected[k], case["weights"])
                    states[k] = np.concatenate([states[k][:-1], part[None]])
                    moments[k] = (mu, sd)
            fields = corrected
        for k in range(members):
            eps = noise[own[k].randint(pool)]
            new = sum(case["phi"][:, j, None, None] * states[k][-1 - j] for j in range(order)) + case["phi"][:, -1, None, None] * eps
            before = fields[k]
            states[k] = np.concatenate([states[k][1:], new[None]])
            f = S.recompose(new, *moments[k])
            nearby = _grown(wet[k])
            model = model_at(step, k)
            if model is not None:
                nearby = nearby | _grown(model >= threshold)
            f = match(np.where(nearby, f, f.min()), before)
            f = np.where(f < threshold, least, f)
            moved = extrapolate(f, velocity, [1])[0][0]
            inside = np.isfinite(moved)
            fill = model if model is not None else np.full(shape, least)
            edge = masks.soft_mask(~inside, 2, blur=1) if not inside.all() else np.zeros(shape)
            f = (1 - edge) * np.where(inside, moved, fill) + edge * fill
            if full_model_from is not None and step >= full_model_from and model is not None:
                f = model
            # the state follows the flow with the field
            states[k] = np.stack([np.stack([np.where(np.isfinite(x), x, 0.0) for x in (extrapolate(level, velocity, [1])[0][0] for level in frame)]) for frame in states[k]])
            fields[k] = f
            wet[k] = f >= threshold
        for i in [i for i, lead in enumerate(leads) if lead == step]:
            out[:, i] = fields
    return out
