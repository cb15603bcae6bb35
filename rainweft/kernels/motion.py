"""Motion between frames: flow fields ``(u, v)`` in cells per step."""

from __future__ import annotations

import numpy as np

from rainweft.kernels.advection import bilinear
from rainweft.kernels.spectral import smooth


def constant(frames: np.ndarray, reach: int = 12) -> np.ndarray:
    """The one displacement of largest correlation between the last two frames, refined to a fraction by a parabola."""
    a, b = frames[-2], frames[-1]
    best = {}
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            p = a[max(0, -dy) : a.shape[0] - max(0, dy), max(0, -dx) : a.shape[1] - max(0, dx)].ravel()
            q = b[max(0, dy) : b.shape[0] - max(0, -dy), max(0, dx) : b.shape[1] - max(0, -dx)].ravel()
            if len(p) < a.size / 4 or p.std() == 0 or q.std() == 0:
                continue
            best[dy, dx] = np.corrcoef(p, q)[0, 1]
    if not best:
        return np.zeros((2, *a.shape))
    dy, dx = max(best, key=best.get)

    def refine(lo, mid, hi):
        return 0.0 if lo is None or hi is None or lo + hi - 2 * mid >= 0 else 0.5 * (lo - hi) / (lo + hi - 2 * mid)

    fy = refine(best.get((dy - 1, dx)), best[dy, dx], best.get((dy + 1, dx)))
    fx = refine(best.get((dy, dx - 1)), best[dy, dx], best.get((dy, dx + 1)))
    return np.stack([np.full(a.shape, dx + fx), np.full(a.shape, dy + fy)])


def _halved(f: np.ndarray) -> np.ndarray:
    f = f[: f.shape[0] // 2 * 2, : f.shape[1] // 2 * 2]
    return f.reshape(f.shape[0] // 2, 2, f.shape[1] // 2, 2).mean((1, 3))


def _pyramid(f: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [f]
    while len(out) < levels and min(out[-1].shape) >= 16:
        out.append(_halved(out[-1]))
    return out


def _resized(f: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    y, x = np.linspace(-0.25, f.shape[0] - 0.75, shape[0]), np.linspace(-0.25, f.shape[1] - 0.75, shape[1])
    return bilinear(f, *np.meshgrid(y, x, indexing="ij"), None)


def lucas_kanade(a: np.ndarray, b: np.ndarray, sigma: float = 5.0, levels: int = 3, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Dense pyramidal least-squares flow from a to b, and the smaller eigenvalue of its system (the trust in it)."""
    flow, trust = None, None
    for p, q in reversed(list(zip(_pyramid(a, levels), _pyramid(b, levels)))):
        flow = np.zeros((2, *p.shape)) if flow is None else np.stack([2 * _resized(c, p.shape) for c in flow])
        gy, gx = np.mgrid[0 : p.shape[0], 0 : p.shape[1]].astype(float)
        for _ in range(rounds):
            moved = bilinear(q, gy + flow[1], gx + flow[0], None)
            dy, dx = (g1 + g2 for g1, g2 in zip(np.gradient(p), np.gradient(moved)))
            dy, dx, dt = dy / 2, dx / 2, moved - p
            xx, yy, xy = smooth(dx * dx, sigma), smooth(dy * dy, sigma), smooth(dx * dy, sigma)
            xt, yt = smooth(dx * dt, sigma), smooth(dy * dt, sigma)
            lam = 1e-3 * (xx + yy).mean() + 1e-12
            det = (xx + lam) * (yy + lam) - xy * xy
            flow = flow - np.stack([((yy + lam) * xt - xy * yt) / det, ((xx + lam) * yt - xy * xt) / det])
        trust = 0.5 * (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy))
    return flow, trust


def track(a: np.ndarray, b: np.ndarray, points: np.ndarray, **how) -> np.ndarray:
    """Displacements of (x, y) points from a to b."""
    flow, _ = lucas_kanade(a, b, **how)
    return np.stack([bilinear(c, points[:, 1], points[:, 0], None) for c in flow], 1)


def dense_lucas_kanade(frames: np.ndarray, quality: float = 0.01) -> np.ndarray:
    """Mean over frame pairs, each weighted by its trust and spread to places without texture."""
    num, den = 0.0, 0.0
    for a, b in zip(frames[:-1], frames[1:]):
        flow, trust = lucas_kanade(a, b)
        w = np.where(trust > quality * max(trust.max(), 1e-12), trust, 0.0)
        num, den = num + flow * w, den + w
    if np.max(den) <= 0:
        return np.zeros((2, *frames.shape[1:]))
    whole = (num.sum((1, 2)) / den.sum())[:, None, None]
    spread = max(frames.shape[1:]) / 8
    back = 1e-3 * den.max()
    d = smooth(den, spread) + back
    return np.stack([(smooth(n, spread) + back * w) / d for n, w in zip(num, whole)])


def darts(frames: np.ndarray, n_flow: int = 2, n_x: int = 8) -> np.ndarray:
    """Flow as a few Fourier modes that solve the advection equation over the frame stack by least squares in the spectral domain."""
    t, ny, nx = frames.shape
    f = np.fft.fftn(frames) / frames.size
    gy, gx = np.fft.ifftn(f * (2j * np.pi * np.fft.fftfreq(ny))[None, :, None] * f.size).real, np.fft.ifftn(f * (2j * np.pi * np.fft.fftfreq(nx))[None, None, :] * f.size).real
    gt = np.gradient(frames, axis=0)
    ys, xs = np.arange(ny) / ny * 2 * np.pi, np.arange(nx) / nx * 2 * np.pi
    basis = [np.ones((ny, nx))]
    for a in range(n_flow):
        for b in range(n_flow):
            if a or b:
                basis += [np.cos(a * ys[:, None] + b * xs[None]), np.sin(a * ys[:, None] + b * xs[None])]
    low = (np.abs(np.fft.fftfreq(ny) * ny) <= n_x)[:, None] & (np.abs(np.fft.fftfreq(nx) * nx) <= n_x)[None]
    cols = [np.fft.fft2(g * m)[:, low].ravel() for g in (gx, gy) for m in basis]
    right = np.fft.fft2(-gt)[:, low].ravel()
    a = np.stack([np.concatenate([c.real, c.imag]) for c in cols], 1)
    coef = np.linalg.lstsq(a, np.concatenate([right.real, right.imag]), rcond=0.01)[0]
    n = len(basis)
    return np.stack([sum(c * m for c, m in zip(coef[:n], basis)), sum(c * m for c, m in zip(coef[n:], basis))])


def smooth_flow(a: np.ndarray, b: np.ndarray, lam: float = 50.0, rounds: int = 100, levels: int = 4) -> np.ndarray:
    """Flow whose steps follow brightness constancy and whose roughness is relaxed (all cells at once) where forward and backward flow agree."""
    scale = max(np.ptp(a), np.ptp(b), 1e-9) / 255.0
    flow = back = None
    for p, q in reversed(list(zip(_pyramid(a / scale, levels), _pyramid(b / scale, levels)))):
        zero = np.zeros((2, *p.shape))
        flow = zero if flow is None else np.stack([2 * _resized(c, p.shape) for c in flow])
        back = zero if back is None else np.stack([2 * _resized(c, p.shape) for c in back])
        gy, gx = np.mgrid[0 : p.shape[0], 0 : p.shape[1]].astype(float)
        for _ in range(rounds):
            flow = _relaxed(p, q, flow, back, lam, gy, gx)
            back = _relaxed(q, p, back, flow, lam, gy, gx)
    return flow


def _relaxed(p, q, flow, other, lam, gy, gx):
    there = np.stack([bilinear(c, gy + flow[1], gx + flow[0], None) for c in other])
    miss = np.hypot(*(flow + there))
    trust = 1.0 / (1.0 + (miss / max(miss.mean(), 1e-9)) ** 2)
    pad = lambda f: np.pad(f, 1, mode="edge")

    def mean(f):
        w, g = pad(trust), pad(f * trust)
        s = lambda m: m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:]
        return s(g) / np.maximum(s(w), 1e-9)

    m = np.stack([mean(c) for c in flow])
    moved = bilinear(q, gy + m[1], gx + m[0], None)
    dy, dx = np.gradient(moved)
    k = (moved - p) / (lam + dx * dx + dy * dy)
    return m - np.stack([dx * k, dy * k])


def padding(n: int, sectors: tuple[int, ...]) -> tuple[int, int]:
    """Cells to add before and after a side of ``n`` cells so that every number of sectors divides it."""
    lacking = -n % int(np.lcm.reduce(np.array(sectors)))
    return lacking // 2, lacking - lacking // 2


def warped(image: np.ndarray, displacement: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An image read at its places plus a displacement (u, v), and the mask of places outside it."""
    gy, gx = np.mgrid[0 : image.shape[0], 0 : image.shape[1]].astype(float)
    y, x = gy + displacement[1], gx + displacement[0]
    outside = (y < 0) | (y > image.shape[0] - 1) | (x < 0) | (x > image.shape[1] - 1)
    return np.where(outside, 0.0, bilinear(image, y, x, None)), outside


def sector_cost(d: np.ndarray, frames: np.ndarray, gain: float, mask: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Mean squared residual plus roughness of sector displacements ``(2, n, m)``, and a descent direction per sector.

    frames: two or three; of three the middle one is compared with both others,
    read at minus and plus the displacement. Masked cells don't count.
    """
    shape = frames.shape[1:]
    full = np.stack([_resized(c, shape) for c in d])
    pairs = [(frames[-2], frames[-1], 1.0)] if len(frames) == 2 else [(frames[1], frames[0], -1.0), (frames[1], frames[2], 1.0)]
    lap = np.stack([_laplace(c) for c in d])
    cost, grad, size = gain * 1e-3 * float((lap**2).mean()), np.zeros_like(d), np.full_like(d, 1e-3)
    for a, b, sign in pairs:
        moved, outside = warped(b, sign * full)
        keep = ~outside if mask is None else ~outside & ~mask
        miss = np.where(keep, moved - a, 0.0)
        cost += float((miss**2).sum() / max(keep.sum(), 1)) / len(pairs)
        dy, dx = np.gradient(moved)
        grad += sign * np.stack([_shrunk(miss * dx, d.shape[1:]), _shrunk(miss * dy, d.shape[1:])]) / len(pairs)
        size += np.stack([_shrunk((dx * dx + dy * dy) * keep, d.shape[1:])] * 2) / len(pairs)
    return cost, grad / size - gain * 1e-2 * lap


def variational(frames: np.ndarray, sectors: tuple[int, ...] = (2, 4, 8, 16), gain: float = 1.0, rounds: int = 60, mask: np.ndarray | None = None) -> np.ndarray:
    """Displacements of ever finer sectors that lessen residual plus roughness, by descent with falling steps."""
    frames = frames[-2:] if len(frames) == 2 else frames[-3:]
    frames = frames / max(frames.std(), 1e-9)
    shape = frames.shape[1:]
    d = np.stack([c[:1, :1] for c in constant(frames, min(12, min(shape) // 3))])
    for n in sectors:
        d = np.stack([_resized(c, (n, n)) if c.size > 1 else np.full((n, n), c[0, 0]) for c in d])
        rate = 0.5
        best, way = sector_cost(d, frames, gain, mask)
        for _ in range(rounds):
            tried = d - rate * way
            cost, next_way = sector_cost(tried, frames, gain, mask)
            if cost < best:
                d, best, way = tried, cost, next_way
            else:
                rate /= 2
                if rate < 1e-3:
                    break
    return np.stack([_resized(c, shape) for c in d])


def _laplace(c: np.ndarray) -> np.ndarray:
    p = np.pad(c, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * c


def _shrunk(f: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    y = np.minimum(np.arange(f.shape[0]) * shape[0] // f.shape[0], shape[0] - 1)
    x = np.minimum(np.arange(f.shape[1]) * shape[1] // f.shape[1], shape[1] - 1)
    key = (y[:, None] * shape[1] + x[None]).ravel()
    return (np.bincount(key, f.ravel(), shape[0] * shape[1]) / np.bincount(key, minlength=shape[0] * shape[1])).reshape(shape)


def polynomial_flow(frames: np.ndarray, sigma: float = 1.5, window: float = 8.0, rounds: int = 3, levels: int = 3) -> np.ndarray:
    """Flow from local quadratic expansions of both frames, mean over pairs, smoothed."""
    flows = []
    for a, b in zip(frames[:-1], frames[1:]):
        flow = None
        for p, q in reversed(list(zip(_pyramid(a, levels), _pyramid(b, levels)))):
            flow = np.zeros((2, *p.shape)) if flow is None else np.stack([2 * _resized(c, p.shape) for c in flow])
            gy, gx = np.mgrid[0 : p.shape[0], 0 : p.shape[1]].astype(float)
            pa, qa = _quadratic(p, sigma), _quadratic(q, sigma)
            for _ in range(rounds):
                qm = [bilinear(c, gy + flow[1], gx + flow[0], None) for c in qa]
                bx, by, xx, yy, xy = pa[0], pa[1], (pa[2] + qm[2]) / 2, (pa[3] + qm[3]) / 2, (pa[4] + qm[4]) / 4
                rx, ry = (bx - qm[0]) / 2 + xx * flow[0] + xy * flow[1], (by - qm[1]) / 2 + xy * flow[0] + yy * flow[1]
                m = [smooth(g, window) for g in (xx * xx + xy * xy, xy * (xx + yy), yy * yy + xy * xy, xx * rx + xy * ry, xy * rx + yy * ry)]
                lam = 1e-3 * (m[0] + m[2]).mean() + 1e-12
                det = (m[0] + lam) * (m[2] + lam) - m[1] ** 2
                flow = np.stack([((m[2] + lam) * m[3] - m[1] * m[4]) / det, ((m[0] + lam) * m[4] - m[1] * m[3]) / det])
        flows.append(flow)
    return np.stack([smooth(c, 2.0) for c in np.mean(flows, 0)])


def _quadratic(f: np.ndarray, sigma: float) -> list[np.ndarray]:
    """Coefficients of x, y, xx, yy, xy of the local weighted quadratic, by Gaussian derivatives."""
    g = smooth(f, sigma)
    gy, gx = np.gradient(g)
    gyy, gyx = np.gradient(gy)
    _, gxx = np.gradient(gx)
    return [gx, gy, gxx / 2, gyy / 2, gyx]


METHODS = {
    "constant": constant,
    "lucaskanade": dense_lucas_kanade,
    "lk": dense_lucas_kanade,
    "darts": darts,
    "proesmans": lambda f: smooth_flow(f[-2], f[-1]),
    "vet": variational,
    "farneback": polynomial_flow,
    "none": lambda f: np.zeros((2, *f.shape[1:])),
}
