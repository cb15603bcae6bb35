"""Wrappers for kernels and functions: checked inputs, caching by key, renamed arguments."""

from __future__ import annotations

import functools
import inspect
import warnings
from collections import OrderedDict
from collections.abc import Callable

import numpy as np


def checked_frames(least: int = 2, most: float = np.inf, only_shape: bool = False) -> Callable:
    """The first argument must be ``(t, y, x)`` with a number of frames within bounds."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(frames, *args, **how):
            a = np.asarray(frames)
            if a.ndim != 3:
                raise ValueError(f"frames need three dimensions, not {a.ndim}")
            if not only_shape and not least <= len(a) <= most:
                raise ValueError(f"{f.__name__} needs {least} to {most} frames, not {len(a)}")
            return f(frames, *args, **how)

        return run

    return wrap


def cached(size: int = 10) -> Callable:
    """Keeps the last ``size`` results by the keyword ``key``; without it nothing is kept. The cache is a worker's own."""

    def wrap(f: Callable) -> Callable:
        held: OrderedDict = OrderedDict()

        @functools.wraps(f)
        def run(*args, key=None, **how):
            if key is None:
                return f(*args, **how)
            if key in held:
                held.move_to_end(key)
                return held[key]
            held[key] = f(*args, **how)
            if len(held) > size:
                held.popitem(last=False)
            return held[key]

        run.held = held
        return run

    return wrap


def renamed_arguments(names: dict[str, str], until: str) -> Callable:
    """Old keyword names go on working with a warning; both at once is an error."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args, **how):
            for old, new in names.items():
                if old in how:
                    if new in how:
                        raise TypeError(f"{old} is an old name of {new}; give one of them")
                    warnings.warn(f"{old} is now called {new} and goes in {until}", FutureWarning, stacklevel=2)
                    how[new] = how.pop(old)
            return f(*args, **how)

        return run

    return wrap


def point_interpolator(f: Callable) -> Callable:
    """Checks points ``(n, 2)`` and values ``(n[, k])`` for a function (points, values, x, y) to ``(k, y, x)``.

    Without points the result is 0, one point or equal values give a constant;
    values that aren't finite are an error.
    """

    @functools.wraps(f)
    def run(points, values, x, y, **how):
        p, v = np.asarray(points, float), np.asarray(values, float)
        v = v[:, None] if v.ndim == 1 else v
        if p.size == 0:
            return np.zeros((v.shape[1] if v.ndim == 2 else 1, len(y), len(x)))
        if p.ndim != 2 or p.shape[1] != 2 or len(p) != len(v):
            raise ValueError("points are rows of x and y, one for each value")
        if not (np.isfinite(p).all() and np.isfinite(v).all()):
            raise ValueError("points and values must be finite")
        if len(p) == 1 or (v == v[0]).all():
            return np.broadcast_to(v[0][:, None, None], (v.shape[1], len(y), len(x))).copy()
        return f(p, v, np.asarray(x, float), np.asarray(y, float), **how)

    return run


def documented(target: Callable, text: str) -> Callable:
    """Adds text to a function's documentation."""
    target.__doc__ = f"{inspect.getdoc(target) or ''}\n\n{text}".strip()
    return target
