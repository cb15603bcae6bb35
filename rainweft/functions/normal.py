"""The normal distribution in column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Distribution function by the complementary error function."""
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse by bisection of the distribution function over distinct arguments, then Newton steps."""
    q, back = np.unique(p, return_inverse=True)
    x = np.zeros_like(q)
    lo, hi = np.full_like(q, -9.0), np.full_like(q, 9.0)
    for _ in range(24):
        x = (lo + hi) / 2
        below = normal_cdf(x) < q
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    for _ in range(3):
        x = x - (normal_cdf(x) - q) / (np.exp(-x * x / 2) / math.sqrt(2 * math.pi))
    return x[back]


@F.pandas_udf(DoubleType())
def _inverse(p: pd.Series) -> pd.Series:
    good = p.notna() & (p > 0) & (p < 1)
    out = pd.Series(np.nan, index=p.index)
    out[good] = normal_quantile(p[good].to_numpy())
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    x = _inverse(p)
    return F.when(~F.isnan(x), x)
