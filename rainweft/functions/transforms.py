"""Unit conversion and statistical transforms as column expressions.

All take and give columns, so they stay inside whole-stage code. A null gives
null; NaN is brought to null at the scan (``missing_to_null``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZR = (200.0, 1.6)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def missing_to_null(v: Column, fill: float | None = None) -> Column:
    """Non-finite values become null, or ``fill``."""
    good = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return good if fill is None else F.coalesce(good, F.lit(fill))


def db_transform(v: Column, threshold, zerovalue=None) -> Column:
    """10 log10 of values from the threshold (in the input's unit) up; others get zerovalue."""
    thr = _c(threshold)
    zero = 10 * F.log10(thr) - 5.0 if zerovalue is None else _c(zerovalue)
    return F.when(v.isNull(), None).when(v < thr, zero).otherwise(10 * F.log10(v))


def db_inverse(v: Column, threshold=None) -> Column:
    """10^(v/10); values below the threshold (in dB) become 0."""
    out = F.pow(F.lit(10.0), v / 10.0)
    return out if threshold is None else F.when(out < F.pow(F.lit(10.0), _c(threshold) / 10.0), 0.0).otherwise(out)


def boxcox_transform(v: Column, threshold, lam: float = 0.0, zerovalue=None) -> Column:
    """Box-Cox of values from the threshold up; at lambda 0 the logarithm."""
    f = (lambda c: F.log(c)) if lam == 0 else (lambda c: (F.pow(c, F.lit(lam)) - 1.0) / lam)
    thr = _c(threshold)
    zero = f(thr) - 1.0 if zerovalue is None else _c(zerovalue)
    return F.when(v.isNull(), None).when(v < thr, zero).otherwise(f(v))


def boxcox_inverse(v: Column, threshold=None, lam: float = 0.0) -> Column:
    """Inverse Box-Cox; results below the back-transformed threshold become 0."""
    f = (lambda c: F.exp(c)) if lam == 0 else (lambda c: F.pow(F.lit(lam) * c + 1.0, F.lit(1.0 / lam)))
    return f(v) if threshold is None else F.when(f(v) < f(_c(threshold)), 0.0).otherwise(f(v))


def sqrt_transform(v: Column) -> Column:
    return F.sqrt(v)


def sqrt_inverse(v: Column) -> Column:
    return v * v


def _linear(v: Column, transform: Column | str) -> Column:
    t = F.lower(F.coalesce(_c(transform), F.lit("")))
    return F.when(t == "db", db_inverse(v)).when(t.isin("boxcox", "log"), F.exp(v)).when(t == "sqrt", v * v).otherwise(v)


def to_rainrate(v: Column, unit, transform=None, accutime=5.0, zr_a=DEFAULT_ZR[0], zr_b=DEFAULT_ZR[1]) -> Column:
    """mm/h of a value in mm/h, mm or dBZ, its transform undone first."""
    x, u = _linear(v, transform), F.lower(_c(unit))
    x = F.when((u == "dbz") & (F.lower(F.coalesce(_c(transform), F.lit(""))) != "db"), db_inverse(v)).otherwise(x)
    return F.when(u == "mm/h", x).when(u == "mm", x * 60.0 / _c(accutime)).when(u == "dbz", F.pow(x / _c(zr_a), 1.0 / _c(zr_b)))


def to_raindepth(v: Column, unit, transform=None, accutime=5.0, zr_a=DEFAULT_ZR[0], zr_b=DEFAULT_ZR[1]) -> Column:
    """mm of a value in mm/h, mm or dBZ."""
    rate = to_rainrate(v, unit, transform, accutime, zr_a, zr_b)
    return F.when(F.lower(_c(unit)) == "mm", _linear(v, transform)).otherwise(rate * _c(accutime) / 60.0)


def to_reflectivity(v: Column, unit, transform=None, accutime=5.0, zr_a=DEFAULT_ZR[0], zr_b=DEFAULT_ZR[1], zerovalue: float = -15.0) -> Column:
    """dBZ of a value in mm/h, mm or dBZ; no rain gives ``zerovalue``."""
    z = _c(zr_a) * F.pow(to_rainrate(v, unit, transform, accutime, zr_a, zr_b), _c(zr_b))
    return F.when(z <= 0, _c(zerovalue)).otherwise(10 * F.log10(z))


def hann(r: Column) -> Column:
    """Hann taper of a normalised radius; 0 beyond 0.5."""
    return F.when(r > 0.5, 0.0).otherwise(0.5 * (1 - F.cos(2 * F.pi() * (r + 0.5))))


def tukey(r: Column, alpha: float = 0.2) -> Column:
    """Tukey taper of a normalised radius: flat, then a cosine flank of share alpha."""
    flank = 0.5 * (1 + F.cos(F.pi() * (r / (alpha / 2) - 1 / alpha + 1)))
    return F.when(r < 0.5 * (1 - alpha), 1.0).when(r > 0.5, 0.0).otherwise(flank)


def ar1_parameters(g1: Column) -> tuple[Column, Column]:
    """phi1 and the noise scale of an AR(1) process of that lag-1 correlation."""
    return g1, F.sqrt(F.greatest(1 - g1 * g1, F.lit(0.0)))


def adjusted_lag2(g1: Column, g2: Column, variant: int = 2) -> Column:
    """Lag-2 correlation moved into the range that an AR(2) process can have.

    Variant 2 keeps a known oddity: its first bound multiplies both correlations.
    """
    if variant == 1:
        return F.greatest(g2, 2 * g1 * g1 - 1)
    first = F.greatest(g2, 2 * g1 * g2 - 1)
    bound = (3 * g1 * g1 - 2 + 2 * F.pow(F.greatest(1 - g1 * g1, F.lit(0.0)), F.lit(1.5))) / (g1 * g1)
    return F.greatest(first, F.coalesce(F.when(g1 != 0, bound), first))


def ar2_parameters(g1: Column, g2: Column) -> tuple[Column, Column, Column]:
    """phi1, phi2 and the noise scale of an AR(2) process by Yule-Walker."""
    phi1 = g1 * (1 - g2) / (1 - g1 * g1)
    phi2 = (g2 - g1 * g1) / (1 - g1 * g1)
    return phi1, phi2, F.sqrt(F.greatest(1 - g1 * phi1 - g2 * phi2, F.lit(0.0)))
