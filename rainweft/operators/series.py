"""Temporal correlation and autoregressive models over rasters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _from_last(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``back``: steps before the last frame of the cell's own keys."""
    last = cells.groupBy(*keys).agg(F.max("t").alias("_last"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = cells.join(last.select(*[F.col(k).alias(f"_{k}") for k in keys], "_last"), on)
    return joined.withColumn("back", (F.col("_last") - F.col("t")).cast("int")).select(*cells.columns, "back")


def lag_correlations(cells: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), differenced: bool = False) -> DataFrame:
    """``(keys, lag, gamma)``: correlation of the last frame with earlier ones over the cells present in both.

    With ``differenced`` the frames are first replaced by their changes.
    """
    if differenced:
        w = Window.partitionBy(*keys, "y", "x").orderBy("t")
        cells = cells.withColumn("v", F.col("v") - F.lag("v").over(w))
    cells = _from_last(cells, keys)
    wide = cells.groupBy(*keys, "y", "x").agg(*[F.max(F.when(F.col("back") == k, F.col("v"))).alias(f"l{k}") for k in (0, *lags)])
    g = wide.groupBy(*keys).agg(*[F.corr("l0", f"l{k}").alias(f"g{k}") for k in lags])
    packed = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("lag"), F.col(f"g{k}").alias("gamma")) for k in lags])).alias("e")
    return g.select(*keys, packed).select(*keys, "e.lag", "e.gamma")


def cross_correlations(variables: DataFrame, lags: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, lag, i, j, gamma)`` between variables: ``variables`` has (keys, var, t, y, x, v)."""
    v = _from_last(variables, keys)
    now = v.where("back = 0").select(*keys, F.col("var").alias("i"), "y", "x", F.col("v").alias("a"))
    past = v.where(F.col("back").isin(list(lags))).select(*keys, F.col("var").alias("j"), F.col("back").alias("lag"), "y", "x", F.col("v").alias("b"))
    return now.join(past, [*keys, "y", "x"]).groupBy(*keys, "lag", "i", "j").agg(F.corr("a", "b").alias("gamma"))


def iterate_ar(cells: DataFrame, phi: Sequence[float], noise: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One step: the next value of each cell from its last ``p`` ones; phi ends with the noise scale."""
    p = len(phi) - 1
    value = sum((F.max(F.when(F.col("back") == k, F.col("v"))) * float(phi[k]) for k in range(p)), F.lit(0.0))
    if noise:
        value = value + float(phi[p]) * F.max(F.when(F.col("back") == 0, F.col(noise)))
    return _from_last(cells, keys).groupBy(*keys, "y", "x").agg((F.max("t") + 1).alias("t"), value.alias("v")).select(*keys, "t", "y", "x", "v")


def iterate_var(cells: DataFrame, phi: Sequence[np.ndarray], keys: Sequence[str] = ()) -> DataFrame:
    """One step of a vector model: ``cells`` has (var, t, y, x, v); phi holds one matrix per lag."""
    spark = cells.sparkSession
    rows = [(k + 1, i, j, float(m[i, j])) for k, m in enumerate(phi) for i in range(m.shape[0]) for j in range(m.shape[1])]
    coefficients = spark.createDataFrame(rows, "lag int, i int, var int, c double")
    past = _from_last(cells, keys).withColumn("lag", F.col("back") + 1)
    return past.join(F.broadcast(coefficients), ["lag", "var"]).groupBy(*keys, F.col("i").alias("var"), "y", "x").agg(F.sum(F.col("v") * F.col("c")).alias("v"))  # lags x variables squared rows


def _lagged(cells: DataFrame, p: int, d: int, keys: Sequence[str]) -> DataFrame:
    """``(keys, t, y, x, x0..xp)``: each value (or its change, with ``d`` 1) beside its p predecessors; rows that lack one go."""
    w = Window.partitionBy(*keys, "y", "x").orderBy("t")
    if d:
        cells = cells.withColumn("v", F.col("v") - F.lag("v").over(w))
    x = cells.select(*keys, "t", "y", "x", *[(F.col("v") if k == 0 else F.lag("v", k).over(w)).alias(f"x{k}") for k in range(p + 1)])
    return x.where(" and ".join(f"x{k} is not null" for k in range(p + 1)))


def ols_sums(cells: DataFrame, p: int, keys: Sequence[str] = (), d: int = 0, constant: bool = False) -> DataFrame:
    """Normal-equation sums of an AR(p) fit: products of each frame with its p predecessors, over all cells.

    With ``constant`` also the plain sums ``c0..cp``. Sums of parts of a table add up.
    """
    x = _lagged(cells, p, d, keys)
    plain = [F.sum(f"x{i}").alias(f"c{i}") for i in range(p + 1)] if constant else []
    return x.groupBy(*keys).agg(F.count("*").alias("n"), *plain, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(p + 1) for j in range(i, p + 1)])


def ols_parameters(sums: dict, p: int, lam: float = 0.0, constant: bool = False, check: bool = True) -> np.ndarray:
    """phi_1..phi_p and the noise scale from the sums, the constant term before them if asked for; ``lam`` is a ridge."""
    s = np.array([[sums[f"s{min(i, j)}{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    a, b = s[1:, 1:] + lam * np.eye(p), s[1:, 0]
    if constant:
        c = np.array([sums[f"c{i}"] for i in range(1, p + 1)])
        a = np.block([[np.array([[sums["n"]]]), c[None, :]], [c[:, None], a]])
        b = np.append(sums["c0"], b)
    found = np.linalg.solve(a, b)
    if check and not stationary(found[constant:]):
        raise ValueError("the estimated process isn't stationary")
    rest = max(s[0, 0] - found @ b, 0.0) / s[0, 0]
    return np.append(found, np.sqrt(rest))


def ols_fits(cells: DataFrame, p: int, keys: Sequence[str] = (), d: int = 0, lam: float = 0.0) -> DataFrame:
    """``(keys, phi_1..phi_p, phi_0)`` of an AR(p) fit, p 1 or 2, solved beside the data in closed form.

    phi_0 is the noise scale. With ``d`` 1 the fit is that of the changes.
    """
    return _solved(ols_sums(cells, p, keys, d), p, keys, lam)


def _solved(sums: DataFrame, p: int, keys: Sequence[str], lam: float) -> DataFrame:
    c = {k: F.col(k) for k in sums.columns}
    if p == 1:
        phi = [F.try_divide(c["s01"], c["s11"] + lam)]
    elif p == 2:
        a, b, e = c["s11"] + lam, c["s12"], c["s22"] + lam
        det = a * e - b * b
        phi = [F.when(det != 0, (e * c["s01"] - b * c["s02"]) / det), F.when(det != 0, (a * c["s02"] - b * c["s01"]) / det)]
    else:
        raise ValueError("closed forms are there for p 1 and 2; use ols_sums and ols_parameters")
    rest = F.greatest(c["s00"] - sum((f * c[f"s0{k + 1}"] for k, f in enumerate(phi)), F.lit(0.0)), F.lit(0.0))
    rest = F.try_divide(rest, c["s00"])
    return sums.select(*keys, *[f.alias(f"phi_{k + 1}") for k, f in enumerate(phi)], F.when(c["s00"] > 0, F.sqrt(rest)).alias("phi_0"))


def ols_fits_localized(cells: DataFrame, p: int, radius: float, keys: Sequence[str] = (), d: int = 0, lam: float = 0.0, window: str = "gaussian", offset_limit: float = 3.0) -> DataFrame:
    """``(keys, y, x, phi_1..phi_p, phi_0)``: a fit per cell from sums weighted over its surroundings.

    window: ``gaussian`` of deviation ``radius`` (up to ``offset_limit`` of them)
    or ``uniform`` (a square of that half width). Products are summed over time
    first, so one row per cell is sent to each place of its window.
    """
    x = _lagged(cells, p, d, keys)
    names = [f"s{i}{j}" for i in range(p + 1) for j in range(i, p + 1)]
    own = x.groupBy(*keys, "y", "x").agg(*[F.sum(F.col(f"x{n[1]}") * F.col(f"x{n[2]}")).alias(n) for n in names])
    return _solved(_windowed(own, names, radius, keys, window, offset_limit), p, [*keys, "y", "x"], lam)


def _windowed(own: DataFrame, names: Sequence[str], radius: float, keys: Sequence[str], window: str, limit: float) -> DataFrame:
    """Weighted sums of columns over the window of each cell, along y then along x."""
    reach = int(radius * limit) if window == "gaussian" else int(radius)
    if window not in ("gaussian", "uniform"):
        raise ValueError(window)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    weight = F.exp(-F.pow(F.col("_k") / float(radius), F.lit(2.0)) / 2) if window == "gaussian" else F.lit(1.0)
    for axis in ("y", "x"):
        ends = own.groupBy(*keys).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
        spread = own.withColumn("_k", F.explode(steps)).withColumn("_w", weight).withColumn(axis, F.col(axis) + F.col("_k"))
        own = spread.groupBy(*keys, "y", "x").agg(*[F.sum(F.col(n) * F.col("_w")).alias(n) for n in names])
        inside = F.col(axis).between(F.col("_lo"), F.col("_hi"))
        own = own.join(ends, list(keys)) if keys else own.withColumn("_lo", ends.select("_lo").scalar()).withColumn("_hi", ends.select("_hi").scalar())
        own = own.where(inside).drop("_lo", "_hi")
    return own


def yule_walker_localized(gammas: DataFrame, keys: Sequence[str] = ("y", "x"), d: int = 0) -> DataFrame:
    """``(keys, phi_1.., phi_0)`` of ``(keys, gamma_1[, gamma_2])``: the Yule-Walker solution of each cell in closed form."""
    second = "gamma_2" in gammas.columns
    g1 = F.col("gamma_1")
    if not second:
        phi, scale = [g1], F.sqrt(F.greatest(1 - g1 * g1, F.lit(0.0)))
    else:
        g2 = F.col("gamma_2")
        det = 1 - g1 * g1
        phi = [F.when(det != 0, g1 * (1 - g2) / det), F.when(det != 0, (g2 - g1 * g1) / det)]
        scale = F.sqrt(F.greatest(1 - g1 * phi[0] - g2 * phi[1], F.lit(0.0)))
    if d:
        phi = [1 + phi[0], *[b - a for a, b in zip(phi, phi[1:])], -phi[-1]]
    return gammas.select(*keys, *[f.alias(f"phi_{k + 1}") for k, f in enumerate(phi)], scale.alias("phi_0"))


def var_sums(variables: DataFrame, p: int, keys: Sequence[str] = (), d: int = 0) -> DataFrame:
    """``(keys, a_var, a_lag, b_var, b_lag, s, n)``: the normal-equation sums of a VAR(p) fit over all cells.

    ``variables`` has (keys, var, t, y, x, v); lag 0 is the value itself. A term
    counts where every variable has all its lags.
    """
    x = _lagged(variables, p, d, [*keys, "var"])
    q = variables.select("var").distinct()
    many = F.count("*").over(Window.partitionBy(*keys, "t", "y", "x"))
    whole = x.withColumn("_n", many).join(F.broadcast(q.agg(F.count("*").alias("_q"))), F.col("_n") == F.col("_q")).drop("_n", "_q")  # one row
    terms = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("v")) for k in range(p + 1)]))
    e = whole.select(*keys, "t", "y", "x", "var", terms.alias("e")).select(*keys, "t", "y", "x", F.struct("var", "e.lag", "e.v").alias("e"))
    # all terms of a cell meet in one small array: q * (p + 1) of them
    cell = e.groupBy(*keys, "t", "y", "x").agg(F.collect_list("e").alias("m"))
    pairs = cell.select(*keys, F.explode("m").alias("a"), "m").select(*keys, "a", F.explode("m").alias("b"))
    return pairs.groupBy(*keys, F.col("a.var").alias("a_var"), F.col("a.lag").alias("a_lag"), F.col("b.var").alias("b_var"), F.col("b.lag").alias("b_lag")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("s"), F.count("*").alias("n"))


def var_parameters(sums: Sequence[tuple], q: int, p: int, lam: float = 0.0, check: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
    """Matrices phi_1..phi_p and the covariance of the rest from rows (a_var, a_lag, b_var, b_lag, s, n) of ``var_sums``."""
    s = np.zeros((q * (p + 1), q * (p + 1)))
    n = 0
    for a, i, b, j, value, n in sums:
        s[i * q + a, j * q + b] = value
    z, y = s[q:, q:] + lam * np.eye(q * p), s[q:, :q]
    phi = np.linalg.solve(z, y).T
    rest = (s[:q, :q] - phi @ y) / max(n, 1)
    found = [phi[:, k * q : (k + 1) * q] for k in range(p)]
    if check and not var_stationary(found):
        raise ValueError("the estimated process isn't stationary")
    return found, rest


def var_fits_localized(variables: DataFrame, p: int, radius: float, q: int, keys: Sequence[str] = (), lam: float = 0.0, window: str = "gaussian", offset_limit: float = 3.0) -> DataFrame:
    """``(keys, y, x, phi)``: VAR(p) matrices of every cell, row by row of phi_1, then phi_2 and so on.

    Products of each cell are summed over time, weighted over the window, and
    solved per cell in vectors of Arrow rows. Variables are numbered 0..q-1.
    """
    x = _lagged(variables, p, 0, [*keys, "var"])
    wide = x.groupBy(*keys, "t", "y", "x").agg(*[F.max(F.when(F.col("var") == a, F.col(f"x{i}"))).alias(f"v{i}_{a}") for i in range(p + 1) for a in range(q)])
    terms = [(i, a) for i in range(p + 1) for a in range(q)]
    names = {f"m{j}_{b}__{i}_{a}": F.sum(F.col(f"v{j}_{b}") * F.col(f"v{i}_{a}")) for j, b in terms if j for i, a in terms}
    own = wide.groupBy(*keys, "y", "x").agg(*[c.alias(k) for k, c in names.items()])
    sums = _windowed(own, list(names), radius, keys, window, offset_limit)

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            later = [(j, b) for j, b in terms if j]
            left = np.stack([np.stack([get(f"m{j}_{b}__{i}_{a}") for i, a in later], 1) for j, b in later], 1) + lam * np.eye(q * p)
            right = np.stack([np.stack([get(f"m{j}_{b}__0_{a}") for a in range(q)], 1) for j, b in later], 1)
            good = np.isfinite(left).all((1, 2)) & np.isfinite(right).all((1, 2))
            good[good] = np.abs(np.linalg.det(left[good])) > 0
            phi = np.full((len(left), p, q, q), np.nan)
            if good.any():
                found = np.swapaxes(np.linalg.solve(left[good], right[good]), 1, 2)  # (cells, q, p * q)
                phi[good] = np.swapaxes(found.reshape(-1, q, p, q), 1, 2)
            flat = phi.reshape(len(phi), -1)
            kept = [batch.column(k) for k in (*keys, "y", "x")]
            values = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel(), mask=np.isnan(flat.ravel())), flat.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, values], names=[*keys, "y", "x", "phi"])

    types = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in (*keys, "y", "x"))
    return sums.mapInArrow(run, f"{types}, phi array<double>")


def var_yule_walker_localized(gammas: np.ndarray) -> np.ndarray:
    """Vector Yule-Walker solution of every cell: (lag 0..p, q, q, cells) to (p, q, q, cells); singular cells are NaN."""
    p, q, n = len(gammas) - 1, gammas.shape[1], gammas.shape[3]
    g = np.moveaxis(gammas, 3, 0)
    left = np.zeros((n, p * q, p * q))
    for i in range(p):
        for j in range(p):
            block = g[:, abs(i - j)]
            left[:, i * q : (i + 1) * q, j * q : (j + 1) * q] = block if i >= j else np.swapaxes(block, 1, 2)
    right = np.concatenate([np.swapaxes(g[:, k], 1, 2) for k in range(1, p + 1)], 1)
    out = np.full((n, p * q, q), np.nan)
    good = np.abs(np.linalg.det(left)) > 1e-12
    out[good] = np.linalg.solve(left[good], right[good])
    return np.moveaxis(np.swapaxes(out, 1, 2).reshape(n, q, p, q), (2, 1, 3, 0), (0, 1, 2, 3))


def moving_lag_correlations(cells: DataFrame, lag: int, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, y, x, gamma)``: correlation of the last frame with that ``lag`` before, in a gaussian window about each cell."""
    b = _from_last(cells, keys)
    wide = b.groupBy(*keys, "y", "x").agg(F.max(F.when(F.col("back") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("back") == lag, F.col("v"))).alias("b")).where("a is not null and b is not null")
    own = wide.select(*keys, "y", "x", F.lit(1.0).alias("n"), "a", "b", (F.col("a") * F.col("a")).alias("aa"), (F.col("b") * F.col("b")).alias("bb"), (F.col("a") * F.col("b")).alias("ab"))
    s = _windowed(own, ["n", "a", "b", "aa", "bb", "ab"], radius, keys, "gaussian", 3.0)
    n = F.col("n")
    va, vb, c = F.col("aa") / n - F.pow(F.col("a") / n, F.lit(2.0)), F.col("bb") / n - F.pow(F.col("b") / n, F.lit(2.0)), F.col("ab") / n - F.col("a") * F.col("b") / (n * n)
    return s.select(*keys, "y", "x", F.when((va > 1e-12) & (vb > 1e-12), c / F.sqrt(va * vb)).alias("gamma"))


def yule_walker(gamma: Sequence[float], d: int = 0, check: bool = True) -> np.ndarray:
    """AR parameters from lag correlations; last the noise scale. ``d`` 1: of the differenced series."""
    p = len(gamma)
    g = np.concatenate([[1.0], gamma])
    phi = np.linalg.solve(g[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))], g[1:])
    if check and not stationary(phi):
        raise ValueError("the estimated process isn't stationary")
    scale = np.sqrt(max(1.0 - float(np.dot(gamma, phi)), 0.0))
    return np.append(phi if d == 0 else undifferenced(phi), scale)


def undifferenced(phi: np.ndarray) -> np.ndarray:
    """Coefficients of the AR(p+1) process whose first differences follow AR(p)."""
    return np.convolve(np.concatenate([[1.0], -np.asarray(phi)]), [1.0, -1.0])[1:] * -1.0


def stationary(phi: Sequence[float]) -> bool:
    """Whether all roots lie inside the unit circle."""
    return bool((np.abs(np.roots(np.concatenate([[1.0], -np.asarray(phi, float)]))) < 1).all())


def var_stationary(phi: Sequence[np.ndarray]) -> bool:
    q, p = phi[0].shape[0], len(phi)
    companion = np.zeros((p * q, p * q))
    companion[:q] = np.hstack(phi)
    companion[q:, :-q] = np.eye((p - 1) * q)
    return bool((np.abs(np.linalg.eigvals(companion)) < 1).all())


def ar_acf(gamma: Sequence[float], n: int) -> np.ndarray:
    """Lag correlations continued to ``n`` by the process they define."""
    phi, out = yule_walker(gamma, check=False)[:-1], [1.0, *gamma]
    while len(out) < n + 1:
        out.append(float(np.dot(phi, out[-1 : -len(phi) - 1 : -1])))
    return np.array(out[1 : n + 1])


def var_yule_walker(gamma: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Matrices of a vector process from its lag matrices gamma[0..p]."""
    q, p = gamma[0].shape[0], len(gamma) - 1
    big = np.block([[gamma[abs(i - j)] if i >= j else gamma[abs(i - j)].T for j in range(p)] for i in range(p)])
    phi = np.linalg.solve(big, np.vstack([gamma[k].T for k in range(1, p + 1)])).T
    return [phi[:, k * q : (k + 1) * q] for k in range(p)]
