"""The exact one-sided Clopper-Pearson upper bound of an error rate, over whole Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of x > 0: Stirling's series, from 15 on."""
    x = np.asarray(x, np.float64)
    shift, at = np.zeros_like(x), x.copy()
    for _ in range(15):
        low = at < 15
        shift = np.where(low, shift - np.log(np.where(low, at, 1.0)), shift)
        at = at + low
    inverse = 1 / at
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return shift + (at - 0.5) * np.log(at) - at + 0.5 * math.log(2 * math.pi) + series


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz); what has converged is left out from time to time."""
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    found, at = np.ones(len(x)), np.arange(len(x))
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 20_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + top * d), safe(1 + top / c)
            step = d * c
            out = out * step
        if m % 8 == 0:
            open_ = np.abs(step - 1) > 1e-15
            found[at[~open_]] = out[~open_]
            at, a, b, x, c, d, out = (v[open_] for v in (at, a, b, x, c, d, out))
            if not len(at):
                break
    found[at] = out
    return found


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = (np.atleast_1d(v) for v in np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x))))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, y, 1 - y)
    part = front * _fraction(p, q, z) / p
    return np.where(inside, np.where(low, part, 1 - part), (x >= 1).astype(float))


def tail(k, n, p) -> np.ndarray:
    """P(X <= k) of n trials at rate p, for 0 <= k < n."""
    return incomplete_beta(np.asarray(n) - k, np.asarray(k) + 1.0, 1 - np.asarray(p, np.float64))


def cp_uppers(k: np.ndarray, n: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The largest error rates under which k or fewer errors in n trials have probability delta; 1 without trials.

    The logarithm of the tail is concave in the rate, so Newton's method finds the root; a step out of the bracket is halved.
    """
    k, n, delta = (np.asarray(v, np.float64) for v in (k, n, delta))
    if ((delta <= 0) | (delta >= 1) | (k < 0) | (k > np.maximum(n, 0))).any():
        raise ValueError("no bound: errors must be among the trials, and delta between 0 and 1")
    out = np.ones(len(k))
    none = (n > 0) & (k == 0)
    out[none] = -np.expm1(np.log(delta[none]) / n[none])
    at = np.flatnonzero((k > 0) & (k < n))
    k, n, delta = k[at], n[at], delta[at]
    low, high = k / n, np.ones(len(at))
    p = np.minimum(low + np.sqrt(-np.log(delta) / (2 * n)), (low + 1) / 2)
    scale = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k)
    for _ in range(100):
        if not len(at):
            break
        reached = tail(k, n, p)
        above = reached > delta
        low, high = np.where(above, p, low), np.where(above, high, p)
        density = np.exp(scale + k * np.log(p) + (n - k - 1) * np.log1p(-p))
        with np.errstate(all="ignore"):
            step = p + (np.log(reached) - np.log(delta)) * reached / density
        fits = np.isfinite(step) & (step > low) & (step < high)
        new = np.where(fits, step, (low + high) / 2)
        out[at] = new
        more = ~(fits & (np.abs(new - p) <= 1e-9 * new)) & (high - low > 4e-16 * high)  # a Newton step squares the error
        at, k, n, delta, low, high, scale, p = (v[more] for v in (at, k, n, delta, low, high, scale, new))
    return out


def cp_upper(k: int, n: int, delta: float) -> float:
    """One bound."""
    return float(cp_uppers(np.array([k]), np.array([n]), np.array([delta]))[0])


def _cp_upper(k: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series(cp_uppers(k.to_numpy(), n.to_numpy(), delta.to_numpy()))


def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The tail; null where k is."""
    some = k.notna().to_numpy()
    out = np.full(len(k), np.nan)
    if some.any():
        out[some] = tail(k.to_numpy(np.float64)[some], n.to_numpy(np.float64)[some], p.to_numpy()[some])
    return pd.Series(out)


def zero_error_bound(n: Column, delta: Column) -> Column:
    return F.when(n > 0, 1 - F.pow(delta, 1.0 / n)).otherwise(F.lit(1.0))


def with_cp_upper(df: DataFrame, k: str, n: str, delta: Column, name: str = "cp_upper") -> DataFrame:
    """df with the bound: closed forms in SQL, and each distinct (k, n, delta) of the middle branch worked out once."""
    keyed = df.withColumn("_delta", delta)
    middle = keyed.where((F.col(k) > 0) & (F.col(k) < F.col(n))).select(F.col(k).alias("_k"), F.col(n).alias("_n"), "_delta").distinct()
    middle = middle.withColumn("_cp", F.pandas_udf(_cp_upper, "double")("_k", "_n", "_delta")).withColumnRenamed("_delta", "_d")
    joined = keyed.join(middle, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")) & (F.col("_delta") == F.col("_d")), "left")
    closed = F.when((F.col(n) <= 0) | (F.col(k) == F.col(n)), F.lit(1.0)).when(F.col(k) == 0, zero_error_bound(F.col(n), F.col("_delta")))
    return joined.withColumn(name, F.coalesce(closed, F.col("_cp"))).drop("_k", "_n", "_d", "_cp", "_delta")


def cp_feasible(k: str, n: str, delta: Column, alpha: Column) -> Column:
    """Whether the bound is alpha at most, without working it out: it is if alpha's tail has probability delta at most.

    Only rows whose empirical rate is alpha at most, with an error, are looked at in Python.
    """
    e, m = F.col(k), F.col(n)
    open_ = F.when((e > 0) & (e < m) & (e <= alpha * m), e)
    reached = F.pandas_udf(_tail, "double")(open_.cast("double"), m.cast("double"), alpha)
    return F.when((m > 0) & (e == 0), F.pow(1 - alpha, m) <= delta).when(open_.isNotNull(), reached <= delta).otherwise(False)
