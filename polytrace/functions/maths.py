"""Arithmetic that keeps IEEE results where Spark's default would be null or an error, order statistics, and Student's t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _log(v: Column, of) -> Column:
    return F.when(v > 0, of(v)).when(v == 0, F.lit(-INF)).when(v.isNotNull(), F.lit(NAN))


def ln(v: Column) -> Column:
    """Natural logarithm: -Infinity at 0, NaN below."""
    return _log(v, F.log)


def log10(v: Column) -> Column:
    return _log(v, F.log10)


def ratio(a: Column, b: Column) -> Column:
    """a / b: infinite or NaN where b is 0."""
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b != 0, a / b).when(b == 0, at_zero)


def root(v: Column) -> Column:
    return F.when(v >= 0, F.sqrt(v)).when(v.isNotNull(), F.lit(NAN))


def number(v: Column) -> Column:
    """null where v is NaN, so that minima and maxima pass over it."""
    return F.when(~F.isnan(v), v)


def plain(v: Column, digits: int | None = None) -> Column:
    """v, rounded if asked, without negative zero."""
    return (F.round(v, digits) if digits is not None else v) + F.lit(0.0)


def quantile_of_sorted(values: Column, q: float) -> Column:
    """The mean of the elements floor((n-1) q) and floor(n q) of an ascending array; the latter falls back to the former at the end."""
    n = F.size(values)
    low = F.floor((n - 1) * F.lit(q)).cast("int")
    high = F.floor(n * F.lit(q)).cast("int")
    return (F.get(values, low) + F.get(values, F.when(high >= n, low).otherwise(high))) / 2


def sorted_quantile(x: np.ndarray, q: float) -> float:
    """The same quantile of an ascending numpy array."""
    low, high = int((len(x) - 1) * q), int(len(x) * q)
    return (x[low] + x[high if high < len(x) else low]) / 2


def group_quantile(v: Column, q: float) -> Column:
    """Aggregate: the quantile of a group, whose values must fit into one array."""
    return quantile_of_sorted(F.array_sort(F.collect_list(v)), q)


def trial_quantile_of_sorted(values: Column, q: float) -> Column:
    """The other quantile, of latency statistics: with u = ceil(n q), clamped at the ends, s[u-1] f + s[u] (1 - f) where f = min(n mod 1/q, 1)."""
    n = F.size(values)
    u = F.ceil(n * F.lit(q)).cast("int")
    f = F.least(F.pmod(n.cast("double"), F.lit(1.0 / q)), F.lit(1.0)) if q > 0 else F.lit(0.0)
    inner = F.get(values, u - 1) * f + F.get(values, u) * (1 - f)
    return F.when(n == 0, None).when(u < 1, F.get(values, F.lit(0))).when(u >= n, F.get(values, n - 1)).otherwise(inner)


# ------------------------------------------------------------------ Student's t


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """The regularised incomplete beta function by Lentz's continued fraction, on arrays."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0, 1)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(abs(d) < tiny, tiny, d)
        total = d.copy()
        for m in range(1, steps):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(abs(c) < tiny, tiny, c)
                total = total * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        part = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * total))
    return np.where(swap, 1 - part, part)


def student_two_sided(df: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with df degrees of freedom; NaN without any."""
    df, t = np.broadcast_arrays(np.asarray(df, np.float64), np.asarray(t, np.float64))
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    bad = ~(df > 0) | np.isnan(t)
    out = incomplete_beta(np.where(bad, 1, df) / 2, 0.5, np.where(bad, 0.5, x))
    return np.where(bad, NAN, out)


def student_quantile(df: float, p: float) -> float:
    """The t whose two-sided probability is p, by bisection."""
    low, high = 0.0, 1.0
    while student_two_sided(df, high) > p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_two_sided(df, mid) > p else (low, mid)
    return (low + high) / 2


def student_p(df: Column, t: Column) -> Column:
    """Two-sided probability of t; batches go through numpy."""

    def run(df: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided(df.to_numpy(float), t.to_numpy(float)))

    return F.coalesce(F.pandas_udf(run, "double")(df, t), F.lit(NAN))  # Arrow hands NaN back as null


def binomial_two_sided(k1: Column, k2: Column) -> Column:
    """Probability of so uneven counts or more if both outcomes are equally likely."""

    def run(k1: pd.Series, k2: pd.Series) -> pd.Series:
        n, k = (k1 + k2).to_numpy(float), np.maximum(k1, k2).to_numpy(float)
        tail = incomplete_beta(np.maximum(k, 1e-9), np.maximum(n - k + 1, 1e-9), 0.5)
        return pd.Series(np.where(n > 0, np.minimum(1.0, 2 * tail), 1.0))

    return F.pandas_udf(run, "double")(k1, k2)
