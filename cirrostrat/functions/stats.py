"""Sample moments as pandas has them, and tails of the t and chi-square distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def sample_skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: str) -> Column:
    """Excess kurtosis."""
    n = F.count(c)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / np.where(abs(d) < tiny, tiny, d), np.where(abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(abs(d * c - 1) < 1e-15):
            break
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


@pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided probability of a t statistic with `df` degrees of freedom."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(t) & (df > 0)
    out = np.full(len(t), np.nan)
    out[ok] = incomplete_beta(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    return pd.Series(out).where(ok, None)


def chi2_quantile(p: float, df: float) -> float:
    """Where the chi-square distribution reaches `p`, by bisection on the incomplete gamma series."""

    def cdf(x: float) -> float:
        a, z = df / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))

    low, high = 0.0, max(10.0, df * 10)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2
