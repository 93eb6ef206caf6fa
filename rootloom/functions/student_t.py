"""Two-sided Student-t probabilities: an Arrow function, for what Spark SQL lacks (the incomplete beta function)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST_P = 1e-300


def _log_beta(a: np.ndarray, b: float) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a) + math.lgamma(b) - lgamma(a + b)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method, all rows at once."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 201):
        before = h.copy()
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - before) <= 3e-14 * np.abs(h)):
            break
    return h


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); the normal limit beyond 1e7 degrees of freedom; at least ``LEAST_P``. An unknown t or df gives 1."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    out = np.ones_like(t)
    normal = (df > 1e7) & np.isfinite(t)
    out[normal] = [math.erfc(v / math.sqrt(2)) for v in t[normal]]
    out[np.isinf(t)] = LEAST_P
    use = np.isfinite(t) & np.isfinite(df) & (df > 0) & ~normal & (t > 0)
    a, x = df[use] / 2, df[use] / (df[use] + t[use] ** 2)
    swap = x > (a + 1) / (a + 2.5)
    p, q = np.where(swap, 0.5, a), np.where(swap, a, 0.5)
    z = np.where(swap, 1 - x, x)
    z = np.clip(z, 1e-300, 1)
    front = np.exp(p * np.log(z) + q * np.log1p(-np.minimum(z, 1 - 1e-16)) - _log_beta(a, 0.5)) / p
    value = front * _fraction(p, q, z)
    out[use] = np.where(swap, 1 - value, value)
    return np.clip(out, LEAST_P, 1)


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided(t.to_numpy(float), df.to_numpy(float)))


def welch_p_value(t: Column, df: Column) -> Column:
    return _p_value(t, df)
