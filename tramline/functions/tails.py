"""Tail probabilities that Spark lacks, vectorised over Arrow batches.

Each is a small numerical helper over columns; numpy only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.session import importable

# Lanczos approximation of the gamma function, g = 7, nine terms (public, Godfrey).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gammaln(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0."""
    x = np.asarray(x, float) - 1
    total = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 0, 1)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gammaln(p + q) - gammaln(p) - gammaln(q) + p * np.log(y) + q * np.log1p(-y))
    out = np.where(y <= 0, 0.0, front * h / p)
    return np.where(swap, 1 - out, out)


def normal_sf(z: np.ndarray) -> np.ndarray:
    """P(Z > z) by the complementary error function as an incomplete gamma function."""
    z = np.asarray(z, float)
    x = z * z / 2
    out = np.empty_like(x)
    small = x < 1.5
    # Series of the lower incomplete gamma function for small x, continued fraction of the upper one beyond.
    term = total = np.ones_like(x[small]) * 2
    for k in range(1, 60):
        term = term * x[small] / (k + 0.5)
        total = total + term
    root = np.sqrt(np.pi)
    out[small] = 1 - np.sqrt(x[small]) * np.exp(-x[small]) * total / root
    y = x[~small]
    with np.errstate(over="ignore", invalid="ignore"):
        b = y + 0.5
        c, d = np.full_like(y, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 200):
            an = -i * (i - 0.5)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
        out[~small] = np.exp(-y) * np.sqrt(y) * h / root
    return np.where(z >= 0, out / 2, 1 - out / 2)


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    t2 = t.to_numpy(float) ** 2
    d = dof.to_numpy(float)
    return pd.Series(np.where(np.isnan(t2) | np.isnan(d), np.nan, betainc(d / 2, 0.5, d / (d + t2))))


@F.pandas_udf(T.DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _ln_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(gammaln(x.to_numpy(float)))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t."""
    importable(SparkSession.getActiveSession())
    return _t_two_sided(t, dof)


def normal_two_sided(z: Column) -> Column:
    importable(SparkSession.getActiveSession())
    return 2 * _normal_sf(F.abs(z))


def normal_cdf(z: Column) -> Column:
    importable(SparkSession.getActiveSession())
    return _normal_sf(-z)


def ln_gamma(x: Column) -> Column:
    importable(SparkSession.getActiveSession())
    return _ln_gamma(x.cast("double"))
