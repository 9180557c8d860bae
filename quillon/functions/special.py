"""Special functions the JVM lacks, as Arrow-batched functions over numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def erf_values(x: np.ndarray) -> np.ndarray:
    """erf of each value. A function of the module, so that workers find it by name: a vectorised one that ran once cannot be sent."""
    return _erf(x)


def erfinv(y: np.ndarray) -> np.ndarray:
    """Inverse error function: a rational start (Winitzki) and three Newton steps."""
    y = np.asarray(y, float)
    with np.errstate(all="ignore"):
        a = 0.147
        ln = np.log1p(-y * y)
        t = 2 / (math.pi * a) + ln / 2
        x = np.sign(y) * np.sqrt(np.sqrt(t * t - ln / a) - t)
        for _ in range(3):
            x = x - (_erf(x) - y) / (2 / math.sqrt(math.pi) * np.exp(-x * x))
        return np.where(np.abs(y) >= 1, np.sign(y) * np.inf, np.where(y == 0, 0.0, x))


def lower_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    with np.errstate(all="ignore"):
        scale = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 400):
            term = term * x / (a + n)
            total = total + term
        series = total * scale
        tiny = 1e-300
        b = x + 1 - a
        c = np.full(a.shape, 1 / tiny)
        d = 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 400):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        fraction = 1 - scale * h
    out = np.where(x <= 0, 0.0, np.where(x < a + 1, series, fraction))
    return out


def erf(col: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(erf_values(x.to_numpy(float))) if len(x) else x.astype(float)

    return F.when(col.isNotNull(), run(F.coalesce(col.cast("double"), F.lit(0.0))))


def erf_inverse(col: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(erfinv(x.to_numpy(float)))

    return F.when(col.isNotNull(), run(F.coalesce(col.cast("double"), F.lit(0.0))))


def chi_square_cdf(chi2: Column, ndf: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(lower_gamma(n.to_numpy(float) / 2, x.to_numpy(float) / 2))

    return F.when(chi2.isNotNull() & (ndf > 0), run(F.coalesce(chi2.cast("double"), F.lit(0.0)), F.greatest(F.coalesce(ndf.cast("double"), F.lit(1.0)), F.lit(1.0))))


def log_factorial(k: Column) -> Column:
    """ln k! as column arithmetic: exact to 20, Stirling's series beyond."""
    k = k.cast("double")
    n = k + 1
    stirling = (n - 0.5) * F.ln(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5.0)))
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20.0)).cast("int")).cast("double"))).otherwise(stirling)
