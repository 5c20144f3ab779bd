"""Aggregates shared by validation, monitoring and metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TINY = 1e-10


def corr_agg(a: Column | str, b: Column | str) -> Column:
    """Correlation of two columns without missing values; NULL when one is constant."""
    sa, sb = F.stddev_samp(a), F.stddev_samp(b)
    return F.when((sa > TINY) & (sb > TINY), F.covar_samp(a, b) / (sa * sb))


def quotient(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def skew_pandas(x: Column | str) -> Column:
    """Bias-corrected skewness."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > TINY),
                  F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n != 2, n - 2))


def kurt_pandas(x: Column | str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when((n > 3) & (F.stddev_pop(x) > TINY), ((n + 1) * F.kurtosis(x) + 6) * (n - 1)
                  / F.when((n != 2) & (n != 3), (n - 2) * (n - 3)))


def _t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta."""
    from math import exp, lgamma, log
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0

    def fraction(a, b, x):
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / (1.0 + num * d or 1e-300)
                c = 1.0 + num / c or 1e-300
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                return h
        return float("nan")
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value; meant for summary rows, one call per row of an Arrow batch."""
    @F.pandas_udf(T.DoubleType())
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([_t_two_sided(a, b) if a == a and b > 0 else np.nan
                          for a, b in zip(ts.astype(float), dfs.astype(float))])
    out = p(t.cast("double"), df.cast("double"))
    return F.when(~F.isnan(out), out)
