"""Rolling least-squares regressions: y on x, x on time, and autoregression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.feature import TINY, Feature, as_feature, row
from quantloom.functions.registry import function, register
from quantloom.functions.rolling import ROW_NUMBER, along, paired, rolling, window

_PARTS = ("slope", "intercept", "resid", "predict", "rsq")


def _pair_fit(y, x, d, part) -> Feature:
    py, px = paired(y, x)

    def fit(f, b, a):
        ok = (F.count(a).over(f) >= 3) & (F.var_samp(a).over(f) > 1e-15)
        if part == "slope":
            return F.when(ok, F.regr_slope(b, a).over(f))
        if part == "intercept":
            return F.when(ok, F.regr_intercept(b, a).over(f))
        syy = F.regr_syy(b, a).over(f)
        return F.when(ok, F.when(syy > TINY, F.regr_r2(b, a).over(f)).otherwise(0.0))
    if part in ("slope", "intercept", "rsq"):
        return rolling(f"reg_{part}", d, fit, py, px)
    fitted = _pair_fit(y, x, d, "intercept") + _pair_fit(y, x, d, "slope") * x
    return fitted if part == "predict" else as_feature(y) - fitted


def _trend_fit(x, d, part) -> Feature:
    d, x = window(d), as_feature(x)
    if d < 3:
        return row("missing", lambda a: F.lit(None).cast("double"), x)

    def fit(f, a, n):
        here = F.when(a.isNotNull(), n)
        ok = a.isNotNull() & (F.count(a).over(f) >= 3)
        if part == "slope":
            return F.when(ok, F.regr_slope(a, here).over(f))
        if part == "level":
            # value of the fitted line now: centring at the current row keeps row numbers small
            return F.when(ok, F.avg(a).over(f)
                          + F.regr_slope(a, here).over(f) * (n - F.avg(here).over(f)))
        syy = F.regr_syy(a, here).over(f)
        return F.when(ok, F.when(syy > TINY, F.regr_r2(a, here).over(f)).otherwise(0.0))
    if part in ("slope", "rsq", "level"):
        return rolling(f"trend_{part}", d, fit, x, ROW_NUMBER)
    level = _trend_fit(x, d, "level")
    if part == "predict":
        return level
    if part == "resid":
        return x - level
    return level - _trend_fit(x, d, "slope") * float(d - 1)


@function("reg", "ts_reg_slope")
def reg_slope(y, x, d):
    return _pair_fit(y, x, d, "slope")


@function("reg", "ts_reg_intercept")
def reg_intercept(y, x, d):
    return _pair_fit(y, x, d, "intercept")


@function("reg", "ts_reg_resid", "ts_regression_residual")
def reg_resid(y, x, d):
    return _pair_fit(y, x, d, "resid")


@function("reg", "ts_reg_predict")
def reg_predict(y, x, d):
    return _pair_fit(y, x, d, "predict")


@function("reg", "ts_reg_rsq")
def reg_rsq(y, x, d):
    return _pair_fit(y, x, d, "rsq")


@function("reg")
def ts_regression(y, x, d, rettype=2):
    """rettype: 0 slope, 1 intercept, 2 residual, 3 prediction, 4 R squared."""
    return _pair_fit(y, x, d, _PARTS[int(rettype)])


@function("reg")
def ts_slope(x, d):
    return _trend_fit(x, d, "slope")


@function("reg")
def ts_intercept(x, d):
    """Fitted value at the oldest row of the window."""
    return _trend_fit(x, d, "intercept")


@function("reg", "ts_resi")
def ts_resid(x, d):
    return _trend_fit(x, d, "resid")


@function("reg")
def ts_predict(x, d):
    return _trend_fit(x, d, "predict")


@function("reg", "ts_rsquare")
def ts_rsq(x, d):
    return _trend_fit(x, d, "rsq")


def regbeta(x, y, d) -> Feature:
    """Slope of y on x: cov(x, y) / var(x), at least 3 pairs and var(x) >= 1e-10."""
    py, px = paired(y, x)

    def fit(f, b, a):
        ok = (F.count(a).over(f) >= 3) & (F.var_samp(a).over(f) >= 1e-10)
        return F.when(ok, F.regr_slope(b, a).over(f))
    return rolling("regbeta", d, fit, py, px)


register("regbeta", regbeta, "reg")


@function("reg")
def ts_ar_resid(x, order=5):
    """Residual of an autoregression of the given order, fitted on 3 * order + 5 rows.

    The rows a fit needs travel as one short array per row (4 * order + 5 values); the solves
    run batch-wise on Arrow batches.
    """
    p = int(order)
    d = 3 * p + 5
    need = d + p

    @F.pandas_udf(T.DoubleType())
    def residual(history: pd.Series) -> pd.Series:
        out = np.full(len(history), np.nan)
        full = np.flatnonzero([h is not None and len(h) == need for h in history])
        if len(full):
            h = np.stack([np.asarray(history.iloc[i], dtype=float) for i in full])
            y = h[:, p:]
            design = np.stack([np.ones_like(y)]
                              + [h[:, p - k:need - k] for k in range(1, p + 1)], axis=2)
            coef = np.linalg.pinv(design) @ y[:, :, None]
            fitted = (design[:, -1:, :] @ coef)[:, 0, 0]
            out[full] = y[:, -1] - fitted
        return pd.Series(out)

    history = along("ar_history", lambda w, a: F.collect_list(a).over(w.last(need)),
                    x, lookback=need - 1, params=(need,))
    # collect_list drops missing values, so a short array also means an incomplete design
    return row("ts_ar_resid", lambda h: F.nanvl(residual(h), F.lit(None).cast("double")),
               history, params=(p,))
