"""Rolling and expanding functions along time.

Windows count rows. A rolling value is missing for the first ``d - 1`` rows of a series and
otherwise uses the values present in the window.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.feature import TINY, Feature, as_feature, row
from quantloom.functions.registry import function
from quantloom.functions.scalar import coalesce0, log, plain_ratio

ROW_NUMBER = Feature("row_number", (), lambda w: w.row_number(), axis="symbol", lookback=None)


def window(d) -> int:
    d = int(d)
    if d < 1:
        raise ValueError(f"window must be at least 1, got {d}")
    return d


def along(op, build, *inputs, lookback, params=()) -> Feature:
    """Feature over earlier rows of the same series; ``build(windows, *columns)``."""
    return Feature(op, tuple(as_feature(i) for i in inputs), build, params=params,
                   axis="symbol", lookback=lookback)


def rolling(op, d, value, *inputs, params=()) -> Feature:
    """``value(frame, *columns)`` over the last ``d`` rows, missing while fewer exist."""
    d = window(d)
    if d == 1:
        return along(op, lambda w, *cs: value(w.last(1), *cs), *inputs, lookback=0,
                     params=(d, *params))
    return along(op, lambda w, rn, *cs: F.when(rn >= d, value(w.last(d), *cs)),
                 ROW_NUMBER, *inputs, lookback=d - 1, params=(d, *params))


def _no_window(*_):
    raise NotImplementedError("added by plans.passes")


def whole_series(op, *inputs, params=(), lookback=None) -> Feature:
    """Function of a whole series that ``plans.passes`` computes under this name."""
    return along(op, _no_window, ROW_NUMBER, *inputs, lookback=lookback, params=params)


def ordered(op, x, d, params=(), lookback=0) -> Feature:
    """Order statistic of the last ``d`` rows or (``lookback=None``) of all rows, from row ``d`` on."""
    d = window(d)
    return whole_series(op, x, params=(d, *params), lookback=None if lookback is None else d - 1)


def paired(x, y) -> tuple[Feature, Feature]:
    x, y = as_feature(x), as_feature(y)
    return (row("present_with", lambda a, b: F.when(b.isNotNull(), a), x, y),
            row("present_with", lambda a, b: F.when(b.isNotNull(), a), y, x))


# -- basic statistics ---------------------------------------------------------------------------
@function("ts")
def ts_mean(x, d):
    return rolling("ts_mean", d, lambda f, a: F.avg(a).over(f), x)


@function("ts")
def ts_sum(x, d):
    return rolling("ts_sum", d, lambda f, a: F.sum(a).over(f), x)


@function("ts")
def ts_std(x, d):
    return rolling("ts_std", d, lambda f, a: F.stddev_samp(a).over(f), x)


@function("ts")
def ts_var(x, d):
    return rolling("ts_var", d, lambda f, a: F.var_samp(a).over(f), x)


@function("ts")
def ts_max(x, d):
    return rolling("ts_max", d, lambda f, a: F.max(a).over(f), x)


@function("ts")
def ts_min(x, d):
    return rolling("ts_min", d, lambda f, a: F.min(a).over(f), x)


@function("ts")
def ts_median(x, d):
    return ordered("ts_median", x, d)


@function("ts")
def ts_product(x, d):
    return rolling("ts_product", d, lambda f, a: F.product(a).over(f), x)


# -- lags -----------------------------------------------------------------------------------------
@function("ts", "delay")
def ts_delay(x, d):
    d = window(d)
    return along("ts_delay", lambda w, a: F.lag(a, d).over(w.order), x, lookback=d, params=(d,))


@function("ts", "delta")
def ts_delta(x, d):
    x = as_feature(x)
    return x - ts_delay(x, d)


@function("ts", "roc")
def ts_roc(x, d):
    x = as_feature(x)
    return row("rate_of_change", lambda a, b: F.when(F.abs(b) > TINY, (a - b) / b),
               x, ts_delay(x, d), uses=2)


@function("ts", "logret")
def ts_logret(x):
    x = as_feature(x)
    return log(plain_ratio(x, ts_delay(x, 1)))


# -- order statistics -----------------------------------------------------------------------------
def _values(x, d) -> Feature:
    """Values present in the window, for functions of their own."""
    return rolling("window_values", d, lambda f, a: F.collect_list(a).over(f), x)


@function("ts")
def ts_rank(x, d):
    """Values of the window below the current one, and itself, as a share of those present."""
    return ordered("ts_rank", x, d)


@function("ts")
def ts_quantile(x, d, p=0.5):
    """Nearest-rank quantile of the window."""
    return ordered("ts_quantile", x, d, (float(p),))


def _days_since(op, x, d, best):
    return rolling(op, d, lambda f, a, n: n - best(a, n, f), x, ROW_NUMBER)


@function("ts")
def ts_argmax(x, d):
    """Rows since the maximum (0 = now); the oldest of equal values counts."""
    return _days_since("ts_argmax", x, d, lambda a, n, f: F.max_by(
        n, F.when(a.isNotNull(), F.struct(a, -n))).over(f))


@function("ts")
def ts_argmin(x, d):
    return _days_since("ts_argmin", x, d, lambda a, n, f: F.min_by(
        n, F.when(a.isNotNull(), F.struct(a, n))).over(f))


# -- moments --------------------------------------------------------------------------------------
def _steady(f, a):
    return F.stddev_pop(a).over(f) > TINY


@function("ts")
def ts_skew(x, d):
    def value(f, a):
        n = F.count(a).over(f)
        g = F.skewness(a).over(f) * F.sqrt(n * (n - 1)) / (n - 2)
        return F.when((n >= 3) & _steady(f, a), g)
    return rolling("ts_skew", d, value, x)


@function("ts", "kurt")
def ts_kurt(x, d):
    def value(f, a):
        n = F.count(a).over(f)
        g = ((n + 1) * F.kurtosis(a).over(f) + 6) * (n - 1) / ((n - 2) * (n - 3))
        return F.when((n >= 4) & _steady(f, a), g)
    return rolling("ts_kurt", d, value, x)


@function("ts")
def ts_zscore(x, d):
    def value(f, a):
        s = F.stddev_samp(a).over(f)
        return F.when(s > TINY, (a - F.avg(a).over(f)) / s)
    return rolling("ts_zscore", d, value, x)


@function("ts")
def ts_av_diff(x, d):
    x = as_feature(x)
    return x - ts_mean(x, d)


@function("ts")
def ts_scale(x, d):
    def value(f, a):
        s = F.sum(F.abs(a)).over(f)
        return F.when(s > TINY, a / s).when(a.isNotNull(), 0.0)
    return rolling("ts_scale", d, value, x)


@function("ts", "corr", "correlation")
def ts_corr(x, y, d):
    def value(f, a, b):
        spread = F.stddev_samp(a).over(f), F.stddev_samp(b).over(f)
        ok = (F.count(a).over(f) >= 3) & (spread[0] > TINY) & (spread[1] > TINY)
        return F.when(ok, F.covar_samp(a, b).over(f) / (spread[0] * spread[1]))
    return rolling("ts_corr", d, value, *paired(x, y))


@function("ts", "covariance")
def ts_cov(x, y, d):
    def value(f, a, b):
        return F.when(F.count(a).over(f) >= 3, F.covar_samp(a, b).over(f))
    return rolling("ts_cov", d, value, *paired(x, y))


@function("ts")
def ts_autocorr(x, lag, d):
    """Correlation of the series with itself ``lag`` rows earlier, from row ``d`` on."""
    x = as_feature(x)
    return ts_corr(x, ts_delay(x, lag), d)


# -- shapes -----------------------------------------------------------------------------------------
@function("ts")
def ts_step(x, d):
    """1 when every value present in the window is non-negative."""
    def value(f, a):
        return F.when(F.coalesce(F.min(a).over(f), F.lit(0.0)) >= 0, 1.0).otherwise(0.0)
    return rolling("ts_step", d, value, x)


@function("ts")
def ts_hump(x, d):
    """1 when the maximum sits in the middle of the window and exceeds both ends."""
    d = window(d)
    low, high = int(d * 0.3), int(d * 0.7)

    def value(f, a, n):
        at = F.max_by(n, F.when(a.isNotNull(), F.struct(a, -n))).over(f) - (n - d + 1)
        top = F.max(a).over(f)
        inner = (at >= low) & (at <= high) & (top > F.first(a).over(f)) & (top > a)
        return F.when(F.count(a).over(f) >= 3, F.when(inner, 1.0).otherwise(0.0))
    return rolling("ts_hump", d, value, x, ROW_NUMBER)


@function("ts", "decay_linear")
def ts_decay_linear(x, d):
    """Weights 1..d by position, renormalised over the values present."""
    d = window(d)

    def value(f, a, n):
        start = n - d
        here = F.when(a.isNotNull(), n)
        weights = F.sum(here).over(f) - start * F.count(a).over(f)
        return F.when(weights > 0,
                      (F.sum(a * n).over(f) - start * F.sum(a).over(f)) / weights)
    return rolling("ts_decay_linear", d, value, x, ROW_NUMBER)


def rolling_apply(name: str, x, d: int, reduce) -> Feature:
    """``reduce(values)`` over the array of values present in the window."""
    return row(name, reduce, _values(x, d), params=(d,), uses=4)


@function("ts")
def sma(x, d, offset=0):
    """Mean of a window that ends ``offset`` rows ago."""
    d, offset = window(d), int(offset)
    return along("sma", lambda w, rn, a: F.when(rn >= d + offset, F.avg(a).over(w.last(d, offset))),
                 ROW_NUMBER, x, lookback=d - 1 + offset, params=(d, offset))


# -- macros -------------------------------------------------------------------------------------------
@function("macro")
def beta(x, y, d):
    return plain_ratio(ts_cov(x, y, d), ts_var(y, d))


@function("macro")
def sharpe(x, d):
    return plain_ratio(ts_mean(x, d), ts_std(x, d))


@function("macro")
def info_ratio(x, y, d):
    return sharpe(as_feature(x) - y, d)


@function("macro")
def ts_deviate(x, d):
    x = as_feature(x)
    return plain_ratio(x - ts_mean(x, d), ts_std(x, d))


@function("macro")
def vol_price_corr(x, y, d):
    return ts_corr(ts_roc(x, d), ts_roc(y, d), d)


# -- expanding ------------------------------------------------------------------------------------------
def expanding(op, value, x, min_rows, params=()) -> Feature:
    """``value(frame, column)`` over all rows so far, from row ``min_rows`` on."""
    return along(op, lambda w, rn, a: F.when(rn >= min_rows, value(w.expanding, a)),
                 ROW_NUMBER, x, lookback=None, params=(min_rows, *params))


@function("expanding")
def expanding_mean(x, min_p=20):
    return expanding("expanding_mean", lambda f, a: F.avg(a).over(f), x, min_p)


@function("expanding")
def expanding_median(x, min_p=20):
    return ordered("expanding_median", x, min_p, lookback=None)


@function("expanding")
def expanding_std(x, min_p=20):
    return expanding("expanding_std", lambda f, a: F.stddev_samp(a).over(f), x, min_p)


@function("expanding")
def expanding_percentile(x, p=0.5, min_p=20):
    """Nearest-rank quantile (``p`` in 0..1) of all values so far."""
    return ordered("expanding_percentile", x, min_p, (float(p),), lookback=None)


@function("expanding")
def expanding_percentile_linear(x, p=0.5, warmup=20):
    """Linear-interpolated percentile, missing for the first ``warmup`` rows."""
    return ordered("expanding_percentile_linear", x, warmup + 1, (float(p),), lookback=None)


@function("expanding")
def expanding_percentile_approx(x, p=0.5, min_p=20, accuracy=1000):
    """Sketch-based percentile for long histories: memory does not grow with the series."""
    return expanding("expanding_percentile_approx", lambda f, a: F.percentile_approx(
        a, float(p), accuracy).over(f), x, min_p, (p, accuracy))


@function("expanding")
def expanding_mean_after(x, warmup=20):
    """Expanding mean, missing for the first ``warmup`` rows."""
    return expanding_mean(x, warmup + 1)


@function("expanding")
def expanding_median_after(x, warmup=20):
    return expanding_median(x, warmup + 1)


@function("expanding")
def expanding_max(x):
    return along("expanding_max", lambda w, a: F.max(a).over(w.expanding), x, lookback=None)


@function("expanding")
def expanding_sum(x):
    return along("expanding_sum", lambda w, a: F.sum(a).over(w.expanding), x, lookback=None)


@function("expanding")
def expanding_zscore(x, warmup=20):
    """Missing counts as 0; population deviation (variance floor 1e-10), clipped to +-3."""
    def value(w, rn, a):
        v = F.greatest(F.var_pop(a).over(w.expanding), F.lit(1e-10))
        z = (a - F.avg(a).over(w.expanding)) / F.sqrt(v)
        return F.when(rn > warmup, F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0))).otherwise(0.0)
    return along("expanding_zscore", value, ROW_NUMBER, coalesce0(x), lookback=None,
                 params=(warmup,))


@function("expanding")
def expanding_rank(x, warmup=20):
    """Share of the history (this row included) that is <= the value; 0.5 during warm-up."""
    return row("half_before", lambda a: F.coalesce(a, F.lit(0.5)), ordered("expanding_rank", coalesce0(x), warmup + 1, lookback=None))


# -- variants with their own missing-value rules ------------------------------------------------------
def ts_rank0(x, d):
    """Share of window values strictly below the current one, in [0, 1)."""
    return ordered("ts_rank0", x, d)


def ts_sum_strict(x, d):
    """Rolling sum that is missing when any value of the window is."""
    d = window(d)
    return rolling("ts_sum_strict", d,
                   lambda f, a: F.when(F.count(a).over(f) == d, F.sum(a).over(f)), x)
