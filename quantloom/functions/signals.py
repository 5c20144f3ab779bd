"""Signals along one series: thresholds, confirmation, scoring transforms, zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import TINY, Feature, all_of, any_of, as_feature, flag, row, where
from quantloom.functions.registry import function
from quantloom.functions.rolling import (ROW_NUMBER, along, expanding_max, expanding_mean_after,
                                         expanding_median_after, expanding_percentile_linear,
                                         expanding_rank, expanding_zscore, ts_mean, ts_median, ts_std,
                                         window)
from quantloom.functions.scalar import coalesce0


@function("signal", "switch", "if_then")
def regime_switch(condition, a, b):
    """``a`` while the condition holds, else (a missing condition included) ``b``."""
    return where(condition, a, b)


@function("signal")
def persist(x, n=3):
    """1 when the last ``n`` values are all positive; missing values break the run."""
    n = window(n)
    positive = row("positive", lambda a: flag(a > 0), x)
    return along("persist", lambda w, rn, p: F.when(
        (rn >= n) & (F.min(p).over(w.last(n)) > 0), 1.0).otherwise(0.0),
        ROW_NUMBER, positive, lookback=n - 1, params=(n,))


def persist_sign(x, n=3) -> Feature:
    """+1 / -1 when the last ``n`` values are all positive / all negative, else 0."""
    return persist(x, n) - persist(-as_feature(x), n)


@function("signal")
def thr(x, k=0.0):
    return as_feature(x) > float(k)


@function("signal")
def thr_mean(x):
    return as_feature(x) > expanding_mean_after(x)


@function("signal")
def thr_med(x):
    return as_feature(x) > expanding_median_after(x)


@function("signal")
def thr_roll_mean(x, w=30):
    return as_feature(x) > ts_mean(x, w)


@function("signal")
def thr_roll_med(x, w=30):
    return as_feature(x) > ts_median(x, w)


@function("signal")
def thr_zscore(x, w=30, k=1.0):
    s = ts_std(x, w)
    return (as_feature(x) > ts_mean(x, w) + s * float(k)) & (s > TINY)


@function("signal")
def thr_pct(x, p=0.5):
    return as_feature(x) > expanding_percentile_linear(x, p)


@function("signal")
def thr_range(x, lo, hi):
    x = as_feature(x)
    return (x > float(lo)) & (x < float(hi))


# -- combination -----------------------------------------------------------------------------------------
def pipe_and(*signals) -> Feature:
    out = signals[0]
    for s in signals[1:]:
        out = row("least", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), out, s, uses=2)
    return as_feature(out)


def pipe_or(*signals) -> Feature:
    out = signals[0]
    for s in signals[1:]:
        out = row("greatest", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), out, s, uses=2)
    return as_feature(out)


def pipe_vote(*signals, threshold=0.5) -> Feature:
    """1 when the share of positive signals exceeds the threshold."""
    n, t = len(signals), float(threshold)

    def build(*cs):
        votes = sum((flag(c > 0) for c in cs[1:]), flag(cs[0] > 0))
        return flag(votes / n > t)
    return row("vote", build, *signals, params=(t,))


def pipe_weighted(weights: Sequence[float], *signals) -> Feature:
    out = as_feature(signals[0]) * float(weights[0])
    for w, s in zip(weights[1:], signals[1:]):
        out = out + as_feature(s) * float(w)
    return out


def pipeline(x, *steps) -> Feature:
    """Apply feature-to-feature steps in order."""
    for step in steps:
        x = step(x)
    return as_feature(x)


# -- scoring --------------------------------------------------------------------------------------------
def _whole(op, value, x) -> Feature:
    """Statistic of the whole series: looks ahead, for comparison only."""
    def build(w, a):
        series = W.partitionBy(*w.symbol)
        return value(series, a)
    return Feature(op, (as_feature(x),), build, axis="symbol", lookback=None)


def scored(x, transform="raw", warmup=20) -> Feature:
    """A column made comparable: raw, rank, zscore, binary, neg_log, rank_full, zscore_full, or a
    function of the feature. Missing and infinite values count as 0."""
    v = coalesce0(x)
    if callable(transform):
        return as_feature(transform(v))
    if transform == "raw":
        return v
    if transform == "rank":
        return expanding_rank(v, warmup)
    if transform == "zscore":
        return expanding_zscore(v, warmup)
    if transform == "binary":
        return v > 0
    if transform == "neg_log":
        p = row("non_negative", lambda a: F.greatest(a, F.lit(0.0)), v)
        return row("neg_log", lambda a, m: F.when(a > TINY, -F.log(a / F.greatest(m, F.lit(TINY))))
                   .otherwise(0.0), p, expanding_max(p), uses=2)
    if transform == "rank_full":
        def value(series, a):
            order = series.orderBy(a)
            n = F.count(F.lit(1)).over(series)
            upto = F.count(F.lit(1)).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
            return (F.rank().over(order) + upto) / 2.0 / n
        return _whole("rank_full", value, v)
    if transform == "zscore_full":
        def value(series, a):
            s = F.stddev_pop(a).over(series)
            z = (a - F.avg(a).over(series)) / s
            return F.when(s < TINY, 0.0).otherwise(
                F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0)))
        return _whole("zscore_full", value, v)
    raise ValueError(f"unknown transform {transform}")


def composite(parts: Sequence[tuple], columns: Sequence[str] | None = None) -> Feature:
    """Weighted sum of scored columns / sum of |weights|. Each part: (name, weight, transform[, warmup]);
    parts whose column is not in ``columns`` are skipped."""
    used = [p for p in parts if columns is None or p[0] in columns]
    if not used:
        return as_feature(0.0)
    total = sum(abs(p[1]) for p in used)
    out = None
    for name, weight, transform, *warm in used:
        term = scored(name, transform, *warm) * float(weight)
        out = term if out is None else out + term
    return out / float(total) if total > 0 else out


def three_zone(score, entry=0.3, exit=-0.3) -> Feature:
    """1 above ``entry``, 0 below ``exit``, otherwise the previous state (0 at the start)."""
    mark = row("zone_mark", lambda s: F.when(s > float(entry), 1.0).when(s < float(exit), 0.0),
               coalesce0(score), params=(entry, exit), uses=2)
    return along("three_zone", lambda w, m: F.coalesce(
        F.last(m, ignorenulls=True).over(w.expanding), F.lit(0.0)), mark, lookback=None)


__all__ = ["all_of", "any_of", "composite", "persist", "persist_sign", "pipe_and", "pipe_or",
           "pipe_vote", "pipe_weighted", "pipeline", "scored", "three_zone", "thr", "thr_mean",
           "thr_med", "thr_pct", "thr_range", "thr_roll_mean", "thr_roll_med", "thr_zscore"]
