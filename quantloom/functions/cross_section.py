"""Functions across the symbols of one date."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import TINY, Feature, as_feature
from quantloom.functions.registry import function


def across(op, build, *inputs, params=()) -> Feature:
    return Feature(op, tuple(as_feature(i) for i in inputs), build, params=params, axis="date")


def _z(w, a, deviation):
    return (a - F.avg(a).over(w.date)) / deviation


@function("cs")
def cs_rank(x):
    """Competition rank / count in (0, 1]; missing values are not counted."""
    return across("cs_rank", lambda w, a: F.when(
        a.isNotNull(), F.rank().over(w.rank(a)) / F.count(a).over(w.date)), x)


def cs_rank_average(x):
    """Average rank of ties / count, as used for the final rank of a panel."""
    def build(w, a):
        upto = F.count(a).over(w.rank(a).rangeBetween(W.unboundedPreceding, W.currentRow))
        return F.when(a.isNotNull(), (F.rank().over(w.rank(a)) + upto) / 2.0
                      / F.count(a).over(w.date))
    return across("cs_rank_average", build, x)


def cs_rank0(x):
    """Share of symbols strictly below, in [0, 1)."""
    return across("cs_rank0", lambda w, a: F.when(
        a.isNotNull(), (F.rank().over(w.rank(a)) - 1) / F.count(a).over(w.date)), x)


@function("cs")
def cs_zscore(x):
    def build(w, a):
        s = F.stddev_samp(a).over(w.date)
        return F.when(s > TINY, _z(w, a, s)).when(a.isNotNull() & s.isNotNull(), 0.0)
    return across("cs_zscore", build, x)


def cs_zscore_unit(x):
    """z-score that divides by 1 where the deviation is 0."""
    def build(w, a):
        s = F.stddev_samp(a).over(w.date)
        return _z(w, a, F.when(s == 0, 1.0).otherwise(s))
    return across("cs_zscore_unit", build, x)


@function("cs")
def cs_scale(x, scale=1.0):
    scale = float(scale)

    def build(w, a):
        s = F.sum(F.abs(a)).over(w.date)
        return F.when(s > TINY, a / s * scale).when(a.isNotNull(), 0.0)
    return across("cs_scale", build, x, params=(scale,))


@function("cs")
def cs_winsorize(x, std=4.0):
    """Clip to mean +- std deviations (sample), for dates with more than one value."""
    k = float(std)

    def build(w, a):
        m, s = F.avg(a).over(w.date), F.stddev_samp(a).over(w.date)
        clipped = F.least(F.greatest(a, m - k * s), m + k * s)
        return F.when(s.isNotNull(), F.when(a.isNotNull(), clipped)).otherwise(a)
    return across("cs_winsorize", build, x, params=(k,))


def winsorize(x, n=3.0):
    """Clip to mean +- n population deviations; a constant row becomes its mean."""
    n = float(n)

    def build(w, a):
        m, s = F.avg(a).over(w.date), F.stddev_pop(a).over(w.date)
        return F.when(a.isNotNull(), F.least(F.greatest(a, m - n * s), m + n * s))
    return across("winsorize", build, x, params=(n,))


@function("cs")
def cs_normalize(x, use_std=False):
    return cs_scale(cs_zscore(x)) if use_std else cs_scale(x)


@function("cs")
def cs_quantile(x, q=0.5, interpolation="linear"):
    """The date's quantile, repeated for every symbol of the date."""
    q = float(q)

    def build(w, a):
        if interpolation == "linear":
            return F.percentile(a, q).over(w.date)
        values = F.array_sort(F.collect_list(a).over(w.date))
        at = F.lit(q) * (F.size(values) - 1)
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        if interpolation == "lower":
            return low
        if interpolation == "higher":
            return high
        if interpolation == "midpoint":
            return (low + high) / 2.0
        if interpolation == "nearest":
            return F.get(values, F.rint(at).cast("int"))
        raise ValueError(f"unknown interpolation {interpolation}")
    return across("cs_quantile", build, x, params=(q, interpolation))


@function("cs")
def cs_mean(x):
    return across("cs_mean", lambda w, a: F.avg(a).over(w.date), x)


def cs_sum(x):
    return across("cs_sum", lambda w, a: F.sum(a).over(w.date), x)


def rank_features(features: dict[str, Feature]) -> dict[str, Feature]:
    """Final cross-section rank of each feature: an outer cs_rank is not ranked again, features
    that already rank somewhere use the competition rank, others the average rank."""
    out = {}
    for name, f in features.items():
        if f.op == "cs_rank":
            out[name] = f
        elif "date" in f.describe()["axes"]:
            out[name] = cs_rank(f)
        else:
            out[name] = cs_rank_average(f)
    return out
