"""Technical indicators.

Smoothed averages follow ``S = a * S + b * x`` from a seed on. Instead of a row-by-row loop, each
row is taken as the map ``S -> a * S + b`` and the maps are composed (``plans.scans``), so nothing
is cut off; :func:`recurrence_maps` gives the maps themselves for series that are split.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantloom.functions.feature import Feature, as_feature, row
from quantloom.functions.registry import function
from quantloom.functions.rolling import ROW_NUMBER, along, rolling, ts_delay, ts_mean, whole_series, window
from quantloom.functions.scalar import abs_, guarded_ratio


def recurrence(x, a: float, b: float, seed_rows: int, *, start: int = 0,
               seed: str = "mean") -> Feature:
    """``S = a*S + b*x`` seeded with the mean (or sum) of ``seed_rows`` rows after ``start``.

    A missing input after ``start`` makes every later value missing.
    """
    return whole_series("recurrence", x, params=(a, b, seed_rows, start, seed))


def recurrence_maps(node: Feature) -> tuple[Feature, Feature]:
    """The maps ``y -> keep*y + put`` of a recurrence, by windows of bounded length."""
    a, b, seed_rows, start, seed = node.params
    first = start + seed_rows

    def contribution(w, rn, v):
        f = w.last(seed_rows)
        at_seed = F.when(F.count(v).over(f) == seed_rows, F.avg(v).over(f) if seed == "mean" else F.sum(v).over(f))
        return F.when(rn == first, at_seed).when(rn > first, F.lit(b) * v).otherwise(0.0)
    put = along("recurrence_put", contribution, ROW_NUMBER, node.inputs[1], lookback=seed_rows - 1, params=node.params)
    keep = row("recurrence_keep", lambda rn: F.when(rn > first, F.lit(a)).otherwise(0.0), ROW_NUMBER, params=(a, first))
    return keep, put


def recurrence_value(node: Feature, scanned: Feature) -> Feature:
    """The recurrence from the scan of its maps: missing before the seed."""
    first = node.params[2] + node.params[3]
    return row("recurrence_value", lambda rn, y: F.when(rn >= first, y), ROW_NUMBER, scanned, params=(first,))


@function("ta")
def ema(x, period=20, start=0):
    k = 2.0 / (window(period) + 1)
    return recurrence(x, 1.0 - k, k, period, start=start)


@function("ta")
def wilder_smooth(x, period, start=0):
    p = window(period)
    return recurrence(x, (p - 1) / p, 1.0 / p, p, start=start)


def sma_recursive(x, w, k=1) -> Feature:
    """S = S*(1 - k/w) + x*k/w, seeded with the mean of the first w rows."""
    return recurrence(x, 1.0 - k / w, k / w, w)


def true_range(high, low, close) -> Feature:
    """Missing on the first row, which has no previous close."""
    def build(h, l, c):
        return F.when(c.isNotNull(), F.greatest(h - l, F.abs(h - c), F.abs(l - c)))
    return row("true_range", build, high, low, ts_delay(close, 1))


@function("ta")
def atr(high, low, close, period=14):
    return wilder_smooth(true_range(high, low, close), period, start=1)


@function("ta")
def natr(high, low, close, period=14):
    return row("natr", lambda a, c: F.when(c != 0, a / c * 100.0).when(a.isNotNull(), 0.0),
               atr(high, low, close, period), close)


@function("ta")
def atr_sma(high, low, close, period=14):
    """Plain mean of the true range; the first row uses its own close as the previous one."""
    def build(h, l, c, prev):
        p = F.coalesce(prev, c)
        return F.greatest(h - l, F.abs(h - p), F.abs(l - p))
    tr = row("true_range_own", build, high, low, close, ts_delay(close, 1), uses=2)
    return ts_mean(tr, period)


@function("ta")
def rsi(close, period=14):
    """Centred: (RSI - 50) / 50."""
    change = as_feature(close) - ts_delay(close, 1)
    up = wilder_smooth(row("gain", lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))),
                           change, uses=2), period, start=1)
    down = wilder_smooth(row("loss", lambda c: F.when(c.isNotNull(), F.greatest(-c, F.lit(0.0))),
                             change, uses=2), period, start=1)

    def build(u, d):
        value = F.when(u + d > 0, 100.0 * u / (u + d)).when((u + d).isNotNull(), 0.0)
        return (value - 50.0) / 50.0
    return row("rsi", build, up, down, uses=2)


@function("ta")
def adx(high, low, close, period=14):
    p = window(period)
    high, low = as_feature(high), as_feature(low)
    up, down = high - ts_delay(high, 1), ts_delay(low, 1) - low

    def moved(a, b):
        return F.when((a > 0) & (a > b), a).when((a + b).isNotNull(), 0.0)

    def smooth(x):
        return recurrence(x, 1.0 - 1.0 / p, 1.0, p - 1, start=1, seed="sum")
    plus = smooth(row("plus_dm", moved, up, down, uses=2))
    minus = smooth(row("minus_dm", moved, down, up, uses=2))
    tr = smooth(true_range(high, low, close))

    def strength(rn, a, b, t):
        total = a + b
        dx = F.when((t > 0) & (total > 0), 100.0 * F.abs(a - b) / total).when(
            (total + t).isNotNull(), 0.0)
        return F.when(rn > p, dx)
    dx = row("dx", strength, ROW_NUMBER, plus, minus, tr, uses=2, params=(p,))
    return wilder_smooth(dx, p, start=p)


@function("ta")
def macd(close, fast=12, slow=26, signal=9):
    """2 * (DIF - DEA)."""
    return macd_hist(close, fast, slow, signal) * 2.0


def macd_hist(close, fast=12, slow=26, signal=9) -> Feature:
    dif = ema(close, fast, slow - fast) - ema(close, slow)
    return dif - ema(dif, signal, slow - 1)


@function("ta")
def dema(close, period=20):
    one = ema(close, period)
    return one * 2.0 - ema(one, period, window(period) - 1)


@function("ta")
def kama(close, period=30):
    """Adaptive average (fast 2, slow 30): the smoothing share varies by row, between (2/31)^2 and (2/3)^2."""
    p = window(period)
    close = as_feature(close)
    change = abs_(close - ts_delay(close, 1))
    path = rolling("path", p, lambda f, c: F.when(F.count(c).over(f) == p, F.sum(c).over(f)), change)
    fast, slow = 2.0 / 3.0, 2.0 / 31.0

    def share(c, before, total):
        move = F.abs(c - before)
        er = F.when((total <= move) | (total == 0), 1.0).otherwise(move / total)
        return F.pow(er * (fast - slow) + slow, F.lit(2.0))
    sc = row("kama_share", share, close, ts_delay(close, p), path, params=(p,), uses=2)
    # before the first output the state is the previous close; a missing close ends the average
    keep = row("kama_keep", lambda rn, s: F.when(rn > p, 1.0 - s).otherwise(0.0), ROW_NUMBER, sc, params=(p,))
    put = row("kama_put", lambda rn, s, c: F.when(rn > p, s * c).when((rn == p) | c.isNull(), c).otherwise(0.0),
              ROW_NUMBER, sc, close, params=(p,))
    return row("kama", lambda rn, y: F.when(rn > p, y), ROW_NUMBER, whole_series("affine_scan", keep, put), params=(p,))


# -- window indicators: a window with a missing value gives a missing result ------------------------
def full(op, d, value, *inputs, params=()) -> Feature:
    d = window(d)
    return rolling(op, d, lambda f, a, *rest: F.when(
        F.count(a).over(f) == d, value(f, a, *rest)), *inputs, params=params)


@function("ta")
def bb_width(close, period=20):
    """(upper - lower) / middle at two population deviations."""
    def value(f, a):
        m = F.avg(a).over(f)
        return F.when(m > 0, 4.0 * F.stddev_pop(a).over(f) / m)
    return full("bb_width", period, value, close)


@function("ta")
def stddev(close, period=20):
    return full("stddev", period, lambda f, a: F.stddev_pop(a).over(f), close)


@function("ta")
def var(close, period=20):
    return full("var", period, lambda f, a: F.var_pop(a).over(f), close)


@function("ta")
def cci(high, low, close, period=14):
    tp = (as_feature(high) + low + close) / 3.0
    p = window(period)
    mean = full("full_mean", p, lambda f, a: F.avg(a).over(f), tp)
    values = rolling("window_values", p, lambda f, a: F.collect_list(a).over(f), tp)

    def build(v, m, t):
        dev = F.aggregate(v, F.lit(0.0), lambda acc, e: acc + F.abs(e - m)) / p
        return F.when((dev > 0) & (t != m), (t - m) / (0.015 * dev)).when(m.isNotNull(), 0.0)
    return row("cci", build, values, mean, tp, uses=2, params=(p,))


@function("ta")
def trima(close, period=40):
    p = window(period)
    first, second = ((p + 1) // 2, (p + 1) // 2) if p % 2 else (p // 2, p // 2 + 1)
    inner = full("full_mean", first, lambda f, a: F.avg(a).over(f), close)
    return full("full_mean", second, lambda f, a: F.avg(a).over(f), inner)


def _line(op, close, period, ahead) -> Feature:
    def value(f, a, n):
        return F.avg(a).over(f) + F.regr_slope(a, n).over(f) * (n + ahead - F.avg(n).over(f))
    return full(op, period, value, close, ROW_NUMBER, params=(ahead,))


@function("ta")
def tsf(close, period=7):
    """Regression forecast one row ahead."""
    return _line("tsf", close, period, 1)


@function("ta")
def linearreg(close, period=20):
    return _line("linearreg", close, period, 0)


@function("ta")
def wma(close, period=20):
    p = window(period)

    def value(f, a, n):
        return (F.sum(a * n).over(f) - (n - p) * F.sum(a).over(f)) / (p * (p + 1) / 2.0)
    return full("wma", p, value, close, ROW_NUMBER)


def returns_from_first(close) -> Feature:
    """close change / previous close (1 where not positive); 0 on the first row."""
    def build(rn, c, prev):
        return F.when(rn == 1, 0.0).otherwise((c - prev) / F.when(prev > 0, prev).when(
            prev.isNotNull(), 1.0))
    return row("returns_from_first", build, ROW_NUMBER, close, ts_delay(close, 1), uses=2)


@function("ta")
def hv(close, period=20):
    """Annualised deviation of returns in percent."""
    scale = math.sqrt(252.0) * 100.0
    return rolling("hv", period, lambda f, a: F.stddev_samp(a).over(f) * scale,
                   returns_from_first(close))


@function("ta")
def vol_ratio(close, volume, short=5, long=20):
    return guarded_ratio(ts_mean(volume, short), ts_mean(volume, long))


@function("ta")
def amt_ratio(amount, short=5, long=20):
    return guarded_ratio(ts_mean(amount, short), ts_mean(amount, long))
