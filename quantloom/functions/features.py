"""The older feature space: 34 window features of OHLCV bars, each named ``NAME{params}``.

Two cycle features based on the Hilbert transform are not offered (see README).
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import indicators as ta
from quantloom.functions.feature import TINY, Feature, as_feature, col, row
from quantloom.functions.rolling import (ROW_NUMBER, expanding_sum, rolling, ts_delay, ts_mean, ts_std,
                                         ts_sum)
from quantloom.plans.panel import with_features

O, H, L, C, V = (col(k) for k in ("open", "high", "low", "close", "volume"))


def _or_zero(x, y, limit=0.0) -> Feature:
    """x / y where y exceeds the limit, else 0."""
    return row("ratio_else_zero", lambda a, b: F.when(b > limit, a / b).otherwise(0.0), x, y,
               params=(limit,), uses=2)


def _change(n: int) -> Feature:
    """close / close n rows ago - 1, where the base is positive."""
    return row("change", lambda a, b: F.when(b > 0, a / b - 1), C, ts_delay(C, n), uses=2)


def _hv(period=20):
    # unlike the indicator of the same name, the first return is missing
    r = row("raw_change", lambda a, b: F.when(b != 0, (a - b) / b), C, ts_delay(C, 1), uses=2)
    return ts_std(r, period) * (math.sqrt(252.0) * 100.0)


def _ma(short=5, long=20):
    slow = ts_mean(C, long)
    return _or_zero((ts_mean(C, short) - slow) * 100.0, slow)


def _vol_chg(period=5):
    ratio = _or_zero(ts_mean(V, period), ts_mean(V, period * 3))
    before = ts_delay(ratio, period)
    return row("vol_chg", lambda a, b: F.when(b > TINY, a / b - 1.0).otherwise(0.0), ratio, before, uses=2)


def _trend_strength(period=20):
    r = _change(1)
    total, dev = ts_sum(r, period), ts_std(r, period)
    return _or_zero(total, dev, TINY)


def _vol_regime(short=20, long=60):
    r = _change(1)
    seen = row("from_long", lambda rn, s: F.when(rn >= long, s), ROW_NUMBER, ts_std(r, short), params=(long,))
    return _or_zero(seen, ts_std(r, long), TINY)


def _mom_chg(period=5):
    m = _change(period)
    return row("mom_chg", lambda a, b: F.when(F.abs(b) > TINY, a - b).otherwise(0.0), m, ts_delay(m, period), uses=2)


def _up_ratio(period=10):
    up = row("is_up", lambda a, b: F.when(b.isNotNull(), F.when(a > b, 1.0).otherwise(0.0)), C, ts_delay(C, 1))
    return ts_mean(up, period)


def _mfi(period=14):
    """Money-flow index - 50: rising typical price against falling, weighted by volume."""
    tp = (H + L + C) / 3.0
    flow, before = tp * V, ts_delay(tp, 1)

    def side(up):
        return row(f"flow_{up}", lambda a, b, m: F.when(b.isNotNull(), F.when(
            (a > b) if up else (a < b), m).otherwise(0.0)), tp, before, flow, uses=2)

    def value(f, p, n):
        a, b = F.sum(p).over(f), F.sum(n).over(f)
        return F.when(F.count(p).over(f) == period, F.when(a + b >= 1.0, 100.0 * a / (a + b)).otherwise(0.0)) - 50.0
    return rolling("mfi", period, value, side(True), side(False))


def _ultosc(period1=7, period2=14, period3=28):
    """Ultimate oscillator - 50: buying pressure over true range, weighted 4 : 2 : 1."""
    pc = ts_delay(C, 1)
    low = row("true_low", lambda l, p: F.when(p.isNotNull(), F.least(l, p)), L, pc)
    bp, tr = C - low, ta.true_range(H, L, C)
    p1, p2, p3 = sorted((period1, period2, period3))

    def part(d):
        def value(f, a, b):
            t = F.sum(b).over(f)
            return F.when(F.count(b).over(f) == d, F.when(t > 0, F.sum(a).over(f) / t).otherwise(0.0))
        return rolling("pressure", d, value, bp, tr)
    return (part(p1) * 4.0 + part(p2) * 2.0 + part(p3)) * (100.0 / 7.0) - 50.0


def _obv(signal_period=10):
    """Percent change of the cumulative signed volume."""
    move = row("move", lambda a, b: F.when(b.isNull(), 0.0).otherwise(F.signum(a - b)), C, ts_delay(C, 1), uses=2)
    obv = expanding_sum(V * move)
    return row("obv", lambda a, b: F.when(b != 0, (a / b - 1) * 100.0).when(b == 0, 0.0), obv,
               ts_delay(obv, signal_period), uses=2)


def _off_price(weighted) -> Feature:
    return _or_zero((C - weighted) * 100.0, weighted)


def _correl(period=10):
    """Correlation of close with the row number."""
    def value(f, a, n):
        sa, sn = F.stddev_samp(a).over(f), F.stddev_samp(n).over(f)
        return F.when(F.count(a).over(f) == period, F.when(
            (sa > TINY) & (sn > TINY), F.covar_samp(a, n).over(f) / (sa * sn)).otherwise(0.0))
    return rolling("correl", period, value, C, ROW_NUMBER)


def _mom_ratio(short=5, long=20):
    a, b = _change(short), _change(long)
    return row("mom_ratio", lambda x, y: F.when(F.abs(y) > TINY, x / F.abs(y)).otherwise(0.0), a, b, uses=2)


FEATURES: dict[str, Callable[..., Feature]] = {
    "ATR": lambda period=14: ta.atr(H, L, C, period),
    "STDDEV": lambda period=20: ta.stddev(C, period),
    "BBWIDTH": lambda period=20: ta.bb_width(C, period),
    "BBW": lambda period=20: ta.bb_width(C, period),
    "HV": _hv,
    "NATR": lambda period=14: ta.natr(H, L, C, period),
    "TRIMA": lambda period=40: ta.trima(C, period),
    "SMA": lambda period=50: ts_mean(C, period),
    "MA": _ma,
    "EMA": lambda period=20: ta.ema(C, period),
    "TSF": lambda period=7: ta.tsf(C, period),
    "ADX": lambda period=14: ta.adx(H, L, C, period),
    "RSI": lambda period=14: ta.rsi(C, period),
    "CCI": lambda period=14: ta.cci(H, L, C, period),
    "MACD": lambda fast=12, slow=26, signal=9: ta.macd_hist(C, fast, slow, signal),
    "VAR": lambda period=20: ta.var(C, period),
    "LINEARREG": lambda period=20: ta.linearreg(C, period),
    "VOL_RATIO": lambda short=5, long=20: _or_zero(ts_mean(V, short), ts_mean(V, long)),
    "VOL_CHG": _vol_chg, "TREND_STRENGTH": _trend_strength, "VOL_REGIME": _vol_regime,
    "MOM_CHG": _mom_chg, "UP_RATIO": _up_ratio,
    "WMA": lambda period=20: ta.wma(C, period),
    "DEMA": lambda period=20: ta.dema(C, period),
    "KAMA": lambda period=30: ta.kama(C, period),
    "MFI": _mfi, "ULTOSC": _ultosc, "OBV": _obv,
    "AVGPRICE": lambda: _off_price((O + H + L + C) / 4.0),
    "WCLPRICE": lambda: _off_price((H + L + C * 2.0) / 4.0),
    "CORREL": _correl,
    "ROC": lambda period=5: _change(period),
    "MOM_RATIO": _mom_ratio,
}
_BY_CLOSE = ("ATR", "STDDEV", "TRIMA", "SMA", "TSF", "EMA", "WMA", "DEMA", "KAMA")
_BY_HUNDRED = ("HV", "NATR")


def register_feature(name: str, build: Callable[..., Feature]) -> None:
    FEATURES[name.upper()] = build


def normalization(name: str) -> str:
    """close (price-like), pct (percent) or raw, from the start of the name."""
    up = name.upper()
    if up.startswith(_BY_CLOSE):
        return "close"
    return "pct" if up.startswith(_BY_HUNDRED) else "raw"


def normalized(x: Feature, how: str) -> Feature:
    if how == "close":
        return row("by_close", lambda a, c: F.when(c > 0, a / c).otherwise(a), x, C, uses=2)
    return x / 100.0 if how == "pct" else x


def expand(name: str, **params) -> dict[str, tuple[str, dict]]:
    """Cross product of list parameters; columns ``NAME{v1,v2}`` in the order of the signature."""
    build = FEATURES[name.upper()]
    order = [p for p in inspect.signature(build).parameters if p in params]
    values = [params[p] if isinstance(params[p], (list, tuple)) else [params[p]] for p in order]
    out = {}
    for combo in product(*values):
        label = f"{name.upper()}{{{','.join(str(v) for v in combo)}}}" if combo else name.upper()
        out[label] = (name.upper(), dict(zip(order, combo)))
    return out


def feature_matrix(bars: DataFrame, specs: Sequence[tuple[str, dict]], *, normalize: bool = True,
                   ma_windows: Sequence[int] = (), differences: Sequence[tuple[str, str, str]] = (),
                   drop_missing: bool = True, keep: Sequence[str] = ("symbol", "ts"), **kw) -> DataFrame:
    """All features of ``specs`` in one plan, with rolling-mean companions and differences.

    Rows with any missing value are dropped by default.
    """
    cols: dict[str, Feature] = {}
    for name, params in specs:
        for label, (base, p) in expand(name, **params).items():
            f = FEATURES[base](**p)
            cols[label] = normalized(f, normalization(base)) if normalize else f
    for label, f in list(cols.items()):
        for d in ma_windows:
            if not label.endswith(f"_{d}"):
                cols[f"{label}_MA" if d == 10 else f"{label}_MA_{d}"] = ts_mean(f, d)
    for a, b, op in differences:
        if a in cols and b in cols:
            x, y = cols[a], cols[b]
            cols[_difference_name(a, b, op)] = {"sub": x - y, "div": x / y, "mul": x * y, "add": x + y}[op]
    out = with_features(bars, cols, keep=keep, **kw)
    return out.dropna(subset=list(cols)) if drop_missing else out


def _difference_name(a: str, b: str, op: str) -> str:
    if a.endswith("}") and b.endswith("}"):
        (na, pa), (nb, pb) = a[:-1].split("{"), b[:-1].split("{")
        return f"{na}_{nb}_{op}{{{pa},{pb}}}"
    return f"{a}_{op}_{b}"


def companion(f: Feature, d: int) -> Feature:
    """Rolling-mean companion of a feature."""
    return ts_mean(as_feature(f), d)


_REGIME: Mapping[str, tuple] = {"TREND_STRENGTH": (20,), "VOL_REGIME": (20, 60), "VOL_CHG": (5,),
                                "MOM_CHG": (5,), "UP_RATIO": (10,)}


def regime_features() -> dict[str, Feature]:
    return {f"{n}{{{','.join(map(str, p))}}}": FEATURES[n](*p) for n, p in _REGIME.items()}

