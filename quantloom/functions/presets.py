"""Named signal templates: functions of window parameters that return a signal feature."""

from __future__ import annotations

from collections.abc import Callable

from quantloom.functions.feature import Feature
from quantloom.functions.features import FEATURES, companion, normalization, normalized
from quantloom.functions.signals import pipe_and, thr, thr_mean


def _f(name: str, *params) -> Feature:
    return normalized(FEATURES[name](*params), normalization(name))


def _above_mean(name: str) -> Callable[..., Feature]:
    return lambda *params: thr_mean(_f(name, *params))


# preset -> (category, number of parameters, feature whose value is compared with its running mean)
_SINGLE = {
    "ma_cross": ("overlap", 1, "SMA"), "ema": ("overlap", 1, "EMA"), "trima": ("overlap", 1, "TRIMA"),
    "boll": ("overlap", 1, "BBWIDTH"), "adx": ("momentum", 1, "ADX"), "cci": ("momentum", 1, "CCI"),
    "mom_ratio": ("momentum", 2, "MOM_RATIO"), "roc": ("momentum", 1, "ROC"), "mom_chg": ("momentum", 1, "MOM_CHG"),
    "atr": ("volatility", 1, "ATR"), "bbw": ("volatility", 1, "BBWIDTH"), "hv": ("volatility", 1, "HV"),
    "natr": ("volatility", 1, "NATR"), "stddev": ("volatility", 1, "STDDEV"),
    "trend_strength": ("regime", 1, "TREND_STRENGTH"), "vol_regime": ("regime", 1, "VOL_REGIME"),
    "vol_chg": ("regime", 1, "VOL_CHG"), "vol_ratio": ("volume", 2, "VOL_RATIO"), "obv": ("volume", 1, "OBV"),
    "tsf": ("statistic", 1, "TSF"), "var": ("statistic", 1, "VAR"), "correl": ("statistic", 1, "CORREL"),
    "linearreg": ("statistic", 1, "LINEARREG"),
}

PRESETS: dict[str, tuple[str, int, Callable[..., Feature]]] = {
    name: (category, n, _above_mean(feature)) for name, (category, n, feature) in _SINGLE.items()}
PRESETS |= {
    "rsi": ("momentum", 1, lambda p: _f("RSI", p)),
    "macd": ("momentum", 3, lambda fast, slow, signal: _f("MACD", fast, slow, signal)),
    "atr_trima": ("combo", 2, lambda a, b: pipe_and(thr_mean(_f("ATR", a)), thr_mean(_f("TRIMA", b)))),
    "atr_adx": ("combo", 2, lambda a, b: pipe_and(thr_mean(_f("ATR", a)), thr_mean(_f("ADX", b)))),
    "atr_roc": ("combo", 2, lambda a, b: pipe_and(thr_mean(_f("ATR", a)), thr_mean(_f("ROC", b)))),
    "atr_ma": ("combo", 1, lambda a: pipe_and(thr_mean(_f("ATR", a)), thr(_f("MA", 5, 20), 0))),
    "bbw_tsf": ("combo", 2, lambda a, b: thr_mean(_f("BBWIDTH", a)) - thr_mean(_f("TSF", b))),
    "bbw_tsf_vol": ("combo", 4, lambda a, s, l, b: thr_mean(_f("BBWIDTH", a)) - pipe_and(
        companion(_f("VOL_RATIO", s, l), s), thr_mean(_f("TSF", b)))),
}


def preset(name: str, *params) -> Feature:
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name}")
    _, n, build = PRESETS[name]
    if len(params) != n:
        raise ValueError(f"preset {name} needs {n} parameters, got {len(params)}")
    return build(*params)
