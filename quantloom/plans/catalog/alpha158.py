"""158 candle, price and rolling features: 9 + 4 + 29 families over 5, 10, 20, 30, 60 rows.

VWAP is approximated by (high + low + close) / 3.
"""

from __future__ import annotations

from quantloom.functions.feature import Feature, col, where
from quantloom.functions.regression import ts_resid, ts_rsq, ts_slope
from quantloom.functions.rolling import (ts_argmax, ts_argmin, ts_corr, ts_delay, ts_max, ts_mean,
                                         ts_min, ts_quantile, ts_rank, ts_std, ts_sum)
from quantloom.functions.scalar import abs_, log

WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12


def alpha158() -> dict[str, Feature]:
    o, h, l, c, v = (col(k) for k in ("open", "high", "low", "close", "volume"))
    pc, pv = ts_delay(c, 1), ts_delay(v, 1)
    top, bottom, span = where(o > c, o, c), where(o < c, o, c), h - l + EPS
    two_c = c * 2 - h - l
    out = {
        "KMID": (c - o) / o, "KLEN": (h - l) / o, "KMID2": (c - o) / span,
        "KUP": (h - top) / o, "KUP2": (h - top) / span,
        "KLOW": (bottom - l) / o, "KLOW2": (bottom - l) / span,
        "KSFT": two_c / o, "KSFT2": two_c / span,
        "OPEN0": o / c, "HIGH0": h / c, "LOW0": l / c, "VWAP0": (h + l + c) / 3 / c,
    }
    wave = abs_(c / pc - 1) * v

    def part(x, prev, d, up):
        change = (x - prev) if up else (prev - x)
        return ts_sum(where(change > 0, change, 0), d) / (ts_sum(abs_(x - prev), d) + EPS)

    families = {
        "ROC": lambda d: ts_delay(c, d) / c,
        "MA": lambda d: ts_mean(c, d) / c,
        "STD": lambda d: ts_std(c, d) / c,
        "BETA": lambda d: ts_slope(c, d) / c,
        "RSQR": lambda d: ts_rsq(c, d),
        "RESI": lambda d: ts_resid(c, d) / c,
        "MAX": lambda d: ts_max(h, d) / c,
        "MIN": lambda d: ts_min(l, d) / c,
        "QTLU": lambda d: ts_quantile(c, d, 0.8) / c,
        "QTLD": lambda d: ts_quantile(c, d, 0.2) / c,
        "RANK": lambda d: ts_rank(c, d),
        "RSV": lambda d: (c - ts_min(l, d)) / (ts_max(h, d) - ts_min(l, d) + EPS),
        "IMAX": lambda d: ts_argmax(h, d) / d,
        "IMIN": lambda d: ts_argmin(l, d) / d,
        "IMXD": lambda d: (ts_argmax(h, d) - ts_argmin(l, d)) / d,
        "CORR": lambda d: ts_corr(c, log(v + 1), d),
        "CORD": lambda d: ts_corr(c / pc, log(v / pv + 1), d),
        "CNTP": lambda d: ts_mean(c > pc, d),
        "CNTN": lambda d: ts_mean(c < pc, d),
        "CNTD": lambda d: ts_mean(c > pc, d) - ts_mean(c < pc, d),
        "SUMP": lambda d: part(c, pc, d, True),
        "SUMN": lambda d: part(c, pc, d, False),
        "SUMD": lambda d: part(c, pc, d, True) - part(c, pc, d, False),
        "VMA": lambda d: ts_mean(v, d) / (v + EPS),
        "VSTD": lambda d: ts_std(v, d) / (v + EPS),
        "WVMA": lambda d: ts_std(wave, d) / (ts_mean(wave, d) + EPS),
        "VSUMP": lambda d: part(v, pv, d, True),
        "VSUMN": lambda d: part(v, pv, d, False),
        "VSUMD": lambda d: part(v, pv, d, True) - part(v, pv, d, False),
    }
    for name, make in families.items():
        for d in WINDOWS:
            out[f"{name}{d}"] = make(d)
    return out
