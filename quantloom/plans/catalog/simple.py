"""Two small catalogs: basic price/volume features and features relative to a benchmark."""

from __future__ import annotations

from quantloom.functions.cross_section import cs_rank
from quantloom.functions.feature import Feature, all_of, col, where
from quantloom.functions.regression import ts_resid
from quantloom.functions.rolling import (ts_argmax, ts_argmin, ts_corr, ts_delay, ts_delta, ts_mean,
                                         ts_rank, ts_skew, ts_std, ts_zscore)


def basic() -> dict[str, Feature]:
    o, h, l, c, v = (col(k) for k in ("open", "high", "low", "close", "volume"))
    out = {f"mom_{d}d": c - ts_delay(c, d) for d in (5, 10, 20, 60)}
    out |= {f"rev_{d}d": -(c - ts_delay(c, d)) for d in (5, 20)}
    out |= {f"vol_{d}d": ts_std(c, d) for d in (10, 20, 60)}
    out |= {f"vol_ratio_{d}d": v / ts_mean(v, d) for d in (10, 20)}
    out |= {f"ma_cross_{a}_{b}": ts_mean(c, a) - ts_mean(c, b) for a, b in ((5, 20), (10, 60))}
    out |= {
        "sma_10d": ts_mean(c, 10),
        "corr_close_vol_20d": ts_corr(c, v, 20),
        "cs_rank_mom_20d": cs_rank(c - ts_delay(c, 20)),
        "cs_rank_volume": cs_rank(v),
        "cs_zscore_mom_10d": ts_zscore(c - ts_delay(c, 10), 20),
        "dollar_volume": (c - o) * v,
        "range_pct": (h - l) / c,
    }
    return out


def industry() -> dict[str, Feature]:
    """Needs rel_amount, rel_close, bench_close and share (see operators.breadth)."""
    o, h, l, c, amt = (col(k) for k in ("open", "high", "low", "close", "amount"))
    bench, rel_amt, rel_close, share = (col(k) for k in
                                        ("bench_close", "rel_amount", "rel_close", "share"))
    revert = cs_rank(ts_argmin(ts_delta(c, 1), 30))
    trend = cs_rank(ts_argmax(c, 60))
    bull = ts_rank(bench, 60) > 0.7
    switch = where(bull, revert, trend)
    active = cs_rank(ts_rank(rel_amt, 10))
    rising = all_of(ts_delta(c, 5) > 0, ts_delta(amt, 5) > 0)
    return {
        "ind_amt_accel_20d": cs_rank(ts_delta(ts_mean(amt, 10), 10)),
        "ind_argmax_cross_60d": cs_rank(ts_argmax(c, 60) + ts_argmax(amt, 60)),
        "ind_argmin_delta1_30d": revert,
        "ind_corr_bench_delta": cs_rank(ts_delta(ts_corr(c, bench, 20), 20)),
        "ind_dual_sw_a1": switch * 0.9 + revert * 0.1,
        "ind_gap_range": cs_rank((o - ts_delay(c, 1)) / (h - l + 0.01)),
        "ind_rank_stable_5d": -ts_std(cs_rank(c), 5),
        "ind_relamt_rank_10d": active,
        "ind_revert_30d": revert,
        "ind_revert_enhanced": revert + rising * revert,
        "ind_revert_vol_confirm": cs_rank(-ts_zscore(ts_rank(c, 10), 10) * ts_zscore(amt, 20)),
        "ind_share_residual_20d": cs_rank(ts_resid(share, 20)),
        "ind_skew_relclose_60d": cs_rank(ts_skew(rel_close, 60)),
        "ind_switch_bull60": switch,
        "ind_switch_volhi_ra_m6": where(ts_rank(ts_std(c, 20), 60) > 0.8, active, trend),
        "ind_trend_60d": trend,
    }
