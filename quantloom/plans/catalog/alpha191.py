"""190 short-horizon price/volume features (after a 2017 broker study of 191 factors).

Number 141 is left out: it ranks along time without saying over how many rows.
"""

from __future__ import annotations

from quantloom.functions.cross_section import cs_rank as rank
from quantloom.functions.feature import Feature, col, where
from quantloom.functions.regression import reg_resid, reg_slope
from quantloom.functions.rolling import (ts_argmax, ts_argmin, ts_corr, ts_cov, ts_decay_linear,
                                         ts_delay, ts_delta, ts_max, ts_mean, ts_min, ts_rank,
                                         ts_std, ts_sum, ts_zscore)
from quantloom.functions.scalar import abs_, log, sign, sqrt

CATEGORIES = (("momentum", 1, 30), ("reversal", 31, 60), ("volatility", 61, 80),
              ("price_volume", 81, 130), ("valuation", 131, 140), ("price_volume", 141, 160),
              ("technical", 161, 191))


def category(number: int) -> str:
    return next(name for name, first, last in CATEGORIES if first <= number <= last)


def alpha191() -> dict[str, Feature]:
    o, h, l, c, v, vwap = (col(k) for k in ("open", "high", "low", "close", "volume", "vwap"))
    eps = 0.001
    pc = ts_delay(c, 1)
    d1 = c - pc
    dv5 = v - ts_delay(v, 5)
    body = c - o
    mid = (h + l) / 2
    signed = sign(body) * v
    turnover = c * v
    hi20, lo20 = ts_max(c, 20), ts_min(c, 20)

    def mom(d): return c - ts_delay(c, d)
    def adv(d): return ts_mean(v, d)
    def ma(d): return ts_delay(ts_mean(c, d), 1)
    def busy(d): return v / (adv(d) + eps)

    heavy = v / adv(20)
    gain = where(c > pc, d1, 0.0)
    up_share = ts_mean(gain, 14) / (ts_mean(abs_(d1), 14) + eps)
    g: dict[int, Feature] = {}

    # momentum
    g[1] = rank(mom(5))
    g[2] = mom(20) * dv5
    g[3] = rank(d1 * v)
    g[4] = mom(5) * heavy
    g[5] = rank(d1 * heavy)
    g[6] = ts_rank(d1, 10) * -ts_std(d1, 10)
    g[7] = ts_rank(d1, 20)
    g[8] = ts_rank(d1, 5) + ts_rank(v, 5)
    g[9] = ts_decay_linear(d1, 4)
    g[10] = mom(5) * -ts_std(d1, 20)
    g[11] = dv5 * mom(5)
    g[12] = ts_decay_linear(d1, 20)
    g[13] = mid - ts_delay(mid, 20) - mom(20)
    g[14] = -rank(ts_argmax(c, 30))
    g[15] = rank(ts_argmin(c, 30))
    g[16] = hi20 - lo20
    g[17] = (c - lo20) / (hi20 - lo20)
    g[18] = mom(10) * (d1 - ts_delay(d1, 1))
    g[19] = ts_mean(d1, 20) - ts_std(d1, 20)
    g[20] = rank(c - vwap)
    g[21] = rank(c - ma(20))
    g[22] = (c - ma(20)) / ma(20)
    g[23] = c / ma(20)
    g[24] = mom(20) / ts_std(d1, 20)
    g[25] = mom(5) * ts_corr(c, v, 20)
    g[26] = c - ts_mean(c, 20)
    g[27] = c - ts_max(c, 5)
    g[28] = (hi20 - lo20) / ts_mean(c, 20)
    g[29] = d1 * ts_rank(v, 20)
    g[30] = ts_rank(c, 10) - ts_rank(v, 10)

    # reversal
    g[31] = -ts_rank(d1, 5)
    g[32] = -(mom(20) * ts_rank(v, 5))
    g[33] = -((c - vwap) * ts_rank(v, 5))
    g[34] = -ts_decay_linear(d1, 10)
    g[35] = -ts_zscore(d1, 20)
    g[36] = -ts_rank(d1, 30)
    g[37] = -ts_rank(c, 45)
    g[38] = -ts_rank(c, 60)
    g[39] = -g[4]
    g[40] = -rank(d1 * (v / ts_delay(v, 1)))
    g[41] = (c - l) / (h - l + eps)
    g[42] = up_share
    g[43] = -(h - ts_delay(h, 10))
    g[44] = -rank(body * v)
    g[45] = -ts_corr(ts_rank(c, 5), ts_rank(v, 5), 10)
    g[46] = -ts_cov(c, v, 10)
    g[47] = -ts_rank(body / (o + eps) * v, 5)
    g[48] = rank(ts_argmax(c, 60))
    g[49] = -rank(ts_argmin(c, 60))
    position = (c - lo20) / (hi20 - lo20 + eps)
    g[50] = -position
    g[51] = -ts_rank(d1, 20)
    g[52] = rank(-d1) * ts_rank(v, 20)
    g[53] = (o - pc) / (pc + eps)
    g[54] = ts_corr(-d1, ts_rank(v, 5), 20)
    g[55] = -ts_rank(mom(60), 10)
    g[56] = -(c - hi20)
    g[57] = -ts_rank(c / ma(20), 10)
    g[58] = -where(pc > c, d1, 0.0)
    g[59] = -(mom(5) / (ts_std(d1, 20) + eps) * ts_rank(v, 20))
    g[60] = rank(-mom(10)) * ts_corr(c, v, 10)

    # volatility
    for n, d in ((61, 20), (62, 10), (63, 60)):
        g[n] = -ts_std(d1, d)
    for n, d in ((64, 20), (65, 10), (66, 60)):
        g[n] = -ts_zscore(d1, d)
    g[67] = -ts_std(where(c > pc, 0.0, d1), 20)
    g[68] = -((h - l) / (c + eps))
    g[69] = -(ts_mean(h - l, 20) / c)
    g[70] = ts_std(d1, 10) - ts_delay(ts_std(d1, 10), 1)
    g[71] = -ts_cov(d1, ts_delay(d1, 1), 20)
    g[72] = -((h - l) / (ts_mean(c, 20) + eps))
    g[73] = -(ts_std(v, 20) / (adv(20) + eps))
    g[74] = -ts_std(d1, 20) - ts_rank(v, 20)
    g[75] = -ts_rank(ts_std(d1, 20), 20)
    g[76] = -reg_slope(d1, d1, 60)
    g[77] = -ts_std(position, 10)
    g[78] = -ts_std(c - ma(10), 20)
    g[79] = -ts_rank(ts_sum(abs_(d1), 20), 20)
    g[80] = -(ts_std(c, 20) / (ts_mean(c, 20) + eps))

    # price and volume
    for n, d in ((81, 20), (82, 5), (83, 60)):
        g[n] = busy(d)
    g[84], g[85] = ts_rank(v, 5), ts_rank(v, 20)
    g[86], g[87] = v - ts_delay(v, 1), dv5
    g[88] = ts_sum(v, 5) / (ts_sum(v, 20) + eps)
    g[89] = ts_sum(v, 10) / (ts_sum(v, 60) + eps)
    g[90] = adv(5) - adv(20)
    g[91] = ts_max(v, 20) / (v + eps)
    g[92] = busy(20) * d1
    g[93] = ts_corr(v, c, 10)
    g[94] = ts_corr(v, d1, 10)
    g[95] = ts_rank(dv5, 10)
    g[96] = ts_decay_linear(v - adv(20), 10)
    g[97] = ts_zscore(v, 20)
    g[98] = v * abs_(d1)
    g[99] = -ts_rank(v, 10)
    g[100] = ts_std(v, 20)
    g[101] = rank(v)
    g[102] = signed
    g[103] = rank(v * vwap)
    g[104] = body * v / (o + eps)
    g[105], g[106] = ts_sum(signed, 5), ts_sum(signed, 20)
    g[107] = ts_sum(signed, 5) - ts_delay(ts_sum(signed, 5), 5)
    g[108] = ts_corr(signed, d1, 20)
    g[109] = ts_rank(body * v, 10)
    g[110] = body * v / (ts_mean(turnover, 20) + eps)
    g[111] = g[88] * d1
    g[112] = ts_mean(v * d1, 5)
    g[113] = ts_mean(v * d1, 5) / (ts_std(d1, 20) + eps)
    g[114] = ts_rank(v * vwap, 20)
    g[115] = sqrt(h * l) / c
    g[116] = -((h - c) / (c + eps))
    g[117] = (c - l) / (c + eps)
    g[118] = body / (h - l + eps)
    g[119] = (c - ts_mean(mid, 20)) / (ts_mean(abs_(c - ts_mean(c, 20)), 20) * 0.015 + eps)
    g[120] = up_share - 0.5
    g[121] = -((ts_max(h, 14) - c) / (ts_max(h, 14) - ts_min(l, 14) + eps))
    g[122] = ts_decay_linear(signed, 10)
    over = v - adv(20)
    g[123] = where(c > pc, over * d1, -over * abs_(d1))
    g[124] = -ts_rank(v, 10) - ts_rank(d1, 10)
    g[125] = ts_rank(v, 10) * ts_rank(d1, 5)
    g[126] = ts_delay(adv(5), 1) - ts_delay(adv(20), 1)
    g[127] = signed * ((h - l) / (c + eps))
    g[128] = rank(ts_argmax(v, 20))
    g[129] = ts_std(v * d1, 20)
    g[130] = ts_decay_linear(c, 5) / (ts_decay_linear(c, 20) + eps)

    # valuation
    g[131] = -ts_mean(turnover, 20)
    g[132] = -rank(turnover)
    g[133] = -rank(turnover) * d1
    g[134] = c - ts_mean(c, 60)
    peak = c / (ts_max(c, 252) + eps)
    g[135] = peak
    g[136], g[137] = mom(60), mom(120)
    g[138] = ts_rank(peak, 20)
    g[139] = rank(ts_argmax(c, 252))
    g[140] = -mom(252)

    # regressions of log price changes on log volume changes: slope and residual in turn
    dlv = ts_delta(log(v), 1)
    for n, price in zip((142, 144, 146, 148), (c, h, l, vwap)):
        dlp = ts_delta(log(price), 1)
        g[n] = -rank(reg_slope(dlp, dlv, 5))
        g[n + 1] = -rank(reg_resid(dlp, dlv, 5))
    # how often the left side exceeded yesterday's right side in 5 rows
    pairs = [(c, c), (c, o), (c, h), (h, l), (l, vwap), (vwap, vwap),
             (v, c), (v, o), (v, h), (v, l), (v, vwap)]
    for n, (now, before) in enumerate(pairs, start=150):
        g[n] = -rank(ts_sum(now > ts_delay(before, 1), 5))

    # technical
    dif = ma(12) - ma(26)
    dea = ts_delay(ts_mean(dif, 9), 1)
    g[161], g[162], g[163] = dif, dea, dif - dea
    sd2 = ts_std(c, 20) * 2
    g[164] = sd2 / (ma(20) + eps)
    g[165] = (c - (ma(20) - sd2)) / (ts_std(c, 20) * 4 + eps)
    g[166] = c - (ma(20) + sd2)
    g[167] = c - (ma(20) - sd2)
    g[168] = (c - ma(20)) / (ts_std(c, 20) + eps)
    for n, (a, b) in zip((169, 170, 171, 172), ((5, 10), (5, 20), (10, 30), (5, 60))):
        g[n] = ma(a) - ma(b)
    g[173] = (ma(5) - ma(10)) + (ma(10) - ma(20))
    g[174] = body / (o + eps)
    g[175] = (h - o) / (o + eps)
    g[176] = -((o - l) / (o + eps))
    g[177], g[178] = ts_mean(h - l, 5) / c, ts_mean(h - l, 20) / c
    g[179] = (c - vwap) / (vwap + eps)
    g[180] = rank(vwap)
    g[181] = where(c > pc, v, -v)
    g[182], g[183] = ts_rank(c, 10) - ts_rank(c, 60), ts_rank(c, 10) - ts_rank(c, 20)
    g[184] = (ma(5) - ma(20)) * busy(20)
    g[185] = ts_sum(sign(d1) * v, 20)
    g[186] = ts_corr(ma(5), ma(20), 30)
    g[187] = where(c > pc, d1, -d1) * busy(10)
    g[188] = ts_rank(ma(5), 20)
    g[189] = rank(c) - rank(d1)
    g[190] = ts_rank(ts_std(c, 10), 20)
    g[191] = ts_corr(rank(c), rank(v), 20)
    return {f"gtja_{i:03d}": f for i, f in sorted(g.items())}
