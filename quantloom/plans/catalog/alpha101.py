"""101 published formulaic features on daily bars (Kakushadze, "101 Formulaic Alphas", 2015).

Industry-neutral steps of the paper are left out and non-integer windows are rounded. ``/`` is
the guarded division of features, so a missing or zero divisor gives 0.
"""

from __future__ import annotations

from quantloom.functions.cross_section import cs_rank as rank
from quantloom.functions.feature import Feature, col, where
from quantloom.functions.rolling import (ts_argmax, ts_argmin, ts_corr, ts_cov, ts_decay_linear,
                                         ts_delay, ts_max, ts_mean, ts_min, ts_rank, ts_std, ts_sum)
from quantloom.functions.scalar import abs_, log, sign, signed_power, sqrt


def alpha101() -> dict[str, Feature]:
    o, h, l, c, v, vwap, ret = (col(k) for k in
                                ("open", "high", "low", "close", "volume", "vwap", "returns"))
    mid = (h + l) / 2

    def delta(x, d):
        return x - ts_delay(x, d)

    def adv(d):
        return ts_mean(v, d)

    def blend(x, y, share):
        return x * share + y * round(1 - share, 3)

    def lagged_mean(x, d, by=1):
        return ts_delay(ts_mean(x, d), by)

    d1 = delta(c, 1)
    body = c - o
    spread = (c - l) - (h - c)
    raw_turn = ((ts_delay(c, 20) - ts_delay(c, 10)) / 10 - (ts_delay(c, 10) - c) / 10) + 0.05
    a: dict[int, Feature] = {}

    a[1] = rank(ts_argmax(signed_power(where(ret < 0, ts_std(ret, 20), c), 2), 5)) - 0.5
    a[2] = -ts_corr(rank(delta(log(v), 2)), rank(body / o), 6)
    a[3] = -ts_corr(rank(o), rank(v), 10)
    a[4] = -ts_rank(rank(l), 9)
    a[5] = rank(o - ts_mean(o, 10)) * -abs_(d1)
    a[6] = -ts_corr(o, v, 10)
    d7 = delta(c, 7)
    a[7] = where(v > adv(20), -ts_rank(abs_(d7), 60) * sign(d7), -1)
    flow = ts_sum(o, 5) * ts_sum(ret, 5)
    a[8] = -rank(delta(flow, 10))

    def follow(d):
        return where(ts_min(d1, d) > 0, d1, where(ts_max(d1, d) < 0, d1, -d1))
    a[9] = follow(5)
    a[10] = rank(follow(4))
    a[11] = (rank(ts_max(vwap - c, 3)) + rank(ts_min(vwap - c, 3))) * rank(delta(v, 3))
    a[12] = sign(delta(v, 1)) * -d1
    a[13] = -rank(ts_cov(rank(c), rank(v), 5))
    a[14] = -rank(delta(ret, 3)) * ts_corr(o, v, 10)
    a[15] = -ts_sum(rank(ts_corr(rank(h), rank(v), 3)), 3)
    a[16] = -rank(ts_cov(rank(h), rank(v), 5))
    a[17] = -rank(ts_rank(c, 10)) * rank(delta(d1, 1)) * rank(ts_rank(v / adv(20), 5))
    a[18] = -rank(ts_std(abs_(body), 5) + body + ts_corr(c, o, 10))
    a[19] = -sign(d7 + d7) * (rank(ts_sum(ret, 250) + 1) + 1)
    a[20] = -rank(o - ts_delay(h, 1)) * rank(o - ts_delay(c, 1)) * rank(o - ts_delay(l, 1))
    a[21] = where(ts_mean(c, 8) + ts_std(c, 8) < ts_mean(c, 2), -1, 1)
    a[22] = -delta(ts_corr(h, v, 5), 5) * rank(ts_std(c, 20))
    a[23] = where(ts_mean(h, 20) < h, -delta(h, 2), 0)
    ma100 = ts_mean(c, 100)
    a[24] = where(delta(ma100, 100) / (ts_delay(c, 100) + 0.001) <= 0.05,
                  -c / (ma100 - c + 0.001), -log(c))
    a[25] = rank(-ret * adv(20) * vwap * (h - c))
    a[26] = -ts_max(ts_corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3)
    a[27] = where(rank(ts_corr(rank(v), rank(vwap), 6)) > 0.5, -1, 1)
    a[28] = ts_corr(adv(20), l, 5) + mid - c
    a[29] = (ts_min(rank(log(ts_sum(rank(-rank(d1)), 15))), 5)
             + ts_rank(ts_delay(-ret, 6), 5))
    streak = (sign(d1) + sign(ts_delay(c, 1) - ts_delay(c, 2))
              + sign(ts_delay(c, 2) - ts_delay(c, 3)))
    a[30] = (1 - rank(streak)) * ts_sum(v, 5) / ts_sum(v, 20)
    a[31] = (rank(ts_decay_linear(-rank(delta(c, 10)), 10)) + rank(-delta(c, 3))
             + sign(ts_corr(adv(20), l, 12)))
    a[32] = ts_sum(c, 7) / 7 - c + ts_corr(vwap, ts_delay(c, 5), 230) * 20
    a[33] = rank(-(1 - o / c))
    a[34] = rank((1 - rank(ts_std(ret, 2) / ts_std(ret, 5))) + (1 - rank(d1)))
    a[35] = ts_rank(v, 32) * (1 - ts_rank(c + h - l, 16)) * (1 - ts_rank(ret, 32))
    a[36] = (rank(ts_corr(body, ts_delay(v, 1), 15)) * 2.21 + rank(o - c) * 0.7
             + rank(ts_rank(ts_delay(-ret, 6), 5)) * 0.73 + rank(abs_(ts_corr(vwap, adv(20), 6)))
             + rank((ts_mean(c, 200) - o) * body) * 0.6)
    a[37] = rank(ts_corr(ts_delay(o - c, 1), c, 200)) + rank(o - c)
    a[38] = -rank(ts_rank(c, 10)) * rank(c / o)
    a[39] = (-rank(d7 * (1 - rank(ts_decay_linear(v / adv(20), 9))))
             * (rank(ts_sum(ret, 250)) + 1))
    a[40] = -rank(ts_std(h, 10)) * ts_corr(h, v, 10)
    a[41] = sqrt(h * l) - vwap
    a[42] = rank(vwap - c) / rank(vwap + c)
    a[43] = ts_rank(adv(20), 20) * ts_rank(-d7, 8)
    a[44] = -ts_corr(h, rank(v), 5)
    a[45] = -rank(delta(blend(c, o, 0.6), 1)) * rank(ts_corr(vwap, adv(20), 15))
    a[46] = (ts_mean(c, 3) + ts_mean(c, 6) + ts_mean(c, 12) + ts_mean(c, 24)) / (c * 4)
    a[47] = lagged_mean((ts_max(h, 6) - c) / (ts_max(h, 6) - ts_min(l, 6)) * 100, 9)
    a[48] = -ts_corr(rank(h), rank(v), 5) * ts_rank(v, 5)
    a[49] = where(raw_turn < 0, -c / (ts_delay(c, 20) + 0.001), 1)
    a[50] = -ts_max(rank(ts_corr(rank(v), rank(vwap), 5)), 5)
    a[51] = where(raw_turn < 0, -1, 1)
    low5 = ts_min(l, 5)
    a[52] = ((ts_delay(low5, 5) - low5) * rank((ts_sum(ret, 240) - ts_sum(ret, 20)) / 220)
             * ts_rank(v, 5))
    a[53] = -delta(spread / (c - l), 9)
    a[54] = -((l - c) * signed_power(o, 5)) / ((l - h) * signed_power(c, 5))
    a[55] = -ts_corr(rank((c - ts_min(l, 12)) / (ts_max(h, 12) - ts_min(l, 12))), rank(v), 6)
    a[56] = -(rank(ts_sum(ret, 10) / ts_sum(ts_sum(ret, 2), 3)) * rank(ret))
    a[57] = -((c - vwap) / ts_decay_linear(rank(ts_argmax(c, 30)), 2))
    a[58] = -ts_rank(ts_decay_linear(ts_corr(vwap, v, 4), 8), 6)
    a[59] = -ts_rank(ts_decay_linear(ts_corr(vwap, v, 5), 6), 4)
    pressure = spread / (h - l) * v
    a[60] = -(rank(pressure) * 2 - rank(ts_argmax(c, 10)))
    a[61] = rank(vwap - ts_min(vwap, 16)) - rank(ts_corr(vwap, adv(180), 18))
    a[62] = (rank(ts_corr(vwap, ts_sum(adv(20), 22), 10))
             - rank((rank(o) + rank(o)) - (rank(mid) + rank(h))))
    a[63] = -(rank(ts_decay_linear(delta(c, 2), 8))
              - rank(ts_decay_linear(ts_sum(v, 10) / adv(10), 1)))
    a[64] = (rank(ts_corr(ts_sum(blend(o, l, 0.178), 13), ts_sum(adv(120), 13), 17))
             - rank(delta(blend(mid, vwap, 0.178), 4)))
    a[65] = (rank(ts_corr(blend(o, vwap, 0.008), ts_sum(adv(60), 9), 6))
             - rank(o - ts_min(o, 14)))
    a[66] = -(rank(ts_decay_linear(delta(vwap, 4), 7))
              + ts_rank(ts_decay_linear((l - vwap) / (o - mid), 11), 7))

    def bias(d, by):
        base = lagged_mean(c, d, by)
        return (c - base) / base * 100
    a[67] = lagged_mean(bias(10, 1), 2)
    gap = mid - lagged_mean(mid, 15, 2)
    a[68] = lagged_mean(gap / (lagged_mean(abs_(gap), 15, 2) * 0.5) * 100, 2)
    a[69] = -signed_power(rank(ts_max(delta(vwap, 3), 5)),
                          ts_rank(ts_corr(blend(c, vwap, 0.491), adv(20), 5), 9))
    a[70] = lagged_mean(bias(10, 2), 2)
    a[71] = -rank(ts_decay_linear(ts_corr(ts_rank(c, 3), rank(v), 5), 7))
    a[72] = ts_rank(ts_decay_linear(ts_corr(mid, adv(40), 9), 4), 2)
    a[73] = ts_rank(ts_decay_linear(ts_corr(mid, adv(40), 5), 3), 2)
    a[74] = (rank(ts_corr(c, ts_sum(adv(30), 37), 15))
             - rank(ts_corr(rank(blend(h, vwap, 0.026)), rank(v), 11)))
    a[75] = rank(ts_corr(vwap, v, 4)) - rank(ts_corr(rank(l), rank(adv(50)), 12))
    a[76] = ts_rank(ts_decay_linear(ts_corr(vwap, v, 17), 20), 3)
    a[77] = ts_rank(ts_decay_linear((mid + h) - (vwap + h), 9), 4)
    a[78] = signed_power(rank(ts_corr(ts_sum(blend(l, vwap, 0.352), 20), ts_sum(adv(40), 20), 7)),
                         rank(ts_corr(rank(vwap), rank(v), 6)))
    a[79] = signed_power(rank(delta(blend(c, o, 0.607), 4)),
                         ts_rank(ts_corr(ts_rank(vwap, 3), ts_rank(adv(81), 9), 12), 3))
    a[80] = -(rank(sign(delta(blend(o, h, 0.868), 4))) * ts_rank(ts_corr(h, adv(10), 5), 6))
    a[81] = -(rank(log(rank(signed_power(rank(ts_corr(vwap, ts_sum(adv(10), 50), 8)), 4))))
              - rank(ts_corr(rank(vwap), rank(v), 5)))
    a[82] = -ts_min(rank(ts_decay_linear(delta(o, 1), 15)), 5)
    width = (h - l) / ts_mean(c, 5)
    a[83] = rank(ts_delay(width, 2)) * rank(rank(v)) / (width / (vwap - c))
    a[84] = signed_power(ts_rank(vwap - ts_max(vwap, 15), 21), delta(c, 5))
    a[85] = signed_power(rank(ts_corr(blend(h, c, 0.877), adv(30), 10)),
                         rank(ts_corr(ts_rank(mid, 4), ts_rank(v, 10), 15)))
    a[86] = -(ts_rank(ts_corr(c, ts_sum(adv(20), 15), 6), 20) - rank((o + c) - (vwap + o)))
    a[87] = lagged_mean(lagged_mean(bias(8, 1), 3), 3)
    a[88] = rank(ts_decay_linear((rank(o) + rank(l)) - (rank(h) + rank(c)), 8))
    a[89] = (ts_rank(ts_decay_linear(ts_corr(l, adv(10), 7), 6), 4)
             - ts_rank(ts_decay_linear(delta(vwap, 3), 10), 15))
    a[90] = -(rank(c - ts_max(c, 5)) * ts_rank(ts_corr(vwap, adv(40), 9), 7))
    a[91] = a[87]
    a[92] = ts_rank(ts_decay_linear(ts_corr(mid + c, adv(10), 12), 7), 16)
    a[93] = ts_rank(ts_decay_linear(ts_corr(vwap, adv(81), 17), 6), 6)
    a[94] = -(rank(vwap - ts_min(vwap, 12))
              * ts_rank(ts_corr(ts_rank(vwap, 20), ts_rank(adv(60), 4), 18), 3))
    a[95] = (rank(o - ts_min(o, 12))
             - ts_rank(signed_power(rank(ts_corr(ts_sum(mid, 19), ts_sum(adv(40), 19), 13)), 5), 12))
    a[96] = -ts_rank(ts_decay_linear(ts_corr(rank(vwap), rank(v), 6), 7), 5)
    a[97] = -(rank(ts_decay_linear(delta(blend(l, vwap, 0.721), 3), 20))
              - ts_rank(ts_decay_linear(
                  ts_rank(ts_corr(ts_rank(l, 8), ts_rank(adv(60), 17), 5), 19), 15), 7))
    a[98] = rank(ts_decay_linear(ts_corr(vwap, ts_sum(adv(5), 26), 5), 7)) - 5.236
    a[99] = -(rank(ts_corr(ts_sum(mid, 20), ts_sum(adv(60), 20), 9)) - rank(ts_corr(l, v, 6)))
    a[100] = -(rank(pressure) * 1.5 - (ts_corr(c, rank(adv(20)), 5) - rank(ts_argmin(c, 30))))
    a[101] = body / (h - l + 0.001)
    return {f"alpha{i:03d}": f for i, f in sorted(a.items())}
