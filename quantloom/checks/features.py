"""Feature-space, preset, sweep and walk-forward queries."""

from __future__ import annotations

from quantloom import col
from quantloom.checks.base import PANEL_SQL, RETS_SQL, SQL, check, panel, rets, rounded, rsql
from quantloom.checks.duck import P, feature_sql, last
from quantloom.checks.functions import _DIF, _wilder, add, hand, smoothed
from quantloom.checks.portfolio import NAV_TAIL, symbol_nav
from quantloom.functions import features as ft
from quantloom.functions.presets import PRESETS, preset
from quantloom.functions.rolling import ts_roc
from quantloom.plans import sweep as sw
from quantloom.sources.store import materialize

F_ = ft.FEATURES
_CH = f"CASE WHEN lag(close, {{n}}) OVER ({P}) > 0 THEN close / lag(close, {{n}}) OVER ({P}) - 1 END"


def stage(*steps: str) -> str:
    """Chain of CTE select lists on top of the numbered panel."""
    out, below = [f"WITH {PANEL_SQL}, p0 AS (SELECT *, row_number() OVER ({P}) AS rn FROM t0)"], "p0"
    for i, s in enumerate(steps[:-1], 1):
        out.append(f"p{i} AS (SELECT *, {s} FROM {below})")
        below = f"p{i}"
    return ",\n".join(out) + f"\nSELECT symbol, ts, {rsql(steps[-1])} AS value FROM {below}"


def avg(x, d):
    return f"CASE WHEN rn >= {d} THEN avg({x}) {last(d)} END"


add("feature_sma", F_["SMA"](10), hand(avg("close", 10)))
add("feature_ma", F_["MA"](5, 20), hand(f"CASE WHEN {avg('close', 20)} > 0 THEN ({avg('close', 5)} - {avg('close', 20)}) * 100 / {avg('close', 20)} ELSE 0.0 END"))
add("feature_hv", F_["HV"](20), stage(f"close / lag(close) OVER ({P}) - 1 AS r", f"CASE WHEN rn >= 20 THEN stddev_samp(r) {last(20)} * sqrt(252.0) * 100 END"))
add("feature_vol_ratio", F_["VOL_RATIO"](5, 20), hand(f"CASE WHEN rn >= 20 THEN avg(volume) {last(5)} / avg(volume) {last(20)} ELSE 0.0 END"))
add("feature_vol_chg", F_["VOL_CHG"](5), stage(f"CASE WHEN rn >= 15 THEN avg(volume) {last(5)} / avg(volume) {last(15)} ELSE 0.0 END AS r", f"lag(r, 5) OVER ({P}) AS q",
    "CASE WHEN q > 1e-10 THEN r / q - 1 ELSE 0.0 END"))
add("feature_trend_strength", F_["TREND_STRENGTH"](20), stage(_CH.format(n=1) + " AS r", f"CASE WHEN rn >= 20 AND stddev_samp(r) {last(20)} > 1e-10 THEN sum(r) {last(20)} / stddev_samp(r) {last(20)} ELSE 0.0 END"))
add("feature_vol_regime", F_["VOL_REGIME"](20, 60), stage(_CH.format(n=1) + " AS r", f"CASE WHEN rn >= 60 AND stddev_samp(r) {last(60)} > 1e-10 THEN stddev_samp(r) {last(20)} / stddev_samp(r) {last(60)} ELSE 0.0 END"))
add("feature_mom_chg", F_["MOM_CHG"](5), stage(_CH.format(n=5) + " AS m", f"lag(m, 5) OVER ({P}) AS q", "CASE WHEN abs(q) > 1e-10 THEN m - q ELSE 0.0 END"))
add("feature_up_ratio", F_["UP_RATIO"](10), stage(f"CASE WHEN lag(close) OVER ({P}) IS NOT NULL THEN (close > lag(close) OVER ({P}))::INT END AS u", avg("u", 10)))
add("feature_mfi", F_["MFI"](14), stage("(high + low + close) / 3.0 AS tp", f"tp * volume AS mf, lag(tp) OVER ({P}) AS pt",
    "CASE WHEN pt IS NOT NULL THEN CASE WHEN tp > pt THEN mf ELSE 0.0 END END AS up, CASE WHEN pt IS NOT NULL THEN CASE WHEN tp < pt THEN mf ELSE 0.0 END END AS dn",
    f"CASE WHEN rn >= 15 THEN CASE WHEN sum(up) {last(14)} + sum(dn) {last(14)} >= 1 THEN 100 * sum(up) {last(14)} / (sum(up) {last(14)} + sum(dn) {last(14)}) ELSE 0.0 END - 50 END"))


def _u(d):
    return f"sum(bp) {last(d)} / sum(tr) {last(d)}"


add("feature_ultosc", F_["ULTOSC"](7, 14, 28), stage(f"lag(close) OVER ({P}) AS pc", "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, "
    "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr", f"CASE WHEN rn >= 29 THEN ({_u(7)} * 4 + {_u(14)} * 2 + {_u(28)}) * 100 / 7.0 - 50 END"))
add("feature_obv", F_["OBV"](10), stage(f"volume * coalesce(sign(close - lag(close) OVER ({P})), 0) AS s", f"sum(s) OVER ({P}) AS o", f"lag(o, 10) OVER ({P}) AS q",
    "CASE WHEN q <> 0 THEN (o / q - 1) * 100 WHEN q = 0 THEN 0.0 END"))
add("feature_avgprice", F_["AVGPRICE"](), hand("(close - (open + high + low + close) / 4) * 100 / ((open + high + low + close) / 4)"))
add("feature_wclprice", F_["WCLPRICE"](), hand("(close - (high + low + 2 * close) / 4) * 100 / ((high + low + 2 * close) / 4)"))
add("feature_correl", F_["CORREL"](10), hand(f"CASE WHEN rn >= 10 THEN corr(close, rn) {last(10)} END"))
add("feature_roc", F_["ROC"](5), hand(_CH.format(n=5)))
add("feature_mom_ratio", F_["MOM_RATIO"](5, 20), stage(f"{_CH.format(n=5)} AS a, {_CH.format(n=20)} AS b", "CASE WHEN abs(b) > 1e-10 THEN a / abs(b) ELSE 0.0 END"))
add("feature_atr_by_close", ft.normalized(F_["ATR"](14), "close"), smoothed([_wilder("e", "p", "tr", 14, 1)], ["e"], "e.v / close"))
def _whole(d: int, expr: str) -> str:
    return hand(f"CASE WHEN rn >= {d} THEN {expr.format(w=last(d))} END")


_TRIMA = f"""WITH {PANEL_SQL}, p0 AS (SELECT *, row_number() OVER ({P}) AS rn FROM t0), p AS (SELECT *, CASE WHEN rn >= 3 THEN avg(close) {last(3)} END AS m FROM p0)
SELECT symbol, ts, {rsql(f"CASE WHEN count(m) {last(4)} = 4 THEN avg(m) {last(4)} END")} AS value FROM p"""
_OTHER = {
    "stddev": ((8,), _whole(8, "stddev_pop(close) {w}")), "var": ((8,), _whole(8, "var_pop(close) {w}")),
    "bbwidth": ((8,), _whole(8, "4 * stddev_pop(close) {w} / avg(close) {w}")), "bbw": ((8,), _whole(8, "4 * stddev_pop(close) {w} / avg(close) {w}")),
    "tsf": ((7,), _whole(7, "regr_intercept(close, rn) {w} + regr_slope(close, rn) {w} * (rn + 1)")),
    "linearreg": ((8,), _whole(8, "regr_intercept(close, rn) {w} + regr_slope(close, rn) {w} * rn")),
    "wma": ((8,), _whole(8, "(sum(close * rn) {w} - (rn - 8) * sum(close) {w}) / 36.0")), "trima": ((6,), _TRIMA),
    "ema": ((20,), SQL["ema"]), "natr": ((14,), SQL["natr"]), "adx": ((14,), SQL["adx"]), "rsi": ((14,), SQL["rsi"]), "cci": ((14,), SQL["cci"]),
    "dema": ((10,), SQL["dema"]), "kama": ((10,), SQL["kama"]), "macd": ((12, 26, 9), smoothed(_DIF, ["dif", "sig"], "dif.d - sig.v"))}
add("feature_other_indicators", {n: F_[n.upper()](*p) for n, (p, _) in _OTHER.items()},
    "WITH " + ", ".join(f"q_{n} AS ({q})" for n, (_, q) in _OTHER.items()) + " SELECT symbol, ts, "
    + ", ".join(f"q_{n}.value AS {n}" for n in _OTHER) + " FROM q_stddev " + " ".join(f"JOIN q_{n} USING (symbol, ts)" for n in _OTHER if n != "stddev"))


@check("feature_matrix", f"""WITH {PANEL_SQL}, p AS (SELECT *, row_number() OVER ({P}) AS rn FROM t0),
q AS (SELECT symbol, ts, rn, {avg('close', 5)} / close AS s5, {avg('close', 10)} / close AS s10, {_CH.format(n=5)} AS r5 FROM p),
m AS (SELECT *, {avg('s5', 10)} AS m5, {avg('s10', 10)} AS m10, {avg('r5', 10)} AS mr FROM q)
SELECT symbol, ts, {rsql('s5')} AS "SMA{{5}}", {rsql('s10')} AS "SMA{{10}}", {rsql('r5')} AS "ROC{{5}}", {rsql('m5')} AS "SMA{{5}}_MA", {rsql('m10')} AS "SMA{{10}}_MA", {rsql('mr')} AS "ROC{{5}}_MA",
  {rsql('s5 - s10')} AS "SMA_SMA_sub{{5,10}}" FROM m WHERE s5 + s10 + r5 + m5 + m10 + mr IS NOT NULL""")
def _(spark, path):
    return rounded(ft.feature_matrix(panel(spark, path), [("SMA", {"period": [5, 10]}), ("ROC", {"period": 5})],
                                     ma_windows=[10], differences=[("SMA{5}", "SMA{10}", "sub")]))


add("preset_ma_cross", preset("ma_cross", 10), stage(f"{avg('close', 10)} / close AS v", f"CASE WHEN rn > 20 AND v > avg(v) OVER ({P}) THEN 1.0 ELSE 0.0 END"))
add("preset_roc", preset("roc", 5), stage(_CH.format(n=5) + " AS v", f"CASE WHEN rn > 20 AND v > avg(v) OVER ({P}) THEN 1.0 ELSE 0.0 END"))
_ONE = {"macd": (12, 26, 9), "atr_trima": (7, 20), "atr_adx": (7, 14), "bbw_tsf": (30, 7), "bbw_tsf_vol": (30, 5, 20, 7), "atr_roc": (7, 10),
        "mom_ratio": (5, 20), "vol_ratio": (5, 20)}
_PRESETS = {n: preset(n, *_ONE.get(n, (10,) * PRESETS[n][1])) for n in sorted(PRESETS)}
add("preset_all", _PRESETS, feature_sql(_PRESETS, PANEL_SQL))

# -- sweeps ------------------------------------------------------------------------------------------------
O = "PARTITION BY symbol ORDER BY ts"
_MET = """m0 AS (SELECT {by}, count(*) AS n, arg_max(nav, ts) / arg_min(nav, ts) - 1 AS tot, stddev_samp(r) * sqrt(252.0) AS vol, min(nav / pk - 1) AS md FROM
  (SELECT *, nav / lag(nav) OVER w - 1 AS r, max(nav) OVER w AS pk FROM nv WINDOW w AS (PARTITION BY {by} ORDER BY ts)) GROUP BY {by}),
m AS (SELECT *, pow(1 + tot, 252.0 / (n - 1)) - 1 AS ann FROM m0)"""
_OUT = f"{rsql('coalesce((ann - 0.02) / nullif(vol, 0), 0)', 4)} AS sharpe, {rsql('ann')} AS annual_return, {rsql('CASE WHEN md < 0 THEN md ELSE 0.0 END')} AS max_drawdown"
_SIGS = ", ".join(f"close / lag(close, {d}) OVER ({O}) - 1 AS s{d}" for d in (2, 4, 8))


@check("sweep_signal_grid", f"""WITH {RETS_SQL}, s0 AS (SELECT *, {_SIGS} FROM rets),
s AS (SELECT 0 AS variant_id, 'd=2' AS params, symbol, ts, ret, s2 AS sig FROM s0 UNION ALL SELECT 1, 'd=4', symbol, ts, ret, s4 FROM s0 UNION ALL SELECT 2, 'd=8', symbol, ts, ret, s8 FROM s0),
h AS (SELECT *, CASE WHEN lag(sig) OVER (PARTITION BY variant_id, symbol ORDER BY ts) > 0 THEN coalesce(ret, 0) ELSE 0 END AS hr FROM s),
nv AS (SELECT variant_id, params, symbol, ts, product(1 + hr) OVER (PARTITION BY variant_id, symbol ORDER BY ts) AS nav FROM h), {_MET.format(by='variant_id, params, symbol')}
SELECT variant_id, params, symbol, {_OUT} FROM m""")
def _(spark, path):
    b = rets(spark, path)
    return rounded(sw.signal_sweep(b, b, lambda d: ts_roc(col("close"), d), sw.grid(d=[2, 4, 8])), sharpe=4)


_DRAWN = [v["d"] for v in sw.draws(5, 11, d=(2, 20))]
_DS = ", ".join(f"close / lag(close, {d}) OVER ({O}) - 1 AS s{i}" for i, d in enumerate(_DRAWN))
_DU = " UNION ALL ".join(f"SELECT {i} AS variant_id, 'd={d}' AS params, symbol, ts, ret, s{i} AS sig FROM s0" for i, d in enumerate(_DRAWN))


@check("sweep_random_search", f"""WITH {RETS_SQL}, s0 AS (SELECT *, {_DS} FROM rets), s AS ({_DU}),
h AS (SELECT *, CASE WHEN lag(sig) OVER (PARTITION BY variant_id, symbol ORDER BY ts) > 0 THEN coalesce(ret, 0) ELSE 0 END AS hr FROM s),
nv AS (SELECT variant_id, params, symbol, ts, product(1 + hr) OVER (PARTITION BY variant_id, symbol ORDER BY ts) AS nav FROM h), {_MET.format(by='variant_id, params, symbol')}
SELECT variant_id, params, symbol, {_OUT} FROM m""")
def _(spark, path):
    b = rets(spark, path)
    variants = sw.draws(5, 11, d=(2, 20))
    return rounded(sw.signal_sweep(b, b, lambda d: ts_roc(col("close"), d), variants), sharpe=4)


@check("sweep_factor_grid", f"""WITH {RETS_SQL}, sc AS (SELECT lookback, symbol, ts, ret, CASE lookback WHEN 2 THEN close / lag(close, 2) OVER w - 1 ELSE close / lag(close, 4) OVER w - 1 END AS score
  FROM rets, (SELECT unnest([2, 4]) AS lookback) WINDOW w AS (PARTITION BY lookback, symbol ORDER BY ts)), d AS (SELECT DISTINCT ts FROM rets),
reb AS (SELECT 'ME' AS rule, max(ts) AS ts FROM d GROUP BY date_trunc('month', ts) UNION ALL SELECT '4D', ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM d) WHERE i % 4 = 0),
rk AS (SELECT lookback, rule, symbol, ts, row_number() OVER (PARTITION BY lookback, rule, ts ORDER BY score DESC, symbol) AS rank FROM sc JOIN reb USING (ts) WHERE score IS NOT NULL),
w AS (SELECT lookback || '|' || rule || '|' || top AS strategy_id, ts, symbol, 1.0 / count(*) OVER (PARTITION BY lookback, rule, top, ts) AS weight
  FROM rk, (SELECT unnest([2, 3]) AS top) WHERE rank <= top){NAV_TAIL.format(cost='1.0')},
nv AS (SELECT strategy_id, ts, nav FROM nav), {_MET.format(by='strategy_id')},
xr AS (SELECT lookback, ts, rank() OVER v + (count(*) OVER (PARTITION BY lookback, ts, score) - 1) / 2.0 AS rv, rank() OVER r + (count(*) OVER (PARTITION BY lookback, ts, ret) - 1) / 2.0 AS rr
  FROM sc WHERE score IS NOT NULL AND ret IS NOT NULL WINDOW v AS (PARTITION BY lookback, ts ORDER BY score), r AS (PARTITION BY lookback, ts ORDER BY ret)),
xi AS (SELECT lookback, ts, corr(rv, rr) AS ic FROM xr GROUP BY 1, 2 HAVING count(*) >= 10),
xq AS (SELECT lookback, avg(ic) AS ic, avg(ic) / stddev_pop(ic) AS ir, avg((ic > 0)::INT) AS hit FROM xi GROUP BY 1)
SELECT CAST(lookback AS INTEGER) AS lookback, split_part(strategy_id, '|', 2) AS rule, CAST(split_part(strategy_id, '|', 3) AS INTEGER) AS top, {rsql('(ann - 0.02) / nullif(vol, 0)', 4)} AS sharpe,
  {rsql('CASE WHEN md < 0 THEN md END')} AS max_drawdown, {rsql('ic')} AS ic, {rsql('ir')} AS ir, {rsql('hit')} AS hit FROM m JOIN xq ON split_part(strategy_id, '|', 1) = lookback::VARCHAR""")
def _(spark, path):
    b = materialize(rets(spark, path), "returns")
    return rounded(sw.factor_sweep(b, b, lambda d: ts_roc(col("close"), d), [2, 4], ["ME", "4D"], [2, 3]), sharpe=4)


@check("sweep_compare_signals", f"""WITH {RETS_SQL}, nv AS (SELECT symbol AS strategy_id, ts, product(1 + coalesce(ret, 0)) OVER ({O}) AS nav FROM rets), {_MET.format(by='strategy_id')}
SELECT strategy_id, {rsql('(ann - 0.02) / vol')} AS sharpe, {rsql('ann')} AS annual_return, {rsql('CASE WHEN md < 0 THEN md END')} AS max_drawdown,
  CAST(row_number() OVER (ORDER BY (ann - 0.02) / vol DESC, strategy_id) AS INTEGER) AS rank FROM m""")
def _(spark, path):
    return rounded(sw.compare_signals(symbol_nav(spark, path)))


_SPLIT = ("2Y", "1Y", "6M")  # training, test and step, from the first date to the last


def _wins_sql(anchored: bool = False) -> str:
    moved = "lo + to_months(CAST(6 * k AS INTEGER))"
    return f"""SELECT k AS window_id, {'lo' if anchored else moved} AS a, {moved} + INTERVAL 24 MONTH AS b, {moved} + INTERVAL 36 MONTH AS c
  FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM rets), (SELECT unnest(range(0, 200)) AS k) WHERE {moved} + INTERVAL 36 MONTH <= hi"""


def _wf_sql(recompute: bool, tail: str, anchored: bool = False, end: str = "<=") -> str:
    key = "symbol, window_id" if recompute else "symbol"
    sig = f"close / lag(close, 4) OVER (PARTITION BY {key} ORDER BY ts) - 1"
    first = f"s AS (SELECT r.*, window_id, b, c FROM rets r JOIN wins ON r.ts >= a AND r.ts {end} c), x AS (SELECT *, {sig} AS sig FROM s)"
    if not recompute:
        first = f"s AS (SELECT *, {sig} AS sig FROM rets), x AS (SELECT s.*, window_id, b, c FROM s JOIN wins ON s.ts >= a AND s.ts {end} c)"
    return f"""WITH {RETS_SQL}, wins AS ({_wins_sql(anchored)}), {first},
q AS (SELECT *, CASE WHEN ts >= b THEN 'test' ELSE 'train' END AS part FROM x),
h AS (SELECT *, CASE WHEN lag(sig) OVER w > 0 THEN coalesce(ret, 0) ELSE 0 END AS hr FROM q WINDOW w AS (PARTITION BY symbol, window_id, part ORDER BY ts)),
nv AS (SELECT symbol, window_id, part, ts, product(1 + hr) OVER (PARTITION BY symbol, window_id, part ORDER BY ts) AS nav FROM h), {_MET.format(by='symbol, window_id, part')},
wf AS (SELECT symbol, window_id, part, n, coalesce((ann - 0.02) / nullif(vol, 0), 0) AS sharpe, ann, md FROM m WHERE n >= 30) {tail}"""


_WF = f"SELECT symbol, CAST(window_id AS INTEGER) AS window_id, part, n, {rsql('sharpe', 4)} AS sharpe, {rsql('ann')} AS annual_return, {rsql('least(md, 0.0)')} AS max_drawdown FROM wf"


def _wf(spark, path, recompute):
    b = rets(spark, path)
    return sw.walk_forward(b, b, ts_roc(col("close"), 4), sw.windows_of(b, *_SPLIT), recompute=recompute)


check("walk_forward_recomputed", _wf_sql(True, _WF))(lambda s, p: rounded(_wf(s, p, True), sharpe=4))
check("walk_forward_precomputed", _wf_sql(False, _WF))(lambda s, p: rounded(_wf(s, p, False), sharpe=4))
check("walk_forward_half_open", _wf_sql(True, _WF, end="<"))(lambda s, p: rounded((lambda b: sw.walk_forward(
    b, b, ts_roc(col("close"), 4), sw.windows_of(b, *_SPLIT), inclusive=False))(rets(s, p)), sharpe=4))
check("walk_forward_anchored", _wf_sql(True, _WF, True, "<"))(lambda s, p: rounded((lambda b: sw.walk_forward(
    b, b, ts_roc(col("close"), 4), sw.windows_of(b, *_SPLIT, anchored=True), inclusive=False))(rets(s, p)), sharpe=4))
check("walk_forward_summary", _wf_sql(True, f"""SELECT symbol, count(*) AS windows, {rsql('avg(sharpe)', 4)} AS mean_sharpe, {rsql('stddev_pop(sharpe)', 4)} AS sharpe_std,
  {rsql('greatest(0.0, 1 - stddev_pop(sharpe))', 4)} AS stability, count(*) FILTER (WHERE sharpe < 0) AS negative_count, {rsql('avg((sharpe > 0)::INT)', 4)} AS win_rate,
  {rsql('min(sharpe)', 4)} AS min_sharpe, {rsql('max(sharpe)', 4)} AS max_sharpe FROM wf WHERE part = 'test' GROUP BY symbol"""))(
    lambda s, p: rounded(sw.walk_forward_summary(_wf(s, p, True)), 4))
_REPORT = " UNION ALL ".join(f"SELECT symbol, part, '{n}' AS metric, {e} AS value FROM wf" for n, e in (
    ("sharpe", "sharpe"), ("annual_return", "ann"), ("max_drawdown", "least(md, 0.0)"), ("volatility", "vol")))
check("walk_forward_stability_report", _wf_sql(False, f"""SELECT symbol, part, metric, count(value) AS windows, {rsql('avg(value)', 4)} AS mean, {rsql('stddev_samp(value)', 4)} AS std
  FROM ({_REPORT}) GROUP BY 1, 2, 3 HAVING count(value) >= 2""").replace("nullif(vol, 0), 0) AS sharpe, ann, md FROM m", "nullif(vol, 0), 0) AS sharpe, ann, md, vol FROM m"))(
    lambda s, p: rounded((lambda b: sw.stability_report(sw.walk_forward(b, b, ts_roc(col("close"), 4), sw.windows_of(b, *_SPLIT), recompute=False, more=["volatility"]),
                                                        ["sharpe", "annual_return", "max_drawdown", "volatility"]))(rets(s, p)), 4))
check("walk_forward_overfit", _wf_sql(False, f"""SELECT symbol, {rsql("avg(sharpe) FILTER (WHERE part = 'test')", 4)} AS mean_test, {rsql("avg(sharpe) FILTER (WHERE part = 'train')", 4)} AS mean_train,
  {rsql("coalesce(avg(sharpe) FILTER (WHERE part = 'test') / nullif(stddev_samp(sharpe) FILTER (WHERE part = 'test'), 0), 0)", 4)} AS stability,
  {rsql("avg(sharpe) FILTER (WHERE part = 'train') - avg(sharpe) FILTER (WHERE part = 'test')", 4)} AS overfit,
  {rsql("avg(sharpe) FILTER (WHERE part = 'train') / avg(sharpe) FILTER (WHERE part = 'test')", 4)} AS overfit_ratio FROM wf GROUP BY symbol"""))(
    lambda s, p: rounded(sw.overfit_summary(_wf(s, p, False)), 4))
