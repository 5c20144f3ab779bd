"""Queries for single functions: one column per function on the weekly brand bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import PANEL_SQL, QUERIES, SQL, panel, rounded, rsql
from quantloom.checks.duck import DAY, P, feature_sql, last
from quantloom.functions import cross_section as cs
from quantloom.functions import indicators as ta
from quantloom.functions import regression as rg
from quantloom.functions import rolling as r
from quantloom.functions import scalar as sc
from quantloom.functions.feature import Feature, all_of, any_of, not_, where

X, Y, C, V, O, H, L, A = (col(k) for k in
                          ("x", "y", "close", "volume", "open", "high", "low", "amount"))
RET = col("returns")


def add(name: str, features: dict[str, Feature] | Feature, sql: str | None = "auto",
        digits: int = 6) -> None:
    """Register a query of features; ``sql`` is the select expression, or generated per function."""
    if isinstance(features, Feature):
        features = {"value": features}

    def run(spark, path):
        return rounded(with_features(panel(spark, path), features, keep=["symbol", "ts"]), digits)
    QUERIES[name] = run
    if sql == "auto":
        SQL[name] = feature_sql(features, PANEL_SQL, digits)
    elif sql is not None:
        SQL[name] = sql


def hand(expr: str, digits: int = 6, more: str = "") -> str:
    """Hand-written SQL for one value on the panel (``rn`` is the row number of the symbol)."""
    return (f"WITH {PANEL_SQL}, p AS (SELECT *, row_number() OVER ({P}) AS rn FROM t0){more}\n"
            f"SELECT symbol, ts, {rsql(expr, digits)} AS value FROM p")


# -- scalar operators and math -------------------------------------------------------------------------
add("op_arithmetic", {"add": X + Y, "sub": X - Y, "mul": X * Y, "div": X / (Y - 6.0),
                      "floordiv": X // Y, "mod": (X * -1.0) % Y, "pow": X ** 2, "neg": -X,
                      "div_zero": X / (Y - Y)})
add("op_compare", {"gt": X > Y, "ge": X >= 8.0, "lt": X < 8.0, "le": X <= Y, "eq": X.eq(X),
                   "ne": X.ne(Y), "not_x": not_(X > 8.0)})
add("op_logic", {"both": all_of(X > 8.0, Y > 6.0), "any_one": any_of(X > 8.0, Y > 6.0),
                 "choice": where(X > 8.0, Y, X), "band": (X > 7.0) & (Y > 5.0),
                 "bor": (X > 9.0) | (Y > 6.5)})
add("op_binary_names", {n: getattr(sc, f)(X, Y) for n, f in {
    "f_add": "add", "f_sub": "sub", "f_mul": "mul", "f_div": "div", "f_max": "max_", "f_min": "min_",
    "f_gt": "gt", "f_lt": "lt", "f_ge": "ge", "f_le": "le", "f_eq": "eq", "f_ne": "ne",
    "f_and": "and_", "f_or": "or_"}.items()})
add("math_functions", {n: getattr(sc, f)(X - 8.0) for n, f in {
    "f_abs": "abs_", "f_log": "log", "f_sqrt": "sqrt", "f_sign": "sign", "f_exp": "exp",
    "f_tanh": "tanh", "f_sigmoid": "sigmoid", "f_relu": "relu", "f_neg": "neg", "f_sin": "sin",
    "f_cos": "cos", "f_gauss": "gauss", "f_p4": "p4", "f_softsign": "softsign",
    "f_square_sigmoid": "square_sigmoid", "f_square": "square",
    "f_signed_power": "signed_power"}.items()})
add("cleanup_missing_to_zero", sc.coalesce0(X / r.ts_delay(Y, 3)))
add("logret", r.ts_logret(C))
add("old_sugar", {"ret_5": r.ts_delta(C, 5), "adv_20": r.ts_mean(V, 20), "intra_ret": (C - O) / O}, digits=9)

# -- rolling -------------------------------------------------------------------------------------------
for _f in (r.ts_mean, r.ts_std, r.ts_var, r.ts_sum, r.ts_max, r.ts_min, r.ts_median, r.ts_rank,
           r.ts_skew, r.ts_kurt, r.ts_argmax, r.ts_argmin, r.ts_zscore, r.ts_hump, r.ts_scale,
           r.ts_quantile, r.ts_decay_linear):
    add(_f.__name__, _f(X, 10))
for _f in (r.ts_delta, r.ts_delay, r.ts_roc):
    add(_f.__name__, _f(X, 5))
add("ts_product", r.ts_product(X / 8.0, 10))
add("ts_step", r.ts_step(X - 7.0, 5))
add("ts_av_diff", r.ts_av_diff(X, 10), hand(f"CASE WHEN rn >= 10 THEN x - avg(x) {last(10)} END"))
add("ts_corr", r.ts_corr(X, Y, 12), hand(f"CASE WHEN rn >= 12 AND count(x + y) {last(12)} >= 3 "
                                         f"THEN corr(x, y) {last(12)} END"))
add("ts_cov", r.ts_cov(X, Y, 12), hand(f"CASE WHEN rn >= 12 AND count(x + y) {last(12)} >= 3 "
                                       f"THEN covar_samp(x, y) {last(12)} END"))
add("ts_autocorr", r.ts_autocorr(X, 2, 20), f"""WITH {PANEL_SQL},
p AS (SELECT *, row_number() OVER ({P}) AS rn, lag(x, 2) OVER ({P}) AS x2 FROM t0)
SELECT symbol, ts, {rsql(f"CASE WHEN rn >= 20 AND count(x + x2) {last(20)} >= 3 THEN corr(x, x2) {last(20)} END")}
  AS value FROM p""")
add("ts_rolling_apply_range", r.rolling_apply(
    "value_range", X, 8, lambda v: F.array_max(v) - F.array_min(v)),
    hand(f"CASE WHEN rn >= 8 THEN max(x) {last(8)} - min(x) {last(8)} END"))
add("sma_offset", r.sma(X, 5, 3))
add("ts_sum_strict", r.ts_sum_strict(X, 5), hand(
    f"CASE WHEN rn >= 5 AND count(x) {last(5)} = 5 THEN sum(x) {last(5)} END"))
add("ts_rank_from_zero", r.ts_rank0(X, 10))
add("regbeta", rg.regbeta(X, Y, 15))

# -- macros --------------------------------------------------------------------------------------------
add("macro_beta", r.beta(X, Y, 20), hand(
    f"CASE WHEN rn >= 20 AND count(x + y) {last(20)} >= 3 THEN covar_samp(x, y) {last(20)} / "
    f"nullif(var_samp(y) {last(20)}, 0) END"))
add("macro_sharpe", r.sharpe(X, 20), hand(
    f"CASE WHEN rn >= 20 THEN avg(x) {last(20)} / nullif(stddev_samp(x) {last(20)}, 0) END"))
add("macro_info_ratio", r.info_ratio(X, Y, 20), hand(
    f"CASE WHEN rn >= 20 THEN avg(x - y) {last(20)} / nullif(stddev_samp(x - y) {last(20)}, 0) END"))
add("macro_ts_deviate", r.ts_deviate(X, 20), hand(
    f"CASE WHEN rn >= 20 THEN (x - avg(x) {last(20)}) / nullif(stddev_samp(x) {last(20)}, 0) END"))
add("macro_vol_price_corr", r.vol_price_corr(C, V, 10))

# -- expanding -----------------------------------------------------------------------------------------
for _f in (r.expanding_mean, r.expanding_median, r.expanding_std, r.expanding_zscore,
           r.expanding_rank):
    add(_f.__name__, _f(X))
add("expanding_percentile", r.expanding_percentile(X, 0.3))
add("expanding_percentile_linear", r.expanding_percentile_linear(X, 0.8))
add("expanding_mean_after_warmup", r.expanding_mean_after(X))
add("expanding_median_after_warmup", r.expanding_median_after(X))
add("expanding_max", r.expanding_max(X))

# -- cross-section -------------------------------------------------------------------------------------
for _f in (cs.cs_rank, cs.cs_zscore, cs.cs_scale, cs.cs_mean, cs.cs_normalize, cs.cs_rank0,
           cs.cs_zscore_unit):
    add(_f.__name__, _f(X))
add("cs_winsorize", cs.cs_winsorize(X, 1.0))
add("winsorize_population", cs.winsorize(X, 1.0))
add("cs_normalize_std", cs.cs_normalize(X, True))
add("cs_quantile", cs.cs_quantile(X, 0.3))
add("rank_panel_average", cs.cs_rank_average(V))
add("rank_panel_final", cs.rank_features({"plain": V - r.ts_delay(V, 1), "ranked": cs.cs_rank(X),
                                          "nested": r.ts_mean(cs.cs_rank(V), 5)}))
add("nested_cs_ts", r.ts_mean(cs.cs_rank(X), 5), f"""WITH {PANEL_SQL},
p AS (SELECT *, row_number() OVER ({P}) AS rn, CASE WHEN x IS NOT NULL THEN
  (1.0 + count(x) OVER (PARTITION BY ts ORDER BY x NULLS LAST RANGE UNBOUNDED PRECEDING EXCLUDE GROUP))
  / count(x) {DAY} END AS k FROM t0)
SELECT symbol, ts, {rsql(f"CASE WHEN rn >= 5 THEN avg(k) {last(5)} END")} AS value FROM p""")

# -- regression ----------------------------------------------------------------------------------------
_OK = f"rn >= 12 AND count(x + y) {last(12)} >= 3"
add("reg_slope", rg.reg_slope(Y, X, 12), hand(f"CASE WHEN {_OK} THEN regr_slope(y, x) {last(12)} END"))
add("reg_intercept", rg.reg_intercept(Y, X, 12), hand(
    f"CASE WHEN {_OK} THEN regr_intercept(y, x) {last(12)} END"))
add("reg_resid", rg.reg_resid(Y, X, 12), hand(
    f"CASE WHEN {_OK} THEN y - regr_intercept(y, x) {last(12)} - regr_slope(y, x) {last(12)} * x END"))
add("reg_predict", rg.reg_predict(Y, X, 12), hand(
    f"CASE WHEN {_OK} THEN regr_intercept(y, x) {last(12)} + regr_slope(y, x) {last(12)} * x END"))
add("reg_rsq", rg.reg_rsq(Y, X, 12), hand(f"CASE WHEN {_OK} THEN regr_r2(y, x) {last(12)} END"))
_T = f"rn >= 12 AND x IS NOT NULL AND count(x) {last(12)} >= 3"
_SL, _IC = f"regr_slope(x, rn) {last(12)}", f"regr_intercept(x, rn) {last(12)}"
add("ts_slope", rg.ts_slope(X, 12), hand(f"CASE WHEN {_T} THEN {_SL} END"))
add("ts_intercept", rg.ts_intercept(X, 12), hand(f"CASE WHEN {_T} THEN {_IC} + {_SL} * (rn - 11) END"))
add("ts_resid", rg.ts_resid(X, 12), hand(f"CASE WHEN {_T} THEN x - {_IC} - {_SL} * rn END"))
add("ts_predict", rg.ts_predict(X, 12), hand(f"CASE WHEN {_T} THEN {_IC} + {_SL} * rn END"))
add("ts_rsq", rg.ts_rsq(X, 12), hand(f"CASE WHEN {_T} THEN regr_r2(x, rn) {last(12)} END"))


def _ar_sql(p: int) -> str:
    """The residual from normal equations over the window, solved by elimination, one step a common table expression."""
    d, m = 3 * p + 5, p + 1
    lags = [f"lag(close, {k}) OVER ({P}) AS l{k}" for k in range(1, p + 1)]
    terms = ["1.0", *[f"l{k}" for k in range(1, p + 1)]]
    sums = [f"sum({terms[i]} * {terms[j] if j < m else 'close'}) {last(d)} AS a0_{i}_{j}" for i in range(m) for j in range(i, m + 1)]
    sql = f"""WITH {PANEL_SQL}, p0 AS (SELECT symbol, ts, row_number() OVER ({P}) AS rn, close, {', '.join(lags)} FROM t0),
e0 AS (SELECT *, count(close + {' + '.join(terms[1:])}) {last(d)} = {d} AS whole, {', '.join(sums)} FROM p0)"""
    for k in range(m - 1):  # only the upper triangle is kept: the matrix is symmetric
        step = [f"a{k}_{i}_{j} - a{k}_{k}_{i} / a{k}_{k}_{k} * a{k}_{k}_{j} AS a{k + 1}_{i}_{j}" for i in range(k + 1, m) for j in range(i, m + 1)]
        sql += f",\ne{k + 1} AS (SELECT *, {', '.join(step)} FROM e{k})"
    below = f"e{m - 1}"
    for i in reversed(range(m)):
        rest = "".join(f" - a{i}_{i}_{j} * b{j}" for j in range(i + 1, m))
        sql += f",\ns{i} AS (SELECT *, (a{i}_{i}_{m}{rest}) / a{i}_{i}_{i} AS b{i} FROM {below})"
        below = f"s{i}"
    fitted = " + ".join(f"b{i} * {terms[i]}" for i in range(m))
    return sql + f"\nSELECT symbol, ts, {rsql(f'CASE WHEN rn >= {d + p} AND whole THEN close - ({fitted}) END')} AS value FROM {below}"


add("ts_ar_resid", rg.ts_ar_resid(C, 3), _ar_sql(3))


# -- indicators ----------------------------------------------------------------------------------------
def recurrence_cte(name: str, src: str, x: str, a: float, b: float, rows: int, start: int = 0,
                   seed: str = "avg") -> str:
    """``S = a*S + b*x`` in closed form: weights of every earlier row (short series only)."""
    first = start + rows
    return f"""{name}_s AS (SELECT symbol, {seed}({x}) AS seed FROM {src}
  WHERE rn > {start} AND rn <= {first} GROUP BY symbol HAVING count({x}) = {rows}),
{name} AS (SELECT p.symbol, p.rn, any_value(s.seed) * pow({a!r}, p.rn - {first})
  + coalesce(sum({b!r} * pow({a!r}, p.rn - q.rn) * q.{x}), 0.0) AS v
  FROM {src} p JOIN {name}_s s ON s.symbol = p.symbol
  LEFT JOIN {src} q ON q.symbol = p.symbol AND q.rn > {first} AND q.rn <= p.rn
  WHERE p.rn >= {first} GROUP BY p.symbol, p.rn)"""


_PRE = f"""WITH {PANEL_SQL},
p0 AS (SELECT *, row_number() OVER ({P}) AS rn, lag(close) OVER ({P}) AS pc, lag(high) OVER ({P}) AS ph,
  lag(low) OVER ({P}) AS pl FROM t0),
p AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain,
  CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0.0) END AS loss,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN high - ph > 0 AND high - ph > pl - low THEN high - ph ELSE 0.0 END END AS pdm,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN pl - low > 0 AND pl - low > high - ph THEN pl - low ELSE 0.0 END END AS mdm
  FROM p0)"""


def smoothed(ctes: list[str], joins: list[str], expr: str, digits: int = 6) -> str:
    joined = " ".join(f"LEFT JOIN {j} ON {j}.symbol = p.symbol AND {j}.rn = p.rn" for j in joins)
    return (f"{_PRE},\n{', '.join(ctes)}\nSELECT p.symbol, p.ts, {rsql(expr, digits)} AS value "
            f"FROM p {joined}")


def _ema(name, src, x, n, start=0):
    k = 2.0 / (n + 1)
    return recurrence_cte(name, src, x, 1.0 - k, k, n, start)


def _wilder(name, src, x, n, start=0):
    return recurrence_cte(name, src, x, (n - 1) / n, 1.0 / n, n, start)


add("ema", ta.ema(C, 20), smoothed([_ema("e", "p", "close", 20)], ["e"], "e.v"))
add("wilder_smooth", ta.wilder_smooth(C, 14), smoothed([_wilder("e", "p", "close", 14)], ["e"], "e.v"))
add("sma_recursive", ta.sma_recursive(C, 9, 2), smoothed(
    [recurrence_cte("e", "p", "close", 1 - 2 / 9, 2 / 9, 9)], ["e"], "e.v"))
add("atr", ta.atr(H, L, C), smoothed([_wilder("e", "p", "tr", 14, 1)], ["e"], "e.v"))
add("natr", ta.natr(H, L, C), smoothed([_wilder("e", "p", "tr", 14, 1)], ["e"], "e.v / close * 100"))
add("rsi", ta.rsi(C), smoothed([_wilder("g", "p", "gain", 14, 1), _wilder("l", "p", "loss", 14, 1)],
                               ["g", "l"], "CASE WHEN g.v + l.v > 0 THEN (100 * g.v / (g.v + l.v) - 50) / 50 "
                               "WHEN g.v + l.v = 0 THEN -1.0 END"))
add("adx", ta.adx(H, L, C), smoothed(
    [recurrence_cte(n, "p", x, 1 - 1 / 14, 1.0, 13, 1, "sum") for n, x in
     (("a", "pdm"), ("b", "mdm"), ("t", "tr"))]
    + ["""dx AS (SELECT a.symbol, a.rn, CASE WHEN t.v > 0 AND a.v + b.v > 0 THEN 100 * abs(a.v - b.v) / (a.v + b.v)
  ELSE 0.0 END AS d FROM a JOIN b USING (symbol, rn) JOIN t USING (symbol, rn) WHERE rn > 14)""",
       _wilder("e", "dx", "d", 14, 14)], ["e"], "e.v"))
_DIF = [_ema("f", "p", "close", 12, 14), _ema("s", "p", "close", 26),
        "dif AS (SELECT f.symbol, f.rn, f.v - s.v AS d FROM f JOIN s USING (symbol, rn))",
        _ema("sig", "dif", "d", 9, 25)]
add("macd", ta.macd(C), smoothed(_DIF, ["dif", "sig"], "2 * (dif.d - sig.v)"))
add("dema", ta.dema(C, 10), smoothed([_ema("f", "p", "close", 10), _ema("s", "f", "v", 10, 9)],
                                     ["f", "s"], "2 * f.v - s.v"))
add("kama", ta.kama(C, 10), f"""WITH RECURSIVE {PANEL_SQL},
p0 AS (SELECT *, row_number() OVER ({P}) AS rn, abs(close - lag(close) OVER ({P})) AS step,
  abs(close - lag(close, 10) OVER ({P})) AS move FROM t0),
p1 AS (SELECT *, sum(step) {last(10)} AS path FROM p0),
p AS (SELECT *, pow(CASE WHEN path <= move OR path = 0 THEN 1.0 ELSE move / path END * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM p1),
k(symbol, rn, v) AS (SELECT symbol, rn, close FROM p WHERE rn = 10
  UNION ALL SELECT p.symbol, p.rn, k.v + p.sc * (p.close - k.v) FROM k JOIN p ON p.symbol = k.symbol AND p.rn = k.rn + 1)
SELECT p.symbol, p.ts, {rsql("CASE WHEN p.rn > 10 THEN k.v END")} AS value
FROM p LEFT JOIN k ON k.symbol = p.symbol AND k.rn = p.rn""")
add("atr_sma", ta.atr_sma(H, L, C), f"""WITH {PANEL_SQL},
p0 AS (SELECT *, row_number() OVER ({P}) AS rn, coalesce(lag(close) OVER ({P}), close) AS pc FROM t0),
p AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p0)
SELECT symbol, ts, {rsql(f"CASE WHEN rn >= 14 THEN avg(tr) {last(14)} END")} AS value FROM p""")


def _full(d: int, expr: str) -> str:
    return hand(f"CASE WHEN rn >= {d} AND count(x) {last(d)} = {d} THEN {expr.format(w=last(d))} END")


add("bb_width", ta.bb_width(X, 8), _full(8, "4 * stddev_pop(x) {w} / avg(x) {w}"))
add("stddev", ta.stddev(X, 8), _full(8, "stddev_pop(x) {w}"))
add("var", ta.var(X, 8), _full(8, "var_pop(x) {w}"))
add("tsf", ta.tsf(X, 7), _full(7, "regr_intercept(x, rn) {w} + regr_slope(x, rn) {w} * (rn + 1)"))
add("linearreg", ta.linearreg(X, 8), _full(8, "regr_intercept(x, rn) {w} + regr_slope(x, rn) {w} * rn"))
add("wma", ta.wma(X, 8), _full(8, "(sum(x * rn) {w} - (rn - 8) * sum(x) {w}) / 36.0"))
for _n, (_a, _b) in {"trima_odd": (3, 3), "trima_even": (3, 4)}.items():
    add(_n, ta.trima(X, _a + _b - 1), f"""WITH {PANEL_SQL}, p0 AS (SELECT *, row_number() OVER ({P}) AS rn FROM t0),
p AS (SELECT *, CASE WHEN rn >= {_a} AND count(x) {last(_a)} = {_a} THEN avg(x) {last(_a)} END AS m FROM p0)
SELECT symbol, ts, {rsql(f"CASE WHEN count(m) {last(_b)} = {_b} THEN avg(m) {last(_b)} END")} AS value FROM p""")
add("cci", ta.cci(H, L, C, 14), f"""WITH {PANEL_SQL},
p0 AS (SELECT *, row_number() OVER ({P}) AS rn, (high + low + close) / 3.0 AS tp FROM t0),
p AS (SELECT *, avg(tp) {last(14)} AS m, list(tp) {last(14)} AS vals FROM p0),
d AS (SELECT *, list_sum(list_transform(vals, lambda v: abs(v - m))) / 14 AS dev FROM p)
SELECT symbol, ts, {rsql("CASE WHEN rn >= 14 THEN CASE WHEN dev > 0 AND tp <> m THEN (tp - m) / (0.015 * dev) ELSE 0.0 END END")} AS value FROM d""")
add("hv", ta.hv(C, 20), f"""WITH {PANEL_SQL},
p0 AS (SELECT *, row_number() OVER ({P}) AS rn, lag(close) OVER ({P}) AS pc FROM t0),
p AS (SELECT *, CASE WHEN rn = 1 THEN 0.0 ELSE (close - pc) / CASE WHEN pc > 0 THEN pc ELSE 1.0 END END AS ret FROM p0)
SELECT symbol, ts, {rsql(f"CASE WHEN rn >= 20 THEN stddev_samp(ret) {last(20)} * sqrt(252.0) * 100 END")} AS value FROM p""")
add("vol_ratio", ta.vol_ratio(C, V), hand(
    f"CASE WHEN rn >= 20 AND avg(volume) {last(20)} > 0 THEN avg(volume) {last(5)} / avg(volume) {last(20)} END"))
add("amt_ratio", ta.amt_ratio(A), hand(
    f"CASE WHEN rn >= 20 AND avg(amount) {last(20)} > 0 THEN avg(amount) {last(5)} / avg(amount) {last(20)} END"))
