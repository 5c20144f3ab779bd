"""Portfolio, net-asset-value, metric and trade-log queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import RETS_SQL, WEEK_SQL, check, rets, rnd, rounded, rsql, table, week_bars
from quantloom.checks.validation import IC_SQL, pairs
from quantloom.functions.rolling import ts_roc
from quantloom.operators import nav as nv
from quantloom.operators import portfolio as pf
from quantloom.operators import trades as tr
from quantloom.operators.joins import common_dates
from quantloom.sources.store import materialize

O = "PARTITION BY symbol ORDER BY ts"
_S = f"""WITH {RETS_SQL}, sc0 AS (SELECT symbol, ts, close / lag(close, 4) OVER ({O}) - 1 AS mom, close, ret FROM rets),
sc AS (SELECT 'mom' AS strategy_id, symbol, ts, mom AS score FROM sc0 WHERE mom IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, ts ORDER BY score DESC, symbol) AS rank FROM sc),
d AS (SELECT DISTINCT ts FROM rets)"""
_REB = """, reb AS (SELECT max(ts) AS ts FROM d GROUP BY date_trunc('month', ts)),
w AS (SELECT strategy_id, ts, symbol, 1.0 / count(*) OVER (PARTITION BY strategy_id, ts) AS weight FROM rk WHERE rank <= 3 AND ts IN (SELECT ts FROM reb))"""
NAV_TAIL = """, rb AS (SELECT strategy_id, ts, row_number() OVER (PARTITION BY strategy_id ORDER BY ts) AS k FROM (SELECT DISTINCT strategy_id, ts FROM w)),
asof_ AS (SELECT s.strategy_id, d.ts, (SELECT max(rb.ts) FROM rb WHERE rb.strategy_id = s.strategy_id AND rb.ts < d.ts) AS rbt FROM d, (SELECT DISTINCT strategy_id FROM w) s),
dr AS (SELECT a.strategy_id, a.ts, coalesce(sum(w.weight * coalesce(r.ret, 0)), 0) AS ret FROM asof_ a LEFT JOIN w ON w.strategy_id = a.strategy_id AND w.ts = a.rbt
  LEFT JOIN rets r ON r.symbol = w.symbol AND r.ts = a.ts GROUP BY 1, 2),
wk AS (SELECT w.*, rb.k FROM w JOIN rb ON rb.strategy_id = w.strategy_id AND rb.ts = w.ts),
ch AS (SELECT coalesce(n.strategy_id, o.strategy_id) AS strategy_id, coalesce(n.k, o.k + 1) AS k, coalesce(n.weight, 0) - coalesce(o.weight, 0) AS dw
  FROM wk n FULL JOIN wk o ON n.strategy_id = o.strategy_id AND n.symbol = o.symbol AND n.k = o.k + 1),
mv AS (SELECT rb.strategy_id, rb.ts, rb.k, sum(greatest(-dw, 0)) AS sold, sum(greatest(dw, 0)) AS bought FROM ch JOIN rb ON rb.strategy_id = ch.strategy_id AND rb.k = ch.k GROUP BY 1, 2, 3),
nav AS (SELECT dr.strategy_id, dr.ts, dr.ret, product((1 + dr.ret) * coalesce({cost}, 1.0)) OVER (PARTITION BY dr.strategy_id ORDER BY dr.ts) AS nav
  FROM dr LEFT JOIN mv ON mv.strategy_id = dr.strategy_id AND mv.ts = dr.ts)"""
_COST = "CASE WHEN k = 1 THEN 1.0 ELSE 1 - sold * 0.0013 - bought * 0.0003 END"
NAV_SQL = _S + _REB + NAV_TAIL.format(cost=_COST)


def scores(spark, path, r=None):
    x = with_features(rets(spark, path) if r is None else r, {"score": ts_roc(col("close"), 4)}, keep=["symbol", "ts"])
    return x.withColumn("strategy_id", F.lit("mom"))


def monthly_weights(spark, path, r=None):
    r = rets(spark, path) if r is None else r
    s = scores(spark, path, r)
    dates = pf.rebalance_dates(r, "ME")
    return pf.equal_weights(pf.top_n(s.join(dates, "ts", "left_semi"), 3))


def rotation(spark, path, **kw):
    r = materialize(rets(spark, path), "returns")
    return pf.rotation_nav(monthly_weights(spark, path, r), r, commission=0.0003, stamp=0.001, **kw)


# -- calendars ---------------------------------------------------------------------------------------------
for _r, _sql in {"D": "SELECT ts FROM d", "W": "SELECT max(ts) AS ts FROM d GROUP BY date_trunc('week', ts)",
                 "ME": "SELECT max(ts) AS ts FROM d GROUP BY date_trunc('month', ts)",
                 "5D": "SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM d) WHERE i % 5 = 0"}.items():
    check(f"calendar_{_r.lower()}", f"WITH d AS (SELECT DISTINCT o_orderdate AS ts FROM orders) {_sql}")(
        lambda s, p, r=_r: pf.rebalance_dates(table(s, p, "orders").select(F.col("o_orderdate").alias("ts")), r))
for _r, (_u, _f) in {"W": ("week", "max"), "ME": ("month", "max"), "M": ("month", "min")}.items():
    check(f"calendar_fixed_{_r.lower()}", f"""WITH g AS (SELECT {_f}(o_orderdate) AS ts FROM orders GROUP BY date_trunc('{_u}', o_orderdate))
SELECT ts FROM g WHERE ts > (SELECT min(ts) FROM g)""")(
        lambda s, p, r=_r: pf.fixed_schedule(table(s, p, "orders").select(F.col("o_orderdate").alias("ts")), r))
check("calendar_interval", """SELECT ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT o_orderdate AS ts FROM orders)) WHERE i % 7 = 0""")(
    lambda s, p: pf.interval_schedule(table(s, p, "orders").select(F.col("o_orderdate").alias("ts")), 7))
check("calendar_recommended", """SELECT p_partkey, CASE WHEN p_size <= 5 THEN '5D' WHEN p_size <= 10 THEN 'W' WHEN p_size <= 22 THEN '10D' ELSE 'ME' END AS freq FROM part""")(
    lambda s, p: table(s, p, "part").select("p_partkey", pf.recommended_frequency(F.col("p_size")).alias("freq")))

# -- selection and weights -----------------------------------------------------------------------------------
check("top_n_per_date", f"{_S} SELECT strategy_id, ts, symbol, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 3")(
    lambda s, p: pf.top_n(scores(s, p), 3).select("strategy_id", "ts", "symbol", "rank"))
check("weights_equal", f"{_S}{_REB} SELECT strategy_id, ts, symbol, {rsql('weight')} AS weight FROM w")(
    lambda s, p: rounded(monthly_weights(s, p)))
check("weights_score", f"""{_S}, t AS (SELECT * FROM rk WHERE rank <= 5) SELECT strategy_id, ts, symbol, {rsql('''coalesce(greatest(score, 0) /
  nullif(sum(greatest(score, 0)) OVER (PARTITION BY strategy_id, ts), 0), 0)''')} AS weight FROM t""")(
    lambda s, p: rounded(pf.score_weights(pf.top_n(scores(s, p), 5))))


def _risk_sql(n: int) -> str:
    """Weights from the fixed point x = sqrt(x / (n C x)): two hundred rounds over the covariance lists of each date."""
    return f"""{_S.replace('WITH', 'WITH RECURSIVE', 1)}, reb AS (SELECT max(ts) AS ts FROM d GROUP BY date_trunc('month', ts)),
hs AS (SELECT symbol, ts, row_number() OVER ({O}) AS i, ret FROM rets), pk AS (SELECT rk.symbol, rk.ts, hs.i FROM rk JOIN hs USING (symbol, ts) WHERE rank <= {n} AND rk.ts IN (SELECT ts FROM reb)),
rr AS (SELECT pk.ts, pk.symbol, pk.i - hs.i AS back, hs.ret FROM pk JOIN hs ON hs.symbol = pk.symbol AND hs.i BETWEEN pk.i - 25 AND pk.i WHERE hs.ret IS NOT NULL),
ok AS (SELECT ts FROM (SELECT pk.ts, pk.symbol, count(rr.ret) AS c FROM pk LEFT JOIN rr ON rr.ts = pk.ts AND rr.symbol = pk.symbol GROUP BY 1, 2) GROUP BY 1 HAVING min(c) = 26 AND count(*) > 1),
cv AS (SELECT a.ts, a.symbol, b.symbol AS other, covar_samp(a.ret, b.ret) + CASE WHEN a.symbol = b.symbol THEN 1e-6 ELSE 0 END AS c FROM rr a JOIN rr b ON a.ts = b.ts AND a.back = b.back JOIN ok ON ok.ts = a.ts GROUP BY 1, 2, 3),
cl AS (SELECT ts, symbol, list(c ORDER BY other) AS c FROM cv GROUP BY 1, 2), cm AS (SELECT ts, list(symbol ORDER BY symbol) AS s, list(c ORDER BY symbol) AS c FROM cl GROUP BY 1),
it(k, ts, x) AS (SELECT 0, ts, list_transform(range(1, len(s) + 1), lambda i: 1 / sqrt(c[i][i])) FROM cm
  UNION ALL SELECT k + 1, it.ts, list_transform(range(1, len(x) + 1), lambda i: sqrt(x[i] / (len(x) * list_dot_product(cm.c[i], x)))) FROM it JOIN cm ON cm.ts = it.ts WHERE k < 200),
w AS (SELECT it.ts, unnest(s) AS symbol, unnest(list_transform(x, lambda v: v / list_sum(x))) AS weight FROM it JOIN cm ON cm.ts = it.ts WHERE k = 200)
SELECT 'mom' AS strategy_id, pk.ts, pk.symbol, {rsql('coalesce(w.weight, 1.0 / count(*) OVER (PARTITION BY pk.ts))')} AS weight, 0e0 AS residual FROM pk LEFT JOIN w ON w.ts = pk.ts AND w.symbol = pk.symbol"""


def _risk_parity(n):
    def run(spark, path):
        s = scores(spark, path)
        dates = pf.rebalance_dates(rets(spark, path), "ME")
        return rounded(pf.risk_parity_weights(pf.top_n(s.join(dates, "ts", "left_semi"), n), rets(spark, path), 26, residual=True), residual=9)
    return run


check("weights_risk_parity", _risk_sql(4))(_risk_parity(4))
# two assets: weights in proportion to 1 / deviation, whatever the correlation
check("weights_risk_parity_pair", f"""{_S}, reb AS (SELECT max(ts) AS ts FROM d GROUP BY date_trunc('month', ts)),
hs AS (SELECT symbol, ts, CASE WHEN count(ret) OVER w = 26 THEN 1 / sqrt(var_samp(ret) OVER w + 1e-6) END AS x FROM rets WINDOW w AS ({O} ROWS 25 PRECEDING)),
pk AS (SELECT rk.symbol, rk.ts, x, count(x) OVER (PARTITION BY rk.ts) AS c, count(*) OVER (PARTITION BY rk.ts) AS n FROM rk JOIN hs USING (symbol, ts) WHERE rank <= 2 AND rk.ts IN (SELECT ts FROM reb))
SELECT 'mom' AS strategy_id, ts, symbol, {rsql('CASE WHEN c = n THEN x / sum(x) OVER (PARTITION BY ts) ELSE 1.0 / n END')} AS weight, 0e0 AS residual FROM pk""")(_risk_parity(2))


@check("weights_rank_buffer", _S.replace("WITH", "WITH RECURSIVE", 1) + """, reb AS (SELECT max(ts) AS ts FROM d GROUP BY date_trunc('month', ts)),
c AS (SELECT ts, list(symbol ORDER BY rank) FILTER (WHERE rank <= 6) AS buf, list(symbol ORDER BY rank) FILTER (WHERE rank <= 3) AS top,
  row_number() OVER (ORDER BY ts) AS k FROM rk WHERE ts IN (SELECT ts FROM reb) GROUP BY ts),
h(k, ts, held) AS (SELECT k, ts, top FROM c WHERE k = 1 UNION ALL
  SELECT c.k, c.ts, list_concat(list_filter(h.held, lambda s: list_contains(c.buf, s)),
    list_filter(c.top, lambda s: NOT list_contains(h.held, s))[1:(3 - len(list_filter(h.held, lambda s: list_contains(c.buf, s))))])
  FROM h JOIN c ON c.k = h.k + 1)
SELECT 'mom' AS strategy_id, ts, unnest(held) AS symbol, """ + rsql("1.0 / len(held)") + " AS weight FROM h")
def _(spark, path):
    return rounded(pf.buffered_targets(scores(spark, path), pf.rebalance_dates(rets(spark, path), "ME"), 3, 3))


def _factors(spark, path):
    return pairs(spark, path)


check("combine_factors_mean", f"{IC_SQL} SELECT ts, symbol, {rsql('avg(value)')} AS score FROM pairs GROUP BY 1, 2")(
    lambda s, p: rounded(pf.combine_factors(_factors(s, p))))
check("combine_factors_fixed", f"""{IC_SQL} SELECT ts, symbol, {rsql("sum(value * CASE factor_id WHEN 'mom' THEN 0.5 WHEN 'vol' THEN 0.2 ELSE 0.3 END)")} AS score FROM pairs GROUP BY 1, 2""")(
    lambda s, p: rounded(pf.combine_factors(_factors(s, p), {"mom": 5.0, "vol": 2.0, "level": 3.0})))
_ICW = f"""{IC_SQL}, m AS (SELECT factor_id, ts, CASE WHEN count(ic) OVER w >= 24 THEN greatest(avg(ic) OVER w, 0) ELSE 0 END AS m FROM ic
  WINDOW w AS (PARTITION BY factor_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND {{lag}})),
iw AS (SELECT factor_id, ts, CASE WHEN sum(m) OVER (PARTITION BY ts) > 0 THEN m / sum(m) OVER (PARTITION BY ts) ELSE 1.0 / count(*) OVER (PARTITION BY ts) END AS weight FROM m)"""
check("combine_weights_by_ic", _ICW.format(lag="CURRENT ROW") + f" SELECT factor_id, ts, {rsql('weight')} AS weight FROM iw")(
    lambda s, p: rounded(pf.ic_weights(pairs(s, p), 24)))
check("combine_by_ic", _ICW.format(lag="1 PRECEDING") + f" SELECT ts, symbol, {rsql('sum(value * weight)')} AS score FROM pairs JOIN iw USING (factor_id, ts) GROUP BY 1, 2")(
    lambda s, p: rounded(pf.combine_by_ic(pairs(s, p), pf.ic_weights(pairs(s, p), 24, lag=1))))

# -- net asset value -----------------------------------------------------------------------------------------
check("weight_changes", f"{NAV_SQL} SELECT strategy_id, ts, {rsql('sold')} AS sold, {rsql('bought')} AS bought FROM mv")(
    lambda s, p: rounded(pf.weight_changes(monthly_weights(s, p)).select("strategy_id", "ts", "sold", "bought")))
check("rotation_nav", f"{NAV_SQL} SELECT strategy_id, ts, {rsql('ret')} AS ret, {rsql('nav')} AS nav FROM nav")(
    lambda s, p: rounded(rotation(s, p)))
check("style_nav_costs", _S + _REB + NAV_TAIL.format(cost="(1 - (sold + bought) / 2 * 0.0003) * (1 - (sold + bought) / 2 * 0.001)")
      + f" SELECT strategy_id, ts, {rsql('nav')} AS nav FROM nav")(
    lambda s, p: rounded(rotation(s, p, style_costs=True).drop("ret")))
check("signal_nav", f"""WITH {RETS_SQL}, s AS (SELECT *, CASE WHEN abs(lag(close, 4) OVER ({O})) > 0 THEN close / lag(close, 4) OVER ({O}) - 1 END AS sig FROM rets),
h AS (SELECT *, CASE WHEN lag(sig) OVER ({O}) > 0 THEN coalesce(ret, 0) ELSE 0 END AS r FROM s)
SELECT symbol, ts, {rsql(f'product(1 + r) OVER ({O})')} AS nav FROM h""")(
    lambda s, p: rounded(pf.signal_nav(scores(s, p).withColumnRenamed("score", "signal"), rets(s, p))))
check("buy_and_hold_nav", f"WITH bars AS ({WEEK_SQL}) SELECT symbol, ts, {rsql(f'close / first_value(close) OVER ({O})')} AS nav FROM bars")(
    lambda s, p: rounded(pf.buy_and_hold(week_bars(s, p))))

# -- styles ----------------------------------------------------------------------------------------------------
_STY = f"""WITH bars AS ({WEEK_SQL}), st AS (SELECT 'mom' AS style, 0.5 AS cw, 2 AS n UNION ALL SELECT 'size', 0.3, 3 UNION ALL SELECT 'low', 0.2, 4),
ss AS (SELECT 'mom' AS style, symbol, ts, close / lag(close, 4) OVER ({O}) - 1 AS score FROM bars UNION ALL SELECT 'size', symbol, ts, amount FROM bars
  UNION ALL SELECT 'low', symbol, ts, -close FROM bars),
pk AS (SELECT * FROM (SELECT ss.*, st.cw, st.n, row_number() OVER (PARTITION BY ss.style, ts ORDER BY score DESC, symbol) AS rank FROM ss JOIN st USING (style) WHERE score IS NOT NULL) WHERE rank <= n)"""
STYLES = ["mom", "size", "low"]


def picks(spark, path):
    b = with_features(week_bars(spark, path), {"m": ts_roc(col("close"), 4)}, keep=["symbol", "ts", "close", "amount"])
    s = [F.struct(F.lit(n).alias("style"), v.alias("score")) for n, v in
         (("mom", F.col("m")), ("size", F.col("amount")), ("low", -F.col("close")))]
    long = b.select("symbol", "ts", F.explode(F.array(*s)).alias("s")).select("symbol", "ts", "s.*")
    styles = spark.createDataFrame([("mom", 0.5, 2), ("size", 0.3, 3), ("low", 0.2, 4)], "style string, capital_weight double, top_n int")
    return pf.style_picks(long, styles)


check("style_picks", f"{_STY} SELECT style, ts, symbol FROM pk")(lambda s, p: picks(s, p).select("style", "ts", "symbol"))
check("style_composition", f"""{_STY} SELECT ts, symbol, {rsql('sum(w)')} AS weight, array_to_string(list_sort(list(style)), ',') AS styles FROM
  (SELECT *, cw / count(*) OVER (PARTITION BY style, ts) AS w FROM pk) GROUP BY 1, 2""")(
    lambda s, p: rounded(pf.compose_styles(picks(s, p)).withColumn("styles", F.concat_ws(",", "styles"))))
check("style_overlap", f"""{_STY}, n AS (SELECT style, ts, count(*) AS n FROM pk GROUP BY 1, 2), pr AS (SELECT * FROM (VALUES ('mom', 'size'), ('mom', 'low'), ('size', 'low')) t(style_a, style_b)),
dd AS (SELECT DISTINCT ts FROM pk)
SELECT style_a, style_b, {rsql('''avg((SELECT count(*) FROM pk a JOIN pk b ON a.symbol = b.symbol AND a.ts = b.ts WHERE a.style = style_a AND b.style = style_b AND a.ts = dd.ts) * 1.0
  / greatest((SELECT max(n) FROM n WHERE style = style_a AND n.ts = dd.ts), (SELECT max(n) FROM n WHERE style = style_b AND n.ts = dd.ts)))''')} AS overlap FROM pr, dd GROUP BY 1, 2""")(
    lambda s, p: rounded(pf.style_overlap(picks(s, p), STYLES)))
check("style_picks_matrix", f"""{_STY} SELECT ts, symbol, bool_or(style = 'mom') AS mom, bool_or(style = 'size') AS size, bool_or(style = 'low') AS low FROM pk GROUP BY 1, 2""")(
    lambda s, p: pf.picks_matrix(picks(s, p), STYLES))
check("style_common_dates", f"{_STY} SELECT ts FROM pk GROUP BY ts HAVING count(DISTINCT style) = 3")(
    lambda s, p: common_dates(picks(s, p), "style"))
check("signal_correlation", f"""WITH bars AS ({WEEK_SQL}), l AS (SELECT unnest(['close', 'volume', 'amount']) AS name), v AS (SELECT row_number() OVER () AS i, close, volume, amount FROM bars),
u AS (SELECT i, 'close' AS name, close AS v FROM v UNION ALL SELECT i, 'volume', volume FROM v UNION ALL SELECT i, 'amount', amount FROM v)
SELECT a.name AS a, b.name AS b, {rsql('corr(a.v, b.v)', 3)} AS corr FROM u a JOIN u b ON a.i = b.i GROUP BY 1, 2""")(
    lambda s, p: rounded(pf.signal_correlation(week_bars(s, p), ["close", "volume", "amount"])))

# -- metrics ------------------------------------------------------------------------------------------------
# one net asset value per symbol: continuous holding under small returns
_NV = f"""WITH {RETS_SQL}, nav AS (SELECT symbol AS strategy_id, ts, product(1 + coalesce(ret, 0)) OVER ({O}) AS nav FROM rets),
n0 AS (SELECT *, row_number() OVER w AS rn, nav / lag(nav) OVER w - 1 AS r, max(nav) OVER (PARTITION BY strategy_id ORDER BY ts) AS peak FROM nav WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)),
n1 AS (SELECT *, nav / peak - 1 AS dd, row_number() OVER (PARTITION BY strategy_id ORDER BY r NULLS LAST, ts) AS k, count(r) OVER (PARTITION BY strategy_id) AS nr FROM n0),
tr AS (SELECT strategy_id, arg_min(rn, row(dd, rn)) AS trn, arg_min(ts, row(dd, rn)) AS trough_ts, min(dd) AS mdd, arg_min(peak, row(dd, rn)) AS pk FROM n1 GROUP BY 1 HAVING min(dd) < 0),
ddn AS (SELECT n1.strategy_id, any_value(mdd) AS max_drawdown, min(ts) FILTER (WHERE nav = pk AND rn <= trn) AS peak_ts, any_value(trough_ts) AS trough_ts,
  any_value(trn) - min(rn) FILTER (WHERE nav = pk AND rn <= trn) AS drawdown_rows, min(rn) FILTER (WHERE rn > trn AND nav >= pk) - any_value(trn) AS recovery_rows
  FROM n1 JOIN tr USING (strategy_id) GROUP BY 1),
m0 AS (SELECT strategy_id, count(*) AS n, arg_max(nav, ts) / arg_min(nav, ts) - 1 AS total, stddev_samp(r) * sqrt(252.0) AS vol, -quantile_cont(r, 0.05) AS var,
  -avg(r) FILTER (WHERE r IS NOT NULL AND k <= greatest(1, floor(nr * 0.05 + 1e-12))) AS cvar, sqrt(avg(pow(dd * 100, 2))) AS ulcer,
  sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END)) * sqrt(252.0) AS down FROM n1 GROUP BY 1),
m1 AS (SELECT *, pow(1 + total, 252.0 / (n - 1)) - 1 AS ann FROM m0),
m AS (SELECT * FROM m1 LEFT JOIN ddn USING (strategy_id))"""


def symbol_nav(spark, path):
    r = rets(spark, path)
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    return r.select(F.col("symbol").alias("strategy_id"), "ts", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w).alias("nav"))


check("nav_metrics", f"""{_NV} SELECT strategy_id, n, {rsql('total')} AS total_return, {rsql('ann')} AS annual_return, {rsql('vol')} AS volatility, {rsql('(ann - 0.02) / vol')} AS sharpe,
  {rsql('var')} AS var, {rsql('cvar')} AS cvar, {rsql('ulcer')} AS ulcer, {rsql("CASE WHEN down > 0 THEN (ann - 0.02) / down ELSE 'inf'::DOUBLE END")} AS sortino,
  {rsql('(ann - 0.02) / (ulcer / 100)')} AS upi, {rsql('ann / abs(max_drawdown)')} AS calmar FROM m""")(
    lambda s, p: rounded(nv.metrics(symbol_nav(s, p)).drop("max_drawdown", "peak_ts", "trough_ts", "drawdown_rows", "recovery_rows")))
check("nav_drawdown", f"""{_NV} SELECT strategy_id, {rsql('max_drawdown')} AS max_drawdown, peak_ts, trough_ts, CAST(drawdown_rows AS DOUBLE) AS drawdown_rows,
  CAST(recovery_rows AS DOUBLE) AS recovery_rows FROM m""")(
    lambda s, p: rounded(nv.drawdowns(symbol_nav(s, p)).withColumns({c: F.col(c).cast("double") for c in ("drawdown_rows", "recovery_rows")})))
check("nav_metric_rows", f"""{_NV} SELECT strategy_id, 'total_return' AS name, {rsql('total')} AS value, 'return' AS "group", 'percent' AS format, 1 AS "order" FROM m
  UNION ALL SELECT strategy_id, 'volatility', {rsql('vol')}, 'risk', 'percent', 3 FROM m UNION ALL SELECT strategy_id, 'sharpe', {rsql('(ann - 0.02) / vol')}, 'ratio', 'number', 4 FROM m""")(
    lambda s, p: rounded(nv.metric_rows(nv.metrics(symbol_nav(s, p))).filter(F.col("name").isin("total_return", "volatility", "sharpe")).drop("text")))


@check("nav_period_slice", f"""{_NV}, e AS (SELECT strategy_id, max(ts) AS e FROM nav GROUP BY 1), b AS (SELECT strategy_id, max(ts) AS b FROM nav JOIN e USING (strategy_id) WHERE ts < e - INTERVAL 6 MONTH GROUP BY 1)
SELECT strategy_id, ts, {rsql('nav')} AS nav FROM nav JOIN b USING (strategy_id) WHERE ts >= b""")
def _(spark, path):
    return rounded(nv.period_slice(symbol_nav(spark, path), "6m"))


check("nav_period_returns", f"""{_NV}, e AS (SELECT strategy_id, max(ts) AS e, arg_max(nav, ts) AS l, arg_min(nav, ts) AS f FROM nav GROUP BY 1)
SELECT strategy_id, {', '.join(rsql(f"any_value(l) / coalesce(arg_max(nav, ts) FILTER (WHERE ts < e - INTERVAL {n} MONTH), any_value(f)) - 1") + f' AS ret_{p}' for p, n in (('1m', 1), ('3m', 3), ('1y', 12)))}
FROM nav JOIN e USING (strategy_id) GROUP BY 1""")(lambda s, p: rounded(nv.period_returns(symbol_nav(s, p))))
check("nav_against_benchmark", f"""{_NV}, bn AS (SELECT ts, avg(nav) AS bnav FROM nav GROUP BY ts),
j AS (SELECT nav.*, bnav, nav / lag(nav) OVER w - 1 - (bnav / lag(bnav) OVER w - 1) AS dlt FROM nav JOIN bn USING (ts) WINDOW w AS (PARTITION BY strategy_id ORDER BY ts)),
a AS (SELECT strategy_id, count(*) AS n, (arg_max(nav, ts) / arg_min(nav, ts)) / (arg_max(bnav, ts) / arg_min(bnav, ts)) - 1 AS ex, stddev_pop(dlt) * sqrt(252.0) AS te, avg((dlt > 0)::INT) AS win FROM j GROUP BY 1)
SELECT strategy_id, n, {rsql('ex')} AS excess, {rsql('te')} AS tracking_error, {rsql('win')} AS win_rate, {rsql('pow(1 + ex, 252.0 / (n - 1)) - 1')} AS annual_excess,
  {rsql('(pow(1 + ex, 252.0 / (n - 1)) - 1) / te')} AS information_ratio FROM a""")(
    lambda s, p: (lambda n: rounded(nv.against_benchmark(n, n.groupBy("ts").agg(F.avg("nav").alias("nav")))))(symbol_nav(s, p)))
check("nav_yearly_report", f"""{_NV}, y AS (SELECT *, CAST(year(ts) AS INTEGER) AS year FROM nav), y0 AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, max(nav) OVER w AS pk FROM y WINDOW w AS (PARTITION BY strategy_id, year ORDER BY ts)),
g AS (SELECT strategy_id, year, count(*) AS n, arg_max(nav, ts) / arg_min(nav, ts) - 1 AS t, stddev_samp(r) * sqrt(252.0) AS v, min(nav / pk - 1) AS md FROM y0 GROUP BY 1, 2)
SELECT strategy_id, year, {rsql('t')} AS total_return, {rsql('v')} AS volatility, {rsql('(pow(1 + t, 252.0 / (n - 1)) - 1 - 0.02) / v')} AS sharpe, {rsql('CASE WHEN md < 0 THEN md END')} AS max_drawdown FROM g""")(
    lambda s, p: rounded(nv.yearly_report(symbol_nav(s, p))))
check("nav_last_per_day", """SELECT event_type AS strategy_id, CAST(ts AS DATE) AS d, arg_max(value, ts) AS nav FROM events GROUP BY 1, 2""")(
    lambda s, p: nv.last_per_day(table(s, p, "events").select(F.col("event_type").alias("strategy_id"), F.col("ts").alias("created_at"), F.col("value").alias("nav"))))


@check("holding_ratio", """WITH s AS (SELECT event_type AS strategy_id, CAST(ts AS DATE) AS d, arg_max(value, ts) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY d) AS rn FROM s)
SELECT strategy_id, """ + rsql("avg((v > 20)::INT)") + " AS holding_ratio FROM k WHERE rn > 1 GROUP BY 1")
def _(spark, path):
    e = table(spark, path, "events")
    pos = F.create_map(F.lit("A"), F.struct(F.greatest(F.col("value") - 20, F.lit(0.0)).alias("volume")))
    return rounded(nv.holding_ratio(e.select(F.col("event_type").alias("strategy_id"), F.col("ts").alias("created_at"), pos.alias("positions"))))


# -- trades ---------------------------------------------------------------------------------------------------
def trade_log(spark, path):
    """Orders as fills: alternate lots bought and sold in full, per priority."""
    o = table(spark, path, "orders")
    w = W.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    i = F.row_number().over(w)
    return o.select(
        F.lit("acct").alias("account"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("seq"), F.when(i % 3 == 0, 2).otherwise(1).alias("side"),
        F.when(i % 3 == 0, 20.0).otherwise(10.0).alias("volume"), (F.col("o_totalprice") / 1009).alias("price"), F.lit(5.0).alias("fee"))


_T = f"""WITH t0 AS (SELECT 'acct' AS account, o_orderpriority AS symbol, o_orderdate AS created_at, o_orderkey AS seq, o_totalprice / 1009 AS price,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
t AS (SELECT *, CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS side, CASE WHEN i % 3 = 0 THEN 20.0 ELSE 10.0 END AS volume FROM t0),
g AS (SELECT account, symbol, (i - 1) // 3 AS g, min(created_at) FILTER (WHERE i % 3 = 1) AS open_time, max(created_at) FILTER (WHERE side = 2) AS close_time,
  max(price) FILTER (WHERE i % 3 = 1) AS open_price, max(price) FILTER (WHERE side = 2) AS close_price,
  sum(price * 10) FILTER (WHERE side = 1) + 10 AS cost, count(*) AS c FROM t GROUP BY 1, 2, 3),
rt AS (SELECT *, 20 * close_price - cost - 5 AS profit FROM g WHERE c = 3)"""
check("trade_round_trips", f"""{_T} SELECT account, symbol, open_time, close_time, {rsql('open_price')} AS open_price, {rsql('close_price')} AS close_price, 20.0::DOUBLE AS volume,
  5.0::DOUBLE AS open_fee, 5.0::DOUBLE AS close_fee, {rsql('profit')} AS profit FROM rt""")(
    lambda s, p: rounded(tr.round_trips(trade_log(s, p))))
_LOTS = {1: 10, 2: 10, 3: -5, 4: 5, 5: -20, 6: -4, 7: 8}  # bought or sold at each place of a cycle of nine


def mixed_log(spark, path):
    """Orders as fills of several accounts: partial sells, sells while flat, and (account O) sells beyond the position."""
    o = table(spark, path, "orders")
    i = F.row_number().over(W.partitionBy("o_orderstatus", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")) % 9
    over = F.col("o_orderstatus") == "O"
    lots = F.coalesce(*[F.when(i == k, v) for k, v in _LOTS.items()], F.when(i == 8, F.when(over, -11).otherwise(-8)), F.when(over, 3).otherwise(-3))
    return o.select(F.col("o_orderstatus").alias("account"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderkey").alias("seq"), F.when(lots > 0, 1).otherwise(2).alias("side"), F.abs(lots).cast("double").alias("volume"),
                    (F.col("o_totalprice") / 1009).alias("price"), F.lit(5.0).alias("fee"))


check("trade_round_trips_partial", f"""WITH RECURSIVE m0 AS (SELECT o_orderstatus AS account, o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS tm, o_totalprice / 1009 AS price,
  row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
m1 AS (SELECT *, CASE i % 9 {' '.join(f'WHEN {k} THEN {v}' for k, v in _LOTS.items())} WHEN 8 THEN CASE WHEN account = 'O' THEN -11 ELSE -8 END ELSE CASE WHEN account = 'O' THEN 3 ELSE -3 END END AS lots FROM m0),
m AS (SELECT *, CASE WHEN lots > 0 THEN 1 ELSE 2 END AS side, abs(lots)::DOUBLE AS q FROM m1),
f(account, symbol, i, tm, side, q, price, v0, c0, f0, t0, p0, v1, c1, f1, t1, p1) AS (
  SELECT account, symbol, i, tm, side, q, price, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::TIMESTAMP, NULL::DOUBLE,
    CASE WHEN side = 1 THEN q ELSE 0e0 END, CASE WHEN side = 1 THEN q * price + 5 ELSE 0e0 END, CASE WHEN side = 1 THEN 5e0 ELSE 0e0 END,
    CASE WHEN side = 1 THEN tm END, CASE WHEN side = 1 THEN price END FROM m WHERE i = 1
  UNION ALL SELECT n.account, n.symbol, n.i, n.tm, n.side, n.q, n.price, v1, c1, f1, t1, p1,
    CASE WHEN n.side = 1 THEN v1 + n.q WHEN v1 <> 0 THEN v1 - n.q ELSE v1 END, CASE WHEN n.side = 1 THEN c1 + n.q * n.price + 5 WHEN v1 <> 0 THEN c1 - n.q / v1 * c1 ELSE c1 END,
    CASE WHEN n.side = 1 THEN CASE WHEN t1 IS NULL THEN f1 + 5 ELSE f1 END WHEN v1 = n.q THEN 0e0 WHEN v1 <> 0 THEN f1 - n.q / v1 * f1 ELSE f1 END,
    CASE WHEN n.side = 1 THEN coalesce(t1, n.tm) WHEN v1 = n.q THEN NULL ELSE t1 END, CASE WHEN n.side = 1 THEN CASE WHEN t1 IS NULL THEN n.price ELSE p1 END ELSE p1 END
  FROM f JOIN m n ON n.account = f.account AND n.symbol = f.symbol AND n.i = f.i + 1)
SELECT account, symbol, t0 AS open_time, tm AS close_time, {rsql('p0')} AS open_price, {rsql('price')} AS close_price, q AS volume, {rsql('q / v0 * f0')} AS open_fee,
  5.0::DOUBLE AS close_fee, {rsql('q * price - q / v0 * c0 - 5')} AS profit FROM f WHERE side = 2 AND v0 <> 0""")(
    lambda s, p: rounded(tr.round_trips(mixed_log(s, p))))
check("trade_stats", f"""{_T}, a AS (SELECT account, count(*) AS trips, avg((profit > 0)::INT) AS win, avg(profit) FILTER (WHERE profit > 0) AS ap, avg(profit) FILTER (WHERE profit < 0) AS al,
  avg(profit / (20 * open_price)) FILTER (WHERE profit > 0) AS app, avg(profit / (20 * open_price)) FILTER (WHERE profit < 0) AS alp, avg(date_diff('day', open_time, close_time)) AS hd FROM rt GROUP BY 1)
SELECT account, trips, {rsql('win')} AS win_rate, {rsql('ap')} AS avg_profit, {rsql('al')} AS avg_loss, {rsql('app')} AS avg_profit_pct, {rsql('alp')} AS avg_loss_pct, {rsql('hd')} AS holding_days,
  {rsql('abs(ap / al)')} AS profit_loss_ratio, {rsql('win - (1 - win) / abs(ap / al)')} AS kelly, {rsql('(win - (1 - win) / abs(ap / al)) / 2')} AS half_kelly FROM a""")(
    lambda s, p: rounded(tr.trip_stats(tr.round_trips(trade_log(s, p)))))
for _w in (True, False):
    check(f"trade_top_{'winners' if _w else 'losers'}", f"{_T} SELECT symbol, close_time, {rsql('profit')} AS profit FROM rt WHERE profit {'>' if _w else '<'} 0 ORDER BY profit {'DESC' if _w else 'ASC'}, symbol, close_time LIMIT 10")(
        lambda s, p, w=_w: rounded(tr.top_trips(tr.round_trips(trade_log(s, p)), 10, w).select("symbol", "close_time", "profit")))
check("trades_in_range", f"{_T} SELECT symbol, seq FROM t WHERE created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")(
    lambda s, p: tr.in_range(trade_log(s, p), "1996-01-01", "1996-12-31").select("symbol", "seq"))
check("trade_positions", f"""{_T} SELECT symbol, seq, CAST(sum(CASE WHEN side = 1 THEN volume ELSE -volume END) OVER (PARTITION BY symbol ORDER BY created_at, seq) AS DOUBLE) AS held FROM t""")(
    lambda s, p: tr.positions(trade_log(s, p)).select("symbol", "seq", "held"))
check("trade_fees", f"""{_T} SELECT symbol, seq, {rsql('greatest(round_even(price * volume * 0.0003, 2), 5.0) + CASE WHEN side = 2 THEN round_even(price * volume * 0.001, 2) ELSE 0.0 END', 4)} AS fee FROM t""")(
    lambda s, p: trade_log(s, p).select("symbol", "seq", rnd(tr.trade_fee(F.col("price"), F.col("volume"), F.col("side"), commission=0.0003, stamp=0.001, minimum=5.0), 4).alias("fee")))
check("account_as_of", """SELECT event_type AS account, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1""")(
    lambda s, p: tr.account_as_of(table(s, p, "events").select(F.col("event_type").alias("account"), F.col("ts").alias("created_at"), "event_id", "value"), "2024-01-15").select("account", "event_id", "value"))
