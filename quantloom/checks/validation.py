"""Factor validation and signal monitoring queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import MONTH_SQL, PANEL_SQL, WEEK_SQL, check, month_bars, panel, rounded, rsql, week_bars
from quantloom.functions.rolling import ts_roc
from quantloom.operators import monitor as mo
from quantloom.operators import validation as va
from quantloom.sources.bars import with_returns

O = "PARTITION BY symbol ORDER BY ts"
# three factors on monthly supplier bars, with the next month's return
PAIRS_SQL = f"""bars AS ({MONTH_SQL}),
r0 AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS ret0, close / lag(close, 3) OVER ({O}) - 1 AS f1,
  CASE WHEN CAST(volume AS BIGINT) % 9 <> 0 THEN volume END AS f2, ln(close) AS f3 FROM bars),
r1 AS (SELECT *, lead(ret0) OVER ({O}) AS ret FROM r0),
pairs AS (SELECT 'mom' AS factor_id, symbol, ts, f1 AS value, ret FROM r1 UNION ALL
  SELECT 'vol', symbol, ts, f2, ret FROM r1 UNION ALL SELECT 'level', symbol, ts, f3, ret FROM r1)"""


def pairs(spark, path):
    b = with_returns(month_bars(spark, path))
    x = with_features(b, {"mom": ts_roc(col("close"), 3)}, keep=["symbol", "ts", "close", "volume", "returns"])
    ahead = F.lead("returns").over(W.partitionBy("symbol").orderBy("ts"))
    vol = F.when(F.col("volume").cast("bigint") % 9 != 0, F.col("volume"))
    x = x.withColumn("ret", ahead)
    s = [F.struct(F.lit(n).alias("factor_id"), v.alias("value")) for n, v in
         (("mom", F.col("mom")), ("vol", vol), ("level", F.log("close")))]
    return x.select("symbol", "ts", "ret", F.explode(F.array(*s)).alias("f")).select("f.*", "symbol", "ts", "ret")


def _rank(x, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0"


IC_SQL = f"""WITH {PAIRS_SQL}, ok AS (SELECT * FROM pairs WHERE value IS NOT NULL AND ret IS NOT NULL),
rk AS (SELECT factor_id, ts, symbol, {_rank('value', 'factor_id, ts')} AS rv, {_rank('ret', 'factor_id, ts')} AS rr, value, ret FROM ok),
ic AS (SELECT factor_id, ts, count(*) AS n, corr(rv, rr) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 10),
pic AS (SELECT factor_id, ts, count(*) AS n, corr(value, ret) AS ic FROM ok GROUP BY 1, 2 HAVING count(*) >= 5)"""

check("factor_data_checks", f"""WITH {PAIRS_SQL} SELECT factor_id, count(*) AS n, count(value) AS present,
  {rsql('count(value) * 1.0 / count(*)')} AS coverage, count(value) * 1.0 / count(*) < 0.9 AS sparse FROM pairs GROUP BY 1""")(
    lambda s, p: rounded(va.data_checks(pairs(s, p), minimum=0.9)))
check("factor_valid_filter", f"""WITH {PAIRS_SQL}, k AS (SELECT factor_id FROM pairs GROUP BY 1 HAVING count(value) >= 0.95 * count(*)
  AND stddev_pop(value) >= 1e-10) SELECT factor_id, count(*) AS n FROM pairs JOIN k USING (factor_id) GROUP BY 1""")(
    lambda s, p: va.valid_factors(pairs(s, p), minimum=0.95).groupBy("factor_id").agg(F.count(F.lit(1)).alias("n")))
check("ic_daily_spearman", f"{IC_SQL} SELECT factor_id, ts, n, {rsql('ic')} AS ic FROM ic")(
    lambda s, p: rounded(va.daily_ic(pairs(s, p))))
check("ic_daily_pearson", f"{IC_SQL} SELECT factor_id, ts, n, {rsql('ic')} AS ic FROM pic")(
    lambda s, p: rounded(va.daily_ic(pairs(s, p), "pearson", 5)))
check("ic_summary", f"""{IC_SQL} SELECT factor_id, count(*) AS days, {rsql('avg(ic)')} AS mean, {rsql('stddev_pop(ic)')} AS std,
  {rsql('avg(ic) / stddev_pop(ic)')} AS ir, {rsql('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ratio,
  {rsql('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))')} AS t_stat FROM ic GROUP BY 1""")(
    lambda s, p: rounded(va.ic_summary(va.daily_ic(pairs(s, p)))))
def t_two_sided(t: str, df: str) -> str:
    """Two-sided p-value by Simpson's rule over the density of Student's t."""
    density = f"pow(1 + pow(abs({t}) * i / 4000.0, 2) / ({df}), -(({df}) + 1) / 2.0) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"greatest(0.0, 1 - 2 * {scale} * abs({t}) / 12000.0 * list_sum(list_transform(range(0, 4001), lambda i: {density})))"


check("ic_p_value", f"""{IC_SQL}, t AS (SELECT factor_id, count(*) AS days, avg(ic) AS mean, stddev_pop(ic) AS std, avg((ic > 0)::INT) AS positive_ratio,
  avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t_stat FROM ic GROUP BY 1)
SELECT factor_id, days, {rsql('mean')} AS mean, {rsql('std')} AS std, {rsql('mean / std')} AS ir, {rsql('positive_ratio')} AS positive_ratio, {rsql('t_stat')} AS t_stat,
  {rsql(t_two_sided('t_stat', '(days - 1)'))} AS p_value FROM t""")(lambda s, p: rounded(va.ic_summary(va.daily_ic(pairs(s, p)), p_value=True)))
check("ic_aligned_one_period", f"""{IC_SQL} SELECT factor_id, ts, {rsql('ic')} AS ic FROM ic WHERE ts > (SELECT min(ts) FROM pairs)
  AND ts < (SELECT max(ts) FROM pairs)""")(
    lambda s, p: rounded(va.daily_ic(va.without_end_dates(pairs(s, p))).select("factor_id", "ts", "ic")))
check("forward_returns", f"""WITH bars AS ({MONTH_SQL}), r AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS ret FROM bars)
SELECT symbol, ts, {rsql('CASE WHEN count(ret) OVER w = 3 THEN product(1 + ret) OVER w - 1 END')} AS fwd FROM r
WINDOW w AS ({O} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)""")(
    lambda s, p: rounded(va.forward_returns(with_returns(month_bars(s, p)), 3, "returns").select("symbol", "ts", "fwd")))


def _decay_sql(lags):
    body = " UNION ALL ".join(
        f"SELECT factor_id, {n} AS lag, ts, symbol, value, CASE WHEN count(ret) OVER w{n} = {n} THEN product(1 + ret) OVER w{n} - 1 END AS f FROM pairs "
        f"WINDOW w{n} AS (PARTITION BY factor_id, symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
        for n in range(1, lags + 1))
    return f"""WITH {PAIRS_SQL}, l AS ({body}), ok AS (SELECT * FROM l WHERE value IS NOT NULL AND f IS NOT NULL),
rk AS (SELECT factor_id, lag, ts, {_rank('value', 'factor_id, lag, ts')} AS rv, {_rank('f', 'factor_id, lag, ts')} AS rr FROM ok),
d AS (SELECT factor_id, lag, ts, corr(rv, rr) AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10),
k AS (SELECT factor_id, lag, avg(ic) AS ic FROM d GROUP BY 1, 2)"""


check("ic_decay", f"{_decay_sql(8)} SELECT factor_id, CAST(lag AS INTEGER) AS lag, {rsql('ic')} AS ic FROM k")(
    lambda s, p: rounded(va.ic_decay(pairs(s, p), 8)))
check("ic_half_life", f"""{_decay_sql(8)} SELECT factor_id, count(*) AS lags, {rsql('-regr_slope(ln(abs(ic)), lag)')} AS decay_rate,
  {rsql("CASE WHEN -regr_slope(ln(abs(ic)), lag) > 0 THEN ln(2) / -regr_slope(ln(abs(ic)), lag) ELSE 'inf'::DOUBLE END", 4)} AS half_life FROM k GROUP BY 1""")(
    lambda s, p: rounded(va.half_life(va.ic_decay(pairs(s, p), 8)), half_life=4))
_GROUPS = f"""WITH {PAIRS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY factor_id, ts ORDER BY value, symbol) AS r,
  count(*) OVER (PARTITION BY factor_id, ts) AS n FROM pairs WHERE value IS NOT NULL),
g AS (SELECT factor_id, symbol, ts, CAST(CASE WHEN r = 1 THEN 1 ELSE ceil((r - 1) * 10.0 / (n - 1)) END AS INTEGER) AS grp FROM q WHERE n >= 10)"""
check("quantile_groups", f'{_GROUPS} SELECT factor_id, symbol, ts, grp AS "group" FROM g')(
    lambda s, p: va.quantile_groups(pairs(s, p)).select("factor_id", "symbol", "ts", "group"))
check("factor_turnover", f"""{_GROUPS}, i AS (SELECT factor_id, ts, row_number() OVER (PARTITION BY factor_id ORDER BY ts) AS i FROM (SELECT DISTINCT factor_id, ts FROM g)),
x AS (SELECT g.*, i.i FROM g JOIN i USING (factor_id, ts)), c AS (SELECT b.factor_id, b.ts, (a.grp <> b.grp)::INT AS m, a.grp AS before
  FROM x b JOIN x a ON a.factor_id = b.factor_id AND a.symbol = b.symbol AND a.i = b.i - 1),
d AS (SELECT factor_id, ts, avg(m) AS al, avg(m) FILTER (WHERE before = 10) AS tp, avg(m) FILTER (WHERE before = 1) AS bt FROM c GROUP BY 1, 2)
SELECT factor_id, {rsql('avg(al)')} AS mean, {rsql('avg(tp)')} AS top, {rsql('avg(bt)')} AS bottom, {rsql('stddev_pop(al)')} AS std FROM d GROUP BY 1""")(
    lambda s, p: rounded(va.turnover(va.quantile_groups(pairs(s, p)))))
check("factor_hit_rate", f"""{IC_SQL}, m AS (SELECT factor_id, ts, quantile_cont(value, 0.5) AS mv, quantile_cont(ret, 0.5) AS mr FROM ok GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT factor_id, {rsql('avg(((value > mv) = (ret > mr))::INT)')} AS hit_rate, count(*) AS pairs FROM ok JOIN m USING (factor_id, ts) GROUP BY 1""")(
    lambda s, p: rounded(va.hit_rate(pairs(s, p))))
check("ic_yearly", f"""{IC_SQL} SELECT factor_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS days, {rsql('avg(ic)')} AS mean, {rsql('avg(ic) / stddev_pop(ic)')} AS ir,
  {rsql('avg((ic > 0)::INT)')} AS positive_ratio FROM ic GROUP BY 1, 2 HAVING count(*) >= 5""")(
    lambda s, p: rounded(va.yearly_ic(va.daily_ic(pairs(s, p)))))
_TABLE = f"""{IC_SQL}, t AS (SELECT factor_id, count(*) AS days, avg(ic) AS m, stddev_samp(ic) AS s, avg((ic > 0)::INT) AS p FROM pic GROUP BY 1 HAVING count(*) >= 30),
y AS (SELECT factor_id, year(ts) AS y, avg(ic) AS ym FROM pic GROUP BY 1, 2),
ft AS (SELECT t.factor_id, any_value(days) AS days, any_value(m) AS ic_mean, any_value(s) AS ic_std, any_value(m / s) AS icir,
  any_value(p) AS hit, avg((sign(ym) = sign(m))::INT) AS yearly_stability FROM t JOIN y USING (factor_id) GROUP BY 1)"""
_FT = ", ".join(f"{rsql(c)} AS {c}" for c in ("ic_mean", "ic_std", "icir", "hit", "yearly_stability"))
check("factor_batch_table", f"{_TABLE} SELECT factor_id, days, {_FT} FROM ft")(
    lambda s, p: rounded(va.factor_table(pairs(s, p))))
check("factor_breadth_gate", f"""{_TABLE} SELECT factor_id, abs(icir) >= 0.1 AND hit >= 0.5 AND yearly_stability >= 0.5 AS strict,
  hit >= 0.5 AND yearly_stability >= 0.4 AS loose, true AS none FROM ft""")(
    lambda s, p: (lambda t: va.breadth_gate(t, F.lit(100)).select("factor_id", F.col("passed").alias("strict")).join(
        va.breadth_gate(t, F.lit(60)).select("factor_id", F.col("passed").alias("loose")), "factor_id").join(
        va.breadth_gate(t, F.lit(20)).select("factor_id", F.col("passed").alias("none")), "factor_id"))(
            va.factor_table(pairs(s, p))))
check("factor_quick_ic", f"{_TABLE} SELECT factor_id, {rsql('ic_mean')} AS ic_mean FROM ft WHERE abs(icir) >= 0.05 ORDER BY abs(ic_mean) DESC")(
    lambda s, p: rounded(va.quick_ic(va.factor_table(pairs(s, p)), 0.05).select("factor_id", "ic_mean")))
check("factor_run_validations", f"""{IC_SQL}, a AS (SELECT factor_id, avg(ic) AS m FROM ic GROUP BY 1), md AS (SELECT factor_id, ts, quantile_cont(value, 0.5) AS mv, quantile_cont(ret, 0.5) AS mr FROM ok GROUP BY 1, 2 HAVING count(*) >= 10),
h AS (SELECT factor_id, avg(((value > mv) = (ret > mr))::INT) AS h FROM ok JOIN md USING (factor_id, ts) GROUP BY 1)
SELECT factor_id, {rsql('m')} AS ic_mean, {rsql('h')} AS hit_hit_rate FROM a JOIN h USING (factor_id)""")(
    lambda s, p: rounded(va.run_validations(pairs(s, p), ["ic", "hit"]).select("factor_id", "ic_mean", "hit_hit_rate")))
check("factor_profile", f"""WITH {PAIRS_SQL}, x AS (SELECT factor_id, ts, symbol, coalesce(value, 0.0) AS x FROM pairs), v AS (SELECT *, least(greatest(x, -100.0), 100.0) AS v FROM x),
b AS (SELECT factor_id, avg(v) AS mean, stddev_pop(v) AS std, avg((v > 0)::INT) AS hit, quantile_cont(v, 0.8) AS q FROM v GROUP BY 1),
s AS (SELECT factor_id, avg((v - mean) ** 3) / any_value(std) ** 3 AS skew, avg((v - mean) ** 4) / any_value(std) ** 4 AS kurtosis,
  avg(v) FILTER (v >= q) / (abs(any_value(mean)) + 1e-10) AS top_ratio FROM v JOIN b USING (factor_id) GROUP BY 1),
m AS (SELECT factor_id, ts, avg(x) AS m, row_number() OVER (PARTITION BY factor_id ORDER BY ts) AS i FROM x GROUP BY 1, 2),
c AS (SELECT factor_id, i, m - avg(m) OVER (PARTITION BY factor_id) AS c FROM m),
a AS (SELECT l.factor_id, sum(l.c * r.c) AS u FROM c l JOIN c r ON l.factor_id = r.factor_id AND l.i + 1 = r.i GROUP BY 1),
z AS (SELECT factor_id, sum(c * c) AS s FROM c GROUP BY 1),
r AS (SELECT x.factor_id, symbol, i, row_number() OVER (PARTITION BY x.factor_id, x.ts ORDER BY x, symbol) AS r, count(*) OVER (PARTITION BY x.factor_id, x.ts) AS n
  FROM x JOIN m ON x.factor_id = m.factor_id AND x.ts = m.ts WHERE i <= 252),
t AS (SELECT n.factor_id, n.i, avg(abs(n.r - o.r)) / max(n.n) AS t FROM r n JOIN r o ON n.factor_id = o.factor_id AND n.symbol = o.symbol AND n.i = o.i + 1 GROUP BY 1, 2),
k AS (SELECT factor_id, avg(t) AS rank_turnover FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY i DESC) AS j FROM t) WHERE j <= 20 GROUP BY 1)
SELECT factor_id, {rsql('mean')} AS mean, {rsql('std')} AS std, {rsql('hit')} AS hit, {rsql('least(greatest(skew, -5), 5)')} AS skew, {rsql('least(greatest(kurtosis, 1), 15)')} AS kurtosis,
  {rsql('top_ratio')} AS top_ratio, {rsql('u / s')} AS autocorr, {rsql('rank_turnover')} AS rank_turnover
FROM b JOIN s USING (factor_id) JOIN a USING (factor_id) JOIN z USING (factor_id) JOIN k USING (factor_id)""")(lambda s, p: rounded(va.factor_profile(pairs(s, p))))


@check("bootstrap_sharpe", f"""WITH bars AS ({MONTH_SQL}), r AS (SELECT symbol, ts, 0.02 * (close / lag(close) OVER ({O}) - 1) AS ret FROM bars),
k AS (SELECT symbol FROM r WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
m AS (SELECT symbol, date_trunc('month', ts) AS t, product(1 + ret) - 1 AS ret FROM r JOIN k USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2),
x AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM m QUALIFY n >= 12),
p AS (SELECT symbol, draw, CAST(('0x' || substr(md5('7-' || draw || '-' || i), 1, 8)) AS BIGINT) % n AS i FROM x, (SELECT unnest(range(1, 201)) AS draw)),
v AS (SELECT p.symbol, draw, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(12.0) END AS v FROM p JOIN x ON x.symbol = p.symbol AND x.i = p.i GROUP BY 1, 2)
SELECT symbol, count(v) AS draws, {rsql('avg(v)')} AS mean, {rsql('stddev_pop(v)')} AS std, {rsql('quantile_cont(v, 0.025)')} AS low, {rsql('quantile_cont(v, 0.975)')} AS high
FROM v GROUP BY 1 HAVING count(v) >= 100""")
def _(spark, path):
    r = with_returns(month_bars(spark, path)).select("symbol", "ts", (F.col("returns") * 0.02).alias("ret"))
    return rounded(va.bootstrap_sharpe(r, ["symbol"], draws=200))


check("monthly_compound_returns", f"""WITH bars AS ({WEEK_SQL}), r AS (SELECT *, 0.02 * (close / lag(close) OVER ({O}) - 1) AS ret FROM bars)
SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS month, {rsql('product(1 + ret) - 1')} AS ret FROM r GROUP BY 1, 2""")(
    lambda s, p: rounded(va.monthly_returns(with_returns(week_bars(s, p)).select(
        "symbol", "ts", (F.col("returns") * 0.02).alias("ret")), ["symbol"])))

_PRED = """WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS model_id, l_extendedprice AS y, l_quantity * 1000.0 AS yhat FROM lineitem),
s AS (SELECT model_id, avg(y) AS m, stddev_pop(y) AS d FROM r GROUP BY 1),
c AS (SELECT r.model_id, y, least(greatest(yhat, m - 10 * d), m + 10 * d) AS p FROM r JOIN s USING (model_id))"""
check("prediction_quality_gate", f"""{_PRED} SELECT model_id, count(*) AS n, {rsql('CASE WHEN count(*) >= 10 THEN avg(pow(y - p, 2)) END / 1e6')} AS mse,
  {rsql('CASE WHEN count(*) >= 10 AND stddev_pop(p) > 1e-8 AND var_pop(p) >= 1e-3 * var_pop(y) THEN -avg(pow(y - p, 2)) END / 1e6')} AS score FROM c GROUP BY 1""")(
    lambda s, p: rounded(va.prediction_gate(s.read.parquet(f"{p}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias("model_id"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1000.0).alias("yhat"))).select(
            "model_id", "n", (F.col("mse") / 1e6).alias("mse"), (F.col("score") / 1e6).alias("score"))))

# -- monitoring ----------------------------------------------------------------------------------------
_M = f"""WITH {PANEL_SQL}, rows_ AS (SELECT 'mom' AS expr_id, symbol, ts, close, volume,
  CASE WHEN abs(lag(close, 4) OVER ({O})) > 1e-10 THEN close / lag(close, 4) OVER ({O}) - 1 END AS signal FROM t0),
h AS (SELECT unnest([1, 3, 5, 10, 20]) AS horizon),
l AS (SELECT *, lag(signal) OVER ({O}) AS value, row_number() OVER ({O}) AS rn FROM rows_),
pairs AS (SELECT a.expr_id, a.symbol, a.ts, a.value, h.horizon, b.close / a.close - 1 AS ret FROM l a CROSS JOIN h
  JOIN l b ON b.symbol = a.symbol AND b.rn = a.rn + h.horizon WHERE a.value IS NOT NULL),
roll AS (SELECT expr_id, symbol, horizon, ts, CASE WHEN count(*) OVER w = 60 THEN corr(value, ret) OVER w END AS ic FROM pairs
  WINDOW w AS (PARTITION BY symbol, horizon ORDER BY ts ROWS 59 PRECEDING))"""


def series(spark, path):
    x = with_features(panel(spark, path), {"signal": ts_roc(col("close"), 4)}, keep=["symbol", "ts", "close", "volume"])
    return x.withColumn("expr_id", F.lit("mom"))


def _pairs(s, p):
    return mo.horizon_pairs(series(s, p))


_G = "GROUP BY expr_id, symbol, horizon"
check("monitor_basic_ic", f"""{_M}, k AS (SELECT *, {_rank('value', 'symbol, horizon')} AS rv, {_rank('ret', 'symbol, horizon')} AS rr FROM pairs),
c AS (SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, corr(value, ret) AS ic, corr(rv, rr) AS rank_ic FROM k {_G})
SELECT expr_id, symbol, horizon, n, {rsql('ic')} AS ic, {rsql('rank_ic')} AS rank_ic, {rsql('ic * sqrt((n - 2) / (1 - ic * ic))')} AS t_stat,
  {rsql('rank_ic * sqrt((n - 2) / (1 - rank_ic * rank_ic))')} AS rank_t FROM c WHERE n >= 10""")(
    lambda s, p: rounded(mo.basic_ic(_pairs(s, p))))
check("monitor_significance", f"""{_M}, k AS (SELECT *, {_rank('value', 'symbol, horizon')} AS rv, {_rank('ret', 'symbol, horizon')} AS rr FROM pairs),
c AS (SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, corr(value, ret) AS ic, corr(rv, rr) AS rank_ic FROM k {_G} HAVING count(*) >= 10),
t AS (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t1, rank_ic * sqrt((n - 2) / (1 - rank_ic * rank_ic)) AS t2 FROM c)
SELECT expr_id, symbol, horizon, n, {rsql('ic')} AS ic, {rsql('rank_ic')} AS rank_ic, {rsql('t1')} AS t_stat, {rsql('t2')} AS rank_t,
  {rsql(t_two_sided('t1', '(n - 2)'))} AS p_value, {rsql(t_two_sided('t2', '(n - 2)'))} AS rank_p FROM t""")(lambda s, p: rounded(mo.significance(mo.basic_ic(_pairs(s, p)))))
check("monitor_rolling_ic", f"{_M} SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, ts, {rsql('ic', 5)} AS ic FROM roll")(
    lambda s, p: rounded(mo.rolling_ic(_pairs(s, p)), 5))
check("monitor_rolling_summary", f"""{_M} SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, {rsql('avg(ic)')} AS mean, {rsql('stddev_samp(ic)')} AS std,
  {rsql('avg(ic) / stddev_samp(ic)')} AS ir, {rsql('avg((ic > 0)::INT)')} AS positive, {rsql('min(ic)')} AS min, {rsql('max(ic)')} AS max FROM roll WHERE ic IS NOT NULL {_G}""")(
    lambda s, p: rounded(mo.rolling_summary(mo.rolling_ic(_pairs(s, p)))))
check("monitor_ic_decay_speed", f"""{_M}, c AS (SELECT expr_id, symbol, horizon, corr(value, ret) AS ic FROM pairs {_G})
SELECT expr_id, symbol, {rsql('(abs(arg_min(ic, horizon)) - abs(arg_max(ic, horizon))) / 19.0')} AS decay FROM c GROUP BY 1, 2""")(
    lambda s, p: rounded(mo.ic_decay_speed(mo.basic_ic(_pairs(s, p)))))
check("monitor_annual_ic", f"""{_M}, c AS (SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, corr(value, ret) AS ic FROM pairs GROUP BY 1, 2, 3, 4)
SELECT expr_id, symbol, horizon, year, n, {rsql('CASE WHEN isfinite(ic) THEN ic END', 5)} AS ic, {rsql('CASE WHEN n >= 30 THEN ic * sqrt((n - 2) / (1 - ic * ic)) END', 5)} AS t_stat FROM c""")(
    lambda s, p: rounded(mo.annual_ic(_pairs(s, p)), 5))
check("monitor_cumulative_ic", f"""{_M} SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, ts, {rsql('sum(ic) OVER (PARTITION BY symbol, horizon ORDER BY ts)', 5)} AS cum_ic FROM roll WHERE ic IS NOT NULL""")(
    lambda s, p: rounded(mo.cumulative_ic(mo.rolling_ic(_pairs(s, p))).drop("ic"), 5))
check("monitor_signal_turnover", f"""{_M}, c AS (SELECT expr_id, symbol, abs(signal - lag(signal) OVER ({O})) AS c FROM rows_),
a AS (SELECT expr_id, symbol, avg(c) AS mean, max(c) AS max, min(c) AS min, stddev_samp(c) AS std FROM c GROUP BY 1, 2)
SELECT a.expr_id, a.symbol, {rsql('any_value(mean)')} AS mean, {rsql('any_value(max)')} AS max, {rsql('any_value(min)')} AS min, {rsql('any_value(std)')} AS std,
  count(*) FILTER (WHERE c > mean + 2 * std) AS high_days FROM a JOIN c ON c.symbol = a.symbol GROUP BY 1, 2""")(
    lambda s, p: rounded(mo.signal_turnover(series(s, p))))
_S = "skewness(ic) * (count(ic) - 2) / sqrt(count(ic) * (count(ic) - 1.0))"
check("monitor_ic_distribution", f"""{_M} SELECT expr_id, symbol, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, {rsql('avg(ic)')} AS mean, {rsql('stddev_samp(ic)')} AS std,
  {rsql('skewness(ic)')} AS skew, {rsql('kurtosis(ic)')} AS kurtosis, {rsql('quantile_cont(ic, 0.05)')} AS q05, {rsql('quantile_cont(ic, 0.25)')} AS q25,
  {rsql('quantile_cont(ic, 0.75)')} AS q75, {rsql('quantile_cont(ic, 0.95)')} AS q95,
  {rsql(f'count(*) / 6.0 * (pow({_S}, 2) + pow(kurtosis_pop(ic), 2) / 4)', 4)} AS jb,
  {rsql(f'exp(-(count(*) / 6.0 * (pow({_S}, 2) + pow(kurtosis_pop(ic), 2) / 4)) / 2)')} AS jb_p FROM roll WHERE ic IS NOT NULL {_G}""")(
    lambda s, p: rounded(mo.ic_distribution(mo.rolling_ic(_pairs(s, p))), jb=4))
check("monitor_decay_alerts", f"""{_M}, z AS (SELECT a.expr_id, a.symbol, a.ts, a.rn, a.signal AS v, b.close / a.close - 1 AS r FROM l a LEFT JOIN l b ON b.symbol = a.symbol AND b.rn = a.rn + 5),
c0 AS (SELECT expr_id, symbol, ts, CASE WHEN count(v + r) OVER w = 60 THEN corr(v, r) OVER w END AS ic FROM z WINDOW w AS ({O} ROWS 59 PRECEDING)),
c AS (SELECT *, row_number() OVER ({O}) - 1 AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM c0 WHERE ic IS NOT NULL),
d AS (SELECT expr_id, symbol, count(*) AS n, avg(ic) AS f, avg(ic) FILTER (WHERE back <= 90) AS n90, avg(ic) FILTER (WHERE back <= 180) AS n180,
  avg((ic < 0)::INT) FILTER (WHERE back <= 90) AS neg, regr_slope(ic, i) AS b, regr_intercept(ic, i) AS a, regr_r2(ic, i) AS r2 FROM c GROUP BY 1, 2)
SELECT expr_id, symbol, n, {rsql('f')} AS ic_full, {rsql('n90')} AS ic_90, {rsql('n180')} AS ic_180, {rsql('b', 8)} AS slope, {rsql('r2', 5)} AS trend_r2, {rsql('abs(a / b)', 2)} AS days_to_zero,
  {rsql('neg')} AS negative_90, {rsql('b * 21')} AS decay_per_month,
  CASE WHEN abs(f) < 0.03 OR abs(n90) < 0.03 OR abs(n90) < abs(f) * 0.3 THEN 'DEAD'
    WHEN r2 > 0.3 AND abs(b * 21) > 1e-4 AND ((f > 0 AND b < 0) OR (f < 0 AND b > 0)) THEN 'DECAYING' WHEN abs(n90) < abs(f) * 0.5 THEN 'DECAYING'
    WHEN f > 0 AND neg > 0.6 THEN 'REVERSED' WHEN f < 0 AND neg < 0.4 THEN 'REVERSED' ELSE 'NORMAL' END AS alert FROM d""")(
    lambda s, p: rounded(mo.decay_monitor(series(s, p)), slope=8, trend_r2=5, days_to_zero=2))
_R = f"""{_M}, x0 AS (SELECT l.*, abs(close / lag(close, 20) OVER ({O}) - 1) AS mv, CASE WHEN rn >= 40 THEN avg(close) OVER ({O} ROWS 39 PRECEDING) END AS ma,
  CASE WHEN rn >= 20 THEN avg(volume) OVER ({O} ROWS 19 PRECEDING) END AS vm, lead(close, 5) OVER ({O}) / close - 1 AS ret FROM l),
x AS (SELECT *, quantile_cont(mv, 0.33) OVER (PARTITION BY symbol) AS q1, quantile_cont(mv, 0.67) OVER (PARTITION BY symbol) AS q2, (close - ma) / ma * 100 AS dev, volume / vm AS vr FROM x0),
g AS (SELECT expr_id, symbol, ts, signal, ret, CASE WHEN mv >= q2 THEN 'vol_high' WHEN mv >= q1 THEN 'vol_mid' WHEN mv IS NOT NULL THEN 'vol_low' END AS regime FROM x
  UNION ALL SELECT expr_id, symbol, ts, signal, ret, CASE WHEN dev > 3 THEN 'trend_up' WHEN dev < -3 THEN 'trend_down' WHEN dev IS NOT NULL THEN 'trend_flat' END FROM x
  UNION ALL SELECT expr_id, symbol, ts, signal, ret, CASE WHEN vr > 1.3 THEN 'volume_high' WHEN vr < 0.7 THEN 'volume_low' WHEN vr IS NOT NULL THEN 'volume_normal' END FROM x)"""
check("monitor_regimes", f"{_R} SELECT symbol, regime, count(*) AS n FROM g WHERE regime IS NOT NULL GROUP BY 1, 2")(
    lambda s, p: mo.regimes(series(s, p)).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n")))
check("monitor_regime_performance", f"""{_R}, u AS (SELECT *, CASE WHEN count(signal) OVER w >= 10 AND signal > quantile_cont(signal, 0.5) OVER w THEN 1 ELSE 0 END AS up FROM g WHERE regime IS NOT NULL
  WINDOW w AS (PARTITION BY symbol, regime ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT expr_id, symbol, regime, count(*) AS n, {rsql('corr(signal, ret)')} AS ic, {rsql('avg(ret) * 100', 5)} AS mean_return,
  {rsql('avg((up = CASE WHEN ret > 0 THEN 1 ELSE 0 END)::INT) * 100')} AS accuracy FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 20""")(
    lambda s, p: rounded(mo.regime_performance(mo.regimes(series(s, p))), mean_return=5))
_TEXTS = ("no regime shows an effect: replace the signal", "works in few regimes: filter by regime", "weak at high volatility: raise the entry threshold there",
          "weak at low volatility: reduce the position there", "weak in falling trends: add a trend filter", "works on high volume: confirm entries with volume")
_WHEN = ("good = 0", "good > 0 AND good < n * 0.5", "vh > 0", "vl > 0", "td > 0", "vv > 0")
check("monitor_explain", f"""{_R}, md AS (SELECT symbol, coalesce(quantile_cont(signal, 0.5), 0.0) AS md FROM x GROUP BY 1),
gf AS (SELECT g.* REPLACE (coalesce(signal, md) AS signal) FROM g JOIN md USING (symbol) WHERE regime IS NOT NULL),
pf AS (SELECT expr_id, symbol, regime, count(*) AS n, corr(signal, ret) AS ic FROM gf GROUP BY 1, 2, 3 HAVING count(*) >= 20),
ag AS (SELECT expr_id, symbol, arg_max(regime, row(abs(ic), regime)) AS best, arg_min(regime, row(abs(ic), regime)) AS worst,
  string_agg(regime, '; ' ORDER BY regime) FILTER (abs(ic) > 0.08) AS works_in, string_agg(regime, '; ' ORDER BY regime) FILTER (abs(ic) <= 0.05 AND n > 50) AS fails_in,
  count(*) FILTER (abs(ic) > 0.05) AS good, count(*) AS n, count(*) FILTER (regime = 'vol_high' AND abs(ic) <= 0.05) AS vh, count(*) FILTER (regime = 'vol_low' AND abs(ic) <= 0.05) AS vl,
  count(*) FILTER (regime = 'trend_down' AND abs(ic) <= 0.05) AS td, count(*) FILTER (regime LIKE 'volume_high%' AND abs(ic) > 0.05) AS vv FROM pf GROUP BY 1, 2),
tx AS (SELECT *, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, t in zip(_WHEN, _TEXTS))}) AS t FROM ag)
SELECT expr_id, symbol, best, worst, coalesce(works_in, '') AS works_in, coalesce(fails_in, '') AS fails_in, CASE WHEN t = '' THEN 'balanced across regimes: keep as it is' ELSE t END AS suggestions FROM tx""")(
    lambda s, p: (lambda e: e.select("expr_id", "symbol", "best", "worst", *[F.array_join(c, "; ").alias(c) for c in ("works_in", "fails_in", "suggestions")]))(
        mo.explain(mo.regime_performance(mo.regimes(mo.fill_signal(series(s, p)))))))
check("monitor_explain_overall", f"""{_M}, r1 AS (SELECT expr_id, symbol, ts, pow(close, 0.01) AS close, signal FROM rows_),
md AS (SELECT symbol, coalesce(quantile_cont(signal, 0.5), 0.0) AS md FROM r1 GROUP BY 1), f0 AS (SELECT r1.* REPLACE (coalesce(signal, md) AS signal) FROM r1 JOIN md USING (symbol)),
f1 AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS ret, lead(close, 5) OVER ({O}) / close - 1 AS ahead,
  CASE WHEN row_number() OVER ({O}) >= 20 AND signal > quantile_cont(signal, 0.5) OVER ({O} ROWS UNBOUNDED PRECEDING) THEN 1 ELSE 0 END AS pos FROM f0),
f2 AS (SELECT *, coalesce(lag(pos) OVER ({O}), 0) AS held FROM f1),
f3 AS (SELECT *, sum(CASE WHEN held = 1 AND before = 0 THEN 1 ELSE 0 END) OVER ({O}) AS trip FROM (SELECT *, coalesce(lag(held) OVER ({O}), 0) AS before FROM f2)),
f4 AS (SELECT *, product(1 + CASE WHEN held = 1 THEN coalesce(ret, 0) ELSE 0 END) OVER ({O}) AS nav FROM f3),
f5 AS (SELECT *, nav / lag(nav) OVER ({O}) - 1 AS r, nav / max(nav) OVER ({O}) - 1 AS dd FROM f4),
f6 AS (SELECT expr_id, symbol, corr(signal, ahead) AS ic, pow(arg_max(nav, ts) / arg_min(nav, ts), 252.0 / (count(*) - 1)) - 1 AS ann, stddev_samp(r) * sqrt(252.0) AS sd, least(min(dd), 0.0) AS dd FROM f5 GROUP BY 1, 2),
w AS (SELECT symbol, avg((p > 1)::INT) AS win FROM (SELECT symbol, trip, product(1 + coalesce(ret, 0)) AS p, arg_max(pos, ts) AS still FROM f3 WHERE held = 1 GROUP BY 1, 2) WHERE still = 0 GROUP BY 1)
SELECT expr_id, symbol, {rsql('ic')} AS ic, {rsql('ann')} AS annual_return, {rsql('(ann - 0.02) / sd', 5)} AS sharpe, {rsql('dd')} AS max_drawdown, {rsql('coalesce(win, 0)')} AS win_rate FROM f6 LEFT JOIN w USING (symbol)""")(
    lambda s, p: rounded(mo.explain_overall(series(s, p).withColumn("close", F.pow("close", F.lit(0.01)))), sharpe=5))
check("monitor_rolling_icir", f"""{_M}, z AS (SELECT a.expr_id, a.symbol, a.ts, a.signal AS v, b.close / a.close - 1 AS r FROM l a LEFT JOIN l b ON b.symbol = a.symbol AND b.rn = a.rn + 5),
c0 AS (SELECT expr_id, symbol, ts, CASE WHEN count(v + r) OVER w = 60 THEN corr(v, r) OVER w END AS ic FROM z WINDOW w AS ({O} ROWS 59 PRECEDING)), c AS (SELECT * FROM c0 WHERE ic IS NOT NULL)
SELECT expr_id, symbol, ts, {rsql('ic')} AS ic, {rsql('CASE WHEN count(*) OVER w = 200 THEN avg(ic) OVER w / stddev_samp(ic) OVER w END')} AS icir FROM c WINDOW w AS ({O} ROWS 199 PRECEDING)""")(
    lambda s, p: rounded(mo.rolling_icir(series(s, p), window=200)))
