"""Two-stage factor scoring: coefficients, then net asset values of what passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import RETS_SQL, check, rounded, rsql, week_bars
from quantloom.functions.rolling import ts_roc
from quantloom.operators import scoring as sc
from quantloom.sources.bars import with_returns
from quantloom.sources.store import materialize

O = "PARTITION BY symbol ORDER BY ts"
# five factors on weekly bars; returns are scaled so that a net asset value stays near 1
_VALUES = f"""WITH {RETS_SQL}, fv AS (SELECT symbol, ts, close / lag(close, 4) OVER ({O}) - 1 AS mom, 1 - close / lag(close) OVER ({O}) AS rev,
  CASE WHEN CAST(volume AS BIGINT) % 9 <> 0 THEN volume END AS vol, -ln(close) AS cheap, (high - low) / close AS span FROM bars),
vals AS ({' UNION ALL '.join(f"SELECT '{n}' AS factor_id, symbol, ts, {n} AS value FROM fv" for n in ('mom', 'rev', 'vol', 'cheap', 'span'))}),
nx AS (SELECT symbol, ts, lead(ret) OVER ({O}) AS ret FROM rets), prs AS (SELECT vals.*, nx.ret FROM vals JOIN nx USING (symbol, ts)),
ok AS (SELECT * FROM prs WHERE value IS NOT NULL AND ret IS NOT NULL),
pic AS (SELECT factor_id, ts, corr(value, ret) AS ic FROM ok GROUP BY 1, 2 HAVING count(*) >= 5),
t AS (SELECT factor_id, count(*) AS days, avg(ic) AS m, stddev_samp(ic) AS s, avg((ic > 0)::INT) AS p FROM pic GROUP BY 1 HAVING count(*) >= 30),
yr AS (SELECT factor_id, year(ts) AS y, avg(ic) AS ym FROM pic GROUP BY 1, 2),
ft AS (SELECT t.factor_id, any_value(days) AS days, any_value(m) AS ic_mean, any_value(s) AS ic_std, any_value(m / s) AS icir,
  any_value(p) AS hit, avg((sign(ym) = sign(m))::INT) AS yearly_stability FROM t JOIN yr USING (factor_id) GROUP BY 1)"""
_NAV = """, pass AS ({gate}), d AS (SELECT DISTINCT ts FROM rets),
{sched},
rk AS (SELECT factor_id, ts, symbol, row_number() OVER (PARTITION BY factor_id, ts ORDER BY value DESC, symbol) AS rank FROM vals JOIN pass USING (factor_id) WHERE value IS NOT NULL),
w AS (SELECT factor_id, freq, rk.ts, symbol, 1.0 / count(*) OVER (PARTITION BY factor_id, freq, rk.ts) AS weight FROM rk JOIN sched USING (ts) WHERE rank <= 3),
hold AS (SELECT *, lead(f) OVER (PARTITION BY factor_id, freq ORDER BY f) AS t FROM (SELECT DISTINCT factor_id, freq, ts AS f FROM w)),
dr AS (SELECT k.factor_id, k.freq, d.ts, coalesce(sum(w.weight * coalesce(r.ret, 0)), 0) AS ret FROM (SELECT DISTINCT factor_id, freq FROM w) k CROSS JOIN d
  LEFT JOIN hold h ON h.factor_id = k.factor_id AND h.freq = k.freq AND h.f < d.ts AND (h.t IS NULL OR d.ts <= h.t)
  LEFT JOIN w ON w.factor_id = k.factor_id AND w.freq = k.freq AND w.ts = h.f LEFT JOIN rets r ON r.symbol = w.symbol AND r.ts = d.ts GROUP BY 1, 2, 3),
nav AS (SELECT *, product(1 + ret) OVER (PARTITION BY factor_id, freq ORDER BY ts) AS nav FROM dr),
nx2 AS (SELECT *, nav / lag(nav) OVER w2 - 1 AS r, nav / max(nav) OVER w2 - 1 AS dd FROM nav WINDOW w2 AS (PARTITION BY factor_id, freq ORDER BY ts)),
b0 AS (SELECT factor_id, freq, pow(arg_max(nav, ts) / arg_min(nav, ts), 252.0 / (count(*) - 1)) - 1 AS ann, stddev_samp(r) * sqrt(252.0) AS sd,
  CASE WHEN min(dd) < 0 THEN min(dd) END AS mdd FROM nx2 GROUP BY 1, 2),
bt AS (SELECT *, (ann - 0.02) / sd AS sharpe FROM b0)"""
_ME = "SELECT 'ME' AS freq, ts FROM (SELECT max(ts) AS ts, row_number() OVER (ORDER BY max(ts)) AS i, count(*) OVER () AS n FROM d GROUP BY date_trunc('month', ts)) WHERE i > 1 OR n = 1"
_W = _ME.replace("'ME'", "'W'").replace("'month'", "'week'")
_5D = "SELECT '5D' AS freq, ts FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM d) WHERE n > 5 AND i % 5 = 0"
_ALL = "SELECT factor_id FROM ft"
_FT = ", ".join(f"{rsql(c)} AS {c}" for c in ("ic_mean", "ic_std", "icir", "hit", "yearly_stability"))


def nav_sql(gate: str = _ALL, *rules: str, more: str = "") -> str:
    return _VALUES + more + _NAV.format(gate=gate, sched=f"sched AS ({' UNION ALL '.join(rules or (_ME,))})")


def inputs(spark, path):
    """Factor values, a folder each, and the returns that score them; both written once."""
    b = with_returns(week_bars(spark, path))
    vol = F.when(F.col("volume").cast("bigint") % 9 != 0, F.col("volume"))
    x = with_features(b, {"mom": ts_roc(col("close"), 4)}, keep=["symbol", "ts", "close", "high", "low", "volume", "returns"])
    x = materialize(x.withColumns({"rev": -F.col("returns"), "vol": vol, "cheap": -F.log("close"), "span": (F.col("high") - F.col("low")) / F.col("close")}), "factors")
    each = [F.struct(F.lit(n).alias("factor_id"), F.col(n).alias("value")) for n in ("mom", "rev", "vol", "cheap", "span")]
    values = x.select("symbol", "ts", F.explode(F.array(*each)).alias("f")).select("f.*", "symbol", "ts")
    returns = x.select("symbol", "ts", (0.001 * F.col("returns")).alias("ret"))
    return sc.store_values(values), materialize(returns, "returns")


check("factor_batch_scores", f"""{nav_sql()} SELECT factor_id, days, {_FT}, {rsql('sharpe', 5)} AS sharpe, {rsql('ann')} AS annual_return, {rsql('mdd')} AS max_drawdown
FROM ft LEFT JOIN bt USING (factor_id)""")(lambda s, p: rounded(sc.batch_scores(*inputs(s, p)), sharpe=5))
_GATE = "hit >= 0.5 AND yearly_stability >= 0.6"
check("factor_funnel", f"""{nav_sql(f'SELECT factor_id FROM ft WHERE {_GATE}')} SELECT factor_id, {_GATE} AS passed, {rsql('coalesce(sharpe, -999.0)', 5)} AS score,
  {rsql('mdd')} AS max_drawdown FROM ft LEFT JOIN bt USING (factor_id)""")(lambda s, p: rounded(sc.funnel(*inputs(s, p)), score=5))
_STRICT = """CASE WHEN n >= 100 THEN abs(icir) >= 0.1 AND hit >= 0.5 AND yearly_stability >= 0.5 WHEN n >= 50 THEN hit >= 0.5 AND yearly_stability >= 0.4 ELSE true END"""
check("factor_breadth_scores", f"""{nav_sql(f'SELECT factor_id FROM ft, (SELECT count(DISTINCT symbol) AS n FROM rets) WHERE {_STRICT}')}
SELECT factor_id, n AS symbols, {_STRICT} AS passed, {rsql('coalesce(sharpe, -999.0)', 5)} AS score, {rsql('mdd')} AS max_drawdown
FROM ft CROSS JOIN (SELECT count(DISTINCT symbol) AS n FROM rets) LEFT JOIN bt USING (factor_id)""")(lambda s, p: rounded(sc.breadth_scores(*inputs(s, p)), score=5))
check("factor_best_frequency", f"""{nav_sql(_ALL, _ME, _W, _5D)} SELECT factor_id, {rsql('max(sharpe)', 5)} AS sharpe, arg_max(freq, row(sharpe, freq)) AS freq,
  {rsql('arg_max(mdd, row(sharpe, freq))')} AS max_drawdown FROM bt WHERE sharpe IS NOT NULL GROUP BY 1""")(
    lambda s, p: rounded(sc.best_rules(*inputs(s, p)), sharpe=5))
_RANK = "(rank() OVER (PARTITION BY factor_id, ts ORDER BY {0}) + (count(*) OVER (PARTITION BY factor_id, ts, {0}) - 1) / 2.0)"
_EXPLORED = f""", ex AS (SELECT factor_id, avg(ic) AS ic_mean, avg(ic) / stddev_pop(ic) AS ic_ir FROM (
  SELECT factor_id, ts, corr(rv, rr) AS ic FROM (SELECT factor_id, ts, {_RANK.format('value')} AS rv, {_RANK.format('ret')} AS rr FROM ok) GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1),
md AS (SELECT factor_id, ts, quantile_cont(value, 0.5) AS mv, quantile_cont(ret, 0.5) AS mr FROM ok GROUP BY 1, 2 HAVING count(*) >= 10),
hr AS (SELECT factor_id, avg(((value > mv) = (ret > mr))::INT) AS hit_rate FROM ok JOIN md USING (factor_id, ts) GROUP BY 1)"""
check("factor_explorer", f"""{nav_sql('SELECT factor_id FROM ex WHERE abs(ic_mean) >= 0.02', more=_EXPLORED)}
SELECT factor_id, {rsql('ic_mean')} AS ic_mean, {rsql('ic_ir')} AS ic_ir, {rsql('hit_rate')} AS hit_rate, {rsql('sharpe', 5)} AS sharpe, {rsql('ann')} AS annual_return,
  {rsql('mdd')} AS max_drawdown, {rsql('abs(ic_mean) * greatest(ic_ir, 0.0)')} AS explore FROM ex JOIN hr USING (factor_id) JOIN bt USING (factor_id)""")(
    lambda s, p: rounded(sc.explore(*inputs(s, p), min_ic=0.02), sharpe=5))
