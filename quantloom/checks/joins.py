"""Alignment, as-of and set queries; breadth queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import (HOUR_SQL, MONTH_SQL, PANEL_SQL, RETS_SQL, WEEK_SQL, check,
                                   hour_bars, month_bars, panel, rets, rounded, rsql, table,
                                   week_bars)
from quantloom.operators import breadth, joins
from quantloom.sources import bars as src

W_ = f"WITH bars AS ({WEEK_SQL})"


@check("bars_brand_week", f"{W_} SELECT symbol, ts, {rsql('open', 9)} AS open, {rsql('high', 9)} AS high, "
       f"{rsql('low', 9)} AS low, {rsql('close', 9)} AS close, volume, {rsql('amount', 2)} AS amount FROM bars")
def _(spark, path):
    return rounded(week_bars(spark, path), 9, amount=2)


@check("bars_supp_month", f"WITH bars AS ({MONTH_SQL}) SELECT symbol, ts, {rsql('open', 9)} AS open, "
       f"{rsql('close', 9)} AS close, volume, {rsql('amount', 2)} AS amount FROM bars")
def _(spark, path):
    return rounded(month_bars(spark, path).select("symbol", "ts", "open", "close", "volume", "amount"),
                   9, amount=2)


@check("bars_event_hour", f"WITH bars AS ({HOUR_SQL}) SELECT symbol, ts, {rsql('open')} AS open, "
       f"{rsql('high')} AS high, {rsql('low')} AS low, {rsql('close')} AS close, volume FROM bars")
def _(spark, path):
    return rounded(hour_bars(spark, path).drop("amount"))


@check("bars_derived", f"WITH {PANEL_SQL} SELECT symbol, ts, {rsql('returns')} AS returns, "
       f"{rsql('vwap')} AS vwap FROM t0")
def _(spark, path):
    return rounded(panel(spark, path).select("symbol", "ts", "returns", "vwap"))


@check("bars_standardize", f"{W_} SELECT symbol, ts, symbol AS symbol_name, ts + INTERVAL 15 HOUR AS eob, "
       f"{rsql('close')} AS close FROM bars")
def _(spark, path):
    b = week_bars(spark, path).select("symbol", F.col("ts").alias(" TS "), F.col("symbol").alias("Name"),
                                      F.col("close").alias("CLOSE"))
    return rounded(src.standardize(b, ts="ts").select("symbol", "ts", "symbol_name", "eob", "close"))


@check("bars_upsert", """SELECT event_type AS symbol, user_id,
  arg_max(value, row(ts, event_id)) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def _(spark, path):
    e = table(spark, path, "events")
    arrivals = e.select(F.col("event_type").alias("symbol"), "user_id", "value", "event_id",
                        F.struct("ts", "event_id").alias("seq"))
    latest = src.upsert_bars(arrivals, keys=("symbol", "user_id"))
    top = e.groupBy(F.col("event_type").alias("symbol"), "user_id").agg(
        F.max("event_id").alias("event_id"))
    return latest.select("symbol", "user_id", "value").join(top, ["symbol", "user_id"])


@check("bars_upsert_partial", """SELECT event_type AS symbol, user_id,
  arg_max(CASE WHEN event_id % 3 <> 0 THEN value END,
    CASE WHEN event_id % 3 <> 0 THEN event_id END) AS value FROM events GROUP BY 1, 2""")
def _(spark, path):
    e = table(spark, path, "events").select(
        F.col("event_type").alias("symbol"), "user_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return src.upsert_bars(e, keys=("symbol", "user_id"), partial=True)


@check("bars_last_rows", f"""{W_} SELECT symbol, ts, {rsql('close')} AS close FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 5""")
def _(spark, path):
    return rounded(src.last_rows(week_bars(spark, path), 5, ["close"]))


@check("bars_from_returns", f"""WITH {RETS_SQL} SELECT symbol, ts, {rsql('v')} AS open, {rsql('v')} AS high,
  {rsql('v')} AS low, {rsql('v')} AS close, 1.0::DOUBLE AS volume FROM (SELECT symbol, ts, product(1 + coalesce(ret, 0))
  OVER (PARTITION BY symbol ORDER BY ts) AS v FROM rets)""")
def _(spark, path):
    return rounded(src.bars_from_returns(rets(spark, path)))


@check("bars_fill_calendar", f"""{W_} SELECT s.symbol, t.ts, {rsql('close')} AS close
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT ts FROM bars) t
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts""")
def _(spark, path):
    return rounded(src.fill_calendar(week_bars(spark, path)).select("symbol", "ts", "close"))


@check("filter_from_start_date", f"""WITH {PANEL_SQL} SELECT symbol, ts, {rsql('m')} AS m FROM (SELECT *, avg(close)
  OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) AS m FROM t0) WHERE ts >= TIMESTAMP '2000-01-01'""")
def _(spark, path):
    from quantloom.functions.rolling import ts_mean
    out = with_features(panel(spark, path), {"m": ts_mean(col("close"), 4)}, keep=["symbol", "ts"])
    return rounded(out.filter("ts >= TIMESTAMP '2000-01-01'"))


# -- joins ---------------------------------------------------------------------------------------------
@check("align_inner", f"""WITH {PANEL_SQL} SELECT symbol, ts, {rsql('x')} AS value FROM t0 WHERE ts IN
  (SELECT ts FROM t0 GROUP BY ts HAVING count(x) = (SELECT count(DISTINCT symbol) FROM t0))""")
def _(spark, path):
    p = panel(spark, path).select("symbol", "ts", F.col("x").alias("value"))
    return rounded(joins.align_inner(p))


@check("common_dates", """SELECT ts FROM (SELECT DISTINCT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts
  FROM events) GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""")
def _(spark, path):
    return joins.common_dates(hour_bars(spark, path), "symbol")


@check("reindex_signal", f"""{W_} SELECT b.symbol, b.ts, coalesce(s.signal, 0.0) AS signal FROM bars b LEFT JOIN
  (SELECT symbol, ts, 1.0::DOUBLE AS signal FROM bars WHERE CAST(volume AS BIGINT) % 3 = 0) s USING (symbol, ts)""")
def _(spark, path):
    b = week_bars(spark, path)
    s = b.filter("CAST(volume AS BIGINT) % 3 = 0").select("symbol", "ts", F.lit(1.0).alias("signal"))
    return joins.reindex(b.select("symbol", "ts"), s)


@check("join_benchmark", f"""{W_}, b AS (SELECT ts + INTERVAL 364 DAY AS ts, avg(close) AS bench FROM bars GROUP BY 1),
s AS (SELECT DISTINCT ts FROM bars) SELECT ts, {rsql('v')} AS bench FROM (
  SELECT s.ts, coalesce(b.bench, CASE WHEN s.ts < (SELECT min(ts) FROM b) THEN (SELECT arg_min(bench, ts) FROM b) END) AS v
  FROM s LEFT JOIN b ON b.ts = s.ts) WHERE v IS NOT NULL""")
def _(spark, path):
    b = week_bars(spark, path)
    bench = b.groupBy((F.col("ts") + F.expr("INTERVAL 364 DAYS")).alias("ts")).agg(F.avg("close").alias("bench"))  # none for the first year
    return rounded(joins.join_benchmark(b.select("ts").distinct(), bench))


_ASOF = """SELECT o_orderkey, ts, p.value AS value FROM (SELECT o_orderkey, o_orderpriority,
  TIMESTAMP '2024-01-01' + to_seconds(o_orderkey % 2592000 * 173 % 2592000) AS ts, o_custkey % 5 AS k FROM orders) o
ASOF LEFT JOIN (SELECT arg_max(value, event_id) AS value, ts AS pts, user_id % 5 AS k FROM events GROUP BY 2, 3) p
ON o.k = p.k AND o.ts {op} p.pts"""


def _asof(strict):
    def run(spark, path):
        left = table(spark, path, "orders").select(
            "o_orderkey", (F.col("o_custkey") % 5).alias("k"),
            (F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") % 2592000 * 173 % 2592000)).alias("ts"))
        right = table(spark, path, "events").select(
            (F.col("user_id") % 5).alias("k"), "ts", "value", "event_id")
        out = joins.asof(left, right, by=["k"], ts="ts", values=["value"], order="event_id", strict=strict)
        return out.select("o_orderkey", "ts", "value")
    return run


check("asof_latest", _ASOF.format(op=">="))(_asof(False))
check("asof_strictly_before", _ASOF.format(op=">"))(_asof(True))


@check("asof_price_by_frequency", f"""WITH h AS ({HOUR_SQL}), d AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts,
  arg_max(close, ts) AS close FROM h GROUP BY 1, 2),
o AS (SELECT DISTINCT symbol, ts + INTERVAL 30 MINUTE AS ts FROM h),
a AS (SELECT o.symbol, o.ts, f.close AS fine FROM o ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 9 DAY AS ts, close FROM h WHERE close > 0) f
  ON o.symbol = f.symbol AND o.ts >= f.ts)
SELECT a.symbol, a.ts, {rsql('coalesce(fine, d.close)')} AS price FROM a ASOF LEFT JOIN (SELECT * FROM d WHERE close > 0) d
  ON a.symbol = d.symbol AND a.ts >= d.ts""")
def _(spark, path):
    h = hour_bars(spark, path)
    d = h.groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(
        F.max_by("close", "ts").alias("close")).withColumn("freq", F.lit("1d"))
    fine = h.select("symbol", (F.col("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), "close", F.lit("1h").alias("freq"))  # none for nine days
    at = h.select("symbol", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("ts"))
    return rounded(joins.latest_price(fine.unionByName(d), at, ["1h", "1d"]))


@check("carry_forward", f"""WITH {PANEL_SQL} SELECT symbol, ts, {rsql('last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS x FROM t0""")
def _(spark, path):
    return rounded(joins.carry_forward(panel(spark, path).select("symbol", "ts", "x"), "x", by=["symbol"]))


@check("range_join_windows", f"""{W_}, d AS (SELECT DISTINCT ts FROM bars), w AS (SELECT k FROM range(0, 40) t(k))
SELECT ts, CAST(k AS INTEGER) AS window_id FROM d JOIN w ON date_diff('day', TIMESTAMP '1995-01-01', ts) >= k * 90
  AND date_diff('day', TIMESTAMP '1995-01-01', ts) < k * 90 + 180""")
def _(spark, path):
    d = week_bars(spark, path).select("ts").distinct()
    ids = joins.window_ids(F.col("ts"), F.lit("1995-01-01"), 90, 180)
    return d.select("ts", F.explode(ids).alias("window_id"))


@check("semi_top_symbols", f"""{W_} SELECT symbol, ts, {rsql('close')} AS close FROM bars WHERE symbol IN (SELECT symbol FROM bars
  WHERE ts = (SELECT max(ts) FROM bars) ORDER BY close DESC, symbol LIMIT 5)""")
def _(spark, path):
    b = week_bars(spark, path).select("symbol", "ts", "close")
    last = b.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    newest = b.agg(F.max("ts").alias("ts"))
    top = last.join(newest, "ts").orderBy(F.desc("close"), "symbol").limit(5).select("symbol")
    return rounded(b.join(top, "symbol", "left_semi"))


@check("anti_exits", """SELECT DISTINCT p_partkey AS symbol FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 100 FROM lineitem)""")
def _(spark, path):
    held = table(spark, path, "part").select(F.col("p_partkey").alias("symbol"))
    target = table(spark, path, "lineitem").select((F.col("l_partkey") + 100).alias("symbol"))
    return joins.only_in(held, target, ["symbol"]).distinct()


@check("set_symbol_union", """SELECT s_nationkey AS symbol FROM supplier UNION SELECT c_nationkey FROM customer""")
def _(spark, path):
    return joins.symbol_union(table(spark, path, "supplier").select(F.col("s_nationkey").alias("symbol")),
                              table(spark, path, "customer").select(F.col("c_nationkey").alias("symbol")))


@check("set_date_intersection", """SELECT DISTINCT ts FROM (SELECT o_orderdate AS ts FROM orders
  INTERSECT SELECT l_shipdate FROM lineitem)""")
def _(spark, path):
    return joins.date_intersection(table(spark, path, "orders").select(F.col("o_orderdate").alias("ts")),
                                   table(spark, path, "lineitem").select(F.col("l_shipdate").alias("ts")))


@check("set_outer_alignment", """SELECT ts, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS lines FROM
  (SELECT o_orderdate AS ts, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN
  (SELECT l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1) b USING (ts)""")
def _(spark, path):
    a = table(spark, path, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, path, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.count(F.lit(1)).alias("b"))
    out = joins.align_outer(a, b)
    return out.select("ts", F.coalesce("a", F.lit(0)).alias("orders"), F.coalesce("b", F.lit(0)).alias("lines"))


@check("set_keep_first", """SELECT k AS key, arg_min(v, s) AS value FROM (SELECT n_nationkey * 2 AS k, n_name AS v, 0 AS s FROM nation
  UNION ALL SELECT r_regionkey, r_name, 1 FROM region UNION ALL
  SELECT n_nationkey, 'late', 2 FROM nation) GROUP BY k""")
def _(spark, path):
    n = table(spark, path, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    r = table(spark, path, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return joins.keep_first([n.select((F.col("key") * 2).alias("key"), "value"), r, n.select("key", F.lit("late").alias("value"))], "key")


@check("join_fundamentals", f"""{W_}, f AS (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, max(CASE WHEN l_returnflag = 'R' AND p_size > 25 THEN p_retailprice END) AS pe_ttm FROM lineitem
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT b.symbol, b.ts, b.volume, f.pe_ttm FROM bars b LEFT JOIN f ON f.symbol = b.symbol AND f.ts = b.ts""")
def _(spark, path):
    price = F.when((F.col("l_returnflag") == "R") & (F.col("p_size") > 25), F.col("p_retailprice"))
    f = (table(spark, path, "lineitem").join(table(spark, path, "part"), F.col("l_partkey") == F.col("p_partkey"))
         .groupBy(F.col("p_brand").alias("symbol"), F.date_trunc("week", "l_shipdate").alias("ts")).agg(F.max(price).alias("pe_ttm")))
    return joins.with_fundamentals(week_bars(spark, path).select("symbol", "ts", "volume"), f, ["pe_ttm"])


# -- breadth -------------------------------------------------------------------------------------------
_COUNTS = f"""{W_}, m AS (SELECT *, sign(close - lag(close) OVER o) AS move,
  count(close) OVER h = 20 AND close > max(close) OVER h AS hi, count(close) OVER h = 20 AND close < min(close) OVER h AS lo
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts),
  h AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
c AS (SELECT ts, count(*) FILTER (WHERE move > 0) * 1.0::DOUBLE AS advance, count(*) FILTER (WHERE move < 0) * 1.0::DOUBLE AS decline,
  count(*) FILTER (WHERE hi) * 1.0::DOUBLE AS new_highs, count(*) FILTER (WHERE lo) * 1.0::DOUBLE AS new_lows,
  coalesce(sum(volume) FILTER (WHERE move > 0), 0) AS adv_volume, coalesce(sum(volume) FILTER (WHERE move < 0), 0) AS decl_volume,
  count(*) * 1.0::DOUBLE AS total FROM m GROUP BY ts),
r AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM c)"""


def _smoothed(expr, name, d):
    return (f"{_COUNTS}, v AS (SELECT ts, rn, {expr} AS v FROM r) SELECT ts, {rsql('v')} AS {name}, "
            f"{rsql(f'CASE WHEN rn >= {d} THEN avg(v) OVER (ORDER BY ts ROWS {d - 1} PRECEDING) END')} AS {name}_smoothed FROM v")


def _counts(spark, path):
    return breadth.breadth_counts(week_bars(spark, path))


check("breadth_counts", f"{_COUNTS} SELECT * FROM c")(_counts)
check("breadth_advance_decline", _smoothed(
    "CASE WHEN advance + decline > 0 THEN (advance - decline) / (advance + decline) ELSE 0.0 END", "ad_ratio", 5))(
    lambda spark, path: rounded(breadth.advance_decline(_counts(spark, path))))
check("breadth_new_high_low", _smoothed("(new_highs - new_lows) / total", "high_low", 20))(
    lambda spark, path: rounded(breadth.new_high_low(_counts(spark, path))))
check("breadth_arms_index", f"{_COUNTS} SELECT ts, {rsql('CASE WHEN decline > 0 AND decl_volume > 0 AND adv_volume > 0 THEN (advance / decline) / (adv_volume / decl_volume) ELSE 0.0 END')} AS arms FROM c")(
    lambda spark, path: rounded(breadth.arms_index(_counts(spark, path))))
check("breadth_from_columns", f"{_COUNTS} SELECT ts, {rsql('CASE WHEN advance + decline > 0 THEN (advance - decline) / (advance + decline) ELSE 0.0 END')} AS breadth_ad, {rsql('(new_highs - new_lows) / 5000.0')} AS breadth_nh FROM c")(
    lambda spark, path: rounded(breadth.breadth_features(_counts(spark, path).drop("total")).select(
        "ts", "breadth_ad", "breadth_nh")))


@check("breadth_sector_diffusion", f"""WITH {RETS_SQL}, d AS (SELECT ts, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS v,
  row_number() OVER (ORDER BY ts) AS rn FROM rets GROUP BY ts) SELECT ts, {rsql('v')} AS diffusion,
  {rsql('CASE WHEN rn >= 20 THEN avg(v) OVER (ORDER BY ts ROWS 19 PRECEDING) END')} AS diffusion_smoothed FROM d""")
def _(spark, path):
    return rounded(breadth.sector_diffusion(rets(spark, path)))


@check("breadth_mcclellan", _COUNTS.replace("WITH", "WITH RECURSIVE", 1) + f""",
e(rn, f, s) AS (SELECT rn, advance - decline, advance - decline FROM r WHERE rn = 1
  UNION ALL SELECT r.rn, e.f * 0.9 + 0.1 * (advance - decline), e.s * 0.95 + 0.05 * (advance - decline)
  FROM e JOIN r ON r.rn = e.rn + 1), o AS (SELECT ts, r.rn, f - s AS v FROM r JOIN e ON e.rn = r.rn)
SELECT ts, {rsql('v')} AS mcclellan, {rsql('CASE WHEN rn >= 5 THEN avg(v) OVER (ORDER BY ts ROWS 4 PRECEDING) END')}
  AS mcclellan_smoothed FROM o""")
def _(spark, path):
    return rounded(breadth.mcclellan(_counts(spark, path)))


@check("relative_to_benchmark", f"""{W_}, b AS (SELECT ts, avg(close) AS bc, avg(amount) AS ba, avg(volume) AS bv FROM bars GROUP BY ts),
br AS (SELECT *, bc / lag(bc) OVER (ORDER BY ts) - 1 AS brr FROM b)
SELECT symbol, bars.ts, {rsql('bc')} AS bench_close, {rsql('brr')} AS bench_returns, {rsql('close / bc')} AS rel_close,
  {rsql('amount / ba')} AS rel_amount, {rsql('volume / bv')} AS rel_volume,
  {rsql('amount / sum(amount) OVER (PARTITION BY bars.ts)')} AS share FROM bars JOIN br ON br.ts = bars.ts""")
def _(spark, path):
    b = week_bars(spark, path)
    out = breadth.relative_to(b, breadth.benchmark_of(b))
    return rounded(out.select("symbol", "ts", "bench_close", "bench_returns", "rel_close", "rel_amount",
                              "rel_volume", "share"))


@check("downside_vol", f"""WITH {PANEL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM t0)
SELECT symbol, ts, {rsql('CASE WHEN rn >= 20 THEN stddev_samp(CASE WHEN returns < 0 THEN returns END) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END')} AS value FROM p""")
def _(spark, path):
    f = breadth.downside_vol(col("returns"))
    return rounded(with_features(panel(spark, path), {"value": f}, keep=["symbol", "ts"]))


_ST = "PARTITION BY symbol ORDER BY ts"


@check("market_state", f"""WITH {PANEL_SQL}, p0 AS (SELECT *, row_number() OVER ({_ST}) AS rn FROM t0),
p AS (SELECT *, close / lag(close) OVER ({_ST}) - 1 AS r, close - lag(close, 20) OVER ({_ST}) AS mom, ln(volume) AS lv,
  CASE WHEN rn >= 5 THEN avg(close) OVER ({_ST} ROWS 4 PRECEDING) END AS m0,
  CASE WHEN rn >= 20 THEN avg(close) OVER ({_ST} ROWS 19 PRECEDING) END AS m1,
  CASE WHEN rn >= 60 THEN avg(close) OVER ({_ST} ROWS 59 PRECEDING) END AS m2,
  CASE WHEN rn >= 20 THEN avg(amount) OVER ({_ST} ROWS 19 PRECEDING) END AS am,
  CASE WHEN rn >= 20 THEN max(close) OVER ({_ST} ROWS 19 PRECEDING) END AS hi,
  CASE WHEN rn >= 20 THEN min(close) OVER ({_ST} ROWS 19 PRECEDING) END AS lo FROM p0),
z AS (SELECT *, (r - avg(r) OVER (PARTITION BY ts)) / nullif(stddev_samp(r) OVER (PARTITION BY ts), 0) AS z FROM p),
d AS (SELECT ts, avg(CASE WHEN r IS NOT NULL THEN (r > 0)::INT END) AS sector_up, avg(CASE WHEN mom IS NOT NULL THEN (mom > 0)::INT END) AS sector_mom,
  count(*) FILTER (WHERE r > 0) AS u, count(*) FILTER (WHERE r < 0) AS dn,
  avg(CASE WHEN m0 IS NOT NULL THEN (close > m0)::INT END) AS breadth_s, avg(CASE WHEN m1 IS NOT NULL THEN (close > m1)::INT END) AS breadth_m,
  avg(CASE WHEN m2 IS NOT NULL THEN (close > m2)::INT END) AS breadth_l, avg(CASE WHEN am IS NOT NULL THEN (amount > am)::INT END) AS breadth_amt,
  stddev_samp(r) AS disp, arg_max(symbol, CASE WHEN r IS NOT NULL THEN row(r, symbol) END) AS leader,
  avg(CASE WHEN hi IS NOT NULL THEN (close >= hi)::INT END) - avg(CASE WHEN lo IS NOT NULL THEN (close <= lo)::INT END) AS nhl,
  quantile_cont(lv, 0.5) AS vmed, stddev_samp(lv) AS vdisp,
  avg(CASE WHEN z IS NOT NULL THEN (z > 2)::INT END) AS tailup, avg(CASE WHEN z IS NOT NULL THEN (z < -2)::INT END) AS taildown,
  skewness(r) * (count(r) - 2) / nullif(sqrt(count(r) * (count(r) - 1.0)), 0) AS skew,
  skewness(lv) * (count(lv) - 2) / nullif(sqrt(count(lv) * (count(lv) - 1.0)), 0) AS vskew FROM z GROUP BY ts)
SELECT ts, {', '.join(f'{rsql(c)} AS {c}' for c in 'sector_up sector_mom breadth_s breadth_m breadth_l breadth_amt disp skew nhl vmed vdisp vskew tailup taildown'.split())},
  {rsql('CASE WHEN u + dn > 0 THEN (u - dn) * 1.0 / (u + dn) ELSE 0.0 END')} AS sector_ad, {rsql('tailup - taildown')} AS tailnet,
  CASE WHEN lag(leader) OVER (ORDER BY ts) IS NOT NULL THEN (leader <> lag(leader) OVER (ORDER BY ts))::INT::DOUBLE END AS rotspd FROM d""")
def _(spark, path):
    return rounded(breadth.market_state(panel(spark, path)))


@check("mean_pair_correlation", f"""WITH {RETS_SQL}, p AS (SELECT *, date_trunc('year', ts)::TIMESTAMP AS period FROM rets WHERE ret IS NOT NULL),
k AS (SELECT period, symbol FROM p GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT q.ts) FROM p q WHERE q.period = p.period) AND count(*) > 2),
w AS (SELECT p.* FROM p SEMI JOIN k ON k.period = p.period AND k.symbol = p.symbol),
c AS (SELECT a.period, a.symbol, b.symbol AS other, corr(a.ret, b.ret) AS r FROM w a JOIN w b ON a.ts = b.ts AND a.symbol <> b.symbol GROUP BY 1, 2, 3)
SELECT period, count(DISTINCT symbol) AS symbols, {rsql('avg(r)')} AS ind_corr FROM c GROUP BY period""")
def _(spark, path):
    return rounded(breadth.mean_pair_correlation(rets(spark, path)))
