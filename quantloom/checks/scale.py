"""Queries of the forms for very long series and very wide dates, on raw rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import col
from quantloom.checks.base import check, rounded, rsql, table
from quantloom.functions.cross_section import cs_rank, cs_rank0, cs_rank_average
from quantloom.functions.indicators import ema, wilder_smooth
from quantloom.functions.rolling import rolling_apply, ts_delay, ts_max, ts_mean, ts_zscore
from quantloom.plans.panel import with_features
from quantloom.plans.split import cs_rank_split, numbered, with_features_split

_O = "PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def lines(spark, path):
    return table(spark, path, "lineitem").select("l_returnflag", "l_shipdate", *KEY)


@check("split_row_numbers", f"SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, row_number() OVER ({_O}) AS rn FROM lineitem")
def _(spark, path):
    return numbered(lines(spark, path), symbol="l_returnflag", ts="l_shipdate", order=KEY, bucket="month").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "rn")


@check("split_rolling_features", f"""WITH p AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice / 997 AS x, row_number() OVER ({_O}) AS rn FROM lineitem),
q AS (SELECT *, CASE WHEN rn >= 50 THEN avg(x) OVER (PARTITION BY l_returnflag ORDER BY rn ROWS 49 PRECEDING) END AS m FROM p)
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, {rsql('m')} AS m, {rsql('lag(m, 7) OVER (PARTITION BY l_returnflag ORDER BY rn)')} AS m7,
  {rsql('CASE WHEN rn >= 20 THEN max(m) OVER (PARTITION BY l_returnflag ORDER BY rn ROWS 19 PRECEDING) END')} AS top,
  {rsql('CASE WHEN rn >= 30 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END')} AS z FROM q WINDOW w AS (PARTITION BY l_returnflag ORDER BY rn ROWS 29 PRECEDING)""")
def _(spark, path):
    x = lines(spark, path).withColumn("x", F.col("l_extendedprice") / 997)
    m = ts_mean(col("x"), 50)
    return rounded(with_features_split(
        x, {"m": m, "m7": ts_delay(m, 7), "top": ts_max(m, 20), "z": ts_zscore(col("x"), 30)}, symbol="l_returnflag",
        ts="l_shipdate", order=KEY, rows=5000, bucket="month", keep=["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"]))


def _smooth_sql(a: float, seed: int, share: float) -> str:
    """An average seeded with the mean of ``seed`` rows: a weighted sum of the rows since; 900 rows back a weight is below 1e-25."""
    return f"""(SELECT p.k, pow({a}, p.rn - {seed}) * any_value(s.m) + coalesce(sum({share} * pow({a}, o.j) * q.x), 0) AS y FROM p JOIN s{seed} s ON s.l_returnflag = p.l_returnflag
  CROSS JOIN (SELECT unnest(range(0, 900)) AS j) o LEFT JOIN p q ON q.l_returnflag = p.l_returnflag AND q.rn = p.rn - o.j AND q.rn > {seed} WHERE p.rn >= {seed} GROUP BY p.k, p.rn)"""


@check("split_smoothed_features", f"""WITH p0 AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice / 997 AS x, row_number() OVER ({_O}) AS rn FROM lineitem),
p AS (SELECT *, row_number() OVER () AS k FROM p0), s20 AS (SELECT l_returnflag, avg(x) AS m FROM p WHERE rn <= 20 GROUP BY 1), s14 AS (SELECT l_returnflag, avg(x) AS m FROM p WHERE rn <= 14 GROUP BY 1),
e AS {_smooth_sql(19 / 21, 20, 2 / 21)}, w AS {_smooth_sql(13 / 14, 14, 1 / 14)}
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, {rsql('e.y')} AS ema, {rsql('w.y')} AS wilder, {rsql('x - e.y')} AS gap FROM p LEFT JOIN e USING (k) LEFT JOIN w USING (k)""")
def _(spark, path):
    x = lines(spark, path).withColumn("x", F.col("l_extendedprice") / 997)
    e = ema(col("x"), 20)
    return rounded(with_features_split(
        x, {"ema": e, "wilder": wilder_smooth(col("x"), 14), "gap": col("x") - e}, symbol="l_returnflag",
        ts="l_shipdate", order=KEY, rows=5000, bucket="month", keep=["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey"]))


@check("split_cross_section_rank", f"""SELECT l_orderkey, l_linenumber, l_partkey, {rsql('rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) * 1.0 / count(*) OVER (PARTITION BY l_returnflag)')} AS rank FROM lineitem""")
def _(spark, path):
    out = cs_rank_split(lines(spark, path), "l_extendedprice", ts="l_returnflag")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "rank"))


# several lines share supplier and day, so (symbol, ts) repeats
_RANKED = {"r1": ("l_extendedprice", ""), "r2": ("l_quantity", ""), "r3": ("l_discount", "0"), "r4": ("l_tax", "average"), "r5": ("l_partkey", ""),
           "r6": ("l_orderkey", "0"), "r7": ("l_linenumber", "average"), "r8": ("l_discount", "")}


def _rank_sql(name, column, kind):
    day, at = "PARTITION BY l_shipdate", f"PARTITION BY l_shipdate ORDER BY {column}"
    upto = f"count(*) OVER ({at} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    top = {"": f"rank() OVER ({at})", "0": f"(rank() OVER ({at}) - 1)", "average": f"(rank() OVER ({at}) + {upto}) / 2.0"}[kind]
    return f"{rsql(f'{top} * 1.0 / count(*) OVER ({day})')} AS {name}"


for _n in (1, 5, 6, 8):
    _some = dict(list(_RANKED.items())[:_n])
    check(f"ranks_repeated_keys_{_n}", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {', '.join(_rank_sql(k, *v) for k, v in _some.items())} FROM lineitem""")(
        lambda s, p, some=_some: rounded(with_features(
            table(s, p, "lineitem"), {k: {"": cs_rank, "0": cs_rank0, "average": cs_rank_average}[kind](col(c)) for k, (c, kind) in some.items()},
            symbol="l_suppkey", ts="l_shipdate", keep=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])))

_R = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING)"
check("rolling_apply_one_name", f"""SELECT event_id, {rsql(f'CASE WHEN count(*) {_R} = 5 THEN max(value) {_R} END')} AS top, {rsql(f'CASE WHEN count(*) {_R} = 5 THEN min(value) {_R} END')} AS low FROM events""")(
    lambda s, p: rounded(with_features(
        numbered(table(s, p, "events"), symbol="event_type", ts="ts", order=["event_id"], bucket="day", output="n"),
        {"top": rolling_apply("f", col("value"), 5, F.array_max), "low": rolling_apply("f", col("value"), 5, F.array_min)},
        symbol="event_type", ts="n", keep=["event_id"])))
