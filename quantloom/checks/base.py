"""Registry of checked queries: a Spark query and, where SQL can say it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, path) -> DataFrame`` with its SQL form."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """All double columns rounded, with per-column exceptions."""
    return df.select(*[rnd(f.name, special.get(f.name, digits)).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def rsql(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


# -- bars ---------------------------------------------------------------------------------------------
_BAR_SQL = """SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS ts,
  arg_min({price}, {key}) AS open, max({price}) AS high, min({price}) AS low,
  arg_max({price}, {key}) AS close, sum({volume}) AS volume, sum({amount}) AS amount
FROM {source} GROUP BY 1, 2"""

_LINE_KEY = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

WEEK_SQL = _BAR_SQL.format(symbol="p_brand", unit="week", ts="l_shipdate", key=_LINE_KEY,
                           price="(l_extendedprice / l_quantity)", volume="l_quantity",
                           amount="l_extendedprice",
                           source="lineitem JOIN part ON l_partkey = p_partkey")
MONTH_SQL = _BAR_SQL.format(symbol="l_suppkey", unit="month", ts="l_shipdate", key=_LINE_KEY,
                            price="(l_extendedprice / l_quantity)", volume="l_quantity",
                            amount="l_extendedprice", source="lineitem")
HOUR_SQL = _BAR_SQL.format(symbol="event_type", unit="hour", ts="ts", key="row(ts, event_id)",
                           price="value", volume="1.0", amount="value", source="events")

week_bars = src.bars_brand_week
month_bars = src.bars_supp_month
hour_bars = src.bars_event_hour

# a scaled price keeps results near 1 and, 997 being prime, off exact decimal halves (which two
# engines may round apart); x and y have gaps
PANEL_SQL = f"""bars AS ({WEEK_SQL}),
t0 AS (SELECT symbol, ts, open/997 AS open, high/997 AS high, low/997 AS low,
  close/997 AS close, volume, amount/997 AS amount, amount/997/volume AS vwap,
  close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS returns,
  CASE WHEN CAST(volume AS BIGINT) % 11 <> 0 THEN ln(close) END AS x,
  CASE WHEN CAST(volume AS BIGINT) % 7 <> 0 THEN ln(volume) END AS y
  FROM bars)"""


def panel(spark: SparkSession, path: str) -> DataFrame:
    b = week_bars(spark, path)
    volume = F.col("volume").cast("bigint")
    scaled = b.select("symbol", "ts", *[(F.col(c) / 997).alias(c) for c in
                                        ("open", "high", "low", "close")], "volume",
                      (F.col("amount") / 997).alias("amount"),
                      F.when(volume % 11 != 0, F.log("close")).alias("x"),
                      F.when(volume % 7 != 0, F.log("volume")).alias("y"))
    return src.derived(scaled, ["vwap", "returns"])


# returns small enough for a net-asset value to stay near 1
RETS_SQL = f"""bars AS ({WEEK_SQL}),
rets AS (SELECT symbol, ts, close,
  0.001 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS ret FROM bars)"""


def rets(spark: SparkSession, path: str) -> DataFrame:
    r = src.with_returns(week_bars(spark, path))
    return r.select("symbol", "ts", "close", (0.001 * F.col("returns")).alias("ret"))


def select_list(columns: Mapping[str, str], digits: int = 6) -> str:
    return ", ".join(f"{rsql(e, digits)} AS {n}" for n, e in columns.items())
