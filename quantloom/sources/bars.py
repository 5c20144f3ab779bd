"""Bars: one row per symbol and time with open, high, low, close, volume, amount."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_FIELDS = ("open", "high", "low", "close", "volume", "amount")

BARS_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("freq", T.StringType()),
     T.StructField("ts", T.TimestampType())]
    + [T.StructField(f, T.DoubleType()) for f in BAR_FIELDS])


def to_bars(trades: DataFrame, *, symbol: Column, ts: Column, price: Column, volume: Column,
            amount: Column, order: Sequence[Column]) -> DataFrame:
    """Aggregate priced rows to bars. ``order`` must identify a row: it picks open and close.

    Partial aggregation runs before the shuffle, so a symbol with most of the rows sends one
    partial bar per input partition and time bucket.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    rows = trades.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("_p"),
                         volume.alias("_v"), amount.alias("_a"), key.alias("_k"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
        F.max_by("_p", "_k").alias("close"), F.sum("_v").alias("volume"),
        F.sum("_a").alias("amount"))


def line_bars(lines: DataFrame, symbol: Column, unit: str) -> DataFrame:
    """Bars of order lines per calendar ``unit`` (week, month, day)."""
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                                "l_suppkey", "l_extendedprice")]
    return to_bars(lines, symbol=symbol, ts=F.date_trunc(unit, "l_shipdate"),
                   price=F.col("l_extendedprice") / F.col("l_quantity"),
                   volume=F.col("l_quantity"), amount=F.col("l_extendedprice"), order=order)


def bars_brand_week(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_shipdate")
    parts = spark.read.parquet(f"{path}/part.parquet").select("p_partkey", "p_brand")
    # a dimension: Spark broadcasts it while its size is under the session's limit
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return line_bars(joined, F.col("p_brand"), "week")


def bars_supp_month(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.parquet(f"{path}/lineitem.parquet")
    return line_bars(lines, F.col("l_suppkey"), "month")


def bars_event_hour(spark: SparkSession, path: str) -> DataFrame:
    events = spark.read.parquet(f"{path}/events.parquet")
    return to_bars(events, symbol=F.col("event_type"), ts=F.date_trunc("hour", "ts"),
                   price=F.col("value"), volume=F.lit(1.0), amount=F.col("value"),
                   order=[F.col("ts"), F.col("event_id")])


# -- ingest ------------------------------------------------------------------------------------------
def standardize(df: DataFrame, *, ts: str, symbol_name: str | None = None) -> DataFrame:
    """Lower-case known columns, parse the time, NaN -> NULL, choose the symbol name.

    Column names are matched without regard to case or surrounding blanks; two columns that
    become the same name are rejected. Rows without a time are dropped.
    """
    clean: dict[str, str] = {}
    for c in df.columns:
        name = c.strip().lower()
        if name in clean:
            raise ValueError(f"columns {clean[name]!r} and {c!r} have the same name")
        clean[name] = c
    df = df.withColumnsRenamed({old: new for new, old in clean.items()})
    ts = ts.strip().lower()
    names = [F.lit(symbol_name)] + [F.col(c) for c in ("symbol_name", "name") if c in df.columns]
    numbers = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    out = df.withColumns(numbers) if numbers else df
    return (out.withColumns({"eob": bar_end(F.to_timestamp(ts)),
                             "symbol_name": F.coalesce(*names)})
            .filter(F.col("eob").isNotNull()))


def bar_end(ts: Column) -> Column:
    """Date-only times mean the 15:00 close; other times are kept."""
    midnight = (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0)
    return F.when(midnight, ts + F.expr("INTERVAL 15 HOURS")).otherwise(ts)


def upsert_bars(arrivals: DataFrame, *, keys: Sequence[str] = ("symbol", "freq", "ts"),
                seq: str = "seq", partial: bool = False) -> DataFrame:
    """One row per key: the latest arrival wins; with ``partial`` each field's latest present
    value wins. An aggregate, not a window, so repeated corrections combine before the shuffle."""
    fields = [c for c in arrivals.columns if c not in (*keys, seq)]
    if partial:
        aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields]
        return arrivals.groupBy(*keys).agg(*aggs)
    latest = F.max_by(F.struct(*fields), seq).alias("_row")
    return arrivals.groupBy(*keys).agg(latest).select(*keys, "_row.*")


def last_rows(bars: DataFrame, n: int, fields: Sequence[str], *,
              keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """The newest ``n`` rows per series with a subset of fields; the time is always kept."""
    w = W.partitionBy(*keys).orderBy(F.col(ts).desc())
    cols = list(dict.fromkeys([*keys, ts, *fields]))
    return (bars.select(*cols).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))


def with_returns(bars: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("ts")
    prev = F.lag("close").over(w)
    return bars.withColumn("returns", F.when(prev != 0, F.col("close") / prev - 1))


def with_vwap(bars: DataFrame) -> DataFrame:
    return bars.withColumn("vwap", F.when(F.col("volume") > 0, F.col("amount") / F.col("volume"))
                           .otherwise(F.col("close")))


def derived(bars: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add only those derived columns that a feature asks for and the table lacks."""
    have, want = {c.lower() for c in bars.columns}, {n.lower() for n in names}
    if want & {"returns", "ret"} and "returns" not in have:
        bars = with_returns(bars)
    if "ret" in want and "ret" not in have:
        bars = bars.withColumn("ret", F.col("returns"))
    if "vwap" in want and "vwap" not in have:
        bars = with_vwap(bars)
    return bars


def bars_from_returns(returns: DataFrame, *, ret: str = "ret") -> DataFrame:
    """Synthetic bars: cumulative product of returns, missing return = 0, volume 1."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    level = F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(w)
    return (returns.select("symbol", "ts", level.alias("close"))
            .select("symbol", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low")],
                    "close", F.lit(1.0).alias("volume")))


def fill_calendar(bars: DataFrame) -> DataFrame:
    """Optional: a row for every symbol at every time of the table (NULL values where absent).

    The grid of symbols and times is as large as the result, and is joined with the bars on both.
    """
    grid = bars.select("symbol").distinct().crossJoin(bars.select("ts").distinct())
    return grid.join(bars, ["symbol", "ts"], "left")
