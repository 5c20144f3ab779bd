"""Alignment and lookup joins on panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align_inner(panel: DataFrame, value: str = "value") -> DataFrame:
    """Rows of those dates on which every symbol of the panel has a value."""
    present = panel.filter(F.col(value).isNotNull())
    n = panel.agg(F.count_distinct("symbol").alias("_n"))
    full = (present.groupBy("ts").agg(F.count_distinct("symbol").alias("_c"))
            .join(F.broadcast(n)).filter(F.col("_c") == F.col("_n")).select("ts"))
    return panel.join(full, "ts", "left_semi")


def common_dates(panels: DataFrame, group: str) -> DataFrame:
    """Dates that occur in every group (style, signal) of a long table."""
    n = panels.agg(F.count_distinct(group).alias("_n"))
    return (panels.groupBy("ts").agg(F.count_distinct(group).alias("_c"))
            .join(F.broadcast(n)).filter(F.col("_c") == F.col("_n")).select("ts"))


def reindex(bars: DataFrame, signal: DataFrame, value: str = "signal",
            on: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Signal on the bars' rows; rows without a signal get 0."""
    right = signal.select(*on, value)
    return bars.join(right, list(on), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def join_benchmark(strategy: DataFrame, benchmark: DataFrame, value: str = "bench") -> DataFrame:
    """Benchmark on strategy dates: dates before its first one take the first value, dates after
    its last one or without a value are dropped."""
    ends = benchmark.agg(F.min_by(value, "ts").alias("_first"), F.min("ts").alias("_from"))
    joined = strategy.join(benchmark.select("ts", value), "ts", "left").join(F.broadcast(ends))
    early = F.when(F.col("ts") < F.col("_from"), F.col("_first"))
    return (joined.withColumn(value, F.coalesce(F.col(value), early))
            .filter(F.col(value).isNotNull()).drop("_first", "_from"))


def asof(left: DataFrame, right: DataFrame, *, by: Sequence[str], ts: str, values: Sequence[str],
         order: str | None = None, bucket: str = "day", strict: bool = False) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time.

    Keys are split by calendar ``bucket``: inside a bucket a window looks back, across buckets only
    the last right row per bucket is carried. No key is handled by one task alone, and the carried
    table has one row per key and bucket. ``order`` breaks ties of equal right times; ``strict``
    looks only before the left time.
    """
    by = list(by)
    payload = F.struct(F.col(ts).alias("_at"), *([F.col(order).alias("_o")] if order else []),
                       *[F.col(v).alias(v) for v in values])
    r = right.select(*by, F.col(ts).alias("_t"), payload.alias("_r"))
    l = left.withColumnRenamed(ts, "_t").select(*by, "_t", F.struct(
        *[c for c in left.columns if c not in (*by, ts)]).alias("_l"))
    side = F.lit(0 if strict else 2)
    both = (l.select(*by, "_t", "_l", side.alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"))
            .unionByName(r.select(*by, "_t", F.lit(None).cast(l.schema["_l"].dataType).alias("_l"),
                                  F.lit(1).alias("_side"), "_r"))
            .withColumn("_bucket", F.date_trunc(bucket, "_t")))
    # F.max of the struct compares the time first: a running maximum is the latest row
    inside = W.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    seen = both.withColumn("_in", F.max("_r").over(inside)).filter(F.col("_side") != 1)
    ends = (r.withColumn("_bucket", F.date_trunc(bucket, "_t")).groupBy(*by, "_bucket")
            .agg(F.max("_r").alias("_end")))
    # carry the last known row over the buckets in which the key has left or right rows
    marks = (seen.select(*by, "_bucket").distinct().join(ends, [*by, "_bucket"], "full"))
    carried = marks.select(*by, "_bucket", F.max("_end").over(
        W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    out = seen.join(carried, [*by, "_bucket"], "left")
    found = F.coalesce("_in", "_carry")
    return out.select(*by, F.col("_t").alias(ts), "_l.*", *[found[v].alias(v) for v in values])


def latest_price(bars: DataFrame, at: DataFrame, freqs: Sequence[str]) -> DataFrame:
    """Latest positive close per symbol at each time, from the finest frequency that has one.

    ``freqs`` lists frequencies from fine to coarse.
    """
    usable = bars.filter(F.col("close") > 0)
    out = at
    for i, f in enumerate(freqs):
        out = asof(out, usable.filter(F.col("freq") == f).withColumnRenamed("close", f"_p{i}"),
                   by=["symbol"], ts="ts", values=[f"_p{i}"])
    return out.withColumn("price", F.coalesce(*[F.col(f"_p{i}") for i in range(len(freqs))])).drop(
        *[f"_p{i}" for i in range(len(freqs))])


def carry_forward(df: DataFrame, value: str, *, by: Sequence[str], ts: str = "ts",
                  before: bool = True) -> DataFrame:
    """Last present value strictly before each row (or up to it with ``before=False``)."""
    end = -1 if before else 0
    w = W.partitionBy(*by).orderBy(ts).rowsBetween(W.unboundedPreceding, end)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def with_fundamentals(bars: DataFrame, fundamentals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fundamental columns (valuation, turnover ratio, capital) of the same symbol and date."""
    return bars.join(fundamentals.select("symbol", "ts", *columns), ["symbol", "ts"], "left")


def window_ids(ts: Column, start: Column, step_days: int, length_days: int,
               inclusive: bool = False) -> Column:
    """Numbers of the sliding day windows that contain a time, as an array (no range join)."""
    days = F.datediff(ts, start)
    last = F.floor(days / step_days)
    first = F.ceil((days - length_days + (0 if inclusive else 1)) / F.lit(step_days))
    first = F.greatest(first, F.lit(0))
    return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(
        F.array().cast("array<int>"))


def symbol_union(*tables: DataFrame) -> DataFrame:
    """Distinct symbols of several tables."""
    out = tables[0].select("symbol")
    for t in tables[1:]:
        out = out.unionByName(t.select("symbol"))
    return out.distinct()


def date_intersection(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("ts")
    for t in tables[1:]:
        out = out.intersect(t.select("ts"))
    return out.distinct()


def align_outer(a: DataFrame, b: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """All dates of either side."""
    return a.join(b, list(on), "full")


def only_in(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b`` (positions to exit)."""
    return a.join(b.select(*on), list(on), "left_anti")


def keep_first(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Union by name in which the first table (then the first row by content) wins a key."""
    parts = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    fields = [c for c in out.columns if c not in (key, "_src")]
    return out.groupBy(key).agg(F.min(F.struct("_src", *fields)).alias("_r")).select(
        key, *[F.col("_r")[c].alias(c) for c in fields])
