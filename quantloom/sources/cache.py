"""Factor values by interval of time: a request computes only what no earlier one has covered.

Values lie in a folder per factor, look-back and stored interval. The index, one row a stored interval, is written after
the values, so an interrupted request leaves nothing that a reader would take for complete. Intervals are half open:
``start <= ts < end``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEX = "factor string, lookback int, part string, start timestamp, end timestamp"
_VALUES = "symbol string, ts timestamp, value double, factor string, lookback int, part string"
Span = tuple[datetime, datetime]


def union_of(spans: list[Span]) -> list[Span]:
    """Ascending, disjoint intervals that do not touch."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        elif start < end:
            out.append((start, end))
    return out


def gaps_in(spans: list[Span], start: datetime, end: datetime) -> list[Span]:
    """What of ``start .. end`` no interval of ``spans`` covers, ascending."""
    out, at = [], start
    for a, b in union_of(spans):
        if at < min(a, end):
            out.append((at, min(a, end)))
        at = max(at, b)
    return [*out, (at, end)] if at < end else out


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """``factor, lookback, part, start, end`` of all stored intervals."""
    folder = f"{path.rstrip('/')}/index"
    return spark.read.schema(_INDEX).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], _INDEX)


def _parts(spark: SparkSession, path: str, factor: str, lookback: int, start: datetime, end: datetime) -> list:
    x = stored(spark, path).filter((F.col("factor") == factor) & (F.col("lookback") == lookback))
    return x.filter((F.col("start") < F.lit(end)) & (F.col("end") > F.lit(start))).collect()  # as many rows as requests made


def put(values: DataFrame, path: str, factor: str, lookback: int, start: datetime, end: datetime) -> None:
    """Store the values ``(symbol, ts, value)`` of an interval, then index it, an empty one too."""
    spark, part = values.sparkSession, uuid.uuid4().hex
    x = values.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    x = x.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"),
                 F.lit(factor).alias("factor"), F.lit(lookback).alias("lookback"), F.lit(part).alias("part"))
    x.write.mode("append").partitionBy("factor", "lookback", "part").parquet(f"{path.rstrip('/')}/values")
    row = spark.createDataFrame([(factor, lookback, part, start, end)], _INDEX)
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/index")


def cached(spark: SparkSession, path: str, factor: str, lookback: int, start: datetime, end: datetime,
           compute: Callable[[datetime, datetime], DataFrame]) -> DataFrame:
    """``symbol, ts, value`` of ``start <= ts < end``; ``compute(a, b)`` gives each stretch that is not stored yet.

    Only folders of stored intervals that meet the request are read, and times are filtered in the scan.
    """
    held = _parts(spark, path, factor, lookback, start, end)
    for a, b in gaps_in([(r.start, r.end) for r in held], start, end):
        put(compute(a, b), path, factor, lookback, a, b)
    parts = [r.part for r in _parts(spark, path, factor, lookback, start, end)]
    schema = T.StructType.fromDDL(_VALUES)
    folder = f"{path.rstrip('/')}/values"
    x = spark.read.schema(schema).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)
    mine = (F.col("factor") == factor) & (F.col("lookback") == lookback) & F.col("part").isin(parts)
    return x.filter(mine & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).select("symbol", "ts", "value")
