"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.sources.bars import upsert_bars


def dedup_bars(bars: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("symbol", "freq", "ts")) -> DataFrame:
    """First arrival per bar; keys are forgotten once the watermark has passed them."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def bars_from_ticks(ticks: DataFrame, *, symbol: str, price: str, order: str, width: str = "1 hour",
                    delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a tick stream; a bar is emitted when the watermark passes its end."""
    w = F.window("ts", width)
    return (ticks.withWatermark("ts", delay).groupBy(w, F.col(symbol).alias("symbol")).agg(
        F.min_by(price, F.struct("ts", order)).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, F.struct("ts", order)).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume"))


def daily_mark(values: DataFrame, *, by: Sequence[str], value: str = "nav", delay: str = "1 hour") -> DataFrame:
    """Last value per day."""
    return (values.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), *by)
            .agg(F.max_by(value, "ts").alias(value)).select(*by, F.col("window.start").alias("day"), value))


def latest_price(bars: DataFrame, *, by: Sequence[str] = ("symbol",), price: str = "close") -> DataFrame:
    """Latest price per symbol, for update mode: state is one row per symbol."""
    return bars.groupBy(*by).agg(F.max_by(price, "ts").alias("price"), F.max("ts").alias("ts"))


def level_one(ticks: DataFrame, quotes: str = "quotes") -> DataFrame:
    """Best quote of each tick as columns; missing when there are no quotes."""
    best = F.get(quotes, F.lit(0))
    return ticks.select("*", *[best[f].alias(f) for f in ("bid_p", "bid_v", "ask_p", "ask_v")]).drop(quotes)


def _sorted(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch by time; the batch size bounds them."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values("ts", kind="stable")


def last_n(rows: DataFrame, n: int, value: str, key: str = "symbol") -> DataFrame:
    """Per update the newest ``n`` values of a key in time order; older late rows fill free places only.

    State: n times and n values per key.
    """
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("ts", T.TimestampType()),
                        T.StructField("values", T.ArrayType(T.DoubleType()))])
    state = T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def step(k, pdfs: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        times, values = ([list(x) for x in s.get] if s.exists else [[], []])
        new = _sorted(pdfs)
        merged = sorted(zip([*times, *(int(t.value) for t in new["ts"])], [*values, *new[value]]), key=lambda p: p[0])[-n:]
        times, values = [p[0] for p in merged], [float(p[1]) for p in merged]
        s.update((times, values))
        yield pd.DataFrame({key: [k[0]], "ts": [pd.Timestamp(times[-1])], "values": [values]})
    return rows.select(key, "ts", value).groupBy(key).applyInPandasWithState(
        step, out, state, "update", GroupStateTimeout.NoTimeout)


def state_machine(signals: DataFrame, max_hold: int | None = None, key: str = "symbol") -> DataFrame:
    """Online BUY/SELL machine over ``(symbol, ts, buy, sell)``; the state is the bars held."""
    limit = float("inf") if max_hold is None else max_hold
    out = T.StructType([T.StructField(key, signals.schema[key].dataType), T.StructField("ts", T.TimestampType()),
                        T.StructField("position", T.DoubleType())])
    state = T.StructType([T.StructField("held", T.IntegerType())])

    def step(k, pdfs: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        held = s.get[0] if s.exists else 0
        rows = _sorted(pdfs)
        pos = []
        for b, e in zip(rows["buy"], rows["sell"]):
            if held == 0:
                held = 1 if b > 0 else 0
            else:
                held = 0 if (e > 0 or held + 1 >= limit) else held + 1
            pos.append(1.0 if held else 0.0)
        s.update((held,))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy(), "position": pos})
    return signals.select(key, "ts", "buy", "sell").groupBy(key).applyInPandasWithState(
        step, out, state, "append", GroupStateTimeout.NoTimeout)


# -- sinks ------------------------------------------------------------------------------------------------
def append_corrections(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch becomes one folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def current_bars(spark: SparkSession, path: str, keys: Sequence[str] = ("symbol", "freq", "ts"), seq: str = "seq") -> DataFrame:
    """Bars after all corrections: the latest arrival per key."""
    return upsert_bars(spark.read.parquet(path).drop("batch"), keys=keys, seq=seq)


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last update per key of an update-mode stream stored by :func:`append_corrections`."""
    x = spark.read.parquet(path)
    fields = [c for c in x.columns if c not in (*keys, "batch")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("_r")).select(*keys, "_r.*")


def run_available(stream: DataFrame, checkpoint: str, *, path: str | None = None, mode: str = "append",
                  sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Process everything that is available, then stop: parquet files or a foreachBatch sink."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink is not None else w.format("parquet").option("path", path).start()
    q.awaitTermination()
    return q
