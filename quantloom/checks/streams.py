"""Streaming queries: the events file replayed as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.checks.base import HOUR_SQL, check, rsql
from quantloom.sources.store import scratch
from quantloom.streaming import flows


def ticks(spark, path):
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def to_files(spark, stream, mode="append"):
    folder = scratch(spark, "stream")
    flows.run_available(stream, f"{folder}/checkpoint", path=f"{folder}/out", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def to_updates(spark, stream, keys, mode="update"):
    folder = scratch(spark, "stream")
    flows.run_available(stream, f"{folder}/checkpoint", mode=mode, sink=flows.append_corrections(f"{folder}/out"))
    return flows.latest_updates(spark, f"{folder}/out", keys)


@check("stream_bars_from_ticks", f"WITH b AS ({HOUR_SQL}) SELECT symbol, ts, open, high, low, close, volume::DOUBLE AS volume FROM b")
def _(spark, path):
    # in update mode a bar comes with each change, the running one too; its last state counts
    bars = flows.bars_from_ticks(ticks(spark, path), symbol="event_type", price="value", order="event_id")
    return to_updates(spark, bars, ["symbol", "ts"])


@check("stream_bars_closed", f"""WITH b AS ({HOUR_SQL}) SELECT symbol, ts, open, high, low, close, volume::DOUBLE AS volume FROM b
  WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def _(spark, path):
    return to_files(spark, flows.bars_from_ticks(ticks(spark, path), symbol="event_type", price="value", order="event_id"))


@check("stream_dedup", "SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts)::TIMESTAMP AS ts FROM events")
def _(spark, path):
    t = ticks(spark, path).select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").alias("ts"))
    return to_files(spark, flows.dedup_bars(t, "40 days", ("symbol", "ts")))


@check("stream_upsert_corrections", """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def _(spark, path):
    t = ticks(spark, path).select(F.col("event_type").alias("symbol"), F.date_trunc("day", "ts").alias("ts"), "value", F.col("event_id").alias("seq"))
    folder = scratch(spark, "stream")
    flows.run_available(t, f"{folder}/checkpoint", sink=flows.append_corrections(f"{folder}/out"))
    return flows.current_bars(spark, f"{folder}/out", ("symbol", "ts"))


@check("stream_latest_price", "SELECT event_type AS symbol, arg_max(value, ts) AS price, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, path):
    t = ticks(spark, path).withColumnRenamed("event_type", "symbol")
    return to_updates(spark, flows.latest_price(t, price="value"), ["symbol"])


@check("stream_daily_mark", """SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, arg_max(value, ts) AS nav FROM events GROUP BY 1, 2""")
def _(spark, path):
    t = ticks(spark, path).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("nav"))
    return to_updates(spark, flows.daily_mark(t, by=["symbol"]), ["symbol", "day"])


@check("stream_last_n", f"""SELECT event_type AS symbol, max(ts) AS ts, {rsql('list_sum(list(value ORDER BY ts DESC)[1:5])')} AS total FROM events GROUP BY 1""")
def _(spark, path):
    t = ticks(spark, path).withColumnRenamed("event_type", "symbol")
    out = to_updates(spark, flows.last_n(t, 5, "value"), ["symbol"])
    return out.select("symbol", "ts", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@check("stream_level_one", """SELECT event_type AS symbol, ts, event_id, CASE WHEN user_id % 4 <> 0 THEN value END AS bid_p FROM events""")
def _(spark, path):
    q = F.struct(F.col("value").alias("bid_p"), F.lit(1.0).alias("bid_v"), (F.col("value") + 1).alias("ask_p"), F.lit(1.0).alias("ask_v"))
    quotes = F.when(F.col("user_id") % 4 != 0, F.array(q))
    t = ticks(spark, path).select(F.col("event_type").alias("symbol"), "ts", "event_id", quotes.alias("quotes"))
    return to_files(spark, flows.level_one(t)).select("symbol", "ts", "event_id", "bid_p")


@check("stream_state_machine", """WITH RECURSIVE s AS (SELECT event_type AS symbol, event_id, ts, value > 60 AS b, value < 5 AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
m(symbol, rn, hold) AS (SELECT symbol, rn, b::INT FROM s WHERE rn = 1 UNION ALL
  SELECT s.symbol, s.rn, CASE WHEN m.hold = 0 THEN s.b::INT WHEN s.e OR m.hold + 1 >= 12 THEN 0 ELSE m.hold + 1 END FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1)
SELECT s.symbol, s.ts, CAST((hold > 0)::INT AS DOUBLE) AS position FROM m JOIN s USING (symbol, rn)""")
def _(spark, path):
    t = ticks(spark, path).select(F.col("event_type").alias("symbol"), "ts", F.when(F.col("value") > 60, 1.0).otherwise(0.0).alias("buy"),
                                  F.when(F.col("value") < 5, 1.0).otherwise(0.0).alias("sell"))
    return to_files(spark, flows.state_machine(t, 12))


