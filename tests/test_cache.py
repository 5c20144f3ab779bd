from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.sources import cache

DAY0 = datetime(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=6), st.integers(0, 20), st.integers(0, 20))
def test_gaps(spans, a, b):
    covered = {d for x, y in spans for d in range(x, y)}
    got = cache.gaps_in([(day(x), day(y)) for x, y in spans], day(a), day(b))
    days = [d for x, y in got for d in range((x - DAY0).days, (y - DAY0).days)]
    assert days == [d for d in range(a, b) if d not in covered]
    assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


@pytest.fixture
def bars(spark):
    return spark.range(60).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("symbol"),
                                  F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id / 2))").alias("ts"), F.col("id").cast("double").alias("value"))


def test_requests_compute_their_gaps_alone(spark, bars, tmp_path):
    asked = []

    def compute(a, b):
        asked.append(((a - DAY0).days, (b - DAY0).days))
        return bars  # more than asked for: the rest is not stored

    def get(a, b, factor="f", lookback=5):
        rows = cache.cached(spark, str(tmp_path), factor, lookback, day(a), day(b), compute).collect()
        assert sorted(r.value for r in rows) == [float(i) for i in range(2 * a, 2 * b)]
        return len(asked)
    assert get(10, 15) == 1 and asked == [(10, 15)]
    assert get(10, 15) == 1 and get(11, 14) == 1           # exact and inner hits
    assert get(12, 20) == 2 and asked[-1] == (15, 20)      # overlap
    assert get(5, 25) == 4 and asked[2:] == [(5, 10), (20, 25)]
    assert get(5, 25) == 4 and get(10, 12, "g") == 5 and get(10, 12, "f", 9) == 6
    assert cache.stored(spark, str(tmp_path)).count() == 6


def test_an_empty_interval_is_remembered(spark, bars, tmp_path):
    calls = []
    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "f", 1, day(100), day(110), lambda a, b: calls.append(1) or bars).count() == 0
    assert len(calls) == 1


def test_values_without_index_do_not_count(spark, bars, tmp_path):
    cache.put(bars, str(tmp_path), "f", 1, day(0), day(5))
    bars.select("symbol", "ts", "value", F.lit("f").alias("factor"), F.lit(1).alias("lookback"), F.lit("broken").alias("part")).write.mode(
        "append").partitionBy("factor", "lookback", "part").parquet(f"{tmp_path}/values")
    got = cache.cached(spark, str(tmp_path), "f", 1, day(0), day(8), lambda a, b: bars)
    assert sorted(r.value for r in got.collect()) == [float(i) for i in range(16)]
