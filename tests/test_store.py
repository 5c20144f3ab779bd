import pytest
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.functions.cross_section import cs_rank
from quantloom.functions.feature import row
from quantloom.functions.rolling import rolling_apply
from quantloom.operators import explog
from quantloom.sources import store


def test_cache_exists_and_clear(spark, tmp_path):
    path = f"{tmp_path}/factors"
    rows = spark.createDataFrame([(f, n, s, f"2024-01-0{d}", 1.0) for f in "ab" for n in (5, 10) for s in "xy" for d in (1, 2)],
                                 "factor string, lookback int, symbol string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert not store.has_factor(spark, path, "a", 5)
    store.save_factors(rows, path)
    assert store.has_factor(spark, path, "a", 5) and not store.has_factor(spark, path, "a", 7)
    store.clear_factors(spark, path, "a", 5)
    assert not store.has_factor(spark, path, "a", 5) and store.load_factors(spark, path, "a", 10).count() == 4
    store.clear_factors(spark, path)
    assert not store.has_factor(spark, path, "b", 5) and not store.has_factor(spark, path, "b", 10)


def test_long_and_cyclic_lineage(spark):
    chain = [(f"t{i}", i, [f"t{i - 1}"] if i else None) for i in range(131)] + [("x", 1, ["y"]), ("y", 1, ["x"])]
    got = explog.lineage(spark.createDataFrame(chain, "template string, seq int, parent_templates array<string>"))
    rows = {(r.template, r.ancestor): r.distance for r in got.collect()}
    assert rows["t130", "t0"] == 130 and rows["x", "y"] == 1 and rows["x", "x"] == 0 and len(rows) == 131 * 132 // 2 + 4


def test_lineage_joins_no_more_pairs_than_there_are(spark, monkeypatch):
    sizes, nearest = [], explog._nearest
    monkeypatch.setattr(explog, "_nearest", lambda pairs: sizes.append(pairs.count()) or nearest(pairs))
    chain = [(f"t{i}", i, [f"t{i - 1}"] if i else None) for i in range(40)]
    got = explog.lineage(spark.createDataFrame(chain, "template string, seq int, parent_templates array<string>"))
    assert got.count() == 40 * 41 // 2 and max(sizes) == got.count()


@pytest.mark.parametrize("n", [1, 5, 6, 12])
def test_ranks_keep_repeated_keys(spark, n):
    rows = [("a", 1, 1.0, 5.0), ("a", 1, 3.0, 5.0), ("b", 1, 2.0, 4.0), ("a", 1, 3.0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double, y double")
    got = with_features(df, {f"r{i}": cs_rank(col("x") + float(i)) for i in range(n)}).collect()
    assert sorted((r.x, r[f"r{n - 1}"]) for r in got) == [(1.0, 0.25), (2.0, 0.5), (3.0, 0.75), (3.0, 0.75)]


def test_one_name_two_functions(spark):
    assert rolling_apply("f", col("x"), 2, F.array_max).key != rolling_apply("f", col("x"), 2, F.array_min).key
    assert row("g", lambda a: a + 1, col("x")).key != row("g", lambda a: a + 2, col("x")).key
    assert (col("x") + 1.0).key == (col("x") + 1.0).key and cs_rank(col("x")).key == cs_rank(col("x")).key


def test_ranks_of_a_date_share_one_sort(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "unread"), ("b", 1, 2.0, "unread")], "symbol string, ts int, x double, note string")
    out = with_features(df, {f"r{i}": cs_rank(col("x") + float(i)) for i in range(5)}, keep=["symbol"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan and "note" not in plan.split("MapInArrow")[1].split("Sort [")[0]
    assert sorted((r.symbol, r.r4) for r in out.collect()) == [("a", 0.5), ("b", 1.0)]


def test_several_ranks_of_texts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "symbol string, ts int, note string")
    got = with_features(df, {"r": cs_rank(col("note")), "q": cs_rank(col("symbol"))}, keep=["symbol"]).collect()
    assert sorted((r.symbol, r.r, r.q) for r in got) == [("a", 0.5, 0.5), ("b", 1.0, 1.0)]
