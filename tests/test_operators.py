"""Operators on small fixtures: behaviour that the table queries do not reach."""

from datetime import datetime, timedelta
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.functions import features as ft
from quantloom.functions import rolling as r
from quantloom.functions.cross_section import cs_rank, cs_scale
from quantloom.functions.indicators import ema
from quantloom.functions.presets import PRESETS, preset
from quantloom.functions.text import fill_template
from quantloom.operators import nav as nv
from quantloom.operators import portfolio as pf
from quantloom.operators import trades as tr
from quantloom.operators import validation as va
from quantloom.operators.fold import state_machine
from quantloom.operators.stats import _t_two_sided
from quantloom.plans import sweep as sw
from quantloom.plans.catalog import CATALOGS
from quantloom.plans.split import cs_rank_split, lookback, with_features_split
from quantloom.sources import bars as src
from quantloom.sources import store
from quantloom.streaming import flows

DAY0 = datetime(2020, 1, 1)


def days(n):
    return [DAY0 + timedelta(days=i) for i in range(n)]


def test_catalog_sizes():
    assert {k: len(v()) for k, v in CATALOGS.items()} == {
        "alpha101": 101, "alpha191": 190, "alpha158": 158, "basic": 20, "industry": 16}
    assert len(PRESETS) == 31 and len(ft.FEATURES) == 34


def test_preset_arity():
    with pytest.raises(ValueError):
        preset("macd", 12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40),
       st.integers(1, 6), st.integers(1, 7))
def test_split_equals_unsplit(spark, values, d, rows):
    df = spark.createDataFrame([("A", t, v) for t, v in zip(days(len(values)), values)],
                               "symbol string, ts timestamp, x double")
    f = {"m": r.ts_mean(r.ts_rank(col("x"), d), 3), "k": r.ts_argmax(col("x"), d), "l": r.ts_delay(col("x"), d)}
    a = with_features(df, f).orderBy("ts").collect()
    b = with_features_split(df, f, rows=rows, bucket="week").orderBy("ts").collect()
    assert a == b


def test_split_refuses_unbounded_history():
    assert lookback({"f": r.ts_mean(r.ts_delay(col("x"), 5), 10)}) == 14
    for f in (r.expanding_mean(col("x")), ema(col("x"), 5), cs_rank(col("x"))):
        with pytest.raises(ValueError):
            lookback({"f": f})


def test_rank_split_with_hot_ties(spark):
    rows = [("d", float(i % 7 if i % 3 else 1)) for i in range(600)] + [("e", 2.0), ("e", None)]
    df = spark.createDataFrame([(str(i), d, v) for i, (d, v) in enumerate(rows)], "symbol string, ts string, x double")
    want = with_features(df, {"r": cs_rank(col("x"))}).select("symbol", "r").toPandas().set_index("symbol").r.sort_index()
    got = cs_rank_split(df, "x", parts=5).select("symbol", "rank").toPandas().set_index("symbol")["rank"].sort_index()
    np.testing.assert_allclose(got, want)


def test_many_ranks_together_equal_single_ranks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame([(f"S{s}", t, *np.where(rng.random(8) < .1, np.nan, np.round(rng.normal(size=8), 1)))
                        for s in range(9) for t in days(6)], columns=["symbol", "ts", *"abcdefgh"])
    df = spark.createDataFrame(pdf).select("symbol", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcdefgh"])
    many = with_features(df, {f"r{c}": cs_rank(col(c)) for c in "abcdefgh"}, keep=["symbol", "ts"])
    for c in "abh":
        one = with_features(df, {"r": cs_rank(col(c))}, keep=["symbol", "ts"])
        a = many.orderBy("symbol", "ts").select(f"r{c}").collect()
        assert [x[0] for x in a] == [x[0] for x in one.orderBy("symbol", "ts").select("r").collect()]


def test_scale_sums_to_one(spark):
    df = spark.createDataFrame([(s, DAY0, float(v)) for s, v in zip("ABCD", (1, -2, 3, 4))], "symbol string, ts timestamp, x double")
    out = with_features(df, {"s": cs_scale(col("x"))}).agg(F.sum(F.abs("s"))).first()[0]
    assert out == pytest.approx(1.0)


def test_window_id_separates_panels(spark):
    df = spark.createDataFrame([("A", w, t, float(i)) for w in (0, 1) for i, t in enumerate(days(5))],
                               "symbol string, window_id int, ts timestamp, x double")
    out = with_features(df, {"m": r.ts_mean(col("x"), 3)}, symbol=["symbol", "window_id"])
    assert out.filter("m IS NULL").count() == 4


def test_one_exchange_per_change_of_direction(spark):
    df = spark.createDataFrame([("A", DAY0, 1.0)], "symbol string, ts timestamp, x double")
    f = {"a": r.ts_mean(cs_rank(r.ts_delay(col("x"), 1)), 3), "b": r.ts_max(cs_scale(r.ts_sum(col("x"), 2)), 4), "c": r.ts_std(col("x"), 9)}
    plan = with_features(df, f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_factor_registry(spark):
    from quantloom.functions import registry as reg

    @reg.factor("twice")
    def twice(bars):
        return bars.select("ts", "symbol", (F.col("x") * 2).alias("value"))
    df = spark.createDataFrame([("A", DAY0, 1.0)], "symbol string, ts timestamp, x double")
    assert reg.evaluate_factors(df, ["twice"]).first().value == 2.0
    with pytest.raises(ValueError):
        reg.factor("twice")(twice)
    reg.FACTORS.pop("twice")


# -- signals ------------------------------------------------------------------------------------------
def brute_machine(buy, sell, hold_max):
    held, out = 0, []
    for b, s in zip(buy, sell):
        if held == 0:
            held = 1 if b > 0 else 0
        else:
            held = 0 if s > 0 or held + 1 >= hold_max else held + 1
        out.append(1.0 if held else 0.0)
    return out


def test_state_machine_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 3000
    rows = pd.DataFrame([(s, t, float(rng.random() < .2), float(rng.random() < .1)) for s in "AB" for t in days(n)],
                        columns=["symbol", "ts", "buy", "sell"])
    df = spark.createDataFrame(rows)
    batch = state_machine(df, max_hold=9).orderBy("symbol", "ts").toPandas()
    want = [x for s in "AB" for x in brute_machine(rows[rows.symbol == s].buy, rows[rows.symbol == s].sell, 9)]
    assert batch.position.tolist() == want
    for i, (lo, hi) in enumerate([("2020-01-01", "2022-06-01"), ("2022-06-01", "2040-01-01")]):
        df.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        flows.run_available(flows.state_machine(stream, 9), str(tmp_path / "cp"), path=str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("symbol", "ts").toPandas()
    assert got.position.tolist() == want


# -- portfolio ------------------------------------------------------------------------------------------
def test_equal_risk_contributions():
    rng = np.random.default_rng(2)
    cov = np.cov(rng.normal(size=(5, 300)) * np.arange(1, 6)[:, None])
    w = pf._equal_risk(cov)
    risk = w * (cov @ w)
    assert w.sum() == pytest.approx(1) and np.ptp(risk / risk.sum()) < 1e-8


def test_constant_weights_nav_is_a_product(spark):
    rets = [0.5, 0.01, -0.02, 0.03, None]
    returns = spark.createDataFrame([("A", t, x) for t, x in zip(days(5), rets)], "symbol string, ts timestamp, ret double")
    w = spark.createDataFrame([("s", DAY0, "A", 1.0)], "strategy_id string, ts timestamp, symbol string, weight double")
    nav = [x.nav for x in pf.rotation_nav(w, returns, commission=.1).orderBy("ts").collect()]
    np.testing.assert_allclose(nav, np.cumprod([1, 1.01, .98, 1.03, 1]))


def test_partial_sells_use_average_cost(spark):
    log = [(1, 10, 100.0, 1.0), (1, 10, 110.0, 1.0), (2, 5, 120.0, 1.0), (2, 15, 90.0, 1.0), (2, 5, 90.0, 1.0), (1, 1, 50.0, 0.0)]
    df = spark.createDataFrame([("a", "X", t, i, s, float(v), p, f) for i, (t, (s, v, p, f)) in enumerate(zip(days(6), log))],
                               "account string, symbol string, created_at timestamp, seq int, side int, volume double, price double, fee double")
    trips = tr.round_trips(df).orderBy("close_time").collect()
    cost = 10 * 100 + 1 + 10 * 110 + 1
    assert [round(t.profit, 6) for t in trips] == [round(5 * 120 - cost / 4 - 1, 6), round(15 * 90 - cost * .75 - 1, 6)]


def test_nav_edge_cases(spark):
    up = [("up", t, 1.0 + i) for i, t in enumerate(days(5))]
    down = [("down", t, 5.0 - i) for i, t in enumerate(days(5))]
    df = spark.createDataFrame(up + down, "strategy_id string, ts timestamp, nav double")
    m = {x.strategy_id: x for x in nv.metrics(df).collect()}
    assert m["up"].max_drawdown is None and m["up"].calmar is None and m["up"].sortino == float("inf")
    assert m["down"].max_drawdown == pytest.approx(-.8) and m["down"].recovery_rows is None and m["down"].drawdown_rows == 4


def test_custom_metric(spark):
    nv.metric("double_return", label="Twice")(lambda: F.col("total_return") * 2)
    try:
        df = spark.createDataFrame([("s", t, 1.0 + i) for i, t in enumerate(days(3))], "strategy_id string, ts timestamp, nav double")
        row = nv.metrics(df).first()
        assert row.double_return == pytest.approx(4.0)
        assert nv.metric_rows(nv.metrics(df)).filter("name = 'double_return'").count() == 1
    finally:
        nv.METRICS.pop("double_return")


def test_holding_ratio_and_calendar_parsing():
    assert pf.parse_frequency("5D") == ("interval", 5) and pf.parse_frequency("ME") == ("fixed", None)
    with pytest.raises(ValueError):
        pf.parse_frequency("Q")


# -- validation -------------------------------------------------------------------------------------------
def test_t_distribution():
    # table values of Student's t
    assert _t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert _t_two_sided(0.0, 5) == 1.0
    assert _t_two_sided(1.96, 1e6) == pytest.approx(0.05, abs=1e-4)


def test_quantile_groups_match_qcut(spark):
    v = np.random.default_rng(0).normal(size=23)
    df = spark.createDataFrame([("f", f"{i:02d}", DAY0, float(x)) for i, x in enumerate(v)], "factor_id string, symbol string, ts timestamp, value double")
    got = va.quantile_groups(df, 10).orderBy("symbol").toPandas().group
    want = pd.qcut(pd.Series(v).rank(method="first"), 10, labels=False) + 1
    assert got.tolist() == want.tolist()


def test_bootstrap_is_repeatable_and_centred(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": days(900), "ret": rng.normal(.001, .01, 900)}))
    a, b = (va.bootstrap_sharpe(df, ["symbol"], draws=300).first() for _ in range(2))
    assert a == b and a.draws == 300 and a.low < a.mean < a.high


@pytest.mark.parametrize("monthly", [True, False])
def test_bootstrap_draws_are_no_rows_of_a_join(spark, monthly):
    rng = np.random.default_rng(5)
    rows = [(s, d, float(r)) for s, n in (("a", 500), ("b", 600), ("short", 19)) for d, r in zip(days(n), rng.normal(.001, .01, n))]
    rows += [("same", d, 0.0) for d in days(500)] + [(None, d, .01 * (i % 2)) for i, d in enumerate(days(500))] + [("a", days(1)[0], None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    out = va.bootstrap_sharpe(df, ["symbol"], draws=120, monthly=monthly)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.symbol: r for r in out.collect()}
    assert sorted(got) == ["a", "b"]
    for s, r in got.items():
        x = pd.Series({d: v for k, d, v in rows if k == s and v is not None})
        x = (((1 + x).groupby(x.index.to_period("M")).prod() - 1) if monthly else x.sort_index()).to_numpy()
        picks = [[int(md5(f"7-{d}-{i}".encode()).hexdigest()[:8], 16) % len(x) for i in range(len(x))] for d in range(1, 121)]
        v = [x[p].mean() / x[p].std(ddof=1) * (12 if monthly else 252) ** .5 for p in picks]
        want = [120, np.mean(v), np.std(v), *np.quantile(v, [.025, .975])]
        assert [r.draws, r["mean"], r["std"], r.low, r.high] == pytest.approx(want, abs=1e-9)


# -- walk-forward and sources -----------------------------------------------------------------------------
def test_windows():
    w = sw.windows(datetime(2000, 1, 31), datetime(2004, 1, 31), "1Y", "1Y", "6M")
    assert w[0] == (datetime(2000, 1, 31), datetime(2001, 1, 31), datetime(2002, 1, 31))
    assert sw.add_offset(datetime(2000, 1, 31), "1M") == datetime(2000, 2, 29)
    assert len(sw.windows(datetime(2000, 1, 1), datetime(2004, 1, 1), "1Y", "1Y", "1Y", anchored=True)) == 3
    assert sw.offset_days("2Y") == timedelta(days=730)
    assert sw.draws(3, 1, d=(2, 9)) == sw.draws(3, 1, d=(2, 9))
    assert fill_template("EMA(?, ?)", 1, 2) == "EMA(1, 2)"


def test_standardize(spark):
    df = spark.createDataFrame([("2020-01-01", float("nan"), "n"), (None, 1.0, "n"), ("2020-01-02 10:00:00", 2.0, "n")],
                               "TS string, Close double, name string")
    rows = src.standardize(df, ts="TS").orderBy("eob").collect()
    assert [x.eob for x in rows] == [datetime(2020, 1, 1, 15), datetime(2020, 1, 2, 10)] and rows[0].close is None
    with pytest.raises(ValueError):
        src.standardize(df.withColumn(" ts", F.lit(1)), ts="ts")


def test_records_skip_broken_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"template": "a", "metrics": {"m": 1.5}}\n{"template": \n{"template": "b"}\n')
    assert sorted(x.template for x in store.read_records(spark, str(tmp_path)).collect()) == ["a", "b"]
    assert store.broken_records(spark, str(tmp_path)).count() == 1


def test_report_formats(spark, tmp_path):
    df = spark.range(3)
    store.save_report(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
