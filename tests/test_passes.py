"""Functions of whole series against loops: order statistics, recurrences, state machine, round trips."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.functions import indicators as ta
from quantloom.functions import rolling as r
from quantloom.functions.cross_section import cs_rank
from quantloom.operators import fold, trades
from quantloom.plans import passes
from quantloom.plans.orderstats import Wavelet
from quantloom.plans.scans import affine_scan
from quantloom.plans.split import with_features_split


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_wavelet(values, data):
    v = np.array(values, float)
    w = Wavelet(v)
    lo = data.draw(st.integers(0, len(v) - 1))
    hi = data.draw(st.integers(lo + 1, len(v)))
    k = data.draw(st.integers(0, hi - lo - 1))
    bound = float(data.draw(st.integers(-1, 11)))
    one = [np.array([x]) for x in (lo, hi)]
    assert w.kth(*one, np.array([k]))[0] == np.sort(v[lo:hi])[k]
    assert w.below(*one, np.array([bound]))[0] == (v[lo:hi] < bound).sum()
    assert w.below(*one, np.array([bound]), "right")[0] == (v[lo:hi] <= bound).sum()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.5, -2.0, 1.0, 0.97, np.nan]), st.sampled_from([0.0, 1.0, -3.5, np.nan, 2.0]), st.booleans()), min_size=1, max_size=80))
def test_affine_scan(rows):
    a, b = (np.array([x[i] for x in rows]) for i in (0, 1))
    start = np.maximum.accumulate(np.where([x[2] or i == 0 for i, x in enumerate(rows)], np.arange(len(rows)), 0))
    y, run = affine_scan(a, b, start)
    s, p = 0.0, 1.0
    for i in range(len(rows)):
        if start[i] == i:
            s, p = 0.0, 1.0
        s, p = (a[i] * s + b[i], p * a[i]) if not np.isnan(s + a[i] + b[i]) else (np.nan, np.nan)
        assert np.isclose(y[i], s, rtol=1e-9, equal_nan=True) and np.isclose(run[i], p, rtol=1e-9, equal_nan=True)


def series(spark, sizes, seed=1, gaps=0.1):
    rng = np.random.default_rng(seed)
    rows = [(s, i, float(rng.integers(0, 30)) if rng.random() > gaps else None, 10.0 + float(rng.random())) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts int, x double, y double")


@pytest.mark.parametrize("rows", [1, 50, 1 << 16])
def test_order_statistics(spark, monkeypatch, rows):
    monkeypatch.setattr(passes, "ROWS", rows)
    df = series(spark, {"a": 90, "b": 1, "c": 40, "d": 7}).withColumnRenamed("y", "_i0").repartition(5)
    x = col("x")
    fs = {"med": r.ts_median(x, 5), "q": r.ts_quantile(x, 7, 0.3), "rank": r.ts_rank(x, 6), "rank0": r.ts_rank0(x, 6), "emed": r.expanding_median(x, 4),
          "ep": r.expanding_percentile(x, 0.8, 3), "el": r.expanding_percentile_linear(x, 0.3, 5), "er": r.expanding_rank(x, 3),
          "later": r.ts_mean(r.ts_median(x, 5), 3), "ranked": cs_rank(r.ts_median(x, 5)), "sum": r.ts_median(x, 5) + r.expanding_median(x, 4)}
    got = with_features(df, fs).toPandas().set_index(["symbol", "ts"]).sort_index()
    for _, g in got.groupby(level=0):
        v = g["x"]
        assert np.allclose(g["med"], v.rolling(5, min_periods=0).median().where(np.arange(len(v)) >= 4), equal_nan=True)
        assert np.allclose(g["emed"], v.expanding().median().where(np.arange(len(v)) >= 3), equal_nan=True)
        assert np.allclose(g["el"], v.expanding().quantile(0.3).where(np.arange(len(v)) >= 5), equal_nan=True)
        assert np.allclose(g["sum"].dropna(), (g["med"] + g["emed"]).dropna())
        for i in range(len(v)):
            w = lambda d: v.iloc[max(0, i + 1 - d):i + 1].dropna().sort_values().to_numpy()
            near = lambda s, p: s[max(int(np.ceil(p * len(s))), 1) - 1] if len(s) else np.nan
            own = v.iloc[i]
            want = {"q": near(w(7), 0.3) if i >= 6 else np.nan, "ep": near(w(10**6), 0.8) if i >= 2 else np.nan,
                    "rank": ((w(6) < own).sum() + 1) / len(w(6)) if i >= 5 and own == own else np.nan,
                    "rank0": (w(6) < own).sum() / len(w(6)) if i >= 5 and own == own else np.nan,
                    "er": (v.iloc[:i + 1].fillna(0) <= (own if own == own else 0)).sum() / (i + 1) if i >= 3 else 0.5}
            for k, value in want.items():
                assert np.isclose(g[k].iloc[i], value, equal_nan=True), (k, i)


def test_million_row_series(spark):
    df = spark.range(1_000_000).selectExpr("'one' as symbol", "id as ts", "cast(xxhash64(id) % 1000003 as double) as x")
    got = with_features(df, {"m": r.expanding_median(col("x"), 1), "k": r.expanding_rank(col("x"), 0)}, keep=["ts", "x"]).filter("ts % 99991 = 7 or ts = 999999").toPandas()
    x = df.toPandas()["x"].to_numpy()
    for row in got.itertuples():
        assert np.isclose(row.m, np.median(x[:row.ts + 1])) and np.isclose(row.k, (x[:row.ts + 1] <= row.x).mean())


def test_smoothed_split_equals_unsplit(spark):
    df = series(spark, {"a": 400, "b": 35, "c": 3}, gaps=0).withColumn("ts", F.timestamp_seconds(F.col("ts") * 3600))
    y, h, low = col("y"), col("y") + 1, col("y") - 1
    fs = {"ema": ta.ema(y, 10), "dema": ta.dema(y, 7), "macd": ta.macd(y, 3, 8, 4), "adx": ta.adx(h, low, y, 5), "kama": ta.kama(y, 6), "rsi": ta.rsi(y, 5),
          "atr": ta.atr(h, low, y, 5), "own": ta.wilder_smooth(col("y"), 1)}
    whole = with_features(df, fs).toPandas().sort_values(["symbol", "ts"])
    for rows in (37, 1000):
        split = with_features_split(df, fs, rows=rows).toPandas().sort_values(["symbol", "ts"])
        for k in fs:
            assert np.allclose(whole[k].astype(float), split[k].astype(float), equal_nan=True), (k, rows)
            assert whole[k].notna().sum() > 300


def test_missing_value_ends_an_average(spark):
    rows = [("a", i, None if i in (2, 30) else float(i)) for i in range(50)] + [("b", i, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double")
    got = with_features(df, {"e": ta.ema(col("x"), 5, 4), "k": ta.kama(col("x"), 5)}).toPandas().sort_values(["symbol", "ts"])
    a, b = got[got.symbol == "a"], got[got.symbol == "b"]
    assert a["e"].notna().tolist() == [8 <= i < 30 for i in range(50)] and not a["k"].notna().any()
    assert b["e"].notna().tolist() == [i >= 8 for i in range(50)] and b["k"].notna().tolist() == [i >= 5 for i in range(50)]


@pytest.mark.parametrize("limit", [None, 1, 2, 4])
def test_state_machine(spark, limit):
    rng = np.random.default_rng(4)
    rows = [(s, i, *[float(rng.integers(-1, 2)) if rng.random() > 0.1 else None for _ in "bs"]) for s, n in (("a", 150), ("b", 1), ("c", 60)) for i in range(n)]
    got = fold.state_machine(spark.createDataFrame(rows, "symbol string, ts int, buy double, sell double").repartition(4), max_hold=limit).toPandas()
    got = got.set_index(["symbol", "ts"])["position"]
    held, last = 0, None
    for s, i, b, sell in rows:
        if s != last:
            held, last = 0, s
        if held == 0:
            held = int((b or 0) > 0)
            want = float(held)
        else:
            held += 1
            if (sell or 0) > 0 or held >= (limit or 10**9):
                held = 0
            want = float(held > 0)
        assert got[s, i] == want, (s, i)


@pytest.mark.parametrize("seed", range(4))
def test_round_trips(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for account in "uvw":
        for symbol in "ab":
            held = 0.0
            for i in range(int(rng.integers(1, 60))):
                side = int(rng.integers(1, 3))
                q = float(rng.choice([1.0, 2.0, 2.5, 0.1]))
                if side == 2 and held > 0 and rng.random() < 0.6:
                    q = round(held, 8) if rng.random() < 0.5 else min(q, held)
                if side == 2 and account != "w":  # only w sells more than it has
                    q = min(q, held) if held > 0 else q
                if side == 1 or held != 0:
                    held = round(held + (q if side == 1 else -q), 8)
                rows.append((account, symbol, datetime(2024, 1, 1) + timedelta(hours=i // 2), i, side, q, 10.0 + float(rng.random()), float(i % 3)))
    df = spark.createDataFrame(rows, "account string, symbol string, created_at timestamp, seq int, side int, volume double, price double, fee double")
    got = trades.round_trips(df.repartition(3)).toPandas().sort_values(["account", "symbol", "close_time", "close_price"]).to_numpy().tolist()
    want, state = [], {}
    for account, symbol, at, _, side, q, price, fee in rows:
        vol, cost, ofee, opened, op = state.get((account, symbol), (0.0, 0.0, 0.0, None, 0.0))
        if side == 1:
            vol, cost = round(vol + q, 8), cost + q * price + fee
            if opened is None:
                opened, op, ofee = at, price, ofee + fee
        elif vol != 0:
            share = q / vol
            want.append([account, symbol, opened, at, op, price, q, share * ofee, fee, q * price - share * cost - fee])
            vol, cost, ofee = round(vol - q, 8), cost - share * cost, ofee - share * ofee
            if vol == 0:
                opened, ofee = None, 0.0
        state[account, symbol] = (vol, cost, ofee, opened, op)
    want.sort(key=lambda w: (w[0], w[1], w[3], w[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [str(v) for v in g[:4]] == [str(v) for v in w[:4]] and np.allclose(np.array(g[4:], float), np.array(w[4:], float), rtol=1e-7, atol=1e-7), (g, w)


@pytest.mark.parametrize("rows", [1, 3, 16, 500])
def test_round_trips_hold_no_whole_series(monkeypatch, rows):
    rng = np.random.default_rng(rows)
    n = 400
    series = np.sort(rng.integers(0, 3, n))
    side = rng.integers(0, 3, n).astype(float)  # 0: neither bought nor sold
    price, fee = 10 + rng.random(n), np.where(np.arange(n) == np.flatnonzero((series == 1) & (side == 1))[9], np.nan, 1.0)
    q = rng.choice([1.0, 2.0, 2.5, 0.1], n)
    for s in (0, 1):  # only the last series sells more than it has
        held = 0.0
        for i in np.flatnonzero(series == s):
            if side[i] == 2 and held > 0:
                q[i] = round(held, 8) if rng.random() < 0.4 else min(q[i], held)
            if side[i] == 1 or held > 0:
                held = round(held + (0, q[i], -q[i])[int(side[i])], 8)
    columns = [side, q, price, fee, np.arange(n) * 1e6]
    batch = pa.RecordBatch.from_arrays([pa.array(series), *map(pa.array, columns)], names=["s", *"abcde"])
    sizes, names = [], ["_held", "_cost", "open_fee", "open_price", "_open"]

    def run(at_once, step):
        def fold_(c, carry):
            sizes.append(len(c.at))
            return trades._trips(c, carry)
        monkeypatch.setattr(passes, "ROWS", at_once)
        batches = (batch.slice(i, step) for i in range(0, n, step))
        return pa.Table.from_batches(passes._carried(["s"], 5, names, fold_)(batches)).to_pandas()
    whole = run(n, n)
    sizes.clear()
    parts = run(rows, 2)
    assert max(sizes) <= min(rows + 1, n) and len(parts) == n and whole["open_price"].notna().sum() > 100 and whole["_cost"].isna().any()
    for k in names:
        assert np.allclose(whole[k].astype(float), parts[k].astype(float), equal_nan=True, rtol=1e-9, atol=1e-9), k
