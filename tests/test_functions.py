"""Feature functions against plain-Python loops on random series with gaps and ties."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from quantloom import col, lit, with_features
from quantloom.functions import cross_section as cs
from quantloom.functions import indicators as ta
from quantloom.functions import registry as reg
from quantloom.functions import regression as rg
from quantloom.functions import rolling as r
from quantloom.functions import scalar as sc
from quantloom.functions.feature import all_of, any_of, not_, where
from tests import brute as b

N, D = 1500, 7


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=N), 1)
    x[rng.random(N) < .15] = np.nan
    x[40:60] = np.nan
    x[100:120] = 0.5
    y = np.where(rng.random(N) < .1, np.nan, np.nan_to_num(x) * .5 + rng.normal(size=N))
    c = 100 * np.exp(np.cumsum(rng.normal(size=N) * .02))
    h, l = c * (1 + rng.random(N) * .03), c * (1 - rng.random(N) * .03)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=N), "x": x,
                        "y": y, "c": c, "h": h, "l": l})
    df = spark.createDataFrame(pdf)
    for name in ("x", "y"):
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return df.cache(), pdf


X, Y, Cl, H, L = (col(k) for k in "xychl")

ROLLING = {
    "mean": (r.ts_mean(X, D), lambda p: b.over(p.x, D, b.mean)),
    "std": (r.ts_std(X, D), lambda p: b.over(p.x, D, b.std)),
    "var": (r.ts_var(X, D), lambda p: b.over(p.x, D, b.std) ** 2),
    "max": (r.ts_max(X, D), lambda p: b.over(p.x, D, lambda w: max(b.present(w), default=b.nan))),
    "min": (r.ts_min(X, D), lambda p: b.over(p.x, D, lambda w: min(b.present(w), default=b.nan))),
    "median": (r.ts_median(X, D), lambda p: b.over(p.x, D, lambda w: np.median(b.present(w)) if len(b.present(w)) else b.nan)),
    "product": (r.ts_product(X, D), lambda p: b.over(p.x, D, lambda w: np.prod(b.present(w)) if len(b.present(w)) else b.nan)),
    "rank": (r.ts_rank(X, D), lambda p: b.over(p.x, D, b.rank)),
    "argmax": (r.ts_argmax(X, D), lambda p: b.over(p.x, D, b.argmax)),
    "argmin": (r.ts_argmin(X, D), lambda p: b.over(p.x, D, b.argmin)),
    "decay": (r.ts_decay_linear(X, D), lambda p: b.over(p.x, D, b.decay)),
    "q80": (r.ts_quantile(X, D, .8), lambda p: b.over(p.x, D, b.quantile(.8))),
    "skew": (r.ts_skew(X, D), lambda p: b.over(p.x, D, b.skew)),
    "kurt": (r.ts_kurt(X, D), lambda p: b.over(p.x, D, b.kurt)),
    "hump": (r.ts_hump(X, D), lambda p: b.over(p.x, D, b.hump)),
    "one": (r.ts_mean(X, 1), lambda p: p.x),
    "slope": (rg.ts_slope(X, D), lambda p: b.over(p.x, D, lambda w: b.trend(w, "slope"))),
    "intercept": (rg.ts_intercept(X, D), lambda p: b.over(p.x, D, lambda w: b.trend(w, "intercept"))),
    "resid": (rg.ts_resid(X, D), lambda p: b.over(p.x, D, lambda w: b.trend(w, "resid"))),
    "rsq": (rg.ts_rsq(X, D), lambda p: b.over(p.x, D, lambda w: b.trend(w, "rsq"))),
    "ema": (ta.ema(Cl, 20), lambda p: b.ema(p.c, 20)),
    "ema1": (ta.ema(Cl, 1), lambda p: p.c),
    "wilder": (ta.wilder_smooth(Cl, 14), lambda p: b.wilder(p.c, 14)),
    "sma_rec": (ta.sma_recursive(Cl, 9, 2), lambda p: b.smooth(p.c, 1 - 2 / 9, 2 / 9, 9)),
    "rsi": (ta.rsi(Cl, 14), lambda p: b.rsi(p.c, 14)),
    "atr": (ta.atr(H, L, Cl, 14), lambda p: b.wilder(b.true_range(p.h, p.l, p.c), 14, 1)),
    "natr": (ta.natr(H, L, Cl, 14), lambda p: b.wilder(b.true_range(p.h, p.l, p.c), 14, 1) / p.c * 100),
    "adx": (ta.adx(H, L, Cl, 14), lambda p: b.adx(p.h, p.l, p.c, 14)),
    "macd": (ta.macd(Cl), lambda p: b.macd(p.c, 12, 26, 9)),
    "dema": (ta.dema(Cl, 10), lambda p: 2 * b.ema(p.c, 10) - b.ema(b.ema(p.c, 10), 10, 9)),
    "kama": (ta.kama(Cl, 10), lambda p: b.kama(p.c, 10)),
    "ar": (rg.ts_ar_resid(Cl, 3), lambda p: b.ar_resid(p.c, 3)),
    "exp_q": (r.expanding_percentile(X, .3), lambda p: np.array([b.quantile(.3)(p.x[:i + 1]) if i >= 19 else b.nan for i in range(N)])),
    "exp_rank": (r.expanding_rank(X), lambda p: np.array([(np.nan_to_num(p.x)[:i + 1] <= np.nan_to_num(p.x)[i]).mean() if i >= 20 else .5 for i in range(N)])),
}


@pytest.fixture(scope="module")
def rolled(series):
    df, pdf = series
    out = with_features(df, {k: f for k, (f, _) in ROLLING.items()}, keep=["ts"])
    return out.orderBy("ts").toPandas(), pdf


@pytest.mark.parametrize("name", ROLLING)
def test_rolling(rolled, name):
    got, pdf = rolled
    arrays = type("P", (), {k: pdf[k].to_numpy() for k in "xychl"})
    want = ROLLING[name][1](arrays)
    np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-8, atol=1e-8, err_msg=name)


def test_recurrence_missing_input_stays_missing(spark, series):
    df, _ = series
    out = with_features(df, {"e": ta.ema(X, 5)}, keep=["ts", "x"]).orderBy("ts").toPandas()
    first_gap = int(np.argmax(out.x.isna()))
    assert out.e[first_gap:].isna().all()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, feature, **values):
    """The feature's value on a single row."""
    names = list(values)
    schema = "symbol string, ts timestamp" + "".join(f", {n} double" for n in names)
    df = spark.createDataFrame([("A", datetime(2020, 1, 1), *values.values())], schema)
    return with_features(df, {"f": feature}, keep=[]).collect()[0][0]


@pytest.mark.parametrize("feature,want", [
    (col("a") / col("b"), 0.0), (col("a") // col("b"), 0.0), (col("a") % col("b"), 0.0),
    (col("a") > col("b"), 0.0), (col("a").eq(col("b")), 0.0), (col("a").ne(col("b")), 0.0),
    (not_(col("b")), 0.0), (where(col("b"), 1, 2), 2.0), (all_of(col("a"), col("b")), None),
    (any_of(col("a"), col("b")), None), (col("a") + col("b"), None),
    (sc.max_(col("a"), col("b")), None), (col("a") / 0.0, 0.0), (col("a") % lit(-2.0), -1.0),
    (all_of(col("a"), 7.0), 1.0), (any_of(col("a"), -4.0), 3.0), (sc.log(lit(0.0)), None),
    (sc.sqrt(lit(-4.0)), 0.0), (sc.signed_power(lit(-3.0), 2), -9.0), (lit(2e6) ** 1, 1e6),
])
def test_missing_rules(spark, feature, want):
    assert one(spark, feature, a=3.0, b=None) == want


def test_warmup_through_division_is_zero(spark, series):
    df, _ = series
    out = with_features(df, {"f": col("c") / r.ts_delay(Cl, 5)}, keep=["ts"]).orderBy("ts").toPandas()
    assert (out.f[:5] == 0.0).all() and (out.f[5:] > 0).all()


def test_cross_section(spark):
    rows = [(s, d, v) for d, vs in [("2020-01-01", [1., 2., 2., None, 5.]),
                                    ("2020-01-02", [3., 3., 3., 3., 3.]),
                                    ("2020-01-03", [None] * 4 + [1.])]
            for s, v in zip("ABCDE", vs)]
    df = spark.createDataFrame(rows, "symbol string, d string, x double").selectExpr(
        "symbol", "to_timestamp(d) ts", "x")
    got = with_features(df, {"rank": cs.cs_rank(X), "avg": cs.cs_rank_average(X),
                             "z": cs.cs_zscore(X), "scale": cs.cs_scale(X),
                             "q": cs.cs_quantile(X, .5), "w": cs.cs_winsorize(X, .5)}
                        ).orderBy("ts", "symbol").toPandas()
    day = got[:5]
    np.testing.assert_allclose(day["rank"], [.25, .5, .5, np.nan, 1.])
    np.testing.assert_allclose(day["avg"], [.25, .625, .625, np.nan, 1.])
    np.testing.assert_allclose(day["scale"], [.1, .2, .2, np.nan, .5])
    assert (day["q"] == 2.0).all()
    v = np.array([1, 2, 2, np.nan, 5.])
    np.testing.assert_allclose(day["z"], (v - np.nanmean(v)) / np.nanstd(v, ddof=1))
    m, s = np.nanmean(v), np.nanstd(v, ddof=1)
    np.testing.assert_allclose(day["w"], np.clip(v, m - .5 * s, m + .5 * s))
    assert (got[5:10]["z"] == 0).all() and got[10:].z.isna().all()
    assert got.iloc[14]["rank"] == 1.0 and got.iloc[14]["w"] == 1.0


def test_rank_is_invariant_under_monotone_maps(series):
    df, _ = series
    out = with_features(df, {"a": r.ts_rank(X, D), "b": r.ts_rank(sc.exp(X), D)}, keep=[]).toPandas()
    np.testing.assert_array_equal(out.a, out.b)


def test_registry():
    reg.register("double_it", lambda x: x * 2.0)
    assert str(reg.call("double_it", col("a"))) == "mul(a, 2.0)"
    with pytest.raises(TypeError):
        reg.call("double_it")
    assert reg.unregister("double_it") and not reg.unregister("double_it")
    reg.register_macro("spread", lambda x, y: x - y)
    assert "spread" in reg.macros()
    reg.unregister("spread")
    assert reg.is_variable("REL_CLOSE") and not reg.is_variable("nothing")
    with pytest.raises(ValueError):
        r.ts_mean("x", 0)


def test_describe_and_missing(series):
    df, _ = series
    f = cs.cs_rank(r.ts_roc(col("CLOSE"), 4))
    d = f.describe()
    assert d["variables"] == ["CLOSE"] and "cs_rank" in d["functions"]
    assert d["axes"] == ["date", "row", "symbol"]
    with pytest.raises(ValueError, match="CLOSE"):
        with_features(df, {"f": f})
