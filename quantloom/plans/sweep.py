"""Parameter sweeps and walk-forward tests: one job for all variants and windows."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import Feature, flag
from quantloom.operators import nav as nv
from quantloom.operators.portfolio import equal_weights, rebalance_dates, rotation_nav, signal_nav, top_n
from quantloom.operators.validation import daily_ic, ic_summary
from quantloom.plans.panel import with_features


def grid(**params: Sequence) -> list[dict]:
    """Cartesian product of parameter lists."""
    return [dict(zip(params, combo)) for combo in product(*params.values())]


def draws(n: int, seed: int, **ranges: tuple) -> list[dict]:
    """n seeded uniform draws; integer bounds give integers."""
    rng = random.Random(seed)

    def one(lo, hi):
        return rng.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rng.uniform(lo, hi)
    return [{k: one(*r) for k, r in ranges.items()} for _ in range(n)]


def variant_signals(bars: DataFrame, template: Callable[..., Feature], variants: Sequence[Mapping]) -> DataFrame:
    """Long ``(variant_id, symbol, ts, signal)``: all variants share one pass over the bars."""
    feats = {f"v{i}": template(**v) for i, v in enumerate(variants)}
    wide = with_features(bars, feats, keep=["symbol", "ts"])
    return wide.select("symbol", "ts", F.posexplode(F.array(*feats)).alias("variant_id", "signal"))


def _params_column(variants: Sequence[Mapping]) -> Column:
    texts = [", ".join(f"{k}={v}" for k, v in p.items()) for p in variants]
    return F.array(*[F.lit(t) for t in texts])[F.col("variant_id")]


def signal_sweep(bars: DataFrame, returns: DataFrame, template: Callable[..., Feature],
                 variants: Sequence[Mapping], **kw) -> DataFrame:
    """Metrics of a signal template per variant and symbol, best Sharpe first; a variant without
    a usable result scores 0."""
    s = variant_signals(bars, template, variants)
    spread = returns.select("symbol", "ts", "ret", F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1))).alias("variant_id"))
    by = ["variant_id", "symbol"]
    m = nv.metrics(signal_nav(s, spread, by), by=by, **kw)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("sharpe", "annual_return", "max_drawdown")}
    return (m.select(*by, _params_column(variants).alias("params"), *[v.alias(k) for k, v in zero.items()])
            .orderBy(F.col("sharpe").desc(), *by))


def compare_signals(navs: DataFrame, **kw) -> DataFrame:
    """Metrics per strategy ranked by Sharpe."""
    m = nv.metrics(navs, **kw).select("strategy_id", "sharpe", "annual_return", "max_drawdown")
    one = W.partitionBy(F.lit(1)).orderBy(F.col("sharpe").desc_nulls_last(), "strategy_id")  # one row per strategy
    return m.withColumn("rank", F.row_number().over(one))


def factor_sweep(bars: DataFrame, returns: DataFrame, template: Callable[..., Feature], lookbacks: Sequence[int],
                 rules: Sequence[str], tops: Sequence[int], **kw) -> DataFrame:
    """IC, IR, hit rate, Sharpe and drawdown for lookback x rebalance rule x number held.

    The factor is computed once per lookback; rules and numbers held only select rows of it.
    """
    feats = {f"v{i}": template(d) for i, d in enumerate(lookbacks)}
    wide = with_features(bars, feats, keep=["symbol", "ts"])
    long = wide.select("symbol", "ts", F.posexplode(F.array(*feats)).alias("_i", "score"))
    long = long.withColumn("lookback", F.array(*[F.lit(d) for d in lookbacks])[F.col("_i")]).drop("_i")
    ic = daily_ic(long.withColumnRenamed("score", "value").join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"]),
                  by=["lookback"])
    quality = ic_summary(ic, by=["lookback"]).select("lookback", F.col("mean").alias("ic"), "ir",
                                                    F.col("positive_ratio").alias("hit"))
    parts = [long.join(rebalance_dates(bars, r), "ts", "left_semi").withColumn("rule", F.lit(r)) for r in rules]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    best = top_n(picked, max(tops), ["lookback", "rule"])
    held = best.select("*", F.explode(F.array(*[F.lit(n) for n in tops])).alias("top")).filter(F.col("rank") <= F.col("top"))
    by = ["lookback", "rule", "top"]
    series = rotation_nav(equal_weights(held, by), returns, by=by)
    m = nv.metrics(series, by=by, **kw).select(*by, "sharpe", "max_drawdown")
    return m.join(quality, "lookback", "left").orderBy(F.col("sharpe").desc(), *by)


# -- walk-forward ------------------------------------------------------------------------------------------
def add_offset(t: datetime, text: str) -> datetime:
    """Calendar offset: nY, nM or nD."""
    n, unit = int(text[:-1]), text[-1].upper()
    if unit == "D":
        return t + timedelta(days=n)
    if unit not in "YM":
        raise ValueError(f"unknown offset {text}")
    months = t.month - 1 + (n * 12 if unit == "Y" else n)
    year, month = t.year + months // 12, months % 12 + 1
    last = (datetime(year + (month == 12), month % 12 + 1, 1) - timedelta(days=1)).day
    return t.replace(year=year, month=month, day=min(t.day, last))


def offset_days(text: str) -> timedelta:
    """Fixed offset: a year is 365 days, a month 30."""
    return timedelta(days=int(text[:-1]) * {"Y": 365, "M": 30, "D": 1}[text[-1].upper()])


def windows(start: datetime, end: datetime, train: str, test: str, step: str, *, calendar: bool = True,
            anchored: bool = False) -> list[tuple[datetime, datetime, datetime]]:
    """(train start, test start, test end) of every window that ends by ``end``."""
    add = add_offset if calendar else (lambda t, s: t + offset_days(s))
    out, begin, split = [], start, add(start, train)
    while add(split, test) <= end:
        out.append((begin, split, add(split, test)))
        if not anchored:
            begin = add(begin, step)
            split = add(begin, train)
        else:
            split = add(split, step)
    return out


def windows_of(rows: DataFrame, train: str, test: str, step: str, *, ts: str = "ts", **kw) -> list[tuple[datetime, datetime, datetime]]:
    """The :func:`windows` from the first to the last time of ``rows``."""
    ends = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    return windows(ends.a, ends.b, train, test, step, **kw) if ends.a is not None else []


def in_windows(rows: DataFrame, wins: Sequence[tuple], inclusive: bool = False) -> DataFrame:
    """Each row once per window that contains it, with ``window_id`` and ``part`` (train / test).

    The windows are a handful of literals, so this is a narrow step without a join.
    """
    table = F.array(*[F.struct(F.lit(i).alias("window_id"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                      for i, (a, b, c) in enumerate(wins)])
    t = F.col("ts")
    hit = F.filter(table, lambda w: (t >= w["a"]) & ((t <= w["c"]) if inclusive else (t < w["c"])))
    x = rows.select("*", F.explode(hit).alias("_w"))
    return x.withColumns({"window_id": F.col("_w.window_id"),
                          "part": F.when(t >= F.col("_w.b"), "test").otherwise("train")}).drop("_w")


def walk_forward(bars: DataFrame, returns: DataFrame, signal: Feature, wins: Sequence[tuple], *,
                 recompute: bool = True, inclusive: bool = True, min_rows: int = 30, more: Sequence[str] = (), **kw) -> DataFrame:
    """Metrics per symbol, window and part; ``more`` names metrics beside the three usual ones.

    With ``recompute`` the feature starts afresh at each window's first row; otherwise it is
    computed once on the whole history (it must not look ahead).
    """
    if recompute:
        tagged = in_windows(bars, wins, inclusive)
        x = with_features(tagged, {"signal": signal}, symbol=["symbol", "window_id"],
                          keep=["symbol", "window_id", "part", "ts"])
    else:
        x = in_windows(with_features(bars, {"signal": signal}, keep=["symbol", "ts"]), wins, inclusive)
    by = ["symbol", "window_id", "part"]
    x = x.join(returns.select("symbol", "ts", "ret"), ["symbol", "ts"])
    first = F.row_number().over(W.partitionBy(*by).orderBy("ts")) == 1
    x = x.withColumn("ret", F.when(first, 0.0).otherwise(F.col("ret")))
    series = signal_nav(x.select(*by, "ts", "signal"), x.select(*by, "ts", "ret"), by)
    m = nv.metrics(series, by=by, **kw).filter(F.col("n") >= min_rows)
    return m.select(*by, "n", F.coalesce("sharpe", F.lit(0.0)).alias("sharpe"),
                    F.coalesce("annual_return", F.lit(0.0)).alias("annual_return"),
                    F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), *more)


def walk_forward_summary(result: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Test-window summary: mean, deviation (population), stability max(0, 1 - deviation), ..."""
    s = F.col("sharpe")
    return result.filter(F.col("part") == "test").groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"), F.avg(s).alias("mean_sharpe"), F.stddev_pop(s).alias("sharpe_std"),
        F.greatest(F.lit(0.0), 1 - F.stddev_pop(s)).alias("stability"),
        F.sum(F.when(s < 0, 1).otherwise(0)).alias("negative_count"), F.avg(flag(s > 0)).alias("win_rate"),
        F.min(s).alias("min_sharpe"), F.max(s).alias("max_sharpe"))


def stability_report(result: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("symbol",), least: int = 2) -> DataFrame:
    """Mean and deviation (sample) over the windows of each metric and part, where ``least`` windows have it."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    x = result.select(*by, "part", F.explode(rows).alias("m")).select(*by, "part", "m.*").filter(F.col("value").isNotNull())
    return x.groupBy(*by, "part", "metric").agg(F.count("value").alias("windows"), F.avg("value").alias("mean"),
                                                F.stddev_samp("value").alias("std")).filter(F.col("windows") >= least)


def overfit_summary(result: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Train against test: stability mean / deviation (sample), overfit as difference and as ratio."""
    def mean(part):
        return F.avg(F.when(F.col("part") == part, F.col("sharpe")))
    test, train = mean("test"), mean("train")
    dev = F.stddev_samp(F.when(F.col("part") == "test", F.col("sharpe")))
    return result.groupBy(*by).agg(
        test.alias("mean_test"), train.alias("mean_train"), F.when(dev > 0, test / dev).otherwise(0.0).alias("stability"),
        (train - test).alias("overfit"), F.when(test != 0, train / test).alias("overfit_ratio"))


def best_of(result: DataFrame, metric: str, by: Sequence[str], better: str = "max") -> DataFrame:
    """Row with the best metric per group."""
    pick = F.max_by if better == "max" else F.min_by
    fields = [c for c in result.columns if c not in by]
    return result.groupBy(*by).agg(pick(F.struct(*fields), metric).alias("_r")).select(*by, "_r.*")
