"""Two-stage scoring: what is read, and against a plain computation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantloom.operators import scoring as sc


def panel(spark, days=300, symbols=12):
    rng = np.random.default_rng(2)
    ret = rng.normal(0, 0.01, (days, symbols))
    ahead = np.vstack([ret[1:], np.zeros(symbols)])
    factors = {"good": ahead + rng.normal(0, 0.01, ahead.shape), "noise": rng.normal(0, 1, ahead.shape), "bad": -ahead + rng.normal(0, 0.01, ahead.shape)}
    dates = pd.bdate_range("2020-01-01", periods=days)
    values = [(f, f"s{j}", d.to_pydatetime(), float(v[i, j])) for f, v in factors.items() for i, d in enumerate(dates) for j in range(symbols)]
    returns = [(f"s{j}", d.to_pydatetime(), float(ret[i, j])) for i, d in enumerate(dates) for j in range(symbols)]
    return (spark.createDataFrame(values, "factor_id string, symbol string, ts timestamp, value double"),
            spark.createDataFrame(returns, "symbol string, ts timestamp, ret double"), factors, ret, dates)


def plain(values, ret, held_from, n=3):
    """Sharpe and drawdown of equal weights of the top ``n`` at each date of ``held_from``, without costs."""
    nav, w = [1.0], np.zeros(ret.shape[1])
    for i in range(len(ret)):
        if i:
            nav.append(nav[-1] * (1 + (w * ret[i]).sum()))
        if i in held_from:
            w = np.zeros(ret.shape[1])
            w[np.argsort(-values[i], kind="stable")[:n]] = 1 / n
    nav = np.array(nav)
    r = nav[1:] / nav[:-1] - 1
    annual = nav[-1] ** (252 / (len(nav) - 1)) - 1
    return (annual - 0.02) / (r.std(ddof=1) * np.sqrt(252)), (nav / np.maximum.accumulate(nav) - 1).min()


def test_funnel_against_plain(spark):
    values, returns, factors, ret, dates = panel(spark)
    got = {r.factor_id: r for r in sc.funnel(sc.store_values(values), returns, "5D").collect()}
    held = set(range(4, len(dates), 5))
    assert got["good"].passed and not got["bad"].passed and got["bad"].score == sc.REJECTED
    sharpe, drawdown = plain(factors["good"], ret, held)
    assert np.isclose(got["good"].score, sharpe) and np.isclose(got["good"].max_drawdown, drawdown)


def test_best_rule_and_batch(spark):
    values, returns, factors, ret, dates = panel(spark)
    stored = sc.store_values(values)
    best = {r.factor_id: r for r in sc.best_rules(stored, returns, ["5D", "2D", "10D"]).collect()}
    for f, v in factors.items():
        each = {k: plain(v, ret, set(range(k - 1, len(dates), k)))[0] for k in (2, 5, 10)}
        assert np.isclose(best[f].sharpe, max(each.values())) and best[f].freq == f"{max(each, key=each.get)}D"
    batch = sc.batch_scores(stored, returns, "5D").collect()
    assert [r.sharpe for r in batch] == sorted((r.sharpe for r in batch), reverse=True) and {r.factor_id for r in batch} == set(factors)
    explored = sc.explore(stored, returns, "5D", min_ic=0.2).collect()
    assert [r.factor_id for r in explored][:1] == ["good"] and {r.factor_id for r in explored} == {"good", "bad"}


def test_second_stage_reads_survivors_alone(spark):
    values, returns, *_ = panel(spark, days=80)
    stored = sc.store_values(values)
    table = sc.store_verdicts(spark.createDataFrame([("good", True), ("noise", False), ("bad", None)], "factor_id string, passed boolean"))
    kept = stored.join(sc.survivors(table).select("factor_id"), "factor_id", "left_semi").select("symbol", F.col("value"))
    assert kept.count() == 80 * 12
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
