"""Scoring of many factors in two stages: coefficients for all of them, net asset values for those that pass.

Factor values are ``(factor_id, symbol, ts, value)``, one folder a factor; returns ``(symbol, ts, ret)``. The second
stage reads the folders of the passing factors alone: which ones is known only while the job runs, and Spark prunes
the scan by the first stage's result. All factors and all rebalance rules share one computation of weights, returns and metrics.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators import nav as nv
from quantloom.operators import portfolio as pf
from quantloom.operators import validation as va
from quantloom.sources.store import materialize, scratch

BY = "factor_id"
#: Score of a factor that the first stage turns down.
REJECTED = -999.0
#: Rebalance rules tried where none is named.
RULES = ("ME", "W", "5D")


def store_values(values: DataFrame, tasks: int = 16) -> DataFrame:
    """``values`` written once with a folder per factor; a factor is spread over up to ``tasks`` files by symbol."""
    spark, path = values.sparkSession, f"{scratch(values.sparkSession, 'factors')}/t"
    x = values.select("symbol", "ts", "value", BY)
    (x.repartition(BY, F.pmod(F.hash("symbol"), F.lit(tasks))).sortWithinPartitions(BY, "ts", "symbol")
     .write.partitionBy(BY).parquet(path))
    return spark.read.schema(x.schema).parquet(path)


def with_next_return(values: DataFrame, returns: DataFrame) -> DataFrame:
    """Each value with its symbol's return of the next date that the symbol has."""
    ahead = F.lead("ret").over(W.partitionBy("symbol").orderBy("ts"))
    return values.join(returns.select("symbol", "ts", ahead.alias("ret")), ["symbol", "ts"])


def schedule(returns: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """``freq, ts``: the rebalance dates of every rule, W / M / ME or nD for every n-th date."""
    def dates(rule: str) -> DataFrame:
        kind, n = pf.parse_frequency(rule)
        found = pf.interval_schedule(returns, n) if kind == "interval" else pf.fixed_schedule(returns, rule)
        return found.select(F.lit(rule).alias("freq"), "ts")
    return reduce(DataFrame.union, [dates(r) for r in rules])


def nav_cube(values: DataFrame, returns: DataFrame, rules: Sequence[str] = RULES, *, n: int = 3, commission: float = 0.0,
             stamp: float = 0.0) -> DataFrame:
    """``factor_id, freq, ts, ret, nav`` of holding the top ``n`` symbols, for every factor and rule in one job.

    Symbols are ranked once per factor and date whatever the number of rules that rebalance on it.
    """
    when = materialize(schedule(returns, rules), "schedule")
    scores = values.select(BY, "symbol", "ts", F.col("value").alias("score")).join(when.select("ts").distinct(), "ts", "left_semi")
    weights = pf.equal_weights(pf.top_n(scores, n, [BY]), [BY]).join(when, "ts")
    return pf.rotation_nav(materialize(weights, "weights"), returns, commission=commission, stamp=stamp, by=[BY, "freq"])


def store_verdicts(table: DataFrame) -> DataFrame:
    """``table`` written once, ``passed`` as 1 or 0: Spark prunes folders by a comparison, not by a flag alone."""
    return materialize(table.withColumn("passed", F.when(F.col("passed"), 1).otherwise(0)), "factor_table")


def survivors(table: DataFrame) -> DataFrame:
    return table.filter(F.col("passed") >= 1)


def backtests(values: DataFrame, returns: DataFrame, chosen: DataFrame, rules: Sequence[str] = RULES, **holding) -> DataFrame:
    """``factor_id, freq, sharpe, annual_return, max_drawdown`` of the ``chosen`` factors under each rule.

    ``values`` should come from :func:`store_values` and ``chosen`` be a filtered stored table: then the scan reads
    the folders of these factors alone.
    """
    kept = values.join(chosen.select(BY), BY, "left_semi")
    nav = nav_cube(kept, returns, rules, **holding)
    return nv.metrics(nav, by=[BY, "freq"]).select(BY, "freq", "sharpe", "annual_return", "max_drawdown")


def staged(values: DataFrame, returns: DataFrame, gate: Column | None = None, rules: Sequence[str] = ("ME",), *,
           min_pairs: int = 5, min_days: int = 30, **holding) -> DataFrame:
    """All factors with the columns of :func:`validation.factor_table` and ``passed``; those that pass ``gate`` (None:
    all) once per rule, with ``freq, sharpe, annual_return, max_drawdown``; the others once, without these."""
    table = va.factor_table(with_next_return(values, returns), min_pairs=min_pairs, min_days=min_days)
    passed = F.lit(True) if gate is None else gate
    table = store_verdicts(table.withColumn("passed", passed))
    x = table.join(backtests(values, returns, survivors(table), rules, **holding), BY, "left")
    return x.withColumn("passed", F.col("passed") == 1)


def batch_scores(values: DataFrame, returns: DataFrame, rule: str = "ME", **limits) -> DataFrame:
    """Coefficients and a quick back-test of every factor, best Sharpe first; no factor is left out."""
    return staged(values, returns, None, (rule,), **limits).drop("passed", "freq").orderBy(F.desc_nulls_last("sharpe"), BY)


def funnel(values: DataFrame, returns: DataFrame, rule: str = "ME", *, hit_min: float = 0.5, stable_min: float = 0.6,
           **limits) -> DataFrame:
    """``factor_id, passed, score``: Sharpe behind a gate of hit rate and yearly stability, else ``REJECTED``."""
    gate = (F.col("hit") >= hit_min) & (F.col("yearly_stability") >= stable_min)
    x = staged(values, returns, gate, (rule,), **limits)
    return x.select(BY, "passed", F.coalesce("sharpe", F.lit(REJECTED)).alias("score"), "max_drawdown")


def breadth_scores(values: DataFrame, returns: DataFrame, rule: str = "ME", **limits) -> DataFrame:
    """Like :func:`funnel`, with a gate that is the stricter the more symbols there are (:func:`validation.breadth_gate`)."""
    symbols = returns.agg(F.countDistinct("symbol").alias("symbols"))  # one row
    table = va.factor_table(with_next_return(values, returns), **limits).join(F.broadcast(symbols))
    table = store_verdicts(va.breadth_gate(table, F.col("symbols")))
    x = table.join(backtests(values, returns, survivors(table), (rule,)), BY, "left")
    return x.select(BY, "symbols", (F.col("passed") == 1).alias("passed"), F.coalesce("sharpe", F.lit(REJECTED)).alias("score"), "max_drawdown")


def best_rules(values: DataFrame, returns: DataFrame, rules: Sequence[str] = RULES, **limits) -> DataFrame:
    """``factor_id, sharpe, freq, max_drawdown`` under the rule of the best Sharpe (ties to the last name)."""
    x = staged(values, returns, None, rules, **limits).filter(F.col("sharpe").isNotNull())
    best = F.max(F.struct("sharpe", "freq", "max_drawdown")).alias("b")
    return x.groupBy(BY).agg(best).select(BY, "b.sharpe", "b.freq", "b.max_drawdown")


def explore(values: DataFrame, returns: DataFrame, rule: str = "ME", *, min_ic: float = 0.0, min_sharpe: float = float("-inf"),
            n: int = 3) -> DataFrame:
    """Rank coefficients, hit rate and back-test per factor, by ``|ic| * max(ir, 0)``; factors below a limit go.

    The back-tests run for factors of enough ``|ic|`` alone.
    """
    pairs = with_next_return(values, returns)
    ic = va.ic_summary(va.daily_ic(pairs)).select(BY, F.col("mean").alias("ic_mean"), F.coalesce("ir", F.lit(0.0)).alias("ic_ir"))
    hits = va.hit_rate(pairs).select(BY, "hit_rate")
    table = materialize(ic.join(hits, BY, "left").filter(F.col("ic_mean").isNotNull()), "explored")
    good = table.filter(F.abs("ic_mean") >= min_ic)
    x = good.join(backtests(values, returns, good, (rule,), n=n).drop("freq"), BY)
    order = F.abs("ic_mean") * F.greatest("ic_ir", F.lit(0.0))
    return x.filter(F.col("sharpe") >= min_sharpe).withColumn("explore", order).orderBy(F.desc("explore"), BY)
