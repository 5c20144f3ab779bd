"""From scores to weights to net asset value, as relations.

Scores are long ``(strategy_id, ts, symbol, score)``; weights ``(strategy_id, ts, symbol, weight)``
hold at each rebalance date; a weight earns returns from the next date on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.stats import corr_agg
from quantloom.operators.validation import daily_ic
from quantloom.sources.store import materialize

SID = "strategy_id"


# -- calendars -------------------------------------------------------------------------------------------
def rebalance_dates(dates: DataFrame, rule: str) -> DataFrame:
    """Dates to rebalance on. D: all; W: last date of each Monday-Sunday week; M and ME: last date
    of each month; nD: every n-th date starting with the n-th."""
    d = dates.select("ts").distinct()
    if rule == "D":
        return d
    if rule == "W":
        return d.groupBy(F.date_trunc("week", "ts")).agg(F.max("ts").alias("ts")).select("ts")
    if rule in ("M", "ME"):
        return d.groupBy(F.date_trunc("month", "ts")).agg(F.max("ts").alias("ts")).select("ts")
    if rule.endswith("D") and rule[:-1].isdigit() and int(rule[:-1]) > 0:
        n = int(rule[:-1])
        rn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("ts"))  # one row per date
        return d.withColumn("_rn", rn).filter(F.col("_rn") % n == 0).select("ts")
    raise ValueError(f"unknown rebalance rule {rule}")


def fixed_schedule(dates: DataFrame, rule: str) -> DataFrame:
    """Older calendar: W last of the ISO week, ME last / M first of the month, without the first
    period when there are several."""
    pick = {"W": ("week", F.max), "ME": ("month", F.max), "M": ("month", F.min)}
    if rule not in pick:
        raise ValueError(f"unknown schedule {rule}")
    unit, take = pick[rule]
    p = dates.groupBy(F.date_trunc(unit, "ts").alias("_p")).agg(take("ts").alias("ts"))
    one = W.partitionBy(F.lit(1))  # one row per period
    return (p.withColumns({"_i": F.row_number().over(one.orderBy("ts")), "_n": F.count(F.lit(1)).over(one)})
            .filter((F.col("_i") > 1) | (F.col("_n") == 1)).select("ts"))


def interval_schedule(dates: DataFrame, n: int) -> DataFrame:
    """Every n-th date; none when there are not more than n dates."""
    one = W.partitionBy(F.lit(1))  # one row per date
    d = dates.select("ts").distinct()
    return (d.withColumns({"_i": F.row_number().over(one.orderBy("ts")), "_n": F.count(F.lit(1)).over(one)})
            .filter((F.col("_n") > n) & (F.col("_i") % n == 0)).select("ts"))


def recommended_frequency(half_life: Column) -> Column:
    return (F.when(half_life <= 5, "5D").when(half_life <= 10, "W").when(half_life <= 22, "10D")
            .otherwise("ME"))


def parse_frequency(text: str) -> tuple[str, int | None]:
    """'5D' -> ('interval', 5); 'W' / 'M' / 'ME' -> ('fixed', None)."""
    if text.endswith("D") and text[:-1].isdigit():
        return "interval", int(text[:-1])
    if text in ("W", "M", "ME"):
        return "fixed", None
    raise ValueError(f"unknown frequency {text}")


# -- selection and weights -----------------------------------------------------------------------------
def ranked(scores: DataFrame, by: Sequence[str] = (SID,)) -> DataFrame:
    """Rank 1.. per date by score (missing scores dropped, ties by symbol)."""
    w = W.partitionBy(*by, "ts").orderBy(F.col("score").desc(), "symbol")
    return scores.filter(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(w))


def top_n(scores: DataFrame, n: int, by: Sequence[str] = (SID,)) -> DataFrame:
    return ranked(scores, by).filter(F.col("rank") <= n)


def equal_weights(selected: DataFrame, by: Sequence[str] = (SID,)) -> DataFrame:
    n = F.count(F.lit(1)).over(W.partitionBy(*by, "ts"))
    return selected.select(*by, "ts", "symbol", (1.0 / n).alias("weight"))


def score_weights(selected: DataFrame, by: Sequence[str] = (SID,)) -> DataFrame:
    """Positive part of the score, normalised; 0 when no score is positive."""
    p = F.greatest(F.col("score"), F.lit(0.0))
    total = F.sum(p).over(W.partitionBy(*by, "ts"))
    return selected.select(*by, "ts", "symbol", F.when(total > 0, p / total).otherwise(0.0).alias("weight"))


def _equal_risk(cov: np.ndarray) -> np.ndarray:
    """Long-only weights with equal risk contributions (coordinate descent on the log barrier)."""
    m = len(cov)
    x = 1.0 / np.sqrt(np.diag(cov))
    for _ in range(500):
        old = x.copy()
        for i in range(m):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4.0 * cov[i, i] / m)) / (2.0 * cov[i, i])
        if np.abs(x - old).max() <= 1e-12 * np.abs(x).max():
            return x / x.sum()
    raise ArithmeticError("risk parity weights did not settle in 500 rounds")


def risk_parity_weights(selected: DataFrame, returns: DataFrame, lookback: int, by: Sequence[str] = (SID,), *,
                        residual: bool = False) -> DataFrame:
    """Equal risk contributions over the last ``lookback`` returns of the selected symbols.

    The selected rows look their returns up by row number, so only they carry any. A group is one rebalance date: at
    most (selected symbols) arrays of ``lookback`` values. Falls back to equal weights where returns are missing.
    With ``residual`` also how far the contribution of a symbol is from an equal share of the risk (0: equal weights
    for want of returns).
    """
    numbered = returns.select("symbol", "ts", "ret", F.row_number().over(W.partitionBy("symbol").orderBy("ts")).alias("_rn"))
    picks = selected.select(*by, "ts", "symbol").join(numbered.drop("ret"), ["symbol", "ts"], "left")
    wanted = picks.select(*by, "ts", "symbol", F.explode(F.sequence(F.col("_rn") - (lookback - 1), F.col("_rn"))).alias("_rn"))
    found = wanted.join(numbered.select("symbol", "_rn", "ret"), ["symbol", "_rn"]).filter(F.col("ret").isNotNull())
    hist = found.groupBy(*by, "ts", "symbol").agg(F.array_sort(F.collect_list(F.struct("_rn", "ret")))["ret"].alias("_h"))
    x = picks.drop("_rn").join(hist, [*by, "ts", "symbol"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        h = [a for a in pdf["_h"]]
        n = len(pdf)
        weights, off = np.full(n, 1.0 / n), np.zeros(n)
        if n > 1 and all(a is not None and len(a) == lookback for a in h):
            cov = np.cov(np.stack([np.asarray(a, float) for a in h])) + 1e-6 * np.eye(n)
            if np.isfinite(cov).all():
                weights = _equal_risk(cov)
                risk = weights * (cov @ weights)
                off = risk / risk.sum() - 1.0 / n
        return pdf.drop(columns="_h").assign(weight=weights, residual=off)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name != "_h")
    return x.groupBy(*by, "ts").applyInPandas(solve, f"{fields}, weight double, residual double").select(
        *by, "ts", "symbol", "weight", *(["residual"] if residual else []))


def buffered_targets(scores: DataFrame, dates: DataFrame, n: int, buffer: int,
                     by: Sequence[str] = (SID,)) -> DataFrame:
    """Equal weights with a rank buffer: a held symbol stays while its rank is within n + buffer,
    free slots go to the best new symbols among the top n.

    Only ranks up to n + buffer reach the fold, as one short array per rebalance date; tasks stream
    the dates of a strategy and keep the held set.
    """
    r = ranked(scores.join(dates.select("ts"), "ts", "left_semi"), by).filter(F.col("rank") <= n + buffer)
    rows = r.groupBy(*by, "ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))),
                                                lambda s: s["symbol"]).alias("_c"))
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, set()
        for pdf in batches:
            out = []
            for key, c in zip(pdf[keys].itertuples(index=False, name=None), pdf["_c"]):
                if key != current:
                    current, held = key, set()
                keep = held & set(c)
                fresh = [s for s in c[:n] if s not in held][:n - len(keep)]
                held = keep | set(fresh)
                out.append(sorted(held))
            yield pdf.drop(columns="_c").assign(_t=out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_c")
    kind = r.schema["symbol"].dataType.simpleString()
    chosen = rows.repartition(*keys).sortWithinPartitions(*keys, "ts").mapInPandas(run, f"{fields}, _t array<{kind}>")
    return chosen.select(*keys, "ts", F.explode("_t").alias("symbol"), (1.0 / F.size("_t")).alias("weight"))


# -- combining factors -----------------------------------------------------------------------------------
def combine_factors(factors: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean, or weighted sum with normalised weights, of ``(factor_id, ts, symbol, value)``."""
    if weights is None:
        return factors.groupBy("ts", "symbol").agg(F.avg("value").alias("score"))
    total = sum(weights.values())
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)])[F.col("factor_id")]
    return factors.groupBy("ts", "symbol").agg(F.sum(F.col("value") * w).alias("score"))


def ic_weights(pairs: DataFrame, min_periods: int = 60, lag: int = 0) -> DataFrame:
    """Weight of each factor per date: its running mean rank IC, negatives to 0, normalised; equal
    when all are 0. With ``lag=0`` the weight of a date uses that date's IC, which needs the next
    return (one date of look-ahead); ``lag=1`` avoids it."""
    ic = daily_ic(pairs, "spearman", 3)
    w = W.partitionBy("factor_id").orderBy("ts")
    run = w.rowsBetween(W.unboundedPreceding, -lag)
    mean = F.when(F.count("ic").over(run) >= min_periods, F.greatest(F.avg("ic").over(run), F.lit(0.0)))
    x = ic.select("factor_id", "ts", F.coalesce(mean, F.lit(0.0)).alias("_m"))
    day = W.partitionBy("ts")
    total = F.sum("_m").over(day)
    return x.select("factor_id", "ts", F.when(total > 0, F.col("_m") / total).otherwise(
        1.0 / F.count(F.lit(1)).over(day)).alias("weight"))


def combine_by_ic(factors: DataFrame, weights: DataFrame) -> DataFrame:
    return (factors.join(weights, ["factor_id", "ts"]).groupBy("ts", "symbol")
            .agg(F.sum(F.col("value") * F.col("weight")).alias("score")))


# -- net asset value ---------------------------------------------------------------------------------------
def _marks(weights: DataFrame, by) -> DataFrame:
    """Each rebalance date of a strategy with its ordinal and the next one (NULL for the last)."""
    o = W.partitionBy(*by).orderBy("ts")
    return weights.select(*by, "ts").distinct().select(*by, "ts", F.row_number().over(o).alias("_k"),
                                                       F.lead("ts").over(o).alias("_next"))


def _changes(held: DataFrame, by) -> DataFrame:
    """Sold and bought weight per ordinal ``_k`` of ``held`` (weights with their marks)."""
    new = held.select(*by, "_k", "symbol", F.col("weight").alias("_w"))
    # what was held at the mark before, but for marks after the last one
    old = held.filter(F.col("_next").isNotNull()).select(*by, (F.col("_k") + 1).alias("_k"), "symbol", (-F.col("weight")).alias("_w"))
    d = new.unionByName(old).groupBy(*by, "_k", "symbol").agg(F.sum("_w").alias("_d"))
    return d.groupBy(*by, "_k").agg(F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).alias("sold"),
                                    F.sum(F.greatest(F.col("_d"), F.lit(0.0))).alias("bought"))


def weight_changes(weights: DataFrame, by: Sequence[str] = (SID,)) -> DataFrame:
    """Sold and bought weight at each rebalance against the previous one (first: all bought)."""
    marks = _marks(weights, by)
    return marks.select(*by, "_k", "ts").join(_changes(weights.join(marks, [*by, "ts"]), by), [*by, "_k"])


def _earned(held: DataFrame, returns: DataFrame, by) -> DataFrame:
    """``by, ts, ret``: what each held symbol adds to a date's return, one row per position and date.

    A weight holds from its date (not included) to the next one of its strategy. It meets the returns of its symbol
    month by month, so the join has equal keys and reads each return once per strategy that holds the symbol.
    """
    end = returns.agg(F.max("ts").alias("_end"))  # one row
    x = held.join(F.broadcast(end)).select(*by, "symbol", "weight", F.col("ts").alias("_from"), F.coalesce("_next", "_end").alias("_to"))
    x = x.filter(F.col("_from") < F.col("_to")).withColumn("_month", F.explode(F.sequence(
        F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))))
    r = returns.select("symbol", "ts", "ret", F.trunc("ts", "month").alias("_month"))
    return (x.join(r, ["symbol", "_month"]).filter((F.col("ts") > F.col("_from")) & (F.col("ts") <= F.col("_to")))
            .select(*by, "ts", (F.col("weight") * F.coalesce(F.col("ret"), F.lit(0.0))).alias("ret")))


def _grid(held: DataFrame, returns: DataFrame, by) -> DataFrame:
    """Every date of the returns for every strategy: as many rows as the result has."""
    return returns.select("ts").distinct().crossJoin(held.select(*by).distinct()).select(*by, "ts", F.lit(0.0).alias("ret"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, by: Sequence[str] = (SID,)) -> DataFrame:
    """Return of each date under the weights of the last rebalance before it; missing returns are 0.

    Every date of the returns is in the result, for every strategy.
    """
    by = list(by)
    held = weights.join(_marks(weights, by), [*by, "ts"])
    return _grid(held, returns, by).unionByName(_earned(held, returns, by)).groupBy(*by, "ts").agg(F.sum("ret").alias("ret"))


def rotation_nav(weights: DataFrame, returns: DataFrame, *, commission: float = 0.0, stamp: float = 0.0,
                 style_costs: bool = False, by: Sequence[str] = (SID,)) -> DataFrame:
    """Net asset value from 1: yesterday's weights earn today's return, then today's rebalance costs.

    Cost factor 1 - sold*(commission + stamp) - bought*commission, none for the first entry. With
    ``style_costs`` it is (1 - t*commission)*... on half the total change, the entry included:
    one commission and one stamp charge in sequence.

    The weights with their marks are written once; dates, earnings and costs meet in one aggregate.
    """
    by = list(by)
    held = materialize(weights.join(_marks(weights, by), [*by, "ts"]), "held")
    moves = _changes(held, by).join(held.select(*by, "_k", "ts").distinct(), [*by, "_k"])
    if style_costs:
        t = (F.col("sold") + F.col("bought")) / 2
        cost = (1 - t * commission) * (1 - t * stamp)
    else:
        cost = F.when(F.col("_k") == 1, 1.0).otherwise(
            1 - F.col("sold") * (commission + stamp) - F.col("bought") * commission)
    # a cost counts on dates of the returns only, which the grid marks
    parts = [_grid(held, returns, by).select("*", F.lit(None).cast("double").alias("_c"), F.lit(True).alias("_day")),
             _earned(held, returns, by).select("*", F.lit(None).cast("double").alias("_c"), F.lit(None).cast("boolean").alias("_day")),
             moves.select(*by, "ts", F.lit(0.0).alias("ret"), cost.alias("_c"), F.lit(None).cast("boolean").alias("_day"))]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*by, "ts").agg(
        F.sum("ret").alias("ret"), F.max("_c").alias("_c"), F.max("_day").alias("_day")).filter("_day")
    o = W.partitionBy(*by).orderBy("ts")
    x = x.withColumn("ret", F.when(F.row_number().over(o) == 1, 0.0).otherwise(F.col("ret")))
    run = o.rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.select(*by, "ts", "ret", F.product((1 + F.col("ret")) * F.coalesce("_c", F.lit(1.0))).over(run).alias("nav"))


def signal_nav(signal: DataFrame, returns: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Long while the previous row's signal is positive, flat otherwise."""
    x = returns.join(signal.select(*by, "ts", "signal"), [*by, "ts"], "left")
    o = W.partitionBy(*by).orderBy("ts")
    held = F.when(F.lag("signal").over(o) > 0, F.coalesce(F.col("ret"), F.lit(0.0))).otherwise(0.0)
    x = x.withColumn("_r", held)
    run = o.rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.select(*by, "ts", F.product(1 + F.col("_r")).over(run).alias("nav"))


def buy_and_hold(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    w = W.partitionBy(*by).orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.first("close", ignorenulls=True).over(w)
    return bars.select(*by, "ts", F.when(first != 0, F.col("close") / first).alias("nav"))


# -- styles --------------------------------------------------------------------------------------------------
def style_picks(style_scores: DataFrame, styles: DataFrame) -> DataFrame:
    """Top picks per style and date; ``styles(style, capital_weight, top_n)`` is a small dimension."""
    r = ranked(style_scores.join(styles, "style"), ("style",))
    return r.filter(F.col("rank") <= F.col("top_n"))


def compose_styles(picks: DataFrame) -> DataFrame:
    """Capital of each style spread over its picks, summed per symbol, with the list of styles."""
    n = F.count(F.lit(1)).over(W.partitionBy("style", "ts"))
    x = picks.withColumn("_w", F.col("capital_weight") / n)
    return x.groupBy("ts", "symbol").agg(F.sum("_w").alias("weight"),
                                         F.array_sort(F.collect_list("style")).alias("styles"))


def style_overlap(picks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean over dates of |A and B| / max(|A|, |B|) per pair of the named styles.

    One flag per style and (date, symbol), then plain sums: no pairs of rows are formed.
    """
    has = picks.groupBy("ts", "symbol").agg(*[
        F.max(F.when(F.col("style") == s, 1).otherwise(0)).alias(f"_s{i}") for i, s in enumerate(names)])
    pairs = list(combinations(range(len(names)), 2))
    daily = has.groupBy("ts").agg(
        *[F.sum(f"_s{i}").alias(f"_n{i}") for i in range(len(names))],
        *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_p{i}_{j}") for i, j in pairs])
    share = [F.avg(F.when(F.greatest(f"_n{i}", f"_n{j}") > 0, F.col(f"_p{i}_{j}") / F.greatest(f"_n{i}", f"_n{j}")))
             .alias(f"_o{i}_{j}") for i, j in pairs]
    one = daily.agg(*share)
    rows = F.array(*[F.struct(F.lit(names[i]).alias("style_a"), F.lit(names[j]).alias("style_b"),
                              F.col(f"_o{i}_{j}").alias("overlap")) for i, j in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def picks_matrix(picks: DataFrame, names: Sequence[str]) -> DataFrame:
    return picks.groupBy("ts", "symbol").pivot("style", list(names)).agg(F.lit(True)).na.fill(False)


def signal_correlation(signals: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """Correlation matrix of signal columns, missing values as 0: one pass, one row per pair."""
    x = signals.select(*[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
    pairs = [(a, b) for a in names for b in names]
    one = x.agg(*[F.round(corr_agg(a, b), digits).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")
