"""Factor validation on long tables ``(factor_id, ts, symbol, value, ret)``.

All factors are evaluated in one job. The caller says which return goes with which value; use
:func:`forward_returns` for multi-period returns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.feature import flag
from quantloom.operators.stats import corr_agg, kurt_pandas, quotient, skew_pandas, t_pvalue
from quantloom.plans.passes import whole_series

BY = ("factor_id",)


# name -> (order, function of pairs returning one row per factor)
VALIDATIONS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def validation(name: str, order: int = 99):
    """Decorator for a custom validation: ``pairs -> one row per factor_id``."""
    def wrap(fn):
        VALIDATIONS[name] = (order, fn)
        return fn
    return wrap


def run_validations(pairs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per factor with the columns of all chosen validations, prefixed by their names."""
    chosen = sorted(names or VALIDATIONS, key=lambda n: (VALIDATIONS[n][0], n))
    out = pairs.select(*BY).distinct()
    for n in chosen:
        part = VALIDATIONS[n][1](pairs)
        out = out.join(part.select(*BY, *[F.col(c).alias(f"{n}_{c}") for c in part.columns if c not in BY]), list(BY), "left")
    return out


def data_checks(factors: DataFrame, by: Sequence[str] = BY, minimum: float = 0.7) -> DataFrame:
    n, present = F.count(F.lit(1)), F.count("value")
    return factors.groupBy(*by).agg(
        n.alias("n"), present.alias("present"), (present / n).alias("coverage"),
        (present / n < minimum).alias("sparse"))


def valid_factors(factors: DataFrame, by: Sequence[str] = BY, minimum: float = 0.5) -> DataFrame:
    """Factors that are neither constant, nor empty, nor mostly missing."""
    good = (factors.groupBy(*by)
            .agg((F.count("value") / F.count(F.lit(1))).alias("c"), F.stddev_pop("value").alias("s"))
            .filter((F.col("c") >= minimum) & (F.col("s") >= 1e-10)).select(*by))
    return factors.join(good, list(by), "left_semi")


def average_rank(x: str, part: Sequence[str]) -> Column:
    """Average rank of ties among present values, in one sort."""
    w = W.partitionBy(*part).orderBy(F.col(x).asc_nulls_last())
    upto = F.count(x).over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) + upto) / 2.0)


def daily_ic(pairs: DataFrame, method: str = "spearman", min_pairs: int = 10,
             by: Sequence[str] = BY) -> DataFrame:
    """Correlation of value and return across symbols, per date with enough pairs."""
    both = pairs.filter(F.col("value").isNotNull() & F.col("ret").isNotNull())
    if method == "spearman":
        part = [*by, "ts"]
        both = both.select(*part, average_rank("value", part).alias("value"),
                           average_rank("ret", part).alias("ret"))
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    return (both.groupBy(*by, "ts").agg(F.count(F.lit(1)).alias("n"), corr_agg("value", "ret").alias("ic"))
            .filter((F.col("n") >= min_pairs) & F.col("ic").isNotNull()))


def without_end_dates(pairs: DataFrame) -> DataFrame:
    """Drop the first and the last date, as the one-period alignment does."""
    ends = pairs.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return (pairs.join(F.broadcast(ends)).filter((F.col("ts") > F.col("_a")) & (F.col("ts") < F.col("_b")))
            .drop("_a", "_b"))


def ic_summary(ic: DataFrame, by: Sequence[str] = BY, p_value: bool = False) -> DataFrame:
    """mean, std (population), ir, positive ratio and t statistic of the daily coefficients."""
    n, s = F.count("ic"), F.stddev_samp("ic")
    out = ic.groupBy(*by).agg(
        n.alias("days"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("std"),
        quotient(F.avg("ic"), F.stddev_pop("ic")).alias("ir"),
        F.avg(flag(F.col("ic") > 0)).alias("positive_ratio"),
        F.when(s > 0, F.avg("ic") / (s / F.sqrt(n))).alias("t_stat"))
    if p_value:
        out = out.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("days") - 1))
    return out


def forward_returns(returns: DataFrame, n: int, ret: str = "ret") -> DataFrame:
    """Return compounded over rows t .. t+n-1; rows without n returns ahead are missing."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(0, n - 1)
    value = F.when(F.count(ret).over(w) == n, F.product(1.0 + F.col(ret)).over(w) - 1.0)
    return returns.withColumn("fwd", value)


def ic_decay(pairs: DataFrame, max_lag: int = 20, method: str = "spearman",
             by: Sequence[str] = BY) -> DataFrame:
    """Mean IC per horizon 1..max_lag: one window stage for all horizons, then long rows."""
    series = W.partitionBy(*by, "symbol").orderBy("ts")
    lags = []
    for n in range(1, max_lag + 1):
        w = series.rowsBetween(0, n - 1)
        lags.append(F.when(F.count("ret").over(w) == n, F.product(1.0 + F.col("ret")).over(w) - 1.0))
    long = (pairs.select(*by, "ts", "symbol", "value", F.array(*lags).alias("_l"))
            .filter(F.col("value").isNotNull())
            .select(*by, "ts", "symbol", "value", F.posexplode("_l").alias("_i", "ret"))
            .withColumn("lag", F.col("_i") + 1))
    ic = daily_ic(long, method, by=[*by, "lag"])
    return ic.groupBy(*by, "lag").agg(F.avg("ic").alias("ic"))


def half_life(decay: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Exponential decay of |IC| over the lag: rate and half-life (infinite when not decaying)."""
    y = F.when(F.abs("ic") > 0, F.log(F.abs("ic")))
    rate = -F.regr_slope(y, F.col("lag").cast("double"))
    return (decay.groupBy(*by).agg(F.count(y).alias("lags"), rate.alias("decay_rate"))
            .withColumn("half_life", F.when(F.col("lags") >= 3, F.when(
                F.col("decay_rate") > 0, F.log(F.lit(2.0)) / F.col("decay_rate"))
                .otherwise(F.lit(float("inf"))))))


def quantile_groups(factors: DataFrame, k: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """Groups 1..k of equal width in rank per date (first-come ties by symbol); dates with fewer
    than k values have none."""
    part = W.partitionBy(*by, "ts")
    present = factors.filter(F.col("value").isNotNull())
    r = F.row_number().over(part.orderBy("value", "symbol"))
    n = F.count(F.lit(1)).over(part)
    group = F.when(r == 1, 1).otherwise(F.ceil((r - 1) * k / F.when(n > 1, n - 1)).cast("int"))
    return present.withColumns({"_n": n, "group": group}).filter(F.col("_n") >= k).drop("_n")


def turnover(groups: DataFrame, k: int = 10, lag: int = 1, by: Sequence[str] = BY) -> DataFrame:
    """Share of symbols whose group changed against ``lag`` dates before: overall, top, bottom."""
    dates = (groups.select(*by, "ts").distinct()
             .withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("ts"))))
    g = groups.join(dates, [*by, "ts"])
    before = F.first("group").over(W.partitionBy(*by, "symbol").orderBy("_i").rangeBetween(-lag, -lag))
    c = g.withColumn("_b", before).filter(F.col("_b").isNotNull())
    moved = flag(F.col("group") != F.col("_b"))
    daily = c.groupBy(*by, "ts").agg(
        F.avg(moved).alias("all_"), F.avg(F.when(F.col("_b") == k, moved)).alias("top_"),
        F.avg(F.when(F.col("_b") == 1, moved)).alias("bottom_"))
    return daily.groupBy(*by).agg(F.avg("all_").alias("mean"), F.avg("top_").alias("top"),
                                  F.avg("bottom_").alias("bottom"), F.stddev_pop("all_").alias("std"))


def hit_rate(pairs: DataFrame, min_pairs: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """Share of pairs on the same side of both medians of their date."""
    both = pairs.filter(F.col("value").isNotNull() & F.col("ret").isNotNull())
    med = both.groupBy(*by, "ts").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile("value", 0.5).alias("_v"),
        F.percentile("ret", 0.5).alias("_r")).filter(F.col("_n") >= min_pairs)
    same = (F.col("value") > F.col("_v")) == (F.col("ret") > F.col("_r"))
    return both.join(med, [*by, "ts"]).groupBy(*by).agg(
        F.avg(flag(same)).alias("hit_rate"), F.count(F.lit(1)).alias("pairs"))


def yearly_ic(ic: DataFrame, min_days: int = 5, by: Sequence[str] = BY) -> DataFrame:
    return (ic.groupBy(*by, F.year("ts").alias("year")).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("mean"),
        quotient(F.avg("ic"), F.stddev_pop("ic")).alias("ir"),
        F.avg(flag(F.col("ic") > 0)).alias("positive_ratio")).filter(F.col("days") >= min_days))


def monthly_returns(returns: DataFrame, by: Sequence[str], ret: str = "ret") -> DataFrame:
    return returns.groupBy(*by, F.date_trunc("month", "ts").alias("month")).agg(
        (F.product(1.0 + F.col(ret)) - 1.0).alias("ret"))


def bootstrap_sharpe(returns: DataFrame, by: Sequence[str], *, ret: str = "ret", draws: int = 1000,
                     monthly: bool = True, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Confidence interval of the annualised Sharpe ratio by resampling with replacement.

    Needs 20 rows (and 12 months) and 100 usable draws. Each group's returns go to a task once, which picks the draws
    from them as vectors: no draw becomes rows of its own. Long groups are dealt again for each block of draws, so the
    work spreads over draws too. Draw positions come from a hash of (seed, draw, slot): a rerun or a lost task gives the
    same sample.
    """
    base = returns.filter(F.col(ret).isNotNull())
    for key in by:
        base = base.filter(F.col(key).isNotNull())
    base = base.withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*by))).filter(F.col("_rows") >= 20)
    if monthly:
        x = monthly_returns(base, by, ret).withColumnRenamed("month", "_t")
        year, minimum, block = 12.0, 12, draws
    else:
        x = base.select(*by, F.col("ts").alias("_t"), F.col(ret).alias("ret"))
        year, minimum, block = 252.0, 20, _DRAWS_TOGETHER
    x = x.select(*by, F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(block))).alias("_draw"), "_t", F.col("ret").cast("double").alias("ret"))
    x = x.repartition(*by, "_draw").sortWithinPartitions(*by, "_draw", "_t")
    schema = T.StructType([*x.select(*by).schema.fields, T.StructField("v", T.DoubleType())])
    sharpe = x.mapInArrow(_resampled(list(by), draws, block, seed, year, minimum), schema)
    tail = (1 - level) / 2
    return (sharpe.groupBy(*by).agg(
        F.count("v").alias("draws"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.percentile("v", tail).alias("low"), F.percentile("v", 1 - tail).alias("high"))
        .filter(F.col("draws") >= 100))


#: Draws of a long group that one task makes.
_DRAWS_TOGETHER = 50
#: Picks that a task holds at once.
_PICKS = 1 << 20


def _slot_hashes(seed: int, first: int, last: int, n: int) -> np.ndarray:
    """The hash of each draw (rows) and slot: the first 32 bits of md5."""
    raw = b"".join(hashlib.md5(b"%d-%d-%d" % (seed, d, i)).digest()[:4] for d in range(first, last) for i in range(n))
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(last - first, n)


def _resampled(by: list[str], draws: int, block: int, seed: int, year: float, minimum: int):
    """One row per draw of each group: the Sharpe ratio of its picks, missing where they do not vary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # hashes by first draw, for groups of usual length

        def hashes(first: int, last: int, n: int) -> np.ndarray:
            if (last - first) * n > _PICKS:
                return _slot_hashes(seed, first, last, n)
            if first not in known or known[first].shape[0] < last - first or known[first].shape[1] < n:
                known.clear()
                known[first] = _slot_hashes(seed, first, last, n)
            return known[first][:last - first, :n]

        def ratios(ret: np.ndarray, first: int) -> np.ndarray:
            n, end, out = len(ret), min(first + block, draws + 1), []
            step = max(1, _PICKS // n)
            for lo in range(first, end, step):
                # from the first return, so that equal picks have no deviation at all
                picks = (ret - ret[0])[hashes(lo, min(lo + step, end), n) % np.uint32(n)]
                mean = picks.mean(axis=1)
                s = np.sqrt(((picks - mean[:, None]) ** 2).sum(axis=1) / (n - 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out.append(np.ma.masked_array((mean + ret[0]) / s * np.sqrt(year), s == 0))
            return np.ma.concatenate(out)

        for table, first in whole_series(batches, [*by, "_draw"]):
            table = table.combine_chunks()
            ret, block_of = table.column("ret").to_numpy(), table.column("_draw").to_numpy()
            rows, found, size = [], [], 0
            ends = np.append(first[1:], len(ret))
            for lo, hi in zip(first.tolist(), ends.tolist()):
                if hi - lo >= minimum:
                    found.append(ratios(ret[lo:hi], int(block_of[lo])))
                    rows.append(lo)
                    size += len(found[-1])
                if found and (size >= _PICKS or hi == len(ret)):
                    v = np.ma.concatenate(found)
                    at = pa.array(np.repeat(rows, [len(f) for f in found]))
                    out = table.select(by).take(at).append_column("v", pa.array(v.data, pa.float64(), mask=np.ma.getmaskarray(v)))
                    yield from out.combine_chunks().to_batches()
                    rows, found, size = [], [], 0
    return run


# -- batch evaluation of many factors -----------------------------------------------------------------
def factor_table(pairs: DataFrame, *, method: str = "pearson", min_pairs: int = 5, min_days: int = 30,
                 compat: bool = False, by: Sequence[str] = BY) -> DataFrame:
    """ic_mean, ic_std (sample), icir, hit rate and yearly stability per factor.

    Yearly stability is the share of years whose mean IC has the sign of the overall mean.
    ``compat=True`` averages only the agreeing years instead, which is 1 or missing.
    """
    ic = daily_ic(pairs, method, min_pairs, by)
    total = ic.groupBy(*by).agg(
        F.count("ic").alias("days"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg(flag(F.col("ic") > 0)).alias("hit")).filter(F.col("days") >= min_days)
    years = ic.groupBy(*by, F.year("ts").alias("_y")).agg(F.avg("ic").alias("_m"))
    same = F.signum("_m") == F.signum("ic_mean")
    share = F.max(F.when(same, 1.0)) if compat else F.avg(flag(same))
    stable = years.join(total.select(*by, "ic_mean"), list(by)).groupBy(*by).agg(
        share.alias("yearly_stability"))
    return total.join(stable, list(by)).withColumn("icir", quotient(F.col("ic_mean"), F.col("ic_std")))


def breadth_gate(table: DataFrame, breadth: Column, *, icir_min=0.1, hit_min=0.5, stable_min=0.5,
                 stable_medium=0.4) -> DataFrame:
    """Pass flag by the number of symbols: |ICIR|, hit rate and yearly stability from 100 on, hit
    rate and a lower stability from 50 on, nothing below (the IC says too little there)."""
    full = (F.abs("icir") >= icir_min) & (F.col("hit") >= hit_min) & (F.col("yearly_stability") >= stable_min)
    loose = (F.col("hit") >= hit_min) & (F.col("yearly_stability") >= stable_medium)
    return table.withColumn("passed", F.when(breadth >= 100, full).when(breadth >= 50, loose).otherwise(True))


def quick_ic(table: DataFrame, min_icir: float = 0.0) -> DataFrame:
    """Factors by |IC|, keeping those with enough |ICIR|."""
    return table.filter(F.abs("icir") >= min_icir).orderBy(F.abs("ic_mean").desc(), *BY)


def explorer_order(table: DataFrame) -> DataFrame:
    """Sort by |IC| * max(IR, 0); adds the ICIR score |IC| * ICIR * 100."""
    return (table.withColumns({"explore": F.abs("ic_mean") * F.greatest("icir", F.lit(0.0)),
                               "icir_score": F.abs("ic_mean") * F.col("icir") * 100})
            .orderBy(F.col("explore").desc(), *BY))


def best_frequency(scores: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Best Sharpe over rebalance variants ``(factor_id, freq, sharpe)``."""
    return scores.groupBy(*by).agg(F.max("sharpe").alias("sharpe"), F.max_by(
        "freq", F.struct("sharpe", "freq")).alias("freq"))


def funnel(table: DataFrame, sharpe: DataFrame, *, hit_min=0.5, stable_min=0.5,
           by: Sequence[str] = BY) -> DataFrame:
    """Cheap gate first, then Sharpe only for the factors that pass (others score 0)."""
    passed = table.filter((F.col("hit") >= hit_min) & (F.col("yearly_stability") >= stable_min))
    scored = passed.join(sharpe, list(by), "left").select(*by, F.coalesce("sharpe", F.lit(0.0)).alias("score"))
    return table.select(*by).join(scored, list(by), "left").select(
        *by, F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNotNull().alias("passed"))


def factor_profile(pairs: DataFrame, *, clip: float = 100.0, last_changes: int = 20, rows: int = 252,
                   by: Sequence[str] = BY) -> DataFrame:
    """Eight statistics per factor; missing and infinite values count as 0.

    Mean, std, skew (within +-5), kurtosis (1 to 15; not excess) and share of positive values, all of values within
    +-``clip``; lag-1 autocorrelation of the date means; mean of the top fifth over the size of the mean; and rank
    turnover: the mean change of a symbol's place over the number of symbols, on the last ``last_changes`` of the
    first ``rows`` dates. Equal values are placed by symbol.
    """
    by = list(by)
    x = F.col("value")
    v = pairs.select(*by, "ts", "symbol", F.when(F.abs(x) < float("inf"), x).otherwise(0.0).alias("_x"))
    v = v.withColumn("_v", F.least(F.greatest("_x", F.lit(-clip)), F.lit(clip)))
    base = v.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.avg(flag(F.col("_v") > 0)).alias("hit"),
                              F.percentile("_v", 0.8).alias("_q"), F.count(F.lit(1)).alias("_n"))
    d = F.col("_v") - F.col("mean")
    cube = F.avg(d * d * d) / F.pow(F.first("std"), F.lit(3.0))
    fourth = F.avg(d * d * d * d) / F.pow(F.first("std"), F.lit(4.0))
    top = F.avg(F.when(F.col("_v") >= F.when(F.col("_n") >= 5, F.col("_q")).otherwise(F.col("mean")), F.col("_v")))
    shape = v.join(base, by).groupBy(*by).agg(
        F.when(F.first("std") > 1e-10, F.least(F.greatest(cube, F.lit(-5.0)), F.lit(5.0))).otherwise(0.0).alias("skew"),
        F.when(F.first("std") > 1e-10, F.least(F.greatest(fourth, F.lit(1.0)), F.lit(15.0))).otherwise(0.0).alias("kurtosis"),
        (top / (F.abs(F.first("mean")) + 1e-10)).alias("top_ratio"))
    w = W.partitionBy(*by).orderBy("ts")
    means = v.groupBy(*by, "ts").agg(F.avg("_x").alias("_m")).withColumn("_i", F.row_number().over(w))
    m = F.col("_m") - F.avg("_m").over(W.partitionBy(*by))
    auto = means.withColumn("_c", m).withColumn("_b", F.lag("_c").over(w)).groupBy(*by).agg(
        F.sum(F.col("_c") * F.col("_b")).alias("_u"), F.sum(F.col("_c") * F.col("_c")).alias("_s"))
    auto = auto.select(*by, F.when(F.col("_s") > 1e-10, F.col("_u") / F.col("_s")).otherwise(0.0).alias("autocorr"))
    kept = v.join(means.filter(F.col("_i") <= rows).select(*by, "ts", "_i"), [*by, "ts"])
    day = W.partitionBy(*by, "ts")
    kept = kept.select(*by, "symbol", "_i", F.row_number().over(day.orderBy("_x", "symbol")).alias("_r"), F.count(F.lit(1)).over(day).alias("_d"))
    before = F.first("_r").over(W.partitionBy(*by, "symbol").orderBy("_i").rangeBetween(-1, -1))
    days = kept.withColumn("_b", before).filter(F.col("_b").isNotNull()).groupBy(*by, "_i").agg(
        (F.avg(F.abs(F.col("_r") - F.col("_b"))) / F.max("_d")).alias("_t"))
    last = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_i")))
    change = days.withColumn("_k", last).filter(F.col("_k") <= last_changes).groupBy(*by).agg(F.avg("_t").alias("rank_turnover"))
    return (base.drop("_q", "_n").join(shape, by).join(auto, by, "left").join(change, by, "left")
            .fillna(0.0, ["autocorr", "rank_turnover"]))


def prediction_gate(rows: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Score of predictions ``(model_id, y, yhat)``: minus the mean squared error, or -inf when
    fewer than 10 are finite, the prediction is (nearly) constant, or its variance is below 1e-3
    of the target's. Predictions are clipped to ten deviations of the target around its mean."""
    ok = rows.filter(F.col("y").isNotNull() & (F.abs("yhat") < float("inf")))
    stats = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("_my"),
                                F.stddev_pop("y").alias("_sy"))
    x = ok.join(stats, list(by))
    clipped = F.least(F.greatest("yhat", F.col("_my") - 10 * F.col("_sy")), F.col("_my") + 10 * F.col("_sy"))
    x = x.withColumn("_p", clipped)
    out = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("y") - F.col("_p"), F.lit(2.0))).alias("mse"),
        F.stddev_pop("_p").alias("_sp"), F.var_pop("_p").alias("_vp"), F.var_pop("y").alias("_vy"))
    good = (F.col("n") >= 10) & (F.col("_sp") > 1e-8) & (F.col("_vp") >= 1e-3 * F.col("_vy"))
    return out.select(*by, "n", F.when(F.col("n") >= 10, F.col("mse")).otherwise(float("inf")).alias("mse"),
                      F.when(good, -F.col("mse")).otherwise(float("-inf")).alias("score"))


VALIDATIONS |= {
    "ic": (10, lambda pairs: ic_summary(daily_ic(pairs))),
    "hit": (15, hit_rate),
    "turnover": (20, lambda pairs: turnover(quantile_groups(pairs))),
    "decay": (21, lambda pairs: half_life(ic_decay(pairs))),
}
