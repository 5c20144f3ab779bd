"""Monitoring of single-series signals: long tables ``(expr_id, symbol, ts, signal, close)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import flag
from quantloom.functions.rolling import expanding_median
from quantloom.operators import nav as nv
from quantloom.operators.portfolio import signal_nav
from quantloom.operators.stats import corr_agg, kurt_pandas, quotient, skew_pandas, t_pvalue
from quantloom.operators.validation import average_rank
from quantloom.plans.panel import with_features

BY = ("expr_id", "symbol")
HORIZONS = (1, 3, 5, 10, 20)


def horizon_pairs(rows: DataFrame, horizons: Sequence[int] = HORIZONS, by: Sequence[str] = BY) -> DataFrame:
    """Yesterday's signal with the return over each horizon, as long rows."""
    w = W.partitionBy(*by).orderBy("ts")
    ahead = [F.when(F.col("close") != 0, F.lead("close", n).over(w) / F.col("close") - 1) for n in horizons]
    x = rows.select(*by, "ts", F.lag("signal").over(w).alias("value"), F.array(*ahead).alias("_a"))
    x = x.select(*by, "ts", "value", F.posexplode("_a").alias("_i", "ret"))
    names = F.array(*[F.lit(n) for n in horizons])
    return (x.withColumn("horizon", names[F.col("_i")]).drop("_i")
            .filter(F.col("value").isNotNull() & F.col("ret").isNotNull()))


def basic_ic(pairs: DataFrame, min_pairs: int = 10, by: Sequence[str] = BY) -> DataFrame:
    """Pearson and rank correlation per horizon, with t statistics."""
    part = [*by, "horizon"]
    x = pairs.withColumns({"_rv": average_rank("value", part), "_rr": average_rank("ret", part)})
    out = x.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), corr_agg("value", "ret").alias("ic"),
                               corr_agg("_rv", "_rr").alias("rank_ic")).filter(F.col("n") >= min_pairs)

    def t(r):
        rest = 1 - F.col(r) * F.col(r)
        return F.when(rest > 0, F.col(r) * F.sqrt((F.col("n") - 2) / rest))
    return out.withColumns({"t_stat": t("ic"), "rank_t": t("rank_ic")})


def significance(ic: DataFrame) -> DataFrame:
    return ic.withColumns({"p_value": t_pvalue(F.col("t_stat"), F.col("n") - 2),
                           "rank_p": t_pvalue(F.col("rank_t"), F.col("n") - 2)})


def rolling_ic(pairs: DataFrame, d: int = 60, by: Sequence[str] = BY) -> DataFrame:
    """Correlation over ``d`` consecutive pairs of one horizon; missing until d pairs exist."""
    w = W.partitionBy(*by, "horizon").orderBy("ts").rowsBetween(-(d - 1), 0)
    a, b = F.stddev_samp("value").over(w), F.stddev_samp("ret").over(w)
    ic = F.when((F.count(F.lit(1)).over(w) == d) & (a > 1e-10) & (b > 1e-10),
                F.covar_samp("value", "ret").over(w) / (a * b))
    return pairs.select(*by, "horizon", "ts", ic.alias("ic"))


def rolling_summary(rolled: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    s = F.stddev_samp("ic")
    return rolled.filter(F.col("ic").isNotNull()).groupBy(*by, "horizon").agg(
        F.avg("ic").alias("mean"), s.alias("std"), quotient(F.avg("ic"), s).alias("ir"),
        F.avg(flag(F.col("ic") > 0)).alias("positive"), F.min("ic").alias("min"), F.max("ic").alias("max"))


def ic_decay_speed(ic: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(|IC of the first horizon| - |IC of the last|) / horizon span."""
    first, last = F.min_by("ic", "horizon"), F.max_by("ic", "horizon")
    span = F.max("horizon") - F.min("horizon")
    return ic.groupBy(*by).agg(F.when(span > 0, (F.abs(first) - F.abs(last)) / span).alias("decay"))


def annual_ic(pairs: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    out = pairs.groupBy(*by, "horizon", F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), corr_agg("value", "ret").alias("ic"))
    rest = 1 - F.col("ic") * F.col("ic")
    return out.withColumn("t_stat", F.when((F.col("n") >= 30) & (rest > 0),
                                           F.col("ic") * F.sqrt((F.col("n") - 2) / rest)))


def cumulative_ic(rolled: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    w = W.partitionBy(*by, "horizon").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rolled.filter(F.col("ic").isNotNull()).withColumn("cum_ic", F.sum("ic").over(w))


def signal_turnover(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    w = W.partitionBy(*by).orderBy("ts")
    x = rows.select(*by, F.abs(F.col("signal") - F.lag("signal").over(w)).alias("c")).filter(F.col("c").isNotNull())
    stats = x.groupBy(*by).agg(F.avg("c").alias("mean"), F.max("c").alias("max"), F.min("c").alias("min"),
                               F.stddev_samp("c").alias("std"))
    high = x.join(stats, list(by)).groupBy(*by).agg(F.sum(F.when(
        F.col("c") > F.col("mean") + 2 * F.col("std"), 1).otherwise(0)).alias("high_days"))
    return stats.join(high, list(by))


def ic_distribution(rolled: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Moments, quantiles and the Jarque-Bera test of the rolling coefficients."""
    q = F.percentile("ic", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.75, 0.95)]))
    out = rolled.filter(F.col("ic").isNotNull()).groupBy(*by, "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"),
        skew_pandas("ic").alias("skew"), kurt_pandas("ic").alias("kurtosis"), q.alias("_q"),
        F.when(F.stddev_pop("ic") > 1e-10, F.skewness("ic")).alias("_s"),
        F.when(F.stddev_pop("ic") > 1e-10, F.kurtosis("ic")).alias("_k"))
    jb = F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    return out.select(*by, "horizon", "n", "mean", "std", "skew", "kurtosis",
                      *[F.col("_q")[i].alias(f"q{p:02d}") for i, p in enumerate((5, 25, 75, 95))],
                      jb.alias("jb"), F.exp(-jb / 2).alias("jb_p"))


def full_window_ic(rows: DataFrame, horizon: int = 5, d: int = 60, by: Sequence[str] = BY) -> DataFrame:
    """Rolling coefficient of signal and forward return where all ``d`` pairs are present."""
    w = W.partitionBy(*by).orderBy("ts")
    ahead = F.when(F.col("close") != 0, F.lead("close", horizon).over(w) / F.col("close") - 1)
    pairs = rows.select(*by, "ts", F.col("signal").alias("value"), ahead.alias("ret"))
    # positions keep gaps: a window with a missing pair has no coefficient
    f = w.rowsBetween(-(d - 1), 0)
    ok = F.col("value").isNotNull() & F.col("ret").isNotNull()
    pairs = pairs.select(*by, "ts", F.when(ok, F.col("value")).alias("v"), F.when(ok, F.col("ret")).alias("r"))
    a, b = F.stddev_samp("v").over(f), F.stddev_samp("r").over(f)
    ic = F.when((F.count("v").over(f) == d) & (a > 1e-10) & (b > 1e-10),
                F.covar_samp("v", "r").over(f) / (a * b))
    return pairs.select(*by, "ts", ic.alias("ic")).filter(F.col("ic").isNotNull())


def rolling_icir(rows: DataFrame, horizon: int = 5, d: int = 60, window: int = 252, by: Sequence[str] = BY) -> DataFrame:
    """Mean over deviation of the last ``window`` rolling coefficients (0 where they are all equal)."""
    f = W.partitionBy(*by).orderBy("ts").rowsBetween(-(window - 1), 0)
    s = F.stddev_samp("ic").over(f)
    icir = F.when(F.count("ic").over(f) == window, F.when(s > 0, F.avg("ic").over(f) / s).otherwise(0.0))
    return full_window_ic(rows, horizon, d, by).select(*by, "ts", "ic", icir.alias("icir"))


def decay_monitor(rows: DataFrame, horizon: int = 5, d: int = 60, by: Sequence[str] = BY) -> DataFrame:
    """State of each signal: rolling IC means (all, last 180, last 90), trend, alert level.

    Fewer than 30 coefficients are too few: recent means and trend are then 0 and the level is NORMAL.
    """
    w = W.partitionBy(*by).orderBy("ts")
    x = full_window_ic(rows, horizon, d, by)
    x = x.withColumns({"_i": (F.row_number().over(w) - 1).cast("double"),
                       "_back": F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts")))})

    def recent(n, value):
        return F.avg(F.when(F.col("_back") <= n, value))
    s = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_full"), recent(90, F.col("ic")).alias("_90"),
        recent(180, F.col("ic")).alias("_180"), recent(90, flag(F.col("ic") < 0)).alias("_neg"),
        F.regr_slope("ic", "_i").alias("_b"), F.regr_intercept("ic", "_i").alias("_a"),
        F.regr_r2("ic", "_i").alias("_r2"))
    n = F.col("n")
    trend, some = n >= 30, n >= 30
    s = s.select(
        *by, "n", "ic_full", F.when(n >= 90, F.col("_90")).when(some, F.col("ic_full")).otherwise(0.0).alias("ic_90"),
        F.when(n >= 180, F.col("_180")).when(some, F.col("ic_full")).otherwise(0.0).alias("ic_180"),
        F.when(trend, F.coalesce("_b", F.lit(0.0))).otherwise(0.0).alias("slope"),
        F.when(trend, F.coalesce("_r2", F.lit(0.0))).otherwise(0.0).alias("trend_r2"),
        F.when(trend & (F.abs("_b") > 1e-10) & (F.col("_a") != 0), F.abs(F.col("_a") / F.col("_b"))).alias("days_to_zero"),
        F.when(n >= 90, F.col("_neg")).otherwise(0.0).alias("negative_90"))
    s = s.withColumn("decay_per_month", F.col("slope") * 21)
    full, near, rate = F.col("ic_full"), F.abs("ic_90"), F.col("decay_per_month")
    against = ((full > 0) & (rate < 0)) | ((full < 0) & (rate > 0))
    level = (F.when(n < 30, "NORMAL")
             .when((F.abs(full) < 0.03) | (near < 0.03) | (near < F.abs(full) * 0.3), "DEAD")
             .when((F.col("trend_r2") > 0.3) & (F.abs(rate) > 1e-4) & against, "DECAYING")
             .when(near < F.abs(full) * 0.5, "DECAYING")
             .when((full > 0) & (F.col("negative_90") > 0.6), "REVERSED")
             .when((full < 0) & (F.col("negative_90") < 0.4), "REVERSED").otherwise("NORMAL"))
    return s.withColumn("alert", level)


def regimes(rows: DataFrame, horizon: int = 5, by: Sequence[str] = BY) -> DataFrame:
    """One row per (time, regime): volatility terciles of the 20-row change, trend against the
    mean of 40 rows (3 %), volume against its mean of 20 rows (0.7 / 1.3)."""
    w = W.partitionBy(*by).orderBy("ts")
    rn = F.row_number().over(w)
    c = F.col("close")
    x = rows.withColumns({
        "_mv": F.abs(quotient(c, F.lag("close", 20).over(w)) - 1),
        "_ma": F.when(rn >= 40, F.avg("close").over(w.rowsBetween(-39, 0))),
        "_vm": F.when(rn >= 20, F.avg("volume").over(w.rowsBetween(-19, 0))),
        "ret": quotient(F.lead("close", horizon).over(w), c) - 1})
    q = x.groupBy(*by).agg(F.percentile("_mv", F.array(F.lit(0.33), F.lit(0.67))).alias("_q"))
    x = x.join(q, list(by))
    mv, dev, vr = F.col("_mv"), (c - F.col("_ma")) / F.col("_ma") * 100, quotient(F.col("volume"), F.col("_vm"))
    vol = F.when(mv >= F.col("_q")[1], "vol_high").when(mv >= F.col("_q")[0], "vol_mid").when(mv.isNotNull(), "vol_low")
    trend = F.when(dev > 3, "trend_up").when(dev < -3, "trend_down").when(dev.isNotNull(), "trend_flat")
    volume = F.when(vr > 1.3, "volume_high").when(vr < 0.7, "volume_low").when(vr.isNotNull(), "volume_normal")
    return (x.select(*by, "ts", "signal", "ret", F.explode(F.array(vol, trend, volume)).alias("regime"))
            .filter(F.col("regime").isNotNull()))


def regime_performance(tagged: DataFrame, min_rows: int = 20, by: Sequence[str] = BY) -> DataFrame:
    """IC, mean return and direction accuracy (against the running median) per regime."""
    part = [*by, "regime"]
    w = W.partitionBy(*part).orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = with_features(tagged.withColumn("_n", F.count("signal").over(w)), {"_m": expanding_median("signal", 1)}, symbol=part)
    x = x.withColumn("_up", flag((F.col("_n") >= 10) & (F.col("signal") > F.col("_m")))).drop("_n", "_m")
    both = F.col("signal").isNotNull() & F.col("ret").isNotNull()
    x = x.withColumns({"_s": F.when(both, F.col("signal")), "_r": F.when(both, F.col("ret"))})
    out = x.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"), corr_agg("_s", "_r").alias("ic"),
        (F.avg("ret") * 100).alias("mean_return"),
        (F.avg(flag(F.col("_up") == flag(F.col("ret") > 0))) * 100).alias("accuracy"))
    return out.filter(F.col("n") >= min_rows)


def fill_signal(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Missing signals take the median of their series (0 without any), as explanations do before they start."""
    median = rows.groupBy(*by).agg(F.coalesce(F.percentile("signal", 0.5), F.lit(0.0)).alias("_m"))
    return rows.join(median, list(by)).withColumn("signal", F.coalesce("signal", "_m")).drop("_m")


def explain_overall(rows: DataFrame, horizon: int = 5, warmup: int = 20, by: Sequence[str] = BY) -> DataFrame:
    """``ic, annual_return, sharpe, max_drawdown, win_rate`` of a signal on its whole series.

    The coefficient is that of the filled signal and the return over ``horizon`` rows. The values come from holding
    while the previous row's signal was above the median of its history; the win rate is the share of closed holdings
    with a profit (0 without any).
    """
    by = list(by)
    o = W.partitionBy(*by).orderBy("ts")
    x = with_features(fill_signal(rows, by), {"_med": expanding_median("signal", warmup)}, symbol=by)
    before = F.lag("close").over(o)
    x = x.withColumns({"_pos": flag(F.col("signal") > F.col("_med")), "ret": F.when(before != 0, F.col("close") / before - 1),
                       "_ahead": F.when(F.col("close") != 0, F.lead("close", horizon).over(o) / F.col("close") - 1)})
    there = F.col("signal").isNotNull() & F.col("_ahead").isNotNull()
    ic = x.withColumns({"_s": F.when(there, F.col("signal")), "_r": F.when(there, F.col("_ahead"))}).groupBy(*by).agg(
        F.when(F.count(F.lit(1)) > 10, F.coalesce(corr_agg("_s", "_r"), F.lit(0.0))).otherwise(0.0).alias("ic"))
    signal = x.select(*by, "ts", F.col("_pos").alias("signal"))
    m = nv.metrics(signal_nav(signal, x.select(*by, "ts", "ret"), by), by=by)
    held = x.withColumn("_held", F.lag("_pos").over(o) > 0)
    begins = F.col("_held") & ~F.coalesce(F.lag("_held").over(o), F.lit(False))
    held = held.withColumn("_n", F.sum(F.when(begins, 1).otherwise(0)).over(o.rowsBetween(W.unboundedPreceding, W.currentRow)))
    trips = held.filter("_held").groupBy(*by, "_n").agg(F.product(1 + F.coalesce("ret", F.lit(0.0))).alias("_p"), F.max_by("_pos", "ts").alias("_open"))
    wins = trips.filter("_open = 0").groupBy(*by).agg(F.avg(flag(F.col("_p") > 1)).alias("win_rate"))
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("annual_return", "sharpe", "max_drawdown", "win_rate")}
    return ic.join(m.select(*by, "annual_return", "sharpe", "max_drawdown"), by).join(wins, by, "left").withColumns(zero)


def explain(perf: DataFrame, effective: float = 0.05, by: Sequence[str] = BY) -> DataFrame:
    """Best and worst regime, lists of conditions, and suggestions from a fixed rule table."""
    good = F.abs("ic") > effective

    def any_(prefix, cond):
        return F.max(flag(F.col("regime").startswith(prefix) & cond)) > 0
    s = perf.groupBy(*by).agg(
        F.max_by("regime", F.struct(F.abs("ic"), "regime")).alias("best"),
        F.min_by("regime", F.struct(F.abs("ic"), "regime")).alias("worst"),
        F.sum(flag(good)).alias("_good"), F.count(F.lit(1)).alias("_all"),
        F.array_sort(F.collect_list(F.when(good & (F.abs("ic") > 0.08), F.col("regime")))).alias("works_in"),
        F.array_sort(F.collect_list(F.when(~good & (F.col("n") > 50), F.col("regime")))).alias("fails_in"),
        any_("vol_high", ~good).alias("_vh"), any_("vol_low", ~good).alias("_vl"),
        any_("trend_down", ~good).alias("_td"), any_("volume_high", good).alias("_vv"))
    rules = [(F.col("_good") == 0, "no regime shows an effect: replace the signal"),
             ((F.col("_good") > 0) & (F.col("_good") < F.col("_all") * 0.5), "works in few regimes: filter by regime"),
             (F.col("_vh"), "weak at high volatility: raise the entry threshold there"),
             (F.col("_vl"), "weak at low volatility: reduce the position there"),
             (F.col("_td"), "weak in falling trends: add a trend filter"),
             (F.col("_vv"), "works on high volume: confirm entries with volume")]
    notes = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda m: m.isNotNull())
    notes = F.when(F.size(notes) == 0, F.array(F.lit("balanced across regimes: keep as it is"))).otherwise(notes)
    return s.select(*by, "best", "worst", "works_in", "fails_in", notes.alias("suggestions"))
