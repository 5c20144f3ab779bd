"""Market breadth and derived market variables: one value per date, or relative to the market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.functions.feature import Feature, flag
from quantloom.functions.indicators import recurrence
from quantloom.functions.rolling import rolling, ts_delta, ts_max, ts_mean, ts_min, ts_roc

MARKET = "_market"


def _smooth(df: DataFrame, names: Sequence[str], d: int) -> DataFrame:
    """Rolling mean of each one-row-per-date column, as ``<name>_smoothed``."""
    one = df.withColumn(MARKET, F.lit("m"))
    feats = {f"{n}_smoothed": ts_mean(col(n), d) for n in names}
    return with_features(one, feats, symbol=MARKET, ts="ts").drop(MARKET)


def _share(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 when the total is 0."""
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(0.0)


def breadth_counts(bars: DataFrame, high_low_rows: int = 20) -> DataFrame:
    """Advancing / declining counts and volume, new highs and lows per date."""
    w = W.partitionBy("symbol").orderBy("ts")
    past = w.rowsBetween(-high_low_rows, -1)
    full = F.count("close").over(past) == high_low_rows
    marked = bars.select(
        "ts", "volume", F.signum(F.col("close") - F.lag("close").over(w)).alias("move"),
        (full & (F.col("close") > F.max("close").over(past))).alias("high_"),
        (full & (F.col("close") < F.min("close").over(past))).alias("low_"))
    up, down = F.col("move") > 0, F.col("move") < 0

    def n(c):
        return F.sum(F.when(c, 1.0).otherwise(0.0))

    def vol(c):
        return F.sum(F.when(c, F.col("volume")).otherwise(0.0))
    return marked.groupBy("ts").agg(
        n(up).alias("advance"), n(down).alias("decline"), n(F.col("high_")).alias("new_highs"),
        n(F.col("low_")).alias("new_lows"), vol(up).alias("adv_volume"),
        vol(down).alias("decl_volume"), F.count(F.lit(1)).cast("double").alias("total"))


def advance_decline(counts: DataFrame, d: int = 5) -> DataFrame:
    out = counts.select("ts", _share(F.col("advance"), F.col("decline")).alias("ad_ratio"))
    return _smooth(out, ["ad_ratio"], d)


def new_high_low(counts: DataFrame, d: int = 20) -> DataFrame:
    total = F.col("total")
    out = counts.select("ts", F.when(total > 0, (F.col("new_highs") - F.col("new_lows")) / total)
                        .otherwise(0.0).alias("high_low"))
    return _smooth(out, ["high_low"], d)


def sector_diffusion(returns: DataFrame, ret: str = "ret", d: int = 20) -> DataFrame:
    """Share of series with a positive return; a missing return counts as not positive."""
    out = returns.groupBy("ts").agg(F.avg(flag(F.col(ret) > 0)).alias("diffusion"))
    return _smooth(out, ["diffusion"], d)


def mcclellan(counts: DataFrame, fast: int = 19, slow: int = 39, d: int = 5) -> DataFrame:
    """Difference of two exponential averages of net advances, each seeded with the first value."""
    net = col("net")

    def ema_from_first(n):
        k = 2.0 / (n + 1)
        return recurrence(net, 1.0 - k, k, 1)
    one = counts.select("ts", (F.col("advance") - F.col("decline")).alias("net"),
                        F.lit("m").alias(MARKET))
    osc = ema_from_first(fast) - ema_from_first(slow)
    return with_features(one, {"mcclellan": osc, "mcclellan_smoothed": ts_mean(osc, d)},
                         symbol=MARKET, keep=["ts"])


def arms_index(counts: DataFrame) -> DataFrame:
    """(advances / declines) / (advancing volume / declining volume); zeros give 0."""
    adv, dec = F.col("advance"), F.col("decline")
    av, dv = F.col("adv_volume"), F.col("decl_volume")
    ok = (dec > 0) & (dv > 0) & (av > 0)
    return counts.select("ts", F.when(ok, (adv / dec) / (av / dv)).otherwise(0.0).alias("arms"))


def breadth_features(df: DataFrame, total: float = 5000.0) -> DataFrame:
    """The breadth ratios whose input columns exist; the others are missing."""
    have = set(df.columns)

    def when_present(need, value):
        return value() if set(need) <= have else F.lit(None).cast("double")
    ad = when_present(("advance", "decline"),
                      lambda: _share(F.col("advance"), F.col("decline")))
    nh = when_present(("new_highs", "new_lows"),
                      lambda: (F.col("new_highs") - F.col("new_lows"))
                      / (F.col("total") if "total" in have else F.lit(total)))
    return df.withColumns({"breadth_ad": ad, "breadth_nh": nh})


# -- relative and benchmark variables ---------------------------------------------------------------
def benchmark_of(bars: DataFrame) -> DataFrame:
    """Equal-weight benchmark: mean close, amount and volume of all symbols per date."""
    means = bars.groupBy("ts").agg(*[F.avg(c).alias(f"bench_{c}")
                                     for c in ("close", "amount", "volume")])
    w = W.partitionBy(F.lit(1)).orderBy("ts")  # one row per date
    prev = F.lag("bench_close").over(w)
    return means.withColumn("bench_returns", F.when(prev != 0, F.col("bench_close") / prev - 1))


def relative_to(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """BENCH_* of the date, REL_* = value / benchmark value, SHARE of the date's amount."""
    joined = bars.join(benchmark, "ts", "left")
    rel = {f"rel_{c}": F.when(F.col(f"bench_{c}") != 0, F.col(c) / F.col(f"bench_{c}"))
           for c in ("close", "amount", "volume")}
    share = F.col("amount") / F.sum("amount").over(W.partitionBy("ts"))
    return joined.withColumns({**rel, "share": share})


def downside_vol(returns: Feature, d: int = 20) -> Feature:
    """Deviation of the negative returns in the window."""
    return rolling("downside_vol", d, lambda f, r: F.stddev_samp(F.when(r < 0, r)).over(f), returns)


def market_state(bars: DataFrame, mom_rows: int = 20, windows: Sequence[int] = (5, 20, 60),
                 tail: float = 2.0) -> DataFrame:
    """Reserved market variables, one row per date. The formulas are this library's choice:

    sector_up / sector_mom: share of symbols with positive return / momentum; sector_ad: net
    advances; breadth_s/m/l: share above the mean of 5/20/60 rows, breadth_amt the same for
    amount; disp / skew: deviation and skewness of returns; nhl: net new highs; rotspd: 1 when the
    leading symbol changed; vmed / vdisp / vskew: median, deviation and skewness of log volume;
    tailup / taildown / tailnet: share of returns beyond ``tail`` deviations.
    """
    c, amt = col("close"), col("amount")
    feats = {"r": ts_roc(c, 1), "mom": ts_delta(c, mom_rows), "a_ma": ts_mean(amt, windows[1]),
             "hi": ts_max(c, windows[1]), "lo": ts_min(c, windows[1]),
             **{f"ma{i}": ts_mean(c, d) for i, d in enumerate(windows)}}
    x = with_features(bars, feats)
    day = W.partitionBy("ts")
    dev = F.stddev_samp("r").over(day)
    z = F.when(dev > 0, (F.col("r") - F.avg("r").over(day)) / dev)
    x = x.withColumns({"z": z, "lv": F.when(F.col("volume") > 0, F.log("volume"))})

    def share(cond, given):
        return F.avg(F.when(F.col(given).isNotNull(), flag(cond)))

    def skew(c):
        return F.when(F.stddev_pop(c) > 1e-10, F.skewness(c))
    up, down = flag(F.col("r") > 0), flag(F.col("r") < 0)
    daily = x.groupBy("ts").agg(
        share(F.col("r") > 0, "r").alias("sector_up"), share(F.col("mom") > 0, "mom").alias("sector_mom"),
        F.sum(up).alias("_u"), F.sum(down).alias("_d"),
        share(F.col("close") > F.col("ma0"), "ma0").alias("breadth_s"),
        share(F.col("close") > F.col("ma1"), "ma1").alias("breadth_m"),
        share(F.col("close") > F.col("ma2"), "ma2").alias("breadth_l"),
        share(F.col("amount") > F.col("a_ma"), "a_ma").alias("breadth_amt"),
        F.stddev_samp("r").alias("disp"), skew("r").alias("skew"),
        (share(F.col("close") >= F.col("hi"), "hi") - share(F.col("close") <= F.col("lo"), "lo")).alias("nhl"),
        F.max_by("symbol", F.when(F.col("r").isNotNull(), F.struct("r", "symbol"))).alias("leader"),
        F.percentile("lv", 0.5).alias("vmed"), F.stddev_samp("lv").alias("vdisp"),
        skew("lv").alias("vskew"), share(F.col("z") > tail, "z").alias("tailup"),
        share(F.col("z") < -tail, "z").alias("taildown"))
    before = F.lag("leader").over(W.partitionBy(F.lit(1)).orderBy("ts"))  # one row per date
    return daily.select(
        "ts", "sector_up", "sector_mom", _share(F.col("_u"), F.col("_d")).alias("sector_ad"),
        "breadth_s", "breadth_m", "breadth_l", "breadth_amt", "disp", "skew", "nhl",
        F.when(before.isNotNull(), flag(F.col("leader") != before)).alias("rotspd"),
        "vmed", "vdisp", "vskew", "tailup", "taildown",
        (F.col("tailup") - F.col("taildown")).alias("tailnet"))


def mean_pair_correlation(returns: DataFrame, ret: str = "ret", unit: str = "year") -> DataFrame:
    """Mean pairwise correlation of all symbols per calendar period, without forming pairs.

    With values standardised per symbol and period, the sum over dates of (sum over symbols)^2
    holds every pair once in each order, so the mean over pairs follows from two aggregates. Only
    symbols present on every date of the period count.
    """
    p = returns.withColumn("period", F.date_trunc(unit, "ts")).filter(F.col(ret).isNotNull())
    dates = p.groupBy("period").agg(F.count_distinct("ts").alias("n_dates"))
    stats = p.groupBy("period", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"))
    whole = (stats.join(dates, "period").filter((F.col("n") == F.col("n_dates"))
                                                & (F.col("n") > 2) & (F.col("s") > 1e-10))
             .select("period", "symbol", "m", "s", "n"))
    z = p.join(whole, ["period", "symbol"]).withColumn("z", (F.col(ret) - F.col("m")) / F.col("s"))
    daily = z.groupBy("period", "ts").agg(F.sum("z").alias("t"), F.count(F.lit(1)).alias("k"),
                                          F.first("n").alias("n"))
    k = F.max("k")
    total = F.sum(F.pow("t", F.lit(2.0))) / (F.max("n") - 1)
    return daily.groupBy("period").agg(k.alias("symbols"), F.when(
        k > 1, (total - k) / (k * (k - 1))).alias("ind_corr"))


