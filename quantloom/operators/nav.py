"""Risk and return metrics of net asset values ``(strategy_id, ts, nav)``; the first row is the base."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.feature import flag
from quantloom.operators.stats import quotient

SID = ("strategy_id",)
PERIODS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "2y": 24, "3y": 36, "5y": 60}


@dataclass(frozen=True)
class Metric:
    """A metric computed from the columns of :func:`metrics`."""
    name: str
    label: str
    group: str
    fmt: str
    order: int
    value: Callable[[], Column] | None = None


METRICS: dict[str, Metric] = {m.name: m for m in (
    Metric("total_return", "Total return", "return", "percent", 1),
    Metric("annual_return", "Annual return", "return", "percent", 2),
    Metric("volatility", "Volatility", "risk", "percent", 3),
    Metric("sharpe", "Sharpe ratio", "ratio", "number", 4),
    Metric("max_drawdown", "Maximum drawdown", "risk", "percent", 5),
    Metric("drawdown_rows", "Drawdown duration", "risk", "count", 6),
    Metric("recovery_rows", "Drawdown recovery", "risk", "count", 7),
    Metric("var", "Value at risk", "risk", "percent", 8),
    Metric("cvar", "Conditional value at risk", "risk", "percent", 9),
    Metric("ulcer", "Ulcer index", "risk", "number", 10),
    Metric("sortino", "Sortino ratio", "ratio", "number", 11),
    Metric("upi", "Ulcer performance index", "ratio", "number", 12),
    Metric("calmar", "Calmar ratio", "ratio", "number", 13))}


def metric(name: str, *, label: str | None = None, group: str = "custom", fmt: str = "number", order: int = 99):
    """Decorator for a custom metric: a function that returns a Column over the metric columns."""
    def wrap(fn):
        METRICS[name] = Metric(name, label or name, group, fmt, order, fn)
        return fn
    return wrap


def period_slice(nav: DataFrame, period: str = "all", *, start=None, end=None, by: Sequence[str] = SID) -> DataFrame:
    """Rows of a period ending at the last date, plus the last row strictly before it as base."""
    if period == "all":
        return nav
    ends = nav.groupBy(*by).agg(F.max("ts").alias("_e"))
    x = nav.join(ends, list(by))
    if period == "custom":
        x = x.withColumns({"_s": F.lit(start).cast("timestamp"), "_e": F.lit(end).cast("timestamp")})
    else:
        x = x.withColumn("_s", F.add_months(F.col("_e"), -PERIODS[period]).cast("timestamp"))
    base = F.max(F.when(F.col("ts") < F.col("_s"), F.col("ts"))).over(W.partitionBy(*by))
    x = x.withColumn("_b", F.coalesce(base, F.col("_s")))
    return x.filter((F.col("ts") >= F.col("_b")) & (F.col("ts") <= F.col("_e"))).select(nav.columns)


def with_drawdown(nav: DataFrame, by: Sequence[str] = SID) -> DataFrame:
    o = W.partitionBy(*by).orderBy("ts")
    prev = F.lag("nav").over(o)
    x = nav.withColumns({"rn": F.row_number().over(o), "r": F.when(prev != 0, F.col("nav") / prev - 1),
                         "peak": F.max("nav").over(o.rowsBetween(W.unboundedPreceding, W.currentRow))})
    return x.withColumn("dd", F.when(F.col("peak") != 0, F.col("nav") / F.col("peak") - 1))


def _with_trough(nav: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row next to its series' first deepest drawdown: windows of one partitioning, no join."""
    low = F.min(F.struct("dd", "rn", "ts", "peak")).over(W.partitionBy(*by))
    return with_drawdown(nav, by).withColumn("_t", F.when(low["dd"] < 0, low))


def _drawdown_aggregates() -> list[Column]:
    t = F.col("_t")
    at_peak = (F.col("nav") == t["peak"]) & (F.col("rn") <= t["rn"])
    back = (F.col("rn") > t["rn"]) & (F.col("nav") >= t["peak"])
    return [F.max(t["dd"]).alias("max_drawdown"), F.max(t["ts"]).alias("trough_ts"), F.max(t["rn"]).alias("_tr"),
            F.min(F.when(at_peak, F.struct("rn", "ts"))).alias("_p"), F.min(F.when(back, F.col("rn"))).alias("_b")]


def _drawdown_columns() -> list[Column]:
    return [F.col("max_drawdown"), F.col("_p.ts").alias("peak_ts"), F.col("trough_ts"),
            (F.col("_tr") - F.col("_p.rn")).alias("drawdown_rows"), (F.col("_b") - F.col("_tr")).alias("recovery_rows")]


def drawdowns(nav: DataFrame, by: Sequence[str] = SID) -> DataFrame:
    """Deepest drawdown: value (NULL when there is none), first peak, first trough, durations in rows."""
    return _with_trough(nav, by).groupBy(*by).agg(*_drawdown_aggregates()).select(*by, *_drawdown_columns())


def metrics(nav: DataFrame, *, risk_free: float = 0.02, confidence: float = 0.95, year: int = 252,
            by: Sequence[str] = SID) -> DataFrame:
    """All metrics, one row per strategy: one shuffle on the strategy and one aggregate."""
    by = list(by)
    x = _with_trough(nav, by)
    r = F.col("r")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(r.asc_nulls_last(), "ts"))
    n_r = F.count("r").over(W.partitionBy(*by))
    tail = F.greatest(F.lit(1), F.floor(n_r * (1 - confidence) + 1e-12).cast("int"))
    x = x.withColumn("_low", F.when(r.isNotNull() & (rank <= tail), r))
    first, last = F.min_by("nav", "ts"), F.max_by("nav", "ts")
    a = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.when(first != 0, last / first - 1).alias("total_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(year)))).alias("volatility"),
        (-F.percentile("r", 1 - confidence)).alias("var"), (-F.avg("_low")).alias("cvar"),
        F.sqrt(F.avg(F.pow(F.col("dd") * 100, F.lit(2.0)))).alias("ulcer"),
        (F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0))) * F.sqrt(F.lit(float(year)))).alias("_down"),
        *_drawdown_aggregates())
    total = F.col("total_return")
    a = a.withColumn("annual_return", F.when((total > -1) & (F.col("n") > 1), F.pow(
        1 + total, F.lit(float(year)) / F.when(F.col("n") > 1, F.col("n") - 1)) - 1))
    extra = F.col("annual_return") - risk_free
    out = a.withColumns({
        "sharpe": quotient(extra, F.col("volatility")),
        "sortino": F.when(F.col("_down") > 0, extra / F.col("_down")).otherwise(F.lit(float("inf"))),
        "upi": quotient(extra, F.col("ulcer") / 100)})
    out = out.select(*[c for c in out.columns if c not in ("_down", "_tr", "_p", "_b", "max_drawdown", "trough_ts")],
                     *_drawdown_columns())
    out = out.withColumn("calmar", F.when(F.col("max_drawdown") != 0, F.col("annual_return") / F.abs("max_drawdown")))
    custom = {m.name: m.value() for m in METRICS.values() if m.value is not None}
    return out.withColumns(custom) if custom else out


def period_returns(nav: DataFrame, periods: Sequence[str] = ("1m", "3m", "1y"), by: Sequence[str] = SID) -> DataFrame:
    """Return of each trailing period against the last value before its start, in one aggregate."""
    by = list(by)
    x = nav.join(nav.groupBy(*by).agg(F.max("ts").alias("_e"), F.max_by("nav", "ts").alias("_l"),
                                      F.min_by("nav", "ts").alias("_f")), by)
    aggs = []
    for p in periods:
        start = F.add_months(F.col("_e"), -PERIODS[p]).cast("timestamp")
        base = F.coalesce(F.max_by("nav", F.when(F.col("ts") < start, F.col("ts"))), F.first("_f"))
        aggs.append(F.when(base != 0, F.first("_l") / base - 1).alias(f"ret_{p}"))
    return x.groupBy(*by).agg(*aggs)


def metric_rows(table: DataFrame, by: Sequence[str] = SID) -> DataFrame:
    """Long table of name, value, group, format and order with a formatted text."""
    rows = F.array(*[F.struct(
        F.lit(m.name).alias("name"), F.col(m.name).cast("double").alias("value"), F.lit(m.group).alias("group"),
        F.lit(m.fmt).alias("format"), F.lit(m.order).alias("order")) for m in sorted(METRICS.values(), key=lambda m: m.order)])
    x = table.select(*by, F.explode(rows).alias("m")).select(*by, "m.*")
    text = (F.when(F.col("value").isNull(), "-")
            .when(F.col("format") == "percent", F.concat(F.format_string("%.2f", F.col("value") * 100), F.lit("%")))
            .when(F.col("format") == "count", F.format_string("%.0f", F.col("value")))
            .otherwise(F.format_string("%.2f", F.col("value"))))
    return x.withColumn("text", text)


def against_benchmark(nav: DataFrame, bench: DataFrame, *, year: int = 252, by: Sequence[str] = SID) -> DataFrame:
    """Excess return, annualised, tracking error (population), information ratio, daily win rate."""
    by = list(by)
    o = W.partitionBy(*by).orderBy("ts")
    x = nav.join(bench.select("ts", F.col("nav").alias("_bn")), "ts")
    x = x.withColumns({"_r": F.col("nav") / F.lag("nav").over(o) - 1, "_q": F.col("_bn") / F.lag("_bn").over(o) - 1})
    x = x.withColumn("_d", F.col("_r") - F.col("_q"))
    a = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.max_by("nav", "ts") / F.min_by("nav", "ts")) / (F.max_by("_bn", "ts") / F.min_by("_bn", "ts")) - 1).alias("excess"),
        (F.stddev_pop("_d") * F.sqrt(F.lit(float(year)))).alias("tracking_error"),
        F.avg(F.when(F.col("_d").isNotNull(), flag(F.col("_d") > 0))).alias("win_rate"))
    a = a.withColumn("annual_excess", F.when((F.col("n") > 1) & (F.col("excess") > -1), F.pow(
        1 + F.col("excess"), F.lit(float(year)) / F.when(F.col("n") > 1, F.col("n") - 1)) - 1))
    return a.withColumn("information_ratio", quotient(F.col("annual_excess"), F.col("tracking_error")))


def holding_ratio(snapshots: DataFrame, by: Sequence[str] = SID) -> DataFrame:
    """Share of days (after the base day) on which the last snapshot holds a position.

    ``snapshots(strategy_id, created_at, positions map<string, struct<volume, ...>>)``.
    """
    daily = snapshots.groupBy(*by, F.to_date("created_at").alias("d")).agg(
        F.max_by("positions", "created_at").alias("_p"))
    held = F.exists(F.map_values("_p"), lambda p: p["volume"] > 0)
    rn = F.row_number().over(W.partitionBy(*by).orderBy("d"))
    return (daily.withColumn("_rn", rn).filter(F.col("_rn") > 1).groupBy(*by)
            .agg(F.avg(flag(held)).alias("holding_ratio")))


def last_per_day(values: DataFrame, *, value: str = "nav", time: str = "created_at", by: Sequence[str] = SID) -> DataFrame:
    return values.groupBy(*by, F.to_date(time).alias("d")).agg(F.max_by(value, time).alias(value))


def yearly_report(nav: DataFrame, *, risk_free: float = 0.02, year: int = 252, by: Sequence[str] = SID) -> DataFrame:
    """Return, volatility, Sharpe and drawdown inside each calendar year."""
    x = nav.withColumn("year", F.year("ts"))
    m = metrics(x, risk_free=risk_free, year=year, by=[*by, "year"])
    return m.select(*by, "year", "total_return", "volatility", "sharpe", "max_drawdown")
