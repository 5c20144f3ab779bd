"""Combining several signals in a long table (signal_id, symbol, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.feature import flag
from quantloom.functions.rolling import expanding_median
from quantloom.plans.panel import with_features


def positions(signals: DataFrame, *, look_ahead: bool = True) -> DataFrame:
    """+1 above / -1 at or below the signal's median.

    ``look_ahead=True`` uses the median of the whole series (which knows the future); otherwise
    the median of the rows so far.
    """
    if look_ahead:
        med = signals.groupBy("signal_id", "symbol").agg(F.percentile("value", 0.5).alias("_m"))
        x = signals.join(med, ["signal_id", "symbol"])
    else:
        x = with_features(signals, {"_m": expanding_median("value", 1)}, symbol=["symbol", "signal_id"])
    return x.withColumn("position", F.when(F.col("value") > F.col("_m"), 1.0).otherwise(-1.0)).drop("_m")


def ensemble(pos: DataFrame, weights: DataFrame | None = None, method: str = "vote") -> DataFrame:
    """1 where the signals together say long, else 0.

    vote: the sum of positions is positive; weighted: so is the sum weighted by
    max(test_sharpe, 0.01); unanimous: every position is +1.
    """
    if method == "weighted":
        w = weights.select("signal_id", F.greatest(F.col("test_sharpe"), F.lit(0.01)).alias("_w"))
        score = F.sum(F.col("position") * F.col("_w"))
        pos = pos.join(w, "signal_id")
    elif method == "vote":
        score = F.sum("position")
    elif method == "unanimous":
        score = F.min("position")
    else:
        raise ValueError(f"unknown method {method}")
    return pos.groupBy("symbol", "ts").agg(flag(score > 0).alias("value"))
