"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("bars_brand_week", "rotation_nav", "signal_nav", "ts_mean", "ts_corr", "cs_rank",
            "nested_cs_ts", "ema", "adx", "catalog_basic", "catalog_alpha158_1", "ic_summary",
            "factor_batch_table", "nav_metrics", "trade_round_trips", "asof_latest", "state_machine")


def stored(spark, path):
    """Daily bars per supplier, written once: the features below are timed on a panel, not on its making."""
    from pyspark.sql import functions as F

    from quantloom import col
    from quantloom.functions.cross_section import cs_rank
    from quantloom.functions.indicators import ema
    from quantloom.functions.rolling import ts_corr, ts_mean
    from quantloom.plans.panel import with_features
    from quantloom.sources.bars import line_bars
    from quantloom.sources.store import materialize

    bars = materialize(line_bars(spark.read.parquet(f"{path}/lineitem.parquet"), F.col("l_suppkey"), "day"), "bars")
    c = col("close")
    runs = {"means": {f"m{d}": ts_mean(c, d) for d in (5, 10, 20, 60)}, "corr": {"c": ts_corr(c, col("volume"), 20)},
            "ranks": {f"r{d}": cs_rank(ts_mean(c, d)) for d in range(2, 10)}, "ema": {"e": ema(c, 20)}}
    return {f"stored_{n}": lambda s, p, f=f: with_features(bars, f, keep=["symbol", "ts"]) for n, f in runs.items()}


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from quantloom.checks import QUERIES

    spark.read.parquet(f"{path}/lineitem.parquet").count()
    times = {}
    queries = {n: QUERIES[n] for n in HEADLINE} | stored(spark, path)
    for name, query in queries.items():
        start = time.time()
        query(spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(path).name}))


if __name__ == "__main__":
    main()
