"""Registered queries against their SQL in DuckDB on the smallest tables.

A cross-section of queries by default; QUANTLOOM_ALL=1 runs every one.
"""

import os

import pytest

from quantloom.checks import QUERIES, SQL
from quantloom.checks.compare import compare, connect

PATH = "/root/testdata/sf0.001"
SOME = ("bars_brand_week", "asof_latest", "ts_decay_linear", "cs_zscore", "reg_resid", "thr_zscore", "three_zone_state",
        "quantile_groups", "monitor_basic_ic", "weights_rank_buffer", "nav_drawdown", "trade_round_trips",
        "walk_forward_overfit", "log_suggestions", "log_lineage", "symbol_classes", "store_factor_cache",
        "stream_bars_from_ticks", "stream_last_n", "split_rolling_features", "split_cross_section_rank")
NAMES = sorted(QUERIES) if os.environ.get("QUANTLOOM_ALL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    result = compare(spark, connect(PATH), PATH, name, QUERIES[name], SQL.get(name))
    assert not result.startswith("FAIL"), result


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
