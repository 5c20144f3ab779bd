"""Signal, scoring and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import col, with_features
from quantloom.checks.base import PANEL_SQL, check, panel, rsql
from quantloom.checks.duck import P, SOFAR, last
from quantloom.checks.functions import add, hand
from quantloom.functions import signals as sg
from quantloom.functions.rolling import ts_roc
from quantloom.operators.ensemble import ensemble, positions
from quantloom.operators.fold import state_machine

X, C = col("x"), col("close")


def b(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


Z = "x - 7.5"
add("persist", sg.persist(X - 7.5, 3), hand(b(f"rn >= 3 AND min({b('x - 7.5 > 0')}) {last(3)} > 0")))
add("persist_sign", sg.persist_sign(X - 7.5, 2), hand(
    f"{b(f'rn >= 2 AND min({b(Z + chr(62) + chr(48))}) {last(2)} > 0')} - {b(f'rn >= 2 AND min({b(Z + chr(60) + chr(48))}) {last(2)} > 0')}"))
add("thr_constant", sg.thr(X, 8.0), hand(b("x > 8.0")))
add("thr_mean", sg.thr_mean(X), hand(b(f"rn > 20 AND x > avg(x) {SOFAR}")))
add("thr_med", sg.thr_med(X), hand(b(f"rn > 20 AND x > quantile_cont(x, 0.5) {SOFAR}")))
add("thr_roll_mean", sg.thr_roll_mean(X), hand(b(f"rn >= 30 AND x > avg(x) {last(30)}")))
add("thr_roll_med", sg.thr_roll_med(X), hand(b(f"rn >= 30 AND x > quantile_cont(x, 0.5) {last(30)}")))
add("thr_zscore", sg.thr_zscore(X, 30, 0.5), hand(b(
    f"rn >= 30 AND stddev_samp(x) {last(30)} > 1e-10 AND x > avg(x) {last(30)} + 0.5 * stddev_samp(x) {last(30)}")))
add("thr_pct", sg.thr_pct(X, 0.8), hand(b(f"rn > 20 AND x > quantile_cont(x, 0.8) {SOFAR}")))
add("thr_range", sg.thr_range(X, 7.0, 8.0), hand(b("x > 7.0 AND x < 8.0")))
add("switch_signal", sg.regime_switch(X > 7.5, col("y"), -col("y")), hand("CASE WHEN x > 7.5 THEN y ELSE -y END"))
add("band_signal", sg.all_of(X > 7.0, X < 8.0), hand(b("x > 7.0 AND x < 8.0")))
add("pipe_and_or", {"low": sg.pipe_and(X, col("y")), "high": sg.pipe_or(X, col("y"))},
    f"WITH {PANEL_SQL} SELECT symbol, ts, {rsql('CASE WHEN x + y IS NOT NULL THEN least(x, y) END')} AS low, "
    f"{rsql('CASE WHEN x + y IS NOT NULL THEN greatest(x, y) END')} AS high FROM t0")
add("pipe_vote", sg.pipe_vote(X - 7.5, col("y") - 6.0, col("returns")), hand(
    b(f"({b('x > 7.5')} + {b('y > 6.0')} + {b('returns > 0')}) / 3 > 0.5")))
add("pipe_weighted", sg.pipe_weighted([0.5, -2.0], X, col("y")), hand("0.5 * x - 2 * y"))
add("pipeline_steps", sg.pipeline(X, lambda s: s - 7.5, lambda s: sg.persist(s, 2), lambda s: sg.thr(s, 0)),
    hand(b(f"rn >= 2 AND min({b('x > 7.5')}) {last(2)} > 0")))

V0 = "coalesce(x, 0.0)"
add("scored_raw_binary", {"raw": sg.scored(X), "bin": sg.scored(X - 8.0, "binary")},
    f"WITH {PANEL_SQL} SELECT symbol, ts, {rsql(V0)} AS raw, {rsql(b('x > 8.0'))} AS bin FROM t0")
add("scored_rank", sg.scored(X, "rank"))
add("scored_zscore", sg.scored(X, "zscore"))
add("scored_neg_log", sg.scored(X, "neg_log"), hand(
    f"CASE WHEN {V0} > 1e-10 THEN -ln({V0} / greatest(max(greatest({V0}, 0)) {SOFAR}, 1e-10)) ELSE 0.0 END"))
_ALL = "OVER (PARTITION BY symbol)"
add("scored_rank_full", sg.scored(X, "rank_full"), hand(
    f"(rank() OVER (PARTITION BY symbol ORDER BY {V0}) + (count(*) OVER (PARTITION BY symbol, {V0}) - 1) / 2.0) / count(*) {_ALL}"))
add("scored_zscore_full", sg.scored(X, "zscore_full"), hand(
    f"least(greatest(({V0} - avg({V0}) {_ALL}) / stddev_pop({V0}) {_ALL}, -3.0), 3.0)"))
add("scored_custom", sg.scored(X, lambda v: v * v), hand(f"{V0} * {V0}"))
add("composite_score", sg.composite([("x", 2.0, "raw"), ("y", -1.0, "raw"), ("absent", 1.0, "raw")],
                                    ["x", "y"]), hand("(2 * coalesce(x, 0.0) - coalesce(y, 0.0)) / 3.0"))
add("three_zone_state", sg.three_zone(X - 7.5, 1.0, -1.0), hand(
    f"coalesce(last_value(CASE WHEN coalesce(x - 7.5, 0) > 1.0 THEN 1.0 WHEN coalesce(x - 7.5, 0) < -1.0 THEN 0.0 END IGNORE NULLS) {SOFAR}, 0.0)"))


@check("state_machine", f"""WITH RECURSIVE {PANEL_SQL}, s AS (SELECT symbol, ts, row_number() OVER ({P}) AS rn,
  coalesce(close / nullif(lag(close, 2) OVER ({P}), 0) - 1, 0.0) AS r FROM t0),
m(symbol, rn, hold, pos) AS (SELECT symbol, rn, CASE WHEN r > 0.5 THEN 1 ELSE 0 END, CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END FROM s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn,
    CASE WHEN m.hold = 0 THEN CASE WHEN s.r > 0.5 THEN 1 ELSE 0 END WHEN s.r < -0.5 OR m.hold + 1 >= 10 THEN 0 ELSE m.hold + 1 END,
    CASE WHEN m.hold = 0 THEN CASE WHEN s.r > 0.5 THEN 1.0 ELSE 0.0 END WHEN s.r < -0.5 OR m.hold + 1 >= 10 THEN 0.0 ELSE 1.0 END
  FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1)
SELECT s.symbol, s.ts, CAST(m.pos AS DOUBLE) AS position FROM s JOIN m ON m.symbol = s.symbol AND m.rn = s.rn""")
def _(spark, path):
    r = ts_roc(C, 2)
    x = with_features(panel(spark, path), {"buy": r > 0.5, "sell": r < -0.5}, keep=["symbol", "ts"])
    return state_machine(x, max_hold=10).select("symbol", "ts", "position")


def _signals(spark, path):
    p = panel(spark, path)
    return p.select("symbol", "ts", F.explode(F.array(
        F.struct(F.lit("close").alias("signal_id"), F.col("close").alias("value")),
        F.struct(F.lit("volume").alias("signal_id"), F.col("volume").alias("value")),
        F.struct(F.lit("open").alias("signal_id"), F.col("open").alias("value")))).alias("s")).select(
            "symbol", "ts", "s.*")


_SIG = f"""WITH {PANEL_SQL}, s AS (SELECT symbol, ts, 'close' AS signal_id, close AS value, 0.5 AS w FROM t0
  UNION ALL SELECT symbol, ts, 'volume', volume, 1.2 FROM t0 UNION ALL SELECT symbol, ts, 'open', open, 0.01 FROM t0),
p AS (SELECT *, CASE WHEN value > quantile_cont(value, 0.5) OVER (PARTITION BY signal_id, symbol) THEN 1.0 ELSE -1.0 END AS position FROM s)"""


def _ens(method):
    def run(spark, path):
        s = _signals(spark, path)
        w = s.groupBy("signal_id").agg(F.max(F.when(F.col("signal_id") == "close", 0.5).when(
            F.col("signal_id") == "volume", 1.2).otherwise(-3.0)).alias("test_sharpe"))
        return ensemble(positions(s), w, method)
    return run


for _m, _e in (("vote", "sum(position) > 0"), ("weighted", "sum(position * w) > 0"), ("unanimous", "min(position) > 0")):
    check(f"ensemble_{_m}", f"{_SIG} SELECT symbol, ts, CAST({b(_e)} AS DOUBLE) AS value FROM p GROUP BY symbol, ts")(_ens(_m))


@check("ensemble_running_median", f"""WITH {PANEL_SQL} SELECT symbol, ts, 'volume' AS signal_id,
  CAST(CASE WHEN volume > quantile_cont(volume, 0.5) {SOFAR} THEN 1.0 ELSE -1.0 END AS DOUBLE) AS position FROM t0""")
def _(spark, path):
    s = panel(spark, path).select("symbol", "ts", F.lit("volume").alias("signal_id"), F.col("volume").alias("value"))
    return positions(s, look_ahead=False).select("symbol", "ts", "signal_id", "position")


