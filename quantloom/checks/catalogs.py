"""Catalog queries: every formula on the weekly brand bars, in groups of one plan each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom import with_features
from quantloom.checks.base import PANEL_SQL, QUERIES, SQL, panel, rounded
from quantloom.checks.duck import feature_sql
from quantloom.functions.feature import Feature, row
from quantloom.operators.breadth import benchmark_of, relative_to
from quantloom.plans.catalog import CATALOGS

RELATIVE_SQL = PANEL_SQL.replace("t0 AS", "base AS") + """,
b AS (SELECT ts, avg(close) AS bench_close, avg(amount) AS bench_amount, avg(volume) AS bench_volume
  FROM base GROUP BY ts),
t0 AS (SELECT base.*, bench_close, close / bench_close AS rel_close, amount / bench_amount AS rel_amount,
  volume / bench_volume AS rel_volume, amount / sum(amount) OVER (PARTITION BY base.ts) AS share
  FROM base JOIN b ON base.ts = b.ts)"""

# Formulas that rank, compare or take the position of values which are equal up to rounding noise
# (repeated patterns of few ranks): two engines break such ties differently, so in a query of their
# own everything that is ordered there is rounded first.
NOISY = {"alpha101": frozenset(f"alpha{n:03d}" for n in (2, 13, 15, 16, 29, 79, 84, 94, 97))}

# a power with values up to 1e99, compared by its size
HUGE = frozenset({"alpha084"})

GROUPS = {"alpha101": 4, "alpha191": 4, "alpha158": 2, "basic": 1, "industry": 1}
DIGITS = 5
# added before rounding, so that exact halves (products of ranks) round alike in both engines
OFFSET = 3e-9


_ORDERED = ("cs_rank", "cs_rank0", "cs_rank_average", "ts_rank", "ts_rank0", "ts_argmax", "ts_argmin", "gt", "ge", "lt", "le", "ts_max", "ts_min", "max", "min", "sign")


def _steady(f: Feature) -> Feature:
    """The same recipe with rounded inputs wherever values are ordered."""
    inputs = [_steady(i) for i in f.inputs]
    if f.op in _ORDERED:
        inputs = [row("steady", lambda a: F.round(a, 9) + 0.0, i) if i.inputs and i.op != "row_number" else i for i in inputs]
    return Feature(f.op, tuple(inputs), f.build, params=f.params, axis=f.axis, lookback=f.lookback, uses=f.uses) if f.inputs else f


def _small(f: Feature) -> Feature:
    return row("log_size", lambda a: F.signum(a) * F.log1p(F.abs(a)), f, uses=2)


def _register(catalog: str, parts: int) -> None:
    features = CATALOGS[catalog]()
    noisy = NOISY.get(catalog, frozenset())
    relative = catalog == "industry"

    def put(name, group, sql):
        def run(spark, path):
            p = panel(spark, path)
            if relative:
                p = relative_to(p, benchmark_of(p))
            out = with_features(p, group, keep=["symbol", "ts"])
            return rounded(out.select("symbol", "ts", *[(F.col(n) + OFFSET).alias(n) for n in group]), DIGITS)
        QUERIES[name] = run
        if sql:
            SQL[name] = feature_sql(group, RELATIVE_SQL if relative else PANEL_SQL, DIGITS, offset=OFFSET)

    stable = [n for n in features if n not in noisy]
    size = -(-len(stable) // parts)
    for i in range(parts):
        names = stable[i * size:(i + 1) * size]
        put(f"catalog_{catalog}_{i + 1}" if parts > 1 else f"catalog_{catalog}",
            {n: features[n] for n in names}, True)
    if noisy:
        put(f"catalog_{catalog}_rank_ties", {n: _small(_steady(features[n])) if n in HUGE else _steady(features[n])
                                                for n in features if n in noisy}, True)


for _name, _parts in GROUPS.items():
    _register(_name, _parts)
