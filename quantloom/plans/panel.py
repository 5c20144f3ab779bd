"""Attach features to a panel DataFrame.

Every distinct window recipe becomes one named column and is shared by all features that use
it. Columns along time (``partitionBy(symbol).orderBy(ts)``) and columns across symbols
(``partitionBy(date)``) are grouped, so the plan has one exchange per change of direction, not
one per function, and each group is sorted once for all its frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.feature import Feature, finite
from quantloom.plans.passes import OPS, Request, add_passes

# repeats of a shared part up to which it is written out again instead of named; changes the plan only
_INLINE_LIMIT = 24
# from this many ranks at one stage on, they are computed in one pass over long rows, whose task holds one sorted copy of
# its rows instead of one a rank; results are the same
_RANKS_TOGETHER = 2
_RANK_OPS = ("cs_rank", "cs_rank0", "cs_rank_average")


class Windows:
    """The window specifications of one panel."""

    def __init__(self, symbol: Sequence[str], ts: str, rn: str | None = None):
        self.symbol, self.ts, self.rn_column = list(symbol), ts, rn
        self.order = W.partitionBy(*self.symbol).orderBy(ts)
        self.expanding = self.order.rowsBetween(W.unboundedPreceding, W.currentRow)
        self.before = self.order.rowsBetween(W.unboundedPreceding, -1)
        # keys other than the symbol (a window id, a parameter id) stay part of a cross-section
        self.date = W.partitionBy(*self.symbol[1:], ts)

    def last(self, d: int, shift: int = 0):
        return self.order.rowsBetween(-(d - 1) - shift, -shift)

    def ahead(self, d: int):
        return self.order.rowsBetween(0, d - 1)

    def within(self, block: Column):
        """Running window inside a block of the symbol's rows."""
        return (W.partitionBy(*self.symbol, block).orderBy(self.ts)
                .rowsBetween(W.unboundedPreceding, W.currentRow))

    def rank(self, x: Column):
        return W.partitionBy(*self.symbol[1:], self.ts).orderBy(x.asc_nulls_last())

    def row_number(self) -> Column:
        if self.rn_column:
            return F.col(self.rn_column)
        return F.row_number().over(self.order)


def with_features(df: DataFrame, features: Mapping[str, Feature], *,
                  symbol: str | Sequence[str] = "symbol", ts: str = "ts",
                  keep: Sequence[str] | None = None, rn: str | None = None) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) plus one column per feature.

    ``symbol`` may name several columns: the first is the series, the others separate
    independent panels (walk-forward windows, parameter variants). ``rn`` names an existing
    1-based row number per series; without it the number is computed when a feature needs it.
    """
    keys = [symbol] if isinstance(symbol, str) else list(symbol)
    windows = Windows(keys, ts, rn)
    missing = sorted({v for f in features.values() for v in f.missing_variables(df.columns)})
    if missing:
        raise ValueError(f"columns not in the panel: {', '.join(missing)}")
    keep = list(df.columns if keep is None else keep)

    nodes: dict[str, Feature] = {}
    for f in features.values():
        for n in f.walk():
            nodes.setdefault(n.key, n)

    named = _named(nodes, features.values())
    stage: dict[str, tuple[int, int]] = {}
    for key, n in nodes.items():
        stage[key] = _stage(n, stage, key in named)

    names = {k: f"_f_{k}" for k in named}
    made: dict[str, Column] = {}
    by_stage: dict[tuple[int, int], list[str]] = {}
    for key in nodes:
        if key in named:
            by_stage.setdefault(stage[key], []).append(key)

    def column(n: Feature) -> Column:
        if n.key in names:
            return F.col(names[n.key])
        if n.key not in made:
            made[n.key] = _build(n, [column(i) for i in n.inputs], windows)
        return made[n.key]

    def pass_of(out: DataFrame, some: Sequence[str], arranged: bool) -> DataFrame:
        return add_passes(out, keys, ts, column(nodes[some[0]].inputs[0]), [
            Request(names[k], nodes[k].op, nodes[k].params, [(i.key, column(i)) for i in nodes[k].inputs[1:]]) for k in some],
            arranged=arranged)

    # a pass in Python hands all columns through: only those that something reads go along
    read = {c.lower().strip("`") for c in (*keep, *keys, ts, *([rn] if rn else []), *(n.params[0] for n in nodes.values() if n.op == "col"))}
    out, arranged = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() in read]), False  # arranged: rows lie by series and time, as the last pass left them
    late = _only_for_outputs(nodes)
    for s in sorted(by_stage):
        passes = [k for k in by_stage[s] if nodes[k].op in OPS]
        ranks = [k for k in by_stage[s] if nodes[k].op in _RANK_OPS]
        if len(ranks) < _RANKS_TOGETHER or not _numbers(out, [column(nodes[k].inputs[0]) for k in ranks]):
            ranks = []
        rest = [k for k in by_stage[s] if k not in {*ranks, *passes} and k not in late]
        arranged = arranged and not ranks and all(nodes[k].axis == "row" for k in rest)
        if rest:
            out = out.select("*", *[
                _build(nodes[k], [column(i) for i in nodes[k].inputs], windows).alias(names[k])
                for k in rest])
        if ranks:
            out = _rank_together(out, windows, [
                (names[k], nodes[k].op, column(nodes[k].inputs[0])) for k in ranks])
        if soon := [k for k in passes if k not in late]:
            out, arranged = pass_of(out, soon, arranged), True
    if last := [k for k in nodes if k in late and nodes[k].op in OPS]:
        have = {c.lower(): c for c in out.columns}
        read = [names.get(n.key) or have[n.params[0].lower()] for n in _read(features.values(), names, late)]
        out = pass_of(out.select(*dict.fromkeys([*keep, *keys, ts, *read])), last, arranged)
        for s in sorted(by_stage):
            if made_of := [k for k in by_stage[s] if k in late and nodes[k].op not in OPS]:
                out = out.select("*", *[_build(nodes[k], [column(i) for i in nodes[k].inputs], windows).alias(names[k])
                                        for k in made_of])
    return out.select(*keep, *[finite(column(f)).alias(name) for name, f in features.items()])


def _numbers(df: DataFrame, columns: Sequence[Column]) -> bool:
    """Whether a pass, which reads doubles, can rank these; texts and decimals are left to windows."""
    types = [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema]
    return all(isinstance(t, T.NumericType) and not isinstance(t, T.DecimalType) for t in types)


def _rank_together(df: DataFrame, windows: Windows,
                   ranks: list[tuple[str, str, Column]]) -> DataFrame:
    """Many cross-section ranks in one shuffle by date and one pass."""
    return add_passes(df, [*windows.symbol[1:], windows.ts], windows.symbol[0], F.lit(1),
                      [Request(name, op, (), [(f"{i}", x)]) for i, (name, op, x) in enumerate(ranks)])


def _only_for_outputs(nodes: Mapping[str, Feature]) -> set[str]:
    """Functions of whole series that no other one needs, and what is made of them: they can all wait for one last pass."""
    needed: set[str] = set()
    for n in reversed(nodes.values()):  # inputs stand before what uses them
        if n.axis != "row" or n.key in needed:
            needed.update(i.key for i in n.inputs)
    late: set[str] = set()
    for k, n in nodes.items():
        if k not in needed and (n.op in OPS or any(i.key in late for i in n.inputs)):
            late.add(k)
    return late


def _read(outputs, names: Mapping[str, str], late: set[str]) -> list[Feature]:
    """What the outputs read when the last pass begins: columns made before it and plain ones."""
    found: dict[str, Feature] = {}
    seen: set[str] = set()
    stack = list(outputs)
    while stack:
        n = stack.pop()
        if n.key in seen:
            continue
        seen.add(n.key)
        if n.op == "col" or (n.key in names and n.key not in late):
            found[n.key] = n
        else:
            stack.extend(n.inputs)
    return list(found.values())


def _build(n: Feature, inputs: list[Column], windows: Windows) -> Column:
    return n.build(*inputs) if n.axis == "row" else n.build(windows, *inputs)


def _named(nodes: Mapping[str, Feature], outputs) -> set[str]:
    """Recipes that get their own column: windows, their computed inputs, big shared parts, and
    the outputs, so that what only they need is dropped early."""
    named: set[str] = {f.key for f in outputs if f.op not in ("col", "lit")}
    size: dict[str, int] = {}
    for key, n in nodes.items():
        if n.axis != "row":
            named.add(key)
            named.update(i.key for i in n.inputs if i.op not in ("col", "lit"))
            size[key] = 1
            continue
        total = 1
        for i in n.inputs:
            inner = 1 if i.key in named else size[i.key]
            if inner > 4 and n.uses * inner > _INLINE_LIMIT:
                named.add(i.key)
                inner = 1
            total += n.uses * inner
        size[key] = 1 if key in named else total
    return named


def _stage(n: Feature, stage: Mapping[str, tuple[int, int]], named: bool) -> tuple[int, int]:
    """(phase, level): odd phases run along time, even phases across symbols."""
    below = [stage[i.key] for i in n.inputs]
    phase = max((p for p, _ in below), default=0)
    if n.axis != "row":
        odd = n.axis == "symbol"
        phase = max(phase, 1 if odd else 2)
        if (phase % 2 == 1) != odd:
            phase += 1
    level = max((lv for p, lv in below if p == phase), default=0)
    return (phase, level + 1 if named else level)
