"""Functions of whole series (or dates) by vectors inside tasks: order statistics, recurrences, many ranks at once.

Rows are dealt by series and sorted by time (Spark leaves that out where they already are), and tasks stream whole
series through vectorised functions: many small series at once, a long one alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from quantloom.plans.orderstats import Stretches, Wavelet
from quantloom.plans.scans import affine_scan, recurrence

#: Rows handled together inside a task, at least; a longer series is handled alone.
ROWS = 1 << 16


class Chunk:
    """Whole series in a row: where each row's series starts, its row number (from 1), and the input columns."""

    def __init__(self, row: np.ndarray, first: np.ndarray, columns: Sequence[np.ndarray]) -> None:
        self.row, self.columns = row, columns
        self.start = np.repeat(first, np.diff(np.append(first, len(row))))
        self.at = np.arange(len(row))
        self._wavelets: dict[int, tuple[Wavelet, np.ndarray]] = {}
        self.shared: dict = {}  # for functions of which several columns are wanted

    def stretches(self, i: int, width: int | None) -> Stretches:
        """The last ``width`` rows of a column, or (None) all so far; one wavelet a column serves them all."""
        value = self.columns[i]
        if i not in self._wavelets:
            there = ~np.isnan(value)
            before = np.zeros(len(value) + 1, np.int64)
            np.cumsum(there, out=before[1:])
            self._wavelets[i] = Wavelet(value[there]), before
        lo = self.start if width is None else np.maximum(self.start, self.at + 1 - width)
        return Stretches(value, *self._wavelets[i], lo)

    def from_row(self, n: int, found: np.ndarray) -> np.ndarray:
        return np.where(self.row >= n, found, np.nan)


def _share(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(count, n, out=np.full(len(n), np.nan), where=n > 0)


def _rolling_rank(c: Chunk, i: int, d: int, own: int) -> np.ndarray:
    s = c.stretches(i, d)
    return c.from_row(d, _share(s.below() + own, s.n))


def _cross_rank(c: Chunk, i: int, kind: str) -> np.ndarray:
    """Place of a value among those of its group, over their number: the lowest place of equal ones, or their mean."""
    v = c.columns[i]
    there = ~np.isnan(v)
    at = np.flatnonzero(there)
    group = c.start[at]
    order = np.lexsort((v[at], group))
    g, s = group[order], v[at][order]
    n = len(s)
    new_group = np.append(True, g[1:] != g[:-1])[:n]
    new_value = new_group | np.append(True, s[1:] != s[:-1])[:n]
    here = np.arange(n)
    lowest = np.maximum.accumulate(np.where(new_value, here, 0))
    first = np.maximum.accumulate(np.where(new_group, here, 0))
    ends = np.flatnonzero(np.append(new_value[1:], True)[:n])
    upto = ends[np.searchsorted(ends, here)] + 1 - first
    count = np.bincount(np.cumsum(new_group) - 1)[np.cumsum(new_group) - 1] if n else np.zeros(0)
    rank = lowest - first + 1
    place = {"cs_rank": rank, "cs_rank0": rank - 1, "cs_rank_average": (rank + upto) / 2.0}[kind]
    out = np.full(len(v), np.nan)
    out[at[order]] = place / count
    return out


#: What a feature of that name computes: ``(chunk, parameters, numbers of its input columns)``.
OPS: Mapping[str, Callable[[Chunk, tuple, Sequence[int]], np.ndarray]] = {
    "ts_median": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], p[0]).linear(0.5)),
    "ts_quantile": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], p[0]).nearest(p[1])),
    "ts_rank": lambda c, p, i: _rolling_rank(c, i[0], p[0], 1),
    "ts_rank0": lambda c, p, i: _rolling_rank(c, i[0], p[0], 0),
    "expanding_median": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], None).linear(0.5)),
    "expanding_percentile": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], None).nearest(p[1])),
    "expanding_percentile_linear": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], None).linear(p[1])),
    "expanding_rank": lambda c, p, i: c.from_row(p[0], c.stretches(i[0], None).below("right") / c.row),
    "recurrence": lambda c, p, i: recurrence(c.columns[i[0]], c.row, c.start, *p),
    "affine_scan": lambda c, p, i: affine_scan(c.columns[i[0]], c.columns[i[1]], c.start)[0],
    "affine_run": lambda c, p, i: affine_scan(c.columns[i[0]], np.zeros(len(c.row)), c.start)[1],
}


RANKS = ("cs_rank", "cs_rank0", "cs_rank_average")


class Request(NamedTuple):
    name: str
    op: str | Callable[[Chunk, tuple, Sequence[int]], np.ndarray]  # a name in OPS, or a function of that kind
    params: tuple
    inputs: Sequence[tuple[str, Column]]  # inputs of one name are the same column


def add_passes(df: DataFrame, series: Sequence[str], ts: str, row_number: Column, requests: Sequence[Request], *,
               arranged: bool = False) -> DataFrame:
    """``df`` and a double column for each request, in one shuffle by series (none if ``arranged`` so) and one pass.

    A task holds the rows of its longest series.
    """
    columns = {name: column for r in requests for name, column in r.inputs}
    place = {name: i for i, name in enumerate(columns)}
    wanted = [(r.op, r.params, [place[name] for name, _ in r.inputs]) for r in requests]
    own = "_i"
    while any(c.startswith(own) for c in df.columns):
        own = f"_{own}"
    x = df.select("*", *[c.cast("double").alias(f"{own}{place[n]}") for n, c in columns.items()], row_number.cast("long").alias(f"{own}row"))
    if not arranged:
        x = x.repartition(*series).sortWithinPartitions(*series, ts)
    schema = T.StructType([*df.schema.fields, *[T.StructField(r.name, T.DoubleType()) for r in requests]])
    return x.mapInArrow(_pass(list(series), len(columns), wanted), schema)


def _pass(series: list[str], n_inputs: int, wanted: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_series(batches, series):
            own = table.num_columns - n_inputs - 1
            chunk = Chunk(table.column(own + n_inputs).to_numpy(), first, [table.column(own + i).to_numpy() for i in range(n_inputs)])
            out = table.select(list(range(own)))
            for i, (op, params, inputs) in enumerate(wanted):
                out = out.append_column(f"_r{i}", pa.array(_function(op)(chunk, params, inputs), pa.float64(), from_pandas=True))
            yield from out.combine_chunks().to_batches()
    return run


def add_carried(df: DataFrame, series: Sequence[str], ts: str, inputs: Sequence[Column], names: Sequence[str],
                fold: Callable[[Chunk, Any], tuple[Mapping[str, np.ndarray], Any]]) -> DataFrame:
    """``df`` and double columns ``names``, in one shuffle by series and one pass that holds no whole series.

    ``fold`` gets some rows after the others, and what it handed on at the end of the last ones where their last series goes
    on (else None); it returns the columns, and what the next rows need. A task holds about ``ROWS`` rows.
    """
    own = "_i"
    while any(c.startswith(own) for c in df.columns):
        own = f"_{own}"
    x = df.select("*", *[c.cast("double").alias(f"{own}{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return x.repartition(*series).sortWithinPartitions(*series, ts).mapInArrow(_carried(list(series), len(inputs), list(names), fold), schema)


def _carried(series: list[str], n_inputs: int, names: list[str], fold: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = carry = None
        for table in _some_rows(batches):
            keys = table.select(series)
            first = _firsts(keys if last is None else pa.concat_tables([last, keys]), series)
            if last is not None:  # the row before these counts as their first
                carry = None if 1 in first else carry
                first = np.union1d(0, first[1:] - 1)
            own = table.num_columns - n_inputs
            chunk = Chunk(np.arange(table.num_rows), first, [table.column(own + i).to_numpy() for i in range(n_inputs)])
            found, carry = fold(chunk, carry)
            last = keys.slice(table.num_rows - 1)
            out = table.select(list(range(own)))
            for n in names:
                out = out.append_column(n, pa.array(found[n], pa.float64(), from_pandas=True))
            yield from out.combine_chunks().to_batches()
    return run


def _some_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _function(op: str | Callable) -> Callable:
    if op in RANKS:
        return lambda c, p, i: _cross_rank(c, i[0], op)
    return OPS[op] if isinstance(op, str) else op


def whole_series(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series, and the first row of each; rows come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        cut = int(_firsts(table, keys)[-1])
        if cut:
            done = table.slice(0, cut)
            yield done, _firsts(done, keys)
            held, rows, enough = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
        else:  # one long series: look again when there is twice as much
            enough = 2 * rows
    if rows:
        table = pa.Table.from_batches(held)
        yield table, _firsts(table, keys)


def _firsts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        a, b = column[1:], column[:-1]
        changed = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= changed | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)
