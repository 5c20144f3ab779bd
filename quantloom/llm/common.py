"""Helpers shared by the operators: tables, shared folders, Arrow batches, vectorised words."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer text is a slice of its own.
SLICE = 1 << 20


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset in a local session (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps survive lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`store`."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# -- columns beside the ones an operator reads ------------------------------------------------------------------
def neutral(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that no operator uses, and the new name of each column."""
    names = {c: f"c{i}__" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def renamed_back(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """``out`` with its old names; an old column that has a new one's name is left out."""
    old = {new: c for c, new in names.items()}
    made = {c for c in out.columns if c not in old}
    return out.select(*[F.col(c).alias(old.get(c, c)) for c in out.columns if old.get(c) not in made])


def any_columns(*reads: str):
    """Decorator: the operator may use any name inside and for its results, whatever ``df`` has beside the columns
    that its parameters ``reads`` name."""
    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kw) -> DataFrame:
            bound = signature.bind(df, *args, **kw)
            bound.apply_defaults()
            safe, names = neutral(df)
            for p in reads:
                bound.arguments[p] = names[bound.arguments[p]]
            bound.arguments[next(iter(signature.parameters))] = safe
            return renamed_back(operator(*bound.args, **bound.kwargs), names)
        return run
    return wrap


def text_id(text: Column | str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


# -- Arrow columns inside tasks ---------------------------------------------------------------------------
def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes of text, one row at least."""
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    lo = 0
    while lo < len(column):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield lo, hi
        lo = hi


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _table(letters: Iterable[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(letters)] = True
    return t


#: Word bytes: all but space and \t \n \v \f \r (the words of the quality and near-duplicate operators).
NOT_SPACE = ~_table([32, 9, 10, 11, 12, 13])
#: Word bytes: digits, ASCII letters, and every byte of a character beyond ASCII.
WORD = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        pair = []
        for base in (_P, _PINV):
            steps = np.full(size, base)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        if size > 8 * SLICE:  # a very long text's powers are not kept
            return pair[0][:n], pair[1][:n]
        _POWERS[:] = pair
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hashes` takes the hash of any span in constant time."""
    up, _ = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``start .. end``; equal bytes have equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    doc: np.ndarray    # row of each word
    start: np.ndarray  # first byte
    end: np.ndarray    # after its last byte
    first: np.ndarray  # rows + 1: index of each row's first word


def words(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes; a run ends with its row."""
    inside = letters[raw]
    before = np.zeros(len(raw) + 1, bool)
    before[1:] = inside
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    starts_here = inside & ~before[:-1]
    starts_here[cut] = inside[cut]
    after = np.zeros(len(raw) + 1, bool)
    after[:-1] = inside
    ends_here = inside & ~after[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends_here[last] = inside[last]
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, start, end, first)
