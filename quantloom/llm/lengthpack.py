"""Packing planned on the length histogram: best-fit over counts, then pieces take planned slots by rank within length."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import store, text_slices
from quantloom.llm.encode import SLICE, encoder

#: Tokens of a sequence.
WINDOW = 2048
#: Slots that one row of the plan is spread into at once; changes the tasks only.
CHUNK = 1 << 16

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()),
                    ("ids", pa.binary())])
_DDL = "doc_id long, piece int, start long, length long, doc_tokens long, ids_crc32 long, part int, nth long, ids binary"
_SLOT = pa.schema([(c, pa.int64()) for c in ("length", "rank", "n", "sequence_id", "offset")])


def plan(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Best-fit, longest first, over ``counts`` of equal lengths: rows ``(length, rank, n, sequence, offset)``.

    The ``n`` pieces of that length from ``rank`` on stand at ``offset`` in the ``n`` sequences from ``sequence`` on.
    Sequences of one gap are kept as ranges and filled together, each to the end before the next, as best-fit does
    piece by piece. The work depends on the number of lengths, not of pieces.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []                          # ascending gaps of the open sequences
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, number)
    used = 0

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                insort(gaps, gap)
            open_.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece has 1 to {window} tokens, not {length}")
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(gaps, length)
            fresh = i == len(gaps)
            gap = window if fresh else gaps[i]
            each = gap // length
            if fresh:
                first, n = used, -(-left // each)
                used += n
            else:
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[i]
            full = min(n, left // each)
            for j in range(each if full else 0):
                slots.append((length, rank, full, first, window - gap + j * length))
                rank += full
            left -= full * each
            keep(gap - each * length, first, full)
            first, n = first + full, n - full
            if n and left:  # fewer than one sequence takes: the last one
                for j in range(left):
                    slots.append((length, rank + j, 1, first, window - gap + j * length))
                keep(gap - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            keep(gap, first, n)
    return slots


def _pieces(tokenizer: str, keeps_spaces: bool, end_id: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_spaces)
        end = np.array([end_id], enc.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), SLICE):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                rows = []
                for doc_id, raw in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), enc.encode([t or "" for t in texts])):
                    ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), window)):
                        mine = ids[start:start + window].tobytes()
                        length = len(mine) // 4
                        rows.append((doc_id, piece, start, length, len(ids), zlib.crc32(mine), part, seen[length],
                                     mine if with_ids else None))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)
    return run


def pack_by_length(df: DataFrame, tokenizer: str, *, keeps_spaces: bool = False, end_id: int = 0, window: int = WINDOW,
                   with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in as few sequences of at most ``window`` tokens as best-fit finds:
    ``doc_id, piece, start, length, doc_tokens, ids_crc32, sequence_id, offset`` and, ``with_ids``, the ``ids`` as
    little-endian unsigned 32-bit numbers.

    A document's tokens are its ids and ``end_id``. Only longer documents are cut, into whole windows and one rest.
    The texts are read once; the pieces are written to the shared folder, each with its number among its task's
    pieces of that length. Those numbers and the tasks' counts give every piece its rank within its length without
    a sort. Only the histogram (``window`` numbers at most) goes to the driver, which plans on counts alone; the plan
    is spread into one row a slot, and pieces meet their slots on ``(length, rank)``, a key that is never repeated,
    so no length is too frequent. ``ids`` move once, with that join, and not at all without ``with_ids``.

    Null texts are empty documents (the end id alone). Null ids and repeated rows are documents like any other. A
    very long text makes many whole windows; memory holds one text's ids. An empty table has no pieces. Columns beside
    id and text are not read, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = store(rows.mapInArrow(_pieces(tokenizer, keeps_spaces, end_id, window, with_ids), _DDL), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    slots = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*plan(histogram, window))] or [[]] * 5, schema=_SLOT)
    placed = ranked.join(_spread(spark.createDataFrame(slots)), ["length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))


def _spread(slots: DataFrame) -> DataFrame:
    """One row a slot; the chunks of a long plan row go to different tasks."""
    chunks = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    last = F.least(F.col("lo") + CHUNK, F.col("n")) - 1
    each = chunks.repartition("length", "rank", "lo").select("*", F.explode(F.sequence("lo", last)).alias("i"))
    return each.select("length", (F.col("rank") + F.col("i")).alias("rank"),
                       (F.col("sequence_id") + F.col("i")).alias("sequence_id"), "offset")
