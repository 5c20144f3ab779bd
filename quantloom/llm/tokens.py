"""Token-id files: concatenated ids in blocks, document boundaries in Elias-Fano form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import text_id, text_slices
from quantloom.llm.eliasfano import EliasFano
from quantloom.llm.encode import SLICE, encoder

#: A block ends with the document that takes it past so many ids.
BLOCK_TOKENS = 1 << 20

_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("ids", pa.binary())])
_BLOCK_DDL = "shard int, block int, before long, n_tokens long, width int, doc_ids array<bigint>, ends binary, ids binary"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _write_blocks(tokenizer: str, keeps_spaces: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_spaces)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        number, before, docs, parts, total = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts]) // enc.dtype.itemsize
            row = [shard, number, before, int(ends[-1]), enc.dtype.itemsize, docs, EliasFano.encode(ends).tobytes(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi in text_slices(text, SLICE):
                raw = enc.encode([t or "" for t in text.slice(lo, hi - lo).to_pylist()])
                for doc, r in zip(ids.slice(lo, hi - lo).to_pylist(), raw):
                    docs.append(doc)
                    parts.append(r + end)
                    total += len(parts[-1])
                    if total >= BLOCK_TOKENS * enc.dtype.itemsize:
                        yield block()
                        number, before, docs, parts, total = number + 1, before + total // enc.dtype.itemsize, [], [], 0
        if docs:
            yield block()
    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str, *, keeps_spaces: bool = True, end_id: int = 0,
                 doc_id: str = "doc_id", text: str = "text") -> None:
    """Write every document's ids and ``end_id``, in ascending ``doc_id`` order, as a folder of blocks.

    One row is a block of a shard: the number of the shard's ids before it, its ids as little-endian 2- or 4-byte numbers (``width``), the documents' ids,
    and the documents' end offsets inside the block in Elias-Fano form. Shards are ranges of ``doc_id`` and blocks
    follow each other inside a shard, so ``(shard, block)`` is the corpus order. Null texts are empty documents
    (the end id alone), null ids come last, rows of one id stand in the order of their text's hash and text.
    An empty table gives a folder without blocks. Other columns are not read.
    """
    # the hash beside the id lets the ranges split many rows of one id
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("_h", text_id("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("_h")
    rows.mapInArrow(_write_blocks(tokenizer, keeps_spaces, end_id), _BLOCK_DDL).write.mode("overwrite").parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``first``, the ids before each block. Only a row for each shard is summed and sent to all."""
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # as many rows as tasks wrote
    earlier = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(earlier, F.lit(0)).alias("_shard"))
    return blocks.join(F.broadcast(shards), "shard").withColumn("first", F.col("_shard") + F.col("before"))


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, width, docs, ends, ids in zip(*[c.to_pylist() for c in batch.columns]):
            ends = EliasFano.frombytes(ends).decode()
            starts = np.concatenate([[0], ends[:-1]])
            all_ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
            parts = [all_ids[a:b].tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first, pa.int64()),
                                              pa.array(ends - starts, pa.int64()), pa.array(parts, pa.binary())], schema=_READ)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document; ``ids`` as little-endian unsigned 32-bit numbers."""
    blocks = block_starts(spark.read.parquet(path))
    return (blocks.select("first", "width", "doc_ids", "ends", "ids")
            .mapInArrow(_read_blocks, "doc_id long, start long, n_tokens long, ids binary"))


def lookup(block: dict, i: int) -> tuple[int, np.ndarray]:
    """Offset and ids of the i-th document of a block row: two selects, nothing else of the index is decoded."""
    ends = EliasFano.frombytes(bytes(block["ends"]))
    start, end = ends[i - 1] if i else 0, ends[i]
    return start, np.frombuffer(block["ids"], f"<u{block['width']}", end - start, start * block["width"])
