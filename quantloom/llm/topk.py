"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import shared_folder

#: Queries held at once: their vectors (and states) are the only things sent to all tasks.
BLOCK = 4096
#: Components of the queries held at once, for wide vectors.
BLOCK_COMPONENTS = 1 << 20
#: Bins of a query's histogram in each round.
BINS = 1024
#: Scores computed at once in a task.
CHUNK = 1 << 21

_HIST = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
_HITS = pa.schema([("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, vec, dim`` of rows with an id and a vector of finite components."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
            .filter(F.col("id").isNotNull() & v.isNotNull()).filter(~bad).withColumn("dim", F.size(v)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return np.floor(256.0 * flat)


class Block:
    """A block of queries of one dimension, and where each one's k-th score lies: ``lo <= it < lo + width``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        bound = np.abs(vectors).sum(axis=1).max(initial=0.0) * largest
        self.exact = bound < 2 ** 53
        span = max(2 * int(bound) + 1, 1)
        self.width = 1
        while self.width < span:
            self.width *= BINS
        self.lo = np.full(len(ids), -int(bound), np.int64)
        self.above = np.zeros(len(ids), np.int64)
        self.all = np.zeros(len(ids), bool)  # fewer than k candidates: all of them are wanted

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates' ids, scores (queries x candidates), and where a candidate is the query itself."""
        rows = max(1, CHUNK // max(1, len(self.ids)))
        dim = self.vectors.shape[1]
        left = self.vectors if self.exact else self.vectors.astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy()
                m = _matrix(part.column(1), dim)
                s = (left @ m.T).astype(np.int64) if self.exact else left @ m.astype(np.int64).T
                i = np.searchsorted(self.ids, ids)
                own = np.flatnonzero((i < len(self.ids)) & (self.ids[np.minimum(i, len(self.ids) - 1)] == ids))
                self_mask = np.zeros(s.shape, bool)
                self_mask[i[own], own] = True
                yield ids, s, self_mask


def _histogram(block: Block):
    """A task's counts by (query, bin), from the top down to the bin that holds its own k-th score in range.

    No bin below that can hold the global k-th score: other tasks only add to the counts above.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = block.width // BINS
        n = len(block.ids)
        total = np.zeros(n * BINS, np.int64)
        for _, s, own in block.scores(batches):
            place = s - block.lo[:, None]
            q, c = np.nonzero((place >= 0) & (place < block.width) & ~own & ~block.all[:, None])
            total += np.bincount(q * BINS + place[q, c] // step, minlength=n * BINS)
        total = total.reshape(n, BINS)
        after = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total  # counts in higher bins
        q, b = np.nonzero((total > 0) & (after < (block.k - block.above)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b])], schema=_HIST)
    return run


def _hits(block: Block):
    """Scores above the k-th, and of those equal to it the task's smallest ids, as many as may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = block.k - block.above
        ties: dict[int, np.ndarray] = {}
        for ids, s, own in block.scores(batches):
            q, c = np.nonzero(((s > block.lo[:, None]) | block.all[:, None]) & ~own)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[c]), pa.array(s[q, c])], schema=_HITS)
            q, c = np.nonzero((s == block.lo[:, None]) & ~block.all[:, None] & ~own)
            cut = np.flatnonzero(np.diff(q)) + 1
            for qs, cs in zip(np.split(q, cut), np.split(c, cut)):
                if len(qs):
                    i = int(qs[0])
                    ties[i] = np.sort(np.concatenate([ties.get(i, ids[:0]), ids[cs]]))[:need[i]]
        for i, found in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i), pa.int32()), pa.array(found, pa.int64()),
                                              pa.array(np.full(len(found), block.lo[i]))], schema=_HITS)
    return run


def _narrow(vectors: DataFrame, block: Block) -> None:
    """One round: the global histogram of each query's range gives the bin of its k-th score."""
    counts = vectors.mapInArrow(_histogram(block), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
    seen = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
    need = F.element_at(F.lit([int(x) for x in block.k - block.above]), F.col("q") + 1)
    found = (counts.withColumn("seen", seen).filter((F.col("seen") >= need) & (F.col("seen") - F.col("n") < need))
             .select("q", "bin", (F.col("seen") - F.col("n")).alias("over")).collect())  # a row for each query of the block
    step = block.width // BINS
    missing = np.ones(len(block.ids), bool)
    for q, b, over in found:
        missing[q] = False
        block.lo[q] += b * step
        block.above[q] += over
    block.all |= missing
    block.width = step


def exact_topk(df: DataFrame, is_query: Column, k: int = 5, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products, ties to smaller ids.

    A component x counts as floor(256 x). Queries are the rows where ``is_query`` holds, candidates all rows of
    another id and the same number of components; vectors that are null or hold null or non-finite components and
    rows without id take no part. Of several query rows with one id the smallest vector asks; repeated candidate rows
    are hits each. Scores are exact up to 64 bits. Fewer than k candidates: all of them. Other columns are not read.

    Queries go in blocks of bounded size, sent to every task. For each block all candidates are scored, and a
    histogram of each query's range is summed over the tasks; the bin with the k-th score is the next round's
    range, until it is one value. A last pass takes the scores above it and its smallest ids.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    vectors = usable(df, vec_id, vector)
    asking = usable(df.filter(is_query), vec_id, vector)
    path = shared_folder(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    sizes = vectors.groupBy("dim").agg(F.max(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(F.floor(256 * x).cast("double")))),
                                                        F.lit(0.0))).alias("largest")).collect()  # a row for each vector length
    for dim, largest in sizes:
        same = vectors.filter(F.col("dim") == dim).select("id", "vec")
        mine = asking.filter(F.col("dim") == dim)
        size, last = max(1, min(BLOCK, BLOCK_COMPONENTS // max(dim, 1))), None
        while True:
            ahead = mine if last is None else mine.filter(F.col("id") > last)
            rows = ahead.groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").limit(size).collect()  # one bounded block
            if not rows:
                break
            last = rows[-1].id
            block = Block(np.array([r.id for r in rows], np.int64),
                          np.floor(256.0 * np.array([r.vec for r in rows]).reshape(len(rows), dim)), largest, k)
            while block.width > 1:
                _narrow(same, block)
            ids = F.element_at(F.lit([int(x) for x in block.ids]), F.col("q") + 1)
            order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            (same.mapInArrow(_hits(block), "q int, vec_id long, score long").withColumn("rank", F.row_number().over(order))
             .filter(F.col("rank") <= k).select(ids.cast("long").alias("query_id"), "rank", "vec_id", "score").write.mode("append").parquet(path))
            if len(rows) < size:
                break
    return spark.read.schema(schema).parquet(path)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""
