"""Importance resampling towards a target: hashed runs of words of corpus and target, a gain for each bucket, a noisy draw.

The checksum of a run of words follows from that of its beginning, so a head-tail vocabulary saves most of the work:
frequent words have their checksum state, frequent pairs their checksum ready in every task; runs with any other word
are taken through the checksum byte by byte. Which words are frequent changes the time, never a result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import drop_stored, store, text_slices

BUCKETS = 10_000
#: Frequent words with a ready state; those of them whose pairs are counted; frequent pairs with a ready checksum.
HEAD_WORDS, PAIR_WORDS, HEAD_PAIRS = 1 << 15, 1 << 10, 1 << 16
#: A longer word is never in the head: states are moved by tables of so many lengths.
LONGEST = 64
#: Distinct words a task counts before it hands them on.
_COUNTED = 1 << 18
#: A-Z as a-z, every byte that is neither a digit, a letter nor beyond ASCII as a space.
_LETTERS = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))

_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()),
                     ("row", pa.int64())])


class Head(NamedTuple):
    """What every task knows of frequent words; its size is bounded by the three limits above."""

    words: list[bytes]  # by falling frequency
    pairs: np.ndarray   # first * PAIR_WORDS + second, of the frequent pairs


class Crc:
    """Checksums of runs of words from the states of frequent words."""

    def __init__(self, head: Head) -> None:
        self.number = _Numbers((w, i) for i, w in enumerate(head.words))
        self.alone = np.array([zlib.crc32(w) for w in head.words], np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in head.words], np.uint32)
        self.size = np.array([len(w) + 1 for w in head.words], np.int64)
        self.shift = _shift_tables(LONGEST + 1)
        self.slot = np.full(PAIR_WORDS * PAIR_WORDS if len(head.pairs) else 0, -1, np.int32)
        self.slot[head.pairs] = np.arange(len(head.pairs))
        first, second = np.divmod(head.pairs, PAIR_WORDS)
        self.pair = self.append(self.alone[first], second)

    def append(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Checksums of texts of checksum ``crc`` and, after a space, frequent words."""
        at = self.size[word] << 10
        out = self.after[word]
        for k in range(4):
            out = out ^ self.shift[at + (k << 8) + (crc >> np.uint32(8 * k) & np.uint32(255))]
        return out

    def features(self, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Checksums of all runs of one, two and three words of the texts ``first``; where the last two kinds begin."""
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        known = ids >= 0
        one = np.zeros(len(ids), np.uint32)
        one[known] = self.alone[ids[known]]
        for i in np.flatnonzero(~known).tolist():
            one[i] = zlib.crc32(words[i])

        begin2 = np.flatnonzero(text[1:] == text[:-1])
        two = np.zeros(len(begin2), np.uint32)
        both = known[begin2] & known[begin2 + 1]
        b = np.flatnonzero(both)
        i, j = ids[begin2[b]], ids[begin2[b] + 1]
        place = np.full(len(b), -1, np.int32)
        if len(self.slot):
            near = np.flatnonzero((i < PAIR_WORDS) & (j < PAIR_WORDS))
            place[near] = self.slot[i[near] * PAIR_WORDS + j[near]]
        ready = place >= 0
        two[b[ready]] = self.pair[place[ready]]
        two[b[~ready]] = self.append(one[begin2[b[~ready]]], j[~ready])
        self._direct(words, one[begin2], begin2 + 1, ~both, two)

        pair_at = np.zeros(len(ids), np.int64)
        pair_at[begin2] = np.arange(len(begin2))
        begin3 = np.flatnonzero(text[2:] == text[:-2])
        three = np.zeros(len(begin3), np.uint32)
        start = two[pair_at[begin3]]
        all3 = both[pair_at[begin3]] & known[begin3 + 2]
        b = np.flatnonzero(all3)
        three[b] = self.append(start[b], ids[begin3[b] + 2])
        self._direct(words, start, begin3 + 2, ~all3, three)
        return one, two, three, begin2, begin3

    @staticmethod
    def _direct(words: list[bytes], start: np.ndarray, last: np.ndarray, which: np.ndarray, out: np.ndarray) -> None:
        which = np.flatnonzero(which)
        crc32 = zlib.crc32
        out[which] = [crc32(words[i], crc32(b" ", c)) for c, i in zip(start[which].tolist(), last[which].tolist())]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _shift_tables(sizes: int) -> np.ndarray:
    """For each size and each byte of a checksum: what that byte becomes under so many zero bytes; flat."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()  # the remainder of a byte by the checksum's polynomial
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    tables = np.empty((sizes + 1, 4, 256), np.uint32)
    tables[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(sizes):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ step[tables[n] & np.uint32(255)]
    return tables.ravel()


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """Slices of a batch: rows from and to, all words in a row, and where each text's words begin."""
    text = pc.fill_null(batch.column(column), "")
    for lo, hi in text_slices(text):
        words, first = [], [0]
        for t in text.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist():
            words += t.translate(_LETTERS).split()
            first.append(len(words))
        yield lo, hi, words, np.array(first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for _, _, words, _ in _texts(batch, 0):
            seen.update(words)
            if len(seen) > _COUNTED:
                yield out()
    yield out()


def _count_pairs(head: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers((w, i) for i, w in enumerate(head.value[:PAIR_WORDS]))
        seen = np.zeros(PAIR_WORDS * PAIR_WORDS, np.int64)
        for batch in batches:
            for _, _, words, first in _texts(batch, 0):
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                follows = np.ones(len(ids), bool)
                follows[first[:-1][first[:-1] < len(ids)]] = False
                here = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0) & follows[1:])
                np.add.at(seen, ids[here] * PAIR_WORDS + ids[here + 1], 1)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(seen[found], pa.int64())], ["pair", "n"])
    return run


def _count_buckets(head: Broadcast, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, seen = Crc(head.value), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words, first in _texts(batch, 0):
                for kind in crc.features(words, first)[:3]:
                    seen += np.bincount(kind % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["bucket", "n"])
    return run


def _weigh(head: Broadcast, gains: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, gain = Crc(head.value), gains.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, words, first in _texts(batch, 1):
                one, two, three, begin2, begin3 = crc.features(words, first)
                each = np.zeros(len(words) + 1, np.int64)
                each[:-1] = gain[one % np.uint32(len(gain))]
                each[begin2] += gain[two % np.uint32(len(gain))]
                each[begin3] += gain[three % np.uint32(len(gain))]
                sums = np.concatenate([[0], np.cumsum(each[:-1])])
                n = np.diff(first)
                features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
                rows = np.arange(row, row + len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, (n, features, np.diff(sums[first]), rows))], schema=_SCORED)
    return run


def _frequent(counted: DataFrame, key: str, most: int) -> list:
    """The keys of the highest counts, at most ``most`` of them, by falling count: whole steps of 1/16 of a doubling.

    The totals are written once; the driver gets a histogram of 1,024 steps at most, then the keys themselves.
    """
    totals = store(counted.groupBy(key).agg(F.sum("n").alias("n")), "totals")
    step = F.floor(16 * F.log2("n"))
    room, least = most, None
    for r in sorted(totals.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    found = [] if least is None else totals.filter(step >= least).collect()
    drop_stored(totals)
    return [r[key] for r in sorted(found, key=lambda r: (-r.n, r[key]))]


def head_of(texts: DataFrame) -> Head:
    """The most frequent words and pairs of all of ``texts(text)``, the same each time."""
    sc = texts.sparkSession.sparkContext
    counted = texts.mapInArrow(_count_words, "word binary, n long").filter(F.length("word") < LONGEST)
    words = [bytes(w) for w in _frequent(counted, "word", HEAD_WORDS)]
    counted = texts.mapInArrow(_count_pairs(sc.broadcast(words)), "pair long, n long")
    return Head(words, np.array(sorted(_frequent(counted, "pair", HEAD_PAIRS)), np.int64))


def bucket_totals(texts: DataFrame, head: Broadcast, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is met in all of ``texts(text)``; ``buckets`` numbers go to the driver."""
    totals = np.zeros(buckets, np.int64)
    found = texts.mapInArrow(_count_buckets(head, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():
        totals[r.bucket] = r.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor of 1000 times the log of its smoothed share in the target over that in the corpus."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def resample(df: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """All documents with ``doc_id, n_words, n_features, weight, score, rank``; a rank tells that a document is drawn.

    Features are all runs of one to three words, hashed to ``buckets`` by checksum. A document's weight sums its
    features' gains, its score adds noise fixed by ``seed`` and id (so the highest scores are a draw without
    replacement in proportion to the weights). Of the documents of ``least_words`` words, ``percent`` of a hundred
    are drawn, highest score first, ties to the smaller id.

    Four passes over the texts, none of which moves them: words are counted, then pairs of the most frequent of them
    (the head, of fixed size, goes to all tasks), then buckets, then weights. Per-task counts are added up by Spark;
    ``buckets`` numbers reach the driver. Narrow scored rows are written once and ranked by ranges of (score, id):
    a range's rows are numbered by its task and begin after those of earlier ranges.

    Null texts have no words; documents without features weigh 0; a null id's noise is that of the text ``seed:``, and
    it comes after other ids; repeated rows are documents like any other (equal ones are ranked in any order, which the result
    cannot tell); a very long text is handled alone; an empty table has no rows, an empty target only counts of 0. Columns
    beside id and text are not read, whatever their names.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    head = spark.sparkContext.broadcast(head_of(docs.select("text")))
    corpus = bucket_totals(docs.select("text"), head, buckets)
    wanted = bucket_totals(target.select(F.col(f"`{target_text}`").alias("text")), head, buckets)
    gain = spark.sparkContext.broadcast(gains(corpus, wanted))
    scored = store(docs.mapInArrow(_weigh(head, gain), "doc_id long, n_words long, n_features long, weight long, row long"), "scored")

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
                               1, 8), 16, 10).cast("double")
    scored = scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296))))
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.filter(fit).count() // 100
    order = [fit.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features"), F.asc("row")]
    ranked = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranked = store(ranked, "ranked").withColumn("part", F.shiftright("place", 33))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))  # one row a task
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") - F.shiftleft("part", 33) + 1
    return ranked.join(F.broadcast(starts), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (rank <= drawn), rank).alias("rank"))
