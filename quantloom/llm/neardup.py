"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import any_columns, mix, prefix_sums, span_hashes, store, text_id, text_slices, utf8, words
from quantloom.llm.groups import components, labels, whole_groups

SHINGLE = 5
#: Similarity as a fraction, so that the last test is one of whole numbers.
THRESHOLD = (4, 5)
#: Bands of equal MinHash values that make two texts candidates: at 0.8 a pair is missed once in 2e8.
BANDS, ROWS = 48, 5
#: Values compared at once, and the posterior probability below which a pair is given up.
STEP, TOLERANCE = 24, 1e-9
#: Values of the first test, inside buckets; the second one compares all.
FIRST = 96
#: Texts of a block; larger buckets and components are compared block by block.
BLOCK = 256

_HASHES = BANDS * ROWS
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)[:, None]
_Q = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(max(SHINGLE, ROWS) + 1)], np.uint64)


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's word shingles (lower case); fewer words than five are one shingle."""
    raw, offsets = utf8(pc.utf8_lower(column))
    w = words(raw, offsets)
    h = span_hashes(prefix_sums(raw), w.start, w.end)
    whole = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(whole) else 0):
        whole += h[k:k + len(whole)] * _Q[k]
    whole = mix(whole)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        if hi - lo >= SHINGLE:
            yield np.unique(whole[lo:hi - SHINGLE + 1])
        elif hi > lo:
            yield mix((h[lo:hi] * _Q[:hi - lo]).sum(keepdims=True) + np.uint64(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def minhash(shingle: np.ndarray) -> np.ndarray:
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    least = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        m = _A * x[at:at + 512]
        m += _B
        np.minimum(least, m.min(axis=1), out=least)
    return least


@lru_cache
def least_matches(length: int) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones that keep a pair), step by step.

    With a uniform prior on the chance p that two values agree, m equal ones of n leave the posterior
    Beta(m + 1, n - m + 1), and P(p >= q) = P(Binomial(n + 1, q) <= m). Values are compared in one byte, so a pair
    at the threshold t agrees with q = t + (1 - t) / 256.
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    q, steps = t + (1 - t) / 256, []
    for n in range(STEP, length + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * q ** m * (1 - q) ** (n + 1 - m)
        steps.append((n, m))
    return steps


def prune(sketch: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes allow the similarity and whose posterior stays above the tolerance at every step."""
    up, down = THRESHOLD
    fits = np.minimum(size[a], size[b]) * down >= np.maximum(size[a], size[b]) * up
    a, b = a[fits], b[fits]
    equal, done = np.zeros(len(a), np.int64), 0
    for n, m in least_matches(sketch.shape[1]):
        equal += (sketch[a, done:n] == sketch[b, done:n]).sum(axis=1)
        keep = equal >= m
        a, b, equal, done = a[keep], b[keep], equal[keep], n
    return a, b


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for lo, hi in text_slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            keys, sizes, bands, sketches = [], [], [], []
            for s in shingles(part.column(2)):
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                v = minhash(s)
                band = mix((v.reshape(BANDS, ROWS).astype(np.uint64) * _Q[:ROWS]).sum(axis=1) + salt)
                bands.append(band.view(np.int64) if len(s) else None)
                sketches.append((v * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "h", "key", "n", "bands", "sketch"])


def _pairs(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a group: inside a block, or across its two blocks."""
    if block[0] == block[-1] and (block == block[0]).all():
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _sketches(t: pa.Table, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, length)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of each bucket that the first values do not rule out."""
    for t, starts in whole_groups(batches, ["bucket", "i", "j"]):
        sketch, size = _sketches(t, FIRST), t.column("n").to_numpy()
        block, key = t.column("block").to_numpy(), t.column("key").to_pylist()
        counts = np.diff(np.append(starts, t.num_rows))
        a, b = [starts[counts == 2]], [starts[counts == 2] + 1]
        twos = block[a[0]] != block[b[0]]
        cross = t.column("i").to_numpy()[a[0]] != t.column("j").to_numpy()[a[0]]
        same = twos == cross  # two rows of one block in the group of two blocks are compared elsewhere
        a, b = [a[0][same]], [b[0][same]]
        for s, c, i, j in zip(starts, counts, t.column("i").to_numpy()[starts], t.column("j").to_numpy()[starts]):
            if c > 2:
                part = block[s:s + c]
                if i != j and (part == part[0]).all():
                    continue
                x, y = _pairs(part)
                x, y = prune(sketch, size, x + s, y + s)
                a.append(x)
                b.append(y)
        a[0], b[0] = prune(sketch, size, a[0], b[0])
        label = labels(t.num_rows, np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in own], pa.binary()),
                                          pa.array([key[i] for i in label[own]], pa.binary())], names=["u", "v"])


def _text_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in text_slices(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            found = pa.array([s.tobytes() for s in shingles(part.column(0))], pa.binary())
            yield pa.RecordBatch.from_arrays([found, *part.columns[1:]], names=["shingles", *part.schema.names[1:]])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities of what the posterior leaves: links of each text (copies counted) and a spanning forest."""
    up, down = THRESHOLD
    for t, starts in whole_groups(batches, ["component", "i", "j"], 512):
        ends = np.append(starts[1:], t.num_rows)
        all_sketches, sizes = _sketches(t, _HASHES), t.column("n").to_numpy()
        blocks, copies = t.column("block").to_numpy(), t.column("copies").to_numpy()
        key, raw = t.column("key").to_pylist(), t.column("shingles").to_pylist()
        i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
        out = []
        for s, e in zip(starts, ends):
            # a repeated row of the table gives a text twice
            at = np.array([r for r in range(s, e) if r == s or key[r] != key[r - 1]])
            if len(at) < 2 or i[s] != j[s] and (blocks[at] == blocks[at[0]]).all():
                continue
            x, y = prune(all_sketches, sizes, *(at[p] for p in _pairs(blocks[at])))
            if not len(x):
                continue
            lists = {r: np.frombuffer(raw[r], np.uint64) for r in np.unique(np.concatenate([x, y])).tolist()}
            _, local = np.unique(np.concatenate(list(lists.values())), return_inverse=True)
            places = dict(zip(lists, np.split(local, np.cumsum([len(v) for v in lists.values()])[:-1])))
            seen, links, kept = np.zeros(int(local.max()) + 1, bool), {}, []
            order = np.argsort(x, kind="stable")
            last = -1
            for a, b in zip(x[order].tolist(), y[order].tolist()):
                if a != last:
                    seen[:] = False
                    seen[places[a]] = True
                    last = a
                both = int(np.count_nonzero(seen[places[b]]))
                if both * down >= (len(places[a]) + len(places[b]) - both) * up:
                    links[a] = links.get(a, 0) + int(copies[b])
                    links[b] = links.get(b, 0) + int(copies[a])
                    kept.append((a - s, b - s))
            if kept:
                root = labels(e - s, *np.array(kept).T)
                out += [(key[r], n, key[s + root[r - s]]) for r, n in links.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))],
                                             names=["key", "links", "root"])


def _in_blocks(df: DataFrame, group: str, size: str) -> DataFrame:
    """Each row once for every pair of blocks that its block takes part in; one pair where a group is one block."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    df = df.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    df = df.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_blocks", "_other")
    return df.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "key")


def jaccard_groups(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, h, stays, no_words`` of every row of ``df``, in no order.

    Texts are sets of five-word shingles of lower-cased words; two are linked at a Jaccard similarity of 0.8 or more.
    ``class_id`` is the smallest id of those that links connect, ``n_links`` the number of other rows linked to a row
    (rows of the same shingles included), ``n_copies`` the rows with its very shingles, itself included. ``h`` is the
    text's hash, and ``stays`` marks the one row of a class (smallest id, then hash) that stands for it.

    Rows of equal shingles are one text from the start. Bands of MinHash values find candidates; inside each bucket
    their values are compared step by step, and a pair is dropped when the posterior probability that it reaches the
    threshold falls below the tolerance. What is left connects texts into components, and inside these all pairs
    are pruned in the same way on more values and verified on the whole shingle sets. Large buckets and components
    go in pairs of blocks, so that no task holds more than two blocks and no pair becomes a row.

    Null texts and texts without words have no links and a class of their own (``class_id`` their id). Null ids are
    rows like others and count last in the choice of ``class_id``; repeated rows are copies; an empty table gives an
    empty result; other columns are not read.
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("h", text_id("text"))
    signed = store(rows.select("doc_id", "h", "text").mapInArrow(
        _signatures, "doc_id long, h long, key binary, n int, bands array<long>, sketch binary"), "signatures")
    classes = store(signed.filter("n > 0").groupBy("key").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("holder"),
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")

    buckets = classes.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    members = buckets.join(shared, "bucket")
    first = classes.select("key", "n", F.substring("sketch", 1, FIRST).alias("sketch"))
    edges = (_in_blocks(members.join(first, "key"), "bucket", "members").select("bucket", "i", "j", "block", "key", "n", "sketch")
             .mapInArrow(_bucket_edges, "u binary, v binary"))
    parts = components(edges).withColumnRenamed("node", "key")

    parts = parts.join(parts.groupBy("component").agg(F.count("*").alias("texts")), "component")
    parts = parts.join(classes.select("key", "copies", "holder.doc_id", "holder.h", "n", "sketch"), "key")
    same = rows["doc_id"].eqNullSafe(parts["doc_id"]) & (rows["h"] == parts["h"])
    held = rows.join(parts, same).select(rows["text"], "key", "component", "texts", "copies", "n", "sketch")
    held = held.mapInArrow(_text_shingles, "shingles binary, key binary, component binary, texts long, copies long, n int, sketch binary")
    verified = store(_in_blocks(held, "component", "texts").select(
        "component", "i", "j", "block", "key", "copies", "n", "sketch", "shingles")
        .mapInArrow(_verify, "key binary, links long, root binary"), "links")

    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    named = components(verified.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    named = named.join(links, "key", "left").join(classes.select("key", "holder"), "key")
    # the row that stands for a class: ids before null, then the text's hash
    rank = F.struct(F.col("holder.doc_id").isNull().alias("none"), "holder.doc_id", "holder.h")
    named = named.join(named.groupBy("component").agg(F.min(rank).alias("best")), "component")
    table = (classes.select("key", "copies", rank.alias("own")).join(named.select("key", "links", "best"), "key", "left")
             .select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("best", "own").alias("best")))
    alone = F.col("n") == 0
    return signed.select("doc_id", "h", "key", "n").join(table, "key", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"), "h",
        (alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))).alias("stays"), alone.alias("no_words"))


@any_columns("doc_id", "text")
def one_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their class in :func:`jaccard_groups`: one of each, and all without words."""
    groups = jaccard_groups(df, doc_id=doc_id, text=text)
    same = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), text_id(F.col(f"`{text}`")))
    chosen = groups.filter("stays").groupBy(F.xxhash64("doc_id", "h").alias("_same")).agg(F.min("no_words").alias("_no_words"))
    # of rows with equal id and text one stays; the join has dealt them out by the same key
    number = F.row_number().over(Window.partitionBy("_same").orderBy("_same"))
    kept = df.withColumn("_same", same).join(chosen, "_same").withColumn("_number", number)
    return kept.filter(F.col("_no_words") | (F.col("_number") == 1)).select(*[F.col(f"`{c}`") for c in df.columns])
