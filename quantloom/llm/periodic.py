"""Runs of repeated words: Lyndon arrays by the first phase of Baier's suffix sorter, roots extended by common extensions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import _powers, mix, text_slices

#: Words of a run, and periods in it, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string()),
                     ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_DDL = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string, "
        "runs_sha256 string, collapsed_sha256 string")


def lyndon_array(letters: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place: the first phase of Baier's suffix sorter.

    Suffixes stand in ordered groups whose members share a prefix. From the highest group down, each member sends its
    group's prefix to the nearest place on its left in a lower group; a place that gets it ``l`` times has its own
    prefix lengthened ``l`` times and moves to a new group just above its old one. When the lowest group is done, a
    place's prefix is its longest Lyndon word. Handled places are skipped by path halving, so each suffix is met a few
    times, whatever the text.
    """
    values = sorted(set(letters))
    number = {v: g for g, v in enumerate(values)}
    group = [number[v] for v in letters]
    members: list[list[int]] = [[] for _ in values]
    for place, g in enumerate(group):
        members[g].append(place)
    size = [len(m) for m in members]
    prefix = [1] * len(values)
    below = list(range(-1, len(values) - 1))
    above = list(range(1, len(values) + 1))
    left = list(range(len(group) + 1))  # node i + 1 is place i, node 0 none; a handled place points to its left
    g = len(values) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        for i in mine:
            left[i + 1] = i
        hits: dict[int, int] = {}
        for node in mine:  # the number of the node just left of it
            up = left[node]
            while up != node:
                left[node] = left[up]
                node, up = up, left[up]
            if node:
                hits[node - 1] = hits.get(node - 1, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for place, times in hits.items():
            split.setdefault((times, group[place]), []).append(place)
        for times, old in sorted(split, reverse=True):
            places = split[times, old]
            longer = prefix[old] + times * prefix[g]
            if len(places) == size[old]:  # all that is left of a group: it stays where it is
                prefix[old] = longer
                continue
            new, over = len(members), above[old]
            members.append(places)
            prefix.append(longer)
            size.append(len(places))
            size[old] -= len(places)
            below.append(old)
            above.append(over)
            below[over] = above[old] = new
            for place in places:
                group[place] = new
        g = below[g]
    return [prefix[x] for x in group]


def _extend(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Longest common extensions, at most ``most``, of places ``a`` and ``b``: to the right, or of what ends there.

    Lengths are searched bit by bit over hashes of spans.
    """
    found = np.zeros(len(a), np.int64)
    bit = 1 << int(most.max(initial=0)).bit_length()
    while bit := bit >> 1:
        n = found + bit
        i = np.flatnonzero(n <= most)
        lo_a, lo_b = (a[i], b[i]) if step > 0 else (a[i] - n[i], b[i] - n[i])
        same = ((sums[lo_a + n[i]] - sums[lo_a]) * down[lo_a] == (sums[lo_b + n[i]] - sums[lo_b]) * down[lo_b])
        found[i[same]] += bit
    return found


def _scan(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch of period ``p`` around place ``i``, word by word: for the rare case of equal hashes."""
    start, end = i, i + p
    while start and w[start - 1] == w[start - 1 + p]:
        start -= 1
    while end < len(w) and w[end] == w[end - p]:
        end += 1
    return start, end


def runs(w: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``least_periods`` (3 or more) periods and ``least_words`` letters.

    Every run's Lyndon root is the longest Lyndon word at its place under one of the two orders of letters, so the
    places' longest Lyndon words are all there is to try: each is extended to both sides as far as letters a
    period apart agree. Each run found is compared letter by letter afterwards.
    """
    if least_periods < 3:
        raise ValueError("with fewer than three periods a root need not stand twice from its place on")
    w = np.ascontiguousarray(w, np.int64)
    n = len(w)
    if n < least_words:
        return []
    i = np.tile(np.arange(n), 2)
    p = np.array(lyndon_array(w.tolist()) + lyndon_array((-w).tolist()))
    room = i + 2 * p <= n
    i, p = i[room], p[room]
    likely = (w[i] == w[i + p]) & (w[i + p - 1] == w[i + 2 * p - 1])  # the root stands twice
    i, p = i[likely], p[likely]
    if not len(i):
        return []
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(w.astype(np.uint64)) * up[:n], out=sums[1:])
    right = _extend(sums, down, i, i + p, n - i - p, 1)
    start = i - _extend(sums, down, i, i + p, i, -1)
    end = i + p + right
    long = end - start >= np.maximum(least_words, least_periods * p)
    found = set()
    for s, e, q, at in zip(start[long].tolist(), end[long].tolist(), p[long].tolist(), i[long].tolist()):
        if (s, e - s, q) in found:
            continue
        if not np.array_equal(w[s:e - q], w[s + q:e]):
            s, e = _scan(w, at, q)
            if e - s < max(least_words, least_periods * q):
                continue
        found.add((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray, first: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int]]:
    """Stretches ``(start, end)`` of the texts ``first`` in which all runs lie.

    A run of ``least_periods`` periods and ``least_words`` words says every ``k`` words of it again a period further
    on or back, for the ``k`` below; so words outside of repeated ``k``-grams of their own text are in no run.
    """
    k = least_words - least_words // least_periods
    counts = np.diff(first)
    if not (counts >= least_words).any():
        return []
    up, down = _powers(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64)) * up[:len(ids)], out=sums[1:])
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(ids)) + k <= first[1:][text])
    keys = mix((sums[at + k] - sums[at]) * down[at]) ^ mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    twice = keys[order][1:] == keys[order][:-1]
    at = at[np.unique(np.concatenate([order[1:][twice], order[:-1][twice]]))]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    inside = np.cumsum(cover)[:-1] > 0
    edges = np.zeros(len(ids) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[first] = True
    cuts = np.flatnonzero(edges)
    return [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a >= least_words and inside[a]]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text whose end is made to repeat: for the tenth of all ids that a checksum picks; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def _sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _find(least_words: int, least_periods: int, plant: bool, with_text: bool):
    def texts_of(doc_ids: list, raw: list[bytes]) -> list[tuple]:
        number: dict[bytes, int] = {}
        texts, ids, first = [], [], [0]
        for doc_id, text in zip(doc_ids, raw):
            words = text.split()  # bytes split at the six ASCII blanks alone
            order = planted(doc_id, len(words)) if plant else None
            if order is not None:
                words = [words[i] for i in order.tolist()]
            texts.append(words)
            ids.extend([number.setdefault(w, len(number)) for w in words])
            first.append(len(ids))
        ids = np.array(ids, np.int64)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        bounds = np.array(first)
        for a, b in repeated(ids, bounds, least_words, least_periods):
            text = int(np.searchsorted(bounds, a, side="right")) - 1
            found[text] += [(a - first[text] + s, length, q) for s, length, q in runs(ids[a:b], least_words, least_periods)]
        rows = []
        for doc_id, words, mine in zip(doc_ids, texts, found):
            n = len(words)
            if mine:
                drop = np.zeros(n + 1, np.int64)
                for s, length, q in mine:
                    drop[s + q] += 1
                    drop[s + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
            kept = b" ".join(words)
            listed = "".join(f"{s},{length},{q}\n" for s, length, q in mine).encode()
            rows.append((doc_id, n, [dict(start=s, length=length, period=q) for s, length, q in mine],
                         kept.decode() if with_text else None, _sha256(listed), _sha256(kept)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, text = batch.column(0), pc.fill_null(batch.column(1), "")
            for lo, hi in text_slices(text):
                raw = text.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
                rows = texts_of(doc_ids.slice(lo, hi - lo).to_pylist(), raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
    return run


def periodic_runs(df: DataFrame, *, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, plant: bool = False,
                  with_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of a text that say the same words again and again, and the text with each said once:
    ``doc_id, n_words, runs, collapsed, runs_sha256, collapsed_sha256``.

    A run has a smallest period ``q`` (words ``q`` apart are the same), at least ``least_words`` words and
    ``least_periods`` periods, and no neighbouring word that keeps the period. ``runs`` lists ``start`` (word number),
    ``length``, ``period`` by start, then period; ``collapsed`` joins by one space the words that no run has after its
    first ``q`` words. The checksums are of ``start,length,period`` lines and of the collapsed text. Words are the
    maximal stretches without ASCII blanks. ``plant`` first makes the end of about a tenth of all texts repeat, by a
    rule on ``doc_id``, so that there is something to find; ``with_text=False`` leaves ``collapsed`` null.

    Texts are read once, each in its own task: nothing is shuffled. Stretches without a repeated 16-gram (of the
    default limits) cannot hold a run and are passed over. A very long text is handled alone, in memory in proportion
    to its words. Null and empty texts have no words and no runs; null ids are never planted; repeated rows are
    texts like any other; an empty table has no rows; other columns are not read, whatever their names.
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_find(least_words, least_periods, plant, with_text), _DDL)


def strongest(runs: str = "runs") -> Column:
    """The run with the most periods, by whole numbers; ties to the smallest start, then period; null without a run."""
    def better(a, b):
        # a run's length times a period can pass 63 bits only in texts of billions of words
        more = a["length"] * b["period"] > b["length"] * a["period"]
        return F.when(b.isNull() | more, a).otherwise(b)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(F.col(runs), none, lambda best, r: better(r, best))
