"""Passages that stand earlier in the corpus, found word by word: winnowing picks places, then whole windows are compared.

Fingerprints are shingles of words, chosen as the minima of all windows of ``least`` words: what is chosen depends on
those words alone, so a passage has the same fingerprints wherever it is pasted. Stretches between fingerprints go where
they stand earlier as a whole. At what is left around fingerprints that repeat, near the ends of passages, all windows of
``least`` words are taken, one from each word on, and each is compared with all its earlier places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import _powers, drop_stored, mix, prefix_sums, span_hashes, store, text_id, text_slices, utf8, words

#: Words of a line that go with a run ending beyond its border, at least: one or two words agree by chance.
PART_WORDS = 3
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over the words' hashes, and rows + 1 places where each row's words begin."""
    w = words(raw, offsets)
    up, _ = _powers(len(w.start) + 1)
    sums = np.zeros(len(w.start) + 1, np.uint64)
    np.cumsum(span_hashes(prefix_sums(raw), w.start, w.end) * up[:-1], out=sums[1:])
    return sums, w.first


def shingles(sums: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on."""
    _, down = _powers(len(sums))
    return mix((sums[start + n] - sums[start]) * down[start] + np.uint64(n))


def winnow(value: np.ndarray, width: int, start: np.ndarray) -> np.ndarray:
    """Distinct places of the (first) minima of ``value[start .. start + width - 1]``, ascending."""
    at, have = np.arange(len(value)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:len(at) - step], at[step:]
        at, have = np.where(value[a] <= value[b], a, b), have + step
    return np.unique(at[start])


def fingerprints(sums: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each chosen shingle; any ``least`` words in a row hold one that they alone decide."""
    n = max(1, least // 3)
    place = np.arange(len(sums) - 1)
    left = np.repeat(first[1:], np.diff(first)) - place
    if not (left >= least).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = shingles(sums, place[:len(place) - n + 1], n)
    chosen = winnow(value, least - n + 1, place[left >= least])
    return np.searchsorted(first, chosen, side="right") - 1, chosen, value[chosen]


def segments(sums: np.ndarray, first: np.ndarray, doc: np.ndarray, chosen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint a stretch of ``least`` words or more to the end of a later one: start, end and hash.

    A row's first stretch starts with the row, its last ones end with it.
    """
    ends = chosen + max(1, least // 3)
    lo, hi = first[doc], first[doc + 1]
    j = np.searchsorted(ends, chosen + least)
    inside = np.append(doc, -1)[j] == doc
    m = np.maximum(np.searchsorted(chosen, hi - least, side="right") - 1, 0)
    back = np.where((doc[m] == doc) & (chosen[m] + least <= hi), chosen[m], lo) if len(doc) else lo
    start = np.where(np.diff(doc, prepend=-1) > 0, lo, np.where(inside, chosen, back))
    end = np.where(inside, np.append(ends, 0)[j], hi)
    _, down = _powers(len(sums))
    return start, end, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _met(key: np.ndarray) -> np.ndarray:
    """1 where a key stands once among ``key``; of several places the first is 2 and the others are 0."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    met = np.ones(len(key), np.int8)
    met[order[:-1][same]] = 2
    met[order[1:][same]] = 0
    return met


def _fingerprints(least: int):
    """Each row's number of words and its fingerprints with their segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                sums, first = word_hashes(*utf8(part.column(2)))
                doc, place, key = fingerprints(sums, first, least)
                start, end, seg = segments(sums, first, doc, place, least)
                own = np.searchsorted(doc, np.arange(len(part) + 1))
                found = pa.StructArray.from_arrays(
                    [pa.array(key.view(np.int64)), *(pa.array(x - first[doc], pa.int32()) for x in (place, start, end)), pa.array(seg.view(np.int64)),
                     pa.array(_met(key))], ["key", "start", "a", "b", "seg", "met"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(first), pa.int32()), pa.ListArray.from_arrays(pa.array(own, pa.int32()), found)],
                    names=["doc_id", "h", "n_words", "prints"])
    return run


def _open(least: int):
    """Fingerprints with a window around them that lies in no earlier segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.concatenate([[0], np.cumsum(np.asarray(batch.column(1), dtype=np.int64))])
            prints = batch.column(2)
            doc = np.repeat(np.arange(len(batch)), np.asarray(prints.value_lengths()))
            flat = prints.flatten()
            a, b = _around(np.asarray(flat.field("start"), dtype=np.int64) + first[doc], doc, first, least)
            held = np.concatenate([[0], np.cumsum(_covered(batch.column(3), first, least, int(first[-1]) + 1))])
            keep = pa.array(np.flatnonzero(held[b + 1] - held[a] < b + 1 - a))
            row = pa.array(doc).take(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *[flat.field(c).take(keep) for c in ("key", "start")]],
                                             names=["ord", "key", "start"])
    return run


def _covered(batch_lists: pa.Array, first: np.ndarray, least: int, size: int) -> np.ndarray:
    """Windows (by their first word) inside one of their row's segments."""
    edge = np.zeros(size + 1, np.int64)
    lengths = np.asarray(batch_lists.value_lengths().fill_null(0))
    base = first[np.repeat(np.arange(len(batch_lists)), lengths)]
    flat = batch_lists.flatten()
    np.add.at(edge, np.asarray(flat.field("a"), dtype=np.int64) + base, 1)
    np.add.at(edge, np.asarray(flat.field("b"), dtype=np.int64) + base - least + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _around(places: np.ndarray, doc: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (by their first words) of the windows that hold each fingerprint."""
    n = max(1, least // 3)
    return np.maximum(places + n - least, first[doc]), np.minimum(places, first[doc + 1] - least)


def _windows(least: int):
    """All windows of ``least`` words that hold one of the row's open fingerprints, but those in earlier segments;
    ``sure`` where the row itself has the window further up, or an earlier row at hand has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sums, first = word_hashes(*utf8(part.column(1)))
                at = part.column(2)
                doc = np.repeat(np.arange(len(part)), np.asarray(at.value_lengths()))
                a, b = _around(np.asarray(at.flatten(), dtype=np.int64) + first[doc], doc, first, least)
                edge = np.zeros(len(sums) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, b + 1, -1)
                start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & ~_covered(part.column(3), first, least, len(sums)))
                row = np.searchsorted(first, start, side="right") - 1
                key = shingles(sums, start, least)
                place, ord_ = start - first[row], np.asarray(part.column(0))[row]
                order = np.lexsort((place, ord_, key))
                new = np.append(True, key[order][1:] != key[order][:-1])[:len(order)]
                one = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                sure = np.zeros(len(start), bool)
                sure[order] = (ord_[order] != ord_[one]) | (place[order] != place[one])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ord_), pa.array(place, pa.int32()), pa.array(sure)],
                                                 names=["key", "ord", "start", "sure"])
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of ``key`` those whose key stands in two rows or more, by ``met`` (:func:`_met`) or here."""
    last, held = None, None  # the last key that is asked for, and its row while it stands alone
    for batch in batches:
        key, met = np.asarray(batch.column("key")), np.asarray(batch.column("met"))
        keep, ask = met != 1, np.flatnonzero(met > 0)
        if len(ask):
            same = np.append(key[ask[0]] == last, key[ask[1:]] == key[ask[:-1]])
            keep[ask[same]] = True
            keep[ask[:-1][same[1:]]] = True
            if same[0] and held is not None:
                yield held
            last, held = key[ask[-1]], None if keep[ask[-1]] else batch.slice(int(ask[-1]), 1)
        yield batch.filter(pa.array(keep))


def _after_first(key: str, *place: str):
    """Of rows in the order of ``key`` and ``place`` those at another place than their key's first row; ``sure`` ones all,
    which are no first rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and place of the last key's first row
        for batch in batches:
            later = np.asarray(batch.column("sure")).astype(bool)
            ask = np.flatnonzero(~later)
            if len(ask):
                k, *at = (np.asarray(batch.column(c))[ask] for c in (key, *place))
                new = np.append(last is None or k[0] != last[0], k[1:] != k[:-1])
                one = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                firsts = [c[one] if new[0] else np.where(one < 0, x, c[one]) for c, x in zip(at, last[1:] if last else place)]
                later[ask] = np.logical_or.reduce([c != x for c, x in zip(at, firsts)])
                last = (k[-1], *(x[-1] for x in firsts))
            yield batch.filter(pa.array(later))
    return run


def remove(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The text without the words ``start .. end - 1`` of ``runs``, the lines that lost words, the words lost, and their character ranges.

    A run's first or last part of a line goes with it if it has :data:`PART_WORDS` words or no line border follows it
    in the run. What is kept on both sides of a run is joined by the longer break of the two, by a newline if one
    was between them.
    """
    doc, (start, end) = np.zeros(len(runs), np.int64), np.array(runs, np.int64).reshape(-1, 2).T
    texts, lines, n_words, spans = remove_all(pa.array([text], pa.string()), doc, start, end)
    return texts[0].as_py(), int(lines[0]), int(n_words[0]), [(x["start"], x["end"]) for x in spans[0].as_py()]


def remove_all(column: pa.Array, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """:func:`remove` for all texts of ``column`` at once; a run is a row ``doc`` and its words ``start .. end - 1``."""
    raw, offsets = utf8(column)
    w = words(raw, offsets)
    n = len(w.start)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + w.first[doc], 1)
    np.add.at(edge, end + w.first[doc], -1)
    inside = np.cumsum(edge[:-1]) > 0
    opens = np.append(True, w.doc[1:] != w.doc[:-1])[:n]  # a row's first word
    a = np.flatnonzero(inside & (opens | ~np.append(False, inside[:-1])[:n]))
    b = np.flatnonzero(inside & (np.append(opens[1:], True)[:n] | ~np.append(inside[1:], False)[:n])) + 1
    # breaks: newlines in the gap before each word, and whether a line begins with it
    newlines = np.append(0, np.cumsum(raw == 10))
    breaks = np.zeros(n + 1, np.int64)
    before, first = w.end[:-1], w.start[1:]
    breaks[1:n] = np.where(opens[1:], 0, newlines[first] - newlines[before])
    ended = np.zeros(n, bool)
    ended[1:] = (raw[np.minimum(before, len(raw) - 1)] == 32) & np.isin(raw[before - 1], (33, 46, 63))
    line = np.cumsum(opens | ended | (breaks[:n] > 0))
    # parts of lines of one or two words at a run's ends stay
    row = w.doc[a]
    heads, tails = a > w.first[row], b < w.first[row + 1]
    trim, new = heads & (breaks[a] == 0), a.copy()
    for j in range(PART_WORDS - 1, 0, -1):
        new = np.where(trim & (a + j < b) & (breaks[np.minimum(a + j, n)] > 0), a + j, new)
    trim, a = tails & (breaks[b] == 0), new
    new = b.copy()
    for j in range(PART_WORDS - 1, 0, -1):
        new = np.where(trim & (b - j > a) & (breaks[np.maximum(b - j, 0)] > 0), b - j, new)
    b = new
    lines, n_words = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    if len(a):
        np.add.at(lines, row, line[b - 1] - line[a] + 1 - np.append(False, line[a[1:]] == line[b[:-1] - 1]))
        np.add.at(n_words, row, b - a)
    # what is kept, piece by piece
    data = raw.tobytes()
    pieces: list[list[bytes]] = [[] for _ in range(len(column))]
    at = offsets[:-1].tolist()
    left, right = w.end[np.maximum(a - 1, 0)], np.append(w.start, len(raw))[b]
    for d, head, tail, x, y, xa, yb, nx, ny, inner in zip(
            row.tolist(), (a > w.first[row]).tolist(), (b < w.first[row + 1]).tolist(), left.tolist(), right.tolist(),
            w.start[a].tolist(), w.end[b - 1].tolist(), breaks[a].tolist(), breaks[b].tolist(), (newlines[right] > newlines[left]).tolist()):
        if head:
            pieces[d].append(data[at[d]:x])
            if tail:
                pieces[d].append(b"\n" if inner and not nx and not ny else data[yb:y] if ny > nx else data[x:xa])
        at[d] = y if tail else int(offsets[d + 1])
    out = [b"".join([*p, data[lo:hi]]) for p, lo, hi in zip(pieces, at, offsets[1:].tolist())]
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    base = chars[offsets[row]]
    found = pa.StructArray.from_arrays([pa.array(chars[w.start[a]] - base, pa.int32()), pa.array(chars[w.end[b - 1]] - base, pa.int32())],
                                       fields=list(_SPAN.value_type))
    own = np.searchsorted(row, np.arange(len(column) + 1))
    return pa.array(out, pa.binary()).cast(pa.string()), lines, n_words, pa.ListArray.from_arrays(pa.array(own, pa.int32()), found)


def _runs(part: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the runs of rows with ``starts`` of windows, ``segs`` and ``whole``."""
    starts, segs, whole = part.columns[1:4]
    rows = np.arange(len(part))
    all_of = np.asarray(whole.fill_null(0), dtype=np.int64)
    some = np.flatnonzero(all_of)
    one, two = (np.repeat(rows, np.asarray(c.value_lengths().fill_null(0))) for c in (starts, segs))
    at, stretch = np.asarray(starts.flatten(), dtype=np.int64), segs.flatten()
    return (np.concatenate([some, one, two]), np.concatenate([np.zeros(len(some), np.int64), at, np.asarray(stretch.field("a"), dtype=np.int64)]),
            np.concatenate([all_of[some], at + least, np.asarray(stretch.field("b"), dtype=np.int64)]))


def _remove(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                marked = pc.or_(pc.or_(part.column(1).is_valid(), part.column(2).is_valid()), part.column(3).is_valid())
                some = part.filter(marked)  # the other texts stay as they are
                text, *counts, spans = remove_all(some.column(0), *_runs(some, least))
                at = np.where(np.asarray(marked), np.cumsum(np.asarray(marked)) - 1, len(some))
                texts = pc.replace_with_mask(part.column(0), marked, text.cast(part.schema.field(0).type))
                found = pa.concat_arrays([spans, pa.array([[]], spans.type)]).take(pa.array(at))
                counts = [pa.array(np.append(x, 0)[at]) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[4:], texts, *counts, found], names=[*part.schema.names[4:], "text", "removed_lines", "removed_words", "removed"])
    return run


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key stands in two rows or more. Keys alone are counted, so that only repeated rows are ordered later."""
    return rows.join(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key).hint("shuffle_hash"), list(key), "left_semi")


def _dealt(rows: DataFrame, key: str, sure: str, *spread: str) -> DataFrame:
    """Rows of a key together; ``sure`` ones need no others and are dealt by ``spread``, so that a frequent key makes no large task."""
    return rows.repartition(F.when(F.expr(sure), F.xxhash64(*spread)).otherwise(F.col(key)))


def _free(*tables: DataFrame) -> None:
    """Remove stored tables that are done with; what is collected lets Spark drop the shuffle files that made the later ones."""
    for df in tables:
        drop_stored(df)
    tables[0].sparkSession._jvm.System.gc()


def dedup(df: DataFrame, *, doc_id: str, text: str, least: int) -> DataFrame:
    """See :func:`quantloom.llm.linededup.line_dedup`."""
    made = ("removed_lines", "removed_words", "removed")
    keep = [c for c in df.columns if c not in made and c != text]
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("_doc"), text_id(F.col(f"`{text}`")).alias("_h"),
                     F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    table = store(rows.select("_doc", "_h", "_text").mapInArrow(_fingerprints(least),
                  "doc_id long, h long, n_words int, prints array<struct<key: long, start: int, a: int, b: int, seg: long, met: tinyint>>"), "prints")
    # an exact copy of an earlier text goes as a whole, and nothing else of it is compared; ``ord`` grows with (id, hash)
    firsts = table.filter(F.col("n_words") >= least).groupBy("h").agg(F.min(F.struct("doc_id")).alias("one"), F.max("n_words").alias("n_words"))
    order = [F.asc_nulls_first("one"), F.asc("h")]
    docs = store(firsts.select("h", F.col("one.doc_id").alias("one"), "n_words").repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("ord", F.monotonically_increasing_id()), "docs")
    copies = table.select("doc_id", "h").distinct().join(docs.hint("shuffle_hash"), "h").filter(~F.col("doc_id").eqNullSafe(F.col("one")))
    copies = store(copies.select("doc_id", "h", "n_words"), "copies")
    # fingerprints of a hash meet in its order and stream by: most stand in one place and go no further
    again = _dealt(table.select("doc_id", "h", F.inline("prints")), "key", "met = 0", "h", "start").sortWithinPartitions("key")
    again = again.mapInArrow(_repeats, again.schema).drop("met").join(docs.hint("shuffle_hash"), "h")
    again = store(again.filter(F.col("doc_id").eqNullSafe(F.col("one"))).drop("one", "doc_id", "h"), "repeats")
    _free(table)
    # whatever lies in a segment with an earlier place goes; so the first place of any window lies in no such segment
    later = again.select("seg", "ord", "a", "b", F.lit(False).alias("sure")).repartition("seg").sortWithinPartitions("seg", "ord", "a")
    later = later.mapInArrow(_after_first("seg", "ord", "a"), later.schema)
    later = store(later.groupBy("ord").agg(F.collect_set(F.struct("a", "b")).alias("segs")),
                  "segments")  # at most a text's words
    prints = again.groupBy("ord").agg(F.first("n_words").alias("n_words"), F.collect_set(F.struct("key", "start")).alias("prints"))  # equal rows once
    prints = prints.join(later.hint("shuffle_hash"), "ord", "left").select("ord", "n_words", "prints", "segs")
    left = store(prints.mapInArrow(_open(least), "ord long, key long, start int"), "open")
    _free(again)
    # around the fingerprints that are open in two places the other windows are compared one by one
    at = _repeated(left, "key").groupBy("ord").agg(F.collect_set("start").alias("at"))
    at = store(at.join(docs.hint("shuffle_hash"), "ord").join(later.hint("shuffle_hash"), "ord", "left").select(
        "ord", F.col("one").alias("doc_id"), "h", "at", "segs"), "places")
    _free(left)
    near = rows.join(at.hint("shuffle_hash"), rows["_doc"].eqNullSafe(at["doc_id"]) & (rows["_h"] == at["h"]))
    windows = near.select("ord", "_text", "at", "segs").mapInArrow(_windows(least), "key long, ord long, start int, sure boolean")
    windows = _dealt(windows, "key", "sure", "ord", "start").sortWithinPartitions("key", "ord")
    singles = store(windows.mapInArrow(_after_first("key", "ord"), windows.schema).groupBy("ord").agg(F.collect_set("start").alias("starts")), "windows")
    del near, windows
    _free(at)
    span = "array<struct<a: int, b: int>>"
    runs = singles.select("ord", "starts", F.lit(None).cast(span).alias("segs")).union(later.select("ord", F.lit(None).cast("array<int>"), "segs"))
    runs = runs.groupBy("ord").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("starts", "segs"))).join(docs.hint("shuffle_hash"), "ord")
    runs = runs.select(F.col("one").alias("doc_id"), "h", "starts", "segs", F.lit(None).cast("int").alias("whole"))
    runs = store(runs.union(copies.select("doc_id", "h", F.lit(None).cast("array<int>"), F.lit(None).cast(span), "n_words")), "runs")
    _free(singles, later, copies, docs)
    joined = rows.join(runs.hint("shuffle_hash"), rows["_doc"].eqNullSafe(runs["doc_id"]) & (rows["_h"] == runs["h"]), "left")
    # the joined columns beside the row's own
    own = [rows[c] for c in rows.columns if c not in ("_doc", "_h", "_text")]
    ready = joined.select(rows["_text"], runs["starts"].alias("_starts"), runs["segs"].alias("_segs"), runs["whole"].alias("_whole"), *own)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[4:])
    out = ready.mapInArrow(_remove(least), fields + "text string, removed_lines long, removed_words long, removed array<struct<start: int, end: int>>")
    order = [F.col("text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c not in made]
    return out.select(*order, *made)
