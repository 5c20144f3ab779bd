"""Line dedup: repeated passages word by word (:mod:`quantloom.llm.passages`), or, on request, runs of whole lines.

The whole-line form joins every window of lines with its first place in the corpus and extends both ways; it selects no
fingerprints, and a tail of under a window may stay where the first place does not hold it. A line of running prose holds many sentences, so lines are cut further at the space after a sentence's end: a passage
pasted into a paragraph is then a run of whole lines but for its first sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import passages
from quantloom.llm.common import any_columns, mix, prefix_sums, span_hashes, store, text_id, text_slices, utf8, words

#: Words of a window of lines: every repeated run of lines with so many words holds a common fingerprint.
WINDOW_WORDS = 30
_CUT = {True: re.compile(r"\n|(?<=[.!?]) "), False: re.compile(r"\n")}
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPACE = " \t\n\x0b\x0c\r"


def lines(raw: np.ndarray, offsets: np.ndarray, sentences: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and number of words of each line with a word, and rows + 1 places where each row's lines begin."""
    w = words(raw, offsets)
    cut = raw == 10
    if sentences:
        ended = np.zeros(len(raw), bool)
        ended[1:] = np.isin(raw[:-1], (33, 46, 63))
        ended[offsets[:-1][offsets[:-1] < len(raw)]] = False
        cut |= ended & (raw == 32)
    newline = np.flatnonzero(cut)
    line = np.searchsorted(newline, w.start) + w.doc
    first = np.flatnonzero(np.diff(line, prepend=-1))
    start, doc = w.start[first], w.doc[first]
    n = np.searchsorted(newline, start)
    bounds = np.concatenate([[-1], newline, [len(raw)]])
    lo = np.maximum(bounds[n] + 1, offsets[:-1][doc])
    hi = np.minimum(bounds[n + 1], offsets[1:][doc])
    return (span_hashes(prefix_sums(raw), lo, hi), np.diff(np.append(first, len(line))),
            np.searchsorted(doc, np.arange(len(offsets))))


def windows(line: np.ndarray, count: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shortest windows of ``least`` words from each line on: start, end, the place of the minimum, and a fingerprint.

    The fingerprint is the hash of the window's lines together with that of its minimum (the last one of equals).
    """
    total = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(len(line))
    end = np.searchsorted(total, total[:-1] + least) - 1
    inside = end < np.repeat(first[1:], np.diff(first))
    start, end = start[inside], end[inside]
    minimum, value = start.copy(), line[start].copy()
    for d in range(1, int((end - start).max(initial=0)) + 1):
        at = np.flatnonzero(start + d <= end)
        lower = at[line[start[at] + d] <= value[at]]
        minimum[lower], value[lower] = start[lower] + d, line[start[lower] + d]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int((end - start).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)]))
    whole = np.zeros(len(start), np.uint64)
    for d in range(int((end - start).max(initial=0)) + 1):
        at = np.flatnonzero(start + d <= end)
        whole[at] += line[start[at] + d] * power[d]
    return start, end, minimum, mix(mix(whole + (end - start).astype(np.uint64)) ^ value)


def _fingerprints(least: int, sentences: bool):
    """Each row's lines, the first window of every fingerprint, and the runs that repeat inside the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                line, count, first = lines(*utf8(part.column(2)), sentences)
                start, _, _, key = windows(line, count, first, least)
                doc = np.searchsorted(first, start, side="right") - 1
                order = np.lexsort((start, key, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
                new = np.ones(len(start), bool)
                new[order[1:][same]] = False
                own = np.searchsorted(doc[new], np.arange(len(part) + 1))
                at = pa.array(start[new] - first[doc[new]], pa.int32())
                found = pa.StructArray.from_arrays([pa.array(key[new].view(np.int64)), at], ["key", "start"])
                again: dict[int, list[tuple[int, int]]] = {}
                for d, i, before in zip(doc[order[1:][same]].tolist(), start[order[1:][same]].tolist(), start[order[:-1][same]].tolist()):
                    again.setdefault(d, []).append((i - int(first[d]), i - before))
                held = [line[x:y] for x, y in zip(first[:-1], first[1:])]
                inside = [_inside(held[d].tolist(), again[d]) if d in again else [] for d in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.tobytes() for x in held], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(own, pa.int32()), found),
                     pa.array([[{"start": x, "end": y} for x, y in spans] for spans in inside], _SPAN)],
                    names=["doc_id", "h", "lines", "windows", "inside"])
    return run


def _inside(line: list[int], again: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of a text that repeat its own earlier lines, from (window, distance to its previous place)."""
    by_shift: dict[int, list[int]] = {}
    for start, shift in again:
        by_shift.setdefault(shift, []).append(start)
    return [run for shift, starts in by_shift.items() for run in extend(line, line, shift, starts)]


def extend(mine: list[int], other: list[int], shift: int, starts: list[int]) -> list[tuple[int, int]]:
    """Runs of ``mine`` equal to ``other`` at ``shift``, grown both ways from each start as far as the lines agree."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        if out and start <= out[-1][1]:
            continue
        a, b = start, start
        while a > 0 and a > shift and mine[a - 1] == other[a - 1 - shift]:
            a -= 1
        while b + 1 < len(mine) and b + 1 - shift < len(other) and mine[b + 1] == other[b + 1 - shift]:
            b += 1
        out.append((a, b))
    return out


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, h, mine, other, shift, starts in zip(*[c.to_pylist() for c in batch.columns]):
            for a, b in extend(np.frombuffer(mine, np.uint64).tolist(), np.frombuffer(other, np.uint64).tolist(), shift, starts):
                out.append((doc, h, a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                             names=["doc_id", "h", "start", "end"])


def remove(text: str, runs: list[tuple[int, int]], sentences: bool = True) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The text without the lines of ``runs`` (numbers among lines with words) and what is blank inside a run.

    Also the lines and words removed, and the removed character ranges. Kept neighbours of a removed run are joined
    by a newline if there was one between them, else by a space.
    """
    cuts = [(m.start(), m.group()) for m in _CUT[sentences].finditer(text)]
    bounds = [-1, *(at for at, _ in cuts), len(text)]
    parts = [(a + 1, b) for a, b in zip(bounds, bounds[1:])]
    full = [i for i, (a, b) in enumerate(parts) if text[a:b].strip(_SPACE)]
    merged: list[list[int]] = []
    for a, b in sorted((full[a], full[b]) for a, b in runs):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    pieces, n_words, lines_gone, at = [], 0, 0, 0
    for a, b in [*merged, [len(parts), len(parts)]]:
        if at < a:
            if pieces:
                pieces.append("\n" if any(c == "\n" for _, c in cuts[gap:at]) else " ")
            pieces.append(text[parts[at][0]:parts[a - 1][1]])
        if a < len(parts):
            n_words += sum(len([x for x in text[p:q].translate(_BLANKS).split(" ") if x]) for p, q in parts[a:b + 1])
            lines_gone += sum(a <= i <= b for i in full)
            gap = a - 1 if at < a or not pieces else gap
        at = b + 1
    return "".join(pieces), lines_gone, n_words, [(parts[a][0], parts[b][1]) for a, b in merged]


_BLANKS = str.maketrans(dict.fromkeys(_SPACE, " "))


def _remove(sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                rows = []
                for text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if runs:
                        rows.append(remove(text, [(r["start"], r["end"]) for r in runs], sentences))
                    else:
                        rows.append((text, 0, 0, []))
                text, gone, n_words, spans = zip(*rows)
                found = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPAN)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(text, pa.string()), pa.array(gone, pa.int64()), pa.array(n_words, pa.int64()), found],
                    names=[*part.schema.names[2:], "text", "removed_lines", "removed_words", "removed"])
    return run


@any_columns("doc_id", "text")
def line_dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window_words: int = WINDOW_WORDS,
               sentences: bool | None = None) -> DataFrame:
    """All rows and columns of ``df``; ``text`` without later repeats, and ``removed_lines, removed_words, removed``.

    Every run of ``window_words`` words or more that stands earlier in the corpus - in a row of smaller id (null ids
    first, then by the text's hash) or further up in the same text - is deleted wherever it begins and ends, and its
    first place stays. Words are equal byte for byte; the blanks between them do not count. Each window of
    ``window_words`` words is compared with all earlier places (by 64-bit hashes). Only one or two words that a run
    holds of a line beyond a newline stay, as these agree by chance. ``removed_lines`` are the lines (up to a newline or
    the space after ``.``, ``!`` or ``?``) that lost words; ``removed`` holds character ranges of the old text.

    With ``sentences`` True or False only whole lines go. A run of whole lines with ``window_words`` words or more that stands earlier in the corpus - in a row of smaller
    id (null ids first, then by the text's hash) or further up in the same text - is deleted; its first place stays.
    Every shortest window of lines with so many words is a fingerprint. A fingerprint met before in the same text is matched with its previous place there,
    a text's first one with the first place in the corpus. Matches of two texts at one shift are extended both
    ways as far as their lines agree, and the later text loses the run. Every deleted line
    has an equal line at an earlier place, so no content is lost. Lines are equal byte for byte; lines without words
    count for nothing and go only inside a run. With ``sentences`` a line also ends at the space after ``.``, ``!`` or
    ``?``. ``removed`` holds character ranges of the old text.

    Null texts stay null. Rows of equal id and text are one document: they keep and lose the same lines. An empty
    table gives an empty result; columns of ``df`` with an output's name (but the text) are replaced, others may have any
    name; a very long text is handled alone, in memory in proportion to its words.
    """
    if sentences is None:
        return passages.dedup(df, doc_id=doc_id, text=text, least=window_words)
    made = ("removed_lines", "removed_words", "removed")
    keep = [c for c in df.columns if c not in made and c != text]
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("_doc"), text_id(F.col(f"`{text}`")).alias("_h"),
                     F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    table = store(rows.select("_doc", "_h", "_text").mapInArrow(
        _fingerprints(window_words, sentences),
        "doc_id long, h long, lines binary, windows array<struct<key: long, start: int>>, inside array<struct<start: int, end: int>>"), "lines")
    found = table.select("doc_id", "h", F.inline("windows"))
    # most windows stand in one place: their keys alone are counted, and only repeated ones move with their places
    repeated = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    again = store(found.join(repeated.select("key"), "key", "left_semi"), "repeats")
    again = again.select("key", F.struct("doc_id", "h", "start").alias("at"))
    later = again.join(again.groupBy("key").agg(F.min("at").alias("first")), "key").filter(F.col("at") != F.col("first"))
    matches = later.groupBy(
        F.col("at.doc_id").alias("doc_id"), F.col("at.h").alias("h"), F.col("first.doc_id").alias("o_doc_id"),
        F.col("first.h").alias("o_h"), (F.col("at.start") - F.col("first.start")).alias("shift")).agg(
        F.collect_set("at.start").alias("starts"))  # at most a text's lines
    held = table.groupBy("doc_id", "h").agg(F.first("lines").alias("lines"))
    other = held.select(F.col("doc_id").alias("_od"), F.col("h").alias("_oh"), F.col("lines").alias("other"))
    matches = matches.join(other, matches["o_doc_id"].eqNullSafe(other["_od"]) & (matches["o_h"] == other["_oh"]))
    mine = held.select(F.col("doc_id").alias("_md"), F.col("h").alias("_mh"), F.col("lines").alias("mine"))
    matches = matches.join(mine, matches["doc_id"].eqNullSafe(mine["_md"]) & (matches["h"] == mine["_mh"]))
    runs = matches.select("doc_id", "h", "mine", "other", "shift", "starts").mapInArrow(_extend, "doc_id long, h long, start int, end int")
    runs = runs.union(table.select("doc_id", "h", F.inline("inside")))
    runs = runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    joined = rows.join(runs, rows["_doc"].eqNullSafe(runs["doc_id"]) & (rows["_h"] == runs["h"]), "left")
    # the joined columns beside the row's own
    own = [rows[c] for c in rows.columns if c not in ("_doc", "_h", "_text")]
    ready = joined.select(rows["_text"], runs["runs"].alias("_runs"), *own)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ready.schema.fields[2:])
    out = ready.mapInArrow(_remove(sentences), fields + "text string, removed_lines long, removed_words long, removed array<struct<start: int, end: int>>")
    order = [F.col("text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns if c not in made]
    return out.select(*order, *made)
