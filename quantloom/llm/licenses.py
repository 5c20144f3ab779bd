"""License scans: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, any_columns, text_slices, utf8, words

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short notices in lower case and their labels; each may differ by one edit for every ``EDIT_LENGTH`` characters.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "licensed under the apache license, version 2.0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "released under the bsd license": "bsd",
    "permission to use, copy, modify, and/or distribute this software": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
EDIT_LENGTH = 10

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_DDL = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,notice:string,start:int,end:int,edits:int>>")
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("edits", pa.int32())]))


class Scanner:
    """Finds phrases and notices in lower-cased texts."""

    def __init__(self, phrases: Mapping[str, str], notices: Mapping[str, str], edit_length: int) -> None:
        gap = f"{_SEPARATOR}+"
        self.phrases = [(label, phrase.split()[-1], re.compile(
            rf"(?<!{_WORD.pattern[:-1]}){gap.join(map(re.escape, phrase.split()))}(?!{_WORD.pattern[:-1]})"))
            for phrase, label in phrases.items()]
        self.automaton = ahocorasick.Automaton()
        self.notices = []
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // edit_length
            self.notices.append((notice, label, edits, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={edits}}}")))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):  # a match with that many edits leaves one of the pieces whole
                seeds.setdefault(notice[a:b], []).append((n, a, b - a))
        for piece, places in seeds.items():
            self.automaton.add_word(piece, places)
        if seeds:
            self.automaton.make_automaton()
        self.seeded = bool(seeds)

    def spans(self, low: str) -> list[tuple[str, str, int, int, int]]:
        """(label, notice, start, end, edits) of the notices in a text, by start."""
        windows: dict[int, list[list[int]]] = {}
        for end, places in self.automaton.iter(low) if self.seeded else ():
            for n, at, size in places:
                notice, _, edits, _ = self.notices[n]
                start = end + 1 - size - at
                lo, hi = max(0, start - edits), min(len(low), start + len(notice) + edits)
                windows.setdefault(n, []).append([lo, hi])
        found = []
        for n, spans in windows.items():
            notice, label, _, pattern = self.notices[n]
            spans.sort()  # a later seed of a notice may give an earlier window
            merged = [spans[0]]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                for m in pattern.finditer(low, lo, hi):
                    found.append((label, notice, m.start(), m.end(), sum(m.fuzzy_counts)))
        # where notices overlap, those nearest to the text stay
        found.sort(key=lambda s: s[4] / len(s[1]))
        kept: list[tuple[str, str, int, int, int]] = []
        taken: list[tuple[int, int]] = []  # what nearer ones cover: disjoint, ascending
        for _, equal in groupby(found, key=lambda s: s[4] / len(s[1])):
            ends = [b for _, b in taken]
            free = [s for s in equal if (i := bisect_right(ends, s[2])) == len(taken) or taken[i][0] >= s[3]]
            kept += free
            taken = _union(taken + [(s[2], s[3]) for s in free])
        return sorted(kept, key=lambda s: (s[2], s[3], s[0]))

    def base(self, low: str) -> list[tuple[int, str]]:
        return [(m.start(), label) for label, last, pattern in self.phrases if last in low for m in pattern.finditer(low)]

    def scan(self, low: str) -> tuple:
        base, spans = self.base(low), self.spans(low)
        first = last = None
        if base:
            starts = [m.start() for m in _WORD.finditer(low)]
            first, last = (bisect_right(starts, at) - 1 for at in (min(base)[0], max(base)[0]))
        labels = {label for _, label in base}
        score = 1.0 if base else max((1 - s[4] / len(s[1]) for s in spans), default=0.0)
        return (len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score,
                [dict(zip(("label", "notice", "start", "end", "edits"), s)) for s in spans])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(phrases: dict, notices: dict, edit_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, edit_length)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            text = batch.column(0)
            for lo, hi in text_slices(text):
                part = pc.ascii_lower(text.slice(lo, hi - lo))
                counts = np.diff(words(*utf8(part), WORD).first)
                rows = [scanner.scan(t or "") for t in part.to_pylist()]
                rest = [c.slice(lo, hi - lo) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(counts, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]],
                    names=[*batch.schema.names[1:], *names])
    return run


@any_columns("text")
def scan_licenses(df: DataFrame, *, text: str = "text", phrases: Mapping[str, str] = PHRASES,
                  notices: Mapping[str, str] = NOTICES, edit_length: int = EDIT_LENGTH) -> DataFrame:
    """The columns of ``df`` without its text, with the counts, labels, ``score`` and ``spans`` of each row.

    The text is lower-cased in A-Z. A phrase counts wherever its words stand consecutively (``n_base``, places as
    word numbers). A notice matches where it occurs with at most one edit for each ``edit_length`` of its characters;
    it is cut into one more piece than edits, so that every match holds a piece unchanged: an automaton finds the
    pieces, and bounded-error matching verifies the text around them; of overlapping notices the nearest stay. ``spans`` are character positions, ``edits``
    the insertions, deletions and substitutions. ``score`` is 1 with a phrase, else that of the best notice,
    1 - edits / length, else 0. A null text is an empty one: no words, empty labels, null positions. Columns of
    ``df`` with an output's name are replaced, others may have any name; repeated rows get equal results; an empty table
    gives an empty result; a very long text is scanned alone, in time in proportion to its length and notices.
    Nothing is shuffled.
    """
    made = {c.split()[0] for c in _DDL.split(", ")}
    keep = [c for c in df.columns if c not in made and c != text]
    rows = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_scan(dict(phrases), dict(notices), edit_length), fields + _DDL)
