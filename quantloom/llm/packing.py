"""Packing into windows of several lengths: tiers, gap filling from shorter tiers, balanced step groups."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import text_slices
from quantloom.llm.encode import encoder

#: Window lengths, shortest first; each is a power of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens packed together inside a task; what does not fill a window goes on to the next round.
ROUND_TOKENS = 1 << 21
#: Tokens of a step group: sequences of one tier, and of all tiers in a task's last ones; one group a task may be short.
STEP_TOKENS = 1 << 16
#: Words whose ids a packing worker keeps in each of two generations: it also holds a round of tokens.
KEPT_WORDS = 300_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
                    ("ids", pa.binary())])
_DDL = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, "
        "step_group long, ids binary")


class Packer:
    """Packs pieces ``(length, document, start)``; :meth:`pack` gives full windows, :meth:`rest` what is left."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.open: list[tuple[int, int, int]] = []  # sorted by length

    def add(self, doc: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Route a document: whole longest windows leave at once, the tail waits in its tier."""
        top = self.tiers[-1]
        for start in range(0, length - top + 1, top):
            yield top, [(top, doc, start)]
        if length % top:
            insort(self.open, (length % top, doc, length - length % top))

    def pack(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows, longest tier first; a piece is cut only where no whole one fits the gap."""
        while self.open:
            base = self.open.pop()
            tier = next(t for t in self.tiers if t >= base[0])
            window, gap = [base], tier - base[0]
            while gap and self.open:
                i = bisect_right(self.open, (gap, float("inf"), 0))
                if i:
                    window.append(self.open.pop(i - 1))
                else:
                    length, doc, start = self.open.pop(0)
                    window.append((gap, doc, start))
                    insort(self.open, (length - gap, doc, start + gap))
                gap -= window[-1][0]
            if gap:  # all other pieces are placed: these wait for more
                self.open = sorted(window)
                return
            yield tier, window

    def rest(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """The last pieces, cut into windows of powers of two, so that nothing is padded."""
        total = sum(p[0] for p in self.open)
        pieces = self.open[::-1]
        self.open = []
        while total:
            size = 1 << (total.bit_length() - 1)
            window, gap = [], size
            while gap:
                length, doc, start = pieces.pop()
                window.append((min(length, gap), doc, start))
                if length > gap:
                    pieces.append((length - gap, doc, start + gap))
                gap -= window[-1][0]
            yield size, window
            total -= size


class Steps:
    """Group numbers: a tier's sequences share a group as soon as they fill it; the last ones of all tiers mix.

    :meth:`of` gives the sequences of a group that is full, :meth:`rest` those of the unfinished ones, largest first.
    As window lengths are powers of two, each common group but the last is full if ``tokens`` is a multiple of them.
    """

    def __init__(self, base: int, tokens: int) -> None:
        self.base, self.tokens, self.next = base, tokens, 1
        self.waiting: dict[int, list] = {}

    def of(self, tier: int, sequence) -> list[tuple[int, object]]:
        waiting = self.waiting.setdefault(tier, [])
        waiting.append(sequence)
        return self._close([(tier, s) for s in self.waiting.pop(tier)]) if (len(waiting) + 1) * tier > self.tokens else []

    def rest(self) -> Iterator[list[tuple[int, object]]]:
        left = [(tier, s) for tier in sorted(self.waiting, reverse=True) for s in self.waiting[tier]]
        self.waiting = {}
        group, size = [], 0
        for tier, sequence in left:
            if group and size + tier > self.tokens:
                yield self._close(group)
                group, size = [], 0
            group.append((tier, sequence))
            size += tier
        if group:
            yield self._close(group)

    def _close(self, group: list[tuple[int, object]]) -> list[tuple[int, object]]:
        number = self.base + self.next
        self.next += 1
        return [(number, s) for _, s in group]


def _pack(tokenizer: str, keeps_spaces: bool, end_id: int, tiers: tuple[int, ...], round_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_spaces, KEPT_WORDS)
        end = np.array([end_id], enc.dtype).tobytes()
        base = TaskContext.get().partitionId() << 32
        packer, steps, held, sequence, number, waiting = Packer(tiers), Steps(base, step_tokens), {}, 0, 0, 0
        rows: list[tuple] = []

        def put(windows) -> None:
            nonlocal sequence
            for tier, window in windows:
                offset, pieces = 0, []
                for length, doc, start in window:
                    doc_id, ids = held[doc]
                    pieces.append((doc_id, start, length, len(ids), base + sequence, offset, tier,
                                   ids[start:start + length].astype("<u4").tobytes()))
                    offset += length
                sequence += 1
                numbered(steps.of(tier, pieces))

        def numbered(group) -> None:
            rows.extend((*piece[:-1], number, piece[-1]) for number, pieces in group for piece in pieces)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)
            rows.clear()
            return batch

        for batch in batches:
            doc_ids, text = batch.column(0), batch.column(1)
            for lo, hi in text_slices(text):
                raw = enc.encode([t or "" for t in text.slice(lo, hi - lo).to_pylist()])
                for doc_id, r in zip(doc_ids.slice(lo, hi - lo).to_pylist(), raw):
                    ids = np.frombuffer(r + end, enc.dtype)
                    held[number] = doc_id, ids
                    put(packer.add(number, len(ids)))
                    number, waiting = number + 1, waiting + len(ids)
                if waiting >= round_tokens:
                    put(packer.pack())
                    held, waiting = {p[1]: held[p[1]] for p in packer.open}, 0
                if rows:
                    yield out()
        enc.forget()  # the worker goes on to other stages' tasks, which need the memory
        put(packer.pack())
        put(packer.rest())
        for group in steps.rest():
            numbered(group)
        if rows:
            yield out()
    return run


def pack(df: DataFrame, tokenizer: str, *, keeps_spaces: bool = False, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         round_tokens: int = ROUND_TOKENS, step_tokens: int = STEP_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids``.

    A document's tokens are its ids and ``end_id``; each token lies in one piece. Documents go to the shortest tier
    that holds them (longer ones are cut into longest windows and a tail), each window is filled with whole pieces
    of shorter tiers, and a piece is cut only to close the last gap. A task's last tokens go to windows of lower
    powers of two, so no window needs padding. Every task packs its own rows in rounds: nothing is shuffled, memory
    holds one round and one document, and a lost task gives the same windows again.

    Null texts are empty documents (one end id); null ids and repeated rows are documents like any other; an empty
    table has no pieces; columns beside id and text are not read.
    """
    if any(t & (t - 1) for t in tiers) or sorted(set(tiers)) != list(tiers):
        raise ValueError("tiers must be ascending powers of two")
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, keeps_spaces, end_id, tuple(tiers), round_tokens, step_tokens), _DDL)
