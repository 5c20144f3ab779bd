"""SentencePiece encoding and decoding by a Viterbi search that shares the prefixes of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import any_columns, text_slices

#: The character that stands for a space.
MARK = "▁"
#: Words whose ids a worker keeps in each of two generations (results do not depend on it).
KEPT_WORDS = 150_000
#: Bytes of text whose new words are sorted together.
SORTED_TOGETHER = 2 << 20
#: Worse than the worst piece by so much is a character that goes in bytes.
BYTE_PENALTY = 10.0


class Pieces:
    """A model's pieces with scores; ``encode`` finds the segmentation with the largest sum.

    Scores of a unigram model are log probabilities and are taken as they are. A merge model has minus the rank
    of the merge: a piece of rank r scores -log(2 + r), as if frequencies followed the ranks. Characters without a
    piece go in bytes. Of segmentations with one score, the one whose last differing piece is longer is taken.
    """

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = [sp.get_score(i) for i in usable]
        ranks = all(s <= 0 and s == int(s) for s in raw)
        scores = [-math.log(2 - s) for s in raw] if ranks else raw
        self.ids = {sp.id_to_piece(i): (s, i) for i, s in zip(usable, scores)}
        self.byte_ids = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.byte_score = min(scores) - BYTE_PENALTY
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        inner = {p for p in self.ids if MARK in p.lstrip(MARK)}
        # words can be searched one by one where no piece goes on beyond a word's end
        alone = [c for c in ("\n",) if not any(c in p for p in self.ids)]
        ends = "".join(alone)
        self.split = None if inner else re.compile(f"{MARK}*[^{MARK}{ends}]+|{MARK}+" + f"|[{ends}]" * bool(ends))
        self.text = [""] * n
        for p, (_, i) in self.ids.items():
            self.text[i] = p.replace(MARK, " ")
        for b, i in self.byte_ids.items():
            self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def _char_ids(self, c: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def search(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its ids; words in sorted order are a trie's depth-first walk.

        ``best`` and ``back`` hold the forward scores along the current branch: a word keeps those of the prefix
        it shares with the one before and computes the rest.
        """
        ids, tails = self.ids, self.tails
        best, back, last = [0.0], [0], ""
        for word in sorted(set(words)):
            shared, top = 0, min(len(word), len(last))
            while shared < top and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top_score, at, start = -math.inf, end - 1, end - 1
                while start >= 0 and (piece := word[start:end]) in tails:
                    found = ids.get(piece)
                    if found is not None and best[start] + found[0] >= top_score:
                        top_score, at = best[start] + found[0], start
                    start -= 1
                if word[end - 1] not in ids and (score := best[end - 1] + self.byte_score) > top_score:
                    top_score, at = score, end - 1
                best.append(top_score)
                back.append(at)
            out, end = [], len(word)
            while end:
                start = back[end]
                piece = ids.get(word[start:end])
                out += [piece[1]] if piece else self._char_ids(word[start:end])[::-1]
                end = start
            yield word, out[::-1]
            last = word

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        keys = [self.split.findall(t) if self.split else [t] * bool(t) for t in marked]
        new = set().union(*keys).difference(self.known)
        old = {k: self.older[k] for k in new if k in self.older}
        self.known.update(old)
        known = self.known
        for word, found in self.search(new.difference(old)):
            known[word] = np.array(found, self.dtype).tobytes()
        return [b"".join([known[k] for k in ks]) for ks in keys]

    def decode(self, ids: np.ndarray) -> str:
        text = "".join([self.text[i] for i in ids.tolist()])
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo, hi in text_slices(batch.column(0), SORTED_TOGETHER):
                part = batch.slice(lo, hi - lo)
                ids = [np.frombuffer(x, m.dtype).astype("<u4").tobytes() for x in m.encode([t or "" for t in part.column(0).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ids, pa.binary())], names=[*part.schema.names[1:], "ids"])
    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo, hi in text_slices(batch.column(0), SORTED_TOGETHER):
                part = batch.slice(lo, hi - lo)
                texts = [None if x is None else m.decode(np.frombuffer(x, "<u4")) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*part.schema.names[1:], "decoded"])
    return run


def _with(df: DataFrame, source: str, new: str, kind: str, fn) -> DataFrame:
    keep = [c for c in df.columns if c != new]
    rows = df.select(F.col(f"`{source}`").alias("_source"), *[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(fn, f"{fields}{new} {kind}")


@any_columns("text")
def encode(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``ids``: the text's piece ids as little-endian unsigned 32-bit numbers.

    A space counts as the mark and a text begins with one, as in the model's own normalisation; nothing else is
    changed. Each distinct word with its mark is searched once and its ids are kept for later texts. Null and
    empty texts have no ids. A column named ``ids`` is replaced, others may have any name; repeated rows get equal
    ids; an empty table gives an empty result; a very long text is searched alone; nothing is shuffled.
    """
    return _with(df, text, "ids", "binary", _encode(path))


@any_columns("ids")
def decode(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``: the text of each row's ids, null for null.

    Byte pieces in a row are decoded together, what is not UTF-8 as U+FFFD. Decoding an encoded text gives the
    text again, with a space for every mark character it had.
    """
    return _with(df, ids, "decoded", "string", _decode(path))
