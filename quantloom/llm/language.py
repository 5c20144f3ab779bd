"""Language identification by multilingual mixtures of n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SLICE, _table, any_columns, text_slices, utf8

BUCKETS = 1 << 15
#: Letters of the models: lower-case ASCII and every byte beyond ASCII.
_LETTERS = _table([*range(97, 123), *range(128, 256)])
#: Steps of expectation and maximisation for each candidate set.
STEPS = 8


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of each letter byte, the first letter of each word, each word's row, and the number of rows' letters."""
    raw, offsets = utf8(pc.utf8_lower(column))
    inside = _LETTERS[raw]
    b = np.where(inside, raw, 0).astype(np.uint32)
    before, after = np.zeros_like(b), np.zeros_like(b)
    before[1:], after[:-1] = b[:-1], b[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = 0
    after[offsets[1:][full] - 1] = 0
    at = np.flatnonzero(inside)
    key = (before[at] << np.uint32(16)) | (b[at] << np.uint32(8)) | after[at]
    bucket = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)
    first = np.flatnonzero(before[at] == 0)
    row = np.searchsorted(offsets, at[first], side="right") - 1
    return bucket, first, row, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        text, langs = batch.column(0), batch.column(1).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for lo, hi in text_slices(text):
            part = text.slice(lo, hi - lo)
            bucket, first, row, _ = _letters(part)
            if not len(first):
                continue
            code = np.repeat(codes[lo:hi][row], np.diff(np.append(first, len(bucket))))
            counts = np.bincount(code * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, c in zip(names, counts):
                if c.any():
                    totals[name] = totals.get(name, 0) + c
    for name, c in totals.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                         names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    """Languages in name order and log probabilities of the n-gram buckets (buckets x languages)."""

    langs: tuple[str, ...]
    logp: np.ndarray


def train(df: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """N-gram counts of every row with a text and a language, summed by Spark; the model is one row of buckets each."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).dropna()
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # languages x buckets at most, however many documents
    langs = tuple(sorted(found["lang"].unique()))
    table = np.zeros((BUCKETS, len(langs)))
    where = {name: i for i, name in enumerate(langs)}
    table[found["bucket"].to_numpy(np.int64), found["lang"].map(where).to_numpy(np.int64)] = found["n"]
    table = (table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)
    return Model(langs, np.log(table).astype(np.float32))


def _em(like: np.ndarray, first: np.ndarray, row: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (documents x languages) and the documents' log likelihoods under them."""
    for _ in range(STEPS):
        w = like * share[row]
        w /= w.sum(axis=1, keepdims=True)
        share = np.add.reduceat(w, first, axis=0) / n[:, None]
    mixed = np.log((like * share[row]).sum(axis=1), dtype=np.float64)
    return share, np.add.reduceat(mixed, first)


def mixtures(loglik: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Language shares of documents from their words' log likelihoods (words x languages).

    Starting from all languages, the one with the smallest share leaves while that does not lower the likelihood by
    more than the penalty of a language, ``penalty * log(words) / 2``.
    """
    n = np.diff(np.append(first, len(loglik))).astype(np.float64)
    docs, langs = len(first), loglik.shape[1]
    like = np.exp(loglik - loglik.max(axis=1, keepdims=True))
    like = np.maximum(like, np.float32(1e-30))
    row = np.repeat(np.arange(docs), n.astype(np.int64))
    share = np.full((docs, langs), 1.0 / langs, np.float32)
    share, best = _em(like, first, row, n, share)
    cost = penalty * np.log(np.maximum(n, 2.0)) / 2
    live = np.arange(docs)  # documents whose set may still shrink
    for _ in range(langs - 1):
        words = np.isin(row, live) if len(live) < docs else slice(None)
        n1 = n[live]
        first1 = np.concatenate([[0], np.cumsum(n1.astype(np.int64))[:-1]])
        row1 = np.repeat(np.arange(len(live)), n1.astype(np.int64))
        trial = share[live].copy()
        smallest = np.where(trial > 0, trial, np.inf).argmin(axis=1)
        trial[np.arange(len(live)), smallest] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), np.float32(1e-30))
        trial, score = _em(like[words], first1, row1, n1, trial.astype(np.float32))
        better = score >= best[live] - cost[live]
        share[live[better]], best[live[better]] = trial[better], score[better]
        live = live[better & ((trial > 0).sum(axis=1) > 1)]
        if not len(live):
            break
    return share


def _predict(model: Model, penalty: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model.langs
        size = max(1 << 14, SLICE * 4 // max(4, len(langs)))
        for batch in batches:
            text = batch.column(0)
            pred, score, sets = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [None] * batch.num_rows
            for lo, hi in text_slices(text, size) if langs else ():
                bucket, first, row, _ = _letters(text.slice(lo, hi - lo))
                if not len(first):
                    continue
                loglik = np.concatenate([  # a very long text goes in parts that end with a word
                    np.add.reduceat(model.logp[bucket[a:b]], first[i:j] - a, axis=0)
                    for i, j, a, b in _parts(first, len(bucket), size)])
                docs, at = np.unique(row, return_index=True)
                share = mixtures(loglik, at, penalty)
                top = share.argmax(axis=1)
                for d, s, t in zip(docs.tolist(), share, top.tolist()):
                    pred[lo + d], score[lo + d] = langs[t], float(min(1.0, s[t]))
                    sets[lo + d] = [langs[i] for i in np.flatnonzero(s > least)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(pred), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                names=[*batch.schema.names[1:], "lang_pred", "score", "languages"])
    return run


def _parts(first: np.ndarray, letters: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Word ranges and their letter ranges, about ``size`` letters each."""
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(first, first[i] + size)))
        yield i, j, int(first[i]), int(first[j]) if j < len(first) else letters
        i = j


@any_columns("text")
def identify(df: DataFrame, model: Model, *, text: str = "text", penalty: float = 2.0, least: float = 0.0) -> DataFrame:
    """All columns of ``df`` with ``lang_pred``, ``score`` and ``languages``.

    A document's words are drawn from a mixture of languages; expectation-maximisation estimates the shares from the
    words' n-gram likelihoods and the penalised likelihood selects the set ``languages`` (in name order, shares over
    ``least``). ``lang_pred`` is the one with the largest share, ties to the first name, and ``score`` is that share.
    A null text, a text without letters, or a model without languages gives ``und``, 0 and null. Columns of ``df``
    with an output's name are replaced, others may have any name; repeated rows get equal results; an empty table
    gives an empty result; a very long text goes in parts that end with a word; nothing is shuffled.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "languages")]
    whole = F.col(f"`{text}`").cast("string")
    rows = df.select(F.when(F.regexp_like(whole, F.lit("\\p{L}")), whole).alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_predict(model, penalty, least), f"{fields}, lang_pred string, score double, languages array<string>")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4. A row without id is neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
