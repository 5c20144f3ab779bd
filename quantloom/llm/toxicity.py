"""Toxicity: a chain of linear classifiers over hashed words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD, any_columns, prefix_sums, span_hashes, text_id, text_slices, utf8, words

#: Labelled rows that a chain learns from at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Hash buckets of words.
BITS = 22
#: Words kept for one classifier at most, and how far from chance they must be.
FEATURES, LEAST_Z = 2000, 3.0
FOLDS = 3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each row, and rows + 1 places where each row's begin."""
    raw, offsets = utf8(pc.utf8_lower(column))
    w = words(raw, offsets, WORD)
    bucket = (span_hashes(prefix_sums(raw), w.start, w.end) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((w.doc.astype(np.int64) << BITS) | bucket)
    return pairs & ((1 << BITS) - 1), np.searchsorted(pairs >> BITS, np.arange(len(column) + 1))


@dataclass
class Linear:
    """Logistic regression on the presence of chosen words and on the earlier categories' probabilities."""

    buckets: np.ndarray
    weights: np.ndarray  # words, then earlier probabilities, then the constant

    def margins(self, bucket: np.ndarray, first: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        at = np.searchsorted(self.buckets, bucket)
        at[at == len(self.buckets)] = 0
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        row = np.repeat(np.arange(n), np.diff(first))
        k = len(self.buckets)
        words_part = np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n)
        return words_part + earlier @ self.weights[k:-1] + self.weights[-1]

    def predict(self, bucket: np.ndarray, first: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(bucket, first, earlier), -30, 30)))


def _choose(bucket: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words whose share among positives and negatives differs most, in order of bucket."""
    n1, n0 = y.sum(), len(y) - y.sum()
    found, at = np.unique(bucket, return_inverse=True)
    with1 = np.bincount(at, weights=y[row], minlength=len(found))
    with0 = np.bincount(at, minlength=len(found)) - with1
    p = (with1 + with0 + 1) / (len(y) + 2)
    z = (with1 / max(n1, 1) - with0 / max(n0, 1)) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)))
    best = np.lexsort((found, -np.abs(z)))[:FEATURES]
    return np.sort(found[best[(np.abs(z[best]) >= LEAST_Z) & (with1 + with0 >= 3)[best]]])


def fit(bucket: np.ndarray, first: np.ndarray, earlier: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 200) -> Linear:
    """Penalised likelihood by accelerated gradient steps; a category without both values is a constant."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(first))
    chosen = _choose(bucket, row, y) if 0 < y.sum() < n else np.zeros(0, np.int64)
    k, extra = len(chosen), earlier.shape[1]
    w = np.zeros(k + extra + 1)
    base = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(base / (1 - base))
    if not 0 < y.sum() < n:
        return Linear(chosen, w)
    at = np.searchsorted(chosen, bucket)
    hit = (at < k) & (chosen[np.minimum(at, k - 1)] == bucket) if k else np.zeros(len(bucket), bool)
    col, row = at[hit], row[hit]
    # every coordinate has its own step: a bound of the curvature by the row sums of the design
    length = np.bincount(row, minlength=n) + earlier.sum(axis=1) + 1.0
    curve = np.concatenate([np.bincount(col, weights=length[row], minlength=k), earlier.T @ length, [length.sum()]])
    ridge = np.concatenate([np.full(k + extra, l2), [0.0]])
    scale = 1 / (0.25 * curve + ridge)
    ahead, old, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        m = np.bincount(row, weights=ahead[col], minlength=n) + earlier @ ahead[k:-1] + ahead[-1]
        error = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
        grad = np.concatenate([np.bincount(col, weights=error[row], minlength=k), earlier.T @ error, [error.sum()]]) + ridge * ahead
        w = ahead - scale * grad
        if (w - old) @ grad > 0:  # restart of the momentum
            t = 1.0
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, old = w + (last - 1) / t * (w - old), w
    return Linear(chosen, w)


@dataclass
class Chain:
    """One classifier for each category, in order, and the threshold of the last one."""

    categories: tuple[str, ...]
    links: list[Linear]
    threshold: float

    def predict(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        earlier = np.zeros((len(first) - 1, 0))
        for link in self.links:
            earlier = np.column_stack([earlier, link.predict(bucket, first, earlier)])
        return earlier


def _subset(bucket: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)[rows]
    start = np.cumsum(sizes) - sizes
    return bucket[np.repeat(first[:-1][rows] - start, sizes) + np.arange(sizes.sum())], np.concatenate([[0], np.cumsum(sizes)])


def fit_chain(bucket: np.ndarray, first: np.ndarray, y: np.ndarray, categories: Sequence[str], least_precision: float) -> Chain:
    """Each category's classifier sees the out-of-fold probabilities of the earlier ones; so is the threshold set."""
    n = len(y)
    fold = np.arange(n) % FOLDS  # rows come in the order of their ids' hashes
    earlier, links = np.zeros((n, 0)), []
    for c in range(y.shape[1]):
        out = np.zeros(n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                link = fit(*_subset(bucket, first, inside), earlier[inside], y[inside, c])
                out[outside] = link.predict(*_subset(bucket, first, outside), earlier[outside])
        links.append(fit(bucket, first, earlier, y[:, c]))
        earlier = np.column_stack([earlier, out])
    return Chain(tuple(categories), links, _threshold(earlier[:, -1], y[:, -1], least_precision) if n else 0.5)


def _threshold(p: np.ndarray, y: np.ndarray, least_precision: float) -> float:
    """The threshold with the best F1 among those of the wanted precision, between 0.2 and 0.8."""
    best, at = -1.0, 0.5
    for t in np.arange(0.2, 0.81, 0.05):
        hits, said, real = ((p >= t) & (y > 0)).sum(), (p >= t).sum(), y.sum()
        if said and hits >= least_precision * said and 2 * hits / (said + real) > best:
            best, at = 2 * hits / (said + real), float(t)
    return at


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, least_precision: float = 0.9) -> Chain:
    """A chain from labelled documents: at most ``sample`` labels (smallest hashes of their ids), fitted in one task.

    ``categories`` are 0/1 columns of ``labels`` in the order of the chain; the last one decides. Labels with a null
    and labels without a document are left out; equal labels of an id count once, and of several texts of an id the one
    with the largest hash, so the rows are at most the labels of the sample. Each link keeps 2,000 words at most.
    """
    y = labels.select(F.col(f"`{doc_id}`").alias("_id"), *[F.col(f"`{c}`").cast("double").alias(f"_y{i}") for i, c in enumerate(categories)])
    y = y.dropna().distinct().withColumn("_h", F.xxhash64("_id")).orderBy("_h", *y.columns).limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = rows.join(F.broadcast(y), "_id").groupBy("_id", "_h", *[f"_y{i}" for i in range(len(categories))]).agg(
        F.max_by("_text", text_id("_text")).alias("_text"))
    rows = rows.select("_h", F.array(*[f"_y{i}" for i in range(len(categories))]).alias("y"), "_text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                bucket, first = features(part.column(2))
                found = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["_h", "y", "x"])

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="stable")
        first = np.concatenate([[0], np.cumsum([len(x) for x in pdf["x"]])])
        bucket = np.concatenate([*pdf["x"], np.zeros(0, np.int64)]).astype(np.int64)
        chain = fit_chain(bucket, first, np.array(pdf["y"].tolist()), categories, least_precision)
        return pd.DataFrame({"threshold": chain.threshold, "buckets": [x.buckets for x in chain.links],
                             "weights": [x.weights for x in chain.links]}).reset_index(names="link")

    found = sorted(rows.mapInArrow(vectors, "_h long, y array<double>, x array<int>").groupBy((F.col("_h") * 0).alias("all"))
             .applyInPandas(fitted, "link long, threshold double, buckets array<long>, weights array<double>")
             .collect())  # one row for each category
    if not found:
        return Chain(tuple(categories), [Linear(np.zeros(0, np.int64), np.zeros(i + 1) - 5.0 * (np.arange(i + 1) == i))
                                         for i in range(len(categories))], 0.5)
    links = [Linear(np.array(r.buckets, np.int64), np.array(r.weights)) for r in found]
    return Chain(tuple(categories), links, found[0].threshold)


def _score(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"p_{c}" for c in chain.categories]
        for batch in batches:
            for lo, hi in text_slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                p = chain.predict(*features(part.column(0)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1]),
                     pa.array(p[:, -1] >= chain.threshold)], names=[*batch.schema.names[1:], *names, "score", "toxic"])
    return run


@any_columns("text")
def score(df: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``p_<category>`` of each link, ``score`` (the last one) and ``toxic``.

    A null or empty text has no words: its probabilities are the classifiers' constants. Columns of ``df`` with an
    output's name are replaced, others may have any name; repeated rows get equal results; an empty table gives an
    empty result; a very long text is scored alone; nothing is shuffled.
    """
    outputs = [*(f"p_{c}" for c in chain.categories), "score"]
    keep = [c for c in df.columns if c not in (*outputs, "toxic")]
    rows = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    return rows.mapInArrow(_score(chain), fields + "".join(f"`{c}` double, " for c in outputs) + "toxic boolean")
