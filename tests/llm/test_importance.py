import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import importance, queries

LONG = "x" * 100


def runs_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(rows, target, percent=5, least=20, n=10_000):
    s, t = Counter(), Counter()
    for total, texts in ((s, (x for _, x in rows)), (t, target)):
        for x in texts:
            total.update(zlib.crc32(f.encode()) % n for f in runs_of(x)[1])
    s_all, t_all = s.total(), t.total()
    out = []
    for d, x in rows:
        words, found = runs_of(x)
        weight = 0
        for f in found:
            b = zlib.crc32(f.encode()) % n
            weight += math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n))))
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(found), weight, score, len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted(str((r[0], *r[1:4], ranks.get(id(r)), r[4])) for r in out)


def corpus():
    rng = np.random.default_rng(5)
    often = ["the", "Of", "und", "é1", LONG]
    rows = []
    for i in range(400):
        words = [often[rng.integers(5)] if rng.random() < 0.7 else f"w{rng.integers(3000)}" for _ in range(rng.integers(0, 60))]
        rows.append((i, ["  ", ", ", "-"][i % 3].join(words)))
    return rows + [(900, None), (901, ""), (902, "?! "), (None, "a b"), (7, "the end"), (7, "the end"), (None, None)]


@pytest.mark.parametrize("limits", [(1 << 15, 1 << 10, 1 << 16), (3, 2, 2), (40, 4, 5), (1, 1, 1)])
def test_query(spark, docs_of, sf, limits, monkeypatch):
    for name, value in zip(("HEAD_WORDS", "PAIR_WORDS", "HEAD_PAIRS"), limits):
        monkeypatch.setattr(importance, name, value)
    monkeypatch.setattr(importance, "_COUNTED", 50)
    rows, target = corpus(), ["The w1 w2 und", None, "", "é1 of the w7 " * 30]
    path = sf(documents=docs_of(rows).repartition(5), benchmark=spark.createDataFrame(list(enumerate(target)), "item_id long, text string"))
    got = queries.QUERIES["op13_importance_resampling"](spark, path)
    assert sorted(map(lambda r: str(tuple(r)), got.collect())) == expected(rows, target)


def test_ties_repeated_rows_and_a_percentage(spark, docs_of):
    rows = [(i % 10, "same words " * 15) for i in range(200)]
    got = importance.resample(docs_of(rows).repartition(7), docs_of([(1, "same words")]), percent=37).collect()
    by_rank = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in by_rank] == list(range(1, 75))
    assert [-r.score for r in by_rank] == sorted(-r.score for r in got)[:74]


def test_long_text_and_clashing_columns(spark, docs_of):
    text = "".join(f"Word{i % 5000} and " for i in range(200_000))
    docs = docs_of([(1, text), (2, "short")]).withColumnsRenamed({"lang": "score", "source": "rank", "n_chars": "place"})
    got = importance.resample(docs, docs_of([])).orderBy("doc_id").collect()
    assert [r.n_features for r in got] == [1_199_997, 1] and [r["rank"] for r in got] == [None, None]
    assert f"{(1, *got[0][2:5], None, got[0].n_words)}" in expected([(1, text), (2, "short")], [])


def test_checksums_move_by_tables():
    head = importance.Head([b"the", b"of", "é".encode() * 20, b"x" * 63], np.array([1, importance.PAIR_WORDS]))
    crc, words = importance.Crc(head), [b"the", b"of", b"the", b"tail", b"x" * 63, "é".encode() * 20, b"the"]
    one, two, three, _, _ = crc.features(words, np.array([0, 0, 7, 7]))
    for n, got in ((1, one), (2, two), (3, three)):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]


def test_empty_table(spark, docs_of, sf):
    path = sf(documents=docs_of([]), benchmark=docs_of([(1, "a b")]))
    assert queries.QUERIES["op13_importance_resampling"](spark, path).count() == 0
