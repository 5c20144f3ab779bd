import math

import numpy as np

from quantloom.llm import language, queries

PATH = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op8_language"](spark, PATH).join(
        spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    unseen = got[got.held_out]
    assert len(unseen) > 100 and (unseen.lang_pred == unseen.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def _plain_mixture(loglik, penalty):
    """The mixture of one document, word by word."""
    n, langs = loglik.shape
    like = np.exp(loglik - loglik.max(axis=1, keepdims=True))

    def em(share):
        for _ in range(language.STEPS):
            total = [0.0] * langs
            for w in like:
                p = [a * b for a, b in zip(w, share)]
                total = [t + x / sum(p) for t, x in zip(total, p)]
            share = [t / n for t in total]
        return share, sum(math.log(sum(a * b for a, b in zip(w, share))) for w in like)

    share, best = em([1 / langs] * langs)
    while sum(s > 0 for s in share) > 1:
        least = min((i for i in range(langs) if share[i] > 0), key=lambda i: share[i])
        trial = [0 if i == least else s for i, s in enumerate(share)]
        trial, score = em([t / sum(trial) for t in trial])
        if score < best - penalty * math.log(max(n, 2)) / 2:
            break
        share, best = trial, score
    return share


def test_mixture_matches_plain_form():
    rng = np.random.default_rng(3)
    docs = [rng.normal(-20, 4, (n, 3)) for n in (1, 2, 15, 40)]
    docs.append(np.where(np.arange(60)[:, None] % 3 == 0, [[-5.0, -30.0, -30.0]], [[-30.0, -5.0, -30.0]]))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
    got = language.mixtures(np.concatenate(docs).astype(np.float32), first, 2.0)
    for share, d in zip(got, docs):
        assert np.allclose(share, _plain_mixture(d, 2.0), atol=1e-3)
    assert np.allclose(got[-1], [1 / 3, 2 / 3, 0], atol=1e-3)


def test_edges(spark, docs_of, sf):
    rows = [(i, "the cat and the dog are here " * 5, "en") for i in range(40)] + [(100 + i, "der hund und die katze sind da " * 5, "de") for i in range(40)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 — ½ !!", "de"), (203, "the dog", None), (None, "die katze", "de"),
           (204, "the dog and the cat are here " * 4000, None), (205, "the dog", None), (205, "the dog", None)]
    df = docs_of(rows + odd)
    got = {}
    for r in queries.QUERIES["op8_language"](spark, sf(documents=df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i in (200, 201, 202):
        assert (got[i][0].lang_pred, got[i][0].score) == ("und", 0.0)
    assert got[203][0].lang_pred == got[204][0].lang_pred == "en" and got[None][0].lang_pred == "de"
    assert got[None][0].held_out is False and len(got[205]) == 2
    assert queries.QUERIES["op8_language"](spark, sf(documents=docs_of([]))).count() == 0
    assert {r.lang_pred for r in queries.QUERIES["op8_language"](spark, sf(documents=docs_of([(1, "text", None)]))).collect()} == {"und"}
    clash = language.identify(df.withColumnRenamed("source", "score"), queries.language_model(df))
    assert clash.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score", "languages"]
