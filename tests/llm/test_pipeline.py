import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quantloom.llm import toxicity
from quantloom.llm.common import store
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    after = {}
    for name, stage in cp.STAGES:
        docs = store(stage(spark, docs, SF), name)
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(after["language"]) >= 990
    gone = {r.doc_id for r in after["language"]} - {r.doc_id for r in after["toxicity"]}
    insult = re.compile("idiot|clown|pathetic|trash|worthless|scum|moron|stupid|disgusting|loser", re.I)
    said = [r for r in after["language"] if insult.search(r.text or "")]
    assert sum(r.doc_id in gone for r in said) >= 0.9 * len(said)
    assert sum(labels[d].toxic == 0 for d in gone if d in labels) <= 0.05 * len(gone) + 1
    before = [(r.doc_id, r.text) for r in after["line_dedup"]]
    classes = {d: c for d, c, *_ in brute(before)}
    assert sorted(r.doc_id for r in after["near_duplicates"]) == sorted(set(classes.values()))
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tokens.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in after["near_duplicates"]}
    got = {}
    for r in after["packing"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty_and_odd(spark, docs_of, sf):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cp.run(spark, sf(documents=docs_of([]), labels=labels)).count() == 0
    rows = [(1, None), (2, ""), (3, "the same text of some words"), (3, "the same text of some words"), (4, "the same text of some words"), (None, "x y")]
    got = cp.run(spark, sf(documents=docs_of(rows), labels=labels)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.start == 0) == [(False, 1), (False, 2), (False, 3), (True, None)]


def test_chain_learns(spark, docs_of):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bad, junk = rng.random() < 0.2, rng.random() < 0.3
        words = [f"w{x}" for x in rng.integers(0, 400, 40)] + ["vile"] * bad + ["###"] * junk + ["spam7"] * junk
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(junk), int(bad)))
    y = spark.createDataFrame(labels + [(1000, 1, 1), (2000, None, 1)], "doc_id long, junk int, toxic int")
    docs = docs_of(rows + [(5000, None), (5001, ""), (5001, ""), (None, "Vile, words")]).withColumnRenamed("lang", "score")
    chain = toxicity.train(docs, y, ["junk", "toxic"])
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "p_junk", "p_toxic", "score", "toxic"]
    got = {r.doc_id: r for r in got.collect()}
    assert [got[i].toxic for i, *_ in labels] == [bool(t) for *_, t in labels]
    assert np.mean([(got[i].p_junk >= 0.5) == bool(j) for i, j, _ in labels]) > 0.99
    assert not got[5000].toxic and not got[5001].toxic and got[None].toxic
    none = toxicity.train(docs, y.limit(0), ["junk", "toxic"])
    assert toxicity.score(docs, none).filter("toxic").count() == 0


def test_links_see_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    n = 900
    first_word = rng.integers(0, 30, n)
    y0 = (first_word < 10).astype(float)
    y1 = y0.copy()  # the second category follows the first one
    bucket = np.sort(np.stack([first_word, 100 + rng.integers(0, 50, n)], 1), axis=1).ravel().astype(np.int64)
    chain = toxicity.fit_chain(bucket, np.arange(0, 2 * n + 1, 2), np.column_stack([y0, y1]), ["a", "b"], 0.9)
    assert chain.links[1].weights[-2] > 1  # the weight of the earlier category's probability
    assert ((chain.predict(bucket, np.arange(0, 2 * n + 1, 2))[:, 1] > 0.5) == y1).all()
