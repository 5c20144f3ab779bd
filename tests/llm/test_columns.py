"""Extra columns of any name: no operator or stage fails on them, and none is lost unless an output replaces it."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quantloom.llm import language, licenses, linededup, neardup, pieces, quality, toxicity
from quantloom.llm.toxicity import Chain, Linear

CLASH = ["_words", "_lines", "_keys", "_bits", "_places", "_doc", "_h", "_text", "_starts", "_segs", "_whole", "_same", "_number", "_no_words", "_source",
         "doc_id_", "h", "key", "n", "row", "batch", "score", "lang_pred", "languages", "toxic", "p_low", "kept", "n_words", "ids", "removed", "removed_lines",
         "starts", "segs", "whole", "label", "spans", "class_id", "c0__"]
TEXTS = ["The quick words of a text that is long enough", "mit license applies here", None, "", "le mot et la phrase", "mit license applies here"]


@pytest.fixture
def wide(spark):
    df = spark.createDataFrame([(i, t, "fr" if i == 4 else "en", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_chars long")
    return df.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH])


def models():
    import numpy as np
    chain = Chain(("low", "toxic"), [Linear(np.zeros(0, np.int64), np.zeros(i + 1) - 5.0 * (np.arange(i + 1) == i)) for i in range(2)], 0.5)
    return chain


def test_operators(wide):
    model = language.train(wide.select("doc_id", "text", "lang"))
    runs = {
        "quality": lambda d: quality.quality_rules(d), "licenses": lambda d: licenses.scan_licenses(d), "language": lambda d: language.identify(d, model),
        "toxicity": lambda d: toxicity.score(d, models()), "pieces": lambda d: pieces.encode(d, public_tokenizers.path("piece_bpe_32k.model")),
        "lines": lambda d: linededup.line_dedup(d), "near": lambda d: neardup.one_of_each(d)}
    for name, run in runs.items():
        alone = run(wide.select("doc_id", "text"))
        made = [c for c in alone.columns if c not in ("doc_id", "text")]
        got = run(wide)
        assert len(set(got.columns)) == len(got.columns) and set(got.columns) == {*alone.columns, *[c for c in wide.columns if c not in ("doc_id", "text")]} - (
            {"text"} if "text" not in alone.columns else set()), name
        rows = {r["doc_id"]: r for r in got.collect()}
        want = {r["doc_id"]: r for r in alone.collect()}
        assert rows.keys() == want.keys(), name
        for i, r in rows.items():
            assert [r[c] for c in alone.columns] == [want[i][c] for c in alone.columns], name
            assert all(r[c] == f"{c}{i}" for c in CLASH if c in got.columns and c not in made), name


def test_stages_keep_all_columns(spark, wide, sf):
    path = sf(labels=spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH), name
    assert cp.dedup_lines(spark, wide.drop("n_chars"), path).columns == [c for c in wide.columns if c != "n_chars"]


def test_many_notices_in_one_text():
    from quantloom.llm.licenses import EDIT_LENGTH, NOTICES, PHRASES, Scanner
    notice = next(iter(NOTICES)).lower()
    scanner = Scanner(dict(PHRASES), dict(NOTICES), EDIT_LENGTH)
    found = scanner.spans(" and so on. ".join([notice] * 3000))
    assert len(found) >= 3000 and all(a[3] <= b[2] or a[4] * len(b[1]) == b[4] * len(a[1]) for a, b in zip(found, found[1:]))
