import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.checks.compare import compare, connect
from quantloom.llm import queries, topk

PATH = "/root/testdata/sf0.01"


def brute(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if (i, [math.floor(256 * x) for x in v] if v and all(x is not None and math.isfinite(x) for x in v) else v) in ok and i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        q = [math.floor(256 * x) for x in v]
        hits = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits[:k])]
    return sorted(out)


@pytest.mark.parametrize("bins,block", [(1024, 4096), (4, 2)])
def test_topk(spark, monkeypatch, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice([0.0, 0.5, -1.25, 0.031], 3).tolist()) for i in range(0, 400, 5)]
    rows += [(50, [1.0, 1.0, 1.0]), (7, None), (8, [1.0, None, 2.0]), (9, [float("nan")] * 3), (11, [float("inf"), 0.0, 0.0]),
             (None, [9.0] * 3), (12, [1.0, 2.0]), (600, [3.0, 4.0]), (650, []), (13, rows[0][1]), (13, rows[0][1]), (700, [0.0] * 9)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int").repartition(3)
    got = topk.exact_topk(df, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_topk_large_components_and_empty(spark):
    df = spark.createDataFrame([(0, [3e6] * 4), (1, [3e6, 3e6, 3e6, 2e6]), (2, [1e6] * 4)], "vec_id long, embedding array<double>")
    got = topk.exact_topk(df, F.col("vec_id") == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got)] == [(1, 768000000 ** 2 * 3 + 768000000 * 512000000), (2, 768000000 * 256000000 * 4)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_exact_topk"])
def test_against_sql(spark, name):
    assert compare(spark, connect(PATH), PATH, name, queries.QUERIES[name], queries.SQL[name]).startswith("ok")


def test_quality_edges(spark, docs_of, sf):
    texts = [None, "", " \n\x0b", "a b c a b c", "a b c " * 30, "x\n\nx\nx \n y...", "é∆ " * 60, "a a a a", "#*$%&|<> " * 60] * 2
    import duckdb
    df = docs_of(list(enumerate(texts))).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    path = sf(documents=df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    name = "op1_quality_rules"
    assert compare(spark, con, path, name, queries.QUERIES[name], queries.SQL[name]).startswith("ok")
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, path).collect()}
    for i, t in enumerate(texts):
        words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")]
        where = defaultdict(list)
        for j in range(len(words) - 2):
            where[tuple(words[j:j + 3])].append(j)
        inside = {j + d for v in where.values() if len(v) > 1 for j in v for d in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(words), len(inside), sum(map(len, words)))
