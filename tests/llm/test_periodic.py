import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import periodic, queries

SMALL = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k - 1), max_size=40))


@st.composite
def looping(draw):
    """Letters that loop from some places on."""
    w = draw(SMALL)
    for _ in range(draw(st.integers(0, 3))):
        if w:
            a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 9))
            w = w[:a] + [w[min(a + i % p, len(w) - 1)] for i in range(len(w) - a + draw(st.integers(0, 30)))]
    return w


def all_runs(w, least_words, least_periods):
    """Every period tried on its own; the smallest one of a stretch counts."""
    found = []
    for p in range(1, len(w) // least_periods + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            i += 1
            part = w[s:e]
            if e - s >= max(least_words, least_periods * p) and not any(
                    all(part[x] == part[x + q] for x in range(len(part) - q)) for q in range(1, p)):
                found.append((s, e - s, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(looping())
def test_lyndon_array(w):
    want = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        want.append(j - i)
    assert periodic.lyndon_array(w) == want


@settings(max_examples=400, deadline=None)
@given(looping(), st.sampled_from([(24, 3), (1, 3), (6, 4), (9, 3)]))
def test_runs(w, least):
    assert periodic.runs(np.array(w), *least) == all_runs(w, *least)
    got = [(a + s, n, q) for a, b in periodic.repeated(np.array(w, np.int64), np.array([0, len(w)]), *least)
           for s, n, q in periodic.runs(np.array(w[a:b]), *least)]
    assert got == all_runs(w, *least)


def test_equal_hashes_are_compared_by_letters(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda h: h * np.uint64(0))  # all spans of a length look the same
    w = [1, 2, 3] * 10 + [9] + [4, 5] * 3 + [7] * 30 + [1, 2, 3] * 2
    assert periodic.runs(np.array(w)) == all_runs(w, 24, 3)


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs(np.arange(50), 24, 2)


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words, 24, 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (str(doc_id), len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest(), n)


def test_query(spark, docs_of, sf):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "bé", "c\xa0d", "e.", " f"], rng.integers(0, 90)))) for i in range(150)]
    rows += [(i, "one two\tthree\n" * int(rng.integers(1, 40)) + "x " * int(rng.integers(0, 40))) for i in range(150, 300)]
    rows += [(i, "la " * 30 + "so fa mi " * 10 + "do " * 30) for i in range(300, 306)] + [(303, "la " * 30), (303, "la " * 30)]
    rows += [(400, None), (401, ""), (402, " \n"), (None, "z " * 50), (None, None)]
    got = queries.QUERIES["op12_periodic_runs"](spark, sf(documents=docs_of(rows))).collect()
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, (expected(*r) for r in rows)))


def test_long_text_and_clashing_columns(spark, docs_of):
    words = [f"w{i}" for i in range(100_000)]
    loop = " ".join(words) + " " + " ".join(words[-50_000:] * 6)
    docs = docs_of([(1, loop), (2, "plain " + " ".join(words))]).withColumnsRenamed({"lang": "runs", "source": "collapsed", "n_chars": "best"})
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(50_000, 350_000, 50_000)] and got[1].collapsed == " ".join(words)
    assert got[2].runs == [] and got[2].n_words == 100_001


def test_empty_table(spark, docs_of, sf):
    assert queries.QUERIES["op12_periodic_runs"](spark, sf(documents=docs_of([]))).count() == 0
