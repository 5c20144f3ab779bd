import random
from itertools import combinations

import pytest

from quantloom.llm import neardup, queries
from quantloom.llm.groups import components


def shingle_set(text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in members[root(i)] if x is not None]
        out.append((d, min(ids) if ids else None, links[i], sum(s == sets[i] for s in sets) if sets[i] else 1))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 30, 120, 300]))]
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3, 14])):
            new = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            texts.append(new)
        texts.append(base[:5] + passage + base[5:])
    rows = [" ".join(t) for t in texts]
    rows += [rows[0].upper(), rows[3].replace(" ", "\n\t "), None, None, "", "  ", "one two", "One  two", "a b c d", "a b c d e", rows[5] * 30]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(3, rows[1]), (None, rows[2]), (None, "only null"), (7, "x y z"), (7, "x y z")]


@pytest.mark.parametrize("block", [256, 4])
def test_groups(spark, docs_of, sf, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    path = sf(documents=docs_of(rows).repartition(4).withColumnRenamed("lang", "key").withColumnRenamed("source", "h"))
    got = queries.QUERIES["op3_jaccard_join"](spark, path).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark, docs_of, sf):
    for rows in ([], [(1, None)], [(1, "alone here with some words")]):
        got = queries.QUERIES["op3_jaccard_join"](spark, sf(documents=docs_of(rows))).collect()
        assert [tuple(r) for r in got] == [(d, d, 0, 1) for d, _ in rows]


def test_posterior_steps():
    steps = neardup.least_matches(240)
    assert [n for n, _ in steps] == list(range(24, 241, 24)) and 140 < steps[-1][1] < 170
    assert all(a[1] <= b[1] for a, b in zip(steps, steps[1:]))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:5] + [(1, 1)], "u long, v long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}
