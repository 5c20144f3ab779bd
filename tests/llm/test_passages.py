import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import linededup, passages
from quantloom.llm.common import text_id, utf8

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, least):
    """Words lost by (doc_id, text) in corpus order: all in windows of ``least`` words that stand at any earlier place."""
    seen, lost = set(), {}
    for k in docs:
        w = WORD.findall(k[1] or "")
        lost[k] = set()
        for i in range(len(w) - least + 1):
            window = tuple(w[i:i + least])
            if window in seen:
                lost[k] |= set(range(i, i + least))
            seen.add(window)
    return lost


def prose(rng, n, name="w"):
    return " ".join(f"{name}{rng.randrange(10 ** 6)}{rng.choice(['', '', '', '', '', '', '.'])}" for _ in range(n))


def corpus():
    rng = random.Random(5)
    passage = [prose(rng, n, "p").split(" ") for n in (51, 64, 80, 300, 30, 29)]
    texts = []
    for i in range(120):
        w = prose(rng, rng.randrange(5, 90)).split(" ")
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p if rng.random() < 0.5 else p[a:b]
        texts.append(" ".join(w))
    texts += [texts[0], texts[3] + "  more", "long " * 80, "a b c " * 40, None, "", " \t", "é " * 20 + "x", " ".join(passage[3])]
    return [(i * 7 % 131, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, None), (4, texts[3]), (4, texts[3]), (4, texts[8])]


@pytest.mark.parametrize("least", [30, 20])
def test_against_brute_force(spark, docs_of, least):
    rows = corpus()
    df = docs_of(rows).repartition(3).withColumnRenamed("lang", "removed").withColumnRenamed("source", "h")
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", text_id("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda k: (k[0] is not None, k[0] or 0, hashes[k]))
    lost = brute(order, least)
    got = linededup.line_dedup(df, window_words=least)
    assert got.columns == ["doc_id", "text", "h", "n_chars", "removed_lines", "removed_words", "removed"]
    want = []
    for k in rows:
        w = WORD.findall(k[1] or "")
        want.append((k[0], len(lost[k]), [x for i, x in enumerate(w) if i not in lost[k]]))
    found = got.collect()
    assert sorted(((r.doc_id, r.removed_words, WORD.findall(r.text or "")) for r in found), key=str) == sorted(want, key=str)
    assert sum(r.removed_words > 0 for r in found) > 30
    assert all((r.removed_lines > 0) == (r.removed_words > 0) == bool(r.removed) for r in found)


def test_passage_inside_a_sentence_goes_whole(spark, docs_of):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(55))  # no sentence end at all
    rows = [(i, f"{prose(rng, 12 + i)} {passage} {prose(rng, 9)}") for i in range(6)]
    got = {r.doc_id: r for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 6):
        assert got[i].text == rows[i][1].replace(f" {passage} ", " ") and got[i].removed_words == 55


def test_run_that_stands_earlier_in_a_later_place(spark, docs_of):
    rng = random.Random(4)
    one, two = prose(rng, 35), prose(rng, 20)
    rows = [(1, f"{prose(rng, 5)}\n{one}\n{prose(rng, 5)}"), (2, f"{one}\n{two}\nend of two"), (3, f"start three\n{one}\n{two}\nof three")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(docs_of(rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == f"{two}\nend of two" and got[3] == "start three\nof three"


def test_winnowing_keeps_few_places_and_one_for_each_window():
    rng = np.random.default_rng(3)
    import pyarrow as pa
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (2000, 29, 30, 0, 700)]
    sums, first = passages.word_hashes(*utf8(pa.array(texts)))
    doc, place, key = passages.fingerprints(sums, first, 30)
    assert len(set(place.tolist())) == len(place) < 0.12 * first[-1]
    assert sorted(set(doc.tolist())) == [0, 2, 4]
    for d in (0, 2, 4):
        mine = place[doc == d]
        assert all(((mine >= i) & (mine + 10 <= i + 30)).any() for i in range(first[d], first[d + 1] - 29))


@pytest.mark.parametrize("text,runs,want", [
    ("a b c d e", [(1, 4)], "a e"), ("a\n\nb c d e", [(1, 3)], "a\n\nd e"), ("a b\nc d e f", [(1, 4)], "a b\ne f"),
    ("a b c d\ne f", [(1, 5)], "a\ne f"), (" a b ", [(0, 2)], ""), ("a b c d\ne f g h", [(1, 7)], "a\nh")])
def test_remove(text, runs, want):
    assert passages.remove(text, runs)[0] == want


def plain_remove(text, runs):
    """One text, word by word: what is kept, lines and words lost, and their ranges."""
    spans = [m.span() for m in WORD.finditer(text)]
    gaps = ["", *(text[a[1]:b[0]] for a, b in zip(spans, spans[1:])), ""]
    inside = [any(a <= i < b for a, b in runs) for i in range(len(spans))] + [False]
    line = np.cumsum([i > 0 and ("\n" in g or g[0] == " " and text[spans[i - 1][1] - 1] in ".!?") for i, g in enumerate(gaps[:-1])]).tolist()
    cuts, out, at = [], "", 0
    for a in (i for i in range(len(spans)) if inside[i] and (not i or not inside[i - 1])):
        b = inside.index(False, a)
        if a and "\n" not in gaps[a]:
            a = next((j for j in range(a + 1, min(a + passages.PART_WORDS, b)) if "\n" in gaps[j]), a)
        if b < len(spans) and "\n" not in gaps[b]:
            b = next((j for j in range(b - 1, max(b - passages.PART_WORDS, a), -1) if "\n" in gaps[j]), b)
        cuts.append((a, b))
        if a:
            out += text[at:spans[a - 1][1]]
            if b < len(spans):
                longer = gaps[b] if gaps[b].count("\n") > gaps[a].count("\n") else gaps[a]
                out += "\n" if "\n" in text[spans[a - 1][1]:spans[b][0]] and "\n" not in longer else longer
        at = spans[b][0] if b < len(spans) else len(text)
    lost = {line[i] for a, b in cuts for i in range(a, b)}
    return out + text[at:], len(lost), sum(b - a for a, b in cuts), [(spans[a][0], spans[b - 1][1]) for a, b in cuts]


def test_texts_removed_together_are_as_one_by_one():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choice(["a", "b.", "é", "x!", "日", " ", "\n", "  ", " \n\n", "\t"]) for _ in range(rng.randrange(60))) for _ in range(4)]
        runs = [[sorted(rng.sample(range(n + 1), 2)) for _ in range(rng.randrange(4))] if (n := len(WORD.findall(t))) else [] for t in texts]
        flat = [(d, a, b) for d, r in enumerate(runs) for a, b in r]
        got = passages.remove_all(pa.array(texts), *np.array(flat, np.int64).reshape(-1, 3).T)
        got = zip(got[0].to_pylist(), got[1].tolist(), got[2].tolist(), ([(x["start"], x["end"]) for x in s] for s in got[3].to_pylist()))
        assert list(got) == [plain_remove(t, r) for t, r in zip(texts, runs)]


def test_a_batch_asks_for_a_window_or_fingerprint_once():
    text = prose(random.Random(2), 60)
    at = pa.array([[0, 15, 30]] * 50, pa.list_(pa.int32()))
    none = pa.array([None] * 50, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array([text] * 50), at, none], names=["ord", "_text", "at", "segs"])
    rows = pa.Table.from_batches(passages._windows(30)([batch])).to_pylist()
    asked = [r for r in rows if not r["sure"]]
    assert len(rows) == 50 * 31 and {r["ord"] for r in asked} == {0} and len({r["key"] for r in asked}) == len(asked) == 31
    assert passages._met(np.array([7, 5, 7, 7, 9], np.uint64)).tolist() == [2, 1, 0, 0, 1]


def test_verdicts_do_not_depend_on_batches():
    rng = random.Random(6)
    for _ in range(200):
        rows = sorted((rng.randrange(6), rng.randrange(4), rng.random() < 0.3) for _ in range(rng.randrange(25)))
        key, place, sure = zip(*rows) if rows else ((), (), ())
        met = [rng.choice([0, 2]) if s else 1 for s in sure]
        batch = pa.record_batch([pa.array(key, pa.int64()), pa.array(place, pa.int64()), pa.array(sure, pa.bool_()), pa.array(met, pa.int8()),
                                 pa.array(range(len(rows)), pa.int64())], names=["key", "ord", "sure", "met", "i"])
        cuts = [0, *sorted(rng.randrange(len(rows) + 1) for _ in range(3)), len(rows)]
        parts = [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]
        first = {}
        for k, p, s in rows:
            if not s:
                first.setdefault(k, p)
        later = [i for o in passages._after_first("key", "ord")(iter(parts)) for i in o.column("i").to_pylist()]
        assert later == [i for i, (k, p, s) in enumerate(rows) if s or p != first[k]]
        asked = [k for k, m in zip(key, met) if m]
        again = [i for o in passages._repeats(iter(parts)) for i in o.column("i").to_pylist()]
        assert sorted(again) == [i for i, (k, m) in enumerate(zip(key, met)) if m != 1 or asked.count(k) > 1]
