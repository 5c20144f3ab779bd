import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import linededup, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def cut(text, sentences):
    parts, seps = [], []
    at = 0
    for m in re.finditer(r"\n|(?<=[.!?]) " if sentences else r"\n", text):
        parts.append(text[at:m.start()])
        seps.append(m.group())
        at = m.end()
    return [*parts, text[at:]], seps


def brute(docs, least, sentences):
    """Kept text by (doc_id, text): windows in order of place, each matched with the first equal one."""
    split = {k: cut(k[1] or "", sentences) for k in docs}
    full = {k: [(i, line) for i, line in enumerate(split[k][0]) if WORD.search(line)] for k in docs}
    first, gone = {}, {k: set() for k in docs}
    for k in docs:
        lines, here = [line for _, line in full[k]], {}
        counts = [len(WORD.findall(line)) for line in lines]
        for i in range(len(lines)):
            j = next((j for j in range(i, len(lines)) if sum(counts[i:j + 1]) >= least), None)
            if j is None:
                continue
            window = tuple(lines[i:j + 1])
            at = here.get(window) or first.setdefault(window, (k, i))
            here[window] = (k, i)
            if at == (k, i):
                continue
            other, shift = [line for _, line in full[at[0]]], i - at[1]
            a, b = i, j
            while a > 0 and a - 1 - shift >= 0 and lines[a - 1] == other[a - 1 - shift]:
                a -= 1
            while b + 1 < len(lines) and b + 1 - shift < len(other) and lines[b + 1] == other[b + 1 - shift]:
                b += 1
            gone[k] |= set(range(full[k][a][0], full[k][b][0] + 1))
    out = {}
    for k in docs:
        parts, seps = split[k]
        kept, text = [i for i in range(len(parts)) if i not in gone[k]], ""
        for n, i in enumerate(kept):
            if n:
                between = seps[kept[n - 1]:i]
                text += between[0] if len(between) == 1 else "\n" if "\n" in between else " "
            text += parts[i]
        out[k] = None if k[1] is None else text
    return out


def corpus():
    rng = random.Random(2)
    line = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 4, 9, 15]))) for _ in range(60)]
    passage = line[:6]
    texts = []
    for _ in range(40):
        t = [rng.choice(line) for _ in range(rng.randrange(1, 15))]
        if rng.random() < 0.5:
            at = rng.randrange(len(t))
            t[at:at] = passage[rng.randrange(3):rng.randrange(4, 7)]
        if rng.random() < 0.3:
            t[1:1] = ["", "  "]
        texts.append("\n".join(t))
    prose = ". ".join(" ".join(f"v{rng.randrange(900)}" for _ in range(rng.choice([2, 7, 12]))) for _ in range(9)) + "."
    texts += [f"some words before {prose} And after. More", f"{prose}\nother lines here", f"An end. {prose} Tail! {prose}", ". . .", "a. \n b. c"]
    texts += [texts[0], texts[0] + "\nmore", "\n".join(line[7:20] * 3), None, "", "\n\n", " ".join(["long"] * 60), " ".join(["long"] * 60) + "\nx",
              "\n".join(["same line of words"] * 50), "x\r\n" + " ".join(["é"] * 55)]
    return [(i * 5 % 53, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, None), (4, texts[3]), (4, texts[3])]


@pytest.mark.parametrize("sentences", [True, False])
def test_against_brute_force(spark, docs_of, sentences):
    from quantloom.llm.common import text_id
    rows = corpus()
    df = docs_of(rows).repartition(3).withColumnRenamed("lang", "removed").withColumnRenamed("source", "h")
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", text_id("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda k: (k[0] is not None, k[0] or 0, hashes[k]))
    want = brute(order, 20, sentences)
    got = linededup.line_dedup(df, window_words=20, sentences=sentences)
    assert got.columns == ["doc_id", "text", "h", "n_chars", "removed_lines", "removed_words", "removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(((d, want[d, t]) for d, t in rows), key=str)
    assert got.filter("removed_lines > 0").count() > 10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(-6, 6))
def test_extend(a, b, shift):
    starts = [i for i in range(len(a)) if 0 <= i - shift < len(b) and a[i] == b[i - shift]]
    covered = {i for s, e in linededup.extend(a, b, shift, starts) for i in range(s, e + 1)}
    assert covered == set(starts)


def test_shared_passages_go_and_clean_texts_stay(spark, docs_of, sf):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(18)) for i in range(3))
    rows = [(i, f"own line {i} here\n{passage}\nlast line {i}") for i in range(30)] + [(100 + i, f"clean text {i} stays\nReleased under the MIT License.") for i in range(30)]
    rows += [(200, None), (201, "")]
    got = {r.doc_id: r for r in queries.QUERIES["op5_line_dedup"](spark, sf(documents=docs_of(rows))).collect()}
    assert got[0].removed_lines == 0 and all(got[i].removed_lines == 3 and got[i].removed_words == 54 for i in range(1, 30))
    assert all(got[100 + i].removed_lines == 0 for i in range(30)) and got[200].kept_chars is None
    assert queries.QUERIES["op5_line_dedup"](spark, sf(documents=docs_of([]))).count() == 0
