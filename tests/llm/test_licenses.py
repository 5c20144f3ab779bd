import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import licenses, queries
from quantloom.llm.licenses import EDIT_LENGTH, NOTICES, PHRASES, Scanner

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORDS.findall(lower(text))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def fewest_edits(pattern, text):
    """Edits of the best place of ``pattern`` in ``text``."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (c != p)))
        row = new
        best = min(best, row[-1])
    return best


def test_query(spark, docs_of, sf):
    texts = [None, "", "MIT license, the MIT-LICENSE; mit\n license", "emit license", "Apache  License cc by Gnu General Public License",
             "Relased under the MTT License.", "Released under the\nMIT licence!", "ALL RIGHTS RESERVD", "cc by-sa éMIT license", "x " * 5000 + "CC BY"]
    path = sf(documents=docs_of([*enumerate(texts), (None, "mit license"), (3, "cc by"), (3, "cc by")]).withColumnRenamed("lang", "labels"))
    got = queries.QUERIES["op4_license_scan"](spark, path).collect()
    assert len(got) == len(texts) + 3
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 3}
    for i, t in enumerate(texts):
        if i != 3:
            r = by[i]
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
    assert by[5].labels == "mit" and 0.9 < by[5].score < 1 and by[6].labels == "mit" and by[7].labels == "reserved"
    assert by[2].score == 1.0 and by[0].score == 0.0 and by[0].labels == ""
    assert queries.QUERIES["op4_license_scan"](spark, sf(documents=docs_of([]))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(sorted(NOTICES)), st.lists(st.tuples(st.integers(0, 200), st.sampled_from("dsi"), st.sampled_from("ae xz")), max_size=6), st.integers(0, 2))
def test_seeds_lose_no_notice(notice, edits, spare):
    text = list(notice)
    for at, kind, c in edits:
        at %= len(text)
        text[at:at + (kind != "i")] = [] if kind == "d" else [c]
    text = "some words before " * spare + "".join(text) + " and after"
    scanner = Scanner({}, {notice: NOTICES[notice]}, EDIT_LENGTH)
    spans, best = scanner.spans(text), fewest_edits(notice, text)
    assert bool(spans) == (best <= len(notice) // EDIT_LENGTH)
    for _, _, start, end, n in spans:
        assert best <= n <= len(notice) // EDIT_LENGTH and fewest_edits(notice, text[start:end]) <= n


def test_nearest_notice_wins():
    scanner = Scanner(licenses.PHRASES, licenses.NOTICES, EDIT_LENGTH)
    assert [s[0] for s in scanner.spans("x released under the mit license. y")] == ["mit"]
