import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import lengthpack, queries

WORD = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, window):
    """Gaps of the sequences that best-fit, longest first, opens for one piece after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(window - n)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50).flatmap(lambda w: st.tuples(st.just(w), st.lists(st.integers(1, w), max_size=120))))
def test_plan_is_best_fit(case):
    window, lengths = case
    counts = Counter(lengths)
    places, slots = {}, Counter()
    for length, rank, n, sequence, offset in lengthpack.plan(counts, window):
        for i in range(n):
            slots[length, rank + i] += 1
            places.setdefault(sequence + i, []).append((offset, length))
    assert slots == Counter((length, r) for length in counts for r in range(counts[length]))
    gaps = []
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        gaps.append(window - end)
    assert sorted(places) == list(range(len(places))) and sorted(gaps) == best_fit(lengths, window)


def test_plan_depends_on_lengths_not_pieces():
    slots = lengthpack.plan({n: 10**9 + n for n in range(1, 2049)})
    assert len(slots) < 4 * 2048 and sum(n for _, _, n, _, _ in slots) == sum(10**9 + n for n in range(1, 2049))


def test_plan_refuses_too_long():
    with pytest.raises(ValueError):
        lengthpack.plan({5: 1}, 4)


def check(got, rows, window):
    plain = Tokenizer.from_file(WORD)
    want = []
    for d, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), window)):
            want.append((str(d), p, s, len(ids[s:s + window]), zlib.crc32(ids[s:s + window].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gaps = []
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        gaps.append(window - end)
    assert sorted(gaps) == best_fit([w[3] for w in want], window)


ODD = [None, "", " ", "\n", "a", "a\0b c", "a \0b c", "\0", "a\x1cb", "日本語 テスト", "<|endoftext|> hi", "word " * 3000, "x" * 5000]


@pytest.mark.parametrize("window", [64, 2048])
def test_pieces(spark, docs_of, window, monkeypatch):
    monkeypatch.setattr(lengthpack, "CHUNK", 7)
    rows = list(enumerate([*ODD, *("many words here " * (i * 13 % 90) for i in range(200))])) + [(None, "x"), (5, "x"), (5, "x")]
    docs = docs_of(rows).repartition(3).withColumnsRenamed({"lang": "nth", "source": "ids", "n_chars": "part"})
    got = lengthpack.pack_by_length(docs, WORD, window=window).collect()
    check(got, rows, window)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_query(spark, docs_of, sf):
    rows = [(i, "some more words " * (i * 37 % 500)) for i in range(120)] + [(7, None), (None, "b"), (200, "long text " * 300_000)]
    path = sf(documents=docs_of(rows))
    check(queries.QUERIES["op11_length_packing"](spark, path).collect(), rows, 2048)


def test_one_length_alone(spark, docs_of):
    rows = [(i, None) for i in range(5000)]
    check(lengthpack.pack_by_length(docs_of(rows), WORD, with_ids=False).collect(), rows, 2048)


def test_empty_table(spark, docs_of, sf):
    assert queries.QUERIES["op11_length_packing"](spark, sf(documents=docs_of([]))).count() == 0
