import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a\n\nb", "Hello  wörld\n\tx ﬁ ① é 日本 a  ", "▁a ▁▁", "the the the", "x" * 300, " lead", "😀 \0 \x7f ☃", "word " * 2000]


def plain(m, text):
    """The best segmentation of the whole marked text, without words or sharing."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [-math.inf] * len(t), [0] * (len(t) + 1)
    for end in range(1, len(t) + 1):
        for start in range(max(0, end - 16), end):
            found = m.ids.get(t[start:end])
            score = found[0] if found else m.byte_score if end - start == 1 else -math.inf
            if best[start] + score > best[end] + 1e-9:
                best[end], back[end] = best[start] + score, start
    out, end = [], len(t)
    while end:
        piece = t[back[end]:end]
        out = ([m.ids[piece][1]] if piece in m.ids else [m.byte_ids[b] for b in piece.encode()]) + out
        end = back[end]
    return best[-1], out


def total(m, ids):
    by_id = {i: s for s, i in m.ids.values()}
    return sum(by_id[i] for i in ids if i in by_id)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abethnou ▁\n.,1é日☃"), max_size=25), max_size=5))
def test_search_is_optimal(texts):
    m = pieces.model(PATH)
    for t, raw in zip(texts, m.encode(texts)):
        ids = np.frombuffer(raw, m.dtype).tolist()
        _, want = plain(m, t)
        assert sum(i in m.byte_ids.values() for i in ids) == sum(i in m.byte_ids.values() for i in want)
        assert total(m, ids) == pytest.approx(total(m, want))
        assert m.decode(np.array(ids, np.int64)) == t.replace("▁", " ")


def test_query(spark, docs_of, sf):
    m = pieces.model(PATH)
    rows = [*enumerate(ODD), (None, "no id"), (1, "twice"), (1, "twice")]
    path = sf(documents=docs_of(rows).repartition(3).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded"))
    got = sorted(map(tuple, queries.QUERIES["op7_sentencepiece"](spark, path).collect()), key=str)
    want = []
    for d, t in rows:
        ids = np.frombuffer(m.encode([t or ""])[0], m.dtype).astype("<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes()), len(t or ""), True))
    assert got == sorted(want, key=str)
    assert queries.QUERIES["op7_sentencepiece"](spark, sf(documents=docs_of([]))).count() == 0
