import os
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import encode, packing, queries, tokens
from quantloom.llm.eliasfano import EliasFano
from quantloom.llm.encode import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "a \0b c", "\0", " \0\0 \n\0a", "", " ", "\n", "a", "a  b\n\nc ", "\nx", "a\tb c\n d", "x \xa0y", "a\x1cb c", "<|endoftext|> hi", " z\r\nw",
       "don't we're  '  's\n\n x", "é́ Ⅷ ½ ΣΑΣ İx", "日本語 テスト", "word " * 3000, "x" * 5000]


@cache
def both(path, spaces):
    return Tokenizer.from_file(path), Encoder(path, spaces)


def ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab Zé'\0\n\t\r\x1c\x85\xa0 !1.s<|>"), max_size=30), max_size=5))
def test_words_give_the_tokenizers_ids(path, spaces, texts):
    plain, enc = both(path, spaces)
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_any_character_gives_the_tokenizers_ids(path, spaces):
    rng, (plain, enc) = np.random.default_rng(11), both(path, spaces)
    every = [chr(c) for c in rng.permutation(1 << 16) if not 0xD800 <= c < 0xE000]
    texts = ["".join(c + "ab ."[rng.integers(4)] * rng.integers(3) for c in every[i:i + 8]) for i in range(0, len(every), 8)]
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    ef = EliasFano.frombytes(EliasFano.encode(values).tobytes())
    assert ef.decode().tolist() == values.tolist()
    assert [ef[i] for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(100_000, 300))
    assert len(EliasFano.encode(ends).tobytes()) * 8 < 100_000 * (2 + np.log2(300) + 1.2)


def test_token_files(spark, docs_of, sf, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_TOKENS", 200)
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD)] + [(3, "same id"), (3, "same id"), (None, "no id"), (None, None)]
    path = sf(documents=docs_of(rows))
    got = queries.QUERIES["op2_token_files"](spark, path).collect()
    plain, start = Tokenizer.from_file(BYTE), 0
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is None, d))
    want = sorted((d is None, d, zlib.crc32(np.array(x, "<u4").tobytes()), len(x))
                  for d, x in ((d, ids(plain, t, 0)) for d, t in rows))
    assert sorted((r.doc_id is None, r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_token_block_lookup(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text number {i} " * (i % 5)) for i in range(50)])
    tokens.write_tokens(docs.withColumnRenamed("source", "ids"), f"{tmp_path}/t", BYTE)
    plain = Tokenizer.from_file(BYTE)
    for block in spark.read.parquet(f"{tmp_path}/t").collect():
        for i, d in enumerate(block.doc_ids):
            assert tokens.lookup(block.asDict(), i)[1].tolist() == ids(plain, f"text number {d} " * (d % 5), 0)


@pytest.mark.parametrize("rounds", [100, 1 << 21])
def test_packing(spark, docs_of, rounds):
    rows = list(enumerate([*ODD, *("many words here " * (i * 13 % 90) for i in range(60))])) + [(None, "x"), (5, "x"), (5, "x")]
    docs = docs_of(rows).repartition(3).withColumnRenamed("lang", "tier").withColumnRenamed("source", "ids")
    got = packing.pack(docs, WORD, round_tokens=rounds).collect()
    plain = Tokenizer.from_file(WORD)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert total <= 2048 and total & (total - 1) == 0 and {p.tier for p in pieces} == {total}
    groups = {}
    for s, pieces in by_sequence.items():
        groups.setdefault(pieces[0].step_group, []).append(sum(p.length for p in pieces))
    assert all(sum(g) <= packing.STEP_TOKENS for g in groups.values())
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(ids(plain, t, 1))
    for d, lists in texts.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, lists))
        assert {r.doc_tokens for r in mine} == set(map(len, lists))
        if len(lists) == 1:
            assert [r.start for r in mine] == [sum(q.length for q in mine[:i]) for i in range(len(mine))]
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == lists[0]


def test_empty_tables(spark, docs_of, sf):
    path = sf(documents=docs_of([]))
    assert queries.QUERIES["op2_token_files"](spark, path).count() == 0
    assert queries.QUERIES["op10_packing"](spark, path).count() == 0


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_words_of_letters_go_to_the_model_alone(path, spaces, monkeypatch):
    enc, plain = Encoder(path, spaces), Tokenizer.from_file(path)
    marks = enc.encode(["a. b,"])  # full stops and commas are known from now on
    asked = []
    monkeypatch.setattr(enc, "_raw_words", lambda words, f=enc._raw_words: asked.extend(words) or f(words))
    text = "Straße ªb µ º ÀÉÎÕÜ àéîõü ÿ the Words\nagain, ill re ve. we ll d s"
    got = [np.frombuffer(x, enc.dtype).tolist() for x in [*marks, *enc.encode([text, f"x\n{text}"])]]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in ("a. b,", text, f"x\n{text}")]
    assert not asked
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"  # no threads beside a task's own


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_a_slice_asks_once_for_each_word(path, spaces):
    asked = []

    class Counted(encode._Memory):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    enc, plain = Encoder(path, spaces), Tokenizer.from_file(path)
    enc.known = Counted({})
    texts = ["one two three " * 50 + "end", "one two\nthree", "three two one"]
    got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) <= 8


@pytest.mark.parametrize("path,spaces", [(BYTE, True), (WORD, False)])
def test_forgotten_words_are_learned_again(path, spaces):
    enc, plain = Encoder(path, spaces, 3), Tokenizer.from_file(path)
    for text in ["one two three four", "one five six seven", "", "eight  nine\n\nten", "one \tétè two", "two eight #x five"] * 3:
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
