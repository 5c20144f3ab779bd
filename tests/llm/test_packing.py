from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest

from quantloom.llm import encode, packing


@pytest.mark.parametrize("rounds", [3000, 1 << 21])
def test_one_short_step_group_a_task(spark, docs_of, rounds):
    docs = docs_of([(i, "many words here " * (i * 13 % 190)) for i in range(300)]).repartition(3)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), round_tokens=rounds, step_tokens=4096).collect()
    groups = {}
    for r in got:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.length
    short = [g >> 32 for g, n in groups.items() if n != 4096]
    assert len(groups) > 20 and len(short) == len(set(short)) <= 3 and max(groups.values()) == 4096


def test_last_groups_mix_tiers():
    steps = packing.Steps(0, 4096)
    full = [steps.of(t, t) for t in (2048, 1024, 512, 256, 128, 64, 32, 1024)]
    assert not any(full)
    assert [[s for _, s in g] for g in steps.rest()] == [[2048, 1024, 1024], [512, 256, 128, 64, 32]]


def test_packing_keeps_fewer_words():
    enc = encode.encoder(public_tokenizers.path("word_bpe_49k.json"), False, 5)
    texts = [f"word{i} other{i % 3}" for i in range(40)]
    want = [w for t in texts for w in encode.encoder(public_tokenizers.path("word_bpe_49k.json"), False).encode([t])]
    assert [w for t in texts for w in enc.encode([t])] == want and len(enc.known) + len(enc.older) <= 2 * (5 + 2)
    assert packing.KEPT_WORDS < encode.KEPT_WORDS


def test_a_packing_task_gives_its_words_memory_back(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "and there"])], names=["doc_id", "text"])
    run = packing._pack(path, False, 1, packing.TIERS, packing.ROUND_TOKENS, packing.STEP_TOKENS)
    assert sum(len(b) for b in run(iter([batch]))) > 1
    enc = encode.encoder(path, False, packing.KEPT_WORDS)
    assert not enc.known and not enc.older
