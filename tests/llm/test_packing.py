"""Pieces cover every document's ids once, sequences are gapless, windows are full."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing

SCHEMA = "doc_id long, text string, start string, tier int"


def fixture():
    rng = random.Random(4)
    words = ["the", "Thndou", "été", "naïve,", "日本", "don't", "<|endoftext|>", "a\nb", "  ", "\t", "\n\n", "x  y", "1234", "###", " ", "\x1c", " x"]
    texts = [None, "", " ", "\n", " x", "x ", "a  b   c", "a \n b", "word " * 5000, "z" * 3000]
    for _ in range(150):
        texts.append(rng.choice([" ", "", "\n"]).join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.choice([1, 5, 60, 400, 1500]))))
    return texts


def test_ids_equal_the_tokenizer():
    path = public_tokenizers.path(packing.TOKENIZER)
    plain, fast = Tokenizer.from_file(path), packing.Encoder(path)
    for text in [t or "" for t in fixture()] * 2:
        assert np.frombuffer(fast(text), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_round_trip(spark):
    texts = fixture()
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    pieces = packing.pack_documents(rows).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_sequence, steps = defaultdict(list), defaultdict(list), defaultdict(dict)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        steps[p.step_group][p.sequence_id] = p.tier
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CONTEXT and at & (at - 1) == 0 and at == sequence[0].tier
    assert all(sum(s.values()) <= packing.STEP_TOKENS + packing.CONTEXT for s in steps.values())


def test_step_groups_are_balanced(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 8192)
    rng = random.Random(9)
    texts = ["word " * rng.choice([3, 40, 200, 700, 1500, 5000]) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA).repartition(7)
    sequences = {(p.sequence_id, p.tier, p.step_group) for p in packing.pack_documents(rows).collect()}
    assert len(sequences) == len({s for s, *_ in sequences})  # a sequence is in one group
    groups = defaultdict(lambda: defaultdict(int))
    for _, tier, group in sequences:
        groups[max(tier, packing.TIERS[-1] // 2)][group] += tier
    for kind, totals in groups.items():
        assert max(totals.values()) - min(totals.values()) <= kind
        assert len(totals) == -(-sum(totals.values()) // packing.STEP_TOKENS)


def test_small_pools_and_empty(spark, monkeypatch):
    path = public_tokenizers.path(packing.TOKENIZER)
    monkeypatch.setattr(packing, "POOL_TOKENS", 3000)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["word " * (7 * i) for i in range(60)])], names=["doc_id", "text"])
    got = [r for b in packing._packed(iter([batch]), packing.encoder(path), 0) for r in b.to_pylist()]
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
