"""Near-duplicates by fingerprint, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash

SCHEMA = "doc_id long, text string, fp string, key int"


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÀB", "naïve"]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            texts.append("\t".join(other))
    texts += [None, "", " \n", "One", "ONE", "one two", "a b c d", "x " * 20000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints)


@pytest.mark.parametrize(("fine", "chunk"), [(simhash.FINE, simhash.CHUNK), (100, simhash.CHUNK), (10**9, 50), (100, 30)])
def test_dense_group_is_linked_whole(spark, monkeypatch, fine, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    centre = 0x9F3B_77A1_0C5D_E284
    prints = {centre}
    while len(prints) < 1500:  # well over two chunks
        bits = rng.choice(64, size=int(rng.integers(1, 7)), replace=False)
        prints.add(centre ^ sum(1 << int(b) for b in bits))
    prints |= {int(x) for x in rng.integers(0, 2**63, size=300)}
    values = sorted(prints)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in values]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.links(frame, fine).cache()
    edges = found.where("n = 0").select("u", "v")
    assert edges.count() < 20 * len(values)
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    want = plain_components(values)
    groups = {}
    for p, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)
    x = np.array(values, dtype=np.uint64)
    degree = (np.bitwise_count(x[:, None] ^ x[None, :]) <= 3).sum(axis=1) - 1
    have = {r.u: r.n for r in found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n")).collect()}
    assert [have.get(p, 0) for p in signed] == degree.tolist()


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d", None, None), (7, "a b c d", None, None), (7, "a b c d", None, None), (None, None, None, None)]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    same = f"{plain_fingerprint('a b c d'):016x}"
    assert got == sorted([("None", same, "7"), ("7", same, "7"), ("7", same, "7"), ("None", "0" * 16, "None")])
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.max("component_id")).first()[0] == 1


def test_links_of_a_chain(spark):
    chain = np.array([0, 0b111, 0b111111], dtype=np.uint64)  # three bits from one to the next, six between the ends
    found = [simhash.links_within(chain, None, k) for k in range(8)]
    assert sorted((int(x), int(y)) for a, b in found for x, y in zip(a, b, strict=True)) == [(0, 1), (1, 2)]  # each by one posting
    assert simhash._stars(3, np.array([0, 1]), np.array([1, 2])).tolist() == [0, 0, 0]
    frame = spark.createDataFrame([(1, "a b c d", "", 1)], SCHEMA)
    assert simhash.near_duplicates(frame).columns == ["doc_id", "fingerprint", "component_id", "n_links"]


def test_count_filter_keeps_what_it_must():
    rng = np.random.default_rng(1)
    for _ in range(3000):  # a pair within three bits is retained by one posting of each kind, and shares five bytes
        bits = rng.choice(64, size=int(rng.integers(1, 4)), replace=False)
        mask = 255 & ~sum(1 << i for i in {int(b) // 8 for b in bits})
        assert simhash.RETAINED[:8, mask].sum() == simhash.RETAINED[8:, mask].sum() == 1
        k = int(np.flatnonzero(simhash.RETAINED[:8, mask])[0])
        assert simhash.RETAINED[8 + 10 * k : 18 + 10 * k, mask].sum() == 1
    assert not simhash.RETAINED[:, [m for m in range(256) if m.bit_count() < 5]].any()


def test_keep_one_settles_copies_and_any_column_names(spark):
    rows = [(1, "a b c d", "x", 1, {"k": "v"}), (2, "a b c d", "x", 1, {"k": "v"}), (1, "a b c d", "x", 1, {"k": "w"}), (3, None, None, None, None), (None, "", None, None, None), (4, "z " * 30000, None, None, {}), (4, "z " * 30000, None, None, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string, row int, c0 map<string,string>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert simhash.keep_one(docs.limit(0)).count() == 0
