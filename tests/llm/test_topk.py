"""Top-k against the plain product of all pairs."""

import math
import random

import numpy as np

from quillon.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every=50, k=5):
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, w) in enumerate(sound):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, x, strict=False)), i) for m, (i, x) in enumerate(sound) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 150)
    monkeypatch.setattr(topk, "GROUP", 4)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(700)]
    rows += [(i + 700, list(rows[50][1])) for i in range(60)]  # ties
    rows += [(50, list(rows[50][1])), (100, [0.0] * 12), (None, [1.0] * 12), (1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (1200, []), (1250, [0.5] * 3)]
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame).collect())
    assert got == plain(rows)


def test_few_rows_and_empty(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (1, [-1.0, 0.5], 1, "")], SCHEMA)
    assert [tuple(r) for r in topk.search(one).collect()] == [(0, 1, 1, 0)]
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_opens_fewer_blocks():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 200, (16, 32)).round()
    vectors = np.repeat(centres, 128, axis=0) + rng.integers(-3, 4, (2048, 32))
    ids = np.arange(2048)
    q, i, s, opened = topk.best(ids, vectors, ids[:10], vectors[:10])
    assert opened < 10 * 32 / 4
    for k in range(10):
        scores = vectors @ vectors[k]
        scores[k] = -(10**9)
        want = np.lexsort((ids, -scores))[:5]
        assert i[q == k].tolist() == want.tolist() and s[q == k].tolist() == scores[want].astype(int).tolist()


def test_blocks_are_ranges_of_like_rows():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1000, 6)) * [10, 1, 1, 1, 1, 1]
    order = topk.like_order(x, 64)
    assert sorted(order.tolist()) == list(range(1000))
    spread = lambda rows: np.mean([np.ptp(x[rows[at : at + 64], 0]) for at in range(0, 1000, 64)])
    assert spread(order) < spread(np.arange(1000)) / 4
    same = topk.like_order(np.ones((200, 3)), 64)
    assert sorted(same.tolist()) == list(range(200))


def test_clusters_spare_queries_from_far_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 100)
    monkeypatch.setattr(topk, "GROUP", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    vectors = centres[rng.integers(0, 8, 1200)] + rng.normal(size=(1200, 16)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame).collect())
    assert got == plain(rows)


def test_large_components_are_exact():
    big = np.array([[2.0**40, 3.0], [2.0**40, 4.0]])
    q, i, s, _ = topk.best(np.array([1, 2]), big, np.array([50]), np.array([[2.0**20, 1.0]]))
    assert s.tolist() == [2**60 + 4, 2**60 + 3]


def test_every_row_of_a_repeated_id_counts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "SEGMENT", 150)
    monkeypatch.setattr(topk, "GROUP", 40)
    rng = random.Random(11)
    ids = [*range(200), *[7] * 100, *[50] * 60]  # hot ids with different vectors, one that is asked
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in ids]
    rows += [rows[100], rows[100], rows[0], (None, [1.0] * 8), (50, None)]  # exact copies; rows that take no part
    spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.block_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == plain(rows)
    clashing = spark.read.parquet(f"{tmp_path}/embeddings.parquet").selectExpr("vec_id", "embedding", "1 row", "2 part", "3 cluster", "4 v", "5 group", "6 `floor`", "7 query_row")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(clashing).collect()) == plain(rows)
