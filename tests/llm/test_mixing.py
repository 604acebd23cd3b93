"""Budgets and prefixes against a plain, sorted computation."""

import math
import random
from collections import defaultdict
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import functions as F

from quillon.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, epoch int"
PLAN = mixing.Plan(domains={"a": 3, "b": 1}, languages={"en": 2, "de": 1}, sources={"s0": 1, "s1": 2, "s2": 1}, domain_of={"s0": "a", "s1": "a", "s2": "b"}, share=0.7, max_epochs=2, seed=5)


def test_shortages_go_to_siblings_first():
    available = {("a", "en", "s0"): 10, ("a", "en", "s1"): 1000, ("a", "de", "s0"): 1000, ("b", "en", "s2"): 1000}
    got = mixing.budgets(available, replace(PLAN, tokens=800, max_epochs=1))
    # a: 600, b: 200; within a: en 400, de 200; within en: s0 is full at 10, s1 takes the rest of en's 400.
    assert got == {("a", "en", "s0"): 10, ("a", "en", "s1"): 390, ("a", "de", "s0"): 200, ("b", "en", "s2"): 200}
    got = mixing.budgets({("a", "en", "s0"): 10, ("b", "en", "s2"): 1000}, replace(PLAN, tokens=800, max_epochs=1))
    assert got == {("a", "en", "s0"): 10, ("b", "en", "s2"): 790}  # all of a is full: the ancestor's other branch
    assert sum(mixing.split_budget(100, [("x", 1, 1000), ("y", 1, 1000), ("z", 1, 1000)]).values()) == 100
    assert mixing.split_budget(10, [("x", 0, 100), ("y", 1, 4)]) == {"x": 0, "y": 4}


def rows_for(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "s1" if rng.random() < 0.4 else rng.choice(["s0", "s2", "odd", None])
        rows.append((i, rng.choice([None, "", "x" * rng.randrange(1, 400)]) if rng.random() < 0.1 else "é" * rng.randrange(1, 300), rng.choice(["en", "en", "de", "xx", None]), source, "clash", 9))
    return [*rows, rows[5], rows[5], (None, "no id", "en", "s0", None, None)]


def test_against_sorted_prefixes(spark):
    for plan in (PLAN, replace(PLAN, share=1.8), replace(PLAN, share=1.0, max_epochs=1)):
        docs = spark.createDataFrame(rows_for(600), SCHEMA)
        got = mixing.mix(docs, plan).collect()
        leaf = lambda r: (plan.domain_of.get(r.source, "*"), r.lang if r.lang in plan.languages else "*", r.source if r.source in plan.sources else "*")
        by_leaf = defaultdict(list)
        for r in docs.select("doc_id", "lang", "source", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), *(F.xxhash64(F.lit(plan.seed), F.lit(e), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias(f"h{e}") for e in range(3))).collect():
            by_leaf[leaf(r)].append((math.ceil(len((r.text or "").encode()) / 4), r))
        share = mixing.budgets({p: sum(n for n, _ in rows) for p, rows in by_leaf.items()}, plan)
        total = sum(n for rows in by_leaf.values() for n, _ in rows)
        assert sum(share.values()) == min(int(Fraction(plan.share) * total), total * plan.max_epochs)
        want = defaultdict(int)
        for path, rows in by_leaf.items():
            whole = sum(n for n, _ in rows)
            full, rest = divmod(share[path], whole) if whole else (0, 0)
            for n, r in rows:
                for e in range(full):
                    want[r.doc_id, path, e, n] += 1
            at, ended = 0, None
            for n, r in sorted(rows, key=lambda x: (x[1][f"h{full}"], x[1].t)):
                place = (r[f"h{full}"], r.t)
                if n and (at < rest or place == ended):
                    want[r.doc_id, path, full, n] += 1
                    at, ended = at + n, place
        have = defaultdict(int)
        for r in got:
            have[r.doc_id, (r.domain, r.language, r.source), r.epoch, r.tokens] += 1
        assert have == want
        taken = defaultdict(int)
        for r in got:
            taken[r.domain, r.language, r.source] += r.taken
        assert all(0 <= taken[p] - share[p] <= 3 * 300 if p in taken else share[p] == 0 for p in by_leaf)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), PLAN).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA), PLAN).count() == 0


def test_copies_at_the_end_of_a_budget_fill_it(spark):
    for lang in ("en", "de"):  # all copies alike, or told apart by their language alone (both pooled in one leaf)
        rows = [(None, "x" * 40, "zz" if lang == "de" and i % 2 else "xx", "s0", None, None) for i in range(90)]
        rows += [(i, "y" * 20, "xx", "s0", None, None) for i in range(4)]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for tokens in (13, 307, 455, 911, 920, 1300):
            got = mixing.mix(docs, replace(PLAN, tokens=tokens)).collect()
            assert sum(r.taken for r in got) == tokens
            assert all(0 < r.taken <= r.tokens for r in got) and sum(r.taken < r.tokens for r in got) <= 1
            assert len(got) <= -(-tokens // 10) + 4
    kept = mixing.select_rows(docs, replace(PLAN, tokens=300))
    assert kept.columns == docs.columns and kept.count() == len(mixing.mix(docs, replace(PLAN, tokens=300)).collect())


def test_long_texts_and_any_column_names(spark):
    rows = [(i, "x" * (400000 if i == 3 else 40), "en", "s0", {"k": str(i)}, 1, "a") for i in range(8)]
    rows += [(None, "y" * 40, "en", "s0", {"k": "1"}, 1, "a")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, c0 map<string,string>, _full int, _leaf string")
    for tokens in (35, 100_050, 100_160, 200_000):
        kept = mixing.select_rows(docs, replace(PLAN, tokens=tokens))
        assert kept.columns == docs.columns
        assert kept.count() == mixing.mix(docs, replace(PLAN, tokens=tokens)).count()
    assert mixing.select_rows(docs, replace(PLAN, tokens=50), tokens=F.length("text").cast("long")).count() in (1, 2)


def test_the_deepest_weights_count():
    available = {(d, "en", s): 10**6 for s, d in mixing.PRODUCTION.domain_of.items()}
    got = mixing.budgets(available, replace(mixing.PRODUCTION, tokens=10**6))
    weights = mixing.PRODUCTION.sources
    for (d, _, s), n in got.items():
        within = sum(w for x, w in weights.items() if mixing.PRODUCTION.domain_of[x] == d)
        assert abs(n - 10**6 * mixing.PRODUCTION.domains[d] * weights[s] / within) < 2
