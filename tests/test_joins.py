"""Joins that look at few pairs, against all pairs."""

import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from quillon.functions.embedding import hashed_ngrams
from quillon.functions.units import rounded
from quillon.operators import planning, relations, similarity, templates


def test_near_boxes_meet_in_cells(spark):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b"):
        for i in range(150):
            size = [rng.choice([0.01, 0.5, 3.0, 3.0, 10.0, 40.0]) * rng.uniform(0.2, 1) for _ in range(3)]
            at = [rng.uniform(-400, 400) for _ in range(3)] if i > 20 else [rng.uniform(-5, 5) for _ in range(3)]
            if i % 10 == 1:
                at = [round(x) for x in at]
                size = [2.0, 2.0, 2.0]
            rows.append((g, i, {"lo": [float(x) for x in at], "hi": [float(x + s) for x, s in zip(at, size, strict=True)]}))
    rows.append(("a", 900, {"lo": [float("nan")] * 3, "hi": [1.0] * 3}))
    points = spark.createDataFrame(rows, "scene string, object_id int, box struct<lo array<double>, hi array<double>>").where("object_id < 900 or scene = 'a'")
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    sound = points.where("object_id < 900")
    want = told(relations.links(sound, ["scene"]).where(F.col("predicate").isin(*relations.LOCAL)))
    assert told(relations.links(points, ["scene"], wanted=relations.LOCAL)) == want and len(want) > 200
    assert relations.near_candidates(sound, ["scene"]).count() < 0.25 * 150 * 149  # of both groups' pairs
    whole = relations.links(sound.where("scene = 'a'").drop("scene"), [], wanted=["near"])
    assert whole.count() == sum("'a', 'near'" in w for w in want)
    assert relations.links(points.limit(0), ["scene"], wanted=["near"]).count() == 0


def test_full_cells_are_dealt_and_small_groups_paired(spark, monkeypatch):
    """A thousand boxes in one cell are not met in one task, groups of a few boxes are not laid out in cells at all."""
    rng = random.Random(7)
    at = lambda: [rng.uniform(0, 40) for _ in range(3)]
    rows = [(g, i, {"lo": p, "hi": [x + rng.choice([0.5, 6.0]) for x in p]}) for g, n in (("full", 300), ("few", 9)) for i in range(n) for p in [at()]]
    points = spark.createDataFrame(rows, "scene string, object_id int, box struct<lo array<double>, hi array<double>>")
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = told(relations.links(points, ["scene"]).where(F.col("predicate").isin(*relations.LOCAL)))
    monkeypatch.setattr(relations, "FULL", 16)
    assert told(relations.links(points, ["scene"], wanted=relations.LOCAL)) == want
    cells, grid = [], relations._in_cells
    monkeypatch.setattr(relations, "_in_cells", lambda levelled, *a: cells.append(levelled) or grid(levelled, *a))
    assert relations.near_candidates(points, ["scene"]).where("scene = 'few'").count() == 36 and cells[0].select("scene").distinct().collect() == [("full",)]
    assert relations.between_links(points.where("scene = 'few'"), ["scene"]).count() == sum(1 for r in _triples([r for r in rows if r[0] == "few"]))


def test_conditions_of_pairs_hold_no_predicates(spark):
    """Candidates are compared by their distance alone; what else a pair is, is worked out for those that are near enough."""
    points = spark.createDataFrame([(i, {"lo": [float(i)] * 3, "hi": [i + 1.0] * 3}) for i in range(9)], "object_id int, box struct<lo array<double>, hi array<double>>")
    plan = relations.links(points, [], wanted=relations.LOCAL)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line and "_part" in line]
    assert joins and not any("around" in line or "size(" in line or "CASE" in line for line in joins)


def test_rounding_without_decimals_is_the_same(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, -1e-9, 0.5e-6, 1.5e-6, 2.5e-6, 1.0000005, 123.4567895, 1e6, 1e12 + 0.1, float("nan"), float("inf"), None, *(rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-8, 14) for _ in range(3000)), *((n / 4) ** 0.5 for n in range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("a"), rounded(F.col("x"), 6).alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]


def _triples(rows):
    """(source, target, third) by the rule's words."""
    gap = lambda a, b: sum(max(0.0, a["lo"][k] - b["hi"][k], b["lo"][k] - a["hi"][k]) ** 2 for k in range(3)) ** 0.5
    longest = lambda b: max(b["hi"][k] - b["lo"][k] for k in range(3))
    near = lambda a, b: gap(a, b) <= (longest(a) + longest(b)) / 2 * 3.0
    centre = lambda b, k: (b["lo"][k] + b["hi"][k]) / 2
    for (_, i, a), (_, j, b), (_, k, c) in product(rows, rows, rows):
        if i not in (j, k) and j < k and near(a, b) and near(a, c):
            if any(abs(centre(b, x) - centre(c, x)) > 2 and min(centre(b, x), centre(c, x)) - 2 <= centre(a, x) <= max(centre(b, x), centre(c, x)) + 2 for x in range(3)):
                yield i, j, k


def test_terms_of_a_link_are_the_first_in_order(spark):
    points = spark.createDataFrame([("s", "a", "t", ["c%d" % i for i in range(6)]), ("s", "b", None, ["d%d" % i for i in range(4)])], "scene string, object_id string, template string, categories array<string>")
    found = spark.createDataFrame([("s", "on", "a", "b"), ("s", "near", "b", "b")], "scene string, predicate string, source string, target string")
    got = {}
    for r in relations.link_terms(points, found, ["scene"], most=25).collect():
        got.setdefault(r.predicate, []).append(r.term)
    whole = sorted(f"spatial:on({a},{b})" for a in ("a", "t", *(f"c{i}" for i in range(6))) for b in ("b", *(f"d{i}" for i in range(4))))
    assert sorted(got["on"]) == whole[:25] and len(got["near"]) == 25
    assert "Window" not in relations.link_terms(points, found, ["scene"])._jdf.queryExecution().optimizedPlan().toString()


def test_combined_plans_are_the_best_of_the_product(spark):
    rng = random.Random(6)
    rows = [(q, t, f"p{i}", float(rng.randrange(4))) for q in ("x", "y", "z") for t in range(1, {"x": 5, "y": 2, "z": 4}[q]) for i in range(rng.choice([1, 2, 6]))]
    got = {}
    for r in planning.combined(spark.createDataFrame(rows, "query_id string, target int, plan_id string, score double"), most=7, each=3).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.score, r.plan_ids)
    for q in ("x", "y", "z"):
        lists = [sorted((-s, p) for a, b, p, s in rows if (a, b) == (q, t))[:3] for t in sorted({b for a, b, *_ in rows if a == q})]
        best = sorted((sum(s for s, _ in combo), [p for _, p in combo]) for combo in product(*lists))[:7]
        assert [got[q][k + 1] for k in range(len(best))] == [(-s, p) for s, p in best] and len(got[q]) == len(best)
    steps = spark.createDataFrame([("p0", 0, "a"), ("p0", 1, "b"), ("p1", 0, "b"), ("p1", 1, "c")], "plan_id string, step int, action_id string")
    chosen = spark.createDataFrame([("q", 1, 1.0, ["p1", "p0"])], "query_id string, place int, score double, plan_ids array<string>")
    assert [r.action_id for r in planning.combined_steps(chosen, steps).orderBy("step").collect()] == ["b", "c", "a"]


def test_sparse_join_of_terms_equals_all_pairs(spark):
    rng = random.Random(8)
    stems = ["open", "opening", "opened", "close", "closing", "red paint", "paint red", "reddish", "bottle", "bottles", "glass bottle", "lid", "lids", "wooden table", "table", "tables"]
    words = sorted({s + rng.choice(["", "s", " top", "ed", "x", " of glass"]) for s in stems for _ in range(8)} | {"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))) for _ in range(200)})
    embed = hashed_ngrams()
    terms = spark.createDataFrame([(w,) for w in words], "term string").select("term", embed(F.col("term")).alias("vec"))
    queries = spark.createDataFrame([(w,) for w in [*words[::7], "opener", "tabel", ""]], "query string").select("query", embed(F.col("query")).alias("vec"))
    got = {(r.query, r.term): r.sim for r in similarity.similar_terms(queries, terms).collect()}
    want = {(r.query, r.term): r.sim for r in similarity.similar_in_cells(queries, terms).collect()}
    assert got.keys() == want.keys() and len(want) > 60 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    met = similarity.sparse_candidates(queries, terms).count()
    assert met < 0.1 * queries.count() * terms.count(), met
    assert similarity.similar_terms(queries, terms.limit(0)).count() == 0 == similarity.similar_terms(queries.limit(0), terms).count()


def test_sparse_join_with_negative_components(spark):
    rng = np.random.default_rng(2)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    base = rng.normal(size=(6, 12)) * (rng.random((6, 12)) < 0.4) + np.eye(12)[:6]
    terms = spark.createDataFrame([(f"t{i}", unit(base[i % 6] + rng.normal(size=12) * 0.1)) for i in range(60)], "term string, vec array<double>")
    queries = spark.createDataFrame([(f"q{i}", unit(base[i])) for i in range(6)], "query string, vec array<double>")
    told = lambda df: {(r.query, r.term) for r in df.collect()}
    assert told(similarity.similar_terms(queries, terms, 0.8)) == told(similarity.similar_in_cells(queries, terms, 0.8))


def test_bounded_template_match_equals_the_cross_join(spark):
    rng = random.Random(12)
    words = ["red", "blue", "steel", "small", "ring", "rings", "widget", "cap", "lid"]
    documents = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for i in range(120)], "id int, text string")
    names = spark.createDataFrame([("red ring",), ("steel lid",), ("unknown thing",), ("blue",)], "name string")
    whole = {}
    for r in templates.blended(names, documents).where("score >= 0.75").orderBy(F.desc(F.round("score", 9)), "id").collect():
        whole.setdefault(r.name, (r.id, round(r.score, 9)))
    assert {r.name: (r.id, round(r.score, 9)) for r in templates.best_template(names, documents, 0.75).collect()} == whole and len(whole) >= 2
