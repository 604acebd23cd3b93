"""Hierarchies and plans of any depth."""

import random

from pyspark.sql import functions as F

from quillon.operators import flatten, geometry, hierarchy, planning, timeline


def test_thousand_deep_in_ten_rounds(spark, monkeypatch):
    rounds, met = [], hierarchy._met
    monkeypatch.setattr(hierarchy, "_met", lambda *a: rounds.append(1) or met(*a))
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(1001)] + [("c0", "c2"), ("c1", "c0"), ("c2", "c1"), ("hung", "c1"), ("self", "self"), ("stray", "unknown")]
    found = {r.id: r for r in hierarchy.rooted(spark.createDataFrame(rows, "id string, parent string"), [], "id", "parent", {"path": (F.col("id"), lambda a, b: F.concat_ws(".", a, b))}).collect()}
    assert len(rounds) <= 3 + 11 and len(found) == len(rows)
    assert all(found[f"n{i}"].depth == i and found[f"n{i}"].root == "n0" for i in range(1001))
    assert found["n1000"].path == ".".join(f"n{i}" for i in range(1001))
    assert {k for k, r in found.items() if r.depth is None} == {"c0", "c1", "c2", "hung", "self"} and found["stray"].depth == 0


def test_ways_around_a_cycle_go_no_further(spark, monkeypatch):
    """A cycle of four beside five thousand single nodes: ways grow with the cycle, not with the number of nodes."""
    rounds, met = [], hierarchy._met
    monkeypatch.setattr(hierarchy, "_met", lambda *a: rounds.append(1) or met(*a))
    rows = [(i, (i + 1) % 4) for i in range(4)] + [(10 + i, 9 + i if i else 0) for i in range(7)] + [(100 + i, 50) for i in range(5000)] + [(50, None)]
    path = {"path": (F.col("id").cast("string"), lambda a, b: F.concat_ws(".", a, b))}
    found = {r.id: r for r in hierarchy.rooted(spark.createDataFrame(rows, "id int, parent int"), [], "id", "parent", path).collect()}
    assert len(rounds) <= 3 + 5 and len(found) == len(rows)
    assert {k for k, r in found.items() if r.depth is None and r.path is None} == {*range(4), *range(10, 17)} and found[100].path == "50.100"


def test_against_walking_up(spark):
    rng = random.Random(3)
    up = {(s, i): rng.choice([None, 0, 0, 0, rng.randrange(80)]) for s in range(3) for i in range(80)}
    nodes = spark.createDataFrame([(s, i, p) for (s, i), p in up.items()], "scene_id int, obj_id int, parent_object_id int")
    order = {(r.scene_id, r.obj_id): r.depth for r in geometry.placement_order(nodes).collect()}
    pairs = {(r.scene_id, r.below, r.obj_id): r.depth for r in geometry.descendants(nodes).collect()}
    want = {}
    for s, i in up:
        way, k = [], up[s, i]
        while k is not None and k not in way:
            way.append(k)
            k = up[s, k]
        assert order[s, i] == (len(way) if k is None else None)
        want |= {(s, i, k): n + 1 for n, k in enumerate(way) if k != i}
    assert pairs == want


def test_counts_below_equal_the_pairs_in_rows_of_one_a_node(spark, monkeypatch):
    """Trees, a chain, and cycles of 1 to 9 nodes with chains hung from them; no round holds more rows than nodes."""
    rng, up = random.Random(8), {}
    for i in range(120):
        up[0, i] = rng.choice([None, *range(max(i - 3, 0), i)])
    for length in (1, 2, 3, 4, 5, 7, 8, 9):
        up |= {(length, i): (i + 1) % length for i in range(length)}
        for i in range(length, length + rng.randrange(0, 20)):
            up[length, i] = rng.choice([i - 1, rng.randrange(length)])
    want = {}
    for s, i in up:
        way, k = [], up[s, i]
        while k is not None and k not in way:
            way.append(k)
            k = up[s, k]
        for n, k in enumerate(way):
            if k != i:
                want.setdefault((s, k), []).append(n + 1)
    sizes, keep = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    nodes = spark.createDataFrame([(s, i, p) for (s, i), p in up.items()], "scene_id int, obj_id int, parent_object_id int")
    found = {(r.scene_id, r.obj_id): (r.n_below, r.deepest) for r in hierarchy.below(nodes, ["scene_id"], "obj_id", "parent_object_id").collect()}
    assert found == {k: (len(v), max(v)) for k, v in want.items()} and max(sizes) <= len(up) < sum(map(len, want.values()))


def test_empty_trees(spark):
    assert flatten.tree_paths(spark.createDataFrame([], "id string, parent string")).count() == 0
    assert hierarchy.ancestors(spark.createDataFrame([], "id string, parent string"), [], "id", "parent").count() == 0
    assert hierarchy.below(spark.createDataFrame([], "id string, parent string"), [], "id", "parent").count() == 0


def test_world_matrices_with_overrides(spark):
    at = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    quarter = [0.0, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    rows = [("s", "a", None, at(1.0), None), ("s", "b", "a", at(2.0), None), ("s", "c", "b", at(4.0), at(100.0)), ("s", "d", "c", quarter, None), ("s", "e", "d", at(8.0), None)]
    frame = spark.createDataFrame(rows, "scene_id string, obj_id string, parent_object_id string, local array<double>, override array<double>")
    found = {r.obj_id: r.world for r in geometry.world_matrices(frame).collect()}
    assert [found[k][3] for k in "abcde"] == [1.0, 3.0, 100.0, 100.0, 100.0] and found["e"][7] == 8.0


CONDITIONS = "memory_id string, action_id string, state_type string, object string, path string, op string, value string"


def plans(spark, rows, seeds, **limits):
    conditions = spark.createDataFrame([("m", a, kind, "o", "p", "eq", v) for a, kind, v in rows], CONDITIONS)
    chosen = spark.createDataFrame([("q", "all", a) for a in seeds], "query_id string, stage string, action_id string")
    allowed = spark.createDataFrame([("q", "all", "m")], "query_id string, stage string, memory_id string")
    initial = spark.createDataFrame([], "query_id string, object string, path string, value string")
    out = {}
    for r in sorted(planning.seed_plans(chosen, allowed, conditions, initial, **limits).collect(), key=lambda r: (r.seed, r.step)):
        assert r.step == len(out.setdefault(r.seed, []))
        out[r.seed].append(r.action_id)
    return out


def test_chain_of_twelve_and_the_depth_limit(spark):
    rows = [(f"a{i:02}", "new", str(i)) for i in range(12)] + [(f"a{i:02}", "precondition", str(i - 1)) for i in range(1, 12)]
    want = [f"a{i:02}" for i in range(12)]
    assert plans(spark, rows, ["a11"]) == {"a11": want}
    assert plans(spark, rows, ["a11", "a05"], depth=5) == {"a05": want[:6]}  # what a11 needs lies ten deep


def test_shared_needs_are_taken_once_and_the_shortest_way_wins(spark):
    rows = [("base", "new", "b"), ("left", "new", "l"), ("left", "precondition", "b"), ("right", "new", "r"), ("right", "precondition", "b"), ("goal", "precondition", "l"), ("goal", "precondition", "r")]
    rows += [("around", "new", "b"), ("around", "precondition", "l"), ("a_long", "new", "r"), ("a_long", "precondition", "l")]  # a cycle; a longer way that is first in order
    assert plans(spark, rows, ["goal"]) == {"goal": ["base", "left", "right", "goal"]}


def test_rounds_shuffle_what_they_find_and_not_the_tables(spark):
    """Chains of six beside forty thousand edges and wants that nothing reaches: these are not shuffled again in each round."""
    chains, idle = 50, 40000
    edges = spark.range(chains * 6).selectExpr("'q' AS query_id", "'all' AS stage", "concat('s', id) AS subgoal_id", "concat('a', id) AS action_id", "1 AS place")
    more = spark.range(idle).selectExpr("'q' AS query_id", "'all' AS stage", "concat('x', id) AS subgoal_id", "concat('y', id) AS action_id", "1 AS place")
    wants = spark.range(chains * 6).where("id % 6 > 0").selectExpr("'q' AS query_id", "'all' AS stage", "concat('a', id) AS action_id", "concat('s', id - 1) AS subgoal_id")
    never = spark.range(idle).selectExpr("'q' AS query_id", "'all' AS stage", "concat('y', id) AS action_id", "concat('never', id) AS subgoal_id")
    store = spark._jsc.sc().statusStore()
    before = max((s.stageId() for s in _stages(store)), default=-1)
    name = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    spark.conf.set(name, "100KB")  # of the files of the tables a fraction, as the usual one is at size
    try:
        found = planning.derivations(edges.unionByName(more), wants.unionByName(never))
    finally:
        spark.conf.set(name, usual)
    assert {r.subgoal_id: r.height for r in found.collect()} == {f"s{i}": i % 6 for i in range(chains * 6)}
    assert sum(s.shuffleWriteRecords() for s in _stages(store) if s.stageId() > before) < 3 * idle


def _stages(store):
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]


def test_near_needs_are_all_that_is_looked_at(spark, monkeypatch):
    rows = [(f"a{i}", "new", str(i)) for i in range(4)] + [(f"a{i}", "precondition", str(i - 1)) for i in range(1, 4)] + [("b2", "new", "2"), ("b2", "precondition", "never")]
    rows += [(f"z{i}", "new", f"z{i}") for i in range(30)] + [(f"z{i}", "precondition", f"z{i - 1}") for i in range(1, 30)]  # nothing asks for these
    looked, reach = [], planning.derivations
    monkeypatch.setattr(planning, "derivations", lambda edges, *a: looked.append({r.action_id for r in edges.collect()}) or reach(edges, *a))
    near = plans(spark, rows, ["a3", "a1"])
    assert looked == [{"a0", "a1", "a2", "b2"}] and near == {"a3": ["a0", "a1", "a2", "a3"], "a1": ["a0", "a1"]}
    monkeypatch.setattr(planning, "NEAR", 0)
    assert plans(spark, rows, ["a3", "a1"]) == near and len(looked[1]) > 30


def test_spread_timelines_equal_the_fold(spark):
    rng = random.Random(9)
    rows = []
    for m in ("large", "m1", "m2"):
        kinds = {}
        for i in range(700 if m == "large" else 40):
            parent = None if i < 2 else f"{m}.{0 if rng.random() < 0.6 else rng.randrange(i)}"
            if i == 30:
                parent = f"{m}.30"  # its own ancestor
            kinds[i] = rng.choice(["sequential", "sequential", "parallel", "cyclical"]) if i else "sequential"
            rows.append((m, f"{m}.{i}", parent, i, kinds[i], float(rng.choice([0, 0, 1, 2, 8])) / 4, rng.choice([None, 0.0, 0.5, 2.0])))
    actions = spark.createDataFrame(rows, "memory_id string, instance_id string, parent_id string, child_ix int, temporal_type string, own double, start_offset double")
    told = lambda df: sorted(map(tuple, df.collect()))
    fold = told(timeline.timelines(actions))
    assert len(fold) > 300 and told(timeline.timelines(actions, small=100)) == fold and told(timeline.timelines(actions, small=0)) == fold


def test_many_siblings_are_dealt_over_ranges(spark):
    rows = [("m", "root", None, 0, None, 0.0, None)] + [("m", f"c{i}", "root", i, "sequential", 1.0, None) for i in range(5000)]
    actions = spark.createDataFrame(rows, "memory_id string, instance_id string, parent_id string, child_ix int, temporal_type string, own double, start_offset double")
    found = {r.instance_id: r for r in timeline.timelines(actions, small=1000).collect()}
    assert found["root"].end_time == 5000.0 and all(found[f"c{i}"].start_time == i for i in range(5000))
