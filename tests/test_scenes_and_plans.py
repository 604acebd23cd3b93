"""Scene operations, geometry, shapes, chaining and simulation."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import geometry, maps, planning, relations, scene, shapes, similarity, world
from quillon.plans import synthetic_queries


def part(key, x=0.0, parent=None, size=2.0):
    return {"object_id": key, "parent_object_id": parent, "mass": 4.0, "transform": {"translation": [x, 0, 0]}, "elements": [{"element_type": "box", "parameters": {f"size_{a}_cm": size for a in "xyz"}}]}


def test_transforms():
    rng = np.random.default_rng(1)
    for _ in range(20):
        q = rng.normal(size=4)
        r = geometry.rotation(q)
        assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
        assert np.allclose(geometry.rotation(np.array(geometry.quaternion(r))), r)
    t = {"translation": [1, 2, 3], "rotation": [0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4)], "scale": [2, 3, 4]}
    back, shear = geometry.parts(geometry.matrix(t))
    assert np.allclose(back["translation"], [1, 2, 3]) and np.allclose(back["scale"], [2, 3, 4]) and shear < 1e-9
    world = geometry.worlds({"a": part("a", 5.0), "b": part("b", 1.0, "a"), "c": part("c", 0.0, "c")})
    assert world["b"][0, 3] == 6.0 and "c" in world
    clipped = part("a") | {"elements": [part("a")["elements"][0] | {"clips": [{"normal": [1, 0, 0], "point": [0, 0, 0]}]}]}
    lo, hi = geometry.world_box(clipped, np.eye(4))
    assert lo[0] == -1 and hi[0] <= 0


def test_operations():
    start = {"objects": {"a": part("a"), "b": part("b", 10.0)}}
    go = lambda s, **op: scene.apply(s, op)
    s, events = go(start, op="move", object_id="a", delta=[1, 0, 0])
    assert s["objects"]["a"]["transform"]["translation"][0] == 1 and start["objects"]["a"]["transform"]["translation"][0] == 0 and events[-1]["event"] == "applied"
    s, _ = go(s, op="attach", object_id="b", parent_id="a")
    assert np.isclose(geometry.worlds(s["objects"])["b"][0, 3], 10.0)
    assert go(s, op="attach", object_id="a", parent_id="b")[1][0]["event"] == "invalid"
    moved, _ = go(s, op="move", object_id="a", delta=[5, 0, 0])
    assert np.isclose(geometry.worlds(moved["objects"])["b"][0, 3], 15.0)
    s, _ = go(s, op="split", object_id="a", normal=[1, 0, 0], point=[0, 0, 0], new_ids=["l", "r"])
    assert set(s["objects"]) == {"l", "r", "b"} and s["objects"]["l"]["mass"] == 2.0 and s["objects"]["b"]["parent_object_id"] == "l"
    s, _ = go(s, op="merge", object_ids=["l", "r"], new_id="a2")
    assert s["objects"]["a2"]["mass"] == 4.0 and s["objects"]["b"]["parent_object_id"] == "a2" and len(s["objects"]["a2"]["elements"]) == 2
    s, _ = go(s, op="contact", a="a2", b="b", kind="rests")
    s, _ = go(s, op="remove_object", object_id="b")
    assert s["contacts"] == [] and set(s["objects"]) == {"a2"}
    s, _ = go({"objects": {"bar": part("bar")}}, op="chain_split", object_id="bar", axis=[1, 0, 0], range=[-1, 1], count=4)
    assert len(s["objects"]) == 4 and sum(o["mass"] for o in s["objects"].values()) == 4.0
    s, events = go(start, op="compound", operations=[{"op": "label", "object_id": "a", "label": "hot"}, {"op": "emit_event", "event": "ding"}, {"op": "nonsense"}])
    assert events[0]["event"] == "invalid" and s is start
    arm, _ = go(start, op="reach_arm_rotate", object_id="a", target_id="b")
    assert np.allclose(geometry.worlds(arm["objects"])["a"][:3, :3] @ [0, 0, -1], [1, 0, 0])


def test_every_sampler():
    sizes = {k: 2.0 for names in geometry.PARAMETERS.values() for k in names} | {"top_radius_cm": 1.0, "minor_radius_cm": 0.5}
    assert set(shapes.SAMPLERS) == set(geometry.PARAMETERS)
    for kind in shapes.SAMPLERS:
        e = {"element_type": kind, "parameters": sizes}
        points = shapes.sample(e, 400)
        lo, hi = geometry._extent(e)
        assert points.shape == (400, 3) and (points >= lo - 1e-9).all() and (points <= hi + 1e-9).all(), kind
        assert (points == shapes.sample(e, 400)).all()
    ball, stick = shapes.sample({"element_type": "sphere", "parameters": {"radius_cm": 3}}), shapes.sample({"element_type": "cylinder", "parameters": {"radius_cm": 1, "height_cm": 20}})
    assert shapes.similarity(ball, ball * 2) > 0.95 > shapes.similarity(ball, stick)


def test_chaining():
    edges, needs = {"g": ["a1", "a2"], "n": ["b"], "x": []}, {"a1": ["x"], "a2": ["n"], "b": []}
    assert planning.chain(["g"], edges, needs, {}, set()) == (["b", "a2"], True)
    assert planning.chain(["g"], edges, needs, {}, {"n"}) == (["a2"], True)
    assert planning.chain(["x"], edges, needs, {}, set()) == ([], False)
    loop = ({"g": ["a"], "h": ["c"]}, {"a": ["h"], "c": ["g"]})
    assert planning.chain(["g"], *loop, {}, set()) == ([], False)
    assert planning.chain(["g"], *loop, {}, set(), sound=False) == (["c", "a"], True)  # the plain mode takes a visited subgoal for solved
    assert planning.combine([[["a"], ["b"]], [["a", "c"]]]) == [["a", "c"], ["b", "a", "c"]]


def test_simulation():
    row = lambda kind, step, state, path, op, value, guard=None: {"kind": kind, "step": step, "state_type": state, "object": "o", "path": path, "op": op, "value": value, "guard": guard}
    rows = [
        row("initial", -1, None, "n", "eq", "1"), row("goal", -1, None, "n", "gte", "3"), row("goal", -1, None, "lid", "eq", "open"),
        row("step", 1, "precondition", "lid", "eq", "closed"), row("step", 1, "new", "n", "+=", "2"),
        row("step", 2, "conditional_new", "lid", "eq", "open", json.dumps({"object": "o", "path": "n", "op": "gt", "value": "2"})), row("step", 3, "conditional_new", "lid", "eq", "shut", json.dumps({"object": "o", "path": "n", "value": "9"})),
    ]
    steps, broken, satisfaction, final = planning._run_plan([tuple(r.get(c) for c in planning._ROW) for r in rows])
    assert (steps, broken, satisfaction) == (3, 1, 1.0) and json.loads(final) == [["o", "lid", "open"], ["o", "n", "3.0"]]


def test_plans_folded_together_equal_each_by_itself(monkeypatch):
    """Sums, texts, nulls, repeated steps and guards of 300 plans at once; texts are compared once for each combination."""
    rng, names = random.Random(5), ("plan_id", *planning._ROW)
    rows = []
    for p in range(300):
        for _ in range(rng.randrange(1, 12)):
            kind = rng.choice(["initial", "goal", "step", "step", "step"])
            state = rng.choice(["precondition", "new", "new", "conditional_new", "old", None]) if kind == "step" else None
            guard = json.dumps({"object": "o", "path": "n", "op": "gt", "value": "2"}) if state == "conditional_new" and p % 5 == 0 else None
            rows.append((f"p{p:03}", rng.choice([0, 1, 2, 3, None]) if kind == "step" else -1, kind, rng.choice(["o", "q"]), rng.choice(["n", "lid"]), rng.choice(["1", "2.5", "open", "-0", "nan", None]), state, rng.choice(["eq", "+=", "+=", "gt", "ne", "in"]), guard))
    key = lambda r: (r[0], *((v is not None, v if v is not None else 0) for v in (r[i] for i in (1, 2, 3, 4, 5, 6, 7, 8))))
    rows.sort(key=key)
    whole, calls = planning.holds, []
    want = [(p, *planning._run_plan([r[1:] for r in rows if r[0] == p])) for p in sorted({r[0] for r in rows})]
    monkeypatch.setattr(planning, "holds", lambda *a: calls.append(a) or whole(*a))
    pa, fields = planning.pa, ("state_type", "guard", "object", "path", "op", "value")
    schema = pa.schema([("plan_id", pa.string()), ("kind", pa.string()), ("step", pa.int32()), ("conditions", pa.list_(pa.struct([(f, pa.string()) for f in fields])))])

    def batch(rows):
        each = [dict(zip(names, r, strict=True)) for r in rows]
        return pa.RecordBatch.from_pylist([{"plan_id": r["plan_id"], "kind": r["kind"], "step": r["step"], "conditions": [{f: r[f] for f in fields}]} for r in each], schema)

    free = [r for r in rows if int(r[0][1:]) % 5]
    planning._folded(batch(free))
    assert 0 < len(calls) < len(free) / 4
    batch = batch(sorted(rows, key=lambda r: (r[0], rng.random())))  # in any order within a plan
    got = [tuple(r.values()) for r in planning._folded(batch).to_pylist()]
    assert got == want
    bare = pa.RecordBatch.from_pylist([{"plan_id": "p", "kind": "step", "step": i, "conditions": None} for i in (1, 2, 2)], schema)
    assert planning._folded(bare).to_pylist() == [{"plan_id": "p", "n_steps": 2, "n_violations": 0, "satisfaction": 1.0, "final": "[]"}]


@pytest.mark.parametrize(("a", "b", "names"), [
    (((-3, 3), (-3, 3), (80, 86)), ((-60, 60), (-30, 30), (75, 80)), {"contact", "near", "on"}),
    (((-9, 9), (-6, 6), (78, 90)), ((-3, 3), (-3, 3), (80, 86)), {"contact", "near", "around", "through"}),
    (((0, 1), (0, 1), (50, 51)), ((0, 1), (0, 1), (0, 1)), {"apart", "above"}),
])
def test_predicates(spark, a, b, names):
    box = lambda d: relations.box(*(F.lit(float(v)) for side in d for v in side))
    found = relations.predicates(F.col("a"), F.col("b"))
    r = spark.range(1).select(box(a).alias("a"), box(b).alias("b")).select(*(holds.alias(n) for n, (holds, _) in found.items())).first()
    assert {n for n in found if r[n]} == names


def test_maps(spark):
    points = lambda rows: spark.createDataFrame(rows, "pair_id string, object_id string, template string, categories array<string>")
    links = lambda rows: spark.createDataFrame(rows, "pair_id string, predicate string, source string, target string")
    left = points([("p", "a", "cup", ["dish"]), ("p", "b", "table", ["furniture"])])
    right = points([("p", "x", "cup", ["dish"]), ("p", "y", "desk", ["furniture", "object"])])
    got = maps.similarity(left, right, links([("p", "on", "a", "b")]), links([("p", "on", "x", "y")])).first()
    assert got.similarity == 1.0


def test_registered_similarities_are_of_512_points(spark, monkeypatch):
    seen, whole = {}, shapes.shape_similarities
    monkeypatch.setattr(shapes, "shape_similarities", lambda forms, pairs, **more: whole(seen.setdefault("forms", forms), pairs, **more))
    rows = synthetic_queries.shape_similarity(spark, "/root/testdata/sf0.001").collect()
    elements = {r.shape_id: json.loads(r.element) for r in seen["forms"].collect()}
    assert len(rows) == len(elements) - len({r.left for r in rows}) > 20
    for r in rows[:20]:
        a, b = (shapes.sample(elements[k], 512) for k in (r.left, r.right))
        assert len(a) == len(b) == 512 and abs(r.similarity - shapes.similarity(a, b)) < 1e-6


def test_chamfer_by_blocks():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(70, 3)), rng.normal(size=(45, 3))
    far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for block in (7, 70, 1024):
        assert np.isclose(shapes.chamfer(a, b, block), far.min(axis=1).mean() + far.min(axis=0).mean(), rtol=1e-12)


def test_split_cuts_where_the_world_plane_is():
    ball = {"element_type": "sphere", "parameters": {"radius_cm": 1.0}, "transform": {"translation": [5, 0, 0]}}
    start = {"objects": {"a": part("a") | {"elements": [ball]}, "c": part("c", 0.0, "a"), "d": part("d", 0.0, "a")}, "contacts": [{"a": "a", "b": "d"}, {"a": "c", "b": "d"}]}
    start["objects"]["a"]["transform"] = {"translation": [0, 0, 10], "rotation": [0, 0, np.sin(np.pi / 4), np.cos(np.pi / 4)], "scale": [2, 2, 2]}  # the ball's centre is at (0, 10, 10)
    s, events = scene.apply(start, {"op": "split", "object_id": "a", "normal": [0, 3, 0], "point": [0, 10, 0], "new_ids": ["l", "r"], "children_assignment": {"d": "r"}})
    assert events[-1]["event"] == "applied" and s["objects"]["c"]["parent_object_id"] == "l" and s["objects"]["d"]["parent_object_id"] == "r"
    assert s["contacts"] == [{"a": "l", "b": "d"}, {"a": "c", "b": "d"}]
    at = geometry.worlds(s["objects"])
    lo, hi = geometry.world_box(s["objects"]["l"], at["l"])
    assert abs(lo[1] - 8) < 0.1 and abs(hi[1] - 10) < 0.1 and abs(hi[0] - 2) < 0.1
    lo, hi = geometry.world_box(s["objects"]["r"], at["r"])
    assert abs(lo[1] - 10) < 0.1 and abs(hi[1] - 12) < 0.1
    assert scene.apply(start, {"op": "split", "object_id": "a", "normal": [0, 0, 0]})[1][0]["event"] == "invalid"


def test_scene_format_is_read_and_written():
    text = json.dumps({"3d_assembly": {"assembly_id": "x", "objects": [
        {"object_id": "a", "template_name": "t", "mass_grams": 6.0, "object_transform": {"translate": [1, 2, 3], "rotate": [0, 0, 0, 1], "scale": [1, 1, 1]}, "elements": [{"element_type": "box", "parameters": {f"size_{k}_cm": 2.0 for k in "xyz"}, "transform": {"translate": [4, 0, 0]}}], "metadata": {"clips": [{"point": [4, 0, 0], "normal": [1, 0, 0]}]}},
        {"object_id": "b", "template_name": "t", "parent_object_id": "a", "world_matrix_override": np.diag([2.0, 2, 2, 1]).tolist(), "elements": [{"element_type": "sphere", "parameters": {"radius_cm": 1.0}}]},
    ], "contacts": [{"object_a": "a", "object_b": "b"}]}})
    s = geometry.unwrapped(text)
    assert s["objects"]["a"]["mass"] == 6.0 and s["objects"]["a"]["template"] == "t" and s["contacts"] == [{"a": "a", "b": "b"}]
    at = geometry.worlds(s["objects"])
    assert at["b"][0, 0] == 2.0 and at["a"][:3, 3].tolist() == [1, 2, 3]
    lo, hi = geometry.world_box(s["objects"]["a"], at["a"])
    assert np.allclose(lo, [4, 1, 2]) and abs(hi[0] - 5) < 0.05
    assert geometry.unwrapped(geometry.wrapped(s)) == s
    for op in ({"op": "move", "object_id": "a", "delta": [1, 0, 0]}, {"op": "rotate", "object_id": "a", "quaternion": [0, 0, 1, 0]}, {"op": "detach", "child_id": "b"}, {"op": "add_object", "object_id": "n", "template_name": "t", "object_transform": {"translate": [9, 0, 0]}, "elements": []}, {"op": "split", "source_id": "a", "cut_point_world": [5, 0, 0], "cut_normal_world": [1, 0, 0], "new_object_ids": ["p", "q"]}, {"op": "release", "object_a": "p", "object_b": "b"}, {"op": "set_transform", "object_id": "b", "world_transform": {"translate": [0, 0, 7]}}):
        s, events = scene.apply(s, op)
        assert events[-1]["event"] == "applied", (op, events)
    assert s["contacts"] == [] and geometry.worlds(s["objects"])["n"][0, 3] == 9


def test_clouds_follow_element_transforms(spark, tmp_path):
    box = lambda x: {"element_type": "box", "parameters": {f"size_{k}_cm": 1.0 for k in "xyz"}, "transform": {"translation": [x, 0, 0]}}
    far, near = shapes.cloud([box(0), box(50)], 200), shapes.cloud([box(0), box(1)], 200)
    assert len(far) == 200 and far[:, 0].max() > 49 and near[:, 0].max() < 2
    assert shapes.geometry_hash(box(0)) != shapes.geometry_hash(box(50))
    tri = shapes.sample({"element_type": "prism", "parameters": {"size_x_cm": 2.0, "size_y_cm": 2.0, "num_sides": 3}}, 2000)
    assert tri[:, 0].min() > -0.51 and tri[:, 0].max() > 0.9  # a triangle's flat side is half a radius away
    elements = spark.createDataFrame([("s", json.dumps(box(0))), ("s", json.dumps(box(50))), ("t", json.dumps(box(0)))], "shape_id string, element string")
    first = {r.shape_id: r.points for r in shapes.kept_clouds(elements, f"{tmp_path}/clouds", 64).collect()}
    n = spark.read.parquet(f"{tmp_path}/clouds").count()
    again = {r.shape_id: r.points for r in shapes.kept_clouds(elements, f"{tmp_path}/clouds", 64).collect()}
    assert first == again == {r.shape_id: r.points for r in shapes.clouds(elements, 64).collect()} and n == spark.read.parquet(f"{tmp_path}/clouds").count() == 2


def test_chamfer_groups_in_cells(spark, monkeypatch):
    monkeypatch.setattr(shapes, "CELL", 7)
    rng = np.random.default_rng(3)
    groups = {g: rng.normal(size=(n, 4)) for g, n in (("a", 30), ("b", 3), ("c", 15))}
    rows = spark.createDataFrame([(g, x.tolist()) for g, xs in groups.items() for x in xs], "g string, p array<double>")
    got = {(r.left, r.right): r.chamfer for r in shapes.chamfer_groups(rows).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), d in got.items():
        assert np.isclose(d, shapes.chamfer(groups[a], groups[b]))


def test_chamfer_groups_meet_copies_once(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=(5, 3)), "b": rng.normal(size=(4, 3))}
    rows = spark.createDataFrame([(g, i, x.tolist()) for g, xs in groups.items() for i, x in enumerate(xs)], "g string, i int, p array<double>")
    copies = rows.crossJoin(spark.range(50_000)).where("i = 0 or id < 10").select("g", "p")  # 10^10 pairs, were they all met
    weighted = {g: np.repeat(xs, [50_000] + [10] * (len(xs) - 1), axis=0) for g, xs in groups.items()}
    nearest = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2).min(axis=1)).mean()
    want = nearest(weighted["a"], groups["b"]) + nearest(weighted["b"], groups["a"])
    began = time.perf_counter()
    got = shapes.chamfer_groups(copies).collect()
    assert len(got) == 1 and np.isclose(got[0].chamfer, want) and time.perf_counter() - began < 20


def test_close_pairs_are_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    vectors = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sims[i, j] >= 0.9}
    for size in (1000, 20):
        found = [(r.left, r.right) for r in similarity.close_pairs(rows, 0.9, rows_in_block=size).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert similarity.close_pairs(rows.limit(0), 0.9).count() == 0


def test_contacts(spark):
    rows = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x")], "a string, b string")
    assert geometry.contacts_of(rows, "x").count() == 2 and geometry.in_contact(rows, "z", "y").count() == 1 and geometry.in_contact(rows, "x", "x").count() == 0


def test_seed_plans_back_out_of_dead_ends(spark):
    rows = [
        ("m", "seed", "precondition", "o", "p", "eq", "2"), ("m", "a", "new", "o", "p", "eq", "2"), ("m", "a", "precondition", "o", "p", "eq", "9"), ("m", "b", "new", "o", "p", "eq", "2"), ("m", "b", "old", "o", "p", "eq", "1"),
        ("m", "free", "new", "o", "x", "eq", "1"), ("m", "lost", "precondition", "o", "p", "eq", "9"), ("far", "c", "new", "o", "p", "eq", "9"),
    ]
    conditions = spark.createDataFrame(rows, "memory_id string, action_id string, state_type string, object string, path string, op string, value string")
    chosen = spark.createDataFrame([("q", "all", a) for a in ("seed", "free", "lost")], "query_id string, stage string, action_id string")
    initial = spark.createDataFrame([("q", "o", "p", "1")], "query_id string, object string, path string, value string")
    allowed = spark.createDataFrame([("q", "all", "m")], "query_id string, stage string, memory_id string")
    found = planning.seed_plans(chosen, allowed, conditions, initial)
    plans = {}
    for r in sorted(found.collect(), key=lambda r: (r.seed, r.step)):
        plans.setdefault(r.seed, []).append(r.action_id)
    assert plans == {"seed": ["b", "seed"], "free": ["free"]}  # a leads nowhere, b's old state holds; what lost needs only a memory that is not allowed gives


def test_worlds_hold_a_row_for_each_memory_of_a_plan(spark):
    rng = random.Random(4)
    steps = [(p, i, f"{p}.{i}") for p in range(6) for i in range(5)]
    stems = [(a, rng.randrange(4)) for _, _, a in steps]
    leaves = [(m, f"o{i}", path, f"{m}{path}") for m in range(4) for i in range(m, 12, m + 1) for path in ("position.relation", "position.relative_to", "size")[: 3 - i % 2]]
    frames = spark.createDataFrame(steps, "plan_id int, step int, action_id string"), spark.createDataFrame(stems, "action_id string, memory_id int"), spark.createDataFrame(leaves, "memory_id int, object string, path string, value string")
    want, of = {}, dict(stems)
    for p, _, a in steps:
        for m, o, path, value in leaves:
            if m == of[a] and want.setdefault((p, o), (m, {}))[0] == m:
                want[p, o][1][path] = value
    assert world.winners(*frames).count() == len({(p, m) for (p, _), (m, _) in want.items()})
    assert {(r.plan_id, r.object, r.path, r.value) for r in world.of_plans(*frames).collect()} == {(*k, *x) for k, (_, v) in want.items() for x in v.items()}
    both = [(*k, v["position.relation"], v["position.relative_to"]) for k, (_, v) in want.items() if "position.relative_to" in v]
    assert sorted(map(tuple, world.relations_of_plans(*frames).collect())) == sorted(both)


def test_memories_that_are_alike_send_no_objects_with_plans(spark):
    rng = random.Random(9)
    of = {m: [f"o{i}" for i in range(3 if m < 4 else m)] for m in range(8)}  # memories 0 to 3 are alike
    steps = [(p, rng.randrange(3), f"{p}.{i}", rng.randrange(4) if p < 20 else rng.randrange(8)) for p in range(40) for i in range(4)]
    leaves = [(m, o, path, f"{m}{path}") for m, objects in of.items() for o in objects for path in ("size", "kind")[: 1 + m % 2]]
    frames = spark.createDataFrame([s[:3] for s in steps], "plan_id int, step int, action_id string"), spark.createDataFrame([(s[2], s[3]) for s in steps] * 2, "action_id string, memory_id int"), spark.createDataFrame([*leaves, (9, None, "size", "1")], "memory_id int, object string, path string, value string")
    want, rows = {}, {}
    for p, _, _, m in sorted(steps, key=lambda s: (s[0], s[1], s[3])):
        for o in of[m]:
            if want.setdefault((p, o), m) == m:
                rows.setdefault(p, set()).update((o, path, value) for k, x, path, value in leaves if (k, x) == (m, o))
    state = lambda found: hashlib.md5(";".join(f"{o}.{path}={value}" for o, path, value in sorted(found)).encode()).hexdigest()
    told = {r.plan_id: (r.n_objects, r.n_leaves, r.state) for r in world.states_of_plans(*frames).collect()}
    assert told == {p: (len({o for o, _, _ in found}), len(found), state(found)) for p, found in rows.items()} and len(told) == 40
    won = world.winners(*frames).collect()
    assert all(r.objects is None and r.n == 1 for r in won if r.plan_id < 20) and any(r.objects for r in won) and any(r.n > 1 for r in won)
    for r in won:
        taken = {o for (p, o), m in want.items() if (p, m) == (r.plan_id, r.memory_id)}
        assert taken == set(of[r.memory_id] if r.objects is None else r.objects)
