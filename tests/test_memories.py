"""The memory engine end to end: reading, ingest, index, search, timelines, query generation, quality jobs."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import aliases, flatten, ingest, legacy, quality, querygen, ranking, search, timeline
from quillon.sources import memories as sources

DIMS = {"length": {"value": 20, "unit": "cm"}, "width": {"value": 10, "unit": "cm"}, "height_thickness": {"value": 0.05, "unit": "m"}}
ONE = {
    "id": "m1", "activity": "Cut bread",
    "objects": [
        {"id": "knife1", "template": "bread_knife", "categories": ["tool"], "functions": ["cut"], "materials": ["steel"], "shape": "long", "dimensions": DIMS, "position": {"relation": "lying on", "relationr": "on", "relative_to": "table1"}, "overrides": {"blade": {"edge": "serrated", "length": {"value": 15, "unit": "cm"}}}},
        {"id": "table1", "template": "table", "position": {"relation": "in", "relationr": "in", "relative_to": "kitchen"}, "overrides": {"finish": ["oiled", "matte"]}},
        {"id": "kitchen", "template": "room"},
    ],
    "actions": [{"template": "slice_bread", "verb": "slice", "duration": 0, "temporal_type": "sequential", "participants": ["knife1", "loaf"], "changes": [{"object": "loaf", "aspect": "form", "attribute": "integrity", "old": "whole", "new": "sliced"}],
                 "preconditions": [{"object": "knife1", "attribute": "blade.edge", "op": "eq", "value": "serrated"}],
                 "sub_actions": [{"template": "grip", "duration": 2}, {"template": "saw", "temporal_type": "cyclical", "cycle_duration": 1.5, "repetitions": 4}]}],
    "goal_states": [{"target_object": "loaf", "aspect": "form", "attribute": "integrity", "value": "sliced"}],
}
TWO = {"memory": {"id": "m2", "activity": "Paint", "objects": [{"id": "brush", "template": "paint_brush", "overrides": {"bristle": "soft"}}], "actions": [], "goal_states": []}}
ALIASES = {"object_aliases": {"bread_knife": ["bread cutter", "bread cutter", "loaf_knife"]}, "value_aliases": {"sliced": ["carved"]}, "attribute_component_aliases": {"integrity": ["wholeness"]}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("memories")
    (where / "a.jsonl").write_text(json.dumps(ONE) + "\n\n---\nnot json\n" + json.dumps(TWO) + "\n---\n" + json.dumps(ONE) + "\n")
    (where / "aliases.json").write_text(json.dumps(ALIASES))
    (where / "terms.txt").write_text("object:table|2.5\n\nvalue:sliced\n")
    return str(where)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return sources.memories(sources.read_jsonl(spark, f"{folder}/a.jsonl")).cache()


@pytest.fixture(scope="module")
def index(spark, folder, rows):
    dictionary = aliases.merge(sources.read_aliases(spark, f"{folder}/aliases.json"))
    return ingest.build_index(rows, dictionary)


def test_reading(spark, folder, rows, tmp_path):
    assert {r.memory_id: r.activity for r in rows.collect()} == {"m1": "Cut bread", "m2": "Paint"}
    assert [tuple(r) for r in sources.read_terms(spark, f"{folder}/terms.txt").orderBy("query_term").collect()] == [("object:table", 2.5), ("value:sliced", 1.0)]
    (tmp_path / "x.json").write_text(json.dumps([ONE, TWO]))
    assert sources.memories(sources.read_documents(spark, str(tmp_path / "x.json"))).count() == 2
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    changed = spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int")
    assert {tuple(r) for r in sources.upsert(stored, changed, "key").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in sources.upsert(stored, changed, "key", overwrite=False).collect()} == {("a", 1), ("b", 2), ("c", 4)}
    vectors = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "term string, vec array<double>")
    sources.save_vectors(vectors, str(tmp_path), "names")
    assert sources.load_vectors(spark, str(tmp_path), "names", vectors).count() == 2
    assert sources.load_vectors(spark, str(tmp_path), "names", vectors.limit(1)) is None and sources.load_vectors(spark, str(tmp_path), "none") is None


def test_flatten():
    got = flatten.leaves({"a": {"b": 1, "c": [True, {"d": None}]}, "w": {"value": 3, "unit": "kg"}, "x.y": "z"})
    assert got == [(["a", "b"], "1", "num"), (["a", "c"], "true", "bool"), (["a", "c", "d"], None, "null"), (["w"], "3kg", "str"), (["x.y"], "z", "str")]
    assert flatten.leaves({"a": ["p", "q"]}, indexed=True) == [(["a", "0"], "p", "str"), (["a", "1"], "q", "str")]


def test_path_variants(spark):
    got = spark.range(1).select(flatten.path_variants(F.array(F.lit("a.b"), F.lit("c"), F.lit("d.e"))).alias("v")).first().v
    assert sorted(map(tuple, got)) == sorted([("a.b", "c", "d.e"), ("a", "b", "c", "d.e"), ("a.b", "c", "d", "e"), ("a", "b", "c", "d", "e")])


def test_timeline(rows):
    times = {r.instance_id: (r.start_time, r.end_time, r.effective_duration) for r in timeline.timelines(ingest.actions(rows)).collect()}
    root = "m1.memory.actions.0"
    assert times == {root: (0.0, 8.0, 8.0), f"{root}.sub_actions.0": (0.0, 2.0, 2.0), f"{root}.sub_actions.1": (2.0, 8.0, 6.0)}


def test_index(index):
    terms = {r.term for r in index.postings.where("memory_id = 'm1'").select("term").distinct().collect()}
    assert {"object:bread_knife", "object_expanded:loaf_knife", "object_token:bread", "category:tool", "attribute:blade", "value:serrated", "attribute:integrity", "attribute_expanded:wholeness", "value_expanded:carved", "verb:slice", "action_token:bread", "value:oiled"} <= terms
    assert "attribute:length" not in terms and "value:15cm" in terms
    paths = {(tuple(r.path), r.value, r.state_type, r.is_goal) for r in index.fullpath.where("memory_id = 'm1'").collect()}
    assert {(("form", "integrity"), "whole", "old", False), (("form", "integrity"), "sliced", "goal", True), (("blade", "edge"), "serrated", "precondition", False), (("dimensions", "length"), "20cm", None, False), (("volume",), "1000.0cm^3", None, False)} <= paths
    assert index.postings.select("memory_id", "seq").distinct().count() == index.postings.count()


def ranked(spark, index, *terms):
    frame = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "query_term string, position int")
    found = search.contributions(index, frame).cache()
    return found.collect(), {r.memory_id: r.score for r in ranking.rank(ranking.settle(found)).collect()}


def test_search_modes(spark, index):
    index.freq = index.freq.withColumn("occurrence_percentage", F.lit(0.01))  # in so small an index every term is too frequent
    path = json.dumps({"path": ["form", "integrity"], "op": "eq", "value": "sliced", "object": "loaf"})
    found, scores = ranked(spark, index, "object:table", "value:sliced", f"fullpath:{path}", "spatial:on(bread_knife,table)", "spatial:in(knife1,kitchen)", "position_unit:k:lying on:on:table1", "verb_target:slice", "attribute_value:dimensions.length=22cm", "attribute_value:dimensions.width=9cm", "attribute_value:dimensions.height_thickness=5cm", "attribute_value:volume=900cm^3")
    by_mode = {}
    for r in found:
        by_mode.setdefault(r["mode"], []).append(r.score)
    assert by_mode["object_exact"] == [1.0]
    assert by_mode["spatial_direct"] == [1.0] and by_mode["spatial_one_hop"] == [0.5]
    assert by_mode["position_unit"] == [1.0] and by_mode["verb_exact"] == [2.0] and by_mode["measurement"] == [1.0]
    assert max(by_mode["fullpath"]) == 16.0  # 2.0 for the core, 2.0 for the object, 4.0 for the goal
    assert sorted(round(x, 6) for x in by_mode["component_exact"]) == [0.4, 0.5]  # the change first; the goal is second, and amplified
    assert scores["m1"] > 0 and "m2" not in scores


def test_aliases_fold(spark, index):
    found, _ = ranked(spark, index, "object_expanded:loaf_knife")
    assert {(r["mode"], r.matched_term, r.alias_used, round(r.score, 6)) for r in found} == {("object_exact", "object:bread_knife", True, 0.9)}


def test_query_terms(spark, folder):
    objects = [("k", "bread_knife", False, "long", "20cm", "10cm", "5cm", "200g", "lying on", "on", "table", ["tool"], ["cut"], ["steel"], {"blade.edge": "serrated"})]
    actions = [("slice_bread", "slice", True, "kitchen", None, ["k", "loaf"])]
    conditions = [("loaf", "form", "integrity", "eq", "sliced", True)]
    queries = spark.createDataFrame([("q", objects, actions, conditions)], querygen.QUERY)
    terms = {r.query_term: r.weight for r in querygen.terms_of(queries, aliases.merge(sources.read_aliases(spark, f"{folder}/aliases.json"))).collect()}
    assert {"object:bread_knife", "object_expanded:bread_cutter", "verb_target:slice", "spatial:on(k,table)", "position_unit:k:lying on:on:table", "attribute_value:volume=1000.0cm^3", "goalstate:value:sliced", "category:tool", "value:serrated"} <= set(terms)
    assert terms["action:slice_bread"] == 3.0 and terms["goalstate:attribute:integrity"] == 10.0
    assert any(t.startswith("fullpath:") and '"goalstate"' in t for t in terms)


def test_legacy_cascade(spark, index):
    terms = spark.createDataFrame([("object:table", 2.0), ("object:tabel", 1.0), ("value:nothing like it", 1.0)], "query_term string, weight double")
    got = legacy.cascade(index.postings, terms, threshold=0.3).collect()
    assert {r.stage for r in got if r.query_term == "object:table"} == {"exact"}
    assert all(r.stage != "exact" for r in got if r.query_term == "object:tabel")
    assert len({(r.query_term, r.stage) for r in got}) == len({r.query_term for r in got})


def test_quality_jobs(spark, rows):
    general = spark.createDataFrame([("cut", "cut", ["grip", "saw"]), ("paint", "", [])], "general string, verb string, sub_actions array<string>")
    alts = spark.createDataFrame([("cut_bread", "cut", None, ["grip", "saw"]), ("cut_cloth", "cut", None, ["grip"])], "alt string, general string, verb string, sub_actions array<string>")
    linked = quality.linked_storage(general, alts)
    assert {(r.general, r.alt, r.implicit) for r in linked.collect()} == {("cut", "cut_bread", False), ("cut", "cut_cloth", False), ("paint", "paint", True)}
    assert [r.general for r in quality.missing_verbs(general).collect()] == ["paint"]
    actions = spark.createDataFrame([("i1", "cut", ["grip"]), ("i2", "cut", ["x"]), ("i3", "cut_bread", []), ("i4", "paint", []), ("i5", "sweep", []), ("i6", "sweep", [])], "instance_id string, template string, sub_names array<string>")
    got = {r.instance_id: (r.alt, r.how) for r in quality.resolve_alts(actions, linked).collect()}
    assert got == {"i1": ("cut_cloth", 2), "i2": ("cut_bread", 3), "i3": ("cut_bread", 0), "i4": ("paint", 0), "i5": (None, None), "i6": (None, None)}
    assert [tuple(r) for r in quality.missing_templates(actions, linked).collect()] == [("sweep", 2, True, True)]
    converted = quality.convert_sub_actions(spark.createDataFrame([("a", ["paint", "cut", "what"])], "alt string, sub_actions array<string>"), linked).first()
    assert converted.converted == ["paint", "cut", "what"] and converted.unresolved == ["cut", "what"]
    assert quality.sub_action_mismatches(linked).first().general == "cut"
    assert {(r.memory_id, r.issue) for r in quality.malformed(rows).collect()} == set()
    assert [r.memory_id for r in quality.without_goals(rows).collect()] == ["m2"]
    mapping = spark.createDataFrame([("Lying On", "on")], "relation string, restricted string")
    records = spark.createDataFrame([("lying on", None), ("over", "above"), ("odd", None)], "relation string, relationr string")
    assert {(r.relation, r.relationr) for r in quality.set_restricted(records, mapping).collect()} == {("lying on", "on"), ("over", "above"), ("odd", None)}
    assert [r.relation for r in quality.unmapped(records, mapping).collect()] == ["odd"]
    goals = spark.createDataFrame([("m", "g1", "o", "integrity", "eq", "sliced"), ("m", "g2", "o", "x", "eq", "y")], "memory_id string, goal_id string, object string, path string, op string, value string")
    paths = spark.createDataFrame([("m", "o", "form.integrity", "sliced", "new"), ("m", "o", "form.integrity", "whole", "old")], "memory_id string, object string, path string, value string, source string")
    assert {r.goal_id: r.supported for r in quality.goal_support(goals, paths).collect()} == {"g1": True, "g2": False}


def test_sinks_and_stores(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "a"), ("m2", "b")], "id string, activity string")
    for _ in range(2):
        sources.append_lines(rows, f"{tmp_path}/lines")
    assert sorted(json.loads(r.raw)["id"] for r in sources.read_jsonl(spark, f"{tmp_path}/lines").collect()) == ["m1", "m1", "m2", "m2"]
    vectors = spark.createDataFrame([("x", [1.0])], "term string, vec array<double>")
    for group in ("names", "values"):
        sources.save_vectors(vectors, f"{tmp_path}/vectors", group)
    assert sources.list_vectors(spark, f"{tmp_path}/vectors") == ["names", "values"] and sources.has_vectors(spark, f"{tmp_path}/vectors", "names")
    sources.clear_vectors(spark, f"{tmp_path}/vectors", "names")
    assert sources.list_vectors(spark, f"{tmp_path}/vectors") == ["values"]
    sources.clear_vectors(spark, f"{tmp_path}/vectors")
    assert sources.list_vectors(spark, f"{tmp_path}/vectors") == [] == sources.list_vectors(spark, f"{tmp_path}/none")
    box = [{"element_type": "box", "parameters": {"size_x_cm": 1.0}}]
    kind = "template string, elements array<struct<element_type:string,parameters:map<string,double>>>"
    kept, refused = sources.stored_elements(spark.createDataFrame([("a", box), ("b", box)], kind), spark.createDataFrame([("b", box * 2), ("c", []), (None, box)], kind))
    assert {r.template: len(r.elements) for r in kept.collect()} == {"a": 1, "b": 2} and refused.count() == 2
    assert [r.template for r in sources.without_elements(kept, spark.createDataFrame([("b",)], "template string")).collect()] == ["a"]
    (tmp_path / "s.3dassembly.json").write_text(json.dumps({"3d_assembly": {"assembly_id": "x1", "objects": [{"object_id": "o", "template_name": "t", "object_transform": {"translate": [1, 0, 0]}, "elements": []}]}}))
    scenes = sources.read_scenes(spark, f"{tmp_path}/s.3dassembly.json")
    assert scenes.first().scene_id == "x1"
    sources.write_scenes(scenes, f"{tmp_path}/scenes")
    back = json.loads(spark.read.text(f"{tmp_path}/scenes").first().value)["3d_assembly"]["objects"][0]
    assert back["template_name"] == "t" and back["object_transform"]["translate"] == [1, 0, 0]


def test_shipped_index_drops_prefixes(spark, rows):
    dictionary = spark.createDataFrame([], "kind string, base string, alias string, rank int")
    kept = {r.prefix for r in ingest.build_index(rows, dictionary, as_shipped=True).postings.select("prefix").distinct().collect()}
    assert "value" in kept and "object_token" in kept and not kept & {"object", "action", "category", "material"}


def test_index_that_grows_by_segments(spark, tmp_path):
    from quillon.plans import synthetic_queries
    from quillon.sources.index_store import IndexStore

    memories = synthetic_queries.memories_of(spark, "/root/testdata/sf0.001").orderBy("memory_id").limit(9).cache()
    ids = [r.memory_id for r in memories.select("memory_id").collect()]
    dictionary = spark.createDataFrame(synthetic_queries.ALIASES, "kind string, base string, alias string, rank int")
    store = IndexStore(spark, f"{tmp_path}/index")
    batch = lambda part: memories.where(F.col("memory_id").isin(*part))
    first = store.append(batch(ids[:4]), dictionary)
    (tmp_path / "index" / first / "postings").rename(tmp_path / "away")  # a batch is added without reading the postings that are there
    assert store.append(batch(ids[2:7]), dictionary) and store.append(batch(ids[:7]), dictionary) is None
    (tmp_path / "away").rename(tmp_path / "index" / first / "postings")
    store.append(batch(ids[7:]), dictionary)
    assert len(store.segments()) == 3 and sum(store.segments().values()) == store.table("postings").count()
    whole = ingest.build_index(memories, dictionary)
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert told(store.frequencies()) == told(whole.freq.select(*store.frequencies().columns))
    terms = spark.createDataFrame([("object:account", 0), ("value:signups", 1), ("verb_target:purchase", 2)], "query_term string, position int")
    want = told(search.search(whole, terms, top=None))
    assert want and told(search.search(store.open(dictionary), terms, top=None)) == want
    assert store.compact(fan=10**6) == [] and len(store.compact(fan=3)) <= 1
    orders = store.segments()
    assert told(store.frequencies()) == told(whole.freq.select(*store.frequencies().columns)) and sum(orders.values()) == store.table("postings").count()


def test_term_counts_are_those_of_the_index(spark):
    changes = [{"object": "cup", "aspect": "mood", "attribute": "last.seen", "op": "eq", "old": "warm", "new": "cold"}, {"object": "cup", "attribute": "state", "new": None, "old": "full"}]
    acts = [{"template": "pour", "verb": "pour", "participants": ["cup"], "preconditions": [{"object": "cup", "attribute": "state", "value": "full"}], "changes": changes, "conditional_changes": [{"changes": changes}, {}], "sub_actions": [{"template": "lift", "changes_total": changes[:1]}]}]
    goals = [{"object": "cup", "attribute": "state", "op": "eq", "value": "empty"}]
    objects = [{"id": "cup", "template": "mug", "categories": ["dish"], "overrides": {"mood": {"last": "calm"}}}]
    rows = [(f"m{k}", json.dumps(objects), json.dumps(acts * k), json.dumps(goals)) for k in range(3)]
    memories = spark.createDataFrame(rows, "memory_id string, objects string, actions string, goals string")
    aliases = spark.createDataFrame([("object_aliases", "mug", "tea cup", 1), ("action_aliases", "pour", "fill", 1), ("value_aliases", "cold", "icy", 1)], "kind string, base string, alias string, rank int")
    want = {(r.term, r.memory_id): r.n for r in ingest.build_index(memories, aliases).postings.groupBy("term", "memory_id").agg(F.count("*").alias("n")).collect()}
    got = {(r.term, r.memory_id): r.n for r in ingest.term_counts(memories, aliases).collect()}
    assert got == want and got["value_expanded:icy", "m1"] == 2 and got["statechangesC_value:cold", "m2"] == 2
