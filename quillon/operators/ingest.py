"""From raw memories to the engine's tables, and from them to an index."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import vocabulary as V
from quillon.functions.embedding import Embedder, hashed_ngrams
from quillon.functions.text import among, numeric_string, term_phrase, term_prefix, tokens, valid_token
from quillon.functions.units import number_of, unit_of, volume_of
from quillon.operators import aliases as A
from quillon.operators import flatten, postings, timeline
from quillon.operators.search import Index
from quillon.session import stored

DIMENSIONS = ("length", "width", "height_thickness")
#: Keys of an object that describe it as a whole; all others are attributes of the instance.
DEFINING = ("categories", "functions", "materials", "shape", "dimensions", "position", "aliases")


def _get(column: str, path: str) -> Column:
    return F.get_json_object(column, f"$.{path}")


def _list(column: str, path: str) -> Column:
    """A list field, a single text as a list of one; never null."""
    raw = _get(column, path)
    return F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull() & (raw != ""), F.array(raw)), F.array().cast("array<string>"))


def _measure(column: str, path: str) -> Column:
    """A {value, unit} field, or a plain one, as a measurement string."""
    return F.coalesce(F.concat(_get(column, f"{path}.value"), F.coalesce(_get(column, f"{path}.unit"), F.lit(""))), F.when(~_get(column, path).startswith("{"), _get(column, path)))


def objects(memories: DataFrame) -> DataFrame:
    """A row for each object; of one id in a memory the last counts."""
    each = memories.select("memory_id", F.posexplode(F.from_json("objects", "array<string>")).alias("obj_ix", "o"))
    own = F.coalesce(_get("o", "id"), _get("o", "obj_id"), _get("o", "template"), _get("o", "template_name"))
    rows = each.select(
        "memory_id", own.alias("obj_id"), F.col("obj_ix").cast("long").alias("obj_ix"), F.coalesce(_get("o", "template"), _get("o", "template_name"), own).alias("template"), _get("o", "shape").alias("shape"),
        *(_measure("o", f"dimensions.{d}").alias(d) for d in DIMENSIONS), F.coalesce(_measure("o", "weight"), _measure("o", "mass")).alias("weight"),
        _get("o", "position.relation").alias("relation"), _get("o", "position.relationr").alias("relationr"), _list("o", "position.relative_to").alias("relative_to"),
        _list("o", "aliases").alias("aliases"), _list("o", "categories").alias("categories"), _list("o", "functions").alias("functions"), _list("o", "materials").alias("materials"),
        F.coalesce(_get("o", "overrides"), F.lit("{}")).alias("overrides"), F.coalesce(_get("o", "template_defaults"), F.lit("{}")).alias("template_defaults"),
    )
    last = Window.partitionBy("memory_id", "obj_id").orderBy(F.desc("obj_ix"))
    return rows.where("obj_id is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def actions(memories: DataFrame) -> DataFrame:
    """A row for each action of each tree, with its fields; `body` keeps the rest."""
    rows = flatten.action_trees(memories).where("template is not null")
    number = lambda p: _get("body", p).try_cast("double")
    kind = F.coalesce(_get("body", "temporal_type"), F.lit("sequential"))
    own = timeline.own_duration(kind, number("duration"), number("cycle_duration"), number("repetitions"))
    return rows.select("*", kind.alias("temporal_type"), own.alias("own"), number("start_offset").alias("start_offset"), _get("body", "verb").alias("verb"), _get("body", "general_template").alias("general_template"), _get("body", "alt").alias("alt"), _get("body", "action_category").alias("category"), _get("body", "kinematic_trajectory").alias("trajectory"), _list("body", "participants").alias("participants"), _list("body", "tags").alias("tags"))


_CONDITION = "array<struct<object:string,aspect:string,attribute:string,op:string,value:string,old:string,new:string,changes:string>>"


def _entries(field: str) -> Column:
    return F.from_json(_get("body", field), _CONDITION)


def conditions(acts: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, action_id, action, state_type, object, path, op, value, items, seq) of preconditions, changes, conditional changes and goals."""
    path = flatten.condition_path()
    base = ["memory_id", F.col("instance_id").alias("action_id"), F.col("template").alias("action"), F.col("seq").alias("action_seq")]
    row = lambda k, c, kind, v: F.struct(k.cast("int").alias("k"), c.alias("c"), F.lit(kind).alias("state_type"), v.alias("v"))
    sides = lambda k, c, mark: F.array(*(row(k, c, mark + side, c[side]) for side in ("old", "new")))
    none_held = F.array().cast("array<struct<k:int,c:struct<object:string,aspect:string,attribute:string,op:string,value:string,old:string,new:string,changes:string>,state_type:string,v:string>>")
    lists = acts.select(
        *base, _entries("preconditions").alias("_before"), F.concat(*(F.coalesce(_entries(f), F.array().cast(_CONDITION)) for f in ("changes", "changes_per_cycle", "changes_total"))).alias("_changed"), _entries("conditional_changes").alias("_guarded"),
    )
    before = F.transform("_before", lambda c, i: row(i, c, "precondition", c["value"]))
    changed = F.flatten(F.transform("_changed", lambda c, i: sides(i, c, "")))
    guarded = F.flatten(F.flatten(F.transform("_guarded", lambda g, i: F.transform(F.coalesce(F.from_json(g["changes"], _CONDITION), F.array().cast(_CONDITION)), lambda c, j: sides(i * 1000 + j, c, "conditional_")))))
    each = F.explode(F.concat(*(F.coalesce(rows, none_held) for rows in (before, changed, guarded)))).alias("e")  # each action is read once
    out = lists.select("memory_id", "action_id", "action", "action_seq", each).select("memory_id", "action_id", "action", "action_seq", "e.k", "e.c", "e.state_type", "e.v")
    goals = memories.select("memory_id", F.lit(None).cast("string").alias("action_id"), F.lit(None).cast("string").alias("action"), F.lit(1 << 40).cast("long").alias("action_seq"), F.posexplode(F.from_json("goals", "array<struct<object:string,target_object:string,aspect:string,attribute:string,op:string,value:string>>")).alias("k", "g"))
    none = F.lit(None).cast("string")
    goal_struct = F.struct(F.coalesce("g.object", "g.target_object").alias("object"), F.col("g.aspect").alias("aspect"), F.col("g.attribute").alias("attribute"), F.col("g.op").alias("op"), F.col("g.value").alias("value"), none.alias("old"), none.alias("new"), none.alias("changes"))
    out = out.unionByName(goals.select("memory_id", "action_id", "action", "action_seq", "k", goal_struct.alias("c"), F.lit("goal").alias("state_type"), F.col("g.value").alias("v")))
    out = out.where("c.object is not null and c.attribute is not null and v is not null")
    rank = F.create_map(*(F.lit(x) for pair in (("precondition", 0), ("new", 1), ("old", 2), ("conditional_new", 3), ("conditional_old", 4), ("goal", 5)) for x in pair))
    seq = F.struct("action_seq", rank[F.col("state_type")].alias("r"), "k")
    items = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>"))
    return out.select("memory_id", "action_id", "action", "state_type", F.col("c.object").alias("object"), path(F.col("c.aspect"), F.col("c.attribute")).alias("path"), F.coalesce("c.op", F.lit("eq")).alias("op"), F.col("v").alias("value"), items.alias("items"), seq.alias("place"))


def object_leaves(objs: DataFrame) -> DataFrame:
    """(memory_id, obj_id, template, obj_ix, k, path, value, kind) of every object's overrides, dimensions, volume and weight."""
    volume = volume_of(*(F.col(d) for d in DIMENSIONS))
    fixed = F.array(
        *(F.struct(F.array(F.lit("dimensions"), F.lit(d)).alias("path"), F.col(d).alias("value"), F.lit("measure").alias("kind")) for d in DIMENSIONS),
        F.struct(F.array(F.lit("volume")).alias("path"), F.concat(volume.cast("string"), F.lit("cm^3")).alias("value"), F.lit("measure").alias("kind")),
        F.struct(F.array(F.lit("weight")).alias("path"), F.col("weight").alias("value"), F.lit("str").alias("kind")),
    )
    free = flatten.flatten_json()(F.col("overrides"))
    return objs.select("memory_id", "obj_id", "template", "obj_ix", F.posexplode(F.concat(free, fixed)).alias("k", "l")).select("memory_id", "obj_id", "template", "obj_ix", "k", "l.path", "l.value", "l.kind").where("value is not null")


def fullpath(objs: DataFrame, acts: DataFrame, conds: DataFrame) -> DataFrame:
    """Full-path entries of objects, participants and conditions, in posting order."""
    none, no_items = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    own = object_leaves(objs).select(
        "memory_id", none.alias("action"), F.col("obj_id").alias("object"), "path", F.lit("eq").alias("op"), "value", no_items.alias("items"), none.alias("state_type"),
        F.concat_ws("|", F.lit("object"), "obj_id", "template").alias("src"), F.lit(False).alias("is_goal"), F.struct(F.lit(0).alias("a"), F.col("obj_ix").alias("b"), F.col("k").cast("long").alias("c")).alias("_o"),
    )
    taking = acts.where(F.size("participants") > 0).select(
        "memory_id", F.col("template").alias("action"), none.alias("object"), F.array(F.lit("participants")).alias("path"), F.lit("in").alias("op"), F.array_join("participants", ",").alias("value"), F.col("participants").alias("items"), none.alias("state_type"),
        F.concat_ws("|", F.lit("action"), "instance_id", "template").alias("src"), F.lit(False).alias("is_goal"), F.struct(F.lit(1).alias("a"), F.col("seq").alias("b"), F.lit(-1).cast("long").alias("c")).alias("_o"),
    )
    goal = F.col("state_type") == "goal"
    held = conds.select(
        "memory_id", "action", "object", "path", "op", "value", "items", "state_type",
        F.when(goal, F.concat_ws("|", F.lit("goal_state"), "object")).otherwise(F.concat_ws("|", F.lit("action"), "action_id", "action")).alias("src"), goal.alias("is_goal"),
        F.struct(F.lit(1).alias("a"), F.col("place.action_seq").alias("b"), (F.col("place.r").cast("long") * 1_000_000 + F.col("place.k")).alias("c")).alias("_o"),
    )
    return own.unionByName(taking).unionByName(held)


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """seq: a number that ascends in posting order within a memory and is the same whatever the partitions."""
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy(*order))
    return df.withColumn("seq", place.cast("long"))


def _base_rows(objs: DataFrame, acts: DataFrame, entries: DataFrame) -> DataFrame:
    """(memory_id, term, k, src, is_goal, _o): the postings without their expansions, not numbered yet."""
    term = lambda prefix, value: F.struct(F.concat(F.lit(f"{prefix}:"), value).alias("term"), F.lit(prefix.split("_")[0]).alias("t"))
    several = lambda prefix, values: F.transform(values, lambda v: term(prefix, v))
    listed = lambda *parts: F.filter(F.concat(*parts), lambda x: x["term"].isNotNull())
    names = F.concat(F.array("template", "obj_id"), F.col("aliases"))
    of_object = listed(
        several("object", names), several("object_token", F.flatten(F.transform(names, lambda n: tokens(n)))),
        several("alias", F.col("aliases")), several("category", F.col("categories")), several("function", F.col("functions")), several("material", F.col("materials")),
    )
    first = objs.select("memory_id", F.posexplode(of_object).alias("k", "p"), F.concat_ws("|", F.lit("object"), "obj_id", "template").alias("src"), F.lit(False).alias("is_goal"), F.struct(F.lit(0).alias("a"), F.col("obj_ix").alias("b"), F.lit(-1).cast("long").alias("c")).alias("_o"))
    labels = F.array_distinct(F.filter(F.array("template", "general_template", "alt"), lambda x: x.isNotNull()))
    verb = F.filter(F.array("verb"), lambda x: x.isNotNull())
    of_action = listed(several("action", labels), several("verb", verb), several("action_token", F.flatten(F.transform(F.concat(verb, labels), lambda n: tokens(n)))))
    second = acts.select("memory_id", F.posexplode(of_action).alias("k", "p"), F.concat_ws("|", F.lit("action"), "instance_id", "template").alias("src"), F.lit(False).alias("is_goal"), F.struct(F.lit(1).alias("a"), F.col("seq").alias("b"), F.lit(-2).cast("long").alias("c")).alias("_o"))
    conditional = F.coalesce(F.col("state_type").startswith("conditional_"), F.lit(False))
    parts = F.filter("path", lambda c: valid_token(c) & ~among(c, V.STRUCTURAL_COMPONENTS))
    value = F.filter(F.array("value"), lambda v: valid_token(v) & ~numeric_string(v))

    def of_entry(mark: str) -> Column:
        return F.concat(several(f"{mark}attribute", parts), several(f"{mark}attribute_token", F.flatten(F.transform(parts, lambda c: tokens(c)))), several(f"{mark}value", value), several(f"{mark}value_token", F.flatten(F.transform(value, lambda c: tokens(c)))))

    content = entries.where("not (size(path) = 1 and path[0] = 'participants')")
    third = content.select("memory_id", F.posexplode(F.when(conditional, of_entry(V.CONDITIONAL)).otherwise(of_entry(""))).alias("k", "p"), "src", "is_goal", "_o")
    return first.unionByName(second).unionByName(third).select("memory_id", F.col("p.term").alias("term"), "k", "src", "is_goal", "_o")


def _expanded(rows: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, Column]:
    """rows of base terms with each of their aliases, and the terms of one: a base term is followed by those of its aliases, whole and by word."""
    kinds = F.create_map(*(F.lit(x) for pair in (("object", "object_aliases"), ("action", "action_aliases"), ("attribute", "attribute_component_aliases"), ("value", "value_aliases")) for x in pair))
    plain = F.regexp_replace(term_prefix("term"), f"^{V.CONDITIONAL}", "")
    bases = rows.withColumn("kind", F.try_element_at(kinds, plain)).withColumn("base", term_phrase("term")).where("kind is not null")
    spread = bases.join(dictionary.select("kind", "base", "alias", "rank"), ["kind", "base"])
    return spread, F.concat(F.array(F.concat(term_prefix("term"), F.lit("_expanded:"), "alias")), F.transform(tokens("alias"), lambda w: F.concat(term_prefix("term"), F.lit("_expanded_token:"), w)))


def term_counts(memories: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, memory_id, n): how many postings of a term each memory has in the index, without numbering or writing them.

    Postings are counted before the shuffle, and expansions are made of the counts, as a term's depend on nothing else.
    """
    objs, acts = stored(objects(memories)), stored(actions(memories))
    rows = _base_rows(objs, acts, fullpath(objs, acts, conditions(acts, memories)))
    each = stored(rows.groupBy("term", "memory_id").agg(F.count("*").alias("n")))
    spread, expanded = _expanded(each, dictionary)
    more = spread.select(F.explode(expanded).alias("term"), "memory_id", "n")
    return each.unionByName(more).groupBy("term", "memory_id").agg(F.sum("n").alias("n"))


def posting_rows(objs: DataFrame, acts: DataFrame, entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All postings, numbered: names, aliases, tokens, path components and values, each with its expansions."""
    rows = stored(_base_rows(objs, acts, entries))  # read twice below
    spread, expanded = _expanded(rows, dictionary)
    more = spread.select("memory_id", "k", "src", "is_goal", "_o", F.col("rank").alias("r"), F.posexplode(expanded).alias("j", "term"))
    both = rows.withColumn("r", F.lit(0)).withColumn("j", F.lit(0)).unionByName(more.select("memory_id", "term", "k", "src", "is_goal", "_o", "r", "j"))
    kind = F.regexp_replace(F.regexp_replace(term_prefix("term"), f"^{V.CONDITIONAL}", ""), "(_expanded)?(_token)?$", "")
    typed = F.when(kind.isin("attribute", "value", "action", "verb"), kind).otherwise("object")
    numbered = _numbered(both, [F.col("_o"), F.col("k"), F.col("r"), F.col("j"), F.col("term")])
    return numbered.select("term", term_prefix("term").alias("prefix"), term_phrase("term").alias("phrase"), "memory_id", "src", typed.alias("term_type"), "is_goal", "seq")


def build_index(memories: DataFrame, dictionary: DataFrame, embed: Embedder | None = None, as_shipped: bool = False) -> Index:
    """An index over memory envelopes (see sources.memories) and an alias dictionary (kind, base, alias, rank).

    Postings, paths and shares are written to the shared folder, as every search reads them again. as_shipped drops the
    postings whose prefix the shipped index does not keep.
    """
    objs, acts = stored(objects(memories)), stored(actions(memories))  # walked once, read by each branch below
    entries = stored(fullpath(objs, acts, conditions(acts, memories)))
    posted = posting_rows(objs, acts, entries, dictionary)
    posted = stored(postings.whitelisted(posted) if as_shipped else posted)
    freq = stored(postings.shares(posted.select("term", "memory_id")))
    paths = _numbered(entries, [F.col("_o"), F.array_join("path", "."), F.col("value"), F.col("state_type")]).drop("_o")
    paths = stored(paths.withColumn("seq", F.xxhash64("memory_id", "seq")))  # one number for an entry in the whole index
    sizes = object_leaves(objs).where("kind = 'measure'").select("memory_id", F.col("obj_id").alias("object_id"), F.array_join("path", ".").alias("path"), number_of(F.col("value")).alias("numeric"), unit_of(F.col("value")).alias("unit"), F.concat_ws("|", F.lit("object"), "obj_id", "template").alias("src"), F.col("obj_ix").alias("seq")).where("numeric is not null")
    placed = objs.select("memory_id", "obj_id", "template", "relation", "relationr", "relative_to", "obj_ix")
    return Index(posted, paths, sizes, placed, dictionary, A.alias_terms(dictionary), freq, postings.unmatchable_components(freq), embed or hashed_ngrams())


# Keys whose leaves tell nothing, and the weight of a leaf that no other walk takes.
SKIPPED_KEYS = ("id", "obj_id", "instance_id", "memory_id")
LEAF_WEIGHT = 0.3


def catch_all(documents: DataFrame, json_col: str, keep: list[str], skipped: tuple[str, ...] = SKIPPED_KEYS) -> DataFrame:
    """(keep, term, weight) of every leaf of a JSON text: `path=value` but for skipped keys, stop and unit words, and numbers."""
    leaf = documents.select(*keep, F.explode(flatten.flatten_json(measures=False)(F.col(json_col))).alias("l")).select(*keep, "l.path", "l.value")
    sound = ~F.element_at("path", -1).isin(*skipped) & valid_token(F.lower("value")) & ~numeric_string("value")
    return leaf.where(sound).select(*keep, F.concat(F.array_join("path", "."), F.lit("="), "value").alias("term"), F.lit(LEAF_WEIGHT).alias("weight"))


def isolated_terms(objs: DataFrame, acts: DataFrame) -> DataFrame:
    """(memory_id, term): the names that stand for themselves: actions, templates, ids, categories, trajectories, tags."""
    named = lambda prefix, value: F.concat(F.lit(f"{prefix}:"), value)
    of_object = F.concat(F.array(named("template", F.col("template")), named("obj_id", F.col("obj_id"))), F.transform("categories", lambda c: named("category", c)))
    of_action = F.concat(F.array(named("action", F.col("template")), named("trajectory", F.col("trajectory")), named("category", F.col("category"))), F.transform("tags", lambda t: named("tag", t)))
    rows = objs.select("memory_id", F.explode(of_object).alias("term")).unionByName(acts.select("memory_id", F.explode(of_action).alias("term")))
    return rows.where("term is not null")


def path_values(objs: DataFrame, conds: DataFrame) -> DataFrame:
    """(memory_id, path, value, source): every path that is known with each of its values, of objects (positions too) and of conditions."""
    own = object_leaves(objs).select("memory_id", F.array_join("path", ".").alias("path"), "value", F.lit("object").alias("source"))
    place = F.explode(F.array(*(F.struct(F.lit(f"position.{n}").alias("path"), F.col(n).alias("value")) for n in ("relation", "relationr")), F.struct(F.lit("position.relative_to").alias("path"), F.array_join("relative_to", ",").alias("value"))))
    placed = objs.where("relation is not null or relationr is not null or size(relative_to) > 0").select("memory_id", place.alias("p")).select("memory_id", "p.path", "p.value", F.lit("object").alias("source"))
    kind = F.regexp_replace("state_type", "^conditional_", "")
    source = F.when(kind == "precondition", "condition").when(kind == "goal", "final").otherwise(kind)
    held = conds.select("memory_id", F.array_join("path", ".").alias("path"), "value", source.alias("source"))
    return own.unionByName(placed).unionByName(held).where("value is not null and value <> ''").distinct()


SPATIAL = "memory_id string, obj_id string, path string, relation string, relationr string, relative_to array<string>"


def spatial_records(memories: DataFrame) -> DataFrame:
    """SPATIAL rows: every part of an object's JSON with a relation and what it relates to, at any depth, with its path."""

    def walk(node: object, owner: str | None, path: str):
        if isinstance(node, dict):
            owner = node.get("id") or node.get("obj_id") or owner
            if "relation" in node and "relative_to" in node:
                to = node["relative_to"]
                yield owner, path, node.get("relation"), node.get("relationr"), [str(x) for x in (to if isinstance(to, list) else [to]) if x not in (None, "")]
            for k, v in node.items():
                yield from walk(v, owner, f"{path}.{k}" if path else str(k))
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, owner, f"{path}.{i}" if path else str(i))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, *r) for m, text in zip(pdf["memory_id"], pdf["objects"], strict=True) for r in walk(json.loads(text) if text else [], None, "")]
            yield pd.DataFrame(rows, columns=["memory_id", "obj_id", "path", "relation", "relationr", "relative_to"])

    return memories.select("memory_id", "objects").mapInPandas(run, SPATIAL)


def template_listing(acts: DataFrame) -> DataFrame:
    """(memory_id, template, n): the action templates of each memory, and how often."""
    return acts.groupBy("memory_id", "template").agg(F.count("*").alias("n"))


def readable_goals(conds: DataFrame) -> DataFrame:
    """(memory_id, text): the goals of each memory as lines."""
    line = F.concat("object", F.lit("."), F.array_join("path", "."), F.when(F.col("op").isin("ne", "!="), " is not ").otherwise(" is "), "value")
    return conds.where("state_type = 'goal'").groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def readable_actions(acts: DataFrame) -> DataFrame:
    """(memory_id, instance_id, text): each action as a line, deeper ones indented."""
    line = F.concat(F.expr("repeat('  ', depth)"), "template", F.when(F.size("participants") > 0, F.concat(F.lit(" ("), F.array_join("participants", ", "), F.lit(")"))).otherwise(""))
    return acts.select("memory_id", "instance_id", line.alias("text"))
