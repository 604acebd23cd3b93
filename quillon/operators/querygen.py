"""From a structured query to query terms.

A structured query is a row with objects, actions and conditions as arrays of structs; its terms are exploded
literals, so many queries become terms in one pass. Aliases come as (kind, base, alias, rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import clean_alias, tokens, valid_token
from quillon.functions.units import volume_of

# Terms that can't match anything.
UNMATCHABLE = ("attribute:value", "attribute:unit", "value:unknown", "value:none", "value:0", "value:")
# Weights of the older, weighted form.
WEIGHTS = {"target": 3.0, "context": 2.0, "goal": 10.0, "category": 1.0}

QUERY = """query_id string,
objects array<struct<obj_id:string,template:string,is_person:boolean,shape:string,length:string,width:string,height_thickness:string,weight:string,relation:string,relationr:string,relative_to:string,categories:array<string>,functions:array<string>,materials:array<string>,attributes:map<string,string>>>,
actions array<struct<name:string,verb:string,is_target:boolean,category:string,trajectory:string,participants:array<string>>>,
conditions array<struct<object:string,aspect:string,attribute:string,op:string,value:string,is_goal:boolean>>"""


def _terms(df: DataFrame, terms: Column, weight: float = 1.0, keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return df.select(*keep, F.explode(terms).alias("query_term")).where("query_term is not null").withColumn("weight", F.lit(weight))


def _named(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{prefix}:"), v))


def _fullpath(path: Column, op: Column, value: Column, obj: Column, action: Column | None = None, goal: Column | None = None) -> Column:
    kind = F.when(goal, "goalstate").otherwise("regular") if goal is not None else F.lit("regular")
    body = F.struct(path.alias("path"), op.alias("op"), value.alias("value"), obj.alias("object"), (F.lit(None).cast("string") if action is None else action).alias("action"), kind.alias("source_type"))
    return F.concat(F.lit("fullpath:"), F.to_json(body))


def object_terms(queries: DataFrame) -> DataFrame:
    """Names, words, categories, functions, materials, dimensions, position, weight and attributes of the objects. Persons give only what they perceive."""
    o = queries.select("query_id", F.explode("objects").alias("o")).select("query_id", "o.*").withColumn("is_person", F.coalesce("is_person", F.lit(False)))
    things = o.where("not is_person")
    names = F.array_distinct(F.filter(F.array("template", "obj_id"), lambda x: x.isNotNull()))
    out = _terms(things, F.concat(_named("object", names), _named("object_token", F.flatten(F.transform(names, lambda n: tokens(n))))))
    for prefix, column in (("category", "categories"), ("function", "functions"), ("material", "materials")):
        out = out.unionByName(_terms(things, _named(prefix, F.col(column)), WEIGHTS["category"]))
    sized = things.withColumn("volume", F.concat(volume_of(F.col("length"), F.col("width"), F.col("height_thickness")).cast("string"), F.lit("cm^3")))
    measures = F.array(*(F.concat(F.lit(f"attribute_value:dimensions.{d}="), F.col(d)) for d in ("length", "width", "height_thickness")), F.concat(F.lit("attribute_value:volume="), "volume"), F.concat(F.lit("attribute_value:weight="), "weight"))
    out = out.unionByName(_terms(sized, measures))
    out = out.unionByName(_terms(things, F.array(F.when(F.col("relative_to").isNotNull(), F.concat_ws(":", F.lit("position_unit"), F.coalesce("obj_id", "template"), F.coalesce("relation", F.lit("")), F.coalesce("relationr", F.lit("")), "relative_to")))))
    out = out.unionByName(_terms(things, F.array(F.when(F.col("relative_to").isNotNull(), F.concat(F.lit("spatial:"), F.coalesce("relationr", "relation"), F.lit("("), F.coalesce("obj_id", "template"), F.lit(","), "relative_to", F.lit(")"))))))
    each = o.select("query_id", "is_person", F.coalesce("obj_id", "template").alias("name"), F.explode("attributes").alias("k", "v")).where(~F.col("is_person") | F.col("k").startswith("sensory_perception"))
    path = F.split("k", r"\.")
    attributes = F.concat(F.array(_fullpath(path, F.lit("eq"), F.col("v"), F.col("name"))), _named("attribute", F.filter(path, valid_token)), F.when(valid_token(F.col("v")), F.array(F.concat(F.lit("value:"), "v"))).otherwise(F.array().cast("array<string>")))
    shape = F.array(F.when(F.col("shape").isNotNull() & (F.col("shape") != ""), F.concat(F.lit("value:"), "shape")))
    return out.unionByName(_terms(each, attributes)).unionByName(_terms(things, shape))


def action_terms(queries: DataFrame) -> DataFrame:
    a = queries.select("query_id", F.explode("actions").alias("a")).select("query_id", "a.*").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    verb = F.coalesce("verb", "name")
    named = F.concat(F.array(F.concat(F.lit("action:"), "name"), F.concat(F.when(F.col("is_target"), "verb_target:").otherwise("verb_context:"), verb)), _named("action_token", tokens("name")))
    taking = F.when(F.size("participants") > 0, F.array(_fullpath(F.array(F.lit("participants")), F.lit("in"), F.array_join("participants", ","), F.lit(None).cast("string"), F.col("name")))).otherwise(F.array().cast("array<string>"))
    labels = F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("trajectory:"), "trajectory"))
    target, context = a.where("is_target"), a.where("not is_target")
    return _terms(target, named, WEIGHTS["target"]).unionByName(_terms(context, named, WEIGHTS["context"])).unionByName(_terms(a, F.concat(taking, labels)))


def condition_terms(queries: DataFrame) -> DataFrame:
    c = queries.select("query_id", F.explode("conditions").alias("c")).select("query_id", "c.*").withColumn("is_goal", F.coalesce("is_goal", F.lit(False)))
    path = F.filter(F.concat(F.split(F.coalesce("aspect", F.lit("")), r"\."), F.split("attribute", r"\.")), lambda p: p != "")
    full = F.array(_fullpath(path, F.coalesce("op", F.lit("eq")), F.col("value"), F.col("object"), None, F.col("is_goal")))
    plain = F.concat(_named("attribute", F.filter(path, valid_token)), F.when(valid_token(F.col("value")), F.array(F.concat(F.lit("value:"), "value"))).otherwise(F.array().cast("array<string>")))
    goal = c.where("is_goal")
    return _terms(c, full).unionByName(_terms(c.where("not is_goal"), plain)).unionByName(_terms(goal, _named("goalstate", plain), WEIGHTS["goal"]))


def fallback_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Where a text could not be parsed: its words, as tokens of any kind."""
    kinds = ("attribute_token", "value_token", "object_token", "action_token")
    return _terms(queries, F.flatten(F.array(*(_named(k, tokens(text_col)) for k in kinds))))


def base_terms(terms: DataFrame) -> DataFrame:
    """(query_id, kind, base): what aliases are asked for."""
    kind = F.when(F.col("query_term").startswith("object:"), "object_aliases").when(F.col("query_term").startswith("action:"), "action_aliases").when(F.col("query_term").startswith("attribute:"), "attribute_component_aliases").when(F.col("query_term").startswith("value:"), "value_aliases")
    return terms.select("query_id", kind.alias("kind"), F.regexp_replace("query_term", "^[^:]*:", "").alias("base")).where("kind is not null").distinct()


def with_aliases(terms: DataFrame, aliases: DataFrame, most: int = 10) -> DataFrame:
    """terms with the expanded terms of their aliases, at most ten of a base."""
    prefix = F.create_map(*(F.lit(x) for pair in (("object_aliases", "object"), ("action_aliases", "action"), ("attribute_component_aliases", "attribute"), ("value_aliases", "value")) for x in pair))
    named = aliases.where(F.col("rank") <= most).select(F.concat(F.try_element_at(prefix, "kind"), F.lit(":"), "base").alias("query_term"), F.concat(F.try_element_at(prefix, "kind"), F.lit("_expanded:"), clean_alias("alias")).alias("_e")).where("query_term is not null")
    more = terms.join(named, "query_term").select("query_id", F.col("_e").alias("query_term"), "weight")
    return terms.unionByName(more)


def terms_of(queries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, query_term, weight, position) of structured queries, without the terms that can't match."""
    out = object_terms(queries).unionByName(action_terms(queries)).unionByName(condition_terms(queries))
    if aliases is not None:
        out = with_aliases(out, aliases)
    out = out.where(~F.col("query_term").isin(*UNMATCHABLE)).groupBy("query_id", "query_term").agg(F.max("weight").alias("weight"))
    return out.withColumn("position", F.xxhash64("query_term"))


def resolved_actions(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, place, name, verb, is_target, participants, category, trajectory, source): each asked action, filled in.

    registry: name, verb, category, trajectory, kind ('general' or 'alt'). A target action stays as it is asked; any other takes
    what the registry knows of its name, the general entry before the alternative; a name that is nowhere stays bare.
    """
    a = queries.select("query_id", F.posexplode("actions").alias("place", "a")).select("query_id", "place", "a.*").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    known = registry.groupBy("name").agg(F.min_by(F.struct("verb", "category", "trajectory", "kind"), F.when(F.col("kind") == "general", 0).otherwise(1)).alias("r"))
    met = a.join(known, "name", "left")
    filled = ~F.col("is_target") & F.col("r").isNotNull()
    take = lambda own, theirs: F.when(filled, F.col(theirs)).otherwise(F.col(own))
    source = F.when(F.col("is_target"), "target").when(F.col("r").isNotNull(), F.col("r.kind")).otherwise("bare")
    return met.select("query_id", "place", "name", take("verb", "r.verb").alias("verb"), "is_target", "participants", take("category", "r.category").alias("category"), take("trajectory", "r.trajectory").alias("trajectory"), source.alias("source"))


def resolved_objects(queries: DataFrame) -> DataFrame:
    """(query_id, place, obj_id, template, is_person, ...): the asked objects with an id, and persons told by their template."""
    o = queries.select("query_id", F.posexplode("objects").alias("place", "o")).select("query_id", "place", "o.*")
    return o.withColumn("obj_id", F.coalesce("obj_id", "template")).withColumn("is_person", F.coalesce("is_person", F.lit(False)) | F.coalesce(F.lower("template") == "person", F.lit(False)))


def planning_data(queries: DataFrame, actions: DataFrame) -> DataFrame:
    """(query_id, target_verbs, category, n_objects, initial, goals): what a planner needs of each query; actions: resolved_actions of it."""
    targets = actions.where("is_target").groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("verb", "name").alias("verb")))), lambda x: x["verb"]).alias("target_verbs"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.col("place"))).alias("category"),
    )
    split = lambda goal: F.filter("conditions", lambda c: F.coalesce(c["is_goal"], F.lit(False)) == F.lit(goal))
    told = queries.select("query_id", F.size("objects").alias("n_objects"), split(False).alias("initial"), split(True).alias("goals"))
    return told.join(targets, "query_id", "left").withColumn("target_verbs", F.coalesce("target_verbs", F.array().cast("array<string>")))
