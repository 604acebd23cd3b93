"""Data-quality jobs over registries and memories: missing entries, conversions, repairs, goals.

Registries: general (general, verb, category, trajectory, default_duration, sub_actions array) and alts (alt,
general, verb, sub_actions array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.scoring import compare
from quillon.functions.vocabulary import SPATIAL_RELATIONS


def linked_storage(general: DataFrame, alts: DataFrame) -> DataFrame:
    """(general, alt, verb, sub_actions, implicit): every general with its alts, and an implicit alt of its own name where it has none."""
    own = alts.join(general.select("general", F.col("verb").alias("_v")), "general").select("general", "alt", F.coalesce("verb", "_v").alias("verb"), "sub_actions", F.lit(False).alias("implicit"))
    bare = general.join(alts.select("general").distinct(), "general", "left_anti").select("general", F.col("general").alias("alt"), "verb", "sub_actions", F.lit(True).alias("implicit"))
    return own.unionByName(bare)


def verb_storage(linked: DataFrame) -> DataFrame:
    """(verb, generals, n_alts) from the linked storage."""
    return linked.where("verb is not null and verb <> ''").groupBy("verb").agg(F.array_sort(F.collect_set("general")).alias("generals"), F.countDistinct("alt").alias("n_alts"))


def missing_verbs(general: DataFrame) -> DataFrame:
    return general.where("verb is null or trim(verb) = ''")


def resolve_alts(actions: DataFrame, linked: DataFrame) -> DataFrame:
    """actions (instance_id, template, sub_names array) with general and alt: by alt name, the only alt, the equal sub-action sequence, or the first alt.

    The alternatives are reduced to a row for each name, general action and sequence first, so an instance meets three rows at most.
    """
    named = linked.groupBy(F.col("alt").alias("template")).agg(F.min("general").alias("_named"))
    first = linked.groupBy(F.col("general").alias("template")).agg(F.min("alt").alias("_first"), F.count("*").alias("_n"))
    same = linked.groupBy(F.col("general").alias("template"), F.col("sub_actions").alias("sub_names")).agg(F.min("alt").alias("_same"))
    met = actions.join(named, "template", "left").join(first, "template", "left").join(same, ["template", "sub_names"], "left")
    how = F.when(F.col("_named").isNotNull(), 0).when(F.col("_n") == 1, 1).when(F.col("_same").isNotNull(), 2).when(F.col("_first").isNotNull(), 3)
    alt = F.when(F.col("how") == 0, F.col("template")).when(F.col("how") == 2, F.col("_same")).otherwise(F.col("_first"))
    general = F.when(F.col("how") == 0, F.col("_named")).when(F.col("how").isNotNull(), F.col("template"))
    return met.withColumn("how", how).select(*(F.col(c) for c in actions.columns), general.alias("general"), alt.alias("alt"), "how")


def missing_templates(actions: DataFrame, linked: DataFrame) -> DataFrame:
    """(template, n, atomic, addable): templates that no registry knows; addable if used once, or always without sub-actions."""
    known = linked.select(F.explode(F.array("general", "alt")).alias("template")).distinct()
    unknown = actions.join(known, "template", "left_anti").groupBy("template").agg(F.count("*").alias("n"), F.bool_and(F.size("sub_names") == 0).alias("atomic"))
    return unknown.withColumn("addable", (F.col("n") == 1) | F.col("atomic"))


def convert_sub_actions(registry: DataFrame, linked: DataFrame, key: str = "alt") -> DataFrame:
    """registry rows (key, sub_actions) with each sub-action's general replaced by its only alt; unresolved names are kept and listed."""
    sole = linked.groupBy("general").agg(F.min("alt").alias("sole"), F.count("*").alias("n")).where("n = 1").select(F.col("general").alias("s"), "sole")
    names = linked.select(F.col("alt").alias("s"), F.lit(True).alias("is_alt")).distinct()
    each = registry.select(key, F.posexplode("sub_actions").alias("k", "s")).join(sole, "s", "left").join(names, "s", "left")
    done = each.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("sole", "s").alias("s")))), lambda x: x["s"]).alias("converted"),
        F.array_sort(F.collect_set(F.when(F.col("sole").isNull() & F.col("is_alt").isNull(), F.col("s")))).alias("unresolved"),
    )
    empty = F.array().cast("array<string>")
    return registry.join(done, key, "left").withColumn("converted", F.coalesce("converted", empty)).withColumn("unresolved", F.coalesce("unresolved", empty))


def sub_action_mismatches(linked: DataFrame) -> DataFrame:
    """Generals whose alts name different sub-actions."""
    return linked.groupBy("general").agg(F.countDistinct(F.to_json("sub_actions")).alias("n_sequences"), F.count("*").alias("n_alts")).where("n_sequences > 1")


def malformed(memories: DataFrame) -> DataFrame:
    """(memory_id, issue) of envelopes that lack a part or whose part is no list."""
    checks = []
    for part in ("objects", "actions", "goals"):
        checks += [F.when(F.col(part).isNull(), F.lit(f"no {part}")), F.when(F.col(part).isNotNull() & ~F.col(part).startswith("["), F.lit(f"{part} is no list"))]
    found = F.filter(F.array(*checks, F.when(F.coalesce(F.trim("activity"), F.lit("")) == "", F.lit("no activity"))), lambda x: x.isNotNull())
    return memories.select("memory_id", F.explode(found).alias("issue"))


def without_goals(memories: DataFrame) -> DataFrame:
    return memories.where("goals is null or goals in ('[]', '')").select("memory_id", "activity")


def incomplete_objects(objects: DataFrame) -> DataFrame:
    """(memory_id, obj_id, missing): which of the defining attributes an object lacks."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    lack = [F.when(F.size(c) == 0, F.lit(c)) for c in ("categories", "functions", "materials", "relative_to")] + [F.when(empty(c), F.lit(c)) for c in ("shape", "length", "width", "height_thickness", "weight")]
    return objects.select("memory_id", "obj_id", F.filter(F.array(*lack), lambda x: x.isNotNull()).alias("missing")).where("size(missing) > 0")


def filled(objects: DataFrame, templates: DataFrame) -> DataFrame:
    """objects with shape, dimensions and weight from their template, or the fixed default, where they have none."""
    named = templates.select("template", *(F.col(c).alias(f"_{c}") for c in ("shape", "length", "width", "height_thickness", "weight")))
    out = objects.join(named, "template", "left")
    for c, default in (("shape", "unknown"), ("length", "0cm"), ("width", "0cm"), ("height_thickness", "0cm"), ("weight", "0g")):
        out = out.withColumn(c, F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}"), F.lit(default))).drop(f"_{c}")
    return out


def with_placeholders(participants: DataFrame, objects: DataFrame) -> DataFrame:
    """objects with a placeholder row for each participant (memory_id, obj_id) that is no object of its memory."""
    lost = participants.select("memory_id", "obj_id").distinct().join(objects.select("memory_id", "obj_id"), ["memory_id", "obj_id"], "left_anti")
    return objects.unionByName(lost.withColumn("template", F.col("obj_id")).withColumn("unresolved", F.lit(True)), allowMissingColumns=True)


def set_restricted(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """records (relation, relationr) with relationr from the mapping (relation, restricted) where it is missing; others keep theirs."""
    named = mapping.select(F.lower(F.trim("relation")).alias("_r"), F.col("restricted").alias("_m")).groupBy("_r").agg(F.min("_m").alias("_m"))
    out = records.withColumn("_k", F.lower(F.trim("relation"))).join(named, F.col("_k") == F.col("_r"), "left")
    own = F.when(F.col("relationr").isin(*SPATIAL_RELATIONS, "none", "from"), F.col("relationr"))
    return out.withColumn("relationr", F.coalesce(own, "_m")).drop("_k", "_r", "_m")


def unmapped(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """(relation, n) of relations that have neither a restricted form nor an entry in the mapping."""
    done = set_restricted(records, mapping)
    return done.where("relationr is null").groupBy("relation").agg(F.count("*").alias("n"))


def repaired_mapping(mapping: DataFrame, key: str = "id") -> DataFrame:
    """A mapping whose keys came back as text: cast to numbers where they are, of one key the first."""
    return mapping.withColumn(key, F.coalesce(F.regexp_extract(F.col(key).cast("string"), r"^\s*(-?\d+)(\.0+)?\s*$", 1).try_cast("long"), F.lit(None).cast("long"))).where(F.col(key).isNotNull()).dropDuplicates([key])


def goal_support(goals: DataFrame, paths: DataFrame) -> DataFrame:
    """goals (memory_id, goal_id, object, path, op, value) with support and source from a catalogue of (memory_id, object, path, value, source).

    The path must be equal, or else be a suffix; of several the value by rank new, final, old, object, condition.
    """
    rank = F.create_map(*(F.lit(x) for pair in (("new", 0), ("final", 1), ("old", 2), ("object", 3), ("condition", 4)) for x in pair))
    c = paths.select("memory_id", "object", F.col("path").alias("c_path"), F.col("value").alias("c_value"), "source", F.coalesce(F.try_element_at(rank, "source"), F.lit(9)).alias("r"))
    near = goals.join(c, ["memory_id", "object"]).where((F.col("c_path") == F.col("path")) | F.col("c_path").endswith(F.concat(F.lit("."), "path"))).withColumn("exact", F.col("c_path") == F.col("path"))
    held = near.where(compare(F.col("c_value"), F.col("op"), F.col("value")))
    best = held.withColumn("_n", F.row_number().over(Window.partitionBy("memory_id", "goal_id").orderBy(F.desc("exact"), "r", "c_value"))).where("_n = 1").select("memory_id", "goal_id", "c_path", "source")
    return goals.join(best, ["memory_id", "goal_id"], "left").withColumn("supported", F.col("source").isNotNull())


def new_goals(goals: DataFrame, existing: DataFrame) -> DataFrame:
    """goals that a memory does not have yet, by object, path, operator and value."""
    key = ["memory_id", "object", "path", "op", "value"]
    return goals.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def excluded_activities(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Activities that no memory has yet, in any spelling of case and space."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return candidates.join(done.select(norm("activity").alias("_a")).distinct(), norm("activity") == F.col("_a"), "left_anti")


def expansion_terms(terms: DataFrame, n: int, seed: int = 3) -> DataFrame:
    """n indexed terms by a seeded hash: the next ones to invent activities around."""
    return terms.orderBy(F.xxhash64(F.lit(seed), "term"), "term").limit(n)


def verb_usage(actions: DataFrame) -> DataFrame:
    """(verb, memories, templates, n) of actions with a verb."""
    return actions.where("verb is not null").groupBy("verb").agg(F.array_sort(F.collect_set("memory_id")).alias("memories"), F.array_sort(F.collect_set("template")).alias("templates"), F.count("*").alias("n"))


def readable(conditions: DataFrame) -> DataFrame:
    """(memory_id, line) of conditions as text."""
    op = F.when(F.col("op").isin("ne", "!="), "is not").when(F.col("op") == "eq", "is").otherwise(F.col("op"))
    return conditions.select("memory_id", F.format_string("%s: %s of %s %s %s", "state_type", F.array_join("path", "."), "object", op, "value").alias("line"))


def duration_issue(own: Column) -> Column:
    return F.when(own.isNull(), "missing").when(own == 0, "zero").when(own < 0, "negative")


def converted(actions: DataFrame, linked: DataFrame) -> DataFrame:
    """Raw actions (instance_id, template, sub_names) as runtime ones: with the general action, the alternative and its verb, and a note where none is known."""
    found = resolve_alts(actions, linked)
    verbs = linked.select("general", "alt", "verb")
    note = F.when(F.col("alt").isNull(), "unknown template").when(F.col("how") == 3, "first of several alternatives")
    return found.join(verbs, ["general", "alt"], "left").select("instance_id", "template", "general", "alt", "verb", note.alias("note"))


def added_templates(general: DataFrame, unknown: DataFrame) -> DataFrame:
    """The general registry with an entry for each addable unknown template, its verb left open; unknown: missing_templates."""
    new = unknown.where("addable").select(F.col("template").alias("general"), F.lit(None).cast("string").alias("verb"), F.array().cast("array<string>").alias("sub_actions"))
    return general.select("general", "verb", "sub_actions").unionByName(new.join(general.select("general"), "general", "left_anti"))


def preconversion_report(unknown: DataFrame, alias_issues: DataFrame) -> DataFrame:
    """(part, item, n): what a conversion would trip over, missing templates and alias issues in one report."""
    first = unknown.select(F.lit("missing template").alias("part"), F.col("template").alias("item"), F.col("n"))
    second = alias_issues.groupBy(F.col("issue").alias("item")).agg(F.count("*").alias("n")).select(F.lit("alias issue").alias("part"), "item", "n")
    return first.unionByName(second)


def verb_diagnosis(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """(verb, n, known): how often each asked verb is in the index."""
    counted = indexed.groupBy("verb").agg(F.count("*").alias("n"))
    return asked.select("verb").distinct().join(counted, "verb", "left").select("verb", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("known"))
