"""Conditions, effects and world states: who changes what, what holds, what is missing.

Conditions are rows (memory_id, action_id, state_type, object, path, op, value) with state_type one of
'precondition', 'old', 'new', 'goal' and their 'conditional_' forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.scoring import compare

CANDIDATES = 10
SUBGOAL_THRESHOLD, SATISFIED_THRESHOLD = 0.3, 0.1
KEY = ["object", "path", "op", "value"]


def sides(changes: DataFrame, conditional: bool = False) -> DataFrame:
    """A row for the old and for the new side of each change, where there is one. changes: ..., old, new."""
    prefix = "conditional_" if conditional else ""
    keep = [c for c in changes.columns if c not in ("old", "new")]
    return changes.select(*keep, F.expr(f"stack(2, '{prefix}old', old, '{prefix}new', new) AS (state_type, value)")).where("value is not null")


def lookup(conditions: DataFrame, wanted: DataFrame, state_type: str) -> DataFrame:
    """Actions whose conditions of a type equal the wanted (object, path, op, value)."""
    return conditions.where(F.col("state_type") == state_type).join(wanted, KEY)


def keep_best(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """Of each key the candidate with the highest score, the least by ties among equals."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def verb_actions(actions: DataFrame, asked: DataFrame) -> DataFrame:
    """(verb, action_id), once each, of the actions whose own or general verb is asked for. actions: action_id, verb, general_verb; asked: verb."""
    names = F.explode(F.array_distinct(F.filter(F.array("verb", "general_verb"), lambda v: v.isNotNull())))
    return actions.select("action_id", names.alias("verb")).join(asked.select("verb").distinct(), "verb").select("verb", "action_id").distinct()


def of_memories(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """rows of the allowed memories (memory_id), all rows without any given."""
    return rows if allowed is None else rows.join(allowed.select("memory_id").distinct(), "memory_id", "left_semi")


def candidates(effects: DataFrame, subgoals: DataFrame, score: Column, n: int = CANDIDATES, threshold: float = SUBGOAL_THRESHOLD) -> DataFrame:
    """The n best actions for each subgoal by their best effect. Both sides share object; score sees g_path, g_op, g_value."""
    pairs = effects.join(subgoals.withColumnsRenamed({"path": "g_path", "op": "g_op", "value": "g_value"}), "object")
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    each = scored.groupBy("subgoal_id", "action_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("subgoal_id").orderBy(F.desc("score"), "action_id"))
    return each.withColumn("place", place).where(F.col("place") <= n)


def satisfied(conditions: DataFrame, state: DataFrame) -> DataFrame:
    """Conditions that a state (object, path, value) fulfils: the semi join."""
    actual = state.select("object", "path", F.col("value").alias("actual"))
    met = conditions.join(actual, ["object", "path"]).where(compare(F.col("actual"), F.coalesce("op", F.lit("eq")), F.col("value")))
    return conditions.join(met.select(*conditions.columns).distinct(), conditions.columns, "left_semi")


def unmet(conditions: DataFrame, state: DataFrame) -> DataFrame:
    actual = state.select("object", "path", F.col("value").alias("actual"))
    met = conditions.join(actual, ["object", "path"]).where(compare(F.col("actual"), F.coalesce("op", F.lit("eq")), F.col("value")))
    return conditions.join(met.select(*conditions.columns).distinct(), conditions.columns, "left_anti")


def final_state(changes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key: what a world looks like after all changes."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_changes"))


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """df with old, the state before: null for the first."""
    return df.withColumn("old", F.lag(state).over(Window.partitionBy(key).orderBy(*order)))


def plan_score(verb: Column, objects: Column, satisfaction: Column, coverage: Column, n_actions: Column, n_errors: Column) -> Column:
    return (0.3 * verb + 0.2 * objects + 0.4 * F.coalesce(satisfaction, F.lit(1.0))) * coverage - 0.005 * n_actions - 0.005 * n_errors


def coverage_group(n_met: Column, n_goals: Column, has_seed: Column) -> Column:
    return F.when(~has_seed, "general").when(n_met >= n_goals, "all").otherwise("partial")


def first_of(df: DataFrame, name: str, *lookups: DataFrame) -> DataFrame:
    """df with found and step: the first of several (name, found) lookups that knows the name, else the name itself as a placeholder."""
    out = df
    for k, one in enumerate(lookups):
        out = out.join(one.select(F.col("name").alias(name), F.col("found").alias(f"_f{k}")), name, "left")
    hits = [F.col(f"_f{k}") for k in range(len(lookups))]
    step = F.lit(len(lookups))
    for k in reversed(range(len(lookups))):
        step = F.when(hits[k].isNotNull(), k).otherwise(step)
    return out.withColumn("found", F.coalesce(*hits, F.col(name))).withColumn("step", step).drop(*(f"_f{k}" for k in range(len(lookups))))


def condition_pairs(effects: DataFrame, subgoals: DataFrame, object_score: Column, path_score: Column, value_score: Column) -> DataFrame:
    """(subgoal_id, action_id, score, reason): an effect's score for a subgoal, and why it is what it is. Both sides share object.

    The scores see the effect's columns and the subgoal's as g_path, g_op, g_value.
    """
    pairs = effects.join(subgoals.withColumnsRenamed({"path": "g_path", "op": "g_op", "value": "g_value"}), "object")
    score = object_score * path_score * F.when(value_score > 0, value_score).otherwise(0.2)
    reason = F.when(path_score == 0, "another path").when(value_score == 0, "another value").when(object_score < 1, "a like object").when(value_score < 1, "a near value").otherwise("equal")
    return pairs.select("subgoal_id", "action_id", F.when(path_score > 0, score).otherwise(0.0).alias("score"), reason.alias("reason"))
