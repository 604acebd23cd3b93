"""Plan traces as reports: lines of text in order, made where the plans are.

A line has a place (part, group, plan, line), so a report is sorted when it is written and no plan is gathered before. Each plan's lines
are one array of its row; actions, substitutions and unmet goals are put into arrays by plan first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Titles and rules of the report layouts.
GROUPS = {"all": "VERB-GUIDED PLANS — COVERING ALL TARGET ACTIONS", "partial": "VERB-GUIDED PLANS — COVERING SOME TARGET ACTIONS", "general": "GENERAL BACKWARD-CHAINING PLANS"}
COVERAGE = {"all": "verb_guided_all", "partial": "verb_guided_partial", "general": "general"}
DOUBLE, HASHES, SINGLE, LONG = "=" * 80, "#" * 80, "-" * 40, "-" * 80
#: Plans of a group that a report tells.
MOST = 10


def number(x: Column) -> Column:
    return F.format_string("%.4f", F.coalesce(x.cast("double"), F.lit(0.0)))


def _text(x: Column, none: str = "None") -> Column:
    return F.coalesce(x.cast("string"), F.lit(none))


def _truth(x: Column) -> Column:
    return F.when(x, "True").when(~x, "False").otherwise("None")


def _titled(title: str, lines: Column) -> Column:
    return F.concat(F.array(F.lit(""), F.lit(title), F.lit(SINGLE)), lines)


def _or_none(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("  (none)")))


def _placed(df: DataFrame, keep: list[str], part: int, group: Column, plan: Column, lines: Column) -> DataFrame:
    told = df.select(*keep, F.lit(part).alias("part"), group.cast("int").alias("group"), plan.cast("int").alias("plan"), F.posexplode(lines).alias("line", "text"))
    return told.select(*keep, "part", "group", "plan", "line", "text")


def lists(rows: DataFrame, line: Column, order: list[str], name: str) -> DataFrame:
    """(plan_id, name): the lines of each plan's rows in order."""
    return rows.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]).alias(name))


def substitution_line() -> Column:
    """Of action_template, original_object, substituted_object, similarity, tier and signals."""
    return F.concat(F.lit("  [goal] action="), _text(F.col("action_template")), F.lit(" original="), _text(F.col("original_object")), F.lit(" substituted="), _text(F.col("substituted_object")), F.lit(" sim="), number(F.col("similarity")), F.lit(" tier="), _text(F.col("tier")), F.lit(" signals="), _text(F.col("signals")))


def unmet_line() -> Column:
    """Of object, attribute, op, value, actual and message."""
    return F.concat(F.lit("    - "), _text(F.col("object")), F.lit("."), _text(F.col("attribute")), F.lit(" "), _text(F.col("op"), "eq"), F.lit(" "), _text(F.col("value")), F.lit(" (actual="), _text(F.col("actual")), F.lit(", msg="), _text(F.col("message")), F.lit(")"))


def _context(title: str, mark: str) -> Column:
    errors, unmet = F.col(f"{mark}_errors"), F.col(f"{mark}_unmet")
    under = lambda name, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"  {name}:")), lines)).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("  Valid: "), _truth(F.col(f"{mark}_valid"))), F.concat(F.lit("  Goal satisfaction: "), number(F.col(f"{mark}_satisfaction"))))
    return _titled(title, F.concat(head, under("Errors", F.transform(errors, lambda e: F.concat(F.lit("    - "), e))), under("Unmet goals", unmet)))


def simple(plans: DataFrame, actions: DataFrame, when: str, details: Mapping[str, DataFrame] | None = None, most: int = MOST) -> DataFrame:
    """(query_id, part, group, plan, line, text): the summaries of each query's plans, by coverage and score.

    plans: query_id, plan_id, type, stage, coverage ('all', 'partial' or 'general'), score, actions_covered, goals_covered, breakdown (a map
    of numbers) and, of both contexts plan and query, valid, satisfaction and errors; actions: plan_id, step, action_id; details: by
    'substitutions', 'plan_unmet' and 'query_unmet' (plan_id and lines, as `lists` gives them), each where there is any.
    """
    empty = F.array().cast("array<string>")
    group = F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(GROUPS) for x in (name, k))), F.col("coverage"))
    place = F.row_number().over(Window.partitionBy("query_id", "coverage").orderBy(F.desc("score"), "plan_id"))
    best = plans.withColumn("_group", group).withColumn("_place", place).where(F.col("_place") <= most)
    steps = actions.join(best.select("plan_id"), "plan_id", "left_semi")
    numbered = steps.withColumn("_n", F.row_number().over(Window.partitionBy("plan_id").orderBy("step", "action_id")))
    told = best.join(lists(numbered, F.concat(F.lit("  "), F.col("_n").cast("string"), F.lit(". "), F.col("action_id")), ["_n"], "actions"), "plan_id", "left")
    for name in ("substitutions", "plan_unmet", "query_unmet"):
        told = told.join(details[name].select("plan_id", F.col(name)), "plan_id", "left") if details and name in details else told.withColumn(name, empty)
        told = told.withColumn(name, F.coalesce(name, empty))
    told = told.withColumn("actions", F.coalesce("actions", empty))
    maybe = lambda name, c: F.when(c.isNotNull(), F.array(F.concat(F.lit(f"{name}: "), c.cast("string")))).otherwise(empty)
    named = F.element_at(F.create_map(*(F.lit(x) for pair in COVERAGE.items() for x in pair)), F.col("coverage"))
    summary = F.array(
        F.concat(F.lit("--- PLAN "), F.col("_place").cast("string"), F.lit(" ---")), F.lit("SUMMARY"), F.lit(SINGLE), F.concat(F.lit("Type: "), _text(F.col("type"), "unknown")), F.concat(F.lit("Stage: "), _text(F.col("stage"), "?")),
        F.concat(F.lit("Coverage group: "), named), F.concat(F.lit("Final score: "), number(F.col("score"))), F.concat(F.lit("Action count: "), F.size("actions").cast("string")),
    )
    parts = F.transform(F.array_sort(F.map_entries("breakdown")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), number(e["value"])))
    lines = F.concat(
        summary, maybe("Actions covered", F.col("actions_covered")), maybe("Goals covered", F.col("goals_covered")), _titled("ACTIONS", F.col("actions")), _titled("SUBSTITUTIONS", _or_none(F.col("substitutions"))),
        _titled("SCORE BREAKDOWN", F.coalesce(parts, empty)), _context("VALIDATION: PLAN CONTEXT", "plan"), _context("VALIDATION: QUERY CONTEXT", "query"), F.array(F.lit(""), F.lit("")),
    )
    counts = plans.groupBy("query_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("coverage") == c).alias(c) for c in GROUPS))
    head = F.array(F.lit(DOUBLE), F.lit("PLAN TRACES (SIMPLE)"), F.lit(f"Generated at: {when}"), F.concat(F.lit("Total plans: "), F.col("n").cast("string")), F.lit(DOUBLE), F.lit(""))
    out = _placed(counts, ["query_id"], 0, F.lit(0), F.lit(0), head)
    for k, (c, title) in enumerate(GROUPS.items()):
        name = F.concat(F.lit(f"# {title}  ("), F.col(c).cast("string"), F.lit(" plans)"))
        rule = F.array(F.lit(HASHES), name, F.lit(HASHES), F.lit(""))
        out = out.unionByName(_placed(counts, ["query_id"], 1, F.lit(k), F.lit(0), F.when(F.col(c) > 0, rule).otherwise(F.concat(rule, F.array(F.lit("  (none)"), F.lit(""))))))
    return out.unionByName(_placed(told, ["query_id"], 1, F.col("_group"), F.col("_place"), lines))


def full(stages: DataFrame, candidates: DataFrame, seeds: DataFrame, trace: DataFrame, when: str, plans: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(query_id, part, group, plan, line, text): each stage's candidates, seeds and followed subgoals, then the plans as `simple` tells them (summaries).

    stages: query_id, stage, memories; candidates: query_id, stage, verb, action_id, instance_id, score, verb_score, object_score; seeds:
    query_id, stage, seed, instance_id, plan_length, failure; trace: query_id, stage, depth, subgoal, action_id, score,
    selected; plans: query_id, plan_id. The rows of a stage are as few as the search's limits let them be.
    """
    keys = ["query_id", "stage"]
    number_of = F.dense_rank().over(Window.partitionBy("query_id").orderBy("stage"))
    listed = stages.withColumn("_group", number_of - 1)
    at = listed.select(*keys, "_group")
    totals = plans.groupBy("query_id").agg(F.count("*").alias("n"))
    head = F.array(F.lit(DOUBLE), F.lit("PLAN TRACES (FULL)"), F.lit(f"Generated at: {when}"), F.concat(F.lit("Total plans: "), F.coalesce("n", F.lit(0)).cast("string")), F.lit(DOUBLE), F.lit(""), F.lit("STAGE-LEVEL PLANNING TRACE"), F.lit(DOUBLE), F.lit(""))
    queries = stages.select("query_id").distinct().join(totals, "query_id", "left")
    out = _placed(queries, ["query_id"], 0, F.lit(0), F.lit(0), head)
    top = F.array(F.concat(F.lit("Stage: "), F.col("stage"), F.lit("  (batch_index="), F.col("_group").cast("string"), F.lit(")")), F.concat(F.lit("Memories: "), _text(F.col("memories"))), F.lit(""))
    section = lambda title: F.array(F.lit(title), F.lit(SINGLE))
    out = out.unionByName(_placed(listed, ["query_id"], 1, F.col("_group") * 8, F.lit(0), F.concat(top, section("VERB CANDIDATES"))))
    out = out.unionByName(_placed(listed, ["query_id"], 1, F.col("_group") * 8 + 2, F.lit(0), section("SEED PLANS")))
    out = out.unionByName(_placed(listed, ["query_id"], 1, F.col("_group") * 8 + 4, F.lit(0), F.concat(F.array(F.lit("")), section("CONDITION COMPONENT TRACE"))))
    out = out.unionByName(_placed(listed, ["query_id"], 1, F.col("_group") * 8 + 6, F.lit(0), F.array(F.lit(""), F.lit(LONG), F.lit(""))))
    place = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    candidate = F.array(
        F.concat(F.lit("  verb="), _text(F.col("verb")), F.lit(" action="), _text(F.col("action_id")), F.lit(" instance="), _text(F.col("instance_id"))), F.concat(F.lit("    total: "), number(F.col("score"))),
        F.concat(F.lit("    verb match: score="), number(F.col("verb_score"))), F.concat(F.lit("    object score: "), number(F.col("object_score"))), F.lit(""),
    )
    found = candidates.withColumn("_n", place(F.desc("score"), "action_id")).join(at, keys)
    out = out.unionByName(_placed(found, ["query_id"], 1, F.col("_group") * 8 + 1, F.col("_n"), candidate))
    seed = F.array(F.concat(F.lit("  seed="), _text(F.col("seed")), F.lit(" instance="), _text(F.col("instance_id")), F.lit(" plan_length="), _text(F.col("plan_length")), F.lit(" failure="), _text(F.col("failure"))))
    out = out.unionByName(_placed(seeds.withColumn("_n", place("seed")).join(at, keys), ["query_id"], 1, F.col("_group") * 8 + 3, F.col("_n"), seed))
    each = trace.groupBy(*keys, "depth", "subgoal").agg(F.array_sort(F.collect_list(F.when(F.col("action_id").isNotNull(), F.struct((-F.col("score")).alias("_order"), "action_id", "score")))).alias("c"), F.max(F.when(F.col("selected"), F.col("action_id"))).alias("chosen"))  # CANDIDATES of a subgoal at most
    lines = F.concat(
        F.array(F.concat(F.lit("  depth="), _text(F.col("depth")), F.lit(" subgoal="), _text(F.col("subgoal")))), F.when(F.size("c") == 0, F.array(F.lit("    failure: no_candidates"))).otherwise(F.array().cast("array<string>")),
        F.transform("c", lambda c: F.concat(F.lit("    candidate action="), c["action_id"], F.lit(" score="), number(c["score"]))), F.when(F.col("chosen").isNotNull(), F.array(F.concat(F.lit("    SELECTED: "), F.col("chosen")))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")),
    )
    out = out.unionByName(_placed(each.withColumn("_n", place("depth", "subgoal")).join(at, keys), ["query_id"], 1, F.col("_group") * 8 + 5, F.col("_n"), lines))
    if summaries is None:
        return out
    title = F.array(F.lit(""), F.lit("PLAN-LEVEL TRACES (grouped)"), F.lit(DOUBLE), F.lit(""))
    out = out.unionByName(_placed(queries, ["query_id"], 2, F.lit(0), F.lit(-1), title))
    return out.unionByName(summaries.where("part = 1").withColumn("part", F.lit(2)))


def write(report: DataFrame, folder: str) -> None:
    """The lines of a report as text, in order, in a folder for each query."""
    order = ["part", "group", "plan", "line"]
    sorted_ = report.repartitionByRange("query_id").sortWithinPartitions("query_id", *order)
    sorted_.select(F.col("query_id"), F.col("text").alias("value")).write.partitionBy("query_id").mode("overwrite").text(folder)
