"""Reports of plans as files."""

from quillon.operators import plan_reports


def test_files_of_both_layouts(spark, tmp_path):
    plans = spark.createDataFrame([("q", f"p{i}", "seed", "top10", "all" if i else "general", 1.5 - i, "2", None, {"verb": 0.5}, True, 1.0, [], False, 0.5, ["no lid"]) for i in range(3)], "query_id string, plan_id string, type string, stage string, coverage string, score double, actions_covered string, goals_covered string, breakdown map<string,double>, plan_valid boolean, plan_satisfaction double, plan_errors array<string>, query_valid boolean, query_satisfaction double, query_errors array<string>")
    actions = spark.createDataFrame([("p1", 0, "open"), ("p1", 1, "pour"), ("p2", 0, "shut")], "plan_id string, step int, action_id string")
    subs = spark.createDataFrame([("p1", "pour", "cup", "glass", 0.75, "same", None)], "plan_id string, action_template string, original_object string, substituted_object string, similarity double, tier string, signals string")
    details = {"substitutions": plan_reports.lists(subs, plan_reports.substitution_line(), ["action_template"], "substitutions")}
    plan_reports.write(plan_reports.simple(plans, actions, "now", details), f"{tmp_path}/simple")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "simple" / "query_id=q").glob("part-*"))).split("\n")
    assert lines[:6] == ["=" * 80, "PLAN TRACES (SIMPLE)", "Generated at: now", "Total plans: 3", "=" * 80, ""]
    at = lines.index("--- PLAN 1 ---")
    assert lines[at + 1 : at + 14] == ["SUMMARY", "-" * 40, "Type: seed", "Stage: top10", "Coverage group: verb_guided_all", "Final score: 0.5000", "Action count: 2", "Actions covered: 2", "", "ACTIONS", "-" * 40, "  1. open", "  2. pour"]
    assert "  [goal] action=pour original=cup substituted=glass sim=0.7500 tier=same signals=None" in lines and lines.count("    - no lid") == 3
    assert lines[lines.index("# VERB-GUIDED PLANS — COVERING SOME TARGET ACTIONS  (0 plans)") + 3] == "  (none)" and lines.count("--- PLAN 1 ---") == 2

    stages = spark.createDataFrame([("q", "all", "9"), ("q", "top10", "3")], "query_id string, stage string, memories string")
    candidates = spark.createDataFrame([("q", "all", "open", "a1", "i1", 1.2, 1.0, 0.2), ("q", "all", "open", "a2", "i2", 2.0, 1.0, 1.0)], "query_id string, stage string, verb string, action_id string, instance_id string, score double, verb_score double, object_score double")
    seeds = spark.createDataFrame([("q", "top10", "a2", "i2", 3, None)], "query_id string, stage string, seed string, instance_id string, plan_length int, failure string")
    trace = spark.createDataFrame([("q", "all", 1, "lid open", "a2", 0.9, True), ("q", "all", 1, "lid open", "a1", 0.4, False), ("q", "all", 2, "lid there", None, None, None)], "query_id string, stage string, depth int, subgoal string, action_id string, score double, selected boolean")
    summaries = plan_reports.simple(plans, actions, "now", details)
    text = [r.text for r in plan_reports.full(stages, candidates, seeds, trace, "now", plans, summaries).orderBy("query_id", "part", "group", "plan", "line").collect()]
    first, second = text.index("Stage: all  (batch_index=0)"), text.index("Stage: top10  (batch_index=1)")
    assert first < text.index("  verb=open action=a2 instance=i2") < text.index("  verb=open action=a1 instance=i1") < text.index("  depth=1 subgoal=lid open") < text.index("    SELECTED: a2") < text.index("    failure: no_candidates") < second
    assert second < text.index("  seed=a2 instance=i2 plan_length=3 failure=None") and text[3] == "Total plans: 3"
    assert second < text.index("PLAN-LEVEL TRACES (grouped)") < text.index("--- PLAN 1 ---") and text.count("SCORE BREAKDOWN") == 3
