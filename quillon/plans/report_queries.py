"""Reports of plans over the driver's tables: an order is a plan, its lines are its actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import plan_reports as R
from quillon.plans.registry import query
from quillon.session import table

WHEN = "1998-12-01T00:00:00"


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    first = F.substring("o_orderpriority", 1, 1)
    coverage = F.when(first.isin("1", "2"), "all").when(first.isin("3", "4"), "partial").otherwise("general")
    errors = F.when(k % 7 == 0, F.array(F.lit("late"), F.lit("short"))).otherwise(F.array().cast("array<string>"))
    context = lambda mark, n: [(k % n == 0).alias(f"{mark}_valid"), (k % 5 / 4).alias(f"{mark}_satisfaction"), errors.alias(f"{mark}_errors")]
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("q"), (F.col("o_custkey") % 40).cast("string")).alias("query_id"), F.lpad(k.cast("string"), 10, "0").alias("plan_id"), F.lit("seed").alias("type"), F.col("o_orderstatus").alias("stage"), coverage.alias("coverage"), (k % 1000 / 8).alias("score"),
        F.when(k % 2 == 0, (k % 4).cast("string")).alias("actions_covered"), F.lit(None).cast("string").alias("goals_covered"), F.create_map(F.lit("verb"), k % 10 / 4, F.lit("objects"), F.lit(0.5)).alias("breakdown"), *context("plan", 2), *context("query", 3),
    )


def _list(lines: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in lines) + "]"


_CONTEXT_SQL = lambda title, n, unmet: f"""{_list(["", title, R.SINGLE])} || ['  Valid: ' || CASE WHEN k % {n} = 0 THEN 'True' ELSE 'False' END, '  Goal satisfaction: ' || printf('%.4f', (k % 5)::DOUBLE / 4)] || CASE WHEN k % 7 = 0 THEN ['  Errors:', '    - late', '    - short'] ELSE [] END{unmet}"""
REPORT_SQL = f"""WITH o AS (SELECT 'q' || o_custkey % 40 AS q, o_orderkey AS k, o_orderstatus AS stage, (o_orderkey % 1000)::DOUBLE / 8 AS score, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 0 WHEN o_orderpriority[1] IN ('3', '4') THEN 1 ELSE 2 END AS g FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY q, g ORDER BY score DESC, k) AS place FROM o QUALIFY place <= {R.MOST}),
l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, 'part ' || l_partkey AS a, l_returnflag AS f FROM lineitem WHERE l_orderkey IN (SELECT k FROM p)),
m AS (SELECT DISTINCT k, n, a FROM l), a AS (SELECT k, list('  ' || i || '. ' || a ORDER BY i) AS acts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, a) AS i FROM m) GROUP BY k),
u AS (SELECT k, list('    - line.part eq ' || a || ' (actual=None, msg=returned)' ORDER BY n, a) AS unmet FROM (SELECT DISTINCT k, n, a FROM l WHERE f = 'R') GROUP BY k),
t AS (SELECT q, g, place, {_list([R.SINGLE])} AS rule, ['--- PLAN ' || place || ' ---', 'SUMMARY', '{R.SINGLE}', 'Type: seed', 'Stage: ' || stage, 'Coverage group: ' || {_list(list(R.COVERAGE.values()))}[g + 1], 'Final score: ' || printf('%.4f', score), 'Action count: ' || coalesce(len(acts), 0)]
  || CASE WHEN k % 2 = 0 THEN ['Actions covered: ' || k % 4] ELSE [] END || {_list(["", "ACTIONS", R.SINGLE])} || coalesce(acts, []) || {_list(["", "SUBSTITUTIONS", R.SINGLE, "  (none)"])}
  || {_list(["", "SCORE BREAKDOWN", R.SINGLE])} || ['  objects: 0.5000', '  verb: ' || printf('%.4f', (k % 10)::DOUBLE / 4)]
  || {_CONTEXT_SQL("VALIDATION: PLAN CONTEXT", 2, " || CASE WHEN unmet IS NOT NULL THEN ['  Unmet goals:'] || unmet ELSE [] END")} || {_CONTEXT_SQL("VALIDATION: QUERY CONTEXT", 3, "")} || ['', ''] AS lines
  FROM p LEFT JOIN a USING (k) LEFT JOIN u USING (k)),
c AS (SELECT q, count(*) AS n, [count(*) FILTER (g = 0), count(*) FILTER (g = 1), count(*) FILTER (g = 2)] AS c FROM o GROUP BY q),
r AS (SELECT q, 0 AS part, 0 AS g, 0 AS place, ['{R.DOUBLE}', 'PLAN TRACES (SIMPLE)', 'Generated at: {WHEN}', 'Total plans: ' || n, '{R.DOUBLE}', ''] AS lines FROM c
  UNION ALL SELECT q, 1, g, 0, ['{R.HASHES}', '# ' || {_list(list(R.GROUPS.values()))}[g + 1] || '  (' || c[g + 1] || ' plans)', '{R.HASHES}', ''] || CASE WHEN c[g + 1] = 0 THEN ['  (none)', ''] ELSE [] END FROM c, range(3) x(g)
  UNION ALL SELECT q, 1, g, place, lines FROM t)
SELECT q AS query_id, part, CAST(g AS INTEGER) AS "group", CAST(place AS INTEGER) AS plan, CAST(unnest(range(len(lines))) AS INTEGER) AS line, unnest(lines) AS text FROM r"""


@query(REPORT_SQL)
def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary report of every query's plans, line by line."""
    plans = _plans(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("plan_id"), F.col("l_linenumber").alias("step"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("action_id"), "l_returnflag")
    returned = lines.where("l_returnflag = 'R'").select("plan_id", "step", "action_id").distinct()
    told = returned.select("*", F.lit("line").alias("object"), F.lit("part").alias("attribute"), F.lit("eq").alias("op"), F.col("action_id").alias("value"), F.lit(None).cast("string").alias("actual"), F.lit("returned").alias("message"))
    unmet = R.lists(told, R.unmet_line(), ["step", "action_id"], "plan_unmet")
    return R.simple(plans, lines.select("plan_id", "step", "action_id").distinct(), WHEN, {"plan_unmet": unmet})
