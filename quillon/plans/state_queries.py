"""Conditions, effects, plans, timelines over the driver's tables. A user is a memory, an event an action that changes the user's last state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import compat, state, timeline
from quillon.plans.registry import query
from quillon.session import spread, table

_TRANSITIONS_SQL = "SELECT event_id, user_id, event_type AS new, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("new"))
    return state.transitions(events, "user_id", ["ts", "event_id"], "new")


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = state.sides(_changes(spark, sf_dir).select("event_id", "user_id", "old", "new"))
    return sides.select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("object"), F.lit("last").alias("path"), F.lit("eq").alias("op"), "value", "state_type")


@query(f"""SELECT event_id, user_id, 'new' AS state_type, new AS value FROM ({_TRANSITIONS_SQL}) UNION ALL SELECT event_id, user_id, 'old', old FROM ({_TRANSITIONS_SQL}) WHERE old IS NOT NULL""")
def change_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sides(_changes(spark, sf_dir).select("event_id", "user_id", "old", "new")).select("event_id", "user_id", "state_type", "value")


@query("""SELECT DISTINCT verb, event_id AS action_id FROM (SELECT event_id, event_type AS verb FROM events UNION ALL SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'commit' ELSE 'look' END FROM events WHERE event_type <> 'error') WHERE verb IN ('view', 'click', 'look', 'commit')""")
def verb_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by asked verbs: their own or their general one."""
    kind = F.col("event_type")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("action_id"), kind.alias("verb"), F.when(kind.isin("purchase", "signup"), "commit").when(kind != "error", "look").alias("general_verb"))
    return state.verb_actions(events, spark.createDataFrame([("view",), ("click",), ("look",), ("commit",)], "verb string"))


WANTED = [("user1", "last", "eq", "purchase"), ("user2", "last", "eq", "view"), ("user3", "last", "eq", "none"), ("user8", "last", "eq", "error")]
_WANTED_SQL = "(VALUES " + ", ".join(str(w) for w in WANTED) + ") w(object, path, op, value)"


def _wanted(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(WANTED, "object string, path string, op string, value string"))


@query(f"SELECT event_id, object, value FROM ({_TRANSITIONS_SQL}), {_WANTED_SQL} WHERE object = 'user' || CAST(user_id AS VARCHAR) AND value = new")
def effect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lookup(_conditions(spark, sf_dir), _wanted(spark), "new").select("event_id", "object", "value")


@query(f"SELECT event_id, object, value FROM ({_TRANSITIONS_SQL}), {_WANTED_SQL} WHERE object = 'user' || CAST(user_id AS VARCHAR) AND value = old")
def old_state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lookup(_conditions(spark, sf_dir), _wanted(spark), "old").select("event_id", "object", "value")


@query(f"""WITH s AS (SELECT object || '/' || value AS subgoal_id, event_id AS action_id, CASE WHEN new = value THEN 1.0::DOUBLE WHEN old = value THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS score
  FROM ({_TRANSITIONS_SQL}), {_WANTED_SQL} WHERE object = 'user' || CAST(user_id AS VARCHAR))
SELECT subgoal_id, action_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY subgoal_id ORDER BY score DESC, action_id) AS place FROM (SELECT subgoal_id, action_id, max(score) AS score FROM s WHERE score >= 0.3 GROUP BY ALL)) WHERE place <= 10""")
def subgoal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = _changes(spark, sf_dir).select(F.col("event_id").alias("action_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("object"), "old", "new")
    goals = _wanted(spark).withColumn("subgoal_id", F.concat_ws("/", "object", "value"))
    score = F.when(F.col("new") == F.col("g_value"), 1.0).when(F.col("old") == F.col("g_value"), 0.5).otherwise(0.2)
    return state.candidates(effects, goals, score).select("subgoal_id", "action_id", "score", "place")


_FINAL_SQL = "SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value, count(*) AS n_changes FROM events GROUP BY ALL"


@query(_FINAL_SQL)
def world_state_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.final_state(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


CONDITIONS = [("purchase", "gt", "10.0"), ("view", "gte", "50"), ("view", "lt", "90.5"), ("click", "<=", "20 "), ("signup", "!=", "none"), ("error", "eq", "7"), ("click", "in", "[1, 2, 3]"), ("purchase", "+=", "1"), ("view", "gt", "many")]


@query(f"""SELECT user_id, event_type, op, wanted FROM ({_FINAL_SQL}) f JOIN (VALUES {", ".join(str(c) for c in CONDITIONS)}) c(t, op, wanted) ON c.t = f.event_type
WHERE CASE op WHEN 'gt' THEN value > TRY_CAST(wanted AS DOUBLE) WHEN 'gte' THEN value >= TRY_CAST(wanted AS DOUBLE) WHEN 'lt' THEN value < TRY_CAST(wanted AS DOUBLE) WHEN '<=' THEN value <= TRY_CAST(wanted AS DOUBLE) WHEN '!=' THEN true WHEN 'eq' THEN value = TRY_CAST(wanted AS DOUBLE) WHEN 'in' THEN value IN (1, 2, 3) ELSE false END""")
def condition_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated conditions of every user, where the final state meets them."""
    final = state.final_state(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")
    asked = F.broadcast(spark.createDataFrame(CONDITIONS, "path string, op string, value string"))  # the stated conditions
    wanted = final.select(F.col("user_id").cast("string").alias("object"), F.col("event_type").alias("path")).join(asked, "path").select("object", "path", "op", "value")
    actual = final.select(F.col("user_id").cast("string").alias("object"), F.col("event_type").alias("path"), F.col("value").cast("string").alias("value"))
    return state.satisfied(wanted, actual).select(F.col("object").cast("long").alias("user_id"), F.col("path").alias("event_type"), "op", F.col("value").alias("wanted"))


ASKED_OBJECTS = [("q1", "Brand#1", "ECONOMY", 20, 950, "round", "Brand#1"), ("q2", "Brand#7", "LARGE", 40, 1000, "flat", None), ("q3", None, "PROMO", 5, 1200, "", "Brand#3"), ("p12", "Brand#2", "SMALL", 9, 30, "flat", None)]
_COMPAT_SQL = f"""q(qid, brand, kind, size, price, shape, dest) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in a) + ")" for a in ASKED_OBJECTS)}),
s AS (SELECT qid, p_partkey, ('p' || p_partkey) = qid AS own, p_type = kind AND kind NOT IN ('SMALL') AS cat, coalesce(p_brand = brand, false) AS mat, shape <> '' AND CASE p_partkey % 2 WHEN 0 THEN 'round' ELSE 'flat' END = shape AS shp,
  (size BETWEEN 0.5 * p_size AND 1.5 * p_size)::INT + (price BETWEEN 0.5 * p_retailprice AND 1.5 * p_retailprice)::INT + (7 BETWEEN 0.5 * (p_partkey % 20) AND 1.5 * (p_partkey % 20))::INT + (7.0::DOUBLE * size * price BETWEEN 0.5 * p_size * p_retailprice * (p_partkey % 20) AND 1.5 * p_size * p_retailprice * (p_partkey % 20))::INT >= 2 AS dim,
  coalesce(p_brand = dest, false) AS pos, p_container_like = 'hold' AS fun, (abs(size - p_size) <= 0.3::DOUBLE * p_size)::INT + 1 AS same FROM q, (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'hold' ELSE 'cut' END AS p_container_like FROM part))"""


@query(f"""WITH {_COMPAT_SQL}, n AS (SELECT *, cat::INT + mat::INT + shp::INT + dim::INT + pos::INT + fun::INT AS n FROM s)
SELECT qid, p_partkey, n AS n_signals, CASE WHEN own THEN 'exact' WHEN cat OR mat OR n + same // 2 >= 2 THEN 'attribute' ELSE 'rejected' END AS tier,
  round(CASE WHEN own THEN 1.0::DOUBLE WHEN cat OR mat OR n + same // 2 >= 2 THEN least(0.9::DOUBLE, (n + 0.3::DOUBLE * same) / 6.0::DOUBLE * 0.9::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS score FROM n""")
def object_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated objects against all parts by all six signals and common attributes; a category may say too little to count."""
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    whole = lambda *xs: F.array_compact(F.array(*xs))
    asked = spark.createDataFrame(ASKED_OBJECTS, "qid string, brand string, kind string, size int, price int, q_shape string, dest string")
    kind = lambda c: F.when(c == "SMALL", "physical_object").otherwise(c)  # noqa: E731  a fixed category that is left out
    asked = asked.select(
        F.col("qid").alias("q_obj_id"), F.col("qid").alias("q_template"), F.array(kind(F.col("kind"))).alias("q_categories"), F.array(F.lit("hold")).alias("q_functions"), whole("brand").alias("q_materials"), "q_shape",
        text("size").alias("q_length"), text("price").alias("q_width"), F.lit("7").alias("q_height_thickness"), F.lit("beside").alias("q_relation"), F.lit("near").alias("q_relationr"), whole("dest").alias("q_relative_to"),
        F.create_map(F.lit("size"), text("size"), F.lit("made"), F.lit("yes"), F.lit("other"), F.lit("1")).alias("q_attributes"),
    )
    key = F.col("p_partkey")
    parts = spread(table(spark, sf_dir, "part")).select(
        key.alias("p_partkey"), F.concat(F.lit("p"), text("p_partkey")).alias("c_obj_id"), F.concat(F.lit("p"), text("p_partkey")).alias("c_template"), F.array(kind(F.col("p_type"))).alias("c_categories"), F.array(F.when(key % 3 == 0, "hold").otherwise("cut")).alias("c_functions"),
        F.array("p_brand").alias("c_materials"), F.when(key % 2 == 0, "round").otherwise("flat").alias("c_shape"), text("p_size").alias("c_length"), text("p_retailprice").alias("c_width"), text(key % 20).alias("c_height_thickness"),
        F.lit("over").alias("c_relation"), F.lit("near").alias("c_relationr"), F.array("p_brand").alias("c_relative_to"), F.create_map(F.lit("size"), F.concat(text("p_size"), F.lit("")), F.lit("made"), F.lit("yes"), F.lit("third"), F.lit("1")).alias("c_attributes"),
    )
    scored = compat.compatibility(parts.crossJoin(F.broadcast(asked)))  # a stated query set of four rows
    return scored.select(F.col("q_obj_id").alias("qid"), "p_partkey", "n_signals", "tier", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS met, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS errors, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sat FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN met = 0 THEN 'general' WHEN met >= n THEN 'all' ELSE 'partial' END AS coverage_group, round((0.3::DOUBLE + 0.2::DOUBLE + 0.4::DOUBLE * sat) * (met / n::DOUBLE) - 0.005::DOUBLE * n - 0.005::DOUBLE * errors, 6) AS score FROM p WHERE round((0.3::DOUBLE + 0.2::DOUBLE + 0.4::DOUBLE * sat) * (met / n::DOUBLE) - 0.005::DOUBLE * n - 0.005::DOUBLE * errors, 6) >= 0""")
def plan_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a plan: filled ones meet a goal, pending ones are errors."""
    met = F.col("o_orderstatus") == "F"
    plans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(met).alias("met"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"), F.avg(met.cast("double")).alias("sat"))
    score = F.round(state.plan_score(F.lit(1.0), F.lit(1.0), F.col("sat"), F.col("met") / F.col("n"), F.col("n"), F.col("errors")), 6)
    return plans.select("o_custkey", state.coverage_group(F.col("met"), F.col("n"), F.col("met") > 0).alias("coverage_group"), score.alias("score")).where("score >= 0")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w - l_quantity AS start_time, sum(l_quantity) OVER w AS end_time FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""")
def seq_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return timeline.sequential(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "start_time", "end_time")


@query("SELECT l_orderkey, max(l_quantity) AS total_duration, count(*) AS n_actions FROM lineitem GROUP BY 1")
def parallel_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.parallel(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")


_KINDS_SQL = "CASE l_linenumber % 3 WHEN 0 THEN 'parallel' WHEN 1 THEN 'sequential' ELSE 'cyclical' END"


@query(f"""WITH a AS (SELECT l_orderkey AS memory_id, {_KINDS_SQL} AS k, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS depth, CASE WHEN {_KINDS_SQL} = 'cyclical' AND l_quantity > 0 AND l_linenumber > 0 THEN l_quantity * l_linenumber ELSE l_quantity END AS d FROM lineitem)
SELECT memory_id, count(*) AS n_actions, count(*) FILTER (depth = 0) AS n_roots, max(d) AS max_end, count(*) FILTER (d = 0) AS n_zero, count(*) FILTER (k = 'sequential') AS n_sequential, count(*) FILTER (k = 'parallel') AS n_parallel, count(*) FILTER (k = 'cyclical') AS n_cyclical FROM a GROUP BY 1""")
def timeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "parallel").when(F.col("l_linenumber") % 3 == 1, "sequential").otherwise("cyclical")
    own = timeline.own_duration(kind, F.col("l_quantity"), F.col("l_quantity"), F.col("l_linenumber"))
    actions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), kind.alias("temporal_type"), F.when(F.col("l_linenumber") == 1, 0).otherwise(1).alias("depth"), own.alias("effective_duration"), own.alias("end_time"))
    return timeline.summary(actions)


@query("SELECT round_even(l_quantity, 0)::DOUBLE AS rounded, count(*) AS n, count(*) FILTER (l_quantity = 0) AS n_zero, count(*) FILTER (l_linenumber > 4) AS n_cyclical FROM lineitem GROUP BY 1")
def duration_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.audit(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_linenumber") > 4)


@query("""WITH RECURSIVE base AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t AS (SELECT id, id AS path, 0 AS depth FROM base WHERE parent IS NULL UNION ALL SELECT b.id, t.path || '.' || b.id, t.depth + 1 FROM base b JOIN t ON b.parent = t.id)
SELECT id, path, depth FROM t""")
def action_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as one tree, flattened depth-first with path ids."""
    read = lambda name: table(spark, sf_dir, name)
    node = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    nodes = read("region").select(node("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(read("nation").select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(read("customer").select(node("c", "c_custkey").alias("id"), node("n", "c_nationkey").alias("parent")))
    from quillon.operators.flatten import tree_paths

    return tree_paths(nodes)


@query("""SELECT goal, step, count(*) AS n FROM (SELECT CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' ELSE 'placeholder' END AS goal, CASE WHEN c.c_custkey IS NOT NULL THEN 0 WHEN s.s_suppkey IS NOT NULL THEN 1 ELSE 2 END AS step
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey * 2 LEFT JOIN supplier s ON s.s_suppkey = o_custkey * 2) GROUP BY ALL""")
def goal_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved by a chain of lookups: customers, then suppliers, then a placeholder."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.col("c_custkey").alias("found"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("found"))
    done = state.first_of(orders, "name", customers, suppliers)
    goal = F.element_at(F.array(F.lit("customer"), F.lit("supplier"), F.lit("placeholder")), F.col("step") + 1)
    return done.groupBy(goal.alias("goal"), "step").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS n, l_partkey FROM lineitem) SELECT l_orderkey, l_partkey FROM m WHERE n = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each key, the higher score kept."""
    return state.keep_best(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey")
