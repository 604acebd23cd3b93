"""World states and names over the driver's tables: an order is a plan, a supplier a memory, and the parts that it delivers are its objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import world
from quillon.plans.registry import query
from quillon.session import table

_LEAVES_SQL = """l AS (SELECT l_suppkey AS m, 'p' || l_partkey % 20 AS o, min(l_extendedprice) AS price, CASE WHEN l_suppkey % 3 = 0 THEN 'on' END AS relation, 'shelf' || l_suppkey % 4 AS shelf FROM lineitem GROUP BY 1, 2, 4, 5),
v AS (SELECT m, o, unnest(['price', 'position.relation', 'position.relative_to']) AS path, unnest([CAST(CAST(round(price * 100) AS BIGINT) AS VARCHAR), relation, shelf]) AS value FROM l),
s AS (SELECT l_orderkey AS k, l_suppkey AS m, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT k, o, arg_min(m, {'n': n, 'm': m}) AS m FROM s JOIN (SELECT DISTINCT m, o FROM l) USING (m) GROUP BY 1, 2),
x AS (SELECT k AS plan_id, o AS object, path, value FROM w JOIN v USING (m, o) WHERE value IS NOT NULL)"""


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, actions, leaves) of orders."""
    lines = table(spark, sf_dir, "lineitem")
    action = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")
    steps = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step"), action.alias("action_id"))
    actions = lines.select(action.alias("action_id"), F.col("l_suppkey").alias("memory_id"))
    things = lines.groupBy(F.col("l_suppkey").alias("memory_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("object")).agg(F.min("l_extendedprice").alias("price"))
    leaf = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    m = F.col("memory_id")
    each = F.array(leaf("price", F.round(F.col("price") * 100).cast("long").cast("string")), leaf("position.relation", F.when(m % 3 == 0, "on")), leaf("position.relative_to", F.concat(F.lit("shelf"), (m % 4).cast("string"))))
    leaves = things.select("memory_id", "object", F.explode(each).alias("l")).select("memory_id", "object", "l.path", "l.value").where("value is not null")
    return steps, actions, leaves


@query(f"WITH {_LEAVES_SQL} SELECT plan_id, count(DISTINCT object) AS n_objects, count(*) AS n_leaves, md5(string_agg(object || '.' || path || '=' || value, ';' ORDER BY object, path)) AS state FROM x GROUP BY plan_id")
def plan_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world before each order: the parts of its suppliers, as the first of them has each."""
    return world.states_of_plans(*_world(spark, sf_dir))


@query(f"WITH {_LEAVES_SQL} SELECT plan_id, object, max(value) FILTER (path = 'position.relation') AS relation, max(value) FILTER (path = 'position.relative_to') AS relative_to FROM x GROUP BY ALL HAVING count(*) FILTER (path = 'position.relation') > 0")
def plan_world_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where things stand in the world before each order."""
    return world.relations_of_plans(*_world(spark, sf_dir))


@query("""WITH l AS (SELECT 'q' || o_custkey % 40 AS q, 'o' || o_custkey AS o, 'status' AS path, o_orderstatus AS v, o_orderkey AS place FROM orders), i AS (SELECT 'q' || o_custkey % 40 AS q, 'o' || o_custkey AS o, 'status' AS path, 'held' AS v, o_orderkey AS place FROM orders WHERE o_totalprice > 200000),
a AS (SELECT *, 0 AS b FROM l UNION ALL SELECT *, 1 FROM i) SELECT q AS query_id, o AS object, path, v AS value FROM a QUALIFY row_number() OVER (PARTITION BY q, o, path ORDER BY b DESC, place DESC, v DESC) = 1""")
def query_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The world of each query: the last status of its customers, but what is stated to be held is."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), (F.col("o_custkey") % 40).cast("string")).alias("query_id"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("object"), F.lit("status").alias("path"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("place"), "o_totalprice")
    return world.of_query(rows, rows.where("o_totalprice > 200000").withColumn("value", F.lit("held")))


_NAME_SQL = "CASE c_custkey % 5 WHEN 0 THEN 'c' || c_custkey WHEN 1 THEN 'p' || c_custkey % 300 WHEN 2 THEN 'b' || c_custkey % 40 WHEN 3 THEN 'n' || c_custkey % 30 ELSE 's' || c_custkey % 9 END"


@query(f"""WITH n AS (SELECT DISTINCT 'q' || c_nationkey AS q, {_NAME_SQL} AS name FROM customer),
a AS (SELECT 'q' || c_nationkey AS q, c_custkey AS place, 'c' || c_custkey AS obj_id, 's' || c_custkey % 4 AS template, c_mktsegment AS kind FROM customer WHERE c_acctbal > 0),
aq AS (SELECT q, name, arg_min(kind, place) AS kind FROM (SELECT q, place, kind, unnest([obj_id, template]) AS name FROM a) GROUP BY 1, 2),
i AS (SELECT p_partkey % 7 AS m, p_partkey AS place, 'p' || p_partkey % 250 AS obj_id, 'b' || p_partkey % 30 AS template, p_brand AS kind FROM part),
ii AS (SELECT obj_id AS name, arg_max(kind, {{'m': m, 'p': place}}) AS kind FROM i GROUP BY 1), im AS (SELECT template AS name, arg_min(kind, {{'m': m, 'p': place}}) AS kind FROM i GROUP BY 1), r AS (SELECT 'n' || n_nationkey AS name, n_name AS kind FROM nation)
SELECT n.q AS query_id, n.name, CASE WHEN aq.kind IS NOT NULL THEN 'query' WHEN ii.kind IS NOT NULL THEN 'instance' WHEN im.kind IS NOT NULL THEN 'memory' WHEN r.kind IS NOT NULL THEN 'registry' ELSE 'stub' END AS how, coalesce(aq.kind, ii.kind, im.kind, r.kind) AS kind
FROM n LEFT JOIN aq ON aq.q = n.q AND aq.name = n.name LEFT JOIN ii ON ii.name = n.name LEFT JOIN im ON im.name = n.name LEFT JOIN r ON r.name = n.name""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved by the query's own objects, instances, objects of memories, the registry, or as stubs."""
    c, k = F.col("c_custkey"), F.col("p_partkey")
    text = lambda mark, col: F.concat(F.lit(mark), col.cast("string"))
    name = F.when(c % 5 == 0, text("c", c)).when(c % 5 == 1, text("p", c % 300)).when(c % 5 == 2, text("b", c % 40)).when(c % 5 == 3, text("n", c % 30)).otherwise(text("s", c % 9))
    customers = table(spark, sf_dir, "customer").withColumn("query_id", text("q", F.col("c_nationkey")))
    asked = customers.where("c_acctbal > 0").select("query_id", c.alias("place"), text("c", c).alias("obj_id"), text("s", c % 4).alias("template"), F.lit(None).cast("string").alias("name"), F.col("c_mktsegment").alias("kind"))
    instances = table(spark, sf_dir, "part").select((k % 7).alias("memory_id"), k.alias("place"), text("p", k % 250).alias("obj_id"), text("b", k % 30).alias("template"), F.col("p_brand").alias("kind"))
    registry = table(spark, sf_dir, "nation").select(text("n", F.col("n_nationkey")).alias("template"), F.col("n_name").alias("kind"))
    return world.resolved(customers.select("query_id", name.alias("name")), asked, instances, registry, ["kind"])
