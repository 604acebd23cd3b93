"""Statistics and data-quality reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import aliases, statistics
from quillon.plans.registry import query
from quillon.session import table


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderkey, o_custkey, n FROM (SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n < 10")
def low_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rare(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10).select("o_orderkey", "o_custkey", "n")


@query("SELECT event_id, lower(event_type) AS relation FROM events WHERE lower(event_type) IN ('click', 'view', 'signup')")
def target_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("relation"))
    return statistics.of_relations(events, "relation", ("click", "view", "signup"))


@query("SELECT size, count(*) AS n FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS size FROM orders GROUP BY 1) GROUP BY 1")
def alternatives_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram_of_sizes(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT role, conv_id % 10 AS bucket, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY ROLLUP(role, bucket)")
def token_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") % 10).alias("bucket"), F.length("text").cast("long").alias("chars"))
    return statistics.usage(turns, [F.count("*").alias("n_turns"), F.sum("chars").alias("n_chars")], "role", "bucket")


@query("""SELECT key, value, count(*) AS n FROM (SELECT 'status' AS key, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders) GROUP BY ALL""")
def plan_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return statistics.census(orders, "status", "priority")


@query("SELECT coalesce(a.k, b.k) AS item, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) a FULL JOIN (SELECT p_partkey + 3 AS k FROM part) b ON a.k = b.k")
def set_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"))
    return statistics.diff(ordered, table(spark, sf_dir, "part").select((F.col("p_partkey") + 3).alias("item")))


@query("SELECT o_custkey + 20 AS c_custkey, count(*) AS n FROM orders WHERE o_custkey + 20 NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def missing_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 20).alias("c_custkey"))
    return statistics.missing(used, table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT p_name, count(DISTINCT p_brand) AS n_owners, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.shared_names(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '__' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def renamed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.renamed_duplicates(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


_OBJECTS_SQL = "SELECT p_brand AS memory_id, 'p' || p_partkey AS obj_id, p_type AS template, [p_name, lower(p_type), CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN p_type ELSE 'p' || (p_partkey + 25) END] AS aliases FROM part"


@query(f"""WITH o AS ({_OBJECTS_SQL}), e AS (SELECT memory_id, obj_id, template, unnest(aliases) AS alias FROM o), s AS (SELECT * FROM e WHERE trim(alias) <> ''), w AS (SELECT DISTINCT memory_id, obj_id, alias FROM s)
SELECT memory_id, obj_id, alias, 'empty' AS issue FROM e WHERE alias IS NULL OR trim(alias) = ''
UNION ALL SELECT memory_id, obj_id, alias, 'repeated in object' FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT memory_id, obj_id, alias, 'shared by objects' FROM (SELECT *, count(*) OVER (PARTITION BY memory_id, alias) AS n FROM w) WHERE n > 1
UNION ALL SELECT memory_id, obj_id, alias, 'equals an object id' FROM w WHERE alias <> obj_id AND EXISTS (SELECT 1 FROM o WHERE o.memory_id = w.memory_id AND o.obj_id = w.alias)
UNION ALL SELECT DISTINCT memory_id, obj_id, alias, 'equals the template' FROM s WHERE alias = template""")
def alias_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    odd = F.when(key % 5 == 0, F.col("p_name")).when(key % 7 == 0, " ").when(key % 11 == 0, F.col("p_type")).otherwise(F.concat(F.lit("p"), (key + 25).cast("string")))
    objects = table(spark, sf_dir, "part").select(F.col("p_brand").alias("memory_id"), F.concat(F.lit("p"), key.cast("string")).alias("obj_id"), F.col("p_type").alias("template"), F.array("p_name", F.lower("p_type"), odd).alias("aliases"))
    return aliases.issues(objects)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
