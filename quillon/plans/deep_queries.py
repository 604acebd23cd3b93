"""Deep chains over the driver's tables: parts in a row hang from one another, or are steps that need one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import geometry, hierarchy, planning
from quillon.plans.registry import query
from quillon.session import table

LONG, CHAIN = 300, 60
_TREE_SQL = f"""b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % {LONG} > 0 THEN p_partkey - 1 WHEN p_partkey // {LONG} % 3 = 1 THEN p_partkey + {LONG - 1} END AS up FROM part),
a AS (SELECT k, CASE WHEN up IN (SELECT k FROM b) THEN up END AS up FROM b)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, obj_id, parent_object_id, local): rows of three hundred; of every third such row the first hangs from the last."""
    k = F.col("p_partkey")
    up = F.when(k % LONG > 0, k - 1).when(F.floor(k / LONG) % 3 == 1, k + LONG - 1)
    one, zero = F.lit(1.0), F.lit(0.0)
    local = F.array(one, zero, zero, (k % 5).cast("double"), zero, one, zero, (k % 3).cast("double"), zero, zero, one, F.lit(2.0), zero, zero, zero, one)
    return table(spark, sf_dir, "part").select(F.lit(0).alias("scene_id"), k.alias("obj_id"), up.alias("parent_object_id"), local.alias("local"))


@query(f"""WITH RECURSIVE {_TREE_SQL}, t AS (SELECT k, 0 AS depth, k AS root, CAST(k AS VARCHAR) AS path, (k % 5)::DOUBLE AS x, (k % 3)::DOUBLE AS y FROM a WHERE up IS NULL
UNION ALL SELECT a.k, depth + 1, root, path || '.' || a.k, x + a.k % 5, y + a.k % 3 FROM a JOIN t ON a.up = t.k)
SELECT a.k AS obj_id, depth, root, md5(path) AS path, x, y FROM a LEFT JOIN t USING (k)""")
def deep_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, root, path and world place of every part, some hundreds deep; parts around a cycle have none."""
    tree = _tree(spark, sf_dir)
    path = {"path": (F.col("obj_id").cast("string"), lambda upper, lower: F.concat_ws(".", upper, lower))}
    found = hierarchy.rooted(tree, ["scene_id"], "obj_id", "parent_object_id", path)
    worlds = geometry.world_matrices(tree).select("obj_id", F.col("world")[3].alias("x"), F.col("world")[7].alias("y"))
    return found.join(worlds, "obj_id").select("obj_id", F.col("depth").cast("int").alias("depth"), "root", F.md5("path").alias("path"), "x", "y")


@query(f"""WITH RECURSIVE {_TREE_SQL}, t AS (SELECT k AS below, up AS above, 1 AS steps FROM a WHERE up IS NOT NULL UNION SELECT t.below, a.up, steps + 1 FROM t JOIN a ON a.k = t.above WHERE a.up IS NOT NULL AND steps < {LONG})
SELECT above AS obj_id, count(*) AS n_below, CAST(max(steps) AS INTEGER) AS deepest FROM (SELECT below, above, min(steps) AS steps FROM t WHERE below <> above GROUP BY ALL) GROUP BY above""")
def deep_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts hang from each, and how far down."""
    found = hierarchy.below(_tree(spark, sf_dir), ["scene_id"], "obj_id", "parent_object_id")
    return found.select("obj_id", "n_below", F.col("deepest").cast("int").alias("deepest"))


def _deep_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as actions in chains of sixty, each bringing its chain one step on.

    A part of even size has a rival that comes first in order and needs what nothing gives; one whose size is divisible by three
    has a rival that needs the step after. One of size 49 needs what nothing gives itself, so its chain ends there.
    """
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.floor(k / CHAIN).cast("string").alias("memory_id"), k.cast("string").alias("name"), (k % CHAIN).alias("i"), size.alias("size"))
    name = lambda mark: F.concat(F.lit(mark), "name")
    step = lambda i: F.concat(F.lit("at "), i.cast("string"))
    row = lambda action, kind, value: F.struct(action.alias("action_id"), F.lit(kind).alias("state_type"), value.alias("value"))
    i, gone = F.col("i"), F.lit("never")
    own = [row(name("do"), "new", step(i)), F.when(i > 0, row(name("do"), "precondition", step(i - 1))), F.when(F.col("size") == 49, row(name("do"), "precondition", gone))]
    dead = [F.when(F.col("size") % 2 == 0, row(name("a"), "new", step(i))), F.when(F.col("size") % 2 == 0, row(name("a"), "precondition", gone))]
    round_ = [F.when(F.col("size") % 3 == 0, row(name("b"), "new", step(i))), F.when(F.col("size") % 3 == 0, row(name("b"), "old", step(i + 1)))]
    each = F.explode(F.array_compact(F.array(*own, *dead, *round_)))
    return rows.select("memory_id", each.alias("c")).select("memory_id", "c.action_id", "c.state_type", F.concat(F.lit("chain "), "memory_id").alias("object"), F.lit("at").alias("path"), F.lit("eq").alias("op"), "c.value")


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey // {CHAIN} AS c, p_partkey % {CHAIN} AS i, p_partkey AS k, p_size AS s FROM part),
t AS (SELECT c, i FROM p WHERE i = 0 AND s <> 49 UNION ALL SELECT p.c, p.i FROM p JOIN t ON p.c = t.c AND p.i = t.i + 1 WHERE s <> 49),
e AS (SELECT p.c, p.i, k FROM p JOIN t USING (c, i) WHERE p.i % 20 = 19)
SELECT 'q' || e.c % 3 AS query_id, 'all' AS stage, 'do' || e.k AS seed, CAST(p.i AS INTEGER) AS step, 'do' || p.k AS action_id FROM e JOIN p ON p.c = e.c AND p.i <= e.i""")
def deep_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of up to sixty actions past dead ends and around cycles, for the twentieth, fortieth and sixtieth step of each chain."""
    conditions = _deep_conditions(spark, sf_dir)
    asked = F.concat(F.lit("q"), (F.col("memory_id").cast("long") % 3).cast("string")).alias("query_id")
    allowed = conditions.select(asked, F.lit("all").alias("stage"), "memory_id").distinct()
    ends = conditions.where("action_id like 'do%' and state_type = 'new'").where(F.substring_index("action_id", "o", -1).cast("long") % CHAIN % 20 == 19)
    chosen = ends.select(asked, F.lit("all").alias("stage"), "action_id")
    initial = spark.createDataFrame([], "query_id string, object string, path string, value string")
    return planning.seed_plans(chosen, allowed, conditions, initial)
