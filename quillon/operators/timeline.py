"""Durations and timelines of action trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import hierarchy
from quillon.operators.scan import joined, running
from quillon.session import stored


def own_duration(temporal_type: Column, duration: Column, cycle: Column, repetitions: Column) -> Column:
    """Cycle times repetitions for a cyclical action with both above zero, else its duration."""
    cyclical = (temporal_type == "cyclical") & (cycle > 0) & (repetitions > 0)
    return F.when(cyclical, cycle * repetitions).otherwise(F.coalesce(duration, F.lit(0.0))).cast("double")


def sequential(df: DataFrame, group: str, order: list[str], duration: str) -> DataFrame:
    """start_time and end_time of rows that follow one another within a group."""
    w = Window.partitionBy(group).orderBy(*order)
    end = F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("end_time", end).withColumn("start_time", F.col("end_time") - F.col(duration))


def parallel(df: DataFrame, group: str, duration: str) -> DataFrame:
    """The longest of a group's durations, as the group's."""
    return df.groupBy(group).agg(F.max(duration).alias("total_duration"), F.count("*").alias("n_actions"))


def summary(actions: DataFrame) -> DataFrame:
    """For each memory: actions, roots, end, actions without duration, and counts by temporal type."""
    return actions.groupBy("memory_id").agg(
        F.count("*").alias("n_actions"),
        F.count_if(F.col("depth") == 0).alias("n_roots"),
        F.max("end_time").alias("max_end"),
        F.count_if(F.col("effective_duration") == 0).alias("n_zero"),
        F.count_if(F.col("temporal_type") == "sequential").alias("n_sequential"),
        F.count_if(F.col("temporal_type") == "parallel").alias("n_parallel"),
        F.count_if(F.col("temporal_type") == "cyclical").alias("n_cyclical"),
    )


def audit(df: DataFrame, duration: str = "duration", cyclical: Column | None = None) -> DataFrame:
    """(rounded, n): rows for each duration rounded half to even; null for missing ones."""
    cyclical = F.lit(False) if cyclical is None else cyclical
    return df.groupBy(F.bround(F.col(duration).cast("double"), 0).alias("rounded")).agg(F.count("*").alias("n"), F.count_if(F.col(duration) == 0).alias("n_zero"), F.count_if(cyclical).alias("n_cyclical"))


TIMES = "instance_id string, start_time double, end_time double, effective_duration double"


#: Actions of a memory up to which it is folded in one group.
SMALL = 10_000


def _slim(actions: DataFrame) -> DataFrame:
    return actions.select("memory_id", "instance_id", "parent_id", "child_ix", F.coalesce("temporal_type", F.lit("sequential")).alias("temporal_type"), F.col("own").cast("double"), F.coalesce("start_offset", F.lit(0.0)).cast("double").alias("start_offset"))


def timelines(actions: DataFrame, small: int = SMALL) -> DataFrame:
    """TIMES of every action of every memory's tree.

    actions: memory_id, instance_id, parent_id, child_ix, temporal_type, own (own_duration) and start_offset. A
    parent without a duration gets the sum of sequential or the maximum of parallel children; children of a
    parent of another type get no times. Memories of up to `small` actions are folded in one group each, larger ones
    by `spread_timelines`, which gives the same times but for the order in which durations are added.
    """
    slim = stored(_slim(actions))
    large = slim.groupBy("memory_id").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("memory_id", "_n")
    if large.isEmpty():
        return slim.groupBy("memory_id").applyInPandas(_fold, TIMES)
    marked = stored(joined(slim, large.withColumn("_large", F.lit(True)), ["memory_id"], "_n", slim.count(), "left"))
    few = marked.where("_large is null").drop("_large").groupBy("memory_id").applyInPandas(_fold, TIMES)
    return few.unionByName(spread_timelines(marked.where("_large").drop("_large")))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = {r.instance_id: r for r in pdf.itertuples()}
    children: dict[object, list] = {}
    for r in sorted(rows.values(), key=lambda r: r.child_ix):
        children.setdefault(r.parent_id if r.parent_id in rows else None, []).append(r)
    out: dict[str, tuple[float, float, float]] = {}

    def place(r, base: float) -> float:
        start, total = base + (r.start_offset or 0.0), r.own
        inner = children.get(r.instance_id, [])
        if inner and r.temporal_type in ("parallel", "sequential"):
            ends = []
            for c in inner:
                ends.append(place(c, ends[-1] if ends and r.temporal_type == "sequential" else start))
            if total == 0:
                total = max(start, *ends) - start if r.temporal_type == "parallel" else ends[-1] - start
        out[r.instance_id] = start, start + total, total
        return start + total

    for root in children.get(None, []):
        place(root, 0.0)
    return pd.DataFrame([(k, *v) for k, v in out.items()], columns=["instance_id", "start_time", "end_time", "effective_duration"])


def spread_timelines(actions: DataFrame) -> DataFrame:
    """TIMES of memories of any size, in tasks whose size no memory sets. actions as in `timelines`.

    How long an action takes with its offset is added up from its children, level by level from the lowest one on that has
    parents without a duration of their own. What lies before it among its siblings is a running total over ranges of all
    siblings. Both make the way from its parent's start to its own, and ways are added up from the roots by pointer doubling.
    """
    keys = ["memory_id", "instance_id"]
    slim = actions.select(*keys, "parent_id", "child_ix", "temporal_type", "own", "start_offset")
    depths = stored(hierarchy.rooted(slim, ["memory_id"], "instance_id", "parent_id").where("depth is not null").select(*keys, "depth"))
    nodes = stored(slim.join(depths, keys))
    parents = nodes.where("depth > 0").groupBy("memory_id", F.col("parent_id").alias("instance_id")).agg(F.count("*").alias("_children"))
    timed = F.col("temporal_type").isin("sequential", "parallel")
    nodes = stored(nodes.join(parents, keys, "left").withColumn("open", F.col("_children").isNotNull() & timed & (F.col("own") == 0)).drop("_children"))
    total = nodes.where("not open").select(*keys, "parent_id", "start_offset", F.col("own").alias("total"))
    levels = sorted((r.depth for r in nodes.where("open").select("depth").distinct().collect()), reverse=True)  # as many rows as the deepest tree has levels
    for depth in levels:
        below = total.where("parent_id is not null").groupBy("memory_id", F.col("parent_id").alias("instance_id")).agg(F.sum(F.col("start_offset") + F.col("total")).alias("_sum"), F.max(F.col("start_offset") + F.col("total")).alias("_max"))
        here = nodes.where("open").where(F.col("depth") == depth).join(below, keys)
        length = F.when(F.col("temporal_type") == "parallel", F.greatest(F.lit(0.0), "_max")).otherwise(F.col("_sum"))
        total = stored(total.unionByName(here.select(*keys, "parent_id", "start_offset", length.alias("total"))))
    full = stored(nodes.join(total.select(*keys, "total"), keys))
    upto = running(full, ["memory_id", "parent_id"], ["child_ix", "instance_id"], {"_upto": F.col("start_offset") + F.col("total")}, [*keys, "parent_id", "start_offset", "total", "depth"])
    kinds = full.select("memory_id", F.col("instance_id").alias("parent_id"), F.col("temporal_type").alias("_above"))
    sizes = full.where("depth > 0").groupBy("memory_id", "parent_id").agg(F.count("*").alias("_n"))
    placed = joined(upto, kinds.join(sizes, ["memory_id", "parent_id"]), ["memory_id", "parent_id"], "_n", full.count(), "left")
    before = F.when(F.col("depth") == 0, 0.0).when(F.col("_above") == "sequential", F.col("_upto") - F.col("start_offset") - F.col("total")).when(F.col("_above") == "parallel", 0.0)
    steps = placed.select(*keys, "parent_id", (before + F.col("start_offset")).alias("_way"), "total")
    found = hierarchy.rooted(steps, ["memory_id"], "instance_id", "parent_id", {"start_time": (F.col("_way"), lambda upper, lower: upper + lower)})
    out = found.where("start_time is not null").select(*keys, "start_time").join(steps.select(*keys, "total"), keys)
    return out.select("instance_id", "start_time", (F.col("start_time") + F.col("total")).alias("end_time"), F.col("total").alias("effective_duration"))
