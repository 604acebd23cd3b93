"""Running totals within groups of any size, and joins to keys of any weight.

A window puts a whole group into one task. Here rows are dealt by ranges of group and order instead, totals run within
a range, and what a group has before its range is carried in by a table of at most two rows a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import stored

#: A key that holds more than one in so many of all rows is hot; there are fewer hot keys than this.
HOT = 1024


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, Column | str], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns keep (all of df's without any given) with the total of each of totals over its group's rows up to itself.

    Rows that are equal in order stand in any order. A group that fills many ranges is added up in many tasks.
    """
    keep = list(df.columns if keep is None else keep)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_v{i}": F.expr(v) if isinstance(v, str) else v for i, v in enumerate(totals.values())})
    values = [f"_v{i}" for i in range(len(totals))]
    names = [f"_g{i}" for i in range(len(group))]
    dealt = valued.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    placed = stored(dealt.select(*keep, *(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), *values, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    sums = placed.groupBy("_range", *names).agg(*(F.sum(v).alias(v) for v in values))
    key = F.struct(*names)
    edges = placed.groupBy("_range").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_edges")).select("_range", F.explode("_edges").alias("_edge"))
    # only the first and the last group of a range go on in another one
    at_edge = sums.join(F.broadcast(edges), (sums["_range"] == edges["_range"]) & F.struct(*(sums[n] for n in names)).eqNullSafe(F.col("_edge"))).select(*(sums[c] for c in sums.columns))
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = at_edge.select("_range", *names, *(F.sum(v).over(before).alias(f"_c{i}") for i, v in enumerate(values)))
    carried = carried.where(" or ".join(f"_c{i} is not null" for i in range(len(values)))).select(F.col("_range").alias("_in"), F.struct(*names).alias("_of"), *(f"_c{i}" for i in range(len(values))))
    so_far = Window.partitionBy("_range", *names).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({v: F.sum(v).over(so_far) for v in values})
    out = local.join(F.broadcast(carried), (F.col("_range") == F.col("_in")) & F.struct(*names).eqNullSafe(F.col("_of")), "left")
    return out.select(*keep, *((F.col(v) + F.coalesce(f"_c{i}", F.lit(0))).alias(name) for i, (name, v) in enumerate(zip(totals, values, strict=True))))


def joined(rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a table of one row a key, whose weights are the rows that a key has and add up to total at most.

    Keys of more than a HOT-th of total are fewer than HOT, so they are sent to the rows; all others are met by a shuffle,
    which no key can fill. The weight is not in the result.
    """
    hot = table.where(F.col(weight) * HOT > total).drop(weight).withColumn("_hot", F.lit(True))
    cold = table.where(F.col(weight) * HOT <= total).drop(weight).hint("merge")
    met = rows.join(F.broadcast(hot), list(on), "left")
    rest = met.where("_hot is null").select(*rows.columns).join(cold, list(on), how)
    return met.where("_hot").select(*rest.columns).unionByName(rest)
