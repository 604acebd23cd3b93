"""Counts, shares and diffs over records: the reports of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def rare(df: DataFrame, key: str, below: int = 10) -> DataFrame:
    """The rows whose key occurs fewer than `below` times. The counts are reduced before they are joined."""
    few = counts(df, key).where(F.col("n") < below)
    return df.join(few, key)


# The relations that a report selects.
TARGET_RELATIONS = ("attached", "between", "front_of")


def of_relations(df: DataFrame, relation: str, wanted: Sequence[str] = TARGET_RELATIONS) -> DataFrame:
    """The rows whose relation is one of the wanted in any case; the relation comes out in lower case."""
    return df.withColumn(relation, F.lower(relation)).where(F.col(relation).isin(*wanted))


def term_counts(df: DataFrame, term: str) -> DataFrame:
    """(term, kind, n): how often each term occurs as it is, and each of its words where it has several."""
    words = F.split(F.trim(F.col(term)), r"[\s_]+")
    exact = df.select(F.col(term).alias("term"), F.lit("exact").alias("kind"))
    parts = df.where(F.size(words) > 1).select(F.explode(words).alias("term"), F.lit("word").alias("kind")).where("term <> ''")
    return exact.unionByName(parts).groupBy("term", "kind").agg(F.count("*").alias("n"))


def memory_term_counts(terms: DataFrame, memory: str = "memory_id") -> DataFrame:
    """(memory, n_isolated, n_triples, n_terms) of (memory, kind) rows with kind 'isolated' or 'triple'."""
    isolated = F.count_if(F.col("kind") == "isolated")
    triples = F.count_if(F.col("kind") == "triple")
    return terms.groupBy(memory).agg(isolated.alias("n_isolated"), triples.alias("n_triples"), F.count("*").alias("n_terms"))


def action_averages(parts: DataFrame, plan: str = "plan_id", kinds: Sequence[str] = ("verb", "object", "category")) -> DataFrame:
    """(plan, n_parts, each kind, total): the mean scores of the single-action plans that a plan was put together from."""
    means = parts.groupBy(plan).agg(F.count("*").alias("n_parts"), *(F.avg(F.coalesce(k, F.lit(0.0))).alias(k) for k in kinds))
    return means.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0.0)))


def histogram_of_sizes(df: DataFrame, group: str, member: str) -> DataFrame:
    """(size, n): how many groups have so many distinct members."""
    return df.groupBy(group).agg(F.countDistinct(member).alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def usage(df: DataFrame, measures: list[Column], *levels: str) -> DataFrame:
    """Sums by all levels, subtotals, and the grand total."""
    return df.rollup(*levels).agg(*measures)


def census(df: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n) of each key by itself."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("e")
    return df.select(each).groupBy("e.key", "e.value").agg(F.count("*").alias("n"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(item, side) of distinct items: 'left', 'right' or 'both'."""
    a, b = left.distinct().withColumn("_l", F.lit(1)), right.distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, "item", "full_outer").select("item", side.alias("side"))


def missing(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, n): names that are used but not known, and how often."""
    return used.join(known.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def renamed_duplicates(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df with unique_name: repeated names get __02, __03, ... in order."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", place).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), F.when(F.col("_n") < 10, F.concat(F.lit("0"), F.col("_n").cast("string"))).otherwise(F.col("_n").cast("string"))))).drop("_n")


def shared_names(df: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, n_owners, owners) of names that several owners have."""
    return df.groupBy(name).agg(F.countDistinct(owner).alias("n_owners"), F.array_join(F.array_sort(F.collect_set(owner)), ",").alias("owners")).where("n_owners > 1")
