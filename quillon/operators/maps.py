"""Comparing relation maps: alignment of their points, agreement of their links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scoring import category_chain_overlap
from quillon.functions.vocabulary import GENERIC_CATEGORIES

LEAST_OVERLAP = 0.3


def point_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, a, b, sim) of the points of two maps: 1 for the same template, else the overlap of the category chains. Both sides: pair_id, object_id, template, categories."""
    drop = F.array(*(F.lit(c) for c in GENERIC_CATEGORIES))
    one = left.select("pair_id", F.col("object_id").alias("a"), F.col("template").alias("a_t"), F.array_except("categories", drop).alias("a_c"))
    two = right.select("pair_id", F.col("object_id").alias("b"), F.col("template").alias("b_t"), F.array_except("categories", drop).alias("b_c"))
    sim = F.when(F.col("a_t") == F.col("b_t"), 1.0).otherwise(category_chain_overlap(F.col("a_c"), F.col("b_c")))
    return one.join(two, "pair_id").select("pair_id", "a", "b", sim.alias("sim")).where(F.col("sim") >= LEAST_OVERLAP)


def align(scored: DataFrame) -> DataFrame:
    """(pair_id, a, b, sim): one to one, the best pairs first. Two maps are one small group."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, keep = set(), set(), []
        for r in pdf.sort_values(["sim", "a", "b"], ascending=[False, True, True]).itertuples():
            if r.a not in used_a and r.b not in used_b:
                used_a.add(r.a)
                used_b.add(r.b)
                keep.append(r.Index)
        return pdf.loc[keep, ["pair_id", "a", "b", "sim"]]

    return scored.groupBy("pair_id").applyInPandas(greedy, "pair_id string, a string, b string, sim double")


def similarity(left: DataFrame, right: DataFrame, left_links: DataFrame, right_links: DataFrame) -> DataFrame:
    """(pair_id, similarity): half the mean point similarity times the coverage, half the share of aligned links that agree."""
    pairs = align(point_similarity(left, right))
    size = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    points = pairs.groupBy("pair_id").agg(F.avg("sim").alias("mean"), F.count("*").alias("n")).join(size(left, "n_a"), "pair_id").join(size(right, "n_b"), "pair_id")
    cover = points.select("pair_id", (F.col("mean") * F.col("n") / F.greatest("n_a", "n_b")).alias("points"))
    names = lambda col: pairs.select("pair_id", F.col("a").alias(col), F.col("b").alias(f"_{col}"))
    moved = left_links.select("pair_id", "predicate", "source", "target").join(names("source"), ["pair_id", "source"]).join(names("target"), ["pair_id", "target"]).select("pair_id", "predicate", F.col("_source").alias("source"), F.col("_target").alias("target")).distinct()
    kept = right_links.select("pair_id", "predicate", "source", "target").join(pairs.select("pair_id", F.col("b").alias("source")), ["pair_id", "source"], "left_semi").join(pairs.select("pair_id", F.col("b").alias("target")), ["pair_id", "target"], "left_semi").distinct()
    both = moved.withColumn("_a", F.lit(1)).join(kept.withColumn("_b", F.lit(1)), ["pair_id", "predicate", "source", "target"], "full_outer")
    agree = both.groupBy("pair_id").agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("links"))
    whole = cover.join(agree, "pair_id", "left")
    return whole.select("pair_id", F.round(0.5 * F.col("points") + 0.5 * F.coalesce("links", F.lit(0.0)), 6).alias("similarity"))
