"""From scored matches to ranked memories: diminishing, caps, co-match, sums, top-k.

Contributions carry memory_id, object_id, query_term, matched_term, score, mode, src, term_type, alias_used and
seq. All steps are windows keyed by memory and term, so they spread over the memories; ties are broken by seq.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import vocabulary as V

#: Modes whose matches diminish where they are made, not globally.
LOCAL_MODES = ("component_exact", "component_fuzzy", "token_exact", "token_fuzzy", "verb_exact", "verb_fuzzy")


def best_first(*keys: str, score: str = "score", tie: str = "seq") -> Window:
    return Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())


def nth_factor(n: Column, factors: Sequence[float]) -> Column:
    """The nth factor, counted from 1; 0 beyond them."""
    out = F.when(n == 1, F.lit(float(factors[0])))
    for k, factor in enumerate(factors[1:], 2):
        out = out.when(n == k, F.lit(float(factor)))
    return out.otherwise(0.0)


def diminish(df: DataFrame, keys: Sequence[str], order: Sequence[Column], factors: Sequence[float], score: str = "score") -> DataFrame:
    """score times the factor of the row's place among its keys; rows with factor 0 go."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).where(F.col("_n") <= sum(f > 0 for f in factors)).withColumn(score, F.col(score) * nth_factor(F.col("_n"), factors)).drop("_n")


def cap(df: DataFrame, keys: Sequence[str], n: int | Column = V.TERM_CAP, score: str = "score", tie: str = "seq") -> DataFrame:
    """The n best rows of each key."""
    return df.withColumn("_n", F.row_number().over(best_first(*keys, score=score, tie=tie))).where(F.col("_n") <= n).drop("_n")


def merge_aliases(df: DataFrame, base: str = "query_base") -> DataFrame:
    """Of one base term's matches with one index term in one memory, the best for each source."""
    return cap(df, [base, "matched_term", "memory_id", "src"], 1)


def global_diminishing(df: DataFrame) -> DataFrame:
    local = F.col("mode").isin(*LOCAL_MODES)
    others = diminish(df.where(~local), ["query_term", "matched_term", "memory_id"], [F.col("score").desc(), F.col("seq")], V.DIMINISHING)
    return df.where(local).unionByName(others)


def co_match(df: DataFrame, keys: Sequence[str] = ("memory_id", "object_id"), score: str = "score") -> DataFrame:
    """score times 1.2 for each further match on the same object, 2.0 at most."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    factor = F.when(F.col(keys[-1]).isNull(), 1.0).otherwise(F.least(F.pow(F.lit(V.CO_MATCH_BASE), n - 1), F.lit(V.CO_MATCH_CAP)))
    return df.withColumn(score, F.col(score) * factor)


def settle(contributions: DataFrame) -> DataFrame:
    """The chain of steps, in its order: alias merge, query term cap, global diminishing, co-match, index term cap."""
    merged = cap(merge_aliases(contributions), ["memory_id", "query_base"])
    return cap(co_match(global_diminishing(merged)), ["memory_id", "matched_term"])


def rank(contributions: DataFrame, top: int | None = None, details: bool = False) -> DataFrame:
    """(memory_id, score[, details]) by score; details hold every match, best first."""
    sums = [F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n_matches")]
    if details:
        found = F.struct((-F.col("score")).alias("_order"), "seq", "query_term", "matched_term", "score", "mode", "src", "term_type", "alias_used")
        sums.append(F.sort_array(F.collect_list(found)).alias("details"))
    ranked = contributions.groupBy("memory_id").agg(*sums)
    return ranked if top is None else ranked.orderBy(F.desc("score"), "memory_id").limit(top)


def drill_down(contributions: DataFrame, memory_id, top: int | None = 20) -> DataFrame:
    """The best matches of one memory, all of them if top is None."""
    found = contributions.where(F.col("memory_id") == memory_id).orderBy(F.desc("score"), "seq")
    return found if top is None else found.limit(top)
