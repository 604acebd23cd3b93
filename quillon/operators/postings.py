"""The inverted index over prefixed terms: postings, occurrence shares, frequency gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import vocabulary as V
from quillon.functions.text import raw_words, valid_row

POSTING = "term string, prefix string, phrase string, memory_id string, src string, term_type string, is_goal boolean, seq long"


def token_occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(memory_id, token, place): every valid token of every text, places ascending. Words are rows before they are told apart, so no array is filtered."""
    return df.select(F.col(id_col).alias("memory_id"), F.posexplode(raw_words(text_col)).alias("place", "token")).where(valid_row("token"))


# The prefixes that the shipped index keeps.
SHIPPED_PREFIXES = (
    "attribute_value", "attribute", "value", "attribute_token", "value_token", "object_token", "action_token", "goal_token", "other_token", "fullpath", "attribute_expanded", "value_expanded", "object_expanded",
    "action_expanded", "attribute_expanded_token", "value_expanded_token", "object_expanded_token", "action_expanded_token", "verb", "statechangesC_attribute", "statechangesC_value", "statechangesC_attribute_token",
    "statechangesC_value_token", "statechangesC_attribute_expanded", "statechangesC_value_expanded", "statechangesC_attribute_expanded_token", "statechangesC_value_expanded_token",
)


def whitelisted(postings: DataFrame, prefixes: Sequence[str] | None = SHIPPED_PREFIXES) -> DataFrame:
    """The postings whose prefix is allowed; None allows all, which is what the index is meant to hold."""
    return postings if prefixes is None else postings.where(F.col("prefix").isin(*prefixes))


def dedup(postings: DataFrame) -> DataFrame:
    """One posting of a term for each memory, source and type: the first."""
    first = Window.partitionBy("term", "memory_id", "src", "term_type").orderBy("seq")
    return postings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def shares(occurrences: DataFrame, term: str = "term", memory: str = "memory_id") -> DataFrame:
    """Occurrences and distinct memories of each term, and their percentages of all.

    Occurrences are counted by term and memory once, before the shuffle; terms, memories and totals all come from these.
    """
    return shares_by_memory(occurrences.groupBy(term, memory).agg(F.count("*").alias("_n")), term, memory)


def shares_by_memory(each: DataFrame, term: str = "term", memory: str = "memory_id") -> DataFrame:
    """shares of (term, memory, _n) rows, one for each term of a memory."""
    found = each.groupBy(term).agg(F.sum("_n").alias("occurrences"), F.count("*").alias("memory_count"))
    whole = each.groupBy(memory).agg(F.sum("_n").alias("_n")).agg(F.sum("_n").alias("_all"), F.count("*").alias("_memories"))
    return percentages(found.crossJoin(F.broadcast(whole)))  # one row


def percentages(counted: DataFrame) -> DataFrame:
    """counted (occurrences, memory_count, _all, _memories) with the shares of all occurrences and memories."""
    out = counted.withColumn("occurrence_percentage", F.round(F.col("occurrences") / F.col("_all") * 100, 6))
    return out.withColumn("memory_percentage", F.round(F.col("memory_count") / F.col("_memories") * 100, 6)).drop("_all", "_memories")


def asked_tokens(df: DataFrame, id_col: str, text_col: str, asked: Sequence[str]) -> DataFrame:
    """(memory_id, token, n): how often each memory has each of the tokens that are asked for, and with a null token all others."""
    found = token_occurrences(df, id_col, text_col)
    return found.groupBy("memory_id", F.when(F.col("token").isin(*asked), F.col("token")).alias("token")).agg(F.count("*").alias("n"))


def shares_of(counted: DataFrame) -> DataFrame:
    """shares of the asked tokens alone; counted: as asked_tokens gives it."""
    found = counted.where("token is not null").groupBy(F.col("token").alias("term")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("memory_count"))
    whole = counted.groupBy("memory_id").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("_all"), F.count("*").alias("_memories"))
    return percentages(found.crossJoin(F.broadcast(whole)))  # one row


def gate(percentage: Column) -> Column:
    """What a term's share of occurrences lets it do: 'unmatchable', 'one_match' or 'diminishing'."""
    share = percentage / 100
    lo, hi = V.ONE_MATCH_SHARES
    return F.when(share >= V.UNMATCHABLE_SHARE, "unmatchable").when((share > lo) & (share <= hi), "one_match").otherwise("diminishing")


def unmatchable_components(freq: DataFrame) -> DataFrame:
    """(component): structural ones and those too frequent to tell anything."""
    common = freq.where(F.col("term").startswith("attribute:") & (gate(F.col("occurrence_percentage")) == "unmatchable")).select(F.regexp_replace("term", "^attribute:", "").alias("component"))
    fixed = freq.sparkSession.createDataFrame([(c,) for c in sorted(V.STRUCTURAL_COMPONENTS)], "component string")
    return common.unionByName(fixed).distinct()
