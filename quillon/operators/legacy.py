"""The older, weighted matching: six stages, each for the terms that no earlier stage could match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.embedding import Embedder, hashed_ngrams
from quillon.functions.text import numeric_string, term_phrase, valid_token, words
from quillon.operators.similarity import similar_terms

THRESHOLD = 0.8
STAGES = ("exact", "value_pair", "phrase", "phrase_word", "component", "word")


def value_pairs(postings: DataFrame) -> DataFrame:
    """Postings under their `path=value` phrase."""
    return postings.where(F.col("phrase").contains("=")).withColumn("key", F.col("phrase"))


def cascade(postings: DataFrame, terms: DataFrame, embed: Embedder | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(query_term, weight, term, memory_id, stage, score) of weighted terms.

    Stages: the equal term; the equal path=value; the nearest whole phrase; equal words of the phrase; the nearest
    path component; the nearest word. A later stage sees only terms that all earlier ones left.
    """
    embed = embed or hashed_ngrams()
    asked = terms.withColumn("q", term_phrase("query_term"))
    index = postings.select("term", "phrase", "memory_id").distinct()
    phrases = index.select("phrase").distinct()

    def matched(left: DataFrame, pairs: DataFrame, stage: str, factor: Column) -> DataFrame:
        return left.join(pairs, "query_term").join(index, "phrase").select("query_term", "weight", "term", "memory_id", F.lit(stage).alias("stage"), (F.col("weight") * factor).alias("score"))

    def near(left: DataFrame, pieces: DataFrame) -> DataFrame:
        """Pairs of a query and the phrases with a piece near it."""
        vectors = pieces.select("piece").distinct().select(F.col("piece").alias("term"), embed(F.col("piece")).alias("vec"))
        found = similar_terms(left.select(F.col("q").alias("query"), embed(F.col("q")).alias("vec")).distinct(), vectors, threshold)
        return left.select("query_term", "q").join(found, F.col("q") == F.col("query")).join(pieces, F.col("term") == F.col("piece")).groupBy("query_term", "phrase").agg(F.max("sim").alias("sim"))

    equal = asked.join(index, asked["query_term"] == index["term"]).select("query_term", "weight", "term", "memory_id", F.lit("exact").alias("stage"), F.col("weight").alias("score"))
    out, left = equal, asked.join(equal.select("query_term").distinct(), "query_term", "left_anti")
    whole = phrases.withColumn("piece", F.col("phrase"))
    parts = phrases.withColumn("piece", F.explode(F.split(F.substring_index("phrase", "=", 1), r"\.")))
    each = phrases.withColumn("piece", F.explode(words("phrase")))
    paired = left.where(F.col("q").contains("=")).select("query_term", F.col("q").alias("phrase"), F.lit(1.0).alias("sim"))
    by_word = left.select("query_term", F.explode(words("q")).alias("piece")).join(each, "piece").select("query_term", "phrase", F.lit(1.0).alias("sim")).distinct()
    for stage, pairs, factor in (("value_pair", lambda x: paired, 1.0), ("phrase", lambda x: near(x, whole), 0.9), ("phrase_word", lambda x: by_word, 0.6), ("component", lambda x: near(x, parts), 0.5), ("word", lambda x: near(x, each), 0.3)):
        hits = matched(left, pairs(left), stage, F.col("sim") * factor)
        out = out.unionByName(hits)
        left = left.join(hits.select("query_term").distinct(), "query_term", "left_anti")
    return out


def attribute_value_score(q_value: Column, e_value: Column, path_similarity: Column, threshold: float = THRESHOLD) -> Column:
    """A similar path with an equal value 1.0, with a number within half and one and a half 0.7, else nothing."""
    q, e = q_value.try_cast("double"), e_value.try_cast("double")
    score = F.when(q_value == e_value, 1.0).when(q.between(0.5 * e, 1.5 * e), 0.7).otherwise(0.0)
    return F.when(path_similarity >= threshold, score).otherwise(0.0)


def recent(postings: DataFrame, memories: DataFrame, n: int) -> DataFrame:
    """Postings of the n latest memories (memory_id, place): the index of a generation run."""
    latest = memories.orderBy(F.desc("place"), "memory_id").limit(n).select("memory_id")
    return postings.join(latest, "memory_id", "left_semi")


# Attributes of the older index that are never taken apart.
WHOLE_ATTRIBUTES = ("category", "materials", "functions", "shape", "position", "dimensions")


def common_attributes(rows: DataFrame) -> DataFrame:
    """(attribute, value) rows that the older index takes apart: no whole attributes, no stop or unit words, no numbers."""
    return rows.where(~F.lower("attribute").isin(*WHOLE_ATTRIBUTES) & valid_token(F.lower("value")) & ~numeric_string("value"))


def frequencies(postings: DataFrame) -> DataFrame:
    """(item, kind, n) of the older index: whole terms, and the components of their paths without the values."""
    terms = postings.select(F.col("term").alias("item"), F.lit("term").alias("kind"))
    path = F.split(F.substring_index("phrase", "=", 1), r"\.")
    parts = postings.where(F.col("phrase").contains("=")).select(F.explode(path).alias("item"), F.lit("component").alias("kind"))
    return terms.unionByName(parts).groupBy("item", "kind").agg(F.count("*").alias("n"))
