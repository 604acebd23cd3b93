"""Finding the template that a name means: lexical rank, vectors, and lookups in order of trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.embedding import Embedder, hashed_ngrams
from quillon.functions.scoring import dot
from quillon.functions.text import normal_name, words
from quillon.operators.similarity import similar_terms

K1, B = 1.5, 0.75
#: Least blend of both ranks for a template to be taken, and of an action's name and trajectory together.
NAME_THRESHOLD, ACTION_THRESHOLD = 0.85, 0.92


def bm25(names: DataFrame, documents: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(name, id, bm25) of stated names against (id, words) documents that share a word with them."""
    terms = documents.select("id", F.explode("words").alias("w"))
    tf = terms.groupBy("id", "w").agg(F.count("*").alias("f"))
    length = documents.select("id", F.size("words").alias("dl"))
    whole = length.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = names.select("name", F.explode(F.array_distinct(words("name"))).alias("w"))
    hits = tf.join(F.broadcast(asked), "w")
    df = tf.join(F.broadcast(asked.select("w").distinct()), "w").groupBy("w").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "w").join(length, "id").crossJoin(F.broadcast(whole))  # df: a row for each asked word; whole: one row
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("name", "id").agg(F.sum(part).alias("bm25"))


def blended(names: DataFrame, documents: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """(name, id, score): the mean of BM25 over its best for the name and the cosine of the vectors. documents: (id, text)."""
    embed = embed or hashed_ngrams()
    lexical = bm25(names, documents.select("id", words("text").alias("words")))
    scaled = lexical.withColumn("lex", F.col("bm25") / F.max("bm25").over(Window.partitionBy("name"))).select("name", "id", "lex")
    vectors = documents.select("id", embed(F.col("text")).alias("v"))
    pairs = vectors.crossJoin(F.broadcast(names.select("name", embed(F.col("name")).alias("q")).distinct()))  # stated names
    both = pairs.select("name", "id", dot(F.col("v"), F.col("q")).alias("cos")).join(scaled, ["name", "id"], "left")
    return both.select("name", "id", ((F.coalesce("lex", F.lit(0.0)) + F.col("cos")) / 2).alias("score"))


def best_template(names: DataFrame, documents: DataFrame, threshold: float = NAME_THRESHOLD, embed: Embedder | None = None) -> DataFrame:
    """(name, id, score) of the best template of each name that reaches the threshold.

    Neither half of a blend is over 1, so a blend of the threshold needs both halves from twice the threshold less 1 on. Only
    documents whose lexical half is so high are embedded and compared, where that is above 0; no pair is formed that shares no word.
    """
    first = Window.partitionBy("name").orderBy(F.desc(F.round("score", 9)), "id")
    least = 2 * threshold - 1
    found = blended(names, documents, embed) if least <= 0 else _bounded(names, documents, least - 1e-9, embed or hashed_ngrams())
    return found.where(F.col("score") >= threshold).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _bounded(names: DataFrame, documents: DataFrame, least: float, embed: Embedder) -> DataFrame:
    """blended, of the pairs whose lexical half reaches least."""
    lexical = bm25(names, documents.select("id", words("text").alias("words")))
    scaled = lexical.withColumn("lex", F.col("bm25") / F.max("bm25").over(Window.partitionBy("name"))).where(F.col("lex") >= least)
    both = scaled.join(documents.select("id", "text"), "id")
    cos = dot(embed(F.col("text")), embed(F.col("name")))
    return both.select("name", "id", ((F.col("lex") + cos) / 2).alias("score"))


def trajectory_score(name: str = "t1", other: str = "t2", embed: Embedder | None = None):
    """1 for equal trajectories, the cosine from 0.7 on, else 0."""
    embed = embed or hashed_ngrams()
    cos = dot(embed(F.col(name)), embed(F.col(other)))
    return F.when(F.col(name) == F.col(other), 1.0).when(cos >= 0.7, cos).otherwise(0.0)


def resolve(names: DataFrame, templates: DataFrame, aliases: DataFrame, threshold: float = 0.6, embed: Embedder | None = None) -> DataFrame:
    """(name, template, how): by equal normal name, else by an alias, else by the nearest vector."""
    embed = embed or hashed_ngrams()
    asked = names.select("name", normal_name("name").alias("n")).distinct()
    exact = asked.join(templates.select(normal_name("template").alias("n"), "template"), "n").groupBy("name").agg(F.min("template").alias("template")).withColumn("how", F.lit("name"))
    rest = asked.join(exact, "name", "left_anti")
    alias = rest.join(aliases.select(normal_name("alias").alias("n"), F.col("base").alias("template")), "n").groupBy("name").agg(F.min("template").alias("template")).withColumn("how", F.lit("alias"))
    rest = rest.join(alias, "name", "left_anti").select("name", embed(F.col("name")).alias("q"))
    named = templates.select(F.col("template").alias("term")).distinct().select("term", embed(F.col("term")).alias("vec"))
    near = similar_terms(rest.select(F.col("name").alias("query"), F.col("q").alias("vec")), named, threshold).select(F.col("query").alias("name"), F.col("term").alias("template"), F.col("sim").alias("s"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("s"), "template"))).where("_n = 1").select("name", "template", F.lit("similar").alias("how"))
    return exact.unionByName(alias).unionByName(near)
