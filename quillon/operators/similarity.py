"""Similarity joins over unit vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scoring import cosine
from quillon.functions.vocabulary import FUZZY_THRESHOLD
from quillon.session import cut, stored

#: Share of the threshold that the norm of a vector's unindexed rest stays under: less indexes more and leaves fewer candidates.
REST = 0.5
#: Queries and terms of a cell, on average: a cell holds their vectors and one matrix of their products.
QUERIES, TERMS, ROWS = 1024, 16384, 2048


def sparse_candidates(queries: DataFrame, terms: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(query, term) of all pairs of unit vectors (query, vec) and (term, vec) whose cosine may reach the threshold, by an inverted index of components.

    Components are taken from the rarest to the most common one. Of each vector those are indexed, its prefix, without which the
    norm of the rest is under REST of the threshold: a pair that shares none in both prefixes can't reach it. What a pair does share
    there is added up, and with the greater norm of the two rests it must still reach the threshold.
    """
    size = terms.select(F.size("vec").alias("n")).agg(F.max("n")).first()[0] or 0
    common = {r.d: r.n for r in terms.select(F.posexplode("vec").alias("d", "x")).where("x <> 0").groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row a component of the vectors
    order = sorted(range(size), key=lambda d: (common.get(d, 0), d))
    least = threshold - 1e-9

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        """(name, d, x, rest): the prefix of each vector, and the norm of what is left."""
        at = F.array(*map(F.lit, order))
        square = lambda x: x["x"] * x["x"]
        held = F.filter(F.transform(at, lambda d: F.struct(d.alias("d"), F.coalesce(F.get("vec", d).cast("double"), F.lit(0.0)).alias("x"))), lambda p: p["x"] != 0)
        # from the end on, components are left out as long as their norm stays small
        cut_ = F.aggregate(F.reverse("held"), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(True).alias("go")), lambda a, p: F.when(a["go"] & (F.sqrt(a["s"] + square(p)) < least * REST), F.struct((a["n"] + 1).alias("n"), (a["s"] + square(p)).alias("s"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["s"].alias("s"), F.lit(False).alias("go"))))
        marked = df.select(name, held.alias("held")).withColumn("cut", cut_)
        return marked.select(name, F.sqrt("cut.s").alias("rest"), F.explode(F.slice("held", F.lit(1), F.greatest(F.size("held") - F.col("cut.n"), F.lit(0)))).alias("p")).select(name, "rest", F.col("p.d").alias("d"), F.col("p.x").alias("x"))

    if not size:
        return queries.crossJoin(terms).limit(0).select("query", "term")
    asked = prefixes(queries, "query").withColumnsRenamed({"x": "qx", "rest": "qrest"})
    met = prefixes(terms, "term").join(asked, "d").groupBy("query", "term").agg(F.sum(F.col("x") * F.col("qx")).alias("s"), F.max(F.greatest("rest", "qrest")).alias("rest"))
    return met.where(F.col("s") + F.col("rest") >= least).select("query", "term")


def similar_terms(queries: DataFrame, terms: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(query, term, sim): for each unit vector (query, vec) the (term, vec) rows with a cosine at or above the threshold, exactly. Names are unique on each side."""
    queries, terms = stored(queries.select("query", "vec")), stored(terms.select("term", "vec"))
    pairs = sparse_candidates(queries, terms, threshold)
    both = pairs.join(terms, "term").join(queries.withColumnRenamed("vec", "asked"), "query")
    dot = F.aggregate(F.zip_with("vec", "asked", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("query", "term", dot.alias("sim")).where(F.col("sim") >= threshold)


def similar_in_cells(queries: DataFrame, terms: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """What `similar_terms` gives, for dense vectors, which no inverted index helps.

    Both sides are dealt into blocks by their counts, and a cell compares one block of each, whatever their number;
    a term is copied once for each block of queries.
    """
    queries, terms = cut(queries.select("query", "vec")), cut(terms.select("term", "vec"))
    n, m = -(-queries.count() // QUERIES) or 1, -(-terms.count() // TERMS) or 1
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    copies = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = terms.withColumn("i", deal("term", m)).withColumn("j", copies(n)).groupBy("i", "j")
    right = queries.withColumn("j", deal("query", n)).withColumn("i", copies(m)).groupBy("i", "j")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": pd.Series(dtype=object), "term": pd.Series(dtype=object), "sim": pd.Series(dtype=float)})]
        if len(a) and len(b):
            asked = np.stack(b["vec"].to_numpy()).astype(np.float64)
            for at in range(0, len(a), ROWS):
                part = a.iloc[at : at + ROWS]
                sims = np.stack(part["vec"].to_numpy()).astype(np.float64) @ asked.T
                t, q = np.nonzero(sims >= threshold)
                out.append(pd.DataFrame({"query": b["query"].to_numpy()[q], "term": part["term"].to_numpy()[t], "sim": sims[t, q]}))
        return pd.concat([x for x in out if len(x)] or out)

    return left.cogroup(right).applyInPandas(run, "query string, term string, sim double")


def close_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", rows_in_block: int = ROWS) -> DataFrame:
    """(left, right, sim) with left < right and a cosine of at least threshold, exactly.

    Rows are dealt by their cosine to a pivot: where two angles to it differ by more than the threshold's angle, so do the
    rows. They are cut by angle into blocks of about rows_in_block rows, and a block meets only those in reach of it.
    """
    sound = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.where(sound).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(1).collect()
    schema = "left long, right long, sim double"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    pivot = F.array(*(F.lit(float(x)) for x in first[0].v))
    rows = cut(rows.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(F.col("v"), pivot))))))
    n = rows.count()
    blocks = -(-n // rows_in_block)
    edges = sorted({float(x) for x in rows.agg(F.percentile_approx("angle", [k / blocks for k in range(1, blocks)] or [0.5], 20 * blocks)).first()[0]}) if blocks > 1 else []
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    bounds = F.array(*(F.lit(e) for e in edges)) if edges else F.array().cast("array<double>")
    block = lambda angle: F.size(F.filter(bounds, lambda e: e <= angle))
    # a row goes to the cells (own block, each block from its own on that its reach meets), and to (others below, own) as the right side
    placed = rows.withColumn("b", block(F.col("angle"))).withColumn("lo", block(F.col("angle") - reach)).withColumn("hi", block(F.col("angle") + reach))
    as_left = placed.select(F.col("id").alias("a"), F.col("v").alias("x"), F.col("b").alias("i"), F.explode(F.sequence("b", "hi")).alias("j")).groupBy("i", "j")
    as_right = placed.select(F.col("id").alias("b"), F.col("v").alias("y"), F.explode(F.sequence("lo", "b")).alias("k"), F.col("b").alias("l")).groupBy("k", "l")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        unit = lambda x: (m := np.stack(x.to_numpy()).astype(np.float64)) / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)
        out = [pd.DataFrame({"left": [], "right": [], "sim": []}).astype({"left": "int64", "right": "int64", "sim": "float64"})]
        if len(left) and len(right):
            other = unit(right["y"]).T
            for at in range(0, len(left), ROWS):
                part = left.iloc[at : at + ROWS]
                sims = unit(part["x"]) @ other
                a, b = np.nonzero(sims >= threshold)
                x, y = part["a"].to_numpy()[a], right["b"].to_numpy()[b]
                found = pd.DataFrame({"left": np.minimum(x, y), "right": np.maximum(x, y), "sim": sims[a, b]})
                out.append(found[x < y] if key[0] == key[1] else found[x != y])
        return pd.concat([x for x in out if len(x)] or out)

    return as_left.cogroup(as_right).applyInPandas(run, schema)
