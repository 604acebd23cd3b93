"""Search: query terms in, contributions out, one function for each way of matching.

Query terms are a frame (query_term, position); terms under `goalstate:` are matched as their inner term with a
goal flag. Every mode is a join of the few query terms against the index; the side that is broadcast is the
stated query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import vocabulary as V
from quillon.functions.embedding import Embedder, hashed_ngrams
from quillon.functions.scoring import core_match, goal_factor, name_factor, position_score, type_multiplier
from quillon.functions.text import let, term_phrase, term_prefix
from quillon.functions.units import in_base_unit, number_of, quantity_of, unit_of
from quillon.operators import postings as P
from quillon.operators import ranking
from quillon.operators.similarity import similar_terms
from quillon.session import stored

CONTRIBUTION = ["memory_id", "object_id", "query_term", "matched_term", "score", "mode", "src", "term_type", "similarity", "alias_used", "seq"]
FULLPATH = "memory_id string, action string, object string, path array<string>, op string, value string, items array<string>, state_type string, src string, is_goal boolean, seq long"
MEASUREMENT = "memory_id string, object_id string, path string, numeric double, unit string, src string, seq long"
OBJECT = "memory_id string, obj_id string, template string, relation string, relationr string, relative_to array<string>, obj_ix long"


@dataclass
class Index:
    """The tables of an index, those that the ways of matching in use need. aliases: (kind, base, alias, rank); alias_terms: (alias_term, base_term)."""

    postings: DataFrame | None = None
    fullpath: DataFrame | None = None
    measurements: DataFrame | None = None
    objects: DataFrame | None = None
    aliases: DataFrame | None = None
    alias_terms: DataFrame | None = None
    freq: DataFrame | None = None
    banned: DataFrame | None = None
    embed: Embedder = hashed_ngrams()


def _mode_of(prefix: Column) -> tuple[Column, Column]:
    """(family, query type) of a term's prefix."""
    plain = F.regexp_replace(F.regexp_replace(prefix, f"^{V.CONDITIONAL}", ""), "_expanded", "")
    family = F.when(plain.isin(*V.TOKEN_TYPES), "token").when(plain.isin("attribute", "value"), "component").when(plain.isin("object", "action"), plain).otherwise("exact")
    kind = F.regexp_replace(plain, "_token$", "")
    return family, kind


def prepared(terms: DataFrame) -> DataFrame:
    """(query_term, term, prefix, phrase, goal_query, family, query_type, position) of raw query terms."""
    inner = F.regexp_replace("query_term", "^goalstate:", "")
    out = terms.select("query_term", "position", inner.alias("term"), F.col("query_term").startswith("goalstate:").alias("goal_query"))
    out = out.withColumn("prefix", term_prefix("term")).withColumn("phrase", term_phrase("term"))
    family, kind = _mode_of(F.col("prefix"))
    return out.withColumn("family", family).withColumn("query_type", kind)


def _group(prefix: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(prefix, f"^{V.CONDITIONAL}", ""), "_expanded", "")


def exact_hits(ix: Index, queries: DataFrame) -> DataFrame:
    """Postings of the very terms that are asked for. Columns: those of queries and postings, exact, similarity."""
    asked = F.broadcast(queries.withColumnsRenamed({"term": "q_term", "prefix": "q_prefix", "phrase": "q_phrase"}))  # the stated query
    return ix.postings.join(asked, F.col("term") == F.col("q_term")).withColumn("exact", F.lit(True)).withColumn("similarity", F.lit(None).cast("double"))


def similar_hits(ix: Index, queries: DataFrame) -> DataFrame:
    """Postings of terms that are similar to asked ones which are nowhere in the index."""
    asked = queries.where("family <> 'exact'")
    known = ix.postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").select("term").distinct()  # as many as are asked for
    loose = asked.join(known, "term", "left_anti")
    words = ix.postings.select("term").distinct() if ix.freq is None else ix.freq.select("term")  # a row a term
    vocabulary = words.select("term", _group(term_prefix("term")).alias("g"), ix.embed(term_phrase("term")).alias("vec"))
    asked_vectors = loose.select(F.concat_ws("\u0001", _group(F.col("prefix")), "phrase").alias("query"), ix.embed(F.col("phrase")).alias("vec")).distinct()
    near = similar_terms(asked_vectors, vocabulary.select(F.concat_ws("\u0001", "g", "term").alias("term"), "vec"))
    cut_at = lambda c, k: F.split(c, "\u0001")[k]
    near = near.where(cut_at(F.col("query"), 0) == cut_at(F.col("term"), 0)).select(cut_at(F.col("query"), 0).alias("g"), cut_at(F.col("query"), 1).alias("q_phrase"), cut_at(F.col("term"), 1).alias("term"), F.col("sim").alias("similarity"))
    fuzzy = loose.withColumnsRenamed({"term": "q_term", "prefix": "q_prefix", "phrase": "q_phrase"}).withColumn("g", _group(F.col("q_prefix"))).join(near, ["g", "q_phrase"]).drop("g")
    return ix.postings.join(fuzzy, "term").withColumn("exact", F.lit(False))


def folded(ix: Index, hits: DataFrame) -> DataFrame:
    """hits with matched, the base term of an alias or the term itself, and alias_used."""
    names = ix.alias_terms.withColumnsRenamed({"alias_term": "term", "base_term": "_base"})
    return hits.join(names, "term", "left").withColumn("matched", F.coalesce("_base", "term")).withColumn("alias_used", F.col("_base").isNotNull()).drop("_base")


def _hits(ix: Index, queries: DataFrame) -> DataFrame:
    """Postings that the queries meet, exactly or, where a term is nowhere in the index, by similarity."""
    exact = exact_hits(ix, queries)
    return folded(ix, exact.unionByName(similar_hits(ix, queries).select(*exact.columns)))


def _once(hits: DataFrame) -> DataFrame:
    first = Window.partitionBy("query_term", "matched", "memory_id", "src", "term_type").orderBy("seq")
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _contributions(df: DataFrame, score: Column, mode: Column, object_id: Column | None = None) -> DataFrame:
    return df.select(
        "memory_id", (F.lit(None).cast("string") if object_id is None else object_id).alias("object_id"), "query_term", F.col("matched").alias("matched_term"), score.alias("score"), mode.alias("mode"),
        "src", "term_type", "similarity", "alias_used", "seq",
    )


def component_and_token_matches(ix: Index, hits: DataFrame) -> DataFrame:
    """Components and tokens: gated by frequency, diminishing within a memory in posting order."""
    hits = _once(hits.where(F.col("family").isin("component", "token")))
    met = hits.select("matched").distinct()  # the terms that are met, not the whole vocabulary
    share = ix.freq.select(F.col("term").alias("matched"), "occurrence_percentage").join(met, "matched", "left_semi")
    gated = hits.join(share, "matched", "left").withColumn("gate", P.gate(F.coalesce("occurrence_percentage", F.lit(0.0))))
    values = F.col("query_type") == "value"
    gated = gated.where(values | (F.col("gate") != "unmatchable"))
    place = F.row_number().over(Window.partitionBy("query_term", "matched", "memory_id").orderBy("seq"))
    n = F.when(~values & (F.col("gate") == "one_match") & (place > 1), F.lit(99)).otherwise(place)
    gated = gated.withColumn("_n", n).withColumn("_f", F.when(values, ranking.nth_factor(F.col("_n"), V.DIMINISHING_VALUES)).otherwise(ranking.nth_factor(F.col("_n"), V.DIMINISHING))).where("_f > 0")
    same = F.col("query_type") == F.col("term_type")
    kind = F.when(F.col("family") == "component", type_multiplier(V.COMPONENT_MULTIPLIERS, F.col("exact"), same)).otherwise(type_multiplier(V.TOKEN_MULTIPLIERS, F.col("exact"), same))
    score = kind * F.col("_f") * F.when(F.col("alias_used"), V.ALIAS_PENALTY).otherwise(1.0) * goal_factor(F.col("goal_query"), F.col("is_goal"))
    return _contributions(gated, score, F.concat_ws("_", "family", F.when(F.col("exact"), "exact").otherwise("fuzzy")))


def name_matches(ix: Index, hits: DataFrame) -> DataFrame:
    """Objects and actions by name: 1.0 equal, 0.9 similar."""
    hits = _once(hits.where(F.col("family").isin("object", "action")))
    score = F.when(F.col("exact"), 1.0).otherwise(0.9) * F.when(F.col("alias_used"), V.ALIAS_PENALTY).otherwise(1.0) * goal_factor(F.col("goal_query"), F.col("is_goal"))
    return _contributions(hits, score, F.concat_ws("_", "family", F.when(F.col("exact"), "exact").otherwise("fuzzy")))


def exact_matches(hits: DataFrame) -> DataFrame:
    """Any other term: every posting of it, whether repeated or not."""
    hits = hits.where((F.col("family") == "exact") & F.col("exact") & ~F.col("prefix").isin("verb"))
    return _contributions(hits.withColumn("matched", F.col("term")).withColumn("alias_used", F.lit(False)), goal_factor(F.col("goal_query"), F.col("is_goal")), F.lit("exact"))


def verb_matches(ix: Index, queries: DataFrame) -> DataFrame:
    """All verbs similar to the asked ones; equal names are exact. Capped for each memory and asked verb."""
    asked = queries.where(F.col("prefix").isin(*V.VERB_CAPS))
    verbs = ix.postings.where("prefix = 'verb'")
    names = verbs.select("phrase").distinct().select(F.col("phrase").alias("term"), ix.embed(F.col("phrase")).alias("vec"))
    near = similar_terms(asked.select(F.col("phrase").alias("query"), ix.embed(F.col("phrase")).alias("vec")).distinct(), names)
    near = near.withColumn("exact", F.col("query") == F.col("term"))
    hits = verbs.drop("prefix").join(near.withColumnRenamed("term", "phrase"), "phrase").join(F.broadcast(asked.select("query_term", F.col("phrase").alias("query"), F.col("prefix"), "goal_query")), "query")
    exact, fuzzy = V.VERB_SCORES
    score = F.when(F.col("exact"), exact).otherwise(fuzzy) * F.when(F.col("goal_query") | F.col("is_goal"), 1.0).otherwise(2.0)
    found = _contributions(hits.withColumn("matched", F.col("term")).withColumn("similarity", F.col("sim")).withColumn("alias_used", F.lit(False)), score, F.when(F.col("exact"), "verb_exact").otherwise("verb_fuzzy"))
    most = F.when(F.col("query_term").rlike("^(goalstate:)?verb_target:"), V.VERB_CAPS["verb_target"]).otherwise(V.VERB_CAPS["verb_context"])
    return ranking.cap(found, ["memory_id", "query_term"], most)


def _alias_map(ix: Index, kind: str, asked: DataFrame, names: Column) -> DataFrame:
    """One row with the map of a kind's aliases: of the names that the queries hold, as bases and as aliases, no others.

    A name of an entry is an alias of an asked one only through such a pair, so the map grows with the query alone.
    """
    held = asked.select(F.explode(names).alias("name")).where("name is not null").distinct()
    pairs = ix.aliases.where(F.col("kind") == kind).select("base", "alias")
    near = pairs.join(F.broadcast(held), F.col("base") == F.col("name"), "left_semi").unionByName(pairs.join(F.broadcast(held), F.col("alias") == F.col("name"), "left_semi")).distinct()
    lists = near.groupBy("base").agg(F.array_sort(F.collect_set("alias")).alias("a"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct("base", "a"))).alias(kind))


QUERY_PATH = "struct<path:array<string>,op:string,value:string,items:array<string>,object:string,action:string,source_type:string>"


def fullpath_matches(ix: Index, queries: DataFrame) -> DataFrame:
    """Full paths with values: a JSON query against the entries that share, or alias to, a component with it.

    A score above zero needs one common component at least, so the join on components loses nothing, and each pair
    is met once.
    """
    asked = queries.where("prefix = 'fullpath'").select("query_term", "goal_query", F.from_json("phrase", QUERY_PATH).alias("q")).where("q is not null")
    component_aliases = ix.aliases.where("kind = 'attribute_component_aliases'")
    both_ways = component_aliases.select(F.col("base").alias("c"), F.col("alias").alias("other")).unionByName(component_aliases.select(F.col("alias").alias("c"), F.col("base").alias("other")))
    own = asked.select("query_term", F.explode("q.path").alias("c"))
    reach = own.unionByName(own.join(both_ways, "c").select("query_term", F.col("other").alias("c"))).groupBy("query_term").agg(F.collect_set("c").alias("reach"))
    met = F.broadcast(reach.join(asked, "query_term").withColumn("c", F.explode("reach")))  # the stated queries, by each component that they reach
    # an entry meets a query through several components; the first of its path that the query reaches stands for all
    near = ix.fullpath.withColumn("c", F.explode(F.array_distinct("path"))).join(met, "c")
    pairs = near.where(F.element_at(F.filter("path", lambda x: F.array_contains("reach", x)), 1) == F.col("c")).drop("c", "reach")
    names = {"attribute_component_aliases": F.col("q.path"), "value_aliases": F.concat(F.array("q.value"), F.coalesce("q.items", F.array().cast("array<string>"))), "object_aliases": F.array("q.object"), "action_aliases": F.array("q.action")}
    for kind, held in names.items():
        pairs = pairs.crossJoin(F.broadcast(_alias_map(ix, kind, asked, held)))  # one row each, of the asked names
    pairs = pairs.crossJoin(F.broadcast(ix.banned.agg(F.collect_set("component").alias("banned"))))  # fixed ones, and those of a share that 333 terms can have at most
    core = core_match(F.col("q.path"), F.coalesce("q.op", F.lit("eq")), F.col("q.value"), F.col("path"), F.coalesce("op", F.lit("eq")), F.col("value"), F.col("banned"), F.col("attribute_component_aliases"), None, F.col("value_aliases"), None, F.col("q.items"), F.col("items"))
    factors = F.struct(core.alias("core"), name_factor(F.col("q.object"), F.col("object"), F.col("object_aliases")).alias("o"), name_factor(F.col("q.action"), F.col("action"), F.col("action_aliases")).alias("a"))
    goal = goal_factor(F.coalesce(F.col("q.source_type") == "goalstate", F.lit(False)) | F.col("goal_query"), F.col("is_goal"))
    told = let(factors, lambda f: F.struct((F.lit(V.CORE_SCORE) * f["core"]["score"] * f["o"] * f["a"] * goal).alias("score"), (f["core"]["alias"] | f["o"].isin(1.8, 1.44) | f["a"].isin(1.8, 1.44)).alias("alias_used")))
    scored = pairs.withColumn("m", F.explode(F.filter(F.array(told), lambda m: m["score"] > 0)))  # worked out once, not again for the filter
    matched = F.concat(F.lit("fullpath:"), F.to_json(F.struct("action", "object", "path", "op", "value", "items", "state_type")))
    scored = scored.withColumn("matched", matched).withColumn("alias_used", F.col("m.alias_used")).withColumn("term_type", F.lit("attribute")).withColumn("similarity", F.lit(None).cast("double"))
    return _contributions(scored, F.col("m.score"), F.lit("fullpath"), F.col("object"))


def measurement_matches(ix: Index, terms: DataFrame) -> DataFrame:
    """Length, width, height and volume asked together: each object's product of 1 or 0.5; nothing if none is in range."""
    paths = ("dimensions.length", "dimensions.width", "dimensions.height_thickness", "volume")
    asked = terms.where("prefix = 'attribute_value'").select(F.substring_index("phrase", "=", 1).alias("path"), F.regexp_replace("phrase", "^[^=]*=", "").alias("raw")).where(F.col("path").isin(*paths))
    asked = asked.groupBy("path").agg(F.max("raw").alias("raw"))
    pairs = ix.measurements.join(F.broadcast(asked), "path")
    q_unit = unit_of(F.col("raw"))
    quantity = F.when(quantity_of(F.col("unit")) != "unknown", quantity_of(F.col("unit"))).otherwise(quantity_of(q_unit))
    q, i = in_base_unit(number_of(F.col("raw")), q_unit, quantity), in_base_unit(F.col("numeric"), F.col("unit"), quantity)
    lo, hi = V.MEASUREMENT_RANGE
    each = pairs.withColumn("m", F.when(q.between(lo * i, hi * i), 1.0).otherwise(V.MEASUREMENT_MISS))
    found = each.groupBy("memory_id", "object_id").agg(F.count("*").alias("n"), F.collect_list("m").alias("ms"), F.min("src").alias("src"), F.min("seq").alias("seq")).where(f"n = {len(paths)}")
    found = found.withColumn("score", F.aggregate("ms", F.lit(1.0), lambda a, x: a * x)).where(F.col("score") > V.MEASUREMENT_MISS ** len(paths))
    return found.select(
        "memory_id", "object_id", F.lit("measurement_unit").alias("query_term"), F.lit("dimensions+volume").alias("matched_term"), "score", F.lit("measurement").alias("mode"),
        "src", F.lit("attribute").alias("term_type"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("alias_used"), "seq",
    )


def position_matches(ix: Index, queries: DataFrame) -> DataFrame:
    """position_unit:object:relation:relationr:relative_to against every positioned object."""
    part = lambda k: F.split("phrase", ":")[k]
    asked = queries.where("prefix = 'position_unit' and size(split(phrase, ':')) = 4").select("query_term", part(0).alias("q_obj"), part(1).alias("q_rel"), part(2).alias("q_relr"), part(3).alias("q_to"))
    entries = ix.objects.where("size(relative_to) > 0").withColumn("to", F.explode("relative_to"))
    hits = entries.join(F.broadcast(asked), F.col("to") == F.col("q_to"))
    score = position_score(F.col("q_to"), F.col("to"), F.col("q_relr"), F.coalesce("relationr", F.lit("")), F.col("q_rel"), F.coalesce("relation", F.lit("")))
    hits = hits.withColumn("matched", F.concat_ws(":", F.lit("position_unit"), "obj_id", F.coalesce("relation", F.lit("")), F.coalesce("relationr", F.lit("")), "to")).withColumn("src", F.concat_ws("|", F.lit("object"), "obj_id", "template")).withColumn("term_type", F.lit("position"))
    hits = hits.withColumn("similarity", F.lit(None).cast("double")).withColumn("alias_used", F.lit(False)).withColumn("seq", F.col("obj_ix"))
    return _contributions(hits, score, F.lit("position_unit"), F.col("q_obj")).where("score > 0")


def spatial_matches(ix: Index, queries: DataFrame) -> DataFrame:
    """spatial:op(a,b): the relation itself 1.0; else a chain over any one object between 0.5."""
    pattern = r"^(\w+)\(([^,]+),([^)]+)\)$"
    part = lambda k: F.regexp_extract("phrase", pattern, k)
    asked = F.broadcast(queries.where("prefix = 'spatial'").where(F.col("phrase").rlike(pattern)).select("query_term", part(1).alias("op"), part(2).alias("a"), part(3).alias("b")).where(F.col("op").isin(*V.SPATIAL_RELATIONS)))

    def resolve(name: str) -> DataFrame:
        """By object id, else the first object of that template."""
        wanted = asked.select("query_term", F.col(name).alias("name"))
        by_id = ix.objects.join(F.broadcast(wanted.withColumn("obj_id", F.col("name"))), "obj_id")
        by_template = ix.objects.where("template <> obj_id or obj_id is null").join(F.broadcast(wanted.withColumn("template", F.col("name"))), "template")
        hit = by_id.unionByName(by_template)
        first = Window.partitionBy("query_term", "memory_id").orderBy((F.col("obj_id") != F.col("name")).cast("int"), "obj_ix")
        return hit.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "name")

    keys = ["query_term", "memory_id"]
    subject = resolve("a").select(*keys, "obj_id", "template", "relationr", "relative_to", "obj_ix")
    target = resolve("b").select(*keys, F.col("obj_id").alias("t_id"), F.col("template").alias("t_template"))
    both = subject.join(target, keys).join(asked.select("query_term", "op"), "query_term")
    points = F.array_contains("relative_to", F.col("t_id")) | F.array_contains("relative_to", F.col("t_template"))
    direct = both.where(points & (F.col("relationr") == F.col("op"))).withColumn("matched", F.concat_ws(":", F.lit("positionr"), "relationr", "t_id")).withColumn("score", F.lit(1.0)).withColumn("mode", F.lit("spatial_direct"))
    middle = ix.objects.where(F.col("relationr").isin(*V.SPATIAL_RELATIONS)).select("memory_id", F.col("obj_id").alias("m_id"), F.col("relative_to").alias("m_to"), F.col("obj_ix").alias("m_ix"))
    left = both.join(direct.select(*keys), keys, "left_anti").where(F.col("relationr").isin(*V.SPATIAL_RELATIONS))
    hop = left.join(middle, "memory_id").where("m_id <> obj_id and m_id <> t_id").where(F.array_contains("relative_to", F.col("m_id")) & F.array_contains("m_to", F.col("t_id")))
    hop = hop.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("m_ix"))).where("_n = 1")
    hop = hop.withColumn("matched", F.concat(F.lit("inferred via "), "m_id")).withColumn("score", F.lit(0.5)).withColumn("mode", F.lit("spatial_one_hop"))
    found = direct.unionByName(hop.select(*direct.columns))
    found = found.withColumn("src", F.concat_ws("|", F.lit("object"), "obj_id", "template")).withColumn("term_type", F.lit("attribute")).withColumn("similarity", F.lit(None).cast("double")).withColumn("alias_used", F.lit(False)).withColumn("seq", F.col("obj_ix"))
    return _contributions(found, F.col("score"), F.col("mode"), F.col("obj_id"))


def contributions(ix: Index, terms: DataFrame) -> DataFrame:
    """All matches of (query_term, position) terms, with query_base, before any cap."""
    queries = prepared(terms)
    special = F.col("prefix").isin("fullpath", "position_unit", "spatial", *V.VERB_CAPS) | ((F.col("prefix") == "attribute_value") & F.col("phrase").rlike("^(dimensions\\.(length|width|height_thickness)|weight|mass|volume)="))
    hits = stored(_hits(ix, queries.where(~special)))  # what the terms meet, read by three ways of matching
    parts = [component_and_token_matches(ix, hits), name_matches(ix, hits), exact_matches(hits), verb_matches(ix, queries), fullpath_matches(ix, queries), measurement_matches(ix, queries), position_matches(ix, queries), spatial_matches(ix, queries)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(*CONTRIBUTION))
    named = stored(out).join(ix.alias_terms.withColumnsRenamed({"alias_term": "query_term", "base_term": "_base"}), "query_term", "left")
    return named.withColumn("query_base", F.coalesce("_base", "query_term")).drop("_base")


def search(ix: Index, terms: DataFrame, top: int | None = 10, details: bool = False) -> DataFrame:
    """Ranked memories for query terms."""
    return ranking.rank(ranking.settle(contributions(ix, terms)), top, details)
