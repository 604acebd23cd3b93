"""Index, matching and ranking operators over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scoring, text, units
from quillon.functions import vocabulary as V
from quillon.operators import aliases, flatten, postings, ranking, search, templates
from quillon.operators.similarity import close_pairs
from quillon.plans.registry import query
from quillon.session import cut, spread, table

_STOP = ", ".join(f"'{w}'" for w in sorted(V.STOP_WORDS | V.UNIT_WORDS))
_SEPS = V.SEPARATORS.replace("'", "''")
TOKENS_SQL = f"""
tok AS (
  SELECT memory_id, place, token FROM (
    SELECT doc_id AS memory_id, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM (
      SELECT doc_id, list_filter(string_split_regex(lower(translate(text, '{_SEPS}', '{" " * len(V.SEPARATORS)}')), '\\s+'),
        lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOP})) AS w FROM documents))
)"""
SHARES_SQL = f"""
{TOKENS_SQL},
freq AS (
  SELECT token AS term, count(*) AS occurrences, count(DISTINCT memory_id) AS memory_count,
    round(count(*)::DOUBLE / (SELECT count(*) FROM tok) * 100, 6) AS occurrence_percentage,
    round(count(DISTINCT memory_id)::DOUBLE / (SELECT count(DISTINCT memory_id) FROM tok) * 100, 6) AS memory_percentage
  FROM tok GROUP BY token
)"""
GATE_SQL = "CASE WHEN occurrence_percentage / 100 >= 0.003::DOUBLE THEN 'unmatchable' WHEN occurrence_percentage / 100 > 0.0003::DOUBLE AND occurrence_percentage / 100 <= 0.0007::DOUBLE THEN 'one_match' ELSE 'diminishing' END"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.token_occurrences(_texts(spark, sf_dir), "doc_id", "text")


@query(f"WITH {TOKENS_SQL} SELECT memory_id, token, count(*) AS occurrences FROM tok GROUP BY ALL")
def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir).groupBy("memory_id", "token").agg(F.count("*").alias("occurrences"))


@query(f"WITH {SHARES_SQL} SELECT * FROM freq")
def term_frequency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.shares(_occurrences(spark, sf_dir).withColumnRenamed("token", "term"))


@query(f"WITH {SHARES_SQL} SELECT term, {GATE_SQL} AS gate FROM freq")
def frequency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = postings.shares(_occurrences(spark, sf_dir).withColumnRenamed("token", "term"))
    return found.select("term", postings.gate(F.col("occurrence_percentage")).alias("gate"))


SEARCHED = ["license", "apache", "version", "thing", "shing", "ertion", "mention", "nicht", "dans", "para"]


@query(f"""WITH {SHARES_SQL},
hit AS (SELECT t.memory_id, t.token, {GATE_SQL} AS gate, row_number() OVER (PARTITION BY t.memory_id, t.token ORDER BY place) AS n
  FROM tok t JOIN freq ON freq.term = t.token WHERE t.token IN ({", ".join(f"'{t}'" for t in SEARCHED)})),
scored AS (SELECT *, 0.3::DOUBLE * CASE n WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS score FROM hit
  WHERE gate <> 'unmatchable' AND n <= CASE gate WHEN 'one_match' THEN 1 ELSE 3 END)
SELECT memory_id, round(sum(score), 6) AS score, count(*) AS n_matches FROM scored GROUP BY memory_id ORDER BY score DESC, memory_id LIMIT 10""")
def exact_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by query tokens: gated by frequency, diminishing within a document, summed; the ten best."""
    counted = cut(postings.asked_tokens(_texts(spark, sf_dir), "doc_id", "text", SEARCHED))
    term = lambda c: F.concat(F.lit("object_token:"), c)
    hits = counted.where("token is not null").select("memory_id", "token", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("place")).select(
        term(F.col("token")).alias("term"), F.lit("object_token").alias("prefix"), F.col("token").alias("phrase"), "memory_id", F.col("place").cast("string").alias("src"),
        F.lit("object").alias("term_type"), F.lit(False).alias("is_goal"), F.col("place").alias("seq"),
    )
    none = spark.createDataFrame([], "alias_term string, base_term string")
    ix = search.Index(postings=hits, alias_terms=none, freq=postings.shares_of(counted).withColumn("term", term(F.col("term"))))
    queries = search.prepared(spark.createDataFrame([(f"object_token:{w}", k) for k, w in enumerate(SEARCHED)], "query_term string, position int"))
    return ranking.rank(search.component_and_token_matches(ix, search.folded(ix, search.exact_hits(ix, queries))), top=10)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("event_type").alias("query_term"), F.col("event_type").alias("matched_term"), F.col("value").alias("score"), F.col("event_id").alias("seq"))


_EVENTS_SQL = "SELECT user_id AS memory_id, event_type AS query_term, event_type AS matched_term, value AS score, event_id AS seq FROM events"


@query(f"SELECT memory_id, matched_term, score, seq FROM ({_EVENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY memory_id, matched_term ORDER BY score DESC, seq) <= 6")
def index_term_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap(_events(spark, sf_dir), ["memory_id", "matched_term"]).select("memory_id", "matched_term", "score", "seq")


@query(f"SELECT memory_id, query_term, score, seq FROM ({_EVENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY memory_id, query_term ORDER BY score DESC, seq) <= 6")
def query_term_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap(_events(spark, sf_dir), ["memory_id", "query_term"]).select("memory_id", "query_term", "score", "seq")


@query(f"SELECT memory_id, query_term, score, seq FROM ({_EVENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY memory_id, query_term ORDER BY score DESC, seq) <= CASE WHEN query_term = 'purchase' THEN 4 ELSE 2 END")
def verb_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.when(F.col("query_term") == "purchase", V.VERB_CAPS["verb_target"]).otherwise(V.VERB_CAPS["verb_context"])
    return ranking.cap(_events(spark, sf_dir), ["memory_id", "query_term"], most).select("memory_id", "query_term", "score", "seq")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, round(o_totalprice * CASE n WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def global_diminishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_totalprice").alias("score"))
    out = ranking.diminish(orders, ["o_custkey", "o_orderpriority"], [F.desc("score"), F.col("o_orderkey")], V.DIMINISHING)
    return out.withColumn("score", F.round("score", 4))


@query("""SELECT l_orderkey, l_suppkey, l_linenumber, round(l_quantity * least(power(1.2::DOUBLE, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) - 1), 2.0::DOUBLE), 6) AS score FROM lineitem""")
def co_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("double").alias("score"))
    return ranking.co_match(lines, ("l_orderkey", "l_suppkey")).withColumn("score", F.round("score", 6))


FOLDS = [("purchase", "buy"), ("purchase", "order"), ("click", "tap"), ("view", "click"), ("signup", "view")]


@query(f"""WITH a AS (SELECT alias, min(base) AS base FROM (VALUES {", ".join(f"('{b}', '{a}')" for b, a in FOLDS)}) v(base, alias) GROUP BY alias)
SELECT event_id, coalesce(a.base, event_type) AS base, a.base IS NOT NULL AS alias_used FROM events LEFT JOIN a ON alias = event_type""")
def alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.broadcast(spark.createDataFrame(FOLDS, "base string, alias string"))
    return aliases.fold(table(spark, sf_dir, "events").select("event_id", "event_type"), names, "event_type").select("event_id", "base", "alias_used")


@query("""WITH one AS (SELECT p_brand AS base, regexp_replace(trim(p_type), '\\s+', '_', 'g') AS alias, min(p_partkey) AS r FROM part GROUP BY ALL)
SELECT base, alias, CAST(rank AS INTEGER) AS rank FROM (SELECT base, alias, row_number() OVER (PARTITION BY base ORDER BY r, alias) AS rank FROM one WHERE alias <> '' AND alias <> base) WHERE rank <= 10""")
def alias_merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select(F.lit("object_aliases").alias("kind"), F.col("p_brand").alias("base"), F.col("p_type").alias("alias"), F.col("p_partkey").alias("rank"))
    return aliases.merge(found).select("base", "alias", "rank")


@query("""SELECT term, memory_id, seq FROM (SELECT unnest(l) AS term, source AS memory_id, lang AS term_type, doc_id * 1000000 + generate_subscripts(l, 1) - 1 AS seq FROM (SELECT source, lang, doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY term, memory_id, term_type ORDER BY seq) = 1""")
def posting_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("memory_id"), F.lit("line").alias("src"), F.col("lang").alias("term_type"), F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "term")).where("term <> ''")
    return postings.dedup(lines.withColumn("seq", F.col("doc_id") * 1_000_000 + F.col("n"))).select("term", "memory_id", "seq")


ASKED_VALUES = ["10", "10 cm", "0.1 m", "25kg", "'7'", "true", "none", "steel", "Brand"]


@query(f"""WITH e AS (SELECT DISTINCT p_size, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || ' cm' WHEN 2 THEN CAST(p_size AS VARCHAR) || 'kg' ELSE 'true' END AS value FROM part),
q AS (SELECT unnest([{", ".join("'" + v.replace("'", "''") + "'" for v in ASKED_VALUES)}]) AS asked),
n AS (SELECT asked, CASE asked WHEN '10' THEN 10.0 WHEN '10 cm' THEN 10.0 WHEN '0.1 m' THEN 10.0 WHEN '25kg' THEN 25000.0 WHEN '''7''' THEN 7.0 END::DOUBLE AS num FROM q),
m AS (SELECT *, CASE p_size % 4 WHEN 2 THEN p_size * 1000.0::DOUBLE WHEN 3 THEN NULL ELSE p_size::DOUBLE END AS e_num FROM e)
SELECT asked, p_size, value, CASE WHEN num = e_num OR asked = 'true' AND value = 'true' THEN 1.0::DOUBLE WHEN abs(num - e_num) <= 0.3::DOUBLE * abs(e_num) AND e_num <> 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM n, m""")
def value_match_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated list of values against all distinct values of the entries."""
    size = F.col("p_size").cast("string")
    entry = F.when(F.col("p_size") % 4 == 0, size).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit(" cm"))).when(F.col("p_size") % 4 == 2, F.concat(size, F.lit("kg"))).otherwise("true")
    entries = table(spark, sf_dir, "part").select("p_size", entry.alias("value")).distinct()
    asked = entries.withColumn("asked", F.explode(F.array(*(F.lit(v) for v in ASKED_VALUES))))
    return asked.select("asked", "p_size", "value", scoring.value_match(F.col("asked"), F.col("value")).alias("score"))


ASKED_PATHS = [(1, "Brand#1", ["dims", "size"], "eq", "20"), (2, None, ["make", "brand"], "eq", "Brand#22"), (3, "Brand#7", ["brand"], "!=", "Brand#7"), (4, None, ["size", "extra"], "eq", "7"), (5, None, ["kind"], "eq", "no such kind")]


@query(f"""WITH e AS (
  SELECT p_partkey, p_brand AS object, 'dims.size' AS path, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL
  SELECT p_partkey, p_brand, 'make.brand', p_brand FROM part UNION ALL SELECT p_partkey, p_brand, 'kind', p_type FROM part),
q(qid, q_object, q_path, q_op, q_value) AS (VALUES {", ".join(f"({i}, {repr(o) if o else 'NULL'}, '{'.'.join(p)}', '{op}', '{v}')" for i, o, p, op, v in ASKED_PATHS)}),
s AS (SELECT *, CASE WHEN q_value = value THEN 1.0::DOUBLE WHEN TRY_CAST(q_value AS DOUBLE) IS NOT NULL AND abs(TRY_CAST(q_value AS DOUBLE) - TRY_CAST(value AS DOUBLE)) <= 0.3::DOUBLE * abs(TRY_CAST(value AS DOUBLE)) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS v,
  CASE WHEN path = q_path OR (q_path = 'brand' AND path = 'make.brand') THEN 1.0::DOUBLE WHEN q_path = 'size.extra' AND path = 'dims.size' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS p FROM q, e)
SELECT qid, p_partkey, path, round(2.0::DOUBLE * p * CASE WHEN v > 0 THEN v ELSE 0.2::DOUBLE END * CASE WHEN q_op = 'eq' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN q_object = object THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM s WHERE p > 0""")
def fullpath_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated path queries against every (object, path, value) of all parts; candidates share a path component."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size"))
    entry = lambda path, value: F.struct(F.array(*(F.lit(p) for p in path)).alias("path"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    entries = part.select("p_partkey", "p_brand", F.posexplode(F.array(entry(["dims", "size"], F.col("p_size")), entry(["make", "brand"], F.col("p_brand")), entry(["kind"], F.col("p_type")))).alias("k", "e"))
    fullpath = entries.select(
        F.col("p_partkey").cast("string").alias("memory_id"), none.alias("action"), F.col("p_brand").alias("object"), "e.path", F.lit("eq").alias("op"), "e.value", F.lit(None).cast("array<string>").alias("items"), none.alias("state_type"),
        F.lit("object").alias("src"), F.lit(False).alias("is_goal"), (F.col("p_partkey") * 3 + F.col("k")).cast("long").alias("seq"),
    )
    asked = [(f"fullpath:{json.dumps({'path': p, 'op': o, 'value': v, 'object': name})}", i) for i, name, p, o, v in ASKED_PATHS]
    terms = spark.createDataFrame(asked, "query_term string, position int")
    ix = search.Index(fullpath=fullpath, aliases=spark.createDataFrame([], "kind string, base string, alias string, rank int"), banned=spark.createDataFrame([], "component string"))
    found = search.fullpath_matches(ix, search.prepared(terms)).join(F.broadcast(terms), "query_term")  # the stated queries
    path = F.from_json(F.regexp_replace("matched_term", "^fullpath:", ""), "path array<string>")["path"]
    return found.select(F.col("position").alias("qid"), F.col("memory_id").cast("long").alias("p_partkey"), F.array_join(path, ".").alias("path"), F.round("score", 6).alias("score"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    given = F.element_at(F.array(F.concat(size, F.lit(" mm")), F.concat(size, F.lit("m")), F.concat(size, F.lit(" kg")), F.concat(size, F.lit("min")), F.concat(size, F.lit("F")), F.concat(size, F.lit(" L")), size), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", given.alias("given"))


_MEASURED_SQL = """SELECT p_partkey, p_size, CAST(p_partkey % 7 AS INTEGER) AS k, CAST(p_size AS VARCHAR) || ([' mm', 'm', ' kg', 'min', 'F', ' L', ''])[CAST(p_partkey % 7 AS INTEGER) + 1] AS given FROM part"""


@query(f"""SELECT p_partkey, given, ([ 'length', 'length', 'mass', 'time', 'temperature', 'volume', 'unknown'])[k + 1] AS quantity,
round(CASE k WHEN 0 THEN p_size * 0.1::DOUBLE WHEN 1 THEN p_size * 100.0::DOUBLE WHEN 2 THEN p_size * 1000.0::DOUBLE WHEN 3 THEN p_size * 60.0::DOUBLE WHEN 4 THEN (p_size - 32) * 5.0::DOUBLE / 9.0::DOUBLE WHEN 5 THEN p_size * 1000.0::DOUBLE ELSE p_size::DOUBLE END, 6) AS value FROM ({_MEASURED_SQL})""")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = units.unit_of(F.col("given"))
    quantity = units.quantity_of(unit)
    return _measured(spark, sf_dir).select("p_partkey", "given", quantity.alias("quantity"), F.round(units.in_base_unit(units.number_of(F.col("given")), unit, quantity), 6).alias("value"))


@query("""SELECT p_partkey, round(product, 6) AS score FROM (SELECT p_partkey,
  (CASE WHEN 20.0 BETWEEN 0.5 * p_size AND 1.5 * p_size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN 10.0 BETWEEN 0.5 * (p_size / 2.0) AND 1.5 * (p_size / 2.0) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) *
  (CASE WHEN 30.0 BETWEEN 0.5 * (p_size % 7 + 25) AND 1.5 * (p_size % 7 + 25) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN 6000.0 BETWEEN 0.5 * (p_size * (p_size / 2.0) * (p_size % 7 + 25)) AND 1.5 * (p_size * (p_size / 2.0) * (p_size % 7 + 25)) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS product FROM part) WHERE product > 0.0625::DOUBLE""")
def measurement_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, width, height and volume of every part against asked ones, each within half and one and a half."""
    size = F.col("p_size").cast("double")
    dims = {"length": size, "width": size / 2, "height_thickness": (F.col("p_size") % 7 + 25).cast("double")}
    volume = dims["length"] * dims["width"] * dims["height_thickness"]
    sizes = F.explode(F.array(*(F.struct(F.lit(f"dimensions.{n}").alias("path"), d.alias("numeric"), F.lit("cm").alias("unit")) for n, d in dims.items()), F.struct(F.lit("volume").alias("path"), volume.alias("numeric"), F.lit("cm^3").alias("unit"))))
    measured = table(spark, sf_dir, "part").select(F.lit("m").alias("memory_id"), F.col("p_partkey").cast("string").alias("object_id"), sizes.alias("s"), F.lit("object").alias("src")).select("memory_id", "object_id", "s.*", "src", F.lit(0).cast("long").alias("seq"))
    asked = ["dimensions.length=200 mm", "dimensions.width=0.1m", "dimensions.height_thickness=30cm", "volume=6L"]
    terms = spark.createDataFrame([(f"attribute_value:{t}", k) for k, t in enumerate(asked)], "query_term string, position int")
    found = search.measurement_matches(search.Index(measurements=measured), search.prepared(terms))
    return found.select(F.col("object_id").cast("long").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS "left", b.vec_id AS "right", round(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 4) AS sim FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.4""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(table(spark, sf_dir, "embeddings"), 0.4).withColumn("sim", F.round("sim", 4))


NAMES = ["small ring", "red widget", "blue steel ring"]


@query(f"""WITH t AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS w FROM part),
d AS (SELECT p_partkey, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
tf AS (SELECT p_partkey, w, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT DISTINCT name, w FROM (SELECT name, unnest(string_split(name, ' ')) AS w FROM (VALUES {", ".join(f"('{n}')" for n in NAMES)}) v(name)))
SELECT name, p_partkey, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS bm25
FROM q JOIN tf USING (w) JOIN df USING (w) JOIN d USING (p_partkey), st GROUP BY name, p_partkey""")
def bm25_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return templates.bm25(names, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower("p_name"), r"\s+").alias("words"))).select("name", F.col("id").alias("p_partkey"), F.round("bm25", 6).alias("bm25"))


_COUNTS_SQL = "[" + ", ".join(f"(length(x) - length(replace(x, '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def letters(phrase: Column) -> Column:
    """An embedder that SQL has too: counts of letters, normalised."""
    low = F.lower(phrase)
    counts = F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"))
    return text.let(counts, lambda c: text.let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))


@query(f"""WITH t AS (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '\\s+')) AS w FROM part),
d AS (SELECT p_partkey, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
tf AS (SELECT p_partkey, w, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT DISTINCT name, w FROM (SELECT name, unnest(string_split(name, ' ')) AS w FROM (VALUES {", ".join(f"('{n}')" for n in NAMES)}) v(name))),
b AS (SELECT name, p_partkey, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN tf USING (w) JOIN df USING (w) JOIN d USING (p_partkey), st GROUP BY name, p_partkey),
l AS (SELECT name, p_partkey, bm25 / max(bm25) OVER (PARTITION BY name) AS lex FROM b),
x AS (SELECT DISTINCT lower(p_name) AS x FROM part UNION SELECT DISTINCT name FROM q), v AS (SELECT x, {_COUNTS_SQL} AS c FROM x), n AS (SELECT x, list_transform(c, lambda y: y / sqrt(list_inner_product(c, c))) AS c FROM v),
s AS (SELECT DISTINCT name, p.p_partkey, (coalesce(lex, 0) + list_inner_product(a.c, b.c)) / 2 AS score FROM part p CROSS JOIN (SELECT DISTINCT name FROM q) m JOIN n a ON a.x = lower(p_name) JOIN n b ON b.x = m.name LEFT JOIN l ON l.name = m.name AND l.p_partkey = p.p_partkey)
SELECT name, p_partkey, round(score, 6) AS score FROM s WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, p_partkey) = 1""".replace("SELECT DISTINCT name, p.p_partkey", "SELECT m.name, p.p_partkey"))
def best_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best part for each stated name by words and letters together."""
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    found = templates.best_template(names, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), embed=letters)
    return found.select("name", F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("""SELECT event_id, k AS path, v AS value FROM (SELECT event_id, unnest(json_keys(props::JSON)) AS k, props FROM events WHERE props IS NOT NULL AND json_valid(props)) t, LATERAL (SELECT json_extract_string(t.props, '$."' || t.k || '"') AS v)""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of every event's JSON."""
    events = table(spark, sf_dir, "events").select("event_id", F.explode(flatten.flatten_json()(F.col("props"))).alias("leaf"))
    return events.select("event_id", F.array_join("leaf.path", ".").alias("path"), "leaf.value")


@query("""SELECT event_id, regexp_extract(g, '^([^.]+)\\.', 1) AS object, regexp_extract(g, '^[^.]+\\.([^=!]+?)(!=|=)', 1) AS path, CASE WHEN contains(g, '!=') THEN 'ne' ELSE 'eq' END AS op, regexp_extract(g, '(?:!=|=)(.*)$', 1) AS value
FROM (SELECT event_id, 'user' || CAST(user_id AS VARCHAR) || '.state.last' || CASE WHEN event_id % 2 = 0 THEN '=' ELSE '!=' END || event_type AS g FROM events)""")
def goal_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".state.last"), F.when(F.col("event_id") % 2 == 0, "=").otherwise("!="), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.goal_parts(goal).alias("g")).select("event_id", "g.*")
