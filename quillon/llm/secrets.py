"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base findings are marked in place (a mark before and behind each match), the text is split at the marks, and
running lengths give the offsets. The values of all findings are then counted over distinct repositories and owners:
a value that many of them hold is a copied example, a live-looking value that one owner holds is a live credential.
Every live value gets a span of its own, within a base finding or in a run of token characters outside the base
patterns; masking takes all findings but the copied examples.

Patterns run only over texts with something that they need (a key word, `AKIA`, a run of 20 token characters).

Defined cases: a null text is empty; very long texts are scanned whole, and masked block by block; a character U+0001
is read as U+0002; findings at one place are ordered by kind, then end; a live value that two findings share has one
span; an empty table gives an empty result; repeated rows give repeated rows; a null repository or owner counts as one
of its own; further input columns, whatever their names, are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import shielded
from quillon.session import cut

_WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = f"""({_WORDS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Runs that may be a credential of no base kind.
RUN = "[A-Za-z0-9+/_-]{20,}"
MIN_VALUE = 6
#: A value held by so many owners or repositories is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 5
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234567|abcdef"
KINDS = ("assign", "access", "hex", "live")
REDACTED = "[REDACTED]"
_MARK, _OTHER, _STEP = "\u0001", "\u0002", 256
_BLOCK = 4096
#: Java forms of the patterns that find the same: a run is maximal, so nothing of its kind stands before it.
_FAST = {ASSIGN: f"(?=[aApPsStT]){ASSIGN}", HEX: f"(?<![0-9a-f]){HEX}", RUN: f"(?<![A-Za-z0-9+/_-]){RUN}"}
_FOUND = "array<struct<start:bigint,end:bigint,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _sums(values: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(values, F.array().cast("array<long>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x))


def _running(values: Column) -> Column:
    """Running sums of an array of any length, by steps: the cost stays near the length times _STEP."""

    def stepped(v: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _STEP).cast("int")), lambda b: _sums(F.slice(v, b * _STEP + 1, _STEP)))
        return _let(cuts, lambda c: _let(_sums(F.transform(c, lambda x: F.element_at(x, -1))), lambda before: F.flatten(F.transform(c, lambda x, i: F.transform(x, lambda e: e + F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(before, i)))))))

    return _let(values, lambda v: F.when(F.size(v) <= _STEP, _sums(v)).otherwise(stepped(v)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points. text must not hold U+0001."""
    parts = F.split(F.regexp_replace(text, _FAST.get(pattern, pattern), f"{_MARK}$0{_MARK}"), _MARK, -1)

    def spans(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: F.length(x).cast("long")))
        return _let(
            ends,
            lambda e: F.transform(
                F.sequence(F.lit(2), F.size(p) - 1, F.lit(2)),
                lambda i: F.struct(F.element_at(e, i - 1).alias("start"), F.element_at(e, i).alias("end"), F.element_at(p, i).alias("value")),
            ),
        )

    return _let(parts, lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(F.array().cast(_FOUND)))


def _tagged(found: Column, kind: int, value=None) -> Column:
    """Candidates as array<struct<start, kind, end, hash, live, value_start>>, live: whether the value itself looks live."""

    def one(m: Column) -> Column:
        v = m["value"] if value is None else value(m["value"])
        varied = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 10)
        live = varied & ~v.rlike(PLACEHOLDER)
        return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.sha2(v, 256).alias("hash"), live.alias("live"), (m["end"] - F.length(v)).alias("value_start"))

    return F.transform(found, one)


def _outside(runs: Column, found: Column) -> Column:
    """The runs that no finding holds. Both are sorted by start; runs are taken by steps, each against the findings that reach it."""

    def step(some: Column) -> Column:
        first, last = F.element_at(some, 1)["start"], F.element_at(some, -1)["end"]
        near = F.filter(found, lambda f: (f["end"] > first) & (f["start"] < last))
        return _let(near, lambda n: F.filter(some, lambda r: ~F.exists(n, lambda f: (f["start"] <= r["start"]) & (r["end"] <= f["end"]))))

    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / _STEP).cast("int")), lambda b: step(F.slice(runs, b * _STEP + 1, _STEP)))
    return F.when((F.size(runs) > 0) & (F.size(found) > 0), F.flatten(steps)).otherwise(runs)


def _needs(text: Column) -> tuple[Column, Column, Column]:
    """Whether a text has what an assignment, an access key, or a run needs."""
    low = F.lower(text)
    return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api"), text.contains("AKIA"), text.rlike(_FAST[RUN])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, repo, owner, found, runs): base findings and further runs of each row."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, _OTHER)
    named, access, run = _needs(text)
    none = F.array().cast(_FOUND)
    both = F.struct(matches(text, HEX).alias("hex"), F.filter(matches(text, RUN), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]")).alias("runs"))
    at = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        (F.col("source") if repo is None else repo).alias("repo"),
        (F.col("source") if owner is None else owner).alias("owner"),
        F.when(named, F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_VALUE)).otherwise(none).alias("assign"),
        F.when(access, matches(text, ACCESS)).otherwise(none).alias("access"),
        F.when(run, both).otherwise(F.struct(none.alias("hex"), none.alias("runs"))).alias("long"),
    )
    base = F.concat(_tagged(F.col("assign"), 0, lambda v: F.regexp_extract(v, ASSIGN, 2)), _tagged(F.col("access"), 1), _tagged(F.col("long.hex"), 2))
    at = at.select("doc_id", "text_hash", "repo", "owner", F.array_sort(base).alias("found"), _tagged(F.col("long.runs"), 3).alias("runs"))
    return at.withColumn("runs", _outside(F.col("runs"), F.col("found")))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) over the whole corpus; found: (hash, repo, owner) rows, hot values reduced before the shuffle."""
    held = found.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("r"))
    repos = held.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, base, spans, masked, n_live, n_example) for every row; base, spans and masked: array<struct<start, kind, end>>.

    spans are the base findings and the live values, masked those of them that aren't copied examples.
    """
    rows = cut(candidates(docs, id_col, text_col, repo, owner))
    each = rows.where(F.size("found") + F.size("runs") > 0).select("doc_id", "text_hash", "repo", "owner", F.explode(F.concat("found", "runs")).alias("f")).select("doc_id", "text_hash", "repo", "owner", "f", F.col("f.hash").alias("hash"))
    counts = ownership(each.select("hash", "repo", "owner"))
    verdict = (
        F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS), F.lit("example"))
        .when((F.col("n_owners") == 1) & F.col("f.live"), F.lit("live"))
        .otherwise(F.lit("shared"))
    )
    of = lambda name, s: F.collect_set(F.when(F.col("verdict") == name, s))
    value = F.struct(F.col("f.value_start").alias("start"), F.lit(3).alias("kind"), F.col("f.end").alias("end"))
    judged = (
        each.join(counts, "hash")
        .withColumn("verdict", verdict)
        .groupBy("doc_id", "text_hash")
        .agg(of("live", value).alias("extra"), of("example", value).alias("copied"), of("example", F.struct("f.start", "f.kind", "f.end")).alias("left"))
    )
    judged = judged.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    base = F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["kind"].alias("kind"), f["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    extra, left = F.coalesce("extra", none), F.coalesce("left", none)
    return rows.join(judged, rows["doc_id"].eqNullSafe(judged["_id"]) & (rows["text_hash"] == judged["_hash"]), "left").select(
        "doc_id",
        "text_hash",
        base.alias("base"),
        F.array_sort(F.concat(base, extra)).alias("spans"),
        F.array_sort(F.concat(F.array_except(base, left), extra)).alias("masked"),
        F.size(extra).cast("long").alias("n_live"),
        F.size(F.coalesce("copied", none)).cast("long").alias("n_example"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Findings of every row: counts, base_sha256, spans, and how many values are live or copied examples."""
    count = lambda k: F.size(F.filter("base", lambda f: f["kind"] == k)).cast("long")
    return findings(docs, id_col, text_col, repo, owner).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def _masked(text: Column, spans: Column) -> Column:
    """text with each span, or chain of overlapping ones, replaced by REDACTED, block by block."""

    def masked(block: Column, number: Column) -> Column:
        base = number.cast("long") * _BLOCK

        def step(acc: Column, s: Column) -> Column:
            at = F.greatest(s["start"] - base, F.lit(0)).cast("int")
            fresh = (s["start"] >= base) & (at >= acc["at"])
            out = F.when(fresh, F.concat(acc["out"], F.substring(block, acc["at"] + 1, at - acc["at"]), F.lit(REDACTED))).otherwise(acc["out"])
            return F.struct(out.alias("out"), F.greatest(acc["at"], F.least(s["end"] - base, F.lit(_BLOCK).cast("long")).cast("int")).alias("at"))

        near = F.filter(spans, lambda s: (s["end"] > base) & (s["start"] < base + _BLOCK))
        return F.aggregate(near, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(block, acc["at"] + 1, _BLOCK)))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), masked), "")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, length_col: str = "n_chars") -> DataFrame:
    """docs with every finding but copied examples replaced by REDACTED; length_col, where there is one, gets the new length in characters.

    Texts without any candidate pass by the join, so only the few others are shuffled.
    """
    inner, name = shielded(docs)
    repo, owner = F.col("source") if repo is None else repo, F.col("source") if owner is None else owner
    tagged = docs.select("*", repo, owner).toDF(*inner.columns, "repo", "owner")
    ident, col = name[id_col], name[text_col]
    text = F.coalesce(F.col(col), F.lit(""))
    risky = F.expr("false")
    for need in _needs(text):
        risky = risky | need
    some = tagged.where(risky)
    spans = findings(some, ident, col, F.col("repo"), F.col("owner")).where(F.size("masked") > 0).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "masked").dropDuplicates(["id", "hash"])
    own = some.withColumn("own", F.xxhash64(F.translate(text, _MARK, _OTHER)))
    found = own.join(spans, own[ident].eqNullSafe(spans["id"]) & (own["own"] == spans["hash"]), "left")
    hit = F.col("masked").isNotNull()
    found = found.withColumn(col, F.when(hit, _masked(F.col(col), F.col("masked"))).otherwise(F.col(col)))
    if length_col in name:
        n = name[length_col]
        found = found.withColumn(n, F.when(hit, F.length(col)).otherwise(F.col(n)).cast(docs.schema[length_col].dataType))
    return inner.where(~risky).unionByName(found.select(*inner.columns)).toDF(*docs.columns)


def _marked(kind: int, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT doc_id, owner, repo, {kind} AS kind, string_split(regexp_replace(t, '{quoted}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d"


#: DuckDB SQL for scan over documents with a distinct doc_id in each row.
ORACLE = f"""
WITH d AS (SELECT doc_id, source AS owner, concat_ws('/', source, lang) AS repo, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
m AS ({" UNION ALL ".join(_marked(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, RUN)))}),
i AS (SELECT doc_id, owner, repo, kind, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM m WHERE len(p) > 1),
e AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS "end" FROM i),
f AS (SELECT doc_id, owner, repo, kind, "end" - length(part) AS start, "end", CASE kind WHEN 0 THEN regexp_extract(part, '{ASSIGN.replace("'", "''")}', 2) ELSE part END AS v FROM e WHERE i % 2 = 0),
g AS (SELECT * FROM f WHERE CASE kind WHEN 0 THEN length(v) >= {MIN_VALUE} WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END),
h AS (SELECT * FROM g WHERE kind < 3 UNION ALL SELECT * FROM g r WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.kind < 3 AND b.doc_id = r.doc_id AND b.start <= r.start AND r."end" <= b."end")),
o AS (SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS n_owners, count(DISTINCT coalesce(repo, chr(0))) AS n_repos FROM h GROUP BY v),
j AS (SELECT h.*, "end" - length(v) AS value_start, CASE WHEN n_owners >= {EXAMPLE_OWNERS} OR n_repos >= {EXAMPLE_REPOS} THEN 'example'
  WHEN n_owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10 AND NOT regexp_matches(v, '{PLACEHOLDER}') THEN 'live' ELSE 'shared' END AS verdict FROM h JOIN o USING (v)),
s AS (SELECT doc_id, kind, start, "end" FROM j WHERE kind < 3 UNION ALL SELECT DISTINCT doc_id, 3, value_start, "end" FROM j WHERE verdict = 'live'),
w AS (SELECT *, (['assign', 'access', 'hex', 'live'])[kind + 1] || ':' || CAST(start AS VARCHAR) || ':' || CAST("end" AS VARCHAR) AS s FROM s),
c AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(s, ',' ORDER BY start, kind, "end") FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind, "end") AS spans, count(*) FILTER (kind = 3) AS n_live FROM w GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT (value_start, "end")) AS n_example FROM j WHERE verdict = 'example' GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""
