"""Not-modified revisit resolution for web archive records.

A revisit record says that a URL was asked for again and had not changed. It is resolved by an as-of join: by
canonical URL, to the latest earlier full response. The validators must agree (the entity tag if the revisit has
one, else the date of last modification), and the headers that a not-modified answer may renew replace those of
the response; all others stay as they were captured.

The as-of join has two levels, so that a URL with very many records is met in pieces: time is cut into ranges of about
equally many records (by quantiles over all of them, so a burst of captures is cut finely); within a range of a URL the
last response is carried along, and between ranges only one row for each range is.

Defined cases: records with a null URL have no canonical URL and find no response; those with a null time or id sort
first; of records at one time the smaller id is the earlier; very long URLs and header values are kept whole; repeated
records give repeated rows; null headers are empty; an empty table gives an empty result; further input columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import cut

#: Headers that a not-modified answer may renew (fixed values of the HTTP semantics and caching standards).
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another resource.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
#: Time ranges: COARSE times COARSE, found in two steps.
COARSE = 32

_URL = r"^(?:[hH][tT][tT][pP][sS]?://)?([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical(url: str = "url") -> Column:
    """Host in lower case without www. and default ports, path without a last slash, other parameters sorted; no scheme, fragment or tracking."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(part(2), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(F.substring(part(3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(F.col(url).isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _tag(column: str) -> Column:
    return F.regexp_replace(column, "^W/", "")


def _range_of(slim: DataFrame, coarse: int) -> Column:
    """The number of the time range that captured lies in: quantile bounds, coarse ones first."""
    shares = [(k + 1) / coarse**2 for k in range(coarse**2 - 1)]
    bounds = [int(x) for x in slim.agg(F.percentile_approx("captured", shares, 10 * coarse**2)).first()[0] or []]
    if not bounds:
        return F.lit(0)
    all_bounds, heads = F.array(*(F.lit(x).cast("long") for x in bounds)), F.array(*(F.lit(x).cast("long") for x in bounds[coarse - 1 :: coarse]))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("captured")))
    first = below(heads) * coarse
    return F.coalesce(first + below(F.slice(all_bounds, first + 1, coarse - 1)), F.lit(-1))


def resolve(records: DataFrame, coarse: int = COARSE) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, captured, response_id, response_captured, outcome, digest, headers.

    records: record_id, url, captured (long), kind ('response' or 'revisit'), etag, last_modified, digest, headers
    (map of lower-case names). Only resolved revisits get the digest and the merged headers.
    """
    # each revisit and response with the place (captured, record_id); a response's own facts travel in one struct
    facts = F.when(F.col("kind") == "response", F.struct(F.col("captured").alias("at"), F.col("record_id").alias("id"), "etag", "last_modified", "digest", "headers"))
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    slim = cut(records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical("url").alias("canonical_url"), "captured", "kind", "etag", "last_modified", "digest", headers.alias("headers")))
    slim = slim.withColumn("range", F.when(F.col("captured").isNull(), -1).otherwise(_range_of(slim, coarse)).cast("int")).withColumn("response", facts)
    named = slim.where("canonical_url is not null")
    order = [F.col("captured").asc_nulls_first(), F.col("record_id").asc_nulls_first()]
    inner = Window.partitionBy("canonical_url", "range").orderBy(*order)
    near = F.last("response", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    asked = named.withColumn("near", near).where("kind = 'revisit'")
    # of each range its last response, and of each URL those of the ranges before: a row for each range of a URL
    least = F.lit(-(1 << 63))
    place = F.when(F.col("kind") == "response", F.struct(F.coalesce("captured", least), F.coalesce("record_id", least)))
    edge = named.groupBy("canonical_url", "range").agg(F.max_by("response", place).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = edge.withColumn("before", before).where("before is not null").select("canonical_url", "range", "before")
    found = asked.join(carried, ["canonical_url", "range"], "left").withColumn("hit", F.coalesce("near", "before")).drop("near", "before", "response", "range")
    lost = slim.where("canonical_url is null and kind = 'revisit'").withColumn("hit", F.col("response")).drop("response", "range")
    found = found.unionByName(lost)
    same = F.when(F.col("etag").isNotNull(), _tag("etag").eqNullSafe(_tag("hit.etag"))).when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("hit.last_modified")))
    outcome = F.when(F.col("hit").isNull(), "no earlier response").when(same.isNull(), "no validator").when(same, "resolved").otherwise("validator differs")
    renewed = F.map_filter("headers", lambda k, _: k.isin(*RENEWED))
    stale = F.map_filter("hit.headers", lambda k, _: ~F.array_contains(F.map_keys(renewed), k))
    done = F.col("outcome") == "resolved"
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(stale, renewed)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    return found.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "captured", F.col("hit.id").alias("response_id"), F.col("hit.at").alias("response_captured"), "outcome",
        F.when(done, F.col("hit.digest")).alias("digest"), F.when(done, merged).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """The records of a crawl of pages: every page is captured, each third again far later, and each asked for once more.

    The pages table has captures only; the checks stand in for a crawler's conditional requests. By the page's id they
    follow the capture at once, half way to the second capture, or after it, or come before the capture. Some carry a
    foreign entity tag, some a date alone, some nothing; of those after a second capture some know it, some don't.
    """
    number, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    day = F.concat(F.lit("day "), F.floor(number / 100).cast("string"))
    base = pages.select("page_id", "url", F.md5(html).alias("digest"), F.md5(F.concat(html, F.lit(" again"))).alias("later"), day.alias("day"))
    pairs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    tag = lambda digest: F.concat(F.lit('"'), digest, F.lit('"'))

    def capture(of: DataFrame, k: int, delay: int, digest: str, day: Column) -> DataFrame:
        return of.select(
            (4 * number + k).alias("record_id"), "url", (100 * number + delay).alias("captured"), F.lit("response").alias("kind"), tag(F.col(digest)).alias("etag"), day.alias("last_modified"), F.col(digest).alias("digest"),
            pairs("content-type", "text/html", "content-length", number.cast("string"), "etag", tag(F.col(digest)), "date", day).alias("headers"),
        )

    delay = F.when(number % 4 == 0, 5).when(number % 4 == 1, 2_000_005).when(number % 4 == 2, -3).otherwise(500_005)
    knows = F.when(number % 8 == 1, F.col("later")).otherwise(F.col("digest"))
    etag = F.when(number % 7 == 0, F.lit('"other"')).when((number % 5 != 0) & (number % 11 != 0), F.concat(F.lit("W/"), tag(knows)))
    bare = F.regexp_replace("url", "^https?://", "")
    respelled = F.concat(F.lit("HTTPS://"), F.when(bare.startswith("www."), F.substring(bare, 5, 1 << 30)).otherwise(F.concat(F.lit("WWW."), bare)), F.lit("#again"))
    check = base.select(
        (4 * number + 2).alias("record_id"), respelled.alias("url"), (100 * number + delay).alias("captured"), F.lit("revisit").alias("kind"), etag.alias("etag"), F.when(number % 11 != 0, F.col("day")).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        pairs("date", F.concat("day", F.lit(" later")), "content-length", "9", "expires", "never", "x-cache", "hit").alias("headers"),
    )
    again = capture(base.where(number % 3 == 0), 1, 1_000_050, "later", F.concat("day", F.lit(" again")))
    return capture(base, 0, 0, "digest", F.col("day")).unionByName(again).unionByName(check)


#: DuckDB SQL for resolve(records_of(pages)): captures and checks written out, hosts spelled by string functions, headers as lists.
ORACLE = f"""
WITH base AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS d1, md5(coalesce(html, '') || ' again') AS d2, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day FROM pages),
response AS (
  SELECT id, url, tm, '"' || d || '"' AS etag, lm, d, [{{'k': 'content-type', 'v': 'text/html'}}, {{'k': 'content-length', 'v': CAST(p AS VARCHAR)}}, {{'k': 'etag', 'v': '"' || d || '"'}}, {{'k': 'date', 'v': lm}}] AS h
  FROM (SELECT p, 4 * p AS id, url, 100 * p AS tm, d1 AS d, day AS lm FROM base UNION ALL SELECT p, 4 * p + 1, url, 100 * p + 1000050, d2, day || ' again' FROM base WHERE p % 3 = 0)),
revisit AS (
  SELECT 4 * p + 2 AS id, url, 100 * p + (CASE p % 4 WHEN 0 THEN 5 WHEN 1 THEN 2000005 WHEN 2 THEN -3 ELSE 500005 END) AS tm,
    CASE WHEN p % 7 = 0 THEN '"other"' WHEN p % 5 = 0 OR p % 11 = 0 THEN NULL WHEN p % 8 = 1 THEN '"' || d2 || '"' ELSE '"' || d1 || '"' END AS etag, CASE WHEN p % 11 <> 0 THEN day END AS lm,
    [{{'k': 'date', 'v': day || ' later'}}, {{'k': 'content-length', 'v': '9'}}, {{'k': 'expires', 'v': 'never'}}, {{'k': 'x-cache', 'v': 'hit'}}] AS h FROM base),
url AS (SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN split_part(url, '://', 2) ELSE url END AS r FROM base),
piece AS (SELECT url, split_part(r, '#', 1) AS r FROM url),
side AS (SELECT url, split_part(r, '?', 1) AS front, CASE WHEN contains(r, '?') THEN string_split(substr(r, strpos(r, '?') + 1), '&') ELSE [] END AS args FROM piece),
host AS (SELECT url, args, lower(split_part(front, '/', 1)) AS host, rtrim(substr(front, length(split_part(front, '/', 1)) + 1), '/') AS path FROM side),
can AS (SELECT url, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE host END AS host, path,
  list_sort(list_filter(args, lambda a: a <> '' AND split_part(a, '=', 1) NOT IN ('ref', 'gclid', 'fbclid') AND NOT regexp_full_match(split_part(a, '=', 1), 'utm_[a-z]+'))) AS args FROM host),
spelled AS (SELECT url, CASE WHEN host LIKE '%:80' THEN left(host, length(host) - 3) WHEN host LIKE '%:443' THEN left(host, length(host) - 4) ELSE host END || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS c FROM can),
r AS (SELECT response.*, c FROM response LEFT JOIN spelled ON response.url = spelled.url),
v AS (SELECT revisit.*, c FROM revisit LEFT JOIN spelled ON revisit.url = spelled.url),
hit AS (SELECT v.id AS vid, max({{'tm': r.tm, 'id': r.id}}) AS place FROM v JOIN r ON v.c = r.c AND (r.tm < v.tm OR r.tm = v.tm AND r.id < v.id) GROUP BY v.id),
j AS (SELECT v.*, r.id AS rid, r.tm AS rat, r.d AS rd, r.h AS rh,
  CASE WHEN r.id IS NULL THEN 'no earlier response' WHEN v.etag IS NULL AND v.lm IS NULL THEN 'no validator' WHEN CASE WHEN v.etag IS NOT NULL THEN v.etag = r.etag ELSE v.lm = r.lm END THEN 'resolved' ELSE 'validator differs' END AS outcome
  FROM v LEFT JOIN hit ON v.id = hit.vid LEFT JOIN r ON r.id = hit.place.id),
m AS (SELECT *, list_filter(h, lambda x: list_contains([{", ".join(f"'{h}'" for h in RENEWED)}], x.k)) AS fresh FROM j)
SELECT id AS record_id, c AS canonical_url, tm AS captured, rid AS response_id, rat AS response_captured, outcome, CASE WHEN outcome = 'resolved' THEN rd END AS digest,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_transform(list_concat(fresh, list_filter(rh, lambda x: NOT list_contains(list_transform(fresh, lambda y: y.k), x.k))), lambda x: x.k || ': ' || x.v)), chr(10)) END AS headers
FROM m
"""
