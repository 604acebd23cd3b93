"""Revisit resolution against a plain scan."""

import random

from pyspark.sql import functions as F

from quillon.llm import revisits

SCHEMA = "record_id long, url string, captured long, kind string, etag string, last_modified string, digest string, headers map<string,string>, outcome string"


def plain(rows, names):
    out = []
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [x for x in rows if x[3] == "response" and names[r[1]] is not None and names[x[1]] == names[r[1]] and (x[2], x[0]) < (r[2], r[0])]
        if not earlier:
            out.append((r[0], r[2], None, "no earlier response", None, None))
            continue
        hit = max(earlier, key=lambda x: (x[2], x[0]))
        strip = lambda t: t.removeprefix("W/") if t else t
        same = strip(r[4]) == strip(hit[4]) if r[4] is not None else r[5] == hit[5] if r[5] is not None else None
        outcome = {None: "no validator", True: "resolved", False: "validator differs"}[same]
        merged = {**(hit[7] or {}), **{k: v for k, v in (r[7] or {}).items() if k in revisits.RENEWED}}
        text = "\n".join(sorted(f"{k}: {v or ''}" for k, v in merged.items()))
        out.append((r[0], r[2], hit[0], outcome, hit[6] if same else None, text if same else None))
    return sorted(out, key=str)


def test_against_plain_scan(spark):
    rng = random.Random(7)
    spelled = ["http://A.com/x", "https://www.a.com/x/", "a.com/x?utm_source=f#t", "http://a.com:80/x?ref=1", "http://a.com/x?b=2&a=1", "http://a.com/x?a=1&b=2&gclid=3", "http://b.org/", "HTTP://B.ORG", "", None]
    rows = []
    for i in range(700):
        kind = rng.choice(["response", "revisit", "revisit", "other"])
        url = spelled[0] if rng.random() < 0.4 else rng.choice(spelled)
        headers = rng.choice([None, {}, {"date": str(i), "content-length": "5"}, {"etag": f"e{i}", "x": None}])
        rows.append((i, url, rng.randrange(0, 300), kind, rng.choice([None, '"p"', 'W/"p"', '"q"']), rng.choice([None, "m1", "m2"]), f"d{i}", headers, "clash"))
    names = {r.url: r.c for r in spark.createDataFrame([(s,) for s in spelled], "url string").select("url", revisits.canonical("url").alias("c")).collect()}
    assert len({names[s] for s in spelled[:4]}) == 1 and names[spelled[4]] == names[spelled[5]] and names[spelled[6]] == names[spelled[7]] == "b.org"
    for coarse in (revisits.COARSE, 3):
        got = revisits.resolve(spark.createDataFrame(rows, SCHEMA), coarse)
        have = sorted(((r.record_id, r.captured, r.response_id, r.outcome, r.digest, r.headers) for r in got.collect()), key=str)
        assert have == plain(rows, names)


def test_odd_rows(spark):
    same = (2, "u", 5, "revisit", None, None, None, None, None)
    rows = [(1, "u", 5, "response", None, None, "d", {"a": "b"}, None), same, same, (None, "u", None, "revisit", "x", None, None, None, None), (4, None, 9, "revisit", "x", None, None, None, None), (5, "u", None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.record_id, r.response_id, r.outcome) for r in revisits.resolve(frame).collect()), key=str)
    assert got == sorted([(2, 1, "no validator"), (2, 1, "no validator"), (None, None, "no earlier response"), (4, None, "no earlier response")], key=str)
    assert revisits.resolve(frame.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://h/x", "a"), (None, None, None)], "page_id long, url string, html string")
    assert revisits.resolve(revisits.records_of(pages)).select(F.count("*")).first()[0] == 2  # of each page a capture and a check; page 1 is not captured again


def test_every_outcome_is_met(spark):
    pages = spark.createDataFrame([(i, f"http://{'www.' if i % 2 else ''}h{i}.example.com/p", f"t{i}") for i in range(400)], "page_id long, url string, html string")
    got = revisits.resolve(revisits.records_of(pages)).collect()
    assert {r.outcome for r in got} == {"resolved", "validator differs", "no validator", "no earlier response"}
    second = [r for r in got if r.response_id is not None and r.response_id % 4 == 1]  # answered by a later capture of the URL
    assert {r.outcome for r in second} >= {"resolved", "validator differs"}
    long = spark.createDataFrame([(1, "u/" + "x" * 200000, 1, "response", "e", None, "d", {"a": "b" * 100000}, None), (2, "http://u/" + "x" * 200000, 2, "revisit", "e", None, None, None, None)], SCHEMA)
    assert revisits.resolve(long).first().headers == "a: " + "b" * 100000
