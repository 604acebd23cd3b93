"""Base findings and ownership against re, masking, and odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quillon.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, spans string, n_chars int"
LETTERS = "".join(chr(c) for c in range(97, 123))
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def written(found):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def fixture():
    rng = random.Random(6)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    bits = ["Été", "日本", "𝔘nit", "\x01", "\x02", "\n", " ", "token=token:abcdefgh", "token=ab", "PassWord : 'hunter22x'", "apikey=", "API_KEY==\"Zx9", "secret=secret=abc", "KEY", "AKIAAKIA", "ſecret=abcdefgh", "toKen=abcdefgh"]
    texts = [None, "", "x", "\x01", "token=token:abcdefgh", "password=secret=abcdef token", "AKIA" * 9, "f" * 24 + "g" + "0" * 23]
    for n in (5, 20, 60, 400, 3000):
        parts = []
        for _ in range(n):
            parts.append(rng.choice([rng.choice(bits), some("0123456789abcdef", rng.randrange(20, 28)), "AKIA" + some("ABCXYZ0189", rng.randrange(14, 19)), some(LETTERS, 5), f"passwd={some(LETTERS + 'XYZ019', rng.randrange(3, 12))}"]) + rng.choice(["", " ", ","]))
        texts.append("".join(parts))
    return texts


def test_base_spans(spark):
    texts = fixture()
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame([(i, t, "en", f"s{i % 3}", "clash", 1) for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        want, r = plain(t), got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)], i
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), i
        assert set(written(want).split(",")) - {""} <= set(r.spans.split(","))


def test_ownership_and_masking(spark):
    live, copied, mine = "Qw3rTy9uIoPaSdFg7hJkLz", "Zx8CvBn5mAsDfGh2jKlQwE", "token=R4nd0mV4lu3Zq9x"
    rows = [(1, f"see {live} here {live}", "en", "a"), (2, f"{live}", "de", "a")]
    rows += [(10 + k, f"doc {copied} and {mine} été", "en", f"o{k % 4}") for k in range(200)]
    rows += [(300, mine, "en", "o0"), (301, "plain text only", "en", None), (None, f"x {live}", None, "a"), (301, "plain text only", "en", None), (400, "é secret: k3yOfOneOwner9Xz and " + "0" * 24, "en", "b")]
    docs = spark.createDataFrame([(*r, "clash", len(r[1])) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert got[1].spans == "live:4:26,live:32:54" and got[1].n_live == 2
    assert got[None].spans == "live:2:24"
    assert got[10].n_example == 2 and "live" not in got[10].spans and got[10].n_assign == 1
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    out = {r.doc_id: r for r in masked.collect()}
    assert out[1].text == f"see {secrets.REDACTED} here {secrets.REDACTED}" and out[1].n_chars == len(out[1].text)
    assert out[10].text == f"doc {copied} and {mine} été"  # both are widely copied
    assert out[400].text == f"é {secrets.REDACTED} and {secrets.REDACTED}" and got[400].spans == "assign:2:26,live:10:26,hex:31:55"
    assert out[301].text == "plain text only"
    assert secrets.scan(docs.limit(0)).count() == 0 and secrets.redact(docs.limit(0)).count() == 0


def test_masking_across_blocks(spark):
    rng = random.Random(8)
    texts = []
    for n in (1, 3, 40):
        parts = [rng.choice(["é" * rng.randrange(1, 900), "x y " * rng.randrange(1, 900), "secret=" + "a1B" * rng.randrange(2, 2000), "𝔘" * 50]) for _ in range(n * 8)]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, _spans string, own int")
    for r in secrets.redact(docs).collect():
        want, at = [], 0
        for a, _, b in plain(texts[r.doc_id]):
            if a >= at:
                want += [texts[r.doc_id][at:a], secrets.REDACTED]
            at = max(at, b)
        assert r.text == "".join(want) + texts[r.doc_id][at:]


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "en", "a", "", 1)], SCHEMA)
    for df in (secrets.candidates(docs), secrets.redact(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_running_sums(spark):
    n = 5000
    got = spark.range(1).select(secrets._running(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("s")).first().s
    assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]
