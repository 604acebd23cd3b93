"""Fill-in-the-middle against a plain computation of each row."""

import hashlib
import random

import pytest
import regex

from quillon.llm import infill

SCHEMA = "doc_id long, text string, fim string, output int"


def plain(ident, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if spm else "psm", a, b - a, sha(out), sha(text)


def test_against_plain_rows(spark):
    rng = random.Random(3)
    letters = "abc Üß\n\r\t\u0085 🙂é<PSM>\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 9, 200]))) for _ in range(300)]
    texts += [None, "", "a<M>b", "<P>", "<", "<<S", "x" * 300_000, "same", "same"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", 1), (7, "again", "c", 1), (7, "again", "c", 1), (-5, "negative", "c", 1)]
    got = infill.digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = [(i, *plain(i, t)) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_restored(spark):
    rows = [(i, f"line {i}\n<S and >P> {'🙂' * i}", "x", i) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = infill.transformed(docs, into="cut_here")
    assert made.columns == [*docs.columns, "cut_here"]
    back = made.select("doc_id", "text", infill.restorer()("cut_here.output", "cut_here.form").alias("back")).collect()
    assert all(r.text == r.back for r in back) and len(back) == 80


@pytest.mark.parametrize("unit", [r"\X", r"\w+", r"[^\n]*\n?"])
def test_other_units_end_where_units_end(unit):
    pattern = regex.compile(unit)
    text = "one two\nthree é four\n\nfive"
    ends = {0, *infill.unit_ends(text, pattern)}
    for ident in range(200):
        n, form, a, m, output = infill.cut_text(ident, text, infill.Plan(unit=unit), pattern)
        assert n == len(list(pattern.finditer(text))) and infill.restored(output, form) == text
        assert form == "plain" or {a, a + m} <= ends


def test_empty_table(spark):
    assert infill.digests(spark.createDataFrame([], SCHEMA)).count() == 0
