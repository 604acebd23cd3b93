"""Base counts against brute force; the bands on plain, repetitive and random texts."""

import random
import re
import zlib
from collections import Counter

import pytest
import zstandard

from quillon.llm import compression

SCHEMA = "doc_id long, text string, ratio double, kept string"


class Prose:
    """Words of an invented language, as frequent as those of natural ones."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        syllables = [c + v + e for c in "bcdfghklmnprstvw" for v in "aeiou" for e in ("", "n", "r", "s", "l", "t")]
        self.words = ["".join(self.rng.choice(syllables) for _ in range(self.rng.randrange(1, 4))) for _ in range(3000)]
        self.weights = [1 / (rank + 10) for rank in range(3000)]

    def __call__(self, n_chars, sep=" "):
        return sep.join(self.rng.choices(self.words, self.weights, k=n_chars // 3 + 1))[:n_chars]


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def fixture():
    rng = random.Random(1)
    words = ["un", "été", "a b", "x#", "|", "naïve", "wort ", "日本語"] + [f"word{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one two", "a a a a a", "a b c a b c"]
    for n in (3, 40, 60, 400, 6000):
        texts.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(n)))
    texts.append("same line here\n" * 50 + " \n\n")
    texts.append(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(300)))
    return texts


def test_base_counts(spark):
    texts = fixture()
    got = {r.doc_id: r for r in compression.apply_rules(spark.createDataFrame([(i, t, 0.0, "clash") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), i
        assert not (r.kept and r.base_failed)
    assert got[len(texts) - 1].reason == "incompressible" and not got[len(texts) - 1].base_failed


@pytest.fixture(scope="module")
def bands(spark):
    """Bands fitted on prose of other seeds than the tests', its lengths as the tests' are."""
    prose = Prose(100)
    rows = [(i, prose(n), 1.0, "x") for i, n in enumerate([150, 200, 280, 330, 400, 450, 600, 700, 800, 1000, 1200, 1700, 2100, 3000, 3500, 5000, 7000, 9000, 12000, 20000, 31000, 70000] * 90)]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in rows] + [(None, 1, 0), (1, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    return compression.fit_bands(spark.createDataFrame(rows, SCHEMA), labels)


def test_fit_takes_good_training_documents_alone(spark, bands):
    assert [b[0] for b in bands] == sorted({b[0] for b in bands}) and all(lo < hi for _, lo, hi in bands)
    assert compression.band(20000, bands)[1] < 3 and compression.band(2048, bands)[0] > 1.35
    prose = Prose(101)
    rows = [(i, prose(2500), 1.0, "x") for i in range(400)] + [(i, "x " * 2000, 1.0, "x") for i in range(400, 700)]
    known = [(i, 1 if i < 400 or zlib.crc32(str(i).encode()) % 5 == 0 else 0, 0) for i in range(700)]  # junk is labelled good on the held-out side only
    fitted = compression.fit_bands(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
    assert compression.band(4000, fitted)[1] < 3
    assert compression.read_bands(compression.bands_table(spark, fitted)) == fitted
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert compression.fit_bands(spark.createDataFrame(rows, SCHEMA), none) == compression.PRIOR


def test_fit_takes_all_good_training_documents(spark):
    prose = Prose(102)
    texts = [prose(200 + i % 700) for i in range(6000)]
    labels = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ratios = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5:
            n = len(t.encode())
            ratios.setdefault(max(e for e in compression.EDGES if e <= n), []).append(n / len(zstandard.ZstdCompressor(level=3).compress(t.encode())))
    found = compression.quantiles(compression.training_ratios(docs, labels), [0.001, 0.999])
    assert found.keys() == {k for k, v in ratios.items() if len(v) >= compression.LEAST} and sum(map(len, ratios.values())) > 4500
    for edge, ends in found.items():
        whole, n = sorted(ratios[edge]), len(ratios[edge]) - 1
        for q, got in zip((0.001, 0.999), ends, strict=True):
            k = int(n * q)
            assert abs(got - (whole[k] + (whole[min(k + 1, n)] - whole[k]) * (n * q - k))) < 1e-12


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert compression.apply_rules(empty).count() == 0
    assert compression.fit_bands(empty, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")) == compression.PRIOR


def plain_verdict(text, bands):
    """Ratios and reason by the rule's words."""
    if not text:
        return None, None, None, ""
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))

    def side(x):
        lo, hi = [(lo, hi) for least, lo, hi in bands if least <= len(x)][-1]
        return "repetitive" if ratio(x) > hi else "incompressible" if ratio(x) < lo else ""

    chunks, rest = [], text
    while len(rest) >= 4096:
        chunks.append(rest[:2048])
        rest = rest[2048:]
    chunks.append(rest)
    sides = Counter(side(c) for c in chunks)
    reason = side(text)
    if not reason and len(chunks) > 1:
        most = "repetitive" if sides["repetitive"] >= sides["incompressible"] else "incompressible"
        reason = f"{most} chunks" if sides[most] > len(chunks) / 4 else ""
    return ratio(text), min(map(ratio, chunks)), max(map(ratio, chunks)), reason


def test_ratios_and_verdicts(spark, bands):
    prose = Prose(12)
    bands = [(n, lo - 0.4 if n >= 4096 else lo, hi) for n, lo, hi in bands]  # so a text can have bad chunks and not be bad as a whole
    noise = lambda n: "".join(prose.rng.choices(LETTERS, k=n))
    texts = [None, ""]
    for n in (1, 127, 128, 191, 300, 700, 2047, 2048, 2049, 4095, 4096, 4097, 6100, 9000, 70000):
        texts += ["x " * (n // 2), prose(n), noise(n), prose(n - n // 3) + " " + " ".join(noise(40) for _ in range(n // 120)), prose(n - n // 3) + prose(n // 3, "### ")]
    got = {r.doc_id: r for r in compression.apply_rules(spark.createDataFrame([(i, t, 0.0, "clash") for i, t in enumerate(texts)], SCHEMA), bands=bands).collect()}
    reasons = set()
    for i, t in enumerate(texts):
        want, r = plain_verdict((t or "").encode(), bands), got[i]
        assert (r.ratio, r.least_chunk_ratio, r.greatest_chunk_ratio) == want[:3], i
        assert r.reason == ("base" if r.base_failed else want[3]) and r.kept == (not r.base_failed and not want[3]), i
        reasons.add(want[3])
    assert reasons == {"", "repetitive", "incompressible", "repetitive chunks", "incompressible chunks"}


def test_copied_phrases_are_rejected_and_prose_is_not(spark, bands):
    prose = Prose(13)
    clean = [prose(n) for n in (450, 600, 900, 1500, 2100, 2600, 3500, 6000, 9000, 31000, 70000)]
    stock = [prose(45).rsplit(" ", 1)[0] for _ in range(4)]
    stuffed = [" ".join(f"{prose(70)} {prose.rng.choice(stock)}" for _ in range(n // 115)) for n in (2000, 6000, 31000, 70000)]  # two fifths are copied phrases
    rows = [(i, t, 0.0, "clash") for i, t in enumerate(clean + stuffed)]
    got = {r.doc_id: r for r in compression.apply_rules(spark.createDataFrame(rows, SCHEMA), bands=bands).collect()}
    assert [got[i].kept for i in range(len(clean))] == [True] * len(clean)
    assert {got[len(clean) + k].reason for k in range(len(stuffed))} <= {"repetitive", "repetitive chunks"}


def test_repetitive_chunks_and_clean_text(spark, bands):
    prose = Prose(2)
    clean = [prose(n) for n in (500, 3000, 30000)]
    tail = clean[2] + " " + " ".join(f"{i % 7} go go on {i % 3}" for i in range(6000))
    rows = [(i, t, 0.0, "clash") for i, t in enumerate([*clean, tail])]
    got = {r.doc_id: r for r in compression.apply_rules(spark.createDataFrame(rows, SCHEMA), bands=bands).collect()}
    assert [got[i].kept for i in range(3)] == [True] * 3
    assert not got[3].kept
    assert compression.apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_encoded_texts_and_blocks(spark, bands):
    prose = Prose(3)
    bands = [(n, lo - 0.6 if n >= 16384 else lo, hi) for n, lo, hi in bands]  # long texts are judged by their chunks alone
    noise = lambda n, width=50: " ".join("".join(prose.rng.choices(LETTERS, k=width)) for _ in range(n // width + 1))[:n]
    bad = [noise(n, 30) for n in (2100, 3500, 6000, 8000)]
    for percent in (30, 50, 70, 80, 90):
        for before in (1000, 4096, 5000):
            block = 31000 * percent // 100
            bad.append(f"{prose(before)} {noise(block)} {prose(31000 - block - before)}")
    good = [prose(n) for n in (400, 600, 900, 1500, 2100, 2600, 3500, 6000, 31000)]
    good.append(f"{prose(20000)} {noise(1500)} {prose(9000)}")  # a short key in a long text
    rows = [(i, t, 0.0, "clash") for i, t in enumerate(bad + good)]
    got = {r.doc_id: r for r in compression.apply_rules(spark.createDataFrame(rows, SCHEMA), bands=bands).collect()}
    assert [got[i].base_failed for i in got] == [False] * len(got)
    assert {got[i].reason for i in range(len(bad))} == {"incompressible", "incompressible chunks"}
    assert [got[len(bad) + i].reason for i in range(len(good))] == [""] * len(good)
