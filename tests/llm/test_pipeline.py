"""The pipeline's stages on a small corpus: each works on all of what came before, and its decisions take effect."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import mixing, packing, quality_cnn, secrets, simhash
from tests.llm.test_classifiers import LABELS, corpus
from tests.llm.test_secrets import ASSIGN, plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(300, 4)
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 7}", len(t)) for i, t, *_ in docs]
    rows += [(1000 + i, rows[i][1], "en", "src1", rows[i][4]) for i in range(0, 40)]  # exact copies
    rows += [(2000, "the on re an " * 30 + 'password = "hunter2secret"', "en", "src0", None), (2001, None, None, None, None), (2002, "", "en", "src0", 0), rows[9]]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    rated, single, masked, mixed, packed = seen[1:]
    assert 0 < rated.count() < docs.count()
    verdicts = quality_cnn.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
    assert Counter(r.doc_id for r in rated.collect()) == Counter(r.doc_id for r in verdicts.collect())
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(rated).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))
    assert masked.count() == single.count()
    held = {r.doc_id: r for r in single.collect()}
    value = lambda text, f: text[f[0] : f[2]] if f[1] else ASSIGN.match(text, f[0])[2]
    owners, repos = defaultdict(set), defaultdict(set)
    for r in held.values():
        for f in plain(r.text):
            owners[value(r.text, f)].add(r.source)
            repos[value(r.text, f)].add((r.source, r.lang))
    for r in masked.collect():
        text, want, at = held[r.doc_id].text, "", 0
        for f in plain(text):
            v = value(text, f)
            if len(owners[v]) < secrets.EXAMPLE_OWNERS and len(repos[v]) < secrets.EXAMPLE_REPOS:
                want, at = (want + text[at : f[0]] + secrets.REDACTED, f[2]) if f[0] >= at else (want, max(at, f[2]))
        assert r.text == (None if text is None else want + text[at:]), r.doc_id
    assert not [r for r in secrets.scan(masked).collect() if "live" in r.spans]
    if 2000 in classes.values():
        assert secrets.REDACTED in masked.where("doc_id = 2000").first().text
    before, after = {r.doc_id: r.text for r in masked.collect()}, {r.doc_id: r.text for r in mixed.collect()}
    assert after.items() <= before.items() and 0.5 < len(after) / len(before) < 1
    chosen = Counter(r.doc_id for r in mixed.collect())
    assert chosen == Counter(r.doc_id for r in mixing.mix(masked, corpus_pipeline.PLAN).collect())
    ids = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tokens = Counter()
    for r in packed.collect():
        tokens[r.doc_id] += r.length
    assert tokens == {d: n * (len(ids.encode(after[d] or "", add_special_tokens=False).ids) + 1) for d, n in chosen.items()}


def test_stages_keep_any_columns(spark, folder):
    names = ["_own", "_full", "_spans", "_score", "row", "own", "masked", "leaf", "epoch", "given"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("*", F.create_map(F.lit("a"), F.lit(1)).alias("c0"), *(F.lit("x").alias(n) for n in names))
    docs = docs.unionByName(docs.where("doc_id = 5").withColumn("text", F.repeat(F.lit("the on re token=Abc123Def456Ghi7 "), 20000)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {("x",) * len(names)}, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = f"{tmp_path}/sf"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_mixing_reaches_its_weights(spark):
    rows = [(i, f"{i:04d} " + "x" * 75, ("en", "de", "fr", "es")[i // 4 % 4], f"src{i % 4}", 80) for i in range(1600)]  # domains and languages alike
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.source_mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    share = {r.source: r["count"] / 1600 for r in mixed.groupBy("source").count().collect()}
    for source, target in zip(("src0", "src1", "src2", "src3"), mixing.PRODUCTION.domains.values(), strict=True):
        assert abs(share[source] - target) < 0.01
