"""The corpus pipeline: five stages from raw documents to packed training sequences.

All stages but the last return the columns of documents, which may be more than the five known ones and bear any name.
Null, empty and very long texts, null ids, ties, repeated rows and empty tables are met in every stage as its docstring
says, and in the operators' own words.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, quality_cnn, secrets, simhash
from quillon.session import ensure_checkpoint_dir, table

#: As many tokens as the earlier stages kept, in the plan's epochs: with each document once its weights can't be reached.
PLAN = replace(mixing.PRODUCTION, share=1.0)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text is scored as the empty one, which holds nothing but padding: it stays or goes as the fitted network scores that (over the
    limit on the given labels, so it stays, and the next stage keeps one of all such); long texts are scored whole; rows that are alike get one verdict; without any
    label all rows stay; an empty table stays empty.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id.

    Null, empty and wordless texts are one group; long texts are compared whole; a null id yields to any other; of repeated
    rows one stays, of rows with one id in a group that with the least hash; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live and other owned credentials are masked in their texts, widely copied examples are not; all documents stay.

    Null and empty texts stay as they are; long texts are masked whole; repeated rows are masked alike; an empty table
    stays empty.
    """
    return secrets.redact(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted budget selects, once for each epoch that they are in.

    Null and empty texts have no tokens and go with whole epochs alone; a long text counts by all its tokens; null and
    unknown languages and sources are pooled; of equal rows where a budget ends as many stay as fill it; an empty table
    stays empty.
    """
    return mixing.select_rows(docs, PLAN)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    A null or empty text is one piece with the end id; long texts are cut; repeated rows are packed each; an empty table
    gives no sequences.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: Convolution, fingerprints and byte-pair tokens have no SQL form.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written to the shared folder and read again by the next, then removed."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{context.applicationId}-{context._jvm.java.util.UUID.randomUUID()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
