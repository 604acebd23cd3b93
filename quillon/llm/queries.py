"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import compression, infill, mixing, odd_sketch, packing, prefix_trie, quality_cnn, revisits, secrets, sharding, simhash, topk, toxicity
from quillon.session import table


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression.apply_rules(docs, bands=compression.fit_bands(docs, table(spark, sf_dir, "labels")))


def table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve(revisits.records_of(table(spark, sf_dir, "pages")))


def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def prefix_trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_nodes(table(spark, sf_dir, "conversations"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": simhash_dedup,
    "op2_table_sharding": table_sharding,
    "op3_weighted_mix": weighted_mix,
    "op4_multi_length_packing": multi_length_packing,
    "op5_quality_cnn": quality_network,
    "op6_warc_revisits": warc_revisits,
    "op7_compression_bands": compression_bands,
    "op8_toxicity_chain": toxicity_chain,
    "op9_secret_scan": secret_scan,
    "op10_block_topk": block_topk,
    "op11_prefix_trie": prefix_trie_nodes,
    "op12_fill_in_middle": fill_in_middle,
    "op13_odd_sketch_dedup": odd_sketch_dedup,
}
TOPK_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.row <> d.row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op2_table_sharding": sharding.oracle(),
    "op6_warc_revisits": revisits.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op10_block_topk": TOPK_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_odd_sketch_dedup": odd_sketch.ORACLE,
}
