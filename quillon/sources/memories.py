"""Readers and writers of memories, registries and alias dictionaries.

Files of memories are JSON lines (blank lines, `---` separators and lines that are no JSON are skipped) or whole
JSON documents with one memory or a list of them. Everything after the read is columnar: Parquet tables replace
object pickles, and a table's folder is the unit of replacement.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import without_fences
from quillon.operators.statistics import first_by

#: Free-form parts stay JSON text; the reader gives nested values of these fields as text.
MEMORY = "id string, activity string, protagonist string, objects string, actions string, goal_states string"


def _inner(raw: Column) -> Column:
    """The memory in a document, with or without its `memory` envelope."""
    return F.coalesce(F.get_json_object(raw, "$.memory"), raw)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw) of every line that is a JSON object."""
    lines = spark.read.text(path).select(F.trim("value").alias("raw")).where(~F.col("raw").isin("", "---"))
    return lines.where(F.try_parse_json("raw").isNotNull() & F.col("raw").startswith("{"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(raw) of whole files that hold one JSON object or a list of them."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("raw")).where(F.try_parse_json("raw").isNotNull())
    each = F.from_json("raw", "array<string>")
    return whole.select(F.explode(F.when(F.col("raw").startswith("["), each).otherwise(F.array("raw"))).alias("raw"))


def memories(raw: DataFrame) -> DataFrame:
    """Envelope rows (memory_id, activity, protagonist, objects, actions, goals) of raw documents; of one id the first counts."""
    inner = _inner(F.col("raw"))
    get = lambda name: F.get_json_object(inner, f"$.{name}")
    own = F.coalesce(get("id"), F.get_json_object("raw", "$.id"), F.get_json_object("raw", "$.memory_id"))
    rows = raw.select(own.alias("memory_id"), F.coalesce(get("activity"), F.get_json_object("raw", "$.activity")).alias("activity"), get("protagonist").alias("protagonist"), get("objects").alias("objects"), get("actions").alias("actions"), F.coalesce(get("goal_states"), get("goals")).alias("goals"), F.xxhash64("raw").alias("_h"))
    return first_by(rows.where("memory_id is not null"), "memory_id", ["_h"]).drop("_h")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(kind, base, alias, rank) of a JSON file of kinds, bases and alias lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    kinds = whole.select(F.explode("m").alias("kind", "bases"))
    bases = kinds.select("kind", F.explode("bases").alias("base", "list"))
    return bases.select("kind", "base", F.posexplode("list").alias("rank", "alias")).select("kind", "base", "alias", (F.col("rank") + 1).alias("rank"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(query_term, weight) of `term|weight` lines; the weight is 1 where there is none."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    return lines.select(F.trim(F.split_part("v", F.lit("|"), F.lit(1))).alias("query_term"), F.coalesce(F.split_part("v", F.lit("|"), F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))


def write_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_snapshot(df: DataFrame, folder: str, count: int, milestones: tuple[int, ...] = (1, 10, 50, 100, 500, 1000)) -> str | None:
    """A copy under the milestone that count reaches, or nothing."""
    if count not in milestones:
        return None
    path = f"{folder}/snapshot-{count:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_results(ranked: DataFrame, path: str, top: int = 10) -> None:
    """The best results with their details, as JSON lines."""
    ranked.orderBy(F.desc("score"), "memory_id").limit(top).write.mode("overwrite").json(path)


def upsert(stored: DataFrame, changed: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """stored with changed rows added; of one key the changed row wins, or the stored one if overwrite is off."""
    both = stored.withColumn("_o", F.lit(1 if overwrite else 0)).unionByName(changed.withColumn("_o", F.lit(0 if overwrite else 1)))
    return first_by(both, key, ["_o"]).drop("_o")


def terms_hash(vectors: DataFrame) -> str:
    """A name for the set of terms that a group of vectors covers: the cache is valid while it stays."""
    r = vectors.select("term").distinct().agg(F.count("*").alias("n"), F.sum(F.xxhash64("term").cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}"


def save_vectors(vectors: DataFrame, folder: str, group: str) -> None:
    """(term, vec) of a group, with the name of its terms beside it."""
    vectors.withColumn("terms_hash", F.lit(terms_hash(vectors))).write.mode("overwrite").parquet(f"{folder}/group={group}")


def load_vectors(spark: SparkSession, folder: str, group: str, terms: DataFrame | None = None) -> DataFrame | None:
    """The stored group, or None if it is missing, unreadable or made for other terms."""
    try:
        stored = spark.read.parquet(f"{folder}/group={group}")
    except Exception as e:  # a missing or broken folder is a miss
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ" in str(e):
            return None
        raise
    if terms is not None:
        head = stored.select("terms_hash").first()
        if head is None or head.terms_hash != terms_hash(terms):
            return None
    return stored.drop("terms_hash")


def parse_responses(df: DataFrame, column: str = "response") -> DataFrame:
    """df with parsed: the variant in a model's response, whose code fences are taken off; null if it is no JSON."""
    return df.withColumn("parsed", F.try_parse_json(without_fences(column)))


def replayed(prompts: DataFrame, responses: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """Prompts with recorded responses: the provider interface of tests and of reruns. Unknown prompts get null."""
    own = prompts.withColumn(key, F.sha2("prompt", 256))
    return own.join(first_by(responses, key, ["response"]).select(key, "response"), key, "left")


def review_accepted(initial: Column, review: Column, least: float = 0.9) -> Column:
    """The review if it is JSON and at least 0.9 as long as what it reviews, else the initial output."""
    return F.when(F.try_parse_json(review).isNotNull() & (F.length(review) >= least * F.length(initial)), review).otherwise(initial)


def pretty(column: Column) -> Column:
    """A JSON text with its own indentation."""
    return F.to_json(F.try_parse_json(column), {"pretty": "true"})




def append_lines(df: DataFrame, path: str, separator: str | None = "---") -> None:
    """Rows as JSON text lines added to a folder, each followed by a blank line and the separator, as read_jsonl reads them."""
    line = F.to_json(F.struct(*df.columns))
    df.select((line if separator is None else F.concat(line, F.lit(f"\n\n{separator}"))).alias("value")).write.mode("append").text(path)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def list_vectors(spark: SparkSession, folder: str) -> list[str]:
    """The names of the stored groups."""
    system, path = _files(spark, folder)
    if not system.exists(path):
        return []
    return sorted(s.getPath().getName().removeprefix("group=") for s in system.listStatus(path) if s.getPath().getName().startswith("group="))


def has_vectors(spark: SparkSession, folder: str, group: str) -> bool:
    return group in list_vectors(spark, folder)


def clear_vectors(spark: SparkSession, folder: str, group: str | None = None) -> None:
    """Removes one stored group, or all of them."""
    for name in list_vectors(spark, folder) if group is None else [group]:
        system, path = _files(spark, f"{folder}/group={name}")
        system.delete(path, True)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, scene) of whole files in the scene format; the id is that of the assembly, else the file's name."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("scene"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).where(F.try_parse_json("scene").isNotNull())
    inner = F.coalesce(F.get_json_object("scene", "$.3d_assembly.assembly_id"), F.get_json_object("scene", "$.assembly_id"), F.regexp_replace("file", r"\.(3dassembly\.)?json$", ""))
    return whole.select(inner.alias("scene_id"), "scene")


def write_scenes(scenes: DataFrame, path: str) -> None:
    """Scenes as lines in the scene format, each in its envelope."""
    from quillon.operators.geometry import unwrapped, wrapped

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: wrapped(unwrapped(text)))

    scenes.select(told("scene").alias("value")).write.mode("overwrite").text(path)


def stored_elements(stored: DataFrame, changed: DataFrame, overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """The element registry (template, elements) with sound changes taken in, and the changes that are refused: those without elements."""
    empty = F.coalesce(F.size("elements") < 1, F.lit(True)) | F.col("template").isNull()
    return upsert(stored, changed.where(~empty), "template", overwrite), changed.where(empty)


def without_elements(stored: DataFrame, templates: DataFrame) -> DataFrame:
    return stored.join(templates.select("template").distinct(), "template", "left_anti")
