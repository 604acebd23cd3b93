"""Alias dictionaries: cleaning, merging, folding terms to their base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import clean_alias

MAX_ALIASES = 10


def cap_aliases(aliases: DataFrame, keys: tuple[str, ...] = ("kind", "base"), n: int = MAX_ALIASES) -> DataFrame:
    """The first n distinct aliases of each base, in order of rank, ranked anew from 1."""
    once = aliases.groupBy(*keys, "alias").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "alias"))
    return once.withColumn("rank", place).where(F.col("rank") <= n)


def merge(*dictionaries: DataFrame, n: int = MAX_ALIASES) -> DataFrame:
    """(kind, base, alias, rank) of several dictionaries, the earlier ones first."""
    out = None
    for k, d in enumerate(dictionaries):
        part = d.select("kind", "base", clean_alias("alias").alias("alias"), (F.lit(k * 1_000_000) + F.col("rank")).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return cap_aliases(out.where("alias <> '' and alias <> base"), n=n)


def fold(df: DataFrame, aliases: DataFrame, term: str = "term") -> DataFrame:
    """df with base (the term that an alias stands for, else the term) and alias_used; a term of several bases takes the least."""
    one = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("base").alias("_base"))
    joined = df.join(one, df[term] == one["_alias"], "left")
    return joined.withColumn("base", F.coalesce("_base", F.col(term))).withColumn("alias_used", F.col("_base").isNotNull()).drop("_alias", "_base")


def alias_terms(aliases: DataFrame) -> DataFrame:
    """(alias_term, base_term): the expanded index terms of a dictionary and the terms they fold to."""
    kinds = F.create_map(*(F.lit(x) for pair in {"object_aliases": "object", "action_aliases": "action", "attribute_component_aliases": "attribute", "value_aliases": "value"}.items() for x in pair))
    named = aliases.withColumn("_k", F.try_element_at(kinds, F.col("kind"))).where("_k is not null")
    return named.select(F.concat("_k", F.lit("_expanded:"), "alias").alias("alias_term"), F.concat("_k", F.lit(":"), "base").alias("base_term")).groupBy("alias_term").agg(F.min("base_term").alias("base_term"))


def issues(objects: DataFrame) -> DataFrame:
    """(memory_id, obj_id, alias, issue) of objects with obj_id, template and an aliases array."""
    each = objects.select("memory_id", "obj_id", "template", F.posexplode("aliases").alias("place", "alias"))
    named = lambda df, issue: df.select("memory_id", "obj_id", "alias", F.lit(issue).alias("issue"))
    empty = named(each.where("alias is null or trim(alias) = ''"), "empty")
    sound = each.where("trim(alias) <> ''")
    again = named(sound.groupBy("memory_id", "obj_id", "alias").agg(F.count("*").alias("n")).where("n > 1"), "repeated in object")
    owners = sound.select("memory_id", "obj_id", "alias").distinct()
    shared = named(owners.withColumn("n", F.count("*").over(Window.partitionBy("memory_id", "alias"))).where("n > 1"), "shared by objects")
    ids = objects.select("memory_id", F.col("obj_id").alias("alias")).distinct()
    clash = named(owners.join(ids, ["memory_id", "alias"], "left_semi").where("alias <> obj_id"), "equals an object id")
    template = named(sound.where("alias = template").select("memory_id", "obj_id", "alias").distinct(), "equals the template")
    return empty.unionByName(again).unionByName(shared).unionByName(clash).unionByName(template)
