"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its own; shards take turns claiming the
first free slot of their order, as often as their weights say, until the table is full. A row's slot is a hash
of its key, its shard is what the table holds there. The table is broadcast: its size is the prime SLOTS
whatever the data, so a placement is one probe, and nothing is shuffled.

Adding or removing a shard moves about that shard's own portion of the slots and few others.

Defined cases: rows with a null key are placed by the hash of their text, and so are spread; a null text is empty; very long
texts are hashed whole where they are the key; rows that repeat a key go to one shard; shards whose turns tie claim in the
order given; an empty table gives an empty result; further input columns, whatever their names, are kept by `place`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import shielded

#: Prime, and over a hundred slots a shard, which keeps the shards' portions within about a percent.
SLOTS = 65537
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, float], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot. With a mapping, shards claim in proportion to their weights."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1.0)
    if not is_prime(slots):
        raise ValueError(f"{slots} is not prime")
    if not weights or len(weights) > slots or min(weights.values()) < 0 or max(weights.values()) <= 0:
        raise ValueError("shards need names, weights of 0 or more, and no more of them than slots")
    names = list(weights)
    start = [_number(f"start:{s}") % slots for s in names]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in names]
    table = np.full(slots, -1, dtype=np.int32)
    place, credit, most, left = [0] * len(names), [0.0] * len(names), max(weights.values()), slots
    while left:
        for k, name in enumerate(names):
            credit[k] += weights[name] / most
            if credit[k] < 1 or not left:
                continue
            credit[k] -= 1
            while table[slot := (start[k] + place[k] * step[k]) % slots] >= 0:
                place[k] += 1
            table[slot] = k
            place[k] += 1
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots).cast("int")


def key_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def place(df: DataFrame, key: Column, shards: Sequence[str] | Mapping[str, float] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with slot_col and shard_col, which must not be columns of df."""
    taken = {slot_col, shard_col} & set(df.columns)
    if taken:
        raise ValueError(f"{sorted(taken)} are columns already; name others with slot_col and shard_col")
    inner, _ = shielded(df)
    names = list(shards)
    rows = [(slot, names[k]) for slot, k in enumerate(lookup_table(shards, slots).tolist())]
    owners = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    keyed = df.select("*", slot_of(key, slots)).toDF(*inner.columns, "slot")
    return keyed.join(F.broadcast(owners), "slot").select(*inner.columns, "slot", "shard").toDF(*df.columns, slot_col, shard_col)


def write_shards(df: DataFrame, path: str, key: Column, shards: Sequence[str] | Mapping[str, float] = SHARDS, slots: int = SLOTS, shard_col: str = "shard") -> None:
    """df under path, a folder for each shard. Tasks write their own files, so a large shard is many files and no row moves."""
    slot_col = next(f"slot{k}" for k in range(len(df.columns) + 2) if f"slot{k}" not in (*df.columns, shard_col))
    place(df, key, shards, slots, slot_col, shard_col).drop(slot_col).write.partitionBy(shard_col).parquet(path)


def moved(before: np.ndarray, after: np.ndarray, names_before: Sequence[str], names_after: Sequence[str]) -> float:
    """The portion of slots whose owner changes from one table to another."""
    a, b = np.array(list(names_before))[before], np.array(list(names_after))[after]
    return float((a != b).mean())


def shard_documents(docs: DataFrame, shards: Sequence[str] | Mapping[str, float] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, slot, shard, n_bytes) for every row of docs."""
    slim = docs.select(F.col(id_col).alias("doc_id"), key_of(id_col, text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return place(slim, F.col("key"), shards, slots).select("doc_id", "slot", "shard", "n_bytes")


def oracle(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB SQL for shard_documents over documents; the table is written out as one list."""
    owners = ",".join(map(str, lookup_table(shards, slots).tolist()))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""
WITH t AS MATERIALIZED (SELECT [{owners}] AS owners, [{names}] AS names),
owner AS MATERIALIZED (SELECT generate_subscripts(owners, 1) - 1 AS slot, unnest(owners) AS k FROM t),
named AS (SELECT slot, names[k + 1] AS shard FROM owner, (SELECT names FROM t)),
keyed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 8)) AS BIGINT) % {slots} AS slot, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents)
SELECT doc_id, CAST(keyed.slot AS INTEGER) AS slot, shard, n_bytes FROM keyed JOIN named ON keyed.slot = named.slot
"""
