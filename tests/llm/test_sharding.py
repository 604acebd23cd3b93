"""The lookup table against a plain fill; placement of odd rows."""

from collections import Counter

import pytest

from quillon.llm import sharding

SCHEMA = "doc_id long, text string, slot string, shard string"


def plain(names, slots):
    orders = []
    for s in names:
        a, b = sharding._number(f"start:{s}") % slots, sharding._number(f"step:{s}") % (slots - 1) + 1
        orders.append(iter([(a + j * b) % slots for j in range(slots)]))
    table, k = {}, 0
    while len(table) < slots:
        for slot in orders[k % len(names)]:
            if slot not in table:
                table[slot] = k % len(names)
                break
        k += 1
    return [table[i] for i in range(slots)]


def test_table():
    names = [f"n{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    assert table.tolist() == plain(names, 1009)
    sizes = Counter(table.tolist())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sharding.moved(table, fewer, names, names[:-1]) < 2.2 / 7
    weighted = Counter(sharding.lookup_table({"a": 3, "b": 1, "c": 0}, 1009).tolist())
    assert abs(weighted[0] - 757) < 5 and weighted[2] == 0
    for bad in (([], 7), (["a"], 8), ({"a": 0}, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark, tmp_path):
    rows = [(i, f"t{i}", "clash", "clash") for i in range(500)] + [(None, f"n{i}", None, None) for i in range(200)] + [(None, None, None, None), (3, "other", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    names = list(sharding.SHARDS)
    table = sharding.lookup_table(names)
    assert all(r.shard == names[table[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert len({r.shard for r in got if r.doc_id is None}) > 30  # spread, though they share the null key
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    placed = sharding.place(docs.withColumnsRenamed({"slot": "c0", "shard": "_slot"}), sharding.key_of())
    assert placed.columns == ["doc_id", "text", "c0", "_slot", "slot", "shard"] and {r._slot for r in placed.collect()} == {"clash", None, ""}
    with pytest.raises(ValueError, match="slot"):
        sharding.place(docs, sharding.key_of())
    long = spark.createDataFrame([(None, "x" * 300000, None, None)], SCHEMA)
    assert sharding.shard_documents(long).first().n_bytes == 300000
    sharding.write_shards(docs.select("doc_id", "text"), f"{tmp_path}/out", sharding.key_of())
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows) and set(back.columns) == {"doc_id", "text", "shard"}
