"""The prefix trie of conversations by partition refinement.

All conversations start in one class. A round looks at the next turns of each active class: turns that all members share
are passed, and at the first one where they part the class splits by that turn. A class that stayed whole looks twice as
far ahead in the next round, so a long shared run takes a logarithm of rounds and few turns are read twice. A class of
one member retires: its further turns are a unary chain and are emitted at the end by one join. What is left of the
active classes' turns is written after each round, so it shrinks as classes retire. When none is active, leaves and
saved tokens are folded back, level by level of splits, over the classes alone.

Turns meet by 128 bits of a SHA-256 of role and text; texts are read once. Keys of any weight are split: the turns of one
conversation are dealt in blocks, classes that hold many rows are joined by `scan.joined`, turns are numbered by ranges,
and the ids that end at one node are put together in bounded chunks, of which a digest is taken in a stream (SHA-256
of one list is sequential by definition; a task holds one chunk at a time).

Defined cases: rows without a conv_id belong to no conversation and are left out; null roles and texts are empty ones;
turns with a null number come first, turns of one number are ordered by role and text; repeated rows are turns of their
own; a remainder of a negative conv_id is negative, as in SQL; very long texts are hashed whole; an empty table gives no
node, not even the root; further input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.scan import joined, running
from quillon.session import removed, stored

#: Turns of one conversation that are joined as one key.
BLOCK = 1 << 16
#: Width of the id ranges that ending conversations are put together in.
CHUNK = 1 << 12
EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): numbered turns, each with the key of what it says and how many words that is."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = conversations.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text")).where("conv_id is not null")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    keyed = slim.withColumns({"key": F.unhex(F.substring(F.sha2(whole, 256), 1, 32)), "words": F.regexp_count("text", F.lit(WORD)).cast("long")})
    return running(keyed, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], {"pos": F.lit(1).cast("long")}, ["conv_id", "key", "words"])


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from the head of its twenty."""
    return F.crc32(conv.cast("string")) % 4


def rebuilt(turns: DataFrame, every: int = 20) -> DataFrame:
    """turns in which each conversation c starts with the first h turns of c - c % every and goes on with its own after h."""
    turns = stored(turns)
    base = F.col("conv_id") - F.col("conv_id") % every
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", head_length(F.col("conv_id")).alias("h"), base.alias("base"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("_base_n"))
    convs = stored(own.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("_base_n", F.lit(0)))).drop("_base_n"))
    heads = turns.where("pos <= 3").select(F.col("conv_id").alias("base"), "pos", "key", "words")
    head = heads.join(convs.where("h > 0").select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "key", "words")
    shift = convs.select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", 16))).alias("_b"))
    tail = turns.withColumn("_b", F.shiftright("pos", 16)).join(shift, ["conv_id", "_b"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words")
    end = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)) + 1).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return head.unionByName(tail).unionByName(end)


def ended(turns: DataFrame) -> DataFrame:
    """turns with a row behind each conversation's last, without a key."""
    last = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("pos"))
    return turns.select("conv_id", "pos", "key", "words").unionByName(last.select("conv_id", "pos", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words")))


def _blocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_b", F.shiftright("pos", 16))


def _of_blocks(convs: DataFrame) -> DataFrame:
    """A row for each block that a conversation's turns, `length` and the end among them, are in."""
    return convs.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("length") + 1, 16))))


_CLASS = ["class", "start", "known", "ahead", "n", "mass", "level"]


def _split(now: DataFrame, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (groups, tagged, next). groups: what members of a class say at each turn looked at; tagged: now; both with the turn at which the class splits; next: the turns of what stays active."""
    last = F.col("known") + F.col("ahead")
    seen = now.where(F.col("pos") <= last)
    groups = stored(seen.groupBy(*_CLASS, "pos", "key").agg(F.count("*").alias("c"), F.min("conv_id").alias("least"), F.max("words").alias("words"), F.sum("length").alias("heavy")))
    shared = F.col("key").isNotNull() & (F.col("c") == F.col("n"))
    split = groups.groupBy("class", "start", F.col("mass").alias("weight")).agg(F.min(F.when(~shared, F.col("pos"))).alias("split"))
    tagged = stored(joined(now, split, ["class", "start"], "weight", total))
    whole = tagged.where("split is null").withColumns({"known": last, "ahead": F.col("ahead") * 2}).where("pos > known").drop("split")
    groups, seen_groups = stored(joined(groups, split, ["class", "start"], "weight", total)), groups
    children = groups.where("pos = split and key is not null and c > 1").select("class", "start", "key", F.struct(F.col("least").alias("class"), F.col("split").alias("start"), F.col("split").alias("known"), F.lit(1).cast("long").alias("ahead"), F.col("c").alias("n"), F.col("heavy").alias("mass"), (F.col("level") + 1).alias("level")).alias("child"), F.col("heavy"))
    lead = tagged.where("pos = split and key is not null").select("conv_id", "length", "class", "start", "key")
    lead = _of_blocks(joined(lead, children, ["class", "start", "key"], "heavy", total)).select("conv_id", "_b", "child")
    parted = _blocked(tagged.where("pos > split")).join(lead, ["conv_id", "_b"]).select("conv_id", "pos", "key", "words", "length", "child.*")
    after = stored(whole.select(*parted.columns).unionByName(parted))
    removed(seen_groups)
    return groups, tagged, after


def _fold(segments: DataFrame, levels: int) -> DataFrame:
    """segments with leaves and below: the childless nodes under each, and the tokens saved under its last node."""
    out, under = [], None
    for level in reversed(range(levels)):
        each = segments.where(F.col("level") == level)
        if under is None:
            each = each.withColumns({"_l": F.lit(0).cast("long"), "_s": F.lit(0).cast("long")})
        else:
            sums = under.groupBy(F.col("up_class").alias("class"), F.col("up_start").alias("start")).agg(F.sum("leaves").alias("_l"), F.sum(F.col("below") + F.col("own")).alias("_s"))
            each = each.join(sums, ["class", "start"], "left")
        leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("singles") + F.coalesce("_l", F.lit(0)))
        under = stored(each.withColumns({"leaves": leaves, "below": F.coalesce("_s", F.lit(0))}).drop("_l", "_s"))
        out.append(under)
    return reduce(DataFrame.unionByName, out)


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, start, ends_sha256) of rows (class, start, ids) that come in order: one chunk in memory at a time."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, s, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k, s) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (k, s), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["class", "start", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(class, start, ends_sha256) of (class, start, conv_id) rows."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")  # CHUNK ids at most
    chunks = ends.groupBy("class", "start", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids)
    return chunks.repartition("class", "start").sortWithinPartitions("class", "start", "chunk").select("class", "start", "ids").mapInArrow(_digest_chunks, "class long, start long, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """NODES of the trie of turns (conv_id, pos, key, words) with an end row each, as `rebuilt` and `ended` give them."""
    turns = stored(turns)
    lengths = turns.where("key is null").select("conv_id", (F.col("pos") - 1).alias("length"))
    first = lengths.agg(F.min("conv_id").alias("class"), F.count("*").alias("n"), F.sum("length").alias("mass")).first()
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    spark = turns.sparkSession
    if not first.n:
        return spark.createDataFrame([], kinds)
    sized = stored(_blocked(turns).join(_of_blocks(lengths), ["conv_id", "_b"]).drop("_b"))
    total = first.mass + first.n  # rows, the ends among them
    start = {"class": first["class"], "start": 0, "known": 0, "ahead": 1, "n": first.n, "mass": total, "level": 0}
    now = sized.withColumn("length", F.col("length") + 1).withColumns({k: F.lit(v).cast("long") for k, v in start.items()})
    runs, forks, ends, retired, links = [], [], [], [], []
    links.append(spark.createDataFrame([(start["class"], 0, 0, start["n"], None, None)], "class long, start long, level long, n long, up_class long, up_start long"))
    while True:
        before = now
        at, tagged, now = _split(now, total)
        runs.append(at.where("split is null or pos < split").select("class", "start", "pos", "n", "words"))
        fork = at.where("pos = split")
        forks.append(fork.groupBy("class", "start").agg(F.max("split").alias("split"), F.count("key").alias("n_children"), F.count_if(F.col("key").isNotNull() & (F.col("c") == 1)).alias("singles")))
        ends.append(stored(tagged.where("pos = split and key is null").select("class", "start", "conv_id")))
        removed(tagged, *([before] if len(runs) > 1 else []))
        retired.append(fork.where("key is not null and c = 1").select(F.col("least").alias("conv_id"), F.col("split").alias("since"), F.col("class").alias("above")))
        links.append(fork.where("key is not null and c > 1").select(F.col("least").alias("class"), F.col("split").alias("start"), (F.col("level") + 1).alias("level"), F.col("c").alias("n"), F.col("class").alias("up_class"), F.col("start").alias("up_start"), "words"))
        if now.isEmpty():
            break
    together = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    links = stored(together(links).withColumn("words", F.coalesce("words", F.lit(0))))
    forks = together(forks).where("split is not null")
    # the shared nodes: where a class starts, and the turns that it passed whole
    shared = links.select("class", "start", F.col("start").alias("pos"), "n", "words", F.col("up_class").alias("above"))
    shared = stored(shared.unionByName(together(runs).withColumn("above", F.col("class"))).withColumn("gain", (F.col("n") - 1) * F.col("words")))
    own = shared.groupBy("class", "start").agg(F.sum("gain").alias("own"), F.count("*").alias("steps"))
    levels = links.agg(F.max("level")).first()[0] + 1
    segments = _fold(stored(links.join(forks, ["class", "start"]).join(own, ["class", "start"]).select("class", "start", "level", "up_class", "up_start", "split", "n_children", "singles", "own", "steps")), levels)
    upto = running(shared, ["class", "start"], ["pos"], {"upto": F.col("gain")})
    about = segments.join(_ends(together(ends)), ["class", "start"], "left").select("class", "start", "split", "n_children", "leaves", "below", "own", F.col("ends_sha256").alias("ended"), "steps")
    told = joined(upto, about, ["class", "start"], "steps", shared.count())
    is_last = F.col("pos") == F.col("split") - 1
    shared = told.select(
        F.col("class").alias("conv_id"), F.col("pos").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(is_last, F.col("n_children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("own") - F.col("upto") + F.col("gain") + F.col("below")).alias("saved_tokens"), F.when(is_last, F.coalesce("ended", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
    # the chains of those that are alone
    alone = together(retired).join(lengths, "conv_id")
    chain = _blocked(sized.where("key is not null").drop("length")).join(_of_blocks(alone), ["conv_id", "_b"]).where("pos >= since")
    last = F.col("pos") == F.col("length")
    chain = chain.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("since"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).alias("n_convs"), (~last).cast("int").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return shared.unionByName(chain).select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODES))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """NODES of the trie of rebuilt conversations."""
    return nodes(rebuilt(turns_of(conversations)))


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT))), lambda x, b: list_reduce(list_prepend(xor(x, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))"
ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
k AS (SELECT DISTINCT c, xor({_CRC}, 4294967295) % 4 AS h FROM t),
u AS (SELECT c, i, r, x FROM t JOIN k USING (c) WHERE i > h UNION ALL SELECT k.c, i - 10, r, x FROM k JOIN t ON t.c = k.c - k.c % 20 AND i <= h),
v AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM u),
p AS (SELECT c, d, x, sha256(string_agg(length(r) || ':' || length(x) || ':' || r || x, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS path FROM v UNION ALL SELECT c, 0, '', '' FROM k),
m AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS node, count(*) OVER (PARTITION BY d, path) AS n, max(d) OVER (PARTITION BY c) AS deepest FROM p),
o AS (SELECT node, d, min(n) AS n, min(x) AS x, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = deepest), '') AS ends FROM m GROUP BY node, d),
e AS (SELECT o.*, a.node AS above FROM o LEFT JOIN m a ON a.c = o.node AND a.d = o.d - 1),
f AS (SELECT node, d, (n - 1) * len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS gain, NOT EXISTS (SELECT 1 FROM e b WHERE b.above = e.node AND b.d = e.d + 1) AS leaf FROM e),
g AS (SELECT a.node, a.d, sum(gain) AS saved, count(*) FILTER (leaf) AS leaves FROM f JOIN m a ON a.c = f.node AND a.d <= f.d GROUP BY a.node, a.d)
SELECT e.node AS conv_id, e.d AS depth, e.above AS parent_conv_id, e.n AS n_convs, (SELECT count(*) FROM e b WHERE b.above = e.node AND b.d = e.d + 1) AS n_children, CAST(g.leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN g ON g.node = e.node AND g.d = e.d
"""
