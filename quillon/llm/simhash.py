"""SimHash near-duplicate detection by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most three bits differ in at most three
bytes, so they share at least five of eight positional bytes, and at least three of the four bytes in one
half. A posting list of one positional byte would hold 1/256 of a corpus, so the index keeps their
intersections: the positional *triples* of each half (eight postings of 24 bits), which lose no such pair.
Within a posting the shared positional bytes of every pair are tallied; pairs that reach the guaranteed minimum
of five are retained, and only they are verified by their differing bits.

A pair may meet in several postings; the one of the least triple that it shares owns it, so each link is found
and counted once. A hot posting (a dense group of near copies) is posted again under its triple and two further
positions, which loses no pair either, as five bytes are shared; what is still longer than a cell is dealt out as
a grid of bounded cells. How postings are dealt changes no result. Each cell emits a star for each component of
its links and a count for each fingerprint, so no group is expanded into all of its pairs.

Defined cases: a null, empty or wordless text has the fingerprint zero; a very long text is hashed whole, block by
block of its shingles; bits that are set in exactly half of the hashes are 0; repeated rows give repeated rows; rows
with a null doc_id keep their row and never name a component unless all of it is null; of repeated ids the
components are those of their own texts; an empty table gives an empty result; further input columns, whatever
their names, are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import row_hash, shielded
from quillon.session import cut

SEED = 42
MAX_BITS = 3
MIN_SHARED_BYTES = 5
#: Positions of the indexed triples, within each half of the fingerprint.
TRIPLES = [(a, b, c) for half in (0, 4) for a, b, c in ((half, half + 1, half + 2), (half, half + 1, half + 3), (half, half + 2, half + 3), (half + 1, half + 2, half + 3))]
#: Fingerprints in one chunk of a hot posting; a cell compares at most two chunks.
CHUNK = 384
#: From so many fingerprints on, a grid repeats each more often than the ten finer postings do.
FINE = 10 * CHUNK
#: Fingerprints that more than one in so many rows share are joined apart.
HOT = 1024
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one whole text, as an unsigned integer."""
    words = text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)), strict=False)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), _BLOCK):
        h = np.array([digest(g, SEED) for g in grams[at : at + _BLOCK]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp): fp is the fingerprint's bits as a signed long; row: a long to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in batch.column(2).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "row", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    carried = F.lit(0).cast("long") if row is None else row
    return docs.select(F.col(id_col).alias("doc_id"), carried.alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, row long, fp long")


def _finer(k: int) -> list[tuple[int, ...]]:
    """Triple k with each two of the five other positions."""
    return [(*TRIPLES[k], *two) for two in combinations(sorted(set(range(8)) - set(TRIPLES[k])), 2)]


def _retained() -> np.ndarray:
    """Whether a posting retains a pair, by the posting's number and the mask of the positional bytes that the pair shares.

    Postings of triple k have the number k, finer ones 8 + 10 * k and on. A pair is retained where it shares enough
    bytes, by the one posting that owns it: of its least triple, and for finer ones of the least of these.
    """
    out = np.zeros((8 + 10 * len(TRIPLES), 256), dtype=bool)
    for mask in range(256):
        if mask.bit_count() < MIN_SHARED_BYTES:
            continue
        covers = lambda at: all(mask >> i & 1 for i in at)  # noqa: E731, B023
        k = next(k for k, at in enumerate(TRIPLES) if covers(at))
        out[k, mask] = True
        out[8 + 10 * k + next(j for j, at in enumerate(_finer(k)) if covers(at)), mask] = True
    return out


RETAINED = _retained()


def _octets(prints: np.ndarray) -> np.ndarray:
    return prints.view(np.uint8).reshape(-1, 8)


def links_within(left: np.ndarray, right: np.ndarray | None, posting: int) -> tuple[np.ndarray, np.ndarray]:
    """The links that a posting owns, as places in left and right, or both in left (the smaller first) without right."""
    a, b = _octets(left), _octets(left if right is None else right)
    shared = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(8):
        shared |= (a[:, None, i] == b[None, :, i]).view(np.uint8) << i
    x, y = np.nonzero(RETAINED[posting][shared])
    if right is None:
        x, y = x[x < y], y[x < y]
    near = np.bitwise_count(left[x] ^ (left if right is None else right)[y]) <= MAX_BITS
    return x[near], y[near]


def _stars(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places the least place that it is linked to over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        least = root.copy()
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, n): edges with n = 0 that connect what a cell's links connect, and with v = u how many links u has in it."""
    for batch in batches:
        postings = batch.column(0).to_numpy()
        flat, starts, sizes = [], [], []
        for lists in (batch.column(1), batch.column(2)):
            flat.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            sizes.append(np.diff(lists.offsets.to_numpy()))
            starts.append(np.concatenate([[0], np.cumsum(sizes[-1])])[:-1])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> None:
            out.append((u, v, n))  # noqa: B023

        pairs = (sizes[0] == 2) & (sizes[1] == 0)
        a, b = flat[0][starts[0][pairs]], flat[0][starts[0][pairs] + 1]
        shared = np.packbits(_octets(a) == _octets(b), axis=1, bitorder="little")[:, 0] if len(a) else np.zeros(0, np.uint8)
        kept = RETAINED[postings[pairs], shared]
        a, b = a[kept], b[kept]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        a, b = a[near], b[near]
        one = np.ones(len(a), dtype=np.int64)
        add(a, b, 0 * one)
        add(a, a, one)
        add(b, b, one)
        for k in np.flatnonzero(~pairs):
            left = flat[0][starts[0][k] : starts[0][k] + sizes[0][k]]
            right = flat[1][starts[1][k] : starts[1][k] + sizes[1][k]] if sizes[1][k] else None
            x, y = links_within(left, right, postings[k])
            if not len(x):
                continue
            both = left if right is None else np.concatenate([left, right])
            y = y if right is None else y + len(left)
            root = _stars(len(both), x, y)
            hung = np.flatnonzero(root != np.arange(len(both)))
            add(both[hung], both[root[hung]], np.zeros(len(hung), np.int64))
            n = np.bincount(np.concatenate([x, y]), minlength=len(both))
            held = np.flatnonzero(n)
            add(both[held], both[held], n[held])
        u, v, n = (np.concatenate(c) for c in zip(*out, strict=True))
        u, v = u.view(np.int64), v.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(n.astype(np.int64))], names=["u", "v", "n"])


def _keys(positions: Sequence[tuple[int, ...]], first: int = 0) -> Column:
    """The posting keys of fp under the given sets of byte positions, numbered from first on."""

    def key(k: int, at: tuple[int, ...]) -> Column:
        out = F.lit(k << 8 * len(at)).cast("long")
        for j, i in enumerate(at):
            out += F.shiftleft(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long")), 8 * j)
        return out

    return F.array(*(key(first + k, at) for k, at in enumerate(positions)))


def _sized(posts: DataFrame) -> DataFrame:
    """(key, posting, fp, n) of the postings with n > 1 fingerprints."""
    return posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def _dealt(posts: DataFrame) -> DataFrame:
    """(posting, left, right): the cells of the postings. Two fingerprints of a posting meet in one cell, both in left or one in each."""
    return (
        posts.withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .select("key", "posting", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j"))
        .groupBy("key", "posting", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("k"))
        .agg(F.collect_list(F.when(F.col("c") == F.least("c", "j"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("c") > F.least("c", "j"), F.col("fp"))).alias("right"))
        .where((F.size("left") > 0) & (F.size("right") > 0) | (F.col("i") == F.col("k")) & (F.size("left") > 1))
        .select("posting", "left", "right")
    )


def links(prints: DataFrame, fine: int = FINE) -> DataFrame:
    """(u, v, n) of `_cells` over all fingerprints within MAX_BITS of one another. prints: distinct fp.

    Postings of more than fine fingerprints are posted again under finer keys, which changes their cells, not their links.
    """
    posts = _sized(prints.select("fp", F.explode(_keys(TRIPLES)).alias("key"))).withColumn("posting", F.shiftright("key", 24).cast("int"))
    finer = F.coalesce(*(F.when(F.col("posting") == k, _keys(_finer(k), 10 * k)) for k in range(len(TRIPLES))))
    hot = posts.where(F.col("n") > fine).select("fp", F.explode(finer).alias("key"))
    hot = _sized(hot).withColumn("posting", (8 + F.shiftright("key", 40)).cast("int"))
    cells = _dealt(posts.where(F.col("n") <= fine)).unionByName(_dealt(hot))
    return cells.mapInArrow(_cells, "u long, v long, n long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root): for every node that isn't its component's least, that least node. edges: (u, v), u > v.

    Alternates large-star and small-star steps; each step is a keyed minimum and a join, so a node with very
    many neighbours is met by partial aggregation and by skew-join splitting, and no neighbour list is built.
    """
    now = cut(edges)
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _labels(prints: DataFrame) -> DataFrame:
    """(fp, component, n_links) of the linked ones: the least fp that fp is linked to over any number of links, and how many fp it is linked to itself."""
    found = cut(links(prints.select("fp")))
    degree = found.where("n > 0").groupBy(F.col("u").alias("fp")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("n = 0").select("u", "v").distinct())
    member = roots.select(F.col("u").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    return cut(member.join(degree, "fp")).select("fp", F.col("root").alias("component"), "n_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per row of docs.

    n_links counts the other fingerprints within MAX_BITS of the row's own. Fingerprints that HOT-th parts of all rows
    share are fewer than HOT, so their labels are sent to the rows; the rows of all others are joined by fingerprint.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width).drop("row"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    total = prints.agg(F.sum("n")).first()[0] or 0
    linked = _labels(prints).join(prints.select("fp", "rep"), "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id", "n_links")
    label = prints.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    label = cut(label)
    hot = label.where(F.col("n") * HOT > total).select("fp", F.struct("component_id", "n_links").alias("hot"))
    met = rows.join(F.broadcast(hot), "fp", "left")
    rest = met.where("hot is null").drop("hot").join(label.where(F.col("n") * HOT <= total).drop("n"), "fp")
    out = lambda df, c, n: df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col(c).alias("component_id"), F.col(n).alias("n_links"))
    return out(rest, "component_id", "n_links").unionByName(out(met.where("hot is not null"), "hot.component_id", "hot.n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the least id stays (a null id last).

    Rows are told apart by two hashes of all their columns, so repeated rows and repeated ids are settled too. Of rows
    with one id, that with the least hash stays. The hashes are the one key that whole rows are shuffled by.
    """
    inner, name = shielded(docs)
    ident, text = name[id_col], name[text_col]
    first, second = row_hash(inner), row_hash(inner, 1)
    rows = cut(fingerprints(inner.withColumn("row", first), ident, text, width, row=F.col("row")))
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    prints = cut(rows.groupBy("fp").agg(stays))
    label = prints.join(_labels(prints), "fp", "left").select(F.coalesce("component", "fp").alias("component"), "first")
    stay = label.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = inner.withColumns({"row": first, "again": second}).join(stay, "row", "left_semi")
    return kept.dropDuplicates(["row", "again"]).select(*inner.columns).toDF(*docs.columns)
