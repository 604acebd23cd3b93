"""Near-duplicates of high similarity by odd sketches of MinHash samples, verified on full shingle sets.

A set's MinHash sample has ROWS * BANDS values. Every band of ROWS values is a posting key: sets that agree in a whole band
are candidates. The sample is also folded into an odd sketch: each (place, value) pair flips one bit of a bitmap, so
bits of equal values cancel in the XOR of two sketches, and its population count tells how many places of the samples
differ. The estimate is precise where sets are alike, so candidates more than SIGMAS standard errors under the threshold
are dropped unseen; all others are verified on their full sets.

Equal sets are folded into one first. Then two passes: each set first meets its most alike earlier partner, which joins groups of copies at the cost of
one verification a set; then, within postings that still hold several components, every remaining pair of
different components is verified, by the one posting that is the least the pair shares. Verification takes place
in cells: full sets are sent to a cell once, however many partners they have in it, and pairs already connected there are
skipped. Long postings are dealt out as a grid of cells of at most two chunks, in the second pass without those of one component alone. No pair is emitted; a cell emits a star for each component.

A link can only be lost where two samples agree in no band, 5.5e-11 of pairs at the threshold and fewer above it, or where
the estimate is off by SIGMAS standard errors (about 1e-8 at the threshold, fewer above).

Defined cases: a null, empty or wordless text has an empty set, which is linked with nothing; a text of fewer words than a
shingle is one shingle; a very long text is taken whole, in blocks of its shingles; a link at exactly the threshold counts;
repeated rows are rows of one set; rows with a null doc_id keep their row, never name a component unless all of it is null, and are then kept;
of repeated ids the components are those of their own texts; an empty table gives an empty result; further
input columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.simhash import components
from quillon.operators.scan import joined
from quillon.session import removed, shuffles_removed, stored

SEED = 42
WIDTH = 3
#: A link needs so many hundredths of the union in common.
THRESHOLD = 85
BANDS, ROWS = 40, 5
BITS = 512
SIGMAS = 6
#: Sets in one chunk of a long posting; a cell has at most two chunks.
CHUNK = 256
#: A set of more shingles than this counts as several in a chunk.
LONG = 4096
_BLOCK = 1 << 16
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    words = text.lower().split() if text else []  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, parts = xxhash.xxh64_intdigest, []
    for at in range(0, max(1, len(words) - width + 1), _BLOCK):
        some = words[at : at + _BLOCK + width - 1]
        grams = zip(*(some[i:] for i in range(width)), strict=False) if len(words) >= width else [some]
        parts.append(np.unique(np.array([digest(b" ".join(g), SEED) for g in grams], dtype=np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finishing hash of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sample(values: np.ndarray) -> np.ndarray:
    """The MinHash sample of a set: the least of its values under each of the permutations."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 512):
        some = values[at : at + 512, None]
        np.minimum(low, (some * _FACTORS[0] + _FACTORS[1]).min(axis=0), out=low)
    return low


def folded(low: np.ndarray) -> np.ndarray:
    """The odd sketch of a sample, as bytes: a bit is set where an odd number of (place, value) pairs fall on it."""
    spots = (_mixed(low * _PLACES) >> np.uint64(40)) % np.uint64(BITS)
    return np.packbits(np.bincount(spots.astype(np.int64), minlength=BITS) & 1)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of a sample, the band's number in it."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0xD1342543DE82EF95) + column)
    return key.view(np.int64)


def estimate(odd_bits: np.ndarray) -> np.ndarray:
    """The similarity of two sets by the odd bits of their sketches' XOR."""
    share = np.minimum(2 * odd_bits / BITS, 1 - 1e-9)
    return 1 + BITS / 2 * np.log1p(-share) / (2 * BANDS * ROWS)


def most_odd_bits(threshold: float = THRESHOLD / 100) -> int:
    """The odd bits up to which a pair stays a candidate: those expected at SIGMAS standard errors under the threshold."""
    places = BANDS * ROWS
    flips = lambda similarity: 2 * places * (1 - similarity)
    load = 4 * flips(threshold) / BITS
    folding = sqrt(BITS / 4 * (1 - exp(-load) * (1 + load))) / (2 * places * exp(-load / 2))  # of the odd bits of so many flips, as similarity
    spread = sqrt(threshold * (1 - threshold) / places + folding**2)
    return int(BITS / 2 * (1 - exp(-2 * flips(threshold - SIGMAS * spread) / BITS)))


ODD_BITS = most_odd_bits()
_SKETCHED = "doc_id {kind}, row long, n_shingles long, set binary, sketch binary, keys array<long>"


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, set, sketch, keys): of each row a hash of it, its set's size, digest, odd sketch and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, sketches, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                values = shingles(text.as_py())
                low = sample(values) if len(values) else None
                sizes.append(len(values))
                sets.append(_digest(values) if len(values) else None)
                sketches.append(folded(low).tobytes() if len(values) else None)
                keys.append(band_keys(low) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "set", "sketch", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, _SKETCHED.format(kind=kind))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return slim.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set, values): the full sets of the wanted (set, row), read from the rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, values = [], []
            for text, ident in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                found = shingles(text.as_py())
                if _digest(found) == ident.as_py():  # else another row with the same hash
                    sets.append(ident.as_py())
                    values.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(values, pa.list_(pa.int64()))], names=["set", "values"])

    texts = _rows(docs, id_col, text_col).join(wanted, "row").withColumn("_again", F.xxhash64(F.lit(1), "doc_id", "text")).dropDuplicates(["row", "set", "_again"])
    return texts.select("text", "set").mapInArrow(run, "set binary, values array<long>")


def _matrix(sketches: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint64).reshape(len(sketches), BITS // 64)


def _odd_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(left), len(right)), dtype=np.uint16)
    for k in range(left.shape[1]):
        out += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return out


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can be linked at all."""
    return 100 * np.minimum.outer(n, m) >= THRESHOLD * np.maximum.outer(n, m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _members(lists: pa.ListArray):
    """(start, end, fields) of the lists of structs of a column."""
    flat = lists.flatten()
    ends = lists.offsets.to_numpy()
    return ends[:-1] - ends[0], ends[1:] - ends[0], {f.name: flat.field(i) for i, f in enumerate(flat.type)}


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, partner, odd): each member that has a candidate in its cell, with the most alike one of the lesser sets, if any."""
    for batch in batches:
        sets, partners, odds = [], [], []
        lefts, rights = _members(batch.column(0)), _members(batch.column(1))
        for k in range(batch.num_rows):
            a0, a1, b0, b1 = lefts[0][k], lefts[1][k], rights[0][k], rights[1][k]
            take = lambda side, x, y: {name: column.slice(x, y - x) for name, column in side[2].items()}
            parts = [take(lefts, a0, a1)] + ([take(rights, b0, b1)] if b1 > b0 else [])
            names = [np.array(p["set"].to_pylist(), dtype="S16") for p in parts]
            sizes = [p["n_shingles"].to_numpy() for p in parts]
            bits = [_matrix(p["sketch"]) for p in parts]
            odd = _odd_bits(bits[0], bits[-1]).astype(np.int64)
            odd[~_near(sizes[0], sizes[-1])] = BITS
            if len(parts) == 1:
                np.fill_diagonal(odd, BITS)
            views = [(names[0], names[-1], odd)] + ([(names[-1], names[0], odd.T)] if len(parts) == 2 else [])
            for mine, theirs, table in views:
                close = table <= ODD_BITS
                held = np.flatnonzero(close.any(axis=1))
                lesser = np.where(close & (theirs[None, :] < mine[:, None]), table, BITS + 1)
                best = lesser.argmin(axis=1)
                for i in held:
                    found = lesser[i, best[i]] <= ODD_BITS
                    sets.append(mine[i].ljust(16, b"\0"))  # numpy strips zeros at the end
                    partners.append(theirs[best[i]].ljust(16, b"\0") if found else None)
                    odds.append(int(lesser[i, best[i]]))
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(partners, pa.binary()), pa.array(odds, pa.int64())], names=["set", "partner", "odd"])


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, set, component): the members of a cell that have a candidate of another component there whose least shared posting is the cell's."""
    for batch in batches:
        cells, sets, comps = [], [], []
        lefts, rights = _members(batch.column(2)), _members(batch.column(3))
        for k, (cell, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            sides = []
            for side in (lefts, rights) if rights[1][k] > rights[0][k] else (lefts,):
                part = {name: column.slice(side[0][k], side[1][k] - side[0][k]) for name, column in side[2].items()}
                keys = part["keys"].flatten().to_numpy().reshape(-1, BANDS)
                sides.append((part["set"].to_pylist(), part["component"].to_pylist(), part["n_shingles"].to_numpy(), _matrix(part["sketch"]), keys))
            one, two = sides[0], sides[-1]
            open_ = (_odd_bits(one[3], two[3]) <= ODD_BITS) & _near(one[2], two[2])
            names = [np.array(s[1], dtype="S16") for s in (one, two)]
            open_ &= names[0][:, None] != names[1][None, :]
            x, y = np.nonzero(open_)
            least = np.where(one[4][x] == two[4][y], one[4][x], np.iinfo(np.int64).max).min(axis=1) if len(x) else np.zeros(0, np.int64)
            own = least == key
            held = [np.unique(x[own]), np.unique(y[own])]
            chosen = {(0, int(i)) for i in held[0]} | {(0 if len(sides) == 1 else 1, int(i)) for i in held[1]}
            for s, i in sorted(chosen):
                cells.append(cell)
                sets.append(sides[s][0][i])
                comps.append(sides[s][1][i])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(sets, pa.binary()), pa.array(comps, pa.binary())], names=["cell", "set", "component"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) with u > v: what the links of a cell's members connect that was not connected yet, as stars."""
    for batch in batches:
        us, vs = [], []
        starts, ends, fields = _members(batch.column(0))
        for x, y in zip(starts, ends, strict=True):
            part = {name: column.slice(x, y - x) for name, column in fields.items()}
            sets, comps = part["set"].to_pylist(), part["component"].to_pylist()
            if len(sets) < 2:
                continue
            values = part["values"]
            edges = values.offsets.to_numpy()
            flat = values.flatten().to_numpy().view(np.uint64)
            full = [flat[edges[i] - edges[0] : edges[i + 1] - edges[0]] for i in range(len(sets))]
            sizes = np.array([len(f) for f in full])
            bits = _matrix(part["sketch"])
            odd = _odd_bits(bits, bits)
            i, j = np.nonzero(np.triu((odd <= ODD_BITS) & _near(sizes, sizes), 1))
            root = list(range(len(sets)))

            def find(k: int) -> int:
                while root[k] != k:  # noqa: B023
                    root[k] = root[root[k]]  # noqa: B023
                    k = root[k]
                return k

            first = {}
            for k, c in enumerate(comps):
                root[k] = find(first.setdefault(c, k))
            for k in np.argsort(odd[i, j], kind="stable"):
                a, b = find(int(i[k])), find(int(j[k]))
                if a != b and linked(full[i[k]], full[j[k]]):
                    root[max(a, b)] = min(a, b)
                    u, v = sets[i[k]], sets[j[k]]
                    us.append(max(u, v))
                    vs.append(min(u, v))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])


def _cells(posts: DataFrame, fields: list[str]) -> DataFrame:
    """(key, i, j, left, right): postings (key, n and fields) dealt into cells, in which any two members meet: both in left or one in each."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    member = F.struct(*fields)
    low, high = F.least("_c", "_j"), F.greatest("_c", "_j")
    return (
        posts.withColumn("_g", chunks).withColumn("_c", F.pmod(F.xxhash64("set"), F.col("_g")).cast("int"))
        .select("key", *fields, "_c", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_j"))
        .groupBy("key", low.alias("i"), high.alias("j"))
        .agg(F.collect_list(F.when(F.col("_c") == low, member)).alias("left"), F.collect_list(F.when(F.col("_c") > low, member)).alias("right"))
        .where((F.size("left") > 0) & (F.size("right") > 0) | (F.col("i") == F.col("j")) & (F.size("left") > 1))
    )


def _load() -> Column:
    """The members of a group, long sets counted by their length: CHUNK of them fit in a task."""
    return F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / LONG))


def _mixed_cells(posts: DataFrame, fields: list[str]) -> DataFrame:
    """(key, cell, left, right): postings (key, main, n_main, n_rest and fields, component among them) dealt into cells, in which any two members of different components meet.

    The members of a posting's main component are not dealt against one another, so where a large group is connected already, each goes out once for each chunk of the others.
    """
    member = F.struct(*fields)
    parts, others = (F.ceil(F.col(n) / CHUNK).cast("int") for n in ("n_main", "n_rest"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda main, i, j, first: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), first.alias("first"))
    c = F.col("_c")
    of_main = F.transform(upto(others), lambda j: at(True, c, j, F.lit(True)))
    of_rest = F.concat(F.transform(upto(parts), lambda i: at(True, i, c, F.lit(False))), F.transform(upto(others), lambda j: at(False, F.least(c, j), F.greatest(c, j), c <= j)))
    in_main = F.col("component") == F.col("main")
    dealt = posts.withColumn("_c", F.pmod(F.xxhash64("set"), F.when(in_main, parts).otherwise(others)).cast("int"))
    return (
        dealt.select("key", *fields, F.explode(F.when(in_main, of_main).otherwise(of_rest)).alias("_at"))
        .groupBy("key", "_at.main", "_at.i", "_at.j")
        .agg(F.collect_list(F.when(F.col("_at.first"), member)).alias("left"), F.collect_list(F.when(~F.col("_at.first"), member)).alias("right"))
        .where((F.size("left") > 0) & (F.size("right") > 0) | ~F.col("main") & (F.col("i") == F.col("j")) & (F.size("left") > 1))
        .select("key", F.concat_ws("/", F.hex("key"), F.col("main").cast("string"), "i", "j").alias("cell"), "left", "right")
    )


def _verify(members: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """(u, v) that the links within each cell connect. members: cell, set, component."""
    told = members.join(full, "set").join(sets.select("set", "sketch"), "set")
    whole = told.groupBy("cell").agg(F.collect_list(F.struct("set", "component", "sketch", "values")).alias("members"))  # two chunks at most
    return whole.select("members").mapInArrow(_verified, "u binary, v binary")


def labels(docs: DataFrame, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(set, component) of the sets that are linked: the least set that each is linked to over any number of links."""
    slim = sets.select("set", "n_shingles", "sketch")
    posts = sets.select("set", F.explode("keys").alias("key"))
    sized = posts.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("_weight")).where("n > 1")
    posts = stored(joined(posts, sized, ["key"], "_weight", BANDS * sets.count()))
    cells = _cells(posts.join(slim, "set"), ["set", "n_shingles", "sketch"])
    met = cells.select("left", "right").mapInArrow(_partners, "set binary, partner binary, odd long")
    best = stored(met.groupBy("set").agg(F.min_by("partner", F.struct("odd", "partner")).alias("partner")))
    full = stored(full_sets(docs, best.select("set").join(sets.select("set", "row"), "set"), id_col, text_col))

    # each set meets its most alike lesser one; a partner of very many is met in several cells
    picked = best.where("partner is not null").join(sets.select("set", "n_shingles"), "set")
    cell = F.concat_ws("/", F.hex("partner"), F.pmod(F.xxhash64("set"), F.ceil(F.col("n") / CHUNK)).cast("string"))
    many = picked.groupBy("partner").agg(_load().alias("n"), F.count("*").alias("_weight"))
    in_cells = joined(picked, many, ["partner"], "_weight", picked.count()).withColumn("cell", cell).select("cell", "set", "partner")
    members = in_cells.select("cell", "set").unionByName(in_cells.select("cell", F.col("partner").alias("set")).distinct())
    first = stored(_verify(members.withColumn("component", F.col("set")), sets, full).distinct())
    roots = components(first).select(F.col("u").alias("set"), "root")

    # what is left: candidates of different components in one posting
    state = stored(best.select("set").join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("component")).join(sets.select("set", "n_shingles", "sketch", "keys"), "set"))
    left = posts.drop("n").join(state.select("set", "component", "n_shingles"), "set")
    each = left.groupBy("key", "component").agg(_load().alias("_n"), F.count("*").alias("_weight"))
    mixed = each.groupBy("key").agg(F.max_by("component", F.struct("_n", "component")).alias("main"), F.max("_n").alias("n_main"), (F.sum("_n") - F.max("_n")).alias("n_rest"), F.sum("_weight").alias("_weight")).where("n_rest > 0")
    again = joined(left.select("key", "set"), mixed, ["key"], "_weight", posts.count()).join(state, "set")
    cells = _mixed_cells(again, ["set", "component", "n_shingles", "sketch", "keys"]).select("cell", "key", "left", "right")
    open_ = cells.mapInArrow(_open_members, "cell string, set binary, component binary")
    second = _verify(open_, sets, full).distinct()
    roots = components(first.unionByName(second).distinct())
    return stored(roots.select(F.col("u").alias("set"), F.col("root").alias("component")).unionByName(roots.select(F.col("root").alias("set"), F.col("root").alias("component")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs; kept of each component is the row that names it."""
    with shuffles_removed(docs.sparkSession):  # else the files of all rounds of both passes stand side by side
        return _near_duplicates(docs, id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = stored(sketched(docs, id_col, text_col))
    one = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    sets = stored(one)
    total = rows.count()
    named = sets.select("set", "rep", "n").join(labels(docs, sets, id_col, text_col), "set", "left")
    named = named.select("set", "rep", "n", F.coalesce("component", "set").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_sets"))
    label = stored(joined(named, least, ["component"], "_sets", sets.count()).select("set", "component_id", F.col("n").alias("_rows")))
    removed(sets)
    met = joined(rows.where("set is not null").select("doc_id", "n_shingles", "set"), label, ["set"], "_rows", total).select("doc_id", "n_shingles", "component_id")
    out = met.unionByName(rows.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_LETTERS = "".join(chr(c) for c in range(65, 91))
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {THRESHOLD} * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
