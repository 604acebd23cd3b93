"""Exact top-k inner-product search by block-at-a-time pruning.

Every component is an integer term weight. Rows are ordered by likeness: at most CLUSTERS centres, taken from the rows by
a hash, and each row goes to the centre that is most like it; a large cluster is cut into parts of bounded size, and in
a part rows are halved again and again along their widest component, so a block of BLOCK rows is a range of like rows.

A query's score with a block is bounded by the sum of its term maxima (each query weight with the block's greatest or,
where negative, least weight of that term). A query first searches its own part, which gives a kth score to beat; the
clusters' bounds, a table of at most CLUSTERS rows, then tell the clusters that may hold better ones, and only their parts
get the query. There blocks are opened in the order of their bounds, scored through the block's forward index, and the
rest is left once the next bound falls below the kth score. Ties may still win by their smaller id, so equal bounds are
opened. Queries travel in bounded groups; the k best of a part are merged per query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part;
rows with the same id are candidates each, and queries each with a ranking of its own, where only the query's own row
is left out; vectors of other lengths, very long ones too, are
compared over the components they share; scores that tie are ordered by the smaller id; an empty table gives an empty
result; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import cut

SCALE, K, EVERY = 256, 5, 50
#: Vectors of a part and queries of a group, on average; vectors in a block; clusters at most.
SEGMENT, GROUP, BLOCK, CLUSTERS = 8192, 2048, 64, 256
_EXACT = float(1 << 53)


def quantised(column: str = "embedding", scale: int = SCALE) -> Column:
    """array<double> of floor(scale * x); null where the vector takes no part."""
    x = F.transform(column, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    sound = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.col(column).isNotNull() & sound, x)


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact_scores(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    reach = np.abs(block).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query))
    if reach < _EXACT:
        return (block @ query).astype(np.int64)
    whole = [[int(x) for x in row] for row in block]
    q, low, high = [int(x) for x in query], -(1 << 63), (1 << 63) - 1
    return np.array([min(high, max(low, sum(a * b for a, b in zip(row, q, strict=True)))) for row in whole], dtype=np.int64)


def like_order(vectors: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Places of the rows, halved along their widest component until a range has at most size rows."""
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size or not vectors.shape[1]:
            out.append(rows)
            continue
        x = vectors[rows]
        rows = rows[np.argsort(x[:, int(np.argmax(x.max(axis=0) - x.min(axis=0)))], kind="stable")]
        half = -(-len(rows) // (2 * size)) * size
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Queries x blocks: the greatest score that a row between least and most can have."""
    out = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    return out + np.abs(out) * 1e-9  # beyond 2^53 the bound itself is rounded


def best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, block: int = BLOCK, keys: np.ndarray | None = None, query_keys: np.ndarray | None = None, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query key, id, score) of each query's k best that reach its floor, and how many blocks were opened.

    Keys tell rows apart, and a query leaves out the row of its own key; without them ids do, which are distinct then.
    """
    keys, query_keys = ids if keys is None else keys, query_ids if query_keys is None else query_keys
    width = min(vectors.shape[1], queries.shape[1])
    order = like_order(vectors[:, :width], block)
    ids, keys, vectors, queries = ids[order], keys[order], np.ascontiguousarray(vectors[order, :width]), np.ascontiguousarray(queries[:, :width])
    edges = np.arange(0, len(ids), block)
    bounds = _bounds(queries, np.maximum.reduceat(vectors, edges, axis=0), np.minimum.reduceat(vectors, edges, axis=0))
    order = np.argsort(-bounds, axis=1, kind="stable")
    out_q, out_i, out_s, opened = [], [], [], 0
    for q in range(len(query_ids)):
        found_i, found_s, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 2
        floor = -np.inf if floors is None else floors[q]
        while at < len(edges):
            take = order[q, at : at + step]
            least = max(floor, found_s[-1]) if len(found_s) >= k else floor
            take = take[bounds[q, take] >= least]
            if not len(take):
                break
            rows = (take[:, None] * block + np.arange(block)).ravel()
            rows = rows[rows < len(ids)]
            opened += len(take)
            rows = rows[keys[rows] != query_keys[q]]
            i, s = np.concatenate([found_i, ids[rows]]), np.concatenate([found_s, _exact_scores(vectors[rows], queries[q])])
            if len(s) > 4 * k:  # what can't be among the k best goes before the sort
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                i, s = i[keep], s[keep]
            pick = np.lexsort((i, -s))[:k]
            found_i, found_s = i[pick], s[pick]
            at, step = at + step, 2 * step
        keep = found_s >= floor
        out_q.append(np.full(int(keep.sum()), query_keys[q], dtype=np.int64))
        out_i.append(found_i[keep])
        out_s.append(found_s[keep])
    flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return flat(out_q), flat(out_i), flat(out_s), opened


def _by_id(pdf: pd.DataFrame, v: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["vec_id"].to_numpy(np.int64), _matrix(pdf[v]), pdf["row"].to_numpy(np.int64)


def _found(left: pd.DataFrame, right: pd.DataFrame, k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
    (ids, vectors, keys), (query_ids, queries, query_keys) = _by_id(left), _by_id(right)
    q, i, s, _ = best(ids, vectors, query_ids, queries, k, keys=keys, query_keys=query_keys, floors=floors)
    id_of = dict(zip(query_keys.tolist(), query_ids.tolist(), strict=True))
    return pd.DataFrame({"query_row": q, "query_id": np.array([id_of[x] for x in q.tolist()], dtype=np.int64), "vec_id": i, "score": s})


def _centres(rows: DataFrame, n: int) -> np.ndarray:
    """Vectors of n rows chosen by a hash, scaled to length 1: a bounded sample, to which every row is then dealt."""
    held = rows.orderBy(F.xxhash64("row"), "row").limit(n).select("v").collect()
    m = _matrix(pd.Series([r.v for r in held]))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def clustered(rows: DataFrame, n: int) -> DataFrame:
    """rows (row, vec_id, v) with cluster: the most like of n centres."""
    centres = _centres(rows, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"])
            width = min(x.shape[1], centres.shape[1])
            pdf["cluster"] = (x[:, :width] @ centres[:, :width].T).argmax(axis=1).astype(np.int32) if len(centres) else np.zeros(len(pdf), np.int32)
            yield pdf

    return rows.mapInPandas(run, "row long, vec_id long, v array<double>, cluster int")


def _spans(rows: DataFrame, width: int) -> DataFrame:
    """(cluster, most, least) of each cluster's first width components; rows are reduced where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for c, part in pdf.groupby("cluster"):
                x = np.stack([np.pad(np.asarray(v, float)[:width], (0, max(0, width - len(v)))) for v in part["v"]])
                hi, lo = x.max(axis=0), x.min(axis=0)
                if c in top:
                    hi, lo = np.maximum(hi, top[c][0]), np.minimum(lo, top[c][1])
                top[c] = hi, lo
        if top:
            yield pd.DataFrame({"cluster": list(top), "most": [hi.tolist() for hi, _ in top.values()], "least": [lo.tolist() for _, lo in top.values()]}).astype({"cluster": "int32"})

    parts = rows.select("cluster", "v").mapInPandas(run, "cluster int, most array<double>, least array<double>")
    each = parts.select("cluster", F.posexplode(F.arrays_zip("most", "least")).alias("i", "x")).groupBy("cluster", "i").agg(F.max("x.most").alias("hi"), F.min("x.least").alias("lo"))
    listed = F.array_sort(F.collect_list(F.struct("i", "hi", "lo")))
    return each.groupBy("cluster").agg(listed.alias("x")).select("cluster", F.col("x.hi").alias("most"), F.col("x.lo").alias("least"))


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row whose id is divisible by every, against all other rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v")).where("vec_id is not null and v is not null")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))  # written, so it stays the same; an id that many rows share is spread by it
    asked = F.col("vec_id") % every == 0
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    rows = cut(clustered(rows, min(CLUSTERS, -(-size.n // SEGMENT))))
    counts = {r.cluster: (r.n, r.q) for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).collect()}  # CLUSTERS rows at most
    parts = {c: -(-n // SEGMENT) for c, (n, _) in counts.items()}
    parts_of = F.element_at(F.from_json(F.lit(json.dumps(parts)), "map<string,int>"), F.col("cluster").cast("string"))
    deal = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    docs = rows.withColumn("part", deal(parts_of))
    out = "query_row long, query_id long, vec_id long, score long"

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return _found(pdf, pdf[pdf["vec_id"] % every == 0], k)

    # the kth score of a query in its own part, where that has so many rows
    near = docs.groupBy("cluster", "part").applyInPandas(own, out)
    floor = near.groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("least").cast("double")).alias("floor"))
    asks = cut(rows.where(asked).join(floor, "row", "left").select("row", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")))
    spans = {r.cluster: (np.array(r.most), np.array(r.least)) for r in _spans(rows, size.width or 0).collect()}  # CLUSTERS rows at most
    names = np.array(sorted(spans), dtype=np.int32)
    most, least = (np.stack([spans[c][i] for c in names.tolist()]) if len(names) else np.zeros((0, 0)) for i in (0, 1))
    shared = json.dumps(parts)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = {int(c): n for c, n in json.loads(shared).items()}
        for pdf in batches:
            x = _matrix(pdf["v"])
            width = min(x.shape[1], most.shape[1])
            q, c = np.nonzero(_bounds(x[:, :width], most[:, :width], least[:, :width]) >= pdf["floor"].to_numpy()[:, None])
            n = np.array([many[int(i)] for i in names[c]], dtype=np.int64)
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"row": np.repeat(pdf["row"].to_numpy()[q], n), "cluster": np.repeat(names[c], n), "part": part.astype(np.int32)})

    cells = cut(asks.mapInPandas(reach, "row long, cluster int, part int"))  # which query goes to which part
    groups = cells.groupBy("cluster", "part").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    sent = cells.join(groups, ["cluster", "part"]).withColumn("group", F.pmod(F.xxhash64("row"), "groups").cast("int")).join(asks, "row")
    sent = sent.toDF(*sent.columns).groupBy("cluster", "part", "group")  # other columns than those of kept, which stem from the same rows
    kept = docs.join(groups, ["cluster", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).groupBy("cluster", "part", "group")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _found(left, right, k, right["floor"].to_numpy())

    found = cut(kept.cogroup(sent).applyInPandas(cell, out))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
