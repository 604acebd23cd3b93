"""Quality score by a byte-level convolutional network in numpy.

Every byte window of WIDTH bytes is answered by FILTERS learned filters (one weight per position and byte
value). A document is covered by chunks of 2 * HOP window positions that overlap by half; each filter is
max-pooled in each chunk, and the pooled responses are combined over all chunks of the whole document by their
mean and their maximum into one logistic probability. Training back-propagates through the same pools.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, from a sample of at most
TRAIN_ROWS labelled ids, of each its whole text; scores see the text alone.

Defined cases: null and empty texts are one chunk of padding and get a score like any other; very long texts are
learned and scored whole, in slabs of bounded memory; a null doc_id is held out; a doc_id labelled more than once is
learned with its mean label, one with more than one text with the least of them; chunks that tie for a document's maximum
share its slope; with no usable label every score is 0.5; an empty table gives an empty result; repeated rows give repeated
rows; further columns, whatever their names, are ignored by `classify` and kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.columns import shielded

WIDTH, FILTERS, HOP = 6, 24, 128
#: Bound of the labelled sample that a fit reads, and of its passes over it.
TRAIN_ROWS, EPOCHS, BATCH, RATE = 1600, 8, 48, 0.02
THRESHOLD = 0.3
#: Label 0 is the rarer one and the decision point is low, so its rows weigh more in the fit.
LOW_WEIGHT = 4.0
_SLAB = 512  # HOP-sized blocks answered at a time


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: of the chunks' mean, of their maximum
    prior: float


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each padded with zeros to whole blocks, and the number of blocks of each.

    The padding starts before the text, so that the last windows of the text before it see zeros alone.
    """
    blocks = np.array([max(1, -(-(len(t) + WIDTH - 1) // HOP)) for t in texts], dtype=np.int64)
    data = np.zeros(int(blocks.sum()) * HOP + WIDTH, dtype=np.uint8)
    at = 0
    for t, n in zip(texts, blocks, strict=True):
        data[at + WIDTH - 1 : at + WIDTH - 1 + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += int(n) * HOP
    return data, blocks


def _answers(net: Network, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Filter responses at the positions of blocks first to last: blocks x HOP x FILTERS."""
    lo, hi = first * HOP, last * HOP
    total = net.tables[0].take(data[lo:hi], axis=0)
    for k in range(1, WIDTH):
        total += net.tables[k].take(data[lo + k : hi + k], axis=0)
    return total.reshape(last - first, HOP, FILTERS)


def _spans(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every chunk its first and second block (the same one in a document of one block); chunks and first chunk of each document."""
    chunks = np.maximum(blocks - 1, 1)
    starts = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    within = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    a = np.repeat(starts, chunks) + within
    return a, a + (np.repeat(blocks, chunks) > 1), chunks, first


def _combined(net: Network, peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    a, b, chunks, first = _spans(blocks)
    pooled = np.maximum(np.maximum(peaks[a], peaks[b]) + net.bias, 0)
    mean = np.add.reduceat(pooled, first, axis=0) / chunks[:, None]
    most = np.maximum.reduceat(pooled, first, axis=0)
    logit = np.concatenate([mean, most], axis=1) @ net.out + net.prior
    return a, b, chunks, first, pooled, mean, most, 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each whole text; memory stays bounded by one slab."""
    data, blocks = _laid(texts)
    n = int(blocks.sum())
    peaks = np.concatenate([_answers(net, data, at, min(at + _SLAB, n)).max(axis=1) for at in range(0, n, _SLAB)])
    return _combined(net, peaks, blocks)[-1]


def gradient(net: Network, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
    """The slopes of the weighted log loss over texts, by what they are of: through the combination, the pools and the filters."""
    data, blocks = _laid(texts)
    n = int(blocks.sum())
    where, peaks = [], []
    for at in range(0, n, _SLAB):
        r = _answers(net, data, at, min(at + _SLAB, n))
        best = r.argmax(axis=1)
        where.append(best)
        peaks.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0])
    where, peaks = np.concatenate(where), np.concatenate(peaks)
    a, b, chunks, first, pooled, mean, most, p = _combined(net, peaks, blocks)
    weigh = LOW_WEIGHT + (1 - LOW_WEIGHT) * labels
    slope = (weigh * (p - labels) / weigh.sum()).astype(net.tables.dtype)
    each = np.repeat(slope, chunks)[:, None]
    g = each * net.out[:FILTERS] / np.repeat(chunks, chunks)[:, None]
    top = pooled == np.repeat(most, chunks, axis=0)  # chunks that overlap may share the place of the maximum
    g += top * each * net.out[FILTERS:] / np.repeat(np.add.reduceat(top, first, axis=0, dtype=np.int64), chunks, axis=0)
    g *= pooled > 0
    block = np.where(peaks[a] >= peaks[b], a[:, None], b[:, None])
    position = block * HOP + where[block, np.arange(FILTERS)]
    column = np.broadcast_to(np.arange(FILTERS), position.shape)
    tables = [np.bincount((data[position + j].astype(np.int64) * FILTERS + column).ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)]
    return {"tables": np.stack(tables), "bias": g.sum(axis=0), "out": np.concatenate([mean, most], axis=1).T @ slope, "prior": np.array([slope.sum()])}


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """A network for the given labelled texts; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), float(np.log(share / (1 - share))))
    if not len(texts):
        net.out[:] = 0
        return net
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("tables", net.tables), ("bias", net.bias), ("out", net.out), ("prior", np.zeros(1)))}
    step, batches = 0, -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(batches):
            pick = order[k * BATCH : (k + 1) * BATCH]
            grad = gradient(net, [texts[i] for i in pick], labels[pick])
            step += 1
            rate = RATE * (1 - 0.9 * step / (EPOCHS * batches))
            for name, x in (("tables", net.tables), ("bias", net.bias), ("out", net.out)):
                x -= _adam(moments[name], grad[name] + 1e-5 * x, step, rate)
            net.prior -= float(_adam(moments["prior"], grad["prior"], step, rate)[0])
    return net


def _adam(moment: list[np.ndarray], grad: np.ndarray, step: int, rate: float) -> np.ndarray:
    moment[0] = 0.9 * moment[0] + 0.1 * grad
    moment[1] = 0.999 * moment[1] + 0.001 * grad * grad
    return (rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Network:
    """Fit on the whole texts of at most rows labelled ids that aren't held out, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
    picked = usable.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = sampled(docs, picked, id_col, text_col)
    return fit([t for _, t, _ in found], np.array([y for _, _, y in found], dtype=np.float32))


def sampled(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> list[tuple[object, bytes, float]]:
    """(doc_id, whole text, label) of the picked (doc_id, label) rows, in the order of ids; of an id's texts the least."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sample = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(picked), "doc_id")
    rows = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # a row for each picked id at most
    return sorted((r.doc_id, bytes(r.text), float(r.label)) for r in rows)


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """All columns of docs, and the score as the last one, named score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            out = np.empty(len(texts))
            begin = 0
            while begin < len(texts):  # groups of about 4 MB, so a batch of long texts needs no more memory
                end, held = begin, []
                size = 0
                while end < len(texts) and (not held or size < 1 << 22):
                    held.append(texts[end].as_py() or b"")
                    size += len(held[-1])
                    end += 1
                out[begin:end] = scores(net, held)
                begin = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*(f"c{i}" for i in range(batch.num_columns)), "score"])

    at = docs.columns.index(text_col)
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = named.mapInArrow(run, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", score double")
    return out.toDF(*docs.columns, "score")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    net = train(docs, labels, "quality", id_col, text_col)
    found = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier predicts as label 1, with the columns of docs."""
    net = train(docs, labels, "quality", id_col, text_col)
    inner, name = shielded(docs)
    scored = score(inner, net, name[text_col])
    return scored.where(F.col("score") >= THRESHOLD).select(*inner.columns).toDF(*docs.columns)
