"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Every model is linear over a vocabulary of words and word prefixes
chosen on the training rows, with the probabilities of the earlier categories as further features. In training
those probabilities are out-of-fold predictions, so a later model learns from what an earlier one really knows.

Where the labels only say toxic or not, finer categories come from the training rows themselves: the items that
mark toxic rows are parted into FAMILIES families by the rows that they occur in together, and a toxic row is of a
family's category if it holds a marker of it. A row can be of several, so each tells the chain something of its own.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, from at most PER_CLASS labelled ids of
each label, of each its whole text; rows are weighted back to the labels' shares.

Defined cases: null and empty texts have no features and get the models' base probability; very long texts are read
whole, in training and in scoring; a null doc_id is held out; a doc_id labelled more than once counts as toxic if any
label says so, one with more than one text is learned with the least of them; items that tie for the vocabulary's last
place are taken in the order of their letters; with no usable label every score is 0; an empty table gives an empty
result; repeated rows give repeated rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.quality_cnn import held_out, sampled

PER_CLASS = 2000
#: Vocabulary items, the least number of training rows that hold one, and the prefix lengths beside whole words.
ITEMS, LEAST_ROWS, PREFIXES = 400, 5, (4, 5, 6, 7)
FOLDS, STEPS, RATE, RIDGE = 5, 250, 0.05, 2e-4
FAMILIES = 3
CHAIN = (*(f"family_{k + 1}" for k in range(FAMILIES)), "toxic")
THRESHOLD = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")


def items(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


@dataclass
class Chain:
    vocabulary: dict[str, int]
    models: list[np.ndarray] = field(default_factory=list)  # weights of a model's features, then its base
    _seen: dict[str, list[int]] = field(default_factory=dict)

    def features(self, text: str) -> np.ndarray:
        """Of each vocabulary item: whether the text holds it, and how often per word."""
        n, v, seen = 0, len(self.vocabulary), self._seen
        counts = np.zeros(v)
        if len(seen) > 200_000:
            seen.clear()
        for word, times in Counter(_LETTERS.findall(text.lower())).items():
            n += times
            at = seen.get(word)
            if at is None:
                at = [self.vocabulary[i] for i in items(word) if i in self.vocabulary]
                if len(word) <= 64:
                    seen[word] = at
            for i in at:
                counts[i] += times
        return np.concatenate([counts > 0, np.log1p(100 * counts / max(n, 1))]).astype(np.float32)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories in order: rows x categories."""
        found = np.zeros((len(x), 0), dtype=np.float32)
        for w in self.models:
            found = np.column_stack([found, _probability(w, np.column_stack([x, found]))])
        return found

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_seen": {}}


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def _linear(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> np.ndarray:
    """A weighted logistic regression by full-batch steps."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    share = np.clip((weigh * y).sum() / weigh.sum(), 1e-4, 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    for t in range(1, STEPS + 1):
        slope = weigh * (_probability(w, x) - y) / weigh.sum()
        g = np.append(slope @ x + RIDGE * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def vocabulary(texts: list[str], y: np.ndarray) -> tuple[dict[str, int], set[str]]:
    """The ITEMS that best tell the labels apart, and those among them that mark label 1."""
    pos, neg = Counter(), Counter()
    for text, label in zip(texts, y, strict=True):
        (pos if label else neg).update({i for word in set(_LETTERS.findall(text.lower())) for i in items(word)})
    n_pos, n_neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    scored = []
    for item in pos.keys() | neg.keys():
        a, b = pos[item], neg[item]
        if a + b >= LEAST_ROWS:
            p, q, both = a / n_pos, b / n_neg, (a + b) / (n_pos + n_neg)
            scored.append((abs(p - q) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-9), item, p > q))
    best = sorted(scored, key=lambda s: (-s[0], s[1]))[:ITEMS]
    return {item: k for k, (_, item, _) in enumerate(best)}, {item for s, item, marks in best if marks and s > 5}


def fit_chain(texts: list[str], labels: dict[str, np.ndarray], vocab: dict[str, int], weigh: np.ndarray, folds: np.ndarray) -> Chain:
    """Models for the categories of labels, in their order. folds: the fold of each row."""
    chain = Chain(vocab)
    x = np.stack([chain.features(t) for t in texts])
    for y in labels.values():
        own = np.zeros(len(texts), dtype=np.float32)
        for fold in np.unique(folds):
            out = folds == fold
            if out.all():
                own[out] = np.average(y, weights=weigh)
            else:
                own[out] = _probability(_linear(x[~out], y[~out], weigh[~out]), x[out])
        chain.models.append(_linear(x, y, weigh))
        x = np.column_stack([x, own])
    return chain


def fit(rows: list[tuple[str, int]], shares: tuple[float, float] = (1.0, 1.0)) -> Chain:
    """The chain over CHAIN for (text, toxic) rows; shares: how many labelled rows a sampled one stands for, by label."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    if not len(rows) or y.min() == y.max():
        return Chain({}, [np.array([*[0.0] * k, 40.0 if len(rows) and y[0] else -40.0]) for k in range(len(CHAIN))])
    texts = [t for t, _ in rows]
    vocab, marks = vocabulary(texts, y)
    at = np.array([vocab[i] for i in sorted(marks)], dtype=np.int64)
    probe = Chain(vocab)
    holds = np.stack([probe.features(t)[: len(vocab)][at] for t in texts])
    family = families(holds[y == 1])
    labels = {name: y * holds[:, family == k].any(axis=1) for k, name in enumerate(CHAIN[:-1])}
    return fit_chain(texts, {**labels, "toxic": y}, vocab, np.where(y == 1, shares[1], shares[0]), np.arange(len(rows)) % FOLDS)


def families(holds: np.ndarray, k: int = FAMILIES, rounds: int = 20) -> np.ndarray:
    """The family of each marker (a column of rows x markers): k centres over the rows that hold it, by cosine.

    Starts from the marker that most rows hold and takes as each further centre the one least like those before.
    """
    x = holds.T / np.maximum(np.sqrt(holds.sum(axis=0)), 1e-9)[:, None]
    if len(x) <= k:
        return np.arange(len(x))
    centres = [x[int(holds.sum(axis=0).argmax())]]
    while len(centres) < k:
        centres.append(x[int(np.max([x @ c for c in centres], axis=0).argmin())])
    c = np.stack(centres)
    family = (x @ c.T).argmax(axis=1)
    for _ in range(rounds):
        c = np.stack([x[family == j].sum(axis=0) if (family == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]
        again = (x @ c.T).argmax(axis=1)
        if (again == family).all():
            break
        family = again
    return family


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Chain:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    part = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = part(1).unionByName(part(0))
    found = sorted(sampled(docs, picked, id_col, text_col), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    rows = [(text.decode("utf-8", "ignore"), int(label)) for _, text, label in found]
    taken = Counter(label for _, label in rows)
    return fit(rows, tuple(sizes.get(k, 0) / max(1, taken[k]) for k in (0, 1)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, p_ of each family, score, predicted) for every row of docs; score is the chain's last probability."""
    chain = train(docs, labels, "toxic", id_col, text_col)
    names = [*(f"p_{c}" for c in CHAIN[:-1]), "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                x = np.stack([chain.features(t.as_py() or "") for t in part.column(1)]) if part.num_rows else np.zeros((0, 2 * len(chain.vocabulary)), np.float32)
                p = chain.predict(x).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(len(CHAIN)))], names=["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names)]))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), *names, (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
