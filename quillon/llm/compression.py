"""Quality rules with compression bands.

Beside the base counts, a document's zstandard ratio (bytes before to bytes after) is taken over the whole text and
over fixed chunks of it. Chunks have CHUNK bytes, the last one takes what is left too, so every byte is judged. Text
that repeats itself has a ratio above, incompressible text one below the band for its length; a document is rejected
when its whole ratio leaves the band of its length, or when more than CHUNK_SHARE of its chunks leave theirs.

The bands are fitted, not chosen: `fit_bands` takes labelled good documents of the training side (crc32(doc_id as text) mod 5
not 0), all of them, and of each the ratio of the whole text and of every chunk. At each length of EDGES the limits are
the QUANTILE from either end, widened by MARGIN; a length with fewer than LEAST ratios takes the limits of the next lower one that
has enough. Without labels PRIOR holds, which only tells base64 noise (ratio 1.04 at 192 bytes, 1.29 at 2048, 1.33 at
most) from text and rejects what any text is far from. Hexadecimal text is as compressible as prose.

Defined cases: a null text has no words and fails the base rules; very long texts are compressed whole and in chunks;
a ratio that equals a limit is within the band; an empty table gives an empty result; repeated rows give repeated rows;
null ids are kept; labels of unknown documents, null ids and null labels are not learned from, of an id's labels the least counts and of
its texts each; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.quality_cnn import held_out
from quillon.session import stored

LEVEL = 3
CHUNK = 2048
CHUNK_SHARE = 0.25
Band = tuple[int, float, float]
#: (from so many bytes, least ratio, greatest ratio) where there is nothing to fit.
PRIOR: list[Band] = [(0, 0.0, 4.0), (192, 1.1, 4.0), (512, 1.25, 4.0), (2048, 1.4, 4.0)]
#: Lengths that have limits of their own, by factors of about 1.5 up to a chunk's and of 2 beyond.
EDGES = [0, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 8192, 16384, 32768, 65536, 131072, 262144]
QUANTILE, MARGIN, LEAST = 0.999, 0.05, 50
#: Bins of a ratio's logarithm, in which quantiles are looked for.
BINS = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


def band(n_bytes: int, bands: list[Band] = PRIOR) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(bands) if n_bytes >= least)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    if len(words) < 3:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    n = len(ids)
    pair = np.unique(w[:-1] * n + w[1:], return_inverse=True)[1].astype(np.int64)
    _, at, count = np.unique(pair[:-1] * n + w[2:], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[at] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[often + k] = True
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = Counter(x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r"))
    return sum(n - 1 for n in lines.values())


def chunks(text: bytes) -> list[bytes]:
    """Chunks of CHUNK bytes, of which the last takes what is left too."""
    starts = range(0, max(len(text) // CHUNK, 1) * CHUNK, CHUNK)
    return [text[at : at + CHUNK] for at in starts[:-1]] + [text[starts[-1] :]]


def verdict(text: bytes, press: zstandard.ZstdCompressor, bands: list[Band] = PRIOR) -> tuple[float | None, float | None, float | None, str]:
    """Whole ratio, least and greatest chunk ratio, and the reason to reject, if any."""
    if not text:
        return None, None, None, ""
    ratio = len(text) / len(press.compress(text))
    lo, hi = band(len(text), bands)
    reason = "repetitive" if ratio > hi else "incompressible" if ratio < lo else ""
    parts = chunks(text)
    if len(parts) == 1:  # the one chunk is the whole text
        return ratio, ratio, ratio, reason
    each = [len(x) / len(press.compress(x)) for x in parts]
    limits = [band(len(x), bands) for x in parts]
    high, low = sum(x > hi for x, (_, hi) in zip(each, limits, strict=True)), sum(x < lo for x, (lo, _) in zip(each, limits, strict=True))
    if not reason and max(high, low) > CHUNK_SHARE * len(each):
        reason = "repetitive chunks" if high >= low else "incompressible chunks"
    return ratio, min(each), max(each), reason


FIELDS = [
    ("n_words", "long", pa.int64()),
    ("word_chars", "long", pa.int64()),
    ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()),
    ("base_failed", "boolean", pa.bool_()),
    ("kept", "boolean", pa.bool_()),
    ("ratio", "double", pa.float64()),
    ("least_chunk_ratio", "double", pa.float64()),
    ("greatest_chunk_ratio", "double", pa.float64()),
    ("reason", "string", pa.string()),
]


def judge(text: bytes | None, press: zstandard.ZstdCompressor, bands: list[Band] = PRIOR) -> tuple:
    """The values of FIELDS for one whole text."""
    text = text or b""
    words = text.split()  # of bytes: splits at \x20 and \x09-\x0D alone
    n, repeats = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    ratio, least, most, reason = verdict(text, press, bands)
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUATION)))
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    return n, chars, symbols, duplicate_lines(text), repeats, failed, not failed and not reason, ratio, least, most, "base" if failed else reason


def training_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(edge, ratio) of the whole texts and the chunks of all labelled good documents of the training side."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    good = known.groupBy("doc_id").agg(F.min("label").alias("label")).where("label = 1").select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, edges = zstandard.ZstdCompressor(level=LEVEL), np.array(EDGES)
        for batch in batches:
            at, sizes, ratios = [], [], []
            for row, t in enumerate(batch.column(1).cast(pa.binary())):
                text = t.as_py() or b""
                parts = chunks(text)
                for x in [text, *(parts if len(parts) > 1 else ())] if text else ():
                    at.append(row)
                    sizes.append(len(x))
                    ratios.append(len(x) / len(press.compress(x)))
            edge = edges[np.searchsorted(edges, np.array(sizes, dtype=np.int64), side="right") - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(edge, pa.int64()), pa.array(ratios, pa.float64())], names=["doc_id", "edge", "ratio"])

    # ratios are taken before labels are met, so no text is shuffled
    side = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~held_out("doc_id"))
    kind = docs.schema[id_col].dataType.simpleString()
    return side.mapInArrow(run, f"doc_id {kind}, edge long, ratio double").join(good, "doc_id", "left_semi").select("edge", "ratio")


def quantiles(seen: DataFrame, ends: list[float], least: int = LEAST) -> dict[int, list[float]]:
    """Exact quantiles (between ranks by proportion) of the ratios of each edge that has `least` of them; seen: edge, ratio.

    Ratios are counted by bins, then only those of the bins in which a rank lies are ordered, so no task holds an edge's ratios.
    """
    n = F.col("_all")
    ranks = [f((n - 1) * F.lit(q)).cast("long") for q in ends for f in (F.floor, F.ceil)]
    holds = lambda upto, count: reduce(Column.__or__, ((r >= upto - count) & (r < upto) for r in ranks))
    binned = seen.withColumn("_bin", F.floor(F.log("ratio") * BINS))
    counts = binned.groupBy("edge", "_bin").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("edge")  # as many rows as there are bins
    placed = counts.withColumns({"_all": F.sum("_n").over(whole), "_upto": F.sum("_n").over(whole.orderBy("_bin"))}).where(n >= least)
    wanted = placed.where(holds(F.col("_upto"), F.col("_n"))).select("edge", "_bin", "_all", (F.col("_upto") - F.col("_n")).alias("_before"))
    near = binned.join(F.broadcast(wanted), ["edge", "_bin"]).groupBy("edge", "_bin", "_all", "_before", "ratio").agg(F.count("*").alias("_n"))  # four rows an edge at most
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("edge", "_bin").orderBy("ratio"))
    rows = near.withColumn("_upto", upto).where(holds(F.col("_upto"), F.col("_n"))).collect()  # four rows an edge at most
    out = {}
    for edge, all_ in {(r.edge, r._all) for r in rows}:
        at = lambda rank: next(r.ratio for r in rows if r.edge == edge and r._upto - r._n <= rank < r._upto)  # noqa: B023, E731
        spots = [(all_ - 1) * q for q in ends]
        out[edge] = [at(floor(x)) if floor(x) == ceil(x) else (ceil(x) - x) * at(floor(x)) + (x - floor(x)) * at(ceil(x)) for x in spots]
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Band]:
    """The bands of labelled good documents of the training side, PRIOR where there are too few."""
    ends = [1 - QUANTILE, QUANTILE]
    seen = stored(training_ratios(docs, labels, id_col, text_col, label_col))  # read twice
    found = {edge: (lo * (1 - MARGIN), hi * (1 + MARGIN)) for edge, (lo, hi) in quantiles(seen, ends).items()}
    bands = [(edge, *found[edge]) for edge in EDGES if edge in found]
    return [b for b in PRIOR if not bands or b[0] < bands[0][0]] + bands


def bands_table(spark: SparkSession, bands: list[Band]) -> DataFrame:
    """(from_bytes, least_ratio, greatest_ratio): fitted bands as a table, to be written and given to other runs."""
    return spark.createDataFrame(bands, "from_bytes long, least_ratio double, greatest_ratio double")


def read_bands(table: DataFrame) -> list[Band]:
    return sorted((r.from_bytes, r.least_ratio, r.greatest_ratio) for r in table.collect())  # as many rows as EDGES


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: list[Band] = PRIOR) -> DataFrame:
    """doc_id and FIELDS for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = [judge(t.as_py(), press, bands) for t in batch.column(1).cast(pa.binary())]
            columns = [list(c) for c in zip(*found, strict=True)] or [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, FIELDS, strict=True))], names=["doc_id", *(f for f, _, _ in FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{f} {k}" for f, k, _ in FIELDS)]))
