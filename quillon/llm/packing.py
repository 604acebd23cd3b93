"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into whole windows of the longest context; what is left is routed to the tier of the
smallest context that holds it. Tiers are packed from the longest to the shortest: a window takes the longest
waiting piece of its tier, its gap is filled with whole pieces of shorter tiers, best fit first, and what still
gapes is closed by a cut piece. Windows of every tier are powers of two and come out full.

A partition packs its own rows, in pools of bounded size, so texts are not shuffled; what a partition has left at
its end goes out in full power-of-two sequences, those under the shortest context as one class of their own. The
packed pieces, which hold numbers alone, are written, and the sequences of each class are then dealt over the whole
corpus into as few step groups of at most about STEP_TOKENS as hold them, all of equal tokens up to one sequence,
so every step of a class costs the same.

Defined cases: a null text is empty and has the end id alone; very long texts are cut freely, each id in one piece;
null ids are kept; repeated rows are packed each; pieces of equal length are taken last in, first out; an empty table
gives an empty result; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import cut

CONTEXT = 2048
#: Contexts of the tiers, longest first.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 1 << 16
#: A partition packs what it holds whenever so many tokens wait; this bounds its memory.
POOL_TOKENS = 1 << 21
TOKENIZER = "byte_bpe_50k.json"
#: Bounds of the cache of encoded pieces, in entries and in characters of one entry.
_CACHE, _CACHED = 1_000_000, 48
#: Byte-level BPE never joins across a space that a non-space follows, so ids of such pieces just follow one another.
_PIECES = re.compile(r" (?=\S)")
_MARKS = frozenset(".,;:!?")

COLUMNS = [(c, "long") for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", "int"), ("ahead", "long")]
#: Bits of a sequence id below the partition that packed it.
_PARTITION = 40


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes, END_ID last.

    As a dict, it holds the ids of pieces that follow a space. A new piece is cut by the tokenizer's own pattern and
    given to its model; pieces with a special token in them go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._cut = regex.compile(public_tokenizers.PATTERN).findall
        self._letters = _byte_letters()
        self._words: dict[str, bytes] = {}
        self._end = array("I", [END_ID]).tobytes()

    def _encoded(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pattern; words after a space are kept with the pieces."""
        if word[0] == " " and len(word) > 1:
            return self[word[1:]]
        ids = self._words.get(word)
        if ids is None:
            ids = self._encoded(word)
            if len(word) <= _CACHED:
                self._words[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of any text, without END_ID."""
        if any(s in text for s in self._special):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self._encoded(w) if w == text else self._word(w) for w in self._cut(text)])

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():  # one word of the pattern, as are letters with a mark behind them two
            ids = self._encoded(f" {piece}")
        elif piece[-1:] in _MARKS and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self._word(piece[-1])
        else:
            ids = self.ids(f" {piece}")
        if len(piece) <= _CACHED:
            self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if len(self) + len(self._words) > _CACHE:
            self.clear()
            self._words.clear()
        head, *rest = _PIECES.split(text)
        return b"".join([self.ids(head), *map(self.__getitem__, rest), self._end])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


Piece = tuple[int, int, int]  # document, first id, number of ids


class Pool:
    """Waiting pieces by length; the longest that fits is found by the bits of a mask."""

    def __init__(self) -> None:
        self.stacks: list[list[Piece]] = [[] for _ in range(CONTEXT + 1)]
        self.mask = 0
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        n = piece[2]
        self.stacks[n].append(piece)
        self.mask |= 1 << n
        self.tokens += n

    def take(self, n: int) -> Piece:
        piece = self.stacks[n].pop()
        if not self.stacks[n]:
            self.mask ^= 1 << n
        self.tokens -= n
        return piece

    def longest(self, most: int) -> int:
        """The greatest waiting length of at most so many ids, 0 if there is none."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def pack(pool: Pool, emit: Callable[[int, list[Piece]], None], last: bool) -> None:
    """Full windows of all tiers. What cannot fill a window stays in the pool or, at last, goes out in powers of two."""
    for tier in TIERS:
        floor = 0 if tier == TIERS[-1] else tier // 2
        while (n := pool.longest(tier)) > floor:
            if pool.tokens < tier:
                break
            window, gap = [pool.take(n)], tier - n
            while gap:
                if fit := pool.longest(gap):
                    window.append(pool.take(fit))
                    gap -= fit
                else:
                    doc, first, length = pool.take(pool.shortest())
                    window.append((doc, first, gap))
                    pool.put((doc, first + gap, length - gap))
                    gap = 0
            emit(tier, window)
    while last and pool.tokens:
        size = 1 << (pool.tokens.bit_length() - 1)
        size = min(size, CONTEXT)
        window, gap = [], size
        while gap:
            n = pool.longest(gap) or pool.shortest()
            doc, first, length = pool.take(n)
            used = min(gap, length)
            window.append((doc, first, used))
            if length > used:
                pool.put((doc, first + used, length - used))
            gap -= used
        emit(size, window)


def _packed(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes], partition: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[object, bytes]] = []  # of each document in the pool: its id and its ids' bytes
    out: list[list] = [[] for _ in range(len(COLUMNS) + 1)]
    sequences, pool, kinds = 0, Pool(), None
    ahead: dict[int, int] = {}  # of each class: its tokens in this partition so far

    def emit(tier: int, window: list[Piece]) -> None:
        nonlocal sequences
        kind = max(tier, TIERS[-1] // 2)
        before, offset = ahead.get(kind, 0), 0
        ahead[kind] = before + tier
        for doc, first, n in window:
            name, ids = held[doc]
            row = name, first, n, zlib.crc32(ids[4 * first : 4 * (first + n)]), len(ids) // 4, partition << _PARTITION | sequences, offset, tier, before
            for column, value in zip(out, row, strict=True):
                column.append(value)
            offset += n
        sequences += 1

    def flush() -> pa.RecordBatch:
        types = [kinds, *(pa.int32() if k == "int" else pa.int64() for _, k in COLUMNS)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", *(c for c, _ in COLUMNS)])
        for column in out:
            column.clear()
        return batch

    def settle(last: bool) -> None:
        pack(pool, emit, last)
        kept = {doc: k for k, doc in enumerate(sorted({p[0] for s in pool.stacks for p in s}))}
        held[:] = [held[doc] for doc in kept]
        for n, stack in enumerate(pool.stacks):
            pool.stacks[n] = [(kept[doc], first, length) for doc, first, length in stack]

    for batch in batches:
        kinds = batch.column(0).type
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encode(text.as_py() or "")
            n, doc = len(ids) // 4, len(held)
            held.append((name.as_py(), ids))
            for first in range(0, n - n % CONTEXT, CONTEXT):
                emit(CONTEXT, [(doc, first, CONTEXT)])
            if n % CONTEXT:
                pool.put((doc, n - n % CONTEXT, n % CONTEXT))
            if pool.tokens >= POOL_TOKENS:
                settle(last=False)
                yield flush()
            elif len(out[0]) >= 1 << 14:
                yield flush()
    settle(last=True)
    if out[0]:
        yield flush()


def step_groups(pieces: DataFrame) -> DataFrame:
    """pieces with step_group for ahead: each class's sequences in order, cut into groups of equal tokens.

    Of a class only the totals of each partition are put in order, a row for each task that packed.
    """
    kind = F.greatest("tier", F.lit(TIERS[-1] // 2))
    placed = pieces.withColumns({"kind": kind, "part": F.shiftright("sequence_id", _PARTITION)})
    sums = placed.groupBy("kind", "part").agg(F.sum("length").alias("tokens"))
    ahead = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("kind", "part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("before"), F.sum("tokens").over(Window.partitionBy("kind")).alias("total"))
    groups = F.ceil(F.col("total") / STEP_TOKENS)
    number = F.floor((F.col("before") + F.col("ahead")).cast("decimal(38,0)") * groups / F.col("total")).cast("long")
    named = placed.join(sums, ["kind", "part"]).withColumn("step_group", F.shiftleft(F.col("kind").cast("long"), _PARTITION) + number)
    return named.select("doc_id", *(c for c, _ in COLUMNS[:-1]), "step_group")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, COLUMNS but ahead, and step_group."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(batches, encoder(path), TaskContext.get().partitionId())

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return step_groups(cut(slim.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} {k}" for c, k in COLUMNS)]))))
