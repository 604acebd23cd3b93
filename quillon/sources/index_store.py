"""An index on disk that grows by segments.

A segment holds the postings, paths, measurements and objects of one batch of memories, postings sorted by term so that a
scan for few terms skips what has others, and its own counts of terms. Shares of the whole are made from the counts, so
adding a batch reads the ids of the memories that are there, and nothing else of them. Segments of one size are put together from time to time.
A segment counts once its totals are written, the last of its tables; those that it takes the place of no longer count then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.embedding import Embedder, hashed_ngrams
from quillon.operators import aliases as A
from quillon.operators import ingest, postings
from quillon.operators.search import Index
from quillon.session import stored

TABLES = ("postings", "fullpath", "measurements", "objects", "counts", "memories")
#: Segments of one order of size that are put together, and the factor between the orders.
FAN = 8


class IndexStore:
    """The segments in a folder of any file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> dict[str, int]:
        """The names of the segments that count, and how many postings each has."""
        files = self._files()
        if not files.exists(self._path(self.folder)):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(self._path(self.folder))]
        whole = [n for n in names if files.exists(self._path(f"{self.folder}/{n}/totals/_SUCCESS"))]
        if not whole:
            return {}
        totals = self.spark.read.parquet(*(f"{self.folder}/{n}/totals" for n in whole)).collect()  # a row a segment
        gone = {name for r in totals for name in r.replaces}
        return {r.segment: r.postings for r in totals if r.segment not in gone}

    def table(self, name: str, segments: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{s}/{name}" for s in (self.segments() if segments is None else segments)))

    def _write(self, tables: dict[str, DataFrame], replaces: list[str]) -> str:
        name = f"segment-{uuid.uuid4()}"
        for kind, df in tables.items():
            if kind in ("postings", "counts"):
                df = df.repartitionByRange("term").sortWithinPartitions("term")
            df.write.parquet(f"{self.folder}/{name}/{kind}")
        n = self.table("counts", [name]).agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(name, int(n), replaces)], "segment string, postings long, replaces array<string>").coalesce(1).write.parquet(f"{self.folder}/{name}/totals")
        return name

    def append(self, memories: DataFrame, dictionary: DataFrame) -> str | None:
        """Add a batch of memory envelopes as a segment; memories whose ids are there already are left out."""
        known = self.segments()
        if known:
            memories = memories.join(self.table("memories", list(known)).select("memory_id"), "memory_id", "left_anti")
        memories = stored(memories)
        if memories.isEmpty():
            return None
        ix = ingest.build_index(memories, dictionary)
        counts = ix.freq.select("term", "occurrences", "memory_count")
        ids = memories.select("memory_id").distinct().join(ix.postings.select("memory_id", F.lit(True).alias("_p")).distinct(), "memory_id", "left").select("memory_id", F.coalesce("_p", F.lit(False)).alias("posted"))
        return self._write({"postings": ix.postings, "fullpath": ix.fullpath, "measurements": ix.measurements, "objects": ix.objects, "counts": counts, "memories": ids}, [])

    def compact(self, fan: int = FAN) -> list[str]:
        """Put segments together of which there are at least fan of one order of size; the names of the new ones."""
        orders: dict[int, list[str]] = {}
        for name, n in sorted(self.segments().items()):
            order = 0
            while n >= fan ** (order + 1):
                order += 1
            orders.setdefault(order, []).append(name)
        made = []
        for names in orders.values():
            if len(names) >= max(2, fan):
                tables = {kind: self.table(kind, names) for kind in TABLES}
                tables["counts"] = _merged(tables["counts"])
                made.append(self._write(tables, names))
                for name in names:
                    self._files().delete(self._path(f"{self.folder}/{name}"), True)
        return made

    def frequencies(self) -> DataFrame:
        """Occurrences and memories of every term and their shares, from the segments' counts. No memory is in two segments."""
        counted = _merged(self.table("counts"))
        whole = counted.agg(F.sum("occurrences").alias("_all")).crossJoin(self.table("memories").agg(F.count_if("posted").alias("_memories")))
        return postings.percentages(counted.crossJoin(F.broadcast(whole)))  # one row

    def open(self, dictionary: DataFrame, embed: Embedder | None = None) -> Index:
        """The index of all segments, as if built at once."""
        freq = self.frequencies()
        whole = {kind: self.table(kind) for kind in ("postings", "fullpath", "measurements", "objects")}
        return Index(whole["postings"], whole["fullpath"], whole["measurements"], whole["objects"], dictionary, A.alias_terms(dictionary), freq, postings.unmatchable_components(freq), embed or hashed_ngrams())


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("occurrences", "memory_count")))

