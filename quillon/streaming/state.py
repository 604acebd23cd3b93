"""Streams of change records: the latest value of every (object, attribute), and windowed counts.

An extension: changes arrive as events, and the world state is kept up to date instead of being folded anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of change records from a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key so far (update mode): one row of state for each key."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n_changes"))


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window; windows older than the watermark are closed and their state dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drained(result: DataFrame, folder: str) -> DataFrame:
    """The whole result of a streaming aggregation once all input that is there has gone through it.

    Every batch replaces the table under folder, which all executors share; the stream's own progress is kept beside it, so a
    broken run goes on where it was.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    run = result.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/table")
