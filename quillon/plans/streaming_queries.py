"""Streams over the driver's events: the state they leave, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.session import ensure_checkpoint_dir, table
from quillon.streaming import state


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changes(spark, f"{sf_dir}/events.parq*et", table(spark, sf_dir, "events").schema)


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{context.applicationId}-{context._jvm.java.util.UUID.randomUUID()}"


@query("SELECT user_id, event_type, arg_max(value, struct_pack(ts := ts, event_id := event_id)) AS value, count(*) AS n_changes FROM events GROUP BY ALL")
def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of every user and kind after the stream of events."""
    return state.drained(state.latest(_stream(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], "value"), _folder(spark, "state"))


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind."""
    found = state.drained(state.windowed_counts(_stream(spark, sf_dir), "ts", ["event_type"]), _folder(spark, "counts"))
    return found.select(F.unix_timestamp("start").alias("start"), "event_type", "n")
