"""Streams: files arriving in a folder merged into an index, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import VersionedTable


def index_arrivals(spark: SparkSession, source: str, schema: str, table: VersionedTable, prepare: Callable[[DataFrame], DataFrame], key: str, checkpoint: str):
    """Runs through all new Parquet files under ``source`` and upserts what ``prepare`` makes of them.

    Merging by key makes a repeated batch harmless. Files that vanish can't show
    in a stream; ``manifest_diff`` finds them.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, _: table.upsert(prepare(df), key))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; on a stream, state older than the watermark is dropped."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")
