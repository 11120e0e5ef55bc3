"""Streams end in the same rows as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators.incremental import VersionedTable
from tracelode.streaming import incremental as s


def test_arrivals_are_merged_once(spark, tmp_path):
    source, t = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"))
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        s.index_arrivals(spark, source, "k int, v string", t, lambda df: df, "k", str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_windows_and_sessions(spark):
    events = spark.createDataFrame([(1, "a", 0), (1, "a", 600), (1, "b", 4000), (2, "a", 10)], "user_id int, event_type string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r["event_type"], r["n"]) for r in s.windowed_counts(events).collect()} == {("a", 3), ("b", 1)}
    assert sorted(r["n"] for r in s.sessions(events).collect()) == [1, 1, 2]
