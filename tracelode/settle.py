"""Cutting lineage of iterative plans at the cluster's checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a folder of this machine only where all tasks run on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracelode-settle-")
    return _OWN[context.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder until the driver ends.

    Lost executors cost a reread, not a rerun, and as the files have a size, Spark
    sends a small table to the tasks by its own check.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, each: int = 16 << 20) -> int:
    """Partitions for work that keeps all of a table: one for ``each`` bytes of its files, and one a core at least.

    The session's number of shuffle partitions does not grow with the table, so by
    that alone the memory of a task does.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // each), 1 << 16))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass
