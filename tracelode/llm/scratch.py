"""Intermediate tables that survive the loss of an executor.

Every multi-pass operator cuts its lineage by writing a narrow Parquet table in
the folder that the cluster shares (``spark.checkpoint.dir``). A folder of our
own is only used where that setting is absent and all tasks run on this machine,
as in local tests; elsewhere its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors and the driver can reach, read from the session; without it, only a local session has one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    return _OWN[key]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before.

    The path is deleted when the driver ends.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result has no lineage above the files, keeps column pruning, and is
    recomputed from shared files only when an executor is lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
