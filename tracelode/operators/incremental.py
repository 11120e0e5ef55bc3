"""Incremental indexing: what changed, what must be embedded, merging into tables of files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``relpath, status``: new, changed, reused or gone, by one full join on the path."""
    f = files.select("relpath", F.col("sha").alias("now"))
    m = manifest.select("relpath", F.col("sha").alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("was"), "reused").otherwise("changed")
    return f.join(m, "relpath", "full").select("relpath", status.alias("status"), "now", "was")


def index_stats(diff: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return diff.agg(n("new", "changed").alias("indexed"), n("reused").alias("reused"), n("gone").alias("gone"), n("changed", "gone").alias("stale_deletes"))


def cache_split(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """``texts`` (``model, sha``) with ``status`` hit or miss and the cached vector."""
    known = cache.select("model", "sha", "vector").dropDuplicates(["model", "sha"])
    return texts.join(known, ["model", "sha"], "left").withColumn("status", F.when(F.col("vector").isNotNull(), "hit").otherwise("miss"))


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: of repeated keys the one whose other columns, in their order, are greatest."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("__row")).select(key, "__row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of keys repeated in ``new`` one row stays (see ``one_per_key``).

    Null keys match nothing in ``old``; those of ``new`` count as one key.
    """
    new = one_per_key(new, key)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


FORMAT = 2


class VersionedTable:
    """A Parquet table whose writes go to new folders; a pointer file names those that make up the current version.

    With a ``key``, rows lie in folders by the key's hash, and an upsert or a
    deletion rewrites only folders that hold a touched key; large tables take more
    ``buckets``. Readers never see a
    half-written version, and lazy plans over an older one keep working until
    ``vacuum``. A pointer that can't be read, or of another format, counts as no
    table, so that callers build it anew. Works on every file system that Hadoop
    knows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        pointer = self._fs_path(f"{self.path}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        try:
            told = json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])
            return told if told["format"] == FORMAT and isinstance(told["folders"], list) else None
        except (ValueError, KeyError, TypeError):
            return None

    def version(self) -> str | None:
        told = self._pointer()
        return told["version"] if told else None

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self) -> DataFrame:
        told = self._pointer()
        if told is None:
            raise LookupError(f"no table at {self.path}")
        return self._read(told, told["folders"])

    def _read(self, told: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(told["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _publish(self, schema: StructType, folders: list[str], layout: dict) -> None:
        told = {"format": FORMAT, "version": uuid.uuid4().hex, "schema": json.loads(schema.json()), "folders": sorted(folders), **layout}
        fresh = self._fs_path(f"{self.path}/CURRENT.{told['version']}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        # One rename that replaces: readers see the old pointer or the new one.
        hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._fs_path(f"{self.path}/CURRENT")), how)

    def _bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")

    def _write(self, df: DataFrame, partition: list[str] | None = None) -> list[str]:
        """Folders of a new version, by hash of the key where the table has one."""
        now = f"v-{uuid.uuid4().hex}"
        if self.key:
            df.withColumn("__bucket", self._bucket(self.key, self.buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{now}")
            return [f"{now}/{x.getPath().getName()}" for x in self._fs.listStatus(self._fs_path(f"{self.path}/{now}")) if x.isDirectory()]
        (df.write.partitionBy(*partition) if partition else df.write).parquet(f"{self.path}/{now}")
        return [now]

    def replace(self, df: DataFrame, partition: list[str] | None = None) -> None:
        schema = df.schema
        self._publish(schema, self._write(df, partition), {"key": self.key, "buckets": self.buckets})

    def vacuum(self) -> None:
        """Deletes all folders that the current version does not name. For when no plan over an older one is still to run."""
        told = self._pointer()
        held = set(told["folders"]) if told else set()
        tops = {f.split("/")[0] for f in held}
        for entry in self._fs.listStatus(self._fs_path(self.path)):
            name = entry.getPath().getName()
            if name.startswith("v-") and name not in tops:
                self._fs.delete(entry.getPath(), True)
            elif name.startswith("v-") and name not in held:
                for part in self._fs.listStatus(entry.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in held:
                        self._fs.delete(part.getPath(), True)

    def _touched(self, told: dict, keys: DataFrame, key: str) -> tuple[list[str], list[str]]:
        """The folders that may hold one of the keys, and the others."""
        if not self.key or (told["key"], told["buckets"], key) != (self.key, self.buckets, self.key):
            return told["folders"], []
        hit = {f"__bucket={r[0]}" for r in keys.select(self._bucket(key, self.buckets)).distinct().collect()}
        inside = [f for f in told["folders"] if f.rsplit("/", 1)[-1] in hit]
        return inside, [f for f in told["folders"] if f not in inside]

    def upsert(self, new: DataFrame, key: str) -> int:
        """Number of rows merged. What is merged is written once, before the table changes, and counted from there."""
        held = f"{self.path}/merge-{uuid.uuid4().hex}"
        one_per_key(new, key).write.parquet(held)
        new = self.spark.read.schema(new.schema).parquet(held)
        n = new.count()
        told = self._pointer()
        if told is None:
            self.replace(new)
        else:
            inside, rest = self._touched(told, new, key)
            merged = upsert(self._read(told, inside), new, key)
            self._publish(merged.schema, self._write(merged) + rest, {"key": self.key, "buckets": self.buckets})
        self._fs.delete(self._fs_path(held), True)
        return n

    def drop(self) -> None:
        """No table from now on; files go, so no plan over an older version may still be to run."""
        self._fs.delete(self._fs_path(self.path), True)

    def swap(self, new: DataFrame, gone: DataFrame, key: str) -> None:
        """Takes out the rows of the keys in ``gone`` and puts in ``new``, in one version. Repeated keys of ``new`` all stay."""
        told = self._pointer()
        if told is None:
            self.replace(new)
            return
        keys = gone.select(key).union(new.select(key)).distinct()
        inside, rest = self._touched(told, keys, key)
        merged = delete_where(self._read(told, inside), keys, key).unionByName(new, allowMissingColumns=True)
        self._publish(merged.schema, self._write(merged) + rest, {"key": self.key, "buckets": self.buckets})

    def delete(self, gone: DataFrame, key: str) -> int:
        """Number of rows removed."""
        told = self._pointer()
        inside, rest = self._touched(told, gone, key)
        old = self._read(told, inside)
        folders = self._write(delete_where(old, gone, key))
        removed = old.count() - self._read(told, folders).count()
        self._publish(old.schema, folders + rest, {"key": self.key, "buckets": self.buckets})
        return removed
