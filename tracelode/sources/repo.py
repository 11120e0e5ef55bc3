"""Repositories as tables: files with contents, chunks and imports by one parse per file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.globs import ignore_rules, ignored
from ..functions.text import content_sha, language_of
from ..schemas import CHUNKS, IMPORTS

LARGEST_FILE = 1_500_000
SKIPPED_DIRS = tuple(sorted("vendor venv env target node_modules dist build __pycache__".split()))


def walk_filter(relpath: Column, length: Column, skipped: tuple[str, ...] = SKIPPED_DIRS, rules: list | None = None) -> Column:
    """Is a file part of the walk? Directories that are skipped by name or start with a dot are not entered;
    empty, oversized, ignored and unsupported files are left out. Hidden files stay."""
    folders = F.slice(F.split(relpath, "/"), 1, F.greatest(F.size(F.split(relpath, "/")) - 1, F.lit(0)))
    closed = F.exists(folders, lambda d: d.isin(*skipped) | d.startswith("."))
    return ~closed & (length > 0) & (length <= LARGEST_FILE) & language_of(relpath).isNotNull() & ~ignored(relpath, rules or [])


def list_files(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED_DIRS, follow_links: bool = False) -> list[tuple[str, str, int]]:
    """(relative path, path, size) of all files below ``root``, without entering skipped and dot directories.

    Spark's own listing drops names that start with ``_`` or ``.``, package files
    of Python among them, so names are listed here; contents are read by tasks.
    """
    out: list[tuple[str, str, int]] = []
    closed = lambda name: name in skipped or name.startswith(".")
    if "://" not in root or root.startswith("file://"):
        base = "/" + root.removeprefix("file://").lstrip("/") if root.startswith("file://") else os.path.abspath(root)
        if not os.path.isdir(base):
            raise NotADirectoryError(root)
        for folder, dirs, names in os.walk(base, followlinks=follow_links):
            dirs[:] = [d for d in dirs if not closed(d)]
            for name in names:
                path = os.path.join(folder, name)
                if follow_links or not os.path.islink(path):
                    out.append((os.path.relpath(path, base).replace(os.sep, "/"), path, os.path.getsize(path)))
        return out
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.getFileStatus(make(root)).isDirectory():
        raise NotADirectoryError(root)
    start = len(store.getFileStatus(make(root)).getPath().toString().rstrip("/")) + 1
    todo = [make(root)]
    while todo:
        for x in store.listStatus(todo.pop()):
            path = x.getPath()
            if x.isDirectory():
                if not closed(path.getName()):
                    todo.append(path)
            else:
                out.append((path.toString()[start:], path.toString(), x.getLen()))
    return out


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for i in range(batch.num_rows):
            path = batch.column(1)[i].as_py()
            store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with store.open_input_stream(inner) as f:
                yield pa.record_batch({"relpath": batch.column(0).slice(i, 1), "length": batch.column(2).slice(i, 1), "content": pa.array([f.read()], pa.binary())})


def scan_repo(spark: SparkSession, root: str, extra_skipped: tuple[str, ...] = (), follow_links: bool = False) -> DataFrame:
    """``relpath, language, size_bytes, sha, content`` of the files of a repository."""
    found = list_files(spark, root, SKIPPED_DIRS + extra_skipped, follow_links)
    rules: list = []
    if ignore := [path for rel, path, _ in found if rel == ".gitignore"]:
        rows = spark.createDataFrame([("", ignore[0], 0)], "relpath string, path string, length bigint")
        text = rows.mapInArrow(_read_contents, "relpath string, length bigint, content binary").first()["content"]
        rules = ignore_rules(bytes(text).decode("utf-8", "replace"))
    names = spark.createDataFrame(found, "relpath string, path string, length bigint")
    names = names.where(walk_filter(F.col("relpath"), F.col("length"), SKIPPED_DIRS + extra_skipped, rules))
    files = names.mapInArrow(_read_contents, "relpath string, length bigint, content binary")
    return files.select("relpath", language_of(F.col("relpath")).alias("language"), F.col("length").alias("size_bytes"), content_sha(F.col("content")).alias("sha"), "content")


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file: ``relpath, chunks, imports``; each file is parsed once."""
    ddl = f"relpath string, chunks array<struct<{_inner(CHUNKS)}>>, imports array<struct<{_inner(IMPORTS)}>>"
    schema = to_arrow_schema(_schema(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..parsing import parse_source

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                path, language, content = (batch.column(c)[i].as_py() for c in ("relpath", "language", "content"))
                parsed = parse_source(path, language, content or b"")
                rows.append({"relpath": path, "chunks": parsed.chunks, "imports": parsed.imports})
                size += len(content or b"")
                if size > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0

    return files.select("relpath", "language", "content").mapInArrow(run, ddl)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over enough tasks for all cores, whatever files they come from: a few MB of keys make hours of parsing."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism))


def _inner(ddl: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in ddl.split(", "))


def chunks_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("chunks"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("imports"))
