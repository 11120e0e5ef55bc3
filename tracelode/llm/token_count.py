"""Token counts with a digest cache.

Contents are keyed by the digest of their normalised form and the digest of the
tokenizer file. Only digests without a stored count are encoded, each from one
representative row, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut, fresh_path
from .textblocks import blocks
from .wordpieces import encoder
from .workers import lean

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def collapse_space(text: Column) -> Column:
    """For tokenizers that drop white space: runs of it count as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " ")


def unchanged(text: Column) -> Column:
    """For tokenizers that encode white space."""
    return F.coalesce(text, F.lit(""))


def _count(path: str):
    @lean("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in blocks(batch, most=4 << 20):
                yield pa.record_batch({"digest": part.column(0), "n_tokens": pa.array(encoder(path).counts(data, off), pa.int64())})

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, normalise: Callable[[Column], Column] = collapse_space, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Null texts are empty; repeated rows are counted each; rows with equal
    content are encoded once. Rows with null ids are served like others. Extra
    columns are ignored. ``cache`` is a Parquet folder to read and append to; a
    fresh one in the shared folder if None. An empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    path = cache or fresh_path(spark, "token-cache")
    known = _cache(spark, path).where(F.col("version") == version).select("digest")
    digest = F.unhex(F.sha2(normalise(F.col("text")), 256))
    keyed = cut(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")), "token-keys")
    # One locator per digest: min() combines before the shuffle, so groups of copies stay small.
    misses = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("at")).join(known, "digest", "left_anti"), "token-misses")
    source = docs.select("doc_id", "text").join(misses.withColumnRenamed("digest", "want"), F.col("doc_id").eqNullSafe(F.col("at")))
    texts = source.where(digest == F.col("want")).select(F.col("want").alias("digest"), "text")
    counted = texts.mapInArrow(_count(tokenizer), "digest binary, n_tokens bigint").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(path)
    stored = _cache(spark, path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join has no aggregate under it and Spark may split the partition of a digest with many copies.
    stored = cut(stored, "token-stored")
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cache(spark, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)
