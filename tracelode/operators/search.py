"""Exact vector search with pack filters, lexical scores and rank fusion.

All searches take a table of queries, so one or a hundred thousand questions run
through one plan. Vectors are scanned once: every batch of vectors is multiplied
with all queries, keeps its best k for each, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL, RRF_K, TOP_K = 40, 60, 8
#: Queries sent to the tasks at once.
QUERY_BYTES = 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def in_packs(packs: Column, wanted: list) -> Column:
    """Row filter to be applied before any scoring."""
    return F.arrays_overlap(packs, F.array(*[F.lit(p) for p in wanted]))


def nearest(vectors: DataFrame, query: DataFrame, k: int = TOP_K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors closest to the single row of ``query`` (column ``q``), ranked; ties by id.

    Null vectors and those without length are close to nothing and never found. A
    one-row side is the only thing sent; the rest is a scan with a top-k per task.
    """
    one = query.limit(1).select(F.col("q"))
    scored = vectors.join(F.broadcast(one)).withColumn("score", cosine(F.col(vector), F.col("q"))).where("score is not null").drop("q", vector)
    best = scored.orderBy(F.desc("score"), id).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id)).cast("bigint"))


def batch_nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, <id>, score, rank`` for every row of ``queries`` (``query_id, q``).

    Queries are collected in parts of bounded size; each part passes over the
    vectors once, a tile of queries against a batch of vectors at a time. Null
    vectors, those without length and those of another size than the queries' are
    found by no query, and such queries find nothing.
    """
    asked = queries.where(F.exists("q", lambda x: x != 0))
    total = asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0))).first()[0] * 8
    parts = max(1, -(-int(total) // QUERY_BYTES))
    out = None
    for i in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "q").collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        q = np.array([r["q"] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, q))
        usable = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v")).where((F.size("v") == q.shape[1]) & F.exists("v", lambda x: x != 0))
        found = usable.mapInArrow(_best_of_batch(sent, k), "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", id)


#: Scores that a task holds at once: queries of a tile times vectors of a batch.
TILE = 1 << 21


def _best(row: np.ndarray, key: np.ndarray, score: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every row, greatest score first, ties by key."""
    order = np.lexsort((key, -score, row))
    row, key, score = row[order], key[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n_rows))[row]
    keep = place < k
    return row[keep], key[keep], score[keep]


def _best_of_batch(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        n = len(ids)
        row, key, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not n or not batch.num_rows:
                continue
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            names = batch.column(0).to_numpy(zero_copy_only=False)
            step = max(1, TILE // len(v))
            more = [(row, key, score)]
            for lo in range(0, n, step):
                s = q[lo : lo + step] @ v.T
                # Only what reaches the k-th score of its row, ties included, is ordered.
                edge = np.partition(s, len(v) - k, axis=1)[:, [len(v) - k]] if len(v) > k else np.full((len(s), 1), -np.inf)
                i, j = np.nonzero(s >= edge)
                more.append((i + lo, names[j], s[i, j]))
            row, key, score = _best(*(np.concatenate(x) for x in zip(*more, strict=True)), n, k)
        if len(row):
            yield pa.record_batch({"query_id": ids[row], "id": key, "score": score})

    return run


def fuse_ranks(pool: DataFrame, k: int = TOP_K, partition: list[str] | None = None, id: str = "id") -> DataFrame:
    """Reciprocal rank fusion of ``score`` and ``lex`` over a candidate pool.

    Without any lexical signal, or with one candidate, the dense order stays.
    Adds ``dense_rank, lex_rank`` (from 0), ``rrf`` and ``rank`` (from 1); ties by dense rank.
    """
    keys = partition or []
    by = lambda *c: Window.partitionBy(*keys).orderBy(*c)
    ranked = pool.withColumn("dense_rank", (F.row_number().over(by(F.desc("score"), id)) - 1).cast("bigint"))
    ranked = ranked.withColumn("lex_rank", (F.row_number().over(by(F.desc("lex"), "dense_rank")) - 1).cast("bigint"))
    whole = Window.partitionBy(*keys)
    signal = (F.max("lex").over(whole) > 0) & (F.count("*").over(whole) > 1)
    fused = 1.0 / (RRF_K + F.col("dense_rank")) + 1.0 / (RRF_K + F.col("lex_rank"))
    ranked = ranked.withColumn("rrf", fused).withColumn("__o", F.when(signal, -F.col("rrf")).otherwise(F.col("dense_rank").cast("double")))
    ranked = ranked.withColumn("rank", F.row_number().over(by("__o", "dense_rank")).cast("bigint"))
    return ranked.where(F.col("rank") <= k).drop("__o")


def neighbours(vectors: DataFrame, queries: DataFrame, group: str, k: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, <id>, score, rank`` of the first k among each query's 2k nearest that aren't of its own group.

    ``queries`` has ``query_id, q, own``; the filter comes after the limit, so a
    query may have fewer than k. A null group on either side differs from all.
    """
    pool = batch_nearest(vectors, queries.select("query_id", "q"), 2 * k, id, vector)
    grouped = pool.join(vectors.select(F.col(id), F.col(group).alias("__g")), id).join(queries.select("query_id", "own"), "query_id")
    other = grouped.where(F.coalesce(F.col("__g") != F.col("own"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("bigint")
    return other.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", id, "score", "rank")
