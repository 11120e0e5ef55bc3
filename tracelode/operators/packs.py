"""Packs: named groups of paths that scope searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import matches
from ..functions.text import humanise, slug

LEAST_CHUNKS, MOST_PACKS, REBUCKET_AT = 3, 40, 200


def tag_paths(paths: DataFrame, packs: list[tuple[str, list[str]]], path: str = "relpath", out: str = "packs") -> DataFrame:
    """Adds the ids of the packs whose globs match, in the given order.

    Pack definitions are driver-side state of bounded size, so matching is a
    projection: no join, no shuffle.
    """
    hits = []
    for pack, globs in packs:
        any_ = F.lit(False)
        for g in globs:
            any_ = any_ | matches(F.col(path), g)
        hits.append(F.when(any_, F.lit(pack)))
    tags = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
    return paths.withColumn(out, tags)


def suggest(chunks: DataFrame, path: str = "file_relpath", size: str = "n_chars", least: int = LEAST_CHUNKS, most: int = MOST_PACKS, rebucket_at: int = REBUCKET_AT) -> DataFrame:
    """Packs by directory: ``pack_id, label, scope, chunk_count, token_estimate``.

    Files are grouped by their first directory; a group over ``rebucket_at``
    chunks is split by the first two path segments. Counting is a partial
    aggregate, then a join with the few group sizes, so a directory with a third
    of all chunks is not gathered.
    """
    fine = _fine(chunks, path, size, rebucket_at)
    groups = fine.groupBy("key").agg(F.sum("c").alias("chunk_count"), F.sum("n").alias("n")).where(F.col("chunk_count") >= least)
    label = humanise(F.replace(F.col("key"), F.lit("/"), F.lit(" / ")))
    out = groups.select(slug(F.col("key")).alias("pack_id"), label.alias("label"), F.concat("key", F.lit("/**")).alias("scope"), "chunk_count", F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("bigint").alias("token_estimate"))
    return out.orderBy(F.desc("chunk_count"), "label").limit(most)


def _tops(path: str) -> tuple:
    parts = F.split(path, "/")
    return F.get(parts, 0).alias("top1"), F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)).alias("top2")


def _fine(chunks: DataFrame, path: str, size: str, rebucket_at: int) -> DataFrame:
    """``top1, top2, c, n, key``: counts by the first two segments and the group that they belong to."""
    base = chunks.where(F.size(F.split(path, "/")) >= 2).select(*_tops(path), F.col(size).alias("n"))
    fine = base.groupBy("top1", "top2").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    total = F.sum("c").over(Window.partitionBy("top1"))
    return fine.withColumn("key", F.when(total > rebucket_at, F.col("top2")).otherwise(F.col("top1")))


def statistics(chunks: DataFrame, path: str = "file_relpath", size: str = "n_chars", name: str = "name", language: str = "language", rebucket_at: int = REBUCKET_AT, shown: int = 5) -> DataFrame:
    """What the groups of ``suggest`` hold: ``scope, n_files, top_files, top_names, top_language, summary``.

    The most frequent files and names, ``shown`` of each (ties by name), and the
    most frequent language. Every list is a count per value, then a rank within
    the group, so only one row per distinct value is ranked.
    """
    keys = _fine(chunks, path, size, rebucket_at).select("top1", "top2", "key", "c")
    base = chunks.where(F.size(F.split(path, "/")) >= 2).select(*_tops(path), F.col(path).alias("file"), F.col(name).alias("name"), F.coalesce(language, F.lit("code")).alias("language"))

    def leading(column: str, k: int) -> DataFrame:
        """The k most frequent values of a column per group, and how many values there are."""
        n = base.groupBy("top1", "top2", column).agg(F.count("*").alias("c")).join(keys.drop("c"), ["top1", "top2"]).groupBy("key", column).agg(F.sum("c").alias("c"))
        values = n.groupBy("key").agg(F.count("*").alias(f"n_{column}"))
        order = Window.partitionBy("key").orderBy(F.desc("c"), column)
        best = n.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", column))).alias("x"))
        return best.join(values, "key").select("key", F.col(f"x.{column}").alias(f"top_{column}"), f"n_{column}")

    total = keys.groupBy("key").agg(F.sum("c").alias("chunk_count"))
    out = total.join(leading("file", shown), "key").join(leading("name", shown), "key").join(leading("language", 1), "key")
    top = F.get("top_language", 0)
    summary = F.format_string("%d chunks across %d files in %s/ (%s).", "chunk_count", "n_file", "key", top)
    return out.select(F.concat("key", F.lit("/**")).alias("scope"), F.col("n_file").alias("n_files"), F.col("top_file").alias("top_files"), F.col("top_name").alias("top_names"), top.alias("top_language"), summary.alias("summary"))


def upsert_packs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_auto(packs: DataFrame) -> DataFrame:
    return packs.where(~F.col("auto"))


def active_packs(state: DataFrame) -> DataFrame:
    """``active`` from the arrays ``pinned, attached, excluded``: order kept, each once."""
    return state.withColumn("active", F.array_except(F.array_distinct(F.concat("pinned", "attached")), "excluded"))


def pack_status(active: DataFrame, packs: DataFrame) -> DataFrame:
    """Active ids with their pack, or ``orphaned`` where there is none."""
    return active.join(packs, "id", "left").withColumn("status", F.when(F.col("label").isNull(), "orphaned").otherwise("active"))
