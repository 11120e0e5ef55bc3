"""Mixing sources to target weights by nested hash-threshold histograms.

A row's place in its source is a 48-bit hash of its id. A source that must give
``need`` words beyond whole repeats gives the rows below a hash threshold; the
threshold is found by summing words per 12-bit hash bucket, stepping into the
bucket where the budget ends and repeating there. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import WORD
from .scratch import cut

_BITS, _LEVELS = 12, 4


def place_hash(doc_id: Column) -> Column:
    """48 bits that any SQL engine with md5 can reproduce; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """``source, source_size, target`` per source.

    Sources in code point order (null last) get the weights in turn and share
    ``share`` of all words by them; no target exceeds ``repeat`` times its
    source's size, the excess going to the others by weight until none is above:
    target = min(cap, level * weight), the level coming from the sources in
    order of cap per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    per = per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(repeat)).alias("cap"))
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    total = F.sum("source_size").over(all_) * share
    before = F.sum("cap").over(up) - F.col("cap")
    left = F.sum("w").over(all_) - F.sum("w").over(up) + F.col("w")
    per = per.withColumn("level", (total - before) / left)
    per = per.withColumn("at", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")))
    level = F.min("at").over(all_)["level"]
    return per.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``copies`` for every row.

    Every row is taken ``floor(target / source_size)`` times, rows below the
    source's threshold once more; the row on the threshold counts in if that
    comes closer. Rows of equal id lie on the same place and are taken alike.
    Null texts and empty texts have size 0 and take nothing; null sources are a
    source of their own; an empty table gives no rows.
    """
    return plan_of_sizes(cut(_sizes(docs), "mix-sizes"), weights, share, repeat)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place_hash(F.col("doc_id")).alias("h"))


def plan_of_sizes(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """``mix_plan`` for a table of ``doc_id, source, size, h`` that is cheap to read again."""
    out = sizes.join(source_limits(sizes, weights, share, repeat), F.col("source").eqNullSafe(F.col("s")))
    out = out.select("doc_id", "size", "source_size", "target", _copies(repeat).alias("copies"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _copies(repeat: int) -> Column:
    return F.col("whole") + F.when((F.col("h") < F.col("limit")) & (F.col("whole") < repeat), 1).otherwise(0)


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as the plan takes it, all columns kept.

    The plan is one row per source, so texts are neither shuffled nor sorted.
    """
    sizes = cut(_sizes(docs), "mix-sizes")
    # A written plan has a known size, by which Spark decides to send it; else texts would be dealt by source.
    plan = cut(source_limits(sizes, weights, share, repeat), "mix-plan").withColumnsRenamed({c: f"__{c}" for c in ("s", "whole", "limit")})
    copies = F.col("__whole") + F.when((place_hash(F.col("doc_id")) < F.col("__limit")) & (F.col("__whole") < repeat), 1).otherwise(0)
    out = docs.join(plan, F.col("source").eqNullSafe(F.col("__s")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__copy")).drop("__copy")


def source_limits(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeat: int = 3) -> DataFrame:
    """``s`` (source), ``source_size, target, whole`` (times that all rows are taken) and ``limit`` (hashes below are taken once more)."""
    targets = source_targets(sizes, weights, share, repeat)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole)
    targets = cut(targets.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets").withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    state = targets.select("s", "need", F.lit(0).cast("long").alias("prefix"))
    rows = sizes.select("source", "size", "h").where("size > 0")
    for level in range(_LEVELS):
        shift = 48 - _BITS * (level + 1)
        inside = rows.join(state, same).where(F.shiftright("h", shift + _BITS) == F.col("prefix"))
        bucket = inside.groupBy("s", "need", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("prefix")
        bucket = bucket.withColumn("cum", F.sum("n").over(run))
        edge = bucket.where(F.col("cum") > F.col("need")).withColumn("k", F.row_number().over(run)).where("k = 1")
        state = cut(edge.select("s", (F.col("need") - (F.col("cum") - F.col("n"))).alias("need"), "prefix", "n"), "mix-edge")
        if level == 0:
            # Only the boundary bucket is read from here on.
            rows = cut(rows.join(state.select("s", "prefix"), same).where(F.shiftright("h", shift) == F.col("prefix")).select("source", "size", "h"), "mix-boundary")
    limit = F.when(F.col("need") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    limits = state.select(F.col("s").alias("ls"), limit.alias("limit"))
    return targets.join(limits, F.col("s").eqNullSafe(F.col("ls")), "left").select("s", "source_size", "target", "whole", F.coalesce("limit", F.lit(1 << 48)).alias("limit"))
