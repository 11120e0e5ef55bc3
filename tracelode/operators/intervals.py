"""Runs of numbers and overlaps of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settle import settle

#: Lines of a block are 2 to this power: windows go over the blocks of a file, not over the file.
BLOCK = 14
#: Sizes of bins go up by 2 to this power.
STEP = 2


def islands(lines: DataFrame, keys: list[str], number: str) -> DataFrame:
    """``keys, range_start, range_end`` of maximal runs of consecutive numbers; repeats count once."""
    once = lines.select(*keys, F.col(number).cast("bigint").alias("__n")).distinct()
    run = F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))
    return once.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min("__n").alias("range_start"), F.max("__n").alias("range_end")).drop("__run")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Do two closed ranges share a number? Meant next to an equality, which makes it a hash join with this residual."""
    return (a_start <= b_end) & (b_start <= a_end)


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_id, right_id`` of the ranges (``id, key, start, end``) of one key that share a number, each pair once.

    A range lies in one or two bins of its own size, a power of ``1 << STEP``,
    and looks for the larger ones of the other side in their bins, so only ranges
    near each other meet, however long a file is. Both sides are kept in files, as
    the sizes that occur have to be known first.
    """
    left, right = (settle(df.select("id", "key", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")).where("key is not null and start is not null and end is not null")) for df in (left, right))
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    size = F.ceil(F.when(hi == lo, 0).otherwise(F.length(F.bin(hi - lo))) / STEP).cast("int") * STEP
    sizes = [sorted(r[0] for r in df.select(size).distinct().collect()) for df in (left, right)]

    def bins(df: DataFrame, side: int) -> DataFrame:
        """A pair meets at the larger one's size: where that is the left one (turn 0) or both are alike, or the right one (turn 1)."""
        there = F.array(*[F.lit(x) for x in sizes[1 - side]]).cast("array<int>")
        other = F.filter(there, lambda x: x > size) if side == 0 else F.filter(there, lambda x: x >= size)
        at = F.concat(F.array(F.struct(size.alias("size"), F.lit(side).alias("turn"))), F.transform(other, lambda x: F.struct(x.alias("size"), F.lit(1 - side).alias("turn"))))
        spread = df.select("*", F.explode(at).alias("at")).select("*", F.expr("shiftright(least(start, end), at.size)").alias("first"), F.expr("shiftright(greatest(start, end), at.size)").alias("last"))
        name = ("left", "right")[side]
        return spread.select("key", "at", F.explode(F.array_distinct(F.array("first", "last"))).alias("bin"), F.col("id").alias(f"{name}_id"), F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"))

    hit = bins(left, 0).join(bins(right, 1), ["key", "at", "bin"]).where(overlap(F.col("left_start"), F.col("left_end"), F.col("right_start"), F.col("right_end")))
    # Of the bins that both lie in, the one where the later one begins counts.
    begin = F.greatest(F.least("left_start", "left_end"), F.least("right_start", "right_end"))
    return hit.withColumn("__begin", begin).where("shiftright(__begin, at.size) = bin").drop("key", "at", "bin", "__begin")


def meeting(rows: DataFrame, key: Column, start: Column, end: Column, ranges: DataFrame) -> DataFrame:
    """Rows whose closed range shares a number with one of ``ranges`` (``key, range_start, range_end``) of their key.

    One does if the greatest end among ranges that start by the row's end reaches
    the row's start. That is a running maximum inside blocks of numbers, and one
    over the blocks before, so the work is a sort and no task holds a whole key.
    """
    asked = rows.select(key.alias("__key"), end.cast("bigint").alias("__at"), start.cast("bigint").alias("__start"), F.lit(1).alias("__turn"), F.lit(None).cast("bigint").alias("__end"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"))
    told = ranges.where(F.col("range_start").isNotNull()).select(F.col("key").alias("__key"), F.col("range_start").cast("bigint").alias("__at"), F.lit(0).alias("__turn"), F.col("range_end").cast("bigint").alias("__end"))
    both = asked.unionByName(told, allowMissingColumns=True).where(F.col("__key").isNotNull() & F.col("__at").isNotNull()).withColumn("__block", F.shiftright("__at", BLOCK))
    inside = Window.partitionBy("__key", "__block").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("__key", "__block").agg(F.max("__end").alias("__most")).select("__key", "__block", F.max("__most").over(before).alias("__before"))
    near = both.withColumn("__near", F.max("__end").over(inside)).where("__turn = 1")
    return near.join(blocks, ["__key", "__block"]).where(F.greatest("__near", "__before") >= F.col("__start")).select("__row.*")
