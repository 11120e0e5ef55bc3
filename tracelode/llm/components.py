"""Connected components of an edge table by alternating stars.

Each round points every node at the smallest neighbour, first from its larger
neighbours (large star), then from its smaller ones (small star). Only
aggregations and joins are used; rounds are cut at shared files, and nothing
but two totals per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``(u, v)`` with v < u; both stars keep components as they are."""
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its least node.

    ``edges`` has two columns of equal, orderable type; their order, repeats and
    loops don't matter. No edges: no rows.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "components")
    told = None
    # Every round that changes anything brings some node a smaller neighbour, so the rounds end.
    while True:
        now = cut(_star(_star(now, True), False), "components")
        total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))).first()
        if total == told or not total[0]:
            break
        told = total
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()).distinct()
