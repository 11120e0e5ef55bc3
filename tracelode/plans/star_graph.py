"""A code-like graph over the star schema, and its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settle import parts_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    def edge(df, src, dst, kind):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    def pairs(df, *keys):
        return df.select(*keys).repartition(parts_of(df), *keys).distinct()

    parts = [
        edge(t("nation"), _id("r:", "n_regionkey"), _id("n:", "n_nationkey"), "contains"),
        edge(t("customer"), _id("n:", "c_nationkey"), _id("c:", "c_custkey"), "contains"),
        edge(t("orders"), _id("c:", "o_custkey"), _id("o:", "o_orderkey"), "contains"),
        edge(t("supplier"), _id("n:", "s_nationkey"), _id("s:", "s_suppkey"), "contains"),
        edge(pairs(t("lineitem"), "l_orderkey", "l_partkey"), _id("o:", "l_orderkey"), _id("p:", "l_partkey"), "calls"),
        edge(pairs(t("lineitem"), "l_suppkey", "l_partkey"), _id("s:", "l_suppkey"), _id("p:", "l_partkey"), "imports"),
        edge(t("part"), _id("p:", "p_partkey"), _id("b:", "p_brand"), "implements"),
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    def node(df, id_, kind, name):
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"))

    parts = [
        node(t("region"), _id("r:", "r_regionkey"), "region", F.col("r_name")),
        node(t("nation"), _id("n:", "n_nationkey"), "nation", F.col("n_name")),
        node(t("customer"), _id("c:", "c_custkey"), "customer", F.col("c_name")),
        node(t("orders"), _id("o:", "o_orderkey"), "order", F.col("o_orderstatus")),
        node(t("supplier"), _id("s:", "s_suppkey"), "supplier", F.col("s_name")),
        node(t("part"), _id("p:", "p_partkey"), "part", F.col("p_name")),
        node(t("part").select("p_brand").distinct(), _id("b:", "p_brand"), "brand", F.col("p_brand")),
    ]
    return reduce(DataFrame.unionByName, parts)


EDGES_SQL = """edges as (
  select 'r:' || n_regionkey as src, 'n:' || n_nationkey as dst, 'contains' as kind from nation
  union all select 'n:' || c_nationkey, 'c:' || c_custkey, 'contains' from customer
  union all select 'c:' || o_custkey, 'o:' || o_orderkey, 'contains' from orders
  union all select 'n:' || s_nationkey, 's:' || s_suppkey, 'contains' from supplier
  union all select distinct 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' from lineitem
  union all select distinct 's:' || l_suppkey, 'p:' || l_partkey, 'imports' from lineitem
  union all select 'p:' || p_partkey, 'b:' || p_brand, 'implements' from part)"""
NODES_SQL = """nodes as (
  select 'r:' || r_regionkey as id, 'region' as kind, r_name as name from region
  union all select 'n:' || n_nationkey, 'nation', n_name from nation
  union all select 'c:' || c_custkey, 'customer', c_name from customer
  union all select 'o:' || o_orderkey, 'order', o_orderstatus from orders
  union all select 's:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'p:' || p_partkey, 'part', p_name from part
  union all select distinct 'b:' || p_brand, 'brand', p_brand from part)"""
