"""Graph operators over the star-schema graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intervals
from . import star_graph as g
from .star_graph import EDGES_SQL, NODES_SQL, table

_START = "p:12"
_EXPOSED = ("region", "order")


def _starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node string")


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.nodes(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = g.nodes(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes"))
    e = g.edges(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("what", F.lit("edges"))
    return n.unionByName(e).select("what", "n")


def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident_edges(g.edges(spark, sf_dir), _starts(spark, "n:1")).select("direction", "node", "kind")


def bfs_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(g.edges(spark, sf_dir), _starts(spark, _START), "in", 3).select("node", F.col("depth").cast("bigint").alias("depth"))


def bfs_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bfs(g.edges(spark, sf_dir), _starts(spark, "n:1"), "out", 2, ("contains",)).select("node", F.col("depth").cast("bigint").alias("depth"))


def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(g.nodes(spark, sf_dir), g.edges(spark, sf_dir), _starts(spark, _START), 3, exposed=_EXPOSED)


def impact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first 25 rows: a top-k is what it prints."""
    return impact(spark, sf_dir).orderBy(F.desc("score"), "depth", "node").limit(25)


def impact_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.risk(impact(spark, sf_dir))


def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    nodes = g.nodes(spark, sf_dir).select("id", "kind", "name", F.concat("kind", F.lit("."), "name").alias("qualified_name"), none.alias("file_relpath"))
    wanted = spark.createDataFrame([("p:12",), ("region.ASIA",), ("FRANCE",), ("nation.FRANCE",), ("nowhere",)], "target string")
    return graph.resolve_targets(nodes, wanted).select("id", F.col("way").cast("bigint").alias("way"))


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("n:1", 0.9, 0), ("n:2", 0.8, 1)], "node string, score double, seed_rank int")
    return graph.expand(g.edges(spark, sf_dir), g.nodes(spark, sf_dir), seeds).select("node", "via", "edge", "score")


def implements_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to the brand they name, joined by name."""
    part = table(spark, sf_dir, "part")
    chunks = part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.lit("class").alias("kind"), F.col("p_name").alias("name"), F.array("p_brand").alias("supers"))
    brands = part.select("p_brand").distinct().select(F.concat(F.lit("b:"), "p_brand").alias("chunk_id"), F.lit("interface").alias("kind"), F.col("p_brand").alias("name"), F.array().cast("array<string>").alias("supers"))
    return graph.implements_edges(chunks.unionByName(brands)).select("src", "dst", "kind")


def dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to part once however many lines say so, without loops and dangling ends."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("calls").alias("kind"), F.lit(0.7).alias("weight"))
    loops = e.select("src", F.col("src").alias("dst"), "kind", "weight")
    return graph.clean_edges(e.unionByName(loops), g.nodes(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def parent_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's latest earlier purchase of the same user: the parent resolution of chunks."""
    e = table(spark, sf_dir, "events")
    chunks = e.select(
        F.col("event_id").cast("string").alias("chunk_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_relpath"),
        F.lit("purchase").alias("parent"), F.col("event_type").alias("qualified_name"), F.col("event_id").alias("emit_seq"),
    )
    return graph.contains_edges(chunks).select("src", "dst")


def diff_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, lines as code: changed lines 2 to 3 of every order hit the line items they overlap."""
    li = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    line = F.col("l_linenumber")
    code = li.select(F.concat_ws("/", path, line.cast("string")).alias("id"), F.lit("function").alias("kind"), path.alias("file_relpath"), line.alias("start_line"), (line + 1).alias("end_line"))
    files = li.select(path.alias("id"), F.lit("file").alias("kind"), path.alias("file_relpath"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")).distinct()
    orders = table(spark, sf_dir, "orders")
    ranges = orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(2).alias("range_start"), F.lit(3).alias("range_end"))
    return graph.diff_targets(files.unionByName(code), ranges)


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


_REACH = """reach as (select node, min(depth) as depth from walk group by node)"""
_WALK_IN = f"""walk(node, depth) as (select '{_START}', 0 union select e.src, w.depth + 1 from walk w join edges e on e.dst = w.node where w.depth < 3)"""
_IMPACT = f"""with recursive {EDGES_SQL}, {NODES_SQL}, {_WALK_IN}, {_REACH},
via as (select e.src as node, string_agg(distinct e.kind, ',' order by e.kind) as via,
  max(case e.kind when 'calls' then 1.0 when 'implements' then 0.7 when 'contains' then 0.6 when 'imports' then 0.5 end::double) as w
  from edges e join reach r on e.dst = r.node where r.depth < 3 group by e.src),
impact as (select r.node, n.kind, cast(r.depth as bigint) as depth, via.via,
  round(w * case when n.kind in ('region', 'order') then 1.15::double else 1.0::double end / greatest(r.depth, 1), 4) as score
  from reach r join via on via.node = r.node join nodes n on n.id = r.node where r.depth > 0)"""

QUERIES = {f.__name__: f for f in (edge_counts, node_counts, graph_totals, neighbors_1hop, bfs_in, bfs_out, impact, impact_top, impact_by_kind, impact_risk, resolve_targets, graph_expand, implements_edges, dedupe_edges, parent_asof, diff_targets, islands)}
SQL = {
    "edge_counts": f"with {EDGES_SQL} select kind, count(*) as n from edges group by kind",
    "node_counts": f"with {NODES_SQL} select kind, count(*) as n from nodes group by kind",
    "graph_totals": f"with {EDGES_SQL}, {NODES_SQL} select 'nodes' as what, count(*) as n from nodes union all select 'edges', count(*) from edges",
    "neighbors_1hop": f"with {EDGES_SQL} select 'out' as direction, dst as node, kind from edges where src = 'n:1' union all select 'in', src, kind from edges where dst = 'n:1'",
    "bfs_in": f"with recursive {EDGES_SQL}, {_WALK_IN} select node, cast(min(depth) as bigint) as depth from walk group by node",
    "bfs_out": f"""with recursive {EDGES_SQL}, walk(node, depth) as (select 'n:1', 0 union select e.dst, w.depth + 1 from walk w
      join edges e on e.src = w.node where w.depth < 2 and e.kind = 'contains') select node, cast(min(depth) as bigint) as depth from walk group by node""",
    "impact": f"{_IMPACT} select * from impact",
    "impact_top": f"{_IMPACT} select * from impact order by score desc, depth, node limit 25",
    "impact_by_kind": f"{_IMPACT} select kind, count(*) as n from impact group by kind",
    "impact_risk": f"""{_IMPACT}, c as (select count(*) as n_affected, count(*) filter (where depth = 1) as n_direct from impact)
      select n_affected, n_direct, case when n_affected = 0 then 'none' when n_direct >= 10 or n_affected >= 40 then 'critical'
      when n_direct >= 4 or n_affected >= 15 then 'high' when n_direct >= 1 or n_affected >= 5 then 'medium' else 'low' end as risk from c""",
    "resolve_targets": f"""with {NODES_SQL}, w as (select unnest(['p:12', 'region.ASIA', 'FRANCE', 'nation.FRANCE', 'nowhere']) as target),
      h as (select id, 0 as way from nodes join w on id = target union all select id, 1 from nodes join w on kind || '.' || name = target
      union all select id, 2 from nodes join w on name = target) select id, cast(min(way) as bigint) as way from h group by id""",
    "graph_expand": f"""with {EDGES_SQL}, {NODES_SQL}, s as (select * from (values ('n:1', 0.9::double, 0), ('n:2', 0.8::double, 1)) v(seed, score, rk)),
      h as (select e.dst as node, s.seed, s.score, s.rk, min(e.kind) as edge from s join edges e on e.src = s.seed and e.kind in ('calls', 'contains', 'implements') group by all),
      b as (select *, row_number() over (partition by node order by rk) as k from h)
      select node, seed as via, edge, round(score * 0.7::double, 4) as score from b where k = 1 and node not in (select seed from s) order by 4 desc, node limit 8""",
    "implements_edges": "select 'p:' || p_partkey as src, 'b:' || p_brand as dst, 'implements' as kind from part",
    "dedupe_edges": "select 'calls' as kind, count(*) as n from (select distinct l_orderkey, l_partkey from lineitem where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part))",
    "parent_asof": """select coalesce((select cast(max(p.event_id) as varchar) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.event_id < e.event_id),
      'file:u' || e.user_id) as src, cast(e.event_id as varchar) as dst from events e""",
    "diff_targets": """select distinct 'o' || l_orderkey as id from lineitem where l_orderkey in (select o_orderkey from orders)
      union all select distinct 'o' || l_orderkey || '/' || l_linenumber from lineitem where l_linenumber <= 3 and l_linenumber + 1 >= 2 and l_orderkey in (select o_orderkey from orders)""",
    "islands": """select l_orderkey, min(n) as range_start, max(n) as range_end from (select l_orderkey, n, n - row_number() over (partition by l_orderkey order by n) as run
      from (select distinct l_orderkey, cast(l_linenumber as bigint) as n from lineitem)) group by l_orderkey, run""",
}
