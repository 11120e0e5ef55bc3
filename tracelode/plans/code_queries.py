"""Parsing, graph building, review and merging over sources and diffs that are made from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, incremental, packs, review, search
from ..settle import parts_of, settle, shared_folder
from ..sources import diffs, repo
from .star_graph import EDGES_SQL, NODES_SQL, edges, nodes, table


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module per customer (a class with a method, a function; they call one another) and one with their base class."""
    c = repo.dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    key, region = F.col("c_custkey").cast("string"), (F.col("c_nationkey") % 5).cast("string")
    text = F.format_string(
        "import region_%s\nfrom . import base\n\nclass S%s(Base, object):\n    def load_%s(self):\n        print(self)\n        return fetch_%s(self)\n\ndef fetch_%s(x):\n    return load_%s(x)\n",
        region, key, key, key, key, key,
    )
    made = c.select(F.concat(F.lit("pkg/c"), key, F.lit(".py")).alias("relpath"), text.cast("binary").alias("content"))
    base = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("pkg/base.py").alias("relpath"), F.lit("class Base:\n    pass\n").cast("binary").alias("content"))
    both = made.unionByName(base)
    return both.select("relpath", F.lit("python").alias("language"), F.octet_length("content").cast("bigint").alias("size_bytes"), F.sha1("content").alias("sha"), "content")


def py_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = repo.chunks_of(repo.parse_files(_sources(spark, sf_dir)))
    names = ("file_relpath", "qualified_name", "kind", "parent", "signature")
    return chunks.select(*names, F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.array_join("calls", ",").alias("calls"), F.array_join("supers", ",").alias("supers"))


def py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.imports_of(repo.parse_files(_sources(spark, sf_dir))).select("importer", "target", "is_relative")


def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the parsed sources, ends by qualified name."""
    files = _sources(spark, sf_dir)
    # Parsed once, then kept without the code, as the graph reads both tables many times.
    parsed = settle(repo.parse_files(files).select(F.transform("chunks", lambda x: x.dropFields("code")).alias("chunks"), "imports"))
    made, links = graph.build_graph(files, settle(repo.chunks_of(parsed)), repo.imports_of(parsed))
    name = lambda c: made.select(F.col("id").alias(c), F.col("qualified_name").alias(f"{c}_name"))
    return links.join(name("src"), "src").join(name("dst"), "dst").select("src_name", "dst_name", "kind", "weight")


def call_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items as callees of a function each: the parser's distinct callees without common ones."""
    b = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: ~w.isin("", *_KEYWORDS))
    body = F.concat_ws("\n", F.lit("def run():"), F.lit("    print(len(dict()))"), F.lit("    __init__()"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("    "), w, F.lit("()"))), "\n"), F.lit(""))
    files = b.select(F.col("item_id").cast("string").alias("relpath"), F.lit("python").alias("language"), body.cast("binary").alias("content"))
    return repo.chunks_of(repo.parse_files(files)).select(F.col("file_relpath").cast("bigint").alias("item_id"), F.size("calls").cast("bigint").alias("n"))


_KEYWORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()


def import_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between made-up paths: absolute, relative and two levels up in Python, relative in TypeScript."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    s, script = F.col("k").cast("string"), F.col("k") % 4 == 3
    target = F.when(F.col("k") % 4 == 0, F.concat(F.lit("lib.n"), s)).when(F.col("k") % 4 == 1, F.concat(F.lit(".n"), s)).when(F.col("k") % 4 == 2, F.concat(F.lit("..n"), s)).otherwise(F.concat(F.lit("../n"), s))
    importer = F.concat(F.lit("a/b/m"), s, F.when(script, ".ts").otherwise(".py"))
    imports = c.select(importer.alias("importer"), F.when(script, "typescript").otherwise("python").alias("language"), target.alias("target"), (F.col("k") % 4 > 0).alias("is_relative"))
    made = [("lib/n%s.py", 3), ("a/b/n%s/__init__.py", 2), ("a/n%s.pyi", 5), ("a/n%s/index.ts", 7), ("a/n%s.js", 6)]
    paths = [c.where(F.col("k") % m != 0).select(F.format_string(form, s).alias("relpath")) for form, m in made]
    files = paths[0]
    for p in paths[1:]:
        files = files.unionByName(p)
    return graph.resolve_imports(graph.import_candidates(imports), files).select("importer", "target", "resolved", "weight")


def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of their users: the first one's type counts; a name that only some tell is kept."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("turn"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("name"))
    return graph.merge_nodes(seen, "turn").select("id", "kind", "name")


def graph_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations as hits, what the graph hangs on them joined to their rows (customers have none here) and ranked after."""
    hits = spark.createDataFrame([("n:1", 0.9, 1), ("n:2", 0.8, 2)], "chunk_id string, score double, rank bigint").join(nodes(spark, sf_dir).select(F.col("id").alias("chunk_id"), "name"), "chunk_id")
    seeds = hits.select(F.col("chunk_id").alias("node"), "score", (F.col("rank") - 1).cast("int").alias("seed_rank"))
    extra = graph.expand(edges(spark, sf_dir), nodes(spark, sf_dir), seeds, 12)
    chunks = nodes(spark, sf_dir).where("kind <> 'customer' or id like '%1'").select(F.col("id").alias("chunk_id"), "name")
    return graph.augment(hits, extra, chunks).select("chunk_id", "name", "source", "via", "edge", "depth", F.round("score", 4).alias("score"), "rank")


def hunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item's vector, the first three of the six nearest that have another label: all in one search."""
    v = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(v, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("own"))
    out = search.neighbours(v, asked, "label", 3)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def pack_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string"))).alias("file_relpath"), F.length("text").alias("n_chars"), F.concat(F.lit("name"), (F.col("doc_id") % 3).cast("string")).alias("name"), F.col("lang").alias("language"))
    out = packs.statistics(chunks, rebucket_at=200)
    return out.select("scope", "n_files", F.array_join("top_files", ",").alias("top_files"), F.array_join("top_names", ",").alias("top_names"), "top_language", "summary")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff per order: changed, removed (status O) or binary (status P)."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("--- a/o/"), key, F.lit(".txt\n+++ b/o/"), key, F.lit(".txt\n@@ -1,2 +1,3 @@ head\n a\n+"), F.col("o_orderstatus"), F.lit("\n-b\n+c\n"))
    gone = F.concat(F.lit("--- a/o/"), key, F.lit(".txt\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-b\n"))
    binary = F.concat(F.lit("diff --git a/o/"), key, F.lit(".txt b/o/"), key, F.lit(".txt\nBinary files differ\n"))
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", gone).when(F.col("o_orderstatus") == "P", binary).otherwise(text).alias("diff"))


def reviewable_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hunks = diffs.reviewable(diffs.diff_hunks(_diffs(spark, sf_dir)))
    return hunks.select("o_orderkey", "path", "new_start", (F.col("new_start") + F.col("new_length") - 1).alias("new_end"), F.array_join("added", ",").alias("added"), F.col("removed_count"))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the diffs of all orders, and how many were reviewed: those that have a reviewable hunk."""
    hunks = diffs.diff_hunks(_diffs(spark, sf_dir))
    return review.file_counts(hunks, diffs.reviewable(hunks))


def ask_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt over each source's documents, shown by length and digest."""
    d = table(spark, sf_dir, "documents")
    hits = d.select(F.col("source").alias("query_id"), F.col("doc_id").cast("int").alias("rank"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("citation"), F.lit("file").alias("kind"), F.col("lang").alias("qualified_name"), F.lit(0.5).alias("score"), F.col("text").alias("code"))
    out = review.ask_prompt(hits, F.concat(F.lit("what is in "), F.col("query_id"), F.lit("?")))
    return out.select("query_id", F.length("prompt").cast("bigint").alias("n_chars"), F.sha1(F.col("prompt").cast("binary")).alias("sha"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table in files by step: made, merged (with repeated keys), one language deleted, swapped."""
    import uuid

    t = incremental.VersionedTable(spark, f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", "doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    counts = []
    t.replace(d.where("n <= 1500"))
    counts.append(("made", t.read().count()))
    counts.append(("merged", t.upsert(d.where("n > 1000").unionByName(d.where("n > 2000").withColumn("n", F.col("n") + 1)), "doc_id")))
    counts.append(("with merged", t.read().count()))
    counts.append(("sum", t.read().agg(F.sum("n")).first()[0]))
    counts.append(("deleted", t.delete(d.where("lang = 'de'"), "doc_id")))
    t.swap(d.where("lang = 'de' and n > 500"), d.where("lang = 'fr'").select("doc_id"), "doc_id")
    counts.append(("swapped", t.read().count()))
    t.vacuum()
    counts.append(("at last", t.read().select("doc_id").distinct().count()))
    t.drop()
    counts.append(("dropped", int(not t.exists())))
    return spark.createDataFrame(counts, "step string, n bigint")


def graph_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the star schema written as a versioned table and read back."""
    import uuid

    t = incremental.VersionedTable(spark, f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}")
    t.replace(edges(spark, sf_dir), ["kind"])
    saved = t.read()
    return saved.repartition(parts_of(saved), "kind", "src").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"))


def findings_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "labels").select(F.lit("f").alias("file"), F.col("doc_id").alias("line"), F.when(F.col("toxic") == 1, "critical").otherwise("info").alias("severity"))
    return f.select("line", F.to_json(F.struct("file", "line", "severity")).alias("json"))


_C = "c as (select c_custkey as k, c_nationkey % 5 as r, 'pkg/c' || c_custkey || '.py' as f from customer)"
_COS = "list_cosine_similarity(v.embedding::double[], q.embedding::double[])"
_STATUS = "o as (select o_orderkey as k, o_orderstatus as st from orders)"
QUERIES = {f.__name__: f for f in (py_chunks, py_imports, graph_build, call_noise, import_resolve, node_merge, graph_augment, hunk_neighbours, pack_statistics, reviewable_hunks, review_counts, ask_prompts, table_counts, graph_saved, findings_jsonl)}
SQL = {
    "py_chunks": f"""with {_C} select 'pkg/base.py' as file_relpath, 'Base' as qualified_name, 'class' as kind, cast(null as varchar) as parent, 'class Base:' as signature, 1::bigint as start_line, 2::bigint as end_line, '' as calls, '' as supers
      union all select f, 'S' || k, 'class', null, 'class S' || k || '(Base, object):', 4, 7, 'fetch_' || k, 'Base' from c
      union all select f, 'S' || k || '.load_' || k, 'method', 'S' || k, 'def load_' || k || '(self):', 5, 7, 'fetch_' || k, '' from c
      union all select f, 'fetch_' || k, 'function', null, 'def fetch_' || k || '(x):', 9, 10, 'load_' || k, '' from c""",
    "py_imports": f"with {_C} select f as importer, 'region_' || r as target, false as is_relative from c union all select f, '.', true from c",
    "graph_build": f"""with {_C} select f as src_name, 'S' || k as dst_name, 'contains' as kind, 1.0::double as weight from c
      union all select 'S' || k, 'S' || k || '.load_' || k, 'contains', 1.0 from c union all select f, 'fetch_' || k, 'contains', 1.0 from c
      union all select 'pkg/base.py', 'Base', 'contains', 1.0
      union all select 'S' || k, 'fetch_' || k, 'calls', 0.7 from c union all select 'S' || k || '.load_' || k, 'fetch_' || k, 'calls', 0.7 from c
      union all select 'fetch_' || k, 'S' || k || '.load_' || k, 'calls', 0.7 from c
      union all select 'S' || k, 'Base', 'implements', 0.7 from c
      union all select f, 'region_' || r, 'imports', 0.3 from c union all select f, '.', 'imports', 0.3 from c""",
    "call_noise": f"""select item_id, count(distinct name) as n from (select item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as name from benchmark)
      where name not in ('', {', '.join(f"'{w}'" for w in [*_KEYWORDS, *sorted(x for x in __import__('tracelode.parsing.rows', fromlist=['x']).COMMON_CALLS if x == x.lower())])}) group by item_id""",
    "import_resolve": """with c as (select c_custkey as k, c_custkey % 4 as w from customer),
      r as (select 'a/b/m' || k || case when w = 3 then '.ts' else '.py' end as importer,
        case w when 0 then 'lib.n' || k when 1 then '.n' || k when 2 then '..n' || k else '../n' || k end as target,
        case when w = 0 and k % 3 <> 0 then 'lib/n' || k || '.py' when w = 1 and k % 2 <> 0 then 'a/b/n' || k || '/__init__.py' when w = 2 and k % 5 <> 0 then 'a/n' || k || '.pyi'
          when w = 3 and k % 6 <> 0 then 'a/n' || k || '.js' when w = 3 and k % 7 <> 0 then 'a/n' || k || '/index.ts' end as hit from c)
      select importer, target, case when hit is null then 'module:' || target else 'file:' || hit end as resolved, case when hit is null then 0.3::double else 0.5::double end as weight from r""",
    "node_merge": "select user_id as id, arg_min(event_type, event_id) as kind, cast(min(event_id) filter (where event_type = 'purchase') as varchar) as name from events group by user_id",
    "graph_augment": f"""with {EDGES_SQL}, {NODES_SQL}, s as (select * from (values ('n:1', 0.9::double, 0), ('n:2', 0.8::double, 1)) v(seed, score, rk)),
      h as (select e.dst as node, s.seed, s.score, s.rk, min(e.kind) as edge from s join edges e on e.src = s.seed and e.kind in ('calls', 'contains', 'implements') group by all),
      b as (select *, row_number() over (partition by node order by rk) as k from h),
      x as (select node, seed, edge, round(score * 0.7::double, 4) as score from b where k = 1 and node not in (select seed from s) order by 4 desc, node limit 12),
      g as (select x.*, n.name, n.kind as nk from x join nodes n on n.id = x.node where n.kind <> 'customer' or x.node like '%1')
      select seed as chunk_id, n.name, 'vector' as source, cast(null as varchar) as via, cast(null as varchar) as edge, 0::bigint as depth, score, rk + 1 as rank from s join nodes n on n.id = s.seed
      union all select node, name, 'graph', seed, edge, 1, score, 2 + row_number() over (order by score desc, node) from g""",
    "hunk_neighbours": f"""with p as (select q.vec_id as query_id, v.vec_id, {_COS} as s, v.label <> q.label as far, row_number() over (partition by q.vec_id order by round({_COS}, 12) desc, v.vec_id) as r
      from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark)),
      n as (select *, row_number() over (partition by query_id order by r) as rank from p where r <= 6 and far) select query_id, vec_id, round(s, 6) as score, rank from n where rank <= 3""",
    "pack_statistics": """with d as (select source as t1, source || '/' || lang as t2, source || '/' || lang || '/f' || doc_id % 7 as f, 'name' || doc_id % 3 as nm, lang from documents),
      b as (select *, case when count(*) over (partition by t1) > 200 then t2 else t1 end as key from d),
      rf as (select key, f, row_number() over (partition by key order by count(*) desc, f) as r from b group by key, f),
      rn as (select key, nm, row_number() over (partition by key order by count(*) desc, nm) as r from b group by key, nm),
      rl as (select key, lang, row_number() over (partition by key order by count(*) desc, lang) as r from b group by key, lang),
      n as (select key, count(*) as c, count(distinct f) as n_files from b group by key)
      select n.key || '/**' as scope, n_files, (select string_agg(f, ',' order by r) from rf where rf.key = n.key and r <= 5) as top_files, (select string_agg(nm, ',' order by r) from rn where rn.key = n.key and r <= 5) as top_names,
        rl.lang as top_language, c || ' chunks across ' || n_files || ' files in ' || n.key || '/ (' || rl.lang || ').' as summary from n join rl on rl.key = n.key and rl.r = 1""",
    "reviewable_hunks": f"with {_STATUS} select k as o_orderkey, 'o/' || k || '.txt' as path, 1 as new_start, 3 as new_end, '2,3' as added, 1 as removed_count from o where st not in ('O', 'P')",
    "review_counts": f"with {_STATUS} select count(*) as files, count(*) filter (where st not in ('O', 'P')) as files_reviewed, count(*) filter (where st in ('O', 'P')) as files_skipped from o",
    "ask_prompts": """with p as (select source as query_id, string_agg('[' || doc_id || '] ' || source || ':' || doc_id || '  (file ' || lang || ', score=0.500)' || chr(10) || '```' || chr(10)
      || case when length(text) > 2000 then substr(text, 1, 2000) || chr(10) || '… (truncated)' else text end || chr(10) || '```', chr(10) || chr(10) order by doc_id) || chr(10) || chr(10) || 'Question: what is in ' || source || '?' as p from documents group by source)
      select query_id, length(p) as n_chars, sha1(p) as sha from p""",
    "table_counts": """with d as (select doc_id, lang, length(text) as n from documents), a as (select doc_id, lang, case when n > 2000 then n + 1 else n end as n from d where n <= 1500 or n > 1000),
      z as (select doc_id from a where lang not in ('de', 'fr') union select doc_id from d where lang = 'de' and n > 500)
      select 'made' as step, count(*) as n from d where n <= 1500 union all select 'merged', count(*) from d where n > 1000 union all select 'with merged', count(*) from a
      union all select 'sum', cast(sum(n) as bigint) from a union all select 'deleted', count(*) from a where lang = 'de' union all select 'swapped', count(*) from z union all select 'at last', count(*) from z union all select 'dropped', 1""",
    "graph_saved": f"with {EDGES_SQL} select kind, count(*) as n, count(distinct src) as n_src from edges group by kind",
    "findings_jsonl": """select doc_id as line, '{"file":"f","line":' || doc_id || ',"severity":"' || case when toxic = 1 then 'critical' else 'info' end || '"}' as json from labels""",
}
