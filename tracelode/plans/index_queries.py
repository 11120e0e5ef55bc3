"""Packs, incremental indexing, review, metering and repository parsing over the driver's tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_regex
from ..operators import incremental, meter, packs, review
from ..operators.embedding import embed_column, hashing_embedder
from ..operators.intervals import islands
from ..sources import diffs, repo
from ..streaming import incremental as streams
from .star_graph import table

_PRIOR_SHA = "was-edited"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.length("html").alias("n_chars"))


def pack_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.suggest(_page_paths(spark, sf_dir), "path", rebucket_at=100)


_PACKS = [("pack_english", ["en/**"]), ("pack_french", ["fr/*"]), ("pack_sevens", ["*/7*"]), ("pack_two_digits", ["de/[0-9][0-9]", "es/??"]), ("pack_not_low", ["en/[!1-4]*"])]


def pack_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = packs.tag_paths(_page_paths(spark, sf_dir), _PACKS, "path")
    return tagged.select("page_id", F.array_join("packs", ",").alias("packs"))


def retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose tags change when the pack list does."""
    old = packs.tag_paths(_page_paths(spark, sf_dir), _PACKS[:3], "path", "old")
    both = packs.tag_paths(old, _PACKS, "path", "new")
    return both.where(F.col("old") != F.col("new")).select("page_id", F.array_join("new", ",").alias("packs"))


def _pack_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("pack_"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).alias("id"), F.initcap("n_name").alias("label"), (F.col("n_nationkey") % 2 == 0).alias("auto"))


def pack_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack_table(spark, sf_dir).orderBy("label")


def pack_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _pack_table(spark, sf_dir)
    new = old.where("auto").select("id", F.concat("label", F.lit(" 2")).alias("label"), "auto")
    return packs.upsert_packs(old, new)


def pack_delete_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.delete_auto(_pack_table(spark, sf_dir))


def active_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = lambda c: F.concat(F.lit("pack_"), c.cast("string"))
    k = F.col("c_custkey")
    state = c.select("c_custkey", F.array(key(k % 3), key(k % 5)).alias("pinned"), F.array(key(k % 7), key(k % 3)).alias("attached"), F.array(key(k % 2)).alias("excluded"))
    return packs.active_packs(state).select("c_custkey", F.array_join("active", ",").alias("active"))


def pack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    ids = r.select(F.concat(F.lit("pack_"), F.lower("r_name")).alias("id")).union(_pack_table(spark, sf_dir).where("auto").select("id"))
    return packs.pack_status(ids, _pack_table(spark, sf_dir).select("id", "label")).select("id", "status")


def pack_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import humanise, slug

    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" / "), "p_brand").alias("label"))
    return p.select("p_partkey", slug(F.col("label")).alias("slug"), humanise(F.lower("label")).alias("title"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("relpath"), F.sha1(F.col("text").cast("binary")).alias("sha"), "doc_id", "lang", "text")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("doc_id % 10 <> 0")
    kept = f.select("relpath", F.when(F.col("doc_id") % 7 == 0, _PRIOR_SHA).otherwise(F.col("sha")).alias("sha"))
    return kept.unionByName(spark.range(20).select(F.concat(F.lit("gone-"), F.col("id").cast("string")).alias("relpath"), F.lit("x").alias("sha")))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.manifest_diff(_files(spark, sf_dir), _manifest(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.index_stats(incremental.manifest_diff(_files(spark, sf_dir), _manifest(spark, sf_dir)))


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).withColumn("model", F.lit("m"))
    cache = f.where("lang = 'en'").select("model", "sha", F.array(F.lit(1.0)).alias("vector"))
    return incremental.cache_split(f, cache).groupBy("status").agg(F.count("*").alias("n_texts"), F.countDistinct("sha").alias("n_distinct"))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with all files merged in, every third of them twice: of repeated keys the greater digest stays."""
    f = _files(spark, sf_dir)
    new = f.select("relpath", "sha").unionByName(f.where("doc_id % 3 = 0").select("relpath", F.concat(F.lit("again-"), "relpath").alias("sha")))
    return incremental.upsert(_manifest(spark, sf_dir), new, "relpath")


def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _files(spark, sf_dir).where("lang = 'de'").select("relpath")
    return incremental.delete_where(_files(spark, sf_dir), gone, "relpath").select("doc_id", "sha")


def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    folder = F.get(F.array(*[F.lit(x) for x in ("src", "node_modules/a", ".git", "a/dist", "lib/.hidden", "a/b")]), (k % 6).cast("int"))
    path = F.concat(folder, F.lit("/f"), k.cast("string"), F.when(k % 5 == 0, ".md").otherwise(".py"))
    size = F.when(k % 11 == 0, 0).when(k % 13 == 0, 2_000_000).otherwise(F.length("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("relpath"), size.alias("length"))
    return pages.where(repo.walk_filter(F.col("relpath"), F.col("length"))).select("page_id", "relpath")


def hunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    chunks = d.select("source", "doc_id", F.col("source").alias("path"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + F.size(F.split("text", "\n")) - 1).alias("end_line"), F.col("doc_id").alias("chunk_id"))
    start = F.expr("doc_id div 10 * 10")
    hunks = d.select("source", start.alias("new_start")).distinct().select(F.col("source").alias("path"), F.concat_ws(":", "source", F.col("new_start").cast("string")).alias("hunk_id"), "new_start", (F.col("new_start") + 3).alias("new_end"))
    return review.containing(hunks, chunks.drop("source", "doc_id")).select("hunk_id", F.col("chunk_id").alias("doc_id"), "rank")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "medium").otherwise("info")
    return table(spark, sf_dir, "labels").select(F.lit("f").alias("file"), F.col("doc_id").alias("line"), F.lit(None).cast("bigint").alias("end_line"), severity.alias("severity"), "doc_id")


def clamp_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = table(spark, sf_dir, "documents").where("doc_id % 5 in (1, 2)").select(F.lit("f").alias("path"), "doc_id")
    return review.clamp(_findings(spark, sf_dir), islands(added, ["path"], "doc_id")).select("doc_id", "severity")


def findings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.select("doc_id", "severity", review.rank_of(F.col("severity")).cast("bigint").alias("rank")).orderBy(F.desc("rank"), "doc_id")


def findings_by_sev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(_findings(spark, sf_dir))


def pr_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    wide = f.select("file", F.col("line").cast("int").alias("line"), F.when(F.col("doc_id") % 3 == 0, F.col("line") + 2).cast("int").alias("end_line"), "severity", F.lit("style").alias("category"), F.lit("check").alias("message"), F.lit(None).cast("string").alias("fix"), F.lit(0.5).alias("confidence"), "doc_id")
    return review.comment_payload(wide).select("doc_id", "payload")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    use = c.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("role") == "user", n)), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(F.col("role") != "user", n)), F.lit(0)).alias("output_tokens"))
    model = F.get(F.array(*[F.lit(m) for m in ("small", "medium", "large", "unknown")]), (F.col("conv_id") % 4).cast("int"))
    return use.select("conv_id", F.lit("tier").alias("provider"), model.alias("model"), "input_tokens", "output_tokens")


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = meter.price_usage(_usage(spark, sf_dir), meter.price_table(spark))
    return out.select("conv_id", "model", "input_tokens", "output_tokens", F.round("total_usd", 9).alias("total_usd"))


def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("text").alias("code"), F.lit("how does it work").alias("question"))
    return meter.prompt_tokens(d)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed_counts(e)
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    diff = F.concat(F.lit("--- a/o/"), key, F.lit(".txt\n+++ b/o/"), key, F.lit(".txt\n@@ -1,2 +1,3 @@ head\n a\n+"), F.col("o_orderstatus"), F.lit("\n-b\n+c\n"))
    return diffs.diff_hunks(o.select("o_orderkey", diff.alias("diff"))).select("o_orderkey", "path", "new_start", "new_length", F.array_join("added", ",").alias("added"), "removed_count")


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing vectors of whole documents, shown by their digests."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", embed_column(F.col("text"), hashing_embedder(64)).alias("v")).select("doc_id", F.size("v").alias("dim"), F.sha1(F.array_join(F.transform("v", lambda x: F.round(x.cast("double"), 4).cast("string")), ",").cast("binary")).alias("sha"))


_PATHS = "paths as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) as path, length(html) as n_chars from pages)"


def _tag_sql(pack_list: list) -> str:
    cases = ", ".join("case when " + " or ".join(f"regexp_full_match(path, '{glob_regex(g)[5:-1]}', 's')" for g in globs) + f" then '{p}' end" for p, globs in pack_list)
    return f"array_to_string(list_filter([{cases}], lambda x: x is not null), ',')"


_FILES = "f as (select cast(doc_id as varchar) as relpath, sha1(text) as sha, doc_id, lang from documents), m as (select relpath, case when doc_id % 7 = 0 then 'was-edited' else sha end as sha from f where doc_id % 10 <> 0 union all select 'gone-' || i, 'x' from range(20) t(i))"
_DIFF = f"{_FILES}, x as (select case when m.sha is null then 'new' when f.sha is null then 'gone' when f.sha = m.sha then 'reused' else 'changed' end as status from f full join m on f.relpath = m.relpath)"
_PACK = "pk as (select 'pack_' || lower(replace(n_name, ' ', '_')) as id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as label, n_nationkey % 2 = 0 as auto from nation)"
_FIND = "fi as (select doc_id, case when toxic = 1 then 'critical' when quality = 0 then 'medium' else 'info' end as severity from labels)"
_REGEX_TITLE = "array_to_string(list_transform(string_split(translate(lower(label), '-_', '  '), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
QUERIES = {f.__name__: f for f in (pack_suggest, pack_tag, retag, pack_list, pack_upsert, pack_delete_auto, active_packs, pack_status, pack_slugs, manifest_diff, index_stats, cache_hit_miss, upsert_merge, delete_by_file, scan_filter, hunk_overlap, clamp_findings, findings_sorted, findings_by_sev, pr_payload, cost_estimate, prompt_tokens, event_windows, diff_hunks, embed_documents)}
SQL = {
    "pack_suggest": f"""with {_PATHS}, p as (select string_split(path, '/') as s, n_chars from paths), q as (select s[1] as top1, s[1] || '/' || s[2] as top2, n_chars from p where len(s) >= 2),
      c as (select *, count(*) over (partition by top1) as t from q), k as (select case when t > 100 then top2 else top1 end as key, n_chars from c),
      g as (select key, count(*) as chunk_count, sum(n_chars) as n from k group by key having count(*) >= 3),
      o as (select trim(regexp_replace(lower(key), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as b, replace(key, '/', ' / ') as label, key, chunk_count, n from g)
      select case when starts_with(b, 'pack_') then b else 'pack_' || b end as pack_id, {_REGEX_TITLE} as label, key || '/**' as scope, chunk_count, cast(greatest(1, n // 4) as bigint) as token_estimate
      from o order by chunk_count desc, 2 limit 40""",
    "pack_tag": f"with {_PATHS} select page_id, {_tag_sql(_PACKS)} as packs from paths",
    "retag": f"with {_PATHS} select page_id, {_tag_sql(_PACKS)} as packs from paths where {_tag_sql(_PACKS)} <> {_tag_sql(_PACKS[:3])}",
    "pack_list": f"with {_PACK} select * from pk order by label",
    "pack_upsert": f"with {_PACK} select id, case when auto then label || ' 2' else label end as label, auto from pk",
    "pack_delete_auto": f"with {_PACK} select * from pk where not auto",
    "active_packs": """with s as (select c_custkey, ['pack_' || c_custkey % 3, 'pack_' || c_custkey % 5, 'pack_' || c_custkey % 7, 'pack_' || c_custkey % 3] as a, 'pack_' || c_custkey % 2 as x from customer)
      select c_custkey, array_to_string(list_filter(a, lambda p, i: list_position(a, p) = i and p <> x), ',') as active from s""",
    "pack_status": f"with {_PACK}, i as (select 'pack_' || lower(r_name) as id from region union all select id from pk where auto) select i.id, case when pk.id is null then 'orphaned' else 'active' end as status from i left join pk on pk.id = i.id",
    "pack_slugs": f"with l as (select p_partkey, p_type || ' / ' || p_brand as label from part) select p_partkey, 'pack_' || trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') as slug, {_REGEX_TITLE} as title from l",
    "manifest_diff": f"with {_DIFF} select status, count(*) as n from x group by status",
    "index_stats": f"with {_DIFF} select count(*) filter (where status in ('new', 'changed')) as indexed, count(*) filter (where status = 'reused') as reused, count(*) filter (where status = 'gone') as gone, count(*) filter (where status in ('changed', 'gone')) as stale_deletes from x",
    "cache_hit_miss": f"with {_FILES} select case when sha in (select sha from f where lang = 'en') then 'hit' else 'miss' end as status, count(*) as n_texts, count(distinct sha) as n_distinct from f group by 1",
    "upsert_merge": f"with {_FILES}, n as (select relpath, sha from f union all select relpath, 'again-' || relpath from f where doc_id % 3 = 0) select relpath, sha from m where relpath not in (select relpath from f) union all select relpath, max(sha) from n group by relpath",
    "delete_by_file": f"with {_FILES} select doc_id, sha from f where lang <> 'de'",
    "scan_filter": """with p as (select page_id, ['src', 'node_modules/a', '.git', 'a/dist', 'lib/.hidden', 'a/b'][page_id % 6 + 1] || '/f' || page_id || case when page_id % 5 = 0 then '.md' else '.py' end as relpath,
      case when page_id % 11 = 0 then 0 when page_id % 13 = 0 then 2000000 else length(html) end as n from pages)
      select page_id, relpath from p where page_id % 6 in (0, 5) and page_id % 5 <> 0 and n > 0 and n <= 1500000""",
    "hunk_overlap": """with c as (select source, doc_id, doc_id as s, doc_id + len(string_split(text, chr(10))) - 1 as e from documents), h as (select distinct source, doc_id // 10 * 10 as hs from documents),
      o as (select h.source || ':' || hs as hunk_id, doc_id, row_number() over (partition by h.source, hs order by e - s, s, doc_id) as rank from h join c on c.source = h.source and s <= hs + 3 and e >= hs)
      select * from o where rank <= 16""",
    "clamp_findings": f"with {_FIND} select doc_id, severity from fi where doc_id % 5 in (1, 2) and doc_id in (select doc_id from documents)",
    "findings_sorted": f"with {_FIND} select doc_id, severity, cast(case severity when 'critical' then 5 when 'medium' then 3 else 1 end as bigint) as rank from fi order by rank desc, doc_id",
    "findings_by_sev": f"with {_FIND} select severity, count(*) as n from fi group by severity",
    "pr_payload": f"""with {_FIND} select doc_id, '{{"path":"f","body":"' || upper(severity) || ' **style** — check\\n\\n_confidence: 0.50_",' || case when doc_id % 3 = 0 then '"start_line":' || doc_id || ',"start_side":"RIGHT","line":' || (doc_id + 2)
      else '"line":' || doc_id end || ',"side":"RIGHT"}}' as payload from fi where doc_id > 0""",
    "diff_hunks": "select o_orderkey, 'o/' || o_orderkey || '.txt' as path, 1 as new_start, 3 as new_length, '2,3' as added, 1 as removed_count from orders",
    "cost_estimate": """with u as (select conv_id, ['small', 'medium', 'large', 'unknown'][conv_id % 4 + 1] as model, cast(coalesce(sum(greatest(1, length(text) // 4)) filter (where role = 'user'), 0) as bigint) as input_tokens,
      cast(coalesce(sum(greatest(1, length(text) // 4)) filter (where role <> 'user'), 0) as bigint) as output_tokens from conversations group by conv_id),
      p as (select * from (values ('small', 1.0::double, 5.0::double), ('medium', 3.0::double, 15.0::double), ('large', 15.0::double, 75.0::double)) v(model, i, o))
      select conv_id, u.model, input_tokens, output_tokens, round(input_tokens * i / 1000000 + output_tokens * o / 1000000, 9) as total_usd from u left join p on p.model = u.model""",
    "prompt_tokens": "select source as query_id, cast((sum(least(length(text), 2000)) + 16 + 800) // 4 as bigint) as prompt_tokens from documents group by source",
    "event_windows": "select cast(epoch(time_bucket(interval '1 hour', ts::timestamp)) as bigint) as window_start, event_type, count(*) as n from events group by 1, 2",
}
