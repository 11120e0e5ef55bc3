"""Search, text and prompt operators over documents, benchmark questions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import search
from .star_graph import table

_QUERY = 7


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    return v.where(F.col("vec_id") != _QUERY), v.where(F.col("vec_id") == _QUERY).select(F.col("embedding").alias("q"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _vectors(spark, sf_dir)
    out = search.nearest(vectors, q)
    return out.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


def pack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, q = _vectors(spark, sf_dir)
    out = search.nearest(vectors.where(search.in_packs(F.array("label"), [3, 9])), q)
    return out.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    asked = v.where(F.col("vec_id") == _QUERY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("own"))
    return search.neighbours(v.where(F.col("vec_id") != _QUERY), asked, "label").select("vec_id", F.round("score", 6).alias("score"), "rank")


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest of every benchmark item's vector among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(v, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = search.batch_nearest(v, queries)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = t.query_terms(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(terms).cast("bigint").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def _lexical(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").where("item_id = 0").select(t.query_terms(F.col("text")).alias("terms"))
    first = F.coalesce(F.get(F.split("text", " "), 0), F.lit(""))
    scored = docs.join(F.broadcast(q))
    return scored.withColumn("lex", t.lexical_score(F.col("terms"), first, F.concat_ws("/", "source", "lang"), F.col("text"))).drop("terms")


def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, table(spark, sf_dir, "documents")).select("doc_id", "lex")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    dense = v.where(F.col("vec_id") != _QUERY).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    pool = search.nearest(dense, v.where(F.col("vec_id") == _QUERY).select(F.col("embedding").alias("q")), search.POOL).select(F.col("vec_id").alias("doc_id"), "score")
    lex = _lexical(spark, sf_dir, table(spark, sf_dir, "documents").join(F.broadcast(pool), "doc_id"))
    out = search.fuse_ranks(lex.select("doc_id", "score", "lex"), id="doc_id")
    return out.select("doc_id", "dense_rank", "lex_rank", F.round("rrf", 9).alias("rrf"), "rank")


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.signature(F.col("text")).alias("signature"))


def chunk_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    cut = t.truncate_code(F.col("text"), path, F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("bigint").alias("n_chars"), F.sha1(cut.cast("binary")).alias("sha"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", "lang", path.alias("path"), F.sha1(F.col("text").cast("binary")).alias("sha"), F.posexplode(F.split("text", "\n")).alias("n", "line"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("n").cast("bigint").alias("n"), t.citation(F.col("path"), F.col("n") + 1, F.col("n") + 1).alias("citation"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("n").cast("bigint").alias("n"), t.chunk_id(F.col("path"), F.col("n"), F.col("n") + 1, F.col("sha")).alias("chunk_id"))


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = t.embed_text(F.col("lang"), F.lit("file"), F.col("source"), t.signature(F.col("text")), F.col("text"))
    return d.select("doc_id", F.sha1(text.cast("binary")).alias("sha"), F.length(text).cast("bigint").alias("n_chars"))


def chunks_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_files"))


def _kind():
    return F.when(F.length("line") == 0, "empty").when(F.length("line") < 80, "short").otherwise("long")


def chunks_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy(_kind().alias("kind")).agg(F.count("*").alias("n"))


def chunks_by_lang_kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("kind", _kind()).rollup("lang", "kind").agg(F.count("*").alias("n"))


def chunks_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("line"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(x) for x in ("py", "PYI", "js", "mjs", "ts", "tsx", "go", "rs", "java", "txt", "")]), (F.col("page_id") % 11).cast("int"))
    path = F.concat_ws(".", F.col("page_id").cast("string"), suffix)
    return table(spark, sf_dir, "pages").select("page_id", t.language_of(path).alias("language"))


def content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.content_sha(F.col("text")).alias("sha"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties wrapped as models wrap answers: plain, fenced, in prose, or broken."""
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
    raw = raw.when(F.col("event_id") % 4 == 2, F.concat(F.lit("Sure, "), "props", F.lit(" as asked"))).otherwise("no json here")
    return e.select("event_id", t.lenient_json(raw).alias("json"))


_COS = "list_cosine_similarity(v.embedding::double[], q.embedding::double[])"
_TERMS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 3 and not list_contains([" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + "], x))"
_LEX = f"""terms as (select unnest({_TERMS.format('text')}) as term from benchmark where item_id = 0),
 d as (select doc_id, string_split_regex(lower(split_part(text, ' ', 1)), '[^a-z0-9]+') as nm, string_split_regex(lower(source || '/' || lang), '[^a-z0-9]+') as pt, lower(substr(text, 1, 2000)) as body from documents),
 lx as (select doc_id, coalesce(sum(case when list_contains(nm, term) then 3.0::double when list_contains(pt, term) then 2.0::double when contains(body, term) then 0.5::double else 0.0::double end), 0) as lex from d, terms group by doc_id)"""
_LINES = "lines as (select doc_id, lang, source || '/' || lang || '/' || doc_id || '.txt' as path, sha1(text) as sha, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents)"
_SIG = "coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '')"
_KIND_SQL = "case when length(line) = 0 then 'empty' when length(line) < 80 then 'short' else 'long' end"
QUERIES = {f.__name__: f for f in (cosine_topk, pack_filter, neighbors, batch_search, query_terms, lexical_score, rrf_hybrid, signature, chunk_truncate, citations, chunk_ids, embed_texts, chunks_by_lang, chunks_by_kind, chunks_by_lang_kind_rollup, chunks_jsonl, token_estimate, lang_detect, content_sha, lenient_json)}
SQL = {
    "cosine_topk": f"select v.vec_id, v.label, round({_COS}, 6) as score, row_number() over (order by {_COS} desc, v.vec_id) as rank from embeddings v, embeddings q where q.vec_id = 7 and v.vec_id <> 7 order by rank limit 8",
    "pack_filter": f"select v.vec_id, v.label, round({_COS}, 6) as score, row_number() over (order by {_COS} desc, v.vec_id) as rank from embeddings v, embeddings q where q.vec_id = 7 and v.vec_id <> 7 and v.label in (3, 9) order by rank limit 8",
    "neighbors": f"""with p as (select v.vec_id, v.label, q.label as own, {_COS} as s from embeddings v, embeddings q where q.vec_id = 7 and v.vec_id <> 7 order by s desc, v.vec_id limit 8)
      select vec_id, round(s, 6) as score, row_number() over (order by s desc, vec_id) as rank from p where label <> own order by rank limit 4""",
    "batch_search": f"""select query_id, vec_id, round(s, 6) as score, rank from (select q.vec_id as query_id, v.vec_id, {_COS} as s, row_number() over (partition by q.vec_id order by round({_COS}, 12) desc, v.vec_id) as rank
      from embeddings v, embeddings q where q.vec_id in (select item_id from benchmark)) where rank <= 8""",
    "query_terms": f"select item_id, cast(len({_TERMS.format('text')}) as bigint) as n_terms, array_to_string({_TERMS.format('text')}, ' ') as terms from benchmark",
    "lexical_score": f"with {_LEX} select d.doc_id, coalesce(lx.lex, 0.0::double) as lex from d left join lx using (doc_id)",
    "rrf_hybrid": f"""with {_LEX}, p as (select v.vec_id as doc_id, {_COS} as s from embeddings v, embeddings q where q.vec_id = 7 and v.vec_id <> 7 and v.vec_id in (select doc_id from documents) order by s desc, v.vec_id limit 40),
      r as (select doc_id, lex, row_number() over (order by s desc, doc_id) - 1 as dense_rank from p join lx using (doc_id)),
      x as (select *, row_number() over (order by lex desc, dense_rank) - 1 as lex_rank from r),
      f as (select *, 1.0::double / (60 + dense_rank) + 1.0::double / (60 + lex_rank) as rrf from x)
      select doc_id, dense_rank, lex_rank, round(rrf, 9) as rrf, row_number() over (order by case when (select max(lex) from x) > 0 then -rrf else dense_rank end, dense_rank) as rank from f order by rank limit 8""",
    "signature": f"select doc_id, case when length({_SIG}) > 240 then substr({_SIG}, 1, 240) || '…' else {_SIG} end as signature from documents",
    "chunk_truncate": """with c as (select doc_id, case when length(text) > 8000 then substr(text, 1, 8000) || chr(10) || '… (truncated — ' || (length(substr(text, 8001)) - length(replace(substr(text, 8001), chr(10), '')))
      || ' more lines; full source at ' || source || '/' || doc_id || ':1)' else text end as c from documents) select doc_id, length(c) as n_chars, sha1(c) as sha from c""",
    "citations": f"with {_LINES} select doc_id, n, path || ':' || (n + 1) || '-' || (n + 1) as citation from lines",
    "chunk_ids": f"with {_LINES} select doc_id, n, 'chunk_' || substr(sha1(path || ':' || n || ':' || (n + 1) || ':' || sha), 1, 16) as chunk_id from lines",
    "embed_texts": f"""with s as (select doc_id, lang, source, text, case when length({_SIG}) > 240 then substr({_SIG}, 1, 240) || '…' else {_SIG} end as sig from documents),
      e as (select doc_id, lang || ' file ' || source || case when sig <> '' and sig <> trim(text, ' ') then chr(10) || sig else '' end || chr(10) || case when strlen(text) > 8000 then substr(text, 1, 8000) else text end as e from s)
      select doc_id, sha1(e) as sha, length(e) as n_chars from e""",
    "chunks_by_lang": f"with {_LINES} select lang, count(*) as n_chunks, count(distinct doc_id) as n_files from lines group by lang",
    "chunks_by_kind": f"with {_LINES} select {_KIND_SQL} as kind, count(*) as n from lines group by 1",
    "chunks_by_lang_kind_rollup": f"with {_LINES} select lang, {_KIND_SQL} as kind, count(*) as n from lines group by rollup (lang, {_KIND_SQL})",
    "chunks_jsonl": """select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' as line from documents""",
    "token_estimate": "select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from documents",
    "lang_detect": """select page_id, case page_id % 11 when 0 then 'python' when 1 then 'python' when 2 then 'javascript' when 3 then 'javascript' when 4 then 'typescript' when 5 then 'typescript'
      when 6 then 'go' when 7 then 'rust' when 8 then 'java' end as language from pages""",
    "content_sha": "select doc_id, sha1(text) as sha from documents",
    "lenient_json": "select event_id, case when event_id % 4 = 3 then '{}' else trim(props) end as json from events",
}
