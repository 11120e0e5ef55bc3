"""Indexing, asking, impact and review over a repository, composed from the operators.

All state is files: versioned Parquet tables under one folder. Nothing here
calls out to a network; a model is whatever object the caller passes in.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import models
from .functions.text import PROMPT_CODE_CAP, citation, embed_text, lexical_score, query_terms, token_estimate
from .operators import embedding, graph, incremental, meter, packs, review, search
from .operators.search import TOP_K
from .schemas import CHUNKS, MANIFEST
from .sources import diffs, repo
from .sources.state import RepoState, load_state, save_state


class Model(Protocol):
    """A text model. It may also have ``generate_structured(system, prompt, schema)`` and a ``provider`` for the meter."""

    name: str

    def generate(self, system: str, prompt: str) -> str | models.Answer: ...


class EchoModel:
    """Stands in for a model in tests: answers with what it was told to."""

    name, provider = "echo", "local"

    def __init__(self, answer: str = "{}"):
        self.answer, self.prompts = answer, []

    def generate(self, system: str, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answer


#: Tables whose rows lie by the hash of a key, so that a small change rewrites a small part.
_KEYS = {"chunks": "file_relpath", "vectors": "key", "manifest": "relpath"}
_VECTORS = "key string, model string, sha string, dim int, vector array<float>"
_PACKS = "id string, label string, scope array<string>, auto boolean"


class Workspace:
    """A repository's tables: ``chunks`` (with vectors and packs), ``manifest``, ``vectors``, ``nodes``, ``edges``, ``packs``."""

    def __init__(self, spark: SparkSession, home: str, load_embedder: Callable | None = None, model_name: str = "hashing-384"):
        self.spark, self.home, self.load_embedder, self.model_name = spark, home.rstrip("/"), load_embedder, model_name
        self.state_path = f"{self.home}/state.json"

    def table(self, name: str) -> incremental.VersionedTable:
        return incremental.VersionedTable(self.spark, f"{self.home}/{name}", _KEYS.get(name))

    def _read(self, name: str, schema: str) -> DataFrame:
        t = self.table(name)
        return t.read() if t.exists() else self.spark.createDataFrame([], schema)

    def pack_list(self) -> list[tuple[str, list[str]]]:
        rows = self._read("packs", "id string, label string, scope array<string>").orderBy("label").collect()
        return [(r["id"], list(r["scope"])) for r in rows]

    def index(self, root: str, full: bool = False, progress: Callable[[str, dict], None] = lambda step, counts: None) -> dict:
        """Brings the tables up to date with the repository; returns counters.

        Files whose digest is in the manifest are not parsed again; texts whose
        digest has a vector are not embedded again. Chunks of every file that was
        parsed are replaced and the manifest is written last, so a run that broke
        off anywhere is made good by the next one. ``full`` forgets all tables
        first. ``progress`` hears of each step with the counters so far.
        """
        files = repo.scan_repo(self.spark, root).cache()
        if full:
            self.reset()
        manifest = self._read("manifest", MANIFEST)
        diff = incremental.manifest_diff(files, manifest).cache()
        stats = incremental.index_stats(diff).first().asDict()
        progress("scanned", stats)
        fresh = files.join(diff.where("status in ('new', 'changed')").select("relpath"), "relpath", "left_semi")
        parsed = repo.parse_files(fresh).cache()
        chunks = repo.chunks_of(parsed)
        text = embed_text(F.col("language"), F.col("kind"), F.col("qualified_name"), F.col("signature"), F.col("code"))
        chunks = chunks.withColumn("text", text).withColumn("text_sha", F.sha1(F.col("text").cast("binary")))
        vectors = self._read("vectors", _VECTORS)
        known = vectors.where(F.col("model") == self.model_name)
        wanted = chunks.select(F.col("text_sha").alias("sha"), "text")
        stats["embeddings_cached"] = wanted.select("sha").distinct().join(known, "sha", "left_semi").count()
        new = embedding.embed_misses(wanted, vectors, self.model_name, self.load_embedder).cache()
        stats["embeddings_computed"] = new.count()
        progress("embedded", stats)
        if stats["embeddings_computed"]:
            self.table("vectors").upsert(new.select(F.concat_ws(":", "model", "sha").alias("key"), "model", "sha", F.col("dim").cast("int").alias("dim"), "vector"), "key")
        vectors = self._read("vectors", _VECTORS).where(F.col("model") == self.model_name)
        ready = chunks.join(vectors.select(F.col("sha").alias("text_sha"), "vector"), "text_sha").drop("text")
        ready = packs.tag_paths(ready, self.pack_list(), "file_relpath")
        stale = diff.where("status <> 'reused'").select(F.col("relpath").alias("file_relpath"))
        self.table("chunks").swap(ready, stale, "file_relpath")
        progress("merged", stats)
        now = f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S}+00:00"
        counts = self.table("chunks").read().groupBy(F.col("file_relpath").alias("relpath")).agg(F.count("*").cast("int").alias("chunk_count"))
        self.table("manifest").replace(files.select("relpath", "sha").join(counts, "relpath", "left").select("relpath", "sha", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(now).alias("indexed_at")))
        stats["chunks"] = self.table("chunks").read().count()
        progress("done", stats)
        for df in (files, diff, parsed, new):
            df.unpersist()
        return stats

    def reset(self) -> None:
        """Forgets everything that is derived from the repository; packs and their state stay."""
        for name in ("chunks", "manifest", "vectors", "nodes", "edges"):
            self.table(name).drop()

    def build_graph(self, root: str) -> dict:
        files = repo.scan_repo(self.spark, root).cache()
        parsed = repo.parse_files(files).cache()
        nodes, edges = graph.build_graph(files, repo.chunks_of(parsed), repo.imports_of(parsed))
        self.table("nodes").replace(nodes)
        self.table("edges").replace(edges)
        files.unpersist(), parsed.unpersist()
        return {"nodes": self.table("nodes").read().count(), "edges": self.table("edges").read().count()}

    def suggest_packs(self, apply: bool = False) -> DataFrame:
        chunks = self.table("chunks").read().withColumn("n_chars", F.length("code"))
        found = packs.suggest(chunks)
        if apply:
            rows = found.select(F.col("pack_id").alias("id"), "label", F.array("scope").alias("scope"), F.lit(True).alias("auto"))
            held = self._read("packs", _PACKS)
            self.table("packs").replace(packs.upsert_packs(packs.delete_auto(held), rows))
            self.retag()
        return found

    def create_pack(self, label: str, scope: list[str]) -> None:
        from .functions.text import slug

        new = self.spark.createDataFrame([(label, scope, False)], "label string, scope array<string>, auto boolean")
        new = new.select(slug(F.col("label")).alias("id"), "label", "scope", "auto")
        self.table("packs").replace(packs.upsert_packs(self._read("packs", _PACKS), new))

    def delete_pack(self, pack: str) -> None:
        self.table("packs").replace(self.table("packs").read().where(F.col("id") != pack))

    def retag(self) -> int:
        chunks = self.table("chunks").read().drop("packs")
        self.table("chunks").replace(packs.tag_paths(chunks, self.pack_list(), "file_relpath"))
        return self.table("chunks").read().count()

    def state(self) -> RepoState:
        return load_state(self.state_path, self.spark)

    def save(self, state: RepoState) -> None:
        save_state(self.state_path, state, self.spark)

    def search(self, questions: list[str], k: int = TOP_K, scope: list[str] | None = None) -> DataFrame:
        """Hits of every question: chunk columns, ``query_id, question, score, rrf, rank, citation``.

        Candidates are cut to the scope before scoring; a pool of at least
        ``POOL`` per question is fused with lexical ranks.
        """
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id bigint, question string")
        q = asked.withColumn("q", embedding.embed_column(F.col("question"), self.load_embedder))
        chunks = self.table("chunks").read()
        if scope:
            chunks = chunks.where(search.in_packs(F.col("packs"), scope))
        numbered = chunks.select("chunk_id", F.xxhash64("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"))
        pool = search.batch_nearest(numbered, q, max(k, search.POOL)).drop("rank").join(chunks.drop("vector").withColumn("vec_id", F.xxhash64("chunk_id")), "vec_id").join(asked, "query_id")
        pool = pool.withColumn("lex", lexical_score(query_terms(F.col("question")), F.col("name"), F.col("file_relpath"), F.substring("code", 1, PROMPT_CODE_CAP)))
        fused = search.fuse_ranks(pool, k, ["query_id"], "chunk_id")
        return fused.withColumn("citation", citation(F.col("file_relpath"), F.col("start_line"), F.col("end_line"))).drop("vec_id")

    def ask(self, question: str, model: Model | None = None, k: int = TOP_K, all_packs: bool = False, graph_extra: int = 6) -> dict:
        """Hits, what the graph adds to them, the prompt and its tokens, and the model's answer if there is one."""
        state = self.state()
        hits = self.search([question], k, None if all_packs else state.active or None).cache()
        out: dict = {"hits": hits}
        shown = hits
        if self.table("edges").exists() and graph_extra:
            seeds = hits.select(F.col("chunk_id").alias("node"), "score", (F.col("rank") - 1).cast("int").alias("seed_rank"))
            extra = graph.expand(self.table("edges").read(), self.table("nodes").read(), seeds, graph_extra)
            place = citation(F.col("file_relpath"), F.col("start_line"), F.col("end_line"))
            named = self.table("chunks").read().drop("vector").withColumns({"query_id": F.lit(0).cast("bigint"), "question": F.lit(question), "citation": place})
            shown = graph.augment(hits, extra, named).cache()
            out |= {"extra": extra, "hits": shown}
        prompt = review.ask_prompt(shown, F.col("question")).first()
        out["prompt"] = prompt["prompt"] if prompt else f"No indexed code matches. Question: {question}"
        tokens = meter.prompt_tokens(shown).first()
        out["prompt_tokens"] = tokens["prompt_tokens"] if tokens else (len(question) + meter.PROMPT_OVERHEAD) // 4
        if model is not None:
            said = models.answer(model, "Answer from the cited code only and cite file:line.", out["prompt"])
            out |= {"answer": said.text, "cost": self.cost_line(model, [said], out["prompt_tokens"])}
            state.clear_attached()
            self.save(state)
        return out

    def cost_line(self, model: Model, answers: list[models.Answer], estimated_input: int, prices: list[tuple] = ()) -> str:
        """The meter's line over the answers of one model; ``prices`` are more rows of the price list."""
        told = [a for a in answers if a.input_tokens is not None and a.output_tokens is not None]
        whole = bool(answers) and len(told) == len(answers)
        n_in, n_out = (sum(a.input_tokens for a in told), sum(a.output_tokens for a in told)) if whole else (None, None)
        usage = self.spark.createDataFrame([(getattr(model, "provider", "unknown"), model.name, n_in, n_out, estimated_input)], "provider string, model string, input_tokens bigint, output_tokens bigint, estimated_input bigint")
        return meter.cost_line(meter.price_usage(usage, meter.price_table(self.spark, prices))).first()["line"]

    def impact(self, targets: list[str] | None = None, diff: str | None = None, depth: int = 3, kinds: tuple[str, ...] = tuple(graph.WEIGHTS)) -> tuple[DataFrame, DataFrame]:
        """What depends on the named nodes or on a diff's changed code, and its risk."""
        nodes, edges = self.table("nodes").read(), self.table("edges").read()
        if diff is not None:
            hunks = diffs.diff_hunks(self.spark.createDataFrame([(diff,)], "diff string"))
            ids = graph.diff_targets(nodes, diffs.added_ranges(hunks))
        else:
            ids = graph.resolve_targets(nodes, self.spark.createDataFrame([(t,) for t in targets or []], "target string"))
        found = graph.impact(nodes, edges, ids.select(F.col("id").alias("node")), depth, kinds)
        found = graph.located(found, nodes).orderBy(F.desc("score"), "depth", "qualified_name")
        return found, graph.risk(found)

    def resolve(self, targets: list[str]) -> list[str]:
        """Qualified names of what the target strings stand for."""
        nodes = self.table("nodes").read()
        ids = graph.resolve_targets(nodes, self.spark.createDataFrame([(t,) for t in targets], "target string"))
        return [r[0] for r in nodes.join(ids, "id").orderBy("way", "qualified_name").select("qualified_name").collect()]

    def review(self, diff: str, model: Model, near: int = 3) -> DataFrame:
        """Findings of the model on a diff, clamped to its added lines, worst first."""
        return self.review_report(diff, model, near)["findings"]

    def review_report(self, diff: str, model: Model, near: int = 3) -> dict:
        """``findings``, the counts ``files, files_reviewed, files_skipped``, ``errors`` by path and the meter's ``cost``.

        A file is asked about with its hunks, the chunks around them and ``near``
        chunks of other files that are closest to each hunk. A file for which the
        model fails is skipped; the others are reviewed all the same.
        """
        all_hunks = diffs.diff_hunks(self.spark.createDataFrame([(diff,)], "diff string")).cache()
        hunks = diffs.reviewable(all_hunks).withColumn("hunk_id", F.concat_ws("#", "path", F.col("hunk").cast("string")))
        spans = hunks.select("path", "hunk_id", "new_start", (F.col("new_start") + F.greatest(F.col("new_length") - 1, F.lit(0))).alias("new_end"))
        chunks = self._read("chunks", f"{CHUNKS}, vector array<float>")
        place = citation(F.col("file_relpath"), F.col("start_line"), F.col("end_line")).alias("citation")
        inside = review.containing(spans, chunks.select("chunk_id", F.col("file_relpath").alias("path"), "start_line", "end_line"))
        places = inside.join(chunks, "chunk_id").select(F.col("file_relpath").alias("path"), "rank", place, "code")
        prompts = review.review_prompt(hunks, places, self._near_hunks(hunks, chunks, near) if near else None).collect()
        said, errors = {}, {}
        for p in prompts:
            try:
                said[p["path"]] = models.structured(model, "Review the diff. Report findings on added lines only.", p["prompt"], review.FINDINGS_SCHEMA)
            except Exception as e:  # noqa: BLE001 - whatever a model raises concerns its own file only
                errors[p["path"]] = str(e)
        answers = self.spark.createDataFrame([(path, a.text) for path, a in said.items()], "path string, raw string")
        found = review.parse_findings(answers).drop("path")
        counts = review.file_counts(all_hunks, answers).first().asDict()
        tokens = sum(max(1, len(p["prompt"]) // 4) for p in prompts)
        return {"findings": review.order_findings(review.clamp(found, diffs.added_ranges(hunks))), "errors": errors, "cost": self.cost_line(model, list(said.values()), tokens), **counts}

    def _near_hunks(self, hunks: DataFrame, chunks: DataFrame, near: int) -> DataFrame:
        """``path, rank, citation, code`` of the chunks of other files closest to each hunk, all hunks in one search."""
        asked = hunks.select(F.xxhash64("hunk_id").alias("query_id"), F.col("path").alias("own"), embedding.embed_column(F.col("body"), self.load_embedder).alias("q")).cache()
        held = chunks.withColumn("vec_id", F.xxhash64("chunk_id"))
        found = search.neighbours(held, asked, "file_relpath", near, "vec_id", "vector")
        place = citation(F.col("file_relpath"), F.col("start_line"), F.col("end_line")).alias("citation")
        return found.join(asked.select("query_id", F.col("own").alias("path")), "query_id").join(held.drop("path"), "vec_id").select("path", "rank", place, "code").distinct()

    def status(self) -> dict:
        """What is indexed, under which packs."""
        manifest = self._read("manifest", "relpath string, sha string, chunk_count int, indexed_at string")
        counts = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.max("indexed_at").alias("indexed_at")).first()
        return counts.asDict() | {"packs": [p for p, _ in self.pack_list()], "active": self.state().active}

    @staticmethod
    def render_hits(hits: DataFrame) -> str:
        line = F.format_string("[%d] %s  %s %s  %.3f", "rank", "citation", "kind", "qualified_name", "score")
        return "\n".join(r[0] for r in hits.orderBy("rank").select(line).collect())

    @staticmethod
    def render_impact(found: DataFrame, risk: DataFrame, most: int = 25) -> str:
        line = F.format_string("%.3f  depth %d  %s %s  via %s", "score", "depth", "citation", "qualified_name", "via")
        rows = [r[0] for r in found.limit(most).select(line).collect()]
        told = risk.first()
        return "\n".join([f"risk {told['risk']}: {told['n_affected']} affected, {told['n_direct']} directly", *rows])

    def render_packs(self) -> str:
        """A line a pack: id, label, chunks under its scope and an estimate of their tokens."""
        chunks = self._read("chunks", f"{CHUNKS}, packs array<string>").select(F.explode("packs").alias("id"), token_estimate(F.col("code")).alias("t"))
        size = chunks.groupBy("id").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
        line = F.format_string("%-32s %-28s chunks=%-5d ~%s tok", "id", "label", F.coalesce("n", F.lit(0)), F.format_number(F.coalesce("t", F.lit(0)), 0))
        return "\n".join(r[0] for r in self._read("packs", _PACKS).join(size, "id", "left").orderBy("label").select(line).collect())

    def show_pack(self, pack: str) -> dict | None:
        row = self._read("packs", _PACKS).where(F.col("id") == pack).first()
        return row.asDict() if row else None

    def unknown_packs(self, ids: list[str]) -> list[str]:
        """Those of the ids that no pack has; attaching or pinning them is allowed, but worth a warning."""
        known = {p for p, _ in self.pack_list()}
        return [i for i in ids if i not in known]

    @staticmethod
    def render_findings(findings: DataFrame) -> str:
        line = F.format_string("%-8s %s:%d  %s: %s", "severity", "file", "line", "category", "message")
        return "\n".join(r[0] for r in review.order_findings(findings).select(line).collect())

    @staticmethod
    def jsonl(rows: DataFrame, path: str) -> None:
        """Any result (impact, findings, hits) as a folder of JSON lines."""
        rows.write.mode("overwrite").json(path)

    def chunks_jsonl(self, path: str, code: bool = True) -> None:
        chunks = self.table("chunks").read().drop("vector")
        (chunks if code else chunks.drop("code")).write.mode("overwrite").json(path)


def quickstart(spark: SparkSession, root: str, home: str) -> Workspace:
    """Index, graph and packs in one go."""
    w = Workspace(spark, home)
    w.index(root)
    w.build_graph(root)
    w.suggest_packs(apply=True)
    return w
