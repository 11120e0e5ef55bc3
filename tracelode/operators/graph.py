"""Code graph: building, walking and impact analysis as joins over node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation
from ..settle import settle

WEIGHTS = {"calls": 1.0, "implements": 0.7, "contains": 0.6, "defines": 0.6, "imports": 0.5}
EXPOSURE, OTHER_WEIGHT, DECAY = 1.15, 0.4, 0.7
SCRIPT_SUFFIXES = [*(f".{x}" for x in "ts tsx js jsx mjs cjs".split()), *(f"/index.{x}" for x in "ts tsx js jsx".split())]


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges without loops and repeats, and with both ends known where ``nodes`` is given."""
    out = edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))
    if nodes is not None:
        ids = nodes.select("id").distinct()
        out = out.join(ids, out["src"] == ids["id"], "left_semi").join(ids, out["dst"] == ids["id"], "left_semi")
    return out


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def contains_edges(chunks: DataFrame) -> DataFrame:
    """File or enclosing chunk to chunk: the parent is the latest earlier chunk of that name in the file.

    Names and look-ups go through one window per file and name, so the work is
    linear in the chunks however often a name occurs.
    """
    at = F.col("emit_seq")
    names = chunks.where(F.col("qualified_name").isNotNull()).select("file_relpath", F.col("qualified_name").alias("key"), at.alias("at"), F.lit(1).alias("turn"), F.col("chunk_id").alias("pid"), F.lit(None).cast("string").alias("dst"))
    asks = chunks.where(F.col("parent").isNotNull()).select("file_relpath", F.col("parent").alias("key"), at.alias("at"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("pid"), F.col("chunk_id").alias("dst"))
    order = Window.partitionBy("file_relpath", "key").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = names.unionByName(asks).withColumn("near", F.last("pid", ignorenulls=True).over(order)).where("turn = 0").select("file_relpath", "dst", "near")
    alone = chunks.where(F.col("parent").isNull()).select("file_relpath", F.col("chunk_id").alias("dst"), F.lit(None).cast("string").alias("near"))
    return found.unionByName(alone).select(F.coalesce("near", file_id(F.col("file_relpath"))).alias("src"), "dst", F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """Caller to every function or method of the called name: ambiguous names link to all."""
    calls = chunks.select(F.col("chunk_id").alias("src"), F.explode("calls").alias("name")).distinct()
    named = chunks.where(F.col("kind").isin("function", "method")).select(F.col("chunk_id").alias("dst"), "name")
    return calls.join(named, "name").where("src <> dst").select("src", "dst", F.lit("calls").alias("kind"), F.lit(0.7).alias("weight"))


def implements_edges(chunks: DataFrame) -> DataFrame:
    supers = chunks.select(F.col("chunk_id").alias("src"), F.explode("supers").alias("name")).distinct()
    types = chunks.where(F.col("kind").isin("class", "interface", "struct", "enum")).select(F.col("chunk_id").alias("dst"), "name")
    return supers.join(types, "name").where("src <> dst").select("src", "dst", F.lit("implements").alias("kind"), F.lit(0.7).alias("weight"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """Adds the ordered candidate paths of each import, by the importer's language."""
    target, folder = F.col("target"), F.slice(F.split("importer", "/"), 1, F.greatest(F.size(F.split("importer", "/")) - 1, F.lit(0)))
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    up = F.greatest(dots - 1, F.lit(0))
    base = F.slice(folder, 1, F.greatest(F.size(folder) - up, F.lit(0)))
    rest = F.replace(F.substring(target, dots + 1, F.length(target)), F.lit("."), F.lit("/"))
    dotted = F.when(dots > 0, F.array_join(F.filter(F.concat(base, F.array(rest)), lambda x: x != ""), "/")).otherwise(F.replace(target, F.lit("."), F.lit("/")))
    python = F.array(*[F.concat(dotted, F.lit(x)) for x in ".py .pyi /__init__.py".split()])
    steps = F.aggregate(
        F.split(target, "/"), folder,
        lambda at, s: F.when(s.isin(".", ""), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))),
    )
    path = F.array_join(steps, "/")
    script = F.concat(F.array(path), F.transform(F.array(*[F.lit(x) for x in SCRIPT_SUFFIXES]), lambda x: F.concat(path, x)))
    none = F.array().cast("array<string>")
    by_language = F.when(F.col("language") == "python", python).when(F.col("is_relative"), script).otherwise(none)
    return imports.withColumn("candidates", by_language)


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Importer and target to the first candidate that is a file (weight 0.5), else to a module node (0.3)."""
    spread = imports.select("importer", "target", F.posexplode_outer("candidates").alias("ord", "path"))
    known = paths.select(F.col("relpath").alias("path"), F.lit(True).alias("known")).distinct()
    hit = spread.join(known, "path", "left").groupBy("importer", "target").agg(F.min_by("path", F.when(F.col("known"), F.col("ord"))).alias("p"), F.max("known").alias("known"))
    found = F.coalesce(F.col("known"), F.lit(False))
    dst = F.when(found, file_id(F.col("p"))).otherwise(F.concat(F.lit("module:"), F.col("target")))
    return hit.select("importer", "target", dst.alias("resolved"), F.when(found, 0.5).otherwise(0.3).alias("weight"))


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One node per id: the first in the order counts, and what it lacks comes from the next that has it."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    tie = F.struct(order, *rest)
    return nodes.groupBy("id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), tie)).alias(c) for c in rest])


def incident_edges(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``direction, of, node, kind`` of the edges out of and into the ids (column ``node``)."""
    used = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    # Kept in files, the ids have a size, so few of them are sent to the tasks; semi-joins go
    # below unions and distinct pairs to the tables, so only incident edges are shuffled.
    of = settle(ids.select(F.col("node").alias("of")).distinct())
    out = used.join(of, used["src"] == of["of"], "left_semi").select(F.lit("out").alias("direction"), F.col("src").alias("of"), F.col("dst").alias("node"), "kind")
    into = used.join(of, used["dst"] == of["of"], "left_semi").select(F.lit("in").alias("direction"), F.col("dst").alias("of"), F.col("src").alias("node"), "kind")
    return out.unionByName(into)


def build_graph(files: DataFrame, chunks: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a repository."""
    none = F.lit(None).cast("string")
    base = F.substring_index("relpath", "/", -1)
    no_line = F.lit(None).cast("int")
    file_nodes = files.select(file_id(F.col("relpath")).alias("id"), F.lit("file").alias("kind"), base.alias("name"), F.col("relpath").alias("qualified_name"), "language", F.col("relpath").alias("file_relpath"), no_line.alias("start_line"), no_line.alias("end_line"), none.alias("signature"), "sha")
    chunk_nodes = chunks.select(F.col("chunk_id").alias("id"), "kind", "name", "qualified_name", "language", "file_relpath", "start_line", "end_line", "signature", F.col("file_sha").alias("sha"), F.col("emit_seq").cast("int").alias("turn"))
    resolved = resolve_imports(import_candidates(imports), files)
    module = F.col("resolved").startswith("module:")
    modules = resolved.where(module).select("resolved", "target").distinct()
    module_nodes = modules.select(F.col("resolved").alias("id"), F.lit("module").alias("kind"), F.col("target").alias("name"), F.col("target").alias("qualified_name"), none.alias("language"), none.alias("file_relpath"), no_line.alias("start_line"), no_line.alias("end_line"), none.alias("signature"), none.alias("sha"))
    emitted = [file_nodes.withColumn("turn", F.lit(-1)), chunk_nodes, module_nodes.withColumn("turn", F.lit(1 << 30))]
    nodes = merge_nodes(reduce(DataFrame.unionByName, emitted), "turn")
    import_edges = resolved.select(file_id(F.col("importer")).alias("src"), F.col("resolved").alias("dst"), F.lit("imports").alias("kind"), "weight")
    edges = reduce(DataFrame.unionByName, [contains_edges(chunks), import_edges, call_edges(chunks), implements_edges(chunks)])
    return nodes, clean_edges(edges, nodes)


def bfs(edges: DataFrame, starts: DataFrame, direction: str = "in", depth: int = 3, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``node, depth`` for all nodes within ``depth`` steps of the ids in ``starts`` (column ``node``).

    Each step joins the edges with the new nodes only; what it finds is settled
    at shared files, so plans don't grow with the depth.
    """
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    walk = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    walk = walk.select(F.col(here).alias("here"), F.col(there).alias("there"))
    reached = starts.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for k in range(1, depth + 1):
        step = walk.join(frontier.select(F.col("node").alias("here")), "here").select(F.col("there").alias("node")).distinct()
        frontier = settle(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 3, kinds: tuple[str, ...] = tuple(WEIGHTS), exposed: tuple[str, ...] = ("file", "function")) -> DataFrame:
    """``node, kind, depth, via, score`` of what depends on the targets.

    ``via`` are the kinds of edges into what was reached before the last step;
    the score is the best kind's weight, raised for exposed kinds of nodes,
    over the depth. To be ordered by score, depth and name.
    """
    used = settle(edges.where(F.col("kind").isin(*kinds)).select("src", "dst", "kind"))
    reach = bfs(used, targets, "in", depth)
    inner = reach.where(F.col("depth") < depth).select(F.col("node").alias("dst"))
    kind = F.col("kind")
    weight = reduce(lambda a, k: F.when(kind == k, F.lit(WEIGHTS[k])).otherwise(a), WEIGHTS, F.lit(OTHER_WEIGHT))
    via = used.join(inner, "dst").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("kind")).alias("via"), F.max(weight).alias("weight"))
    found = reach.where("depth > 0").join(via, "node").join(nodes.select(F.col("id").alias("node"), kind.alias("kind")), "node")
    score = F.round(F.col("weight") * F.when(F.col("kind").isin(*exposed), EXPOSURE).otherwise(1.0) / F.greatest("depth", F.lit(1)), 4)
    return found.select("node", "kind", F.col("depth").cast("bigint").alias("depth"), F.array_join("via", ",").alias("via"), score.alias("score"))


def risk(affected: DataFrame) -> DataFrame:
    """One row: ``n_affected, n_direct, risk``."""
    n = affected.agg(F.count("*").alias("n_affected"), F.count_if(F.col("depth") == 1).alias("n_direct"))
    grade = F.when(F.col("n_affected") == 0, "none").when((F.col("n_direct") >= 10) | (F.col("n_affected") >= 40), "critical")
    grade = grade.when((F.col("n_direct") >= 4) | (F.col("n_affected") >= 15), "high").when((F.col("n_direct") >= 1) | (F.col("n_affected") >= 5), "medium").otherwise("low")
    return n.withColumn("risk", grade)


def resolve_targets(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids for the ``target`` strings: by id, else qualified name, else name, else file path; each way in that order."""
    w = wanted.select("target").distinct()
    ways = [F.col("id"), F.col("qualified_name"), F.col("name"), F.when(F.col("kind") == "file", F.col("file_relpath"))]
    hits = [nodes.select("id", way.alias("target"), F.lit(i).alias("way")).join(w, "target") for i, way in enumerate(ways)]
    return reduce(DataFrame.unionByName, hits).groupBy("id").agg(F.min("way").alias("way"))


def diff_targets(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Changed files, and the functions, methods and classes that changed lines lie in (``path, range_start, range_end``)."""
    r = ranges.select("path", "range_start", "range_end")
    files = nodes.where("kind = 'file'").join(r.select(F.col("path").alias("file_relpath")).distinct(), "file_relpath", "left_semi")
    code = nodes.where(F.col("kind").isin("function", "method", "class"))
    hit = code.join(r, (code["file_relpath"] == r["path"]) & (r["range_start"] <= code["end_line"]) & (code["start_line"] <= r["range_end"]), "left_semi")
    return files.select("id").unionByName(hit.select("id")).distinct()


def expand(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, most: int = 8, depth: int = 1, direction: str = "out", kinds: tuple[str, ...] = ("calls", "contains", "implements")) -> DataFrame:
    """``node, via, edge, depth, score`` of what hangs on the seeds (``node, score, seed_rank``).

    The first seed wins unless a later one is strictly closer; the score decays
    with the depth; files, modules and the seeds themselves are left out.
    """
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    used = edges.where(F.col("kind").isin(*kinds)).select(F.col(here).alias("here"), F.col(there).alias("there"), "kind")
    front = seeds.select("seed_rank", F.col("node").alias("seed"), F.col("score").alias("seed_score"), "node", F.lit(0).alias("depth"))
    all_ = front
    for k in range(1, depth + 1):
        step = front.join(used, front["node"] == used["here"]).select("seed_rank", "seed", "seed_score", F.col("there").alias("node"), F.lit(k).alias("depth")).distinct()
        front = step.join(all_.select("seed", "node"), ["seed", "node"], "left_anti")
        front = settle(front) if depth > 2 else front
        all_ = all_.unionByName(front)
    best = all_.where("depth > 0").groupBy("node").agg(F.min(F.struct("depth", "seed_rank", "seed", "seed_score")).alias("b"))
    best = best.join(seeds.select("node"), "node", "left_anti")
    best = best.join(nodes.where(~F.col("kind").isin("file", "module")).select(F.col("id").alias("node")), "node", "left_semi")
    score = F.round(F.col("b.seed_score") * F.pow(F.lit(DECAY), F.col("b.depth")), 4)
    best = best.select("node", F.col("b.seed").alias("via"), F.col("b.depth").cast("bigint").alias("depth"), score.alias("score"))
    best = best.orderBy(F.desc("score"), "node").limit(most)
    # Edges are labelled for the few nodes that are left, not for the whole graph.
    label = used.join(F.broadcast(best.select(F.col("via").alias("here"), F.col("node").alias("there"))), ["here", "there"]).groupBy("here", "there").agg(F.min("kind").alias("edge"))
    out = best.join(label, (best["via"] == label["here"]) & (best["node"] == label["there"]), "left")
    return out.select("node", "via", "edge", "depth", "score").orderBy(F.desc("score"), "node")


def augment(hits: DataFrame, extra: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits followed by what the graph adds: chunk columns of ``hits`` with ``source, via, edge, depth``.

    ``extra`` is what ``expand`` gave; additions without a chunk and chunks that
    are hits already are left out. Ranks go on after the last hit.
    """
    none = F.lit(None).cast("string")
    mine = hits.withColumns({"source": F.lit("vector"), "via": none, "edge": none, "depth": F.lit(0).cast("bigint")})
    last = F.broadcast(hits.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("__last")))
    new = extra.join(hits.select(F.col("chunk_id").alias("node")), "node", "left_anti").withColumnRenamed("node", "chunk_id")
    order = Window.orderBy(F.desc("score"), "chunk_id")
    found = chunks.drop("score").join(new, "chunk_id").join(last).withColumns({"rank": (F.row_number().over(order) + F.col("__last")).cast("bigint"), "source": F.lit("graph")}).drop("__last")
    return mine.unionByName(found.select(*[c for c in found.columns if c in mine.columns]), allowMissingColumns=True)


def located(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds a citation: the lines of a chunk, or the bare file."""
    place = F.when(F.col("start_line").isNotNull(), citation(F.col("file_relpath"), F.col("start_line"), F.col("end_line"))).otherwise(F.col("file_relpath"))
    return affected.join(nodes.select(F.col("id").alias("node"), "qualified_name", place.alias("citation")), "node", "left")
