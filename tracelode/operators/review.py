"""Diff review: context of hunks, findings, clamping to the diff, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lenient_json
from ..schemas import CATEGORIES, SEVERITY_RANK
from .intervals import meeting, paired

MOST_CONTAINING = 16


def rank_of(severity: Column) -> Column:
    """5 for critical down to 1 for info; null for anything else."""
    out = F.lit(None).cast("int")
    for name, value in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out


def containing(hunks: DataFrame, chunks: DataFrame, most: int = MOST_CONTAINING) -> DataFrame:
    """``hunk_id, chunk_id, rank``: chunks of the hunk's file that overlap it, shortest first.

    Only ranges near each other in a file meet (see ``paired``); ranked per hunk.
    """
    h = hunks.select(F.col("hunk_id").alias("id"), F.col("path").alias("key"), F.col("new_start").alias("start"), F.col("new_end").alias("end"))
    c = chunks.select(F.col("chunk_id").alias("id"), F.col("path").alias("key"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    order = Window.partitionBy("left_id").orderBy(F.col("right_end") - F.col("right_start"), "right_start", "right_id")
    ranked = paired(h, c).withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= most).select(F.col("left_id").alias("hunk_id"), F.col("right_id").alias("chunk_id"), "rank")


def parse_findings(answers: DataFrame, column: str = "raw") -> DataFrame:
    """Findings of model answers, one row each, with the other columns; rows that lack or break a required field are dropped alone."""
    body = F.from_json(lenient_json(F.col(column)), "struct<findings: array<string>>")
    items = answers.withColumn("__item", F.explode(body["findings"])).drop(column)
    loose = "file string, line string, severity string, category string, message string, fix string, end_line string, confidence string"
    items = items.withColumn("__f", F.from_json("__item", loose)).drop("__item")
    f = F.col("__f")
    number = lambda c: F.expr(f"try_cast(__f.{c} as int)")
    rows = items.withColumns({
        "file": f["file"], "line": number("line"), "severity": F.lower(f["severity"]),
        "category": F.lower(F.coalesce(f["category"], F.lit("other"))), "message": f["message"], "fix": f["fix"],
        "end_line": number("end_line"), "confidence": F.expr("try_cast(__f.confidence as double)"),
    }).drop("__f")
    whole = F.col("file").isNotNull() & F.col("line").isNotNull() & F.col("message").isNotNull()
    return rows.where(whole & F.col("severity").isin(*SEVERITY_RANK) & F.col("category").isin(*CATEGORIES))


def order_findings(findings: DataFrame) -> DataFrame:
    """Worst first, then by place."""
    return findings.orderBy(F.desc(rank_of(F.col("severity"))), "file", "line")


def clamp(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings whose lines meet an added range of their file (``path, range_start, range_end``)."""
    return meeting(findings, F.col("file"), F.col("line"), F.coalesce("end_line", "line"), ranges.select(F.col("path").alias("key"), "range_start", "range_end"))


def comment_payload(findings: DataFrame) -> DataFrame:
    """``payload``: the JSON of an inline comment per finding."""
    badge = F.upper("severity")
    parts = F.filter(F.array(
        F.concat(badge, F.lit(" **"), "category", F.lit("** — "), "message"),
        F.when(F.col("fix").isNotNull() & (F.col("fix") != ""), F.concat(F.lit("**Suggested fix:** "), "fix")),
        F.when(F.col("confidence").isNotNull(), F.concat(F.lit("_confidence: "), F.format_string("%.2f", "confidence"), F.lit("_"))),
    ), lambda x: x.isNotNull())
    ranged = F.col("end_line") > F.col("line")
    body = F.struct(
        F.col("file").alias("path"), F.array_join(parts, "\n\n").alias("body"),
        F.when(ranged, F.col("line")).alias("start_line"), F.when(ranged, F.lit("RIGHT")).alias("start_side"),
        F.when(ranged, F.col("end_line")).otherwise(F.col("line")).alias("line"), F.lit("RIGHT").alias("side"),
    )
    return findings.where((F.col("file") != "") & (F.col("line") > 0)).withColumn("payload", F.to_json(body))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy(F.desc(rank_of(F.col("severity"))))


def file_counts(hunks: DataFrame, answered: DataFrame) -> DataFrame:
    """One row ``files, files_reviewed, files_skipped``: files of a diff, and those with an answer (``path``)."""
    files = hunks.select("path").distinct().join(answered.select("path", F.lit(1).alias("__a")).distinct(), "path", "left")
    return files.agg(F.count("*").alias("files"), F.count("__a").alias("files_reviewed"), F.count_if(F.col("__a").isNull()).alias("files_skipped"))


FINDINGS_SCHEMA = {
    "type": "object", "required": ["findings"],
    "properties": {"findings": {"type": "array", "items": {
        "type": "object", "required": ["file", "line", "severity", "message"],
        "properties": {
            "file": {"type": "string"}, "line": {"type": "integer"}, "end_line": {"type": "integer"}, "severity": {"enum": list(SEVERITY_RANK)},
            "category": {"enum": list(CATEGORIES)}, "message": {"type": "string"}, "fix": {"type": "string"}, "confidence": {"type": "number"},
        },
    }}},
}


def ask_prompt(hits: DataFrame, question: Column) -> DataFrame:
    """``query_id, prompt``: numbered citations with capped code, then the question (hits carry ``rank``)."""
    code = F.when(F.length("code") > 2000, F.concat(F.substring("code", 1, 2000), F.lit("\n… (truncated)"))).otherwise(F.col("code"))
    item = F.format_string("[%d] %s  (%s %s, score=%.3f)\n```\n%s\n```", "rank", "citation", "kind", "qualified_name", "score", code)
    rows = hits.select("query_id", F.struct("rank", item.alias("text")).alias("x"), question.alias("q"))
    joined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("q").alias("q"))
    return joined.select("query_id", F.concat(F.array_join(F.col("xs.text"), "\n\n"), F.lit("\n\nQuestion: "), "q").alias("prompt"))


def review_prompt(hunks: DataFrame, context: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """``path, prompt`` per file: its hunks, up to three containing chunks and three neighbours each, then the task.

    ``context`` and ``neighbours`` have ``path, rank, citation, code``.
    """
    def part(df: DataFrame, cap: int, name: str) -> DataFrame:
        text = F.format_string("### %s\n%s", "citation", F.substring("code", 1, cap))
        got = df.where(F.col("rank") <= 3).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("a"))
        return got.select("path", F.array_join(F.col("a.t"), "\n\n").alias(name))

    mark = F.when(F.col("is_added"), " (new file)").when(F.col("is_renamed"), F.concat(F.lit(" (renamed from "), "old_path", F.lit(")"))).otherwise("")
    body = hunks.groupBy("path").agg(F.first(mark).alias("mark"), F.array_sort(F.collect_list(F.struct("hunk", "body"))).alias("h"))
    out = body.join(part(context, 1500, "inside"), "path", "left")
    out = out.join(part(neighbours, 800, "near"), "path", "left") if neighbours is not None else out.withColumn("near", F.lit(None).cast("string"))
    sections = F.concat_ws(
        "\n\n", F.concat(F.lit("# File: "), "path", "mark"), F.concat(F.lit("## Diff\n"), F.array_join(F.col("h.body"), "\n")),
        F.concat(F.lit("## Enclosing code\n"), "inside"), F.concat(F.lit("## Related code\n"), "near"), F.lit("Report findings on added lines only, as JSON."),
    )
    return out.select("path", sections.alias("prompt"))
