"""Unified diffs as tables of hunks."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import HUNKS

_HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$")


def _path(raw: str) -> str | None:
    raw = raw.split("\t")[0].strip().strip('"')
    return None if raw == "/dev/null" else raw[2:] if raw[:2] in ("a/", "b/") else raw


def parse_diff(text: str) -> list[dict]:
    """Hunk rows; a file without hunks (renamed, binary, mode change) is one row with hunk -1."""
    rows: list[dict] = []
    now: dict | None = None
    hunk: dict | None = None
    left = old_left = 0  # lines of the new and the old side that the hunk still has

    def close() -> None:
        nonlocal now, hunk
        if hunk is not None:
            hunk["body"] = "\n".join(hunk.pop("lines")).rstrip()
            rows.append(now["row"] | hunk)
            now["n"] += 1
        hunk = None

    def leave() -> None:
        nonlocal now
        close()
        if now and not now["n"]:
            rows.append(now["row"] | {"hunk": -1, "new_start": 0, "new_length": 0, "added": [], "removed_count": 0, "section_header": "", "body": ""})
        now = None

    for line in text.splitlines():
        mark = line[:1]
        if hunk is not None and (mark == "\\" or mark == "+" and left or mark == "-" and old_left or mark in (" ", "") and left and old_left):
            if line.startswith("\\"):
                continue
            hunk["lines"].append(line)
            if mark != "+":
                old_left -= 1
            if mark == "-":
                hunk["removed_count"] += 1
            else:
                if mark == "+":
                    hunk["added"].append(hunk["new_start"] + hunk["new_length"] - left)
                left -= 1
            continue
        if line.startswith("diff --git "):
            leave()
            parts = line[11:].split(" b/", 1)
            new = parts[1] if len(parts) > 1 else parts[0]
            now = {"n": 0, "row": {"path": new, "old_path": _path(parts[0]), "is_added": False, "is_removed": False, "is_renamed": False, "is_binary": False}}
        elif line.startswith("--- "):
            if now is None or now["n"] or hunk is not None:
                leave()
                now = {"n": 0, "row": {"path": "", "old_path": None, "is_added": False, "is_removed": False, "is_renamed": False, "is_binary": False}}
            now["row"]["old_path"] = _path(line[4:])
            now["row"]["is_added"] |= now["row"]["old_path"] is None
        elif line.startswith("+++ ") and now:
            new = _path(line[4:])
            now["row"]["is_removed"] |= new is None
            now["row"]["path"] = new or now["row"]["old_path"] or ""
        elif now and line.startswith("new file"):
            now["row"]["is_added"] = True
        elif now and line.startswith("deleted file"):
            now["row"]["is_removed"] = True
        elif now and line.startswith("rename from "):
            now["row"] |= {"old_path": line[12:], "is_renamed": True}
        elif now and line.startswith("rename to "):
            now["row"] |= {"path": line[10:], "is_renamed": True}
        elif now and (line.startswith("Binary files ") or line.startswith("GIT binary patch")):
            now["row"]["is_binary"] = True
        elif now and (m := _HUNK.match(line)):
            close()
            old_left, left = (int(n) if n is not None else 1 for n in (m[1], m[3]))
            hunk = {"hunk": now["n"], "new_start": int(m[2]), "new_length": left, "added": [], "removed_count": 0, "section_header": m[4], "lines": []}
    leave()
    return rows


def diff_hunks(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """Hunks of every row's diff text, with the other columns repeated; null and empty diffs give none."""
    kept = [f for f in diffs.schema.fields if f.name != column]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), HUNKS])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row | x for row in batch.to_pylist() for x in parse_diff(row.pop(column) or "")]
            for lo in range(0, len(found), 1000):
                yield pa.RecordBatch.from_pylist(found[lo : lo + 1000], schema=schema)

    return diffs.mapInArrow(run, ddl)


def reviewable(hunks: DataFrame) -> DataFrame:
    return hunks.where("not is_binary and not is_removed and hunk >= 0")


def git_diff(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    """One row with the staged diff, or the diff of a revision's merge base to HEAD."""
    what = [f"{revision}...HEAD"] if revision else ["--staged"]
    run = subprocess.run(["git", "-C", root, "diff", "--unified=3", "--no-color", *what], capture_output=True, text=True, check=True)
    return spark.createDataFrame([(run.stdout,)], "diff string")


def added_ranges(hunks: DataFrame) -> DataFrame:
    """``path, range_start, range_end`` of runs of added lines."""
    from ..operators.intervals import islands

    lines = hunks.select("path", F.explode("added").alias("line"))
    return islands(lines, ["path"], "line")
