"""Globs and ignore patterns as anchored regular expressions.

``*`` crosses ``/``. A pattern with a ``/`` that doesn't start with ``**/`` also
matches below any directory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _body(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 1 + (glob[i : i + 1] in ("!", "^") and glob[i] == "!"))
            if end < 0:
                out.append(r"\[")
                continue
            inner = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            i = end + 1
            negate = inner.startswith("!")
            inner = inner[1:] if negate else inner
            out.append(f"[{'^' if negate else ''}{re.sub(r'^\^', r'\^', inner)}]")
        else:
            out.append(re.escape(c))
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Regular expression that full paths with forward slashes must match."""
    pattern = pattern.replace("\\", "/")
    parts = [_body(pattern)]
    if "/" in pattern and not pattern.startswith("**/"):
        parts.append(_body("**/" + pattern))
    return "(?s)^(?:" + "|".join(parts) + ")$"


def matches(path: Column, pattern: str) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_regex(pattern))


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(negated, regex) of each line of an ignore file; later lines win."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip("\n")
        bare = line.rstrip()
        # A space after a backslash belongs to the name.
        line = bare + " " if bare.endswith("\\") and not bare.endswith("\\\\") and line != bare else bare
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only_dirs = line.endswith("/")
        line = line.strip("/") if only_dirs else line
        rooted = "/" in line.rstrip("/")
        line = line.lstrip("/")
        out, i = [], 0
        while i < len(line):
            if line.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                out.append("/.*")
                i += 3
            elif line[i] == "*":
                out.append("[^/]*")
                i += 1
            elif line[i] == "?":
                out.append("[^/]")
                i += 1
            elif line[i] == "\\" and i + 1 < len(line):
                out.append(re.escape(line[i + 1]))
                i += 2
            elif line[i] == "[" and (end := line.find("]", i + 2 + line.startswith(("!", "^"), i + 1))) > 0:
                inner = line[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                negative = inner[:1] in ("!", "^")
                out.append(f"(?!/)[{'^' if negative else ''}{inner[negative:]}]")
                i = end + 1
            else:
                out.append(re.escape(line[i]))
                i += 1
        tail = "/.*" if only_dirs else "(?:/.*)?"
        rules.append((negated, "^" + ("" if rooted else "(?:.*/)?") + "".join(out) + tail + "$"))
    return rules


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Is the path ignored, the last matching rule deciding?"""
    out = F.lit(False)
    for negated, regex in rules:
        out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out
