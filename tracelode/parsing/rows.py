"""What parsers emit."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

CODE_CAP, SIGNATURE_CAP = 8000, 240

#: Callees that say nothing about the repository.
COMMON_CALLS = frozenset(
    """Array Boolean Date JSON Map Math Number Object Promise Set String abs all any bool console debug dict enumerate error
    fetch filter float format getattr hasattr hash id info int isinstance issubclass iter len list log map max min next open
    parseFloat parseInt print range repr require reversed set setInterval setTimeout setattr sorted str sum super tuple type
    warn zip""".split()
)
ROOT_TYPES = frozenset(("object", "Object"))


@dataclass
class Parsed:
    chunks: list[dict]
    imports: list[dict]


def distinct_calls(names: list[str]) -> list[str]:
    """Ordered distinct callees without the common ones and without dunder names."""
    return [n for n in dict.fromkeys(names) if n and n not in COMMON_CALLS and not (n.startswith("_") and n.endswith("__") and len(n) > 4)]


def distinct_supers(names: list[str]) -> list[str]:
    return [n for n in dict.fromkeys(names) if n and n not in ROOT_TYPES]


def signature_of(code: str) -> str:
    first = next((x for x in map(str.strip, code.split("\n")) if x), "")
    return first[:SIGNATURE_CAP] + "…" if len(first) > SIGNATURE_CAP else first


def chunk_row(relpath: str, language: str, kind: str, name: str, parent: str | None, content: bytes, start: int, end: int, sha: str, seq: int, calls: list[str], supers: list[str]) -> dict:
    """A chunk of the bytes ``start`` to ``end``; functions with a parent are methods."""
    code = content[start:end].decode("utf-8", "replace")
    first = content.count(b"\n", 0, start) + 1
    last = first + content.count(b"\n", start, end)
    sig = signature_of(code)
    if len(code) > CODE_CAP:
        missing = code.count("\n", CODE_CAP)
        code = f"{code[:CODE_CAP]}\n… (truncated — {missing} more lines; full source at {relpath}:{first})"
    key = hashlib.sha1(f"{relpath}:{start}:{end}:{sha}".encode()).hexdigest()[:16]
    return {
        "chunk_id": "chunk_" + key, "file_relpath": relpath, "language": language, "kind": "method" if kind == "function" and parent else kind,
        "name": name, "qualified_name": f"{parent}.{name}" if parent else name, "parent": parent, "signature": sig,
        "start_line": first, "end_line": last, "start_byte": start, "end_byte": end, "code": code, "file_sha": sha, "emit_seq": seq,
        "calls": distinct_calls(calls), "supers": distinct_supers(supers),
    }
