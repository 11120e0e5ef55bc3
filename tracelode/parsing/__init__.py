"""Source parsers: one pass over a file gives its chunks with calls and supertypes, and its imports."""

from __future__ import annotations

from .brace_source import parse_brace
from .python_source import parse_python
from .rows import Parsed


def parse_source(relpath: str, language: str, content: bytes) -> Parsed:
    """Chunks and imports of a file; a language without a parser gives none."""
    if not content:
        return Parsed([], [])
    if language == "python":
        return parse_python(relpath, content)
    if language in ("javascript", "typescript", "go", "rust", "java"):
        return parse_brace(relpath, language, content)
    return Parsed([], [])
