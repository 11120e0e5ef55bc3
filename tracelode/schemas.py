"""Row types shared by all operators."""

from __future__ import annotations

CHUNKS = (
    "chunk_id string, file_relpath string, language string, kind string, name string, qualified_name string, parent string, "
    "signature string, start_line int, end_line int, start_byte int, end_byte int, code string, file_sha string, emit_seq int, "
    "calls array<string>, supers array<string>"
)
FILES = "relpath string, language string, size_bytes bigint, sha string, content binary"
IMPORTS = "importer string, language string, target string, is_relative boolean"
NODES = "id string, kind string, name string, qualified_name string, language string, file_relpath string, start_line int, end_line int, signature string, sha string"
EDGES = "src string, dst string, kind string, weight double"
PACKS = "id string, label string, scope array<string>, summary string, token_estimate bigint, chunk_count bigint, refreshed_at string, auto boolean"
MANIFEST = "relpath string, sha string, chunk_count int, indexed_at string"
HUNKS = (
    "path string, old_path string, is_added boolean, is_removed boolean, is_renamed boolean, is_binary boolean, hunk int, "
    "new_start int, new_length int, added array<int>, removed_count int, section_header string, body string"
)
FINDING = "file string, line int, severity string, category string, message string, fix string, end_line int, confidence double"

CHUNK_KINDS = ("function", "method", "class", "interface", "struct", "enum", "module", "file")
EDGE_KINDS = ("contains", "imports", "calls", "implements", "defines", "reads", "exposed_by", "backs")
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CATEGORIES = ("correctness", "design", "other", "performance", "security", "style", "testing")
