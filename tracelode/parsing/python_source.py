"""Python files by the standard library's syntax tree, with an indentation reader for files it rejects."""

from __future__ import annotations

import ast
import hashlib
import re

from .rows import Parsed, chunk_row

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _line_starts(content: bytes) -> list[int]:
    starts = [0]
    for line in content.split(b"\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    return starts


def _callee(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


class _Inner(dict):
    """Fields of a type of nodes that may hold calls, decorators first."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = tuple(sorted((f for f in kind._fields if f not in _PLAIN), key=lambda f: f != "decorator_list"))
        return self[kind]


_PLAIN = frozenset("arg asname attr conversion ctx id is_async kind kwd_attrs lineno module n name names op ops rest s simple tag type_comment".split())
_BODIES = frozenset("body orelse handlers finalbody cases".split())
_INNER = _Inner({ast.Constant: (), ast.Name: ()})


def _calls(node: ast.AST) -> list[str]:
    """Callees in source order, outer calls before those in their arguments."""
    found: list[str] = []

    def visit(n: ast.AST) -> None:
        if isinstance(n, ast.Call):
            found.append(_callee(n.func))
        for name in _INNER[n.__class__]:
            child = getattr(n, name, None)
            if isinstance(child, ast.AST):
                visit(child)
            elif child.__class__ is list:
                for c in child:
                    if isinstance(c, ast.AST):
                        visit(c)

    visit(node)
    return found


def _statements(node: ast.AST) -> list[ast.AST]:
    """Statements, handlers and cases right below a node: nothing else can hold an import or a definition."""
    return [c for name in node._fields if name in _BODIES and (inner := getattr(node, name, None)).__class__ is list for c in inner]


def parse_python(relpath: str, content: bytes) -> Parsed:
    """A decorated definition is one chunk from its first decorator on; nested functions belong to theirs."""
    sha = hashlib.sha1(content).hexdigest()
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _by_indentation(relpath, content, sha)
    starts = _line_starts(content)
    chunks: list[dict] = []
    imports: list[dict] = []

    def visit(node: ast.AST, parent: str | None) -> None:
        if isinstance(node, _DEFS):
            top = min([node, *node.decorator_list], key=lambda x: (x.lineno, x.col_offset))
            begin = starts[top.lineno - 1] + top.col_offset
            if top is not node:
                begin = content.rindex(b"@", 0, begin + 1)
            end = starts[node.end_lineno - 1] + node.end_col_offset
            is_class = isinstance(node, ast.ClassDef)
            supers = [_callee(b) for b in node.bases] if is_class else []
            chunks.append(chunk_row(relpath, "python", "class" if is_class else "function", node.name, parent, content, begin, end, sha, len(chunks), _calls(node), supers))
            for child in node.body:
                (visit if is_class else _imports)(child, *([node.name] if is_class else []))
            return
        _own_imports(node)
        for child in _statements(node):
            visit(child, parent)

    def _own_imports(node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            imports.extend({"importer": relpath, "language": "python", "target": a.name, "is_relative": False} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            target = "." * node.level + (node.module or "")
            imports.append({"importer": relpath, "language": "python", "target": target, "is_relative": node.level > 0})

    def _imports(node: ast.AST) -> None:
        level = [node]
        while level:
            for n in level:
                _own_imports(n)
            level = [c for n in level for c in _statements(n)]

    visit(tree, None)
    return Parsed(chunks, imports)


_HEAD = re.compile(rb"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)", re.M)
_IMPORT = re.compile(rb"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import\b|import[ \t]+([\w., \t]+))", re.M)
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")


def _by_indentation(relpath: str, content: bytes, sha: str) -> Parsed:
    """For sources that don't parse: definitions by their heads, up to the next line indented no deeper."""
    chunks: list[dict] = []
    open_: list[tuple[int, str, str]] = []
    for m in _HEAD.finditer(content):
        depth, what, name = len(m[1].expandtabs()), m[2].decode(), m[3].decode()
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        if open_ and open_[-1][1] == "def":
            continue
        at = content.find(b"\n", m.end())
        end = len(content.rstrip()) if at < 0 else at
        while 0 <= at < len(content):
            stop = content.find(b"\n", at + 1)
            line = content[at + 1 : stop if stop >= 0 else len(content)]
            if line.strip() and len(line.expandtabs()) - len(line.expandtabs().lstrip()) <= depth:
                break
            if line.strip():
                end = stop if stop >= 0 else len(content)
            at = stop
        begin = m.start() + len(m[1])
        text = content[begin:end].decode("utf-8", "replace")
        parent = open_[-1][2] if open_ else None
        calls = [c for c in _CALL.findall(text) if c not in ("def", "class", "if", "while", "return", "not", "and", "or", "in", name)]
        chunks.append(chunk_row(relpath, "python", "class" if what == "class" else "function", name, parent, content, begin, end, sha, len(chunks), calls, []))
        open_.append((depth, what, name))
    imports = []
    for m in _IMPORT.finditer(content):
        for target in [m[1].decode()] if m[1] else [x.split()[0] for x in m[2].decode().split(",") if x.split()]:
            imports.append({"importer": relpath, "language": "python", "target": target, "is_relative": target.startswith(".")})
    return Parsed(chunks, imports)
