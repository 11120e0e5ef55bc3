"""JavaScript, TypeScript, Go, Rust and Java by a token reader that pairs brackets.

Strings, comments, template and regular-expression literals are skipped, so
brackets in them don't count. Declarations are recognised by their leading
tokens where a statement or member can start.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from .rows import Parsed, chunk_row

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)
    |(?P<word>[A-Za-z_$][\w$]*|[^\W\d][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|::|->|\.\.\.|[{}()\[\];:,.<>=?!&|+\-*/%^~@\#\\])
    |(?P<other>.)""",
    re.X | re.S,
)
_LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", ""}
_KEYWORDS = frozenset("if for while switch catch return function new typeof await else do with throw delete void in of case yield super import".split())


@dataclass
class Token:
    kind: str
    text: str
    at: int
    end: int
    match: int = -1


def tokens_of(text: str, language: str) -> list[Token]:
    """Tokens without space, with partners of brackets filled in."""
    out: list[Token] = []
    stack: list[int] = []
    at = 0
    while at < len(text):
        if language == "rust" and text[at] == "'" and (m := _LIFETIME.match(text, at)):
            at = m.end()
            continue
        if language in ("javascript", "typescript") and text[at] == "/" and (out[-1].text if out else "") in _BEFORE_REGEX and (m := _REGEX.match(text, at)):
            out.append(Token("string", m[0], at, m.end()))
            at = m.end()
            continue
        m = _TOKEN.match(text, at)
        kind = m.lastgroup or "other"
        if kind != "space":
            t = Token(kind, m[0], at, m.end())
            if t.text in ("{", "(", "["):
                stack.append(len(out))
            elif t.text in ("}", ")", "]") and stack and out[stack[-1]].text == {"}": "{", ")": "(", "]": "["}[t.text]:
                t.match = stack.pop()
                out[t.match].match = len(out)
            out.append(t)
        at = m.end()
    return out


class _Reader:
    def __init__(self, relpath: str, language: str, content: bytes):
        self.text = content.decode("utf-8", "replace")
        exact = len(self.text.encode()) == len(content) and "\ufffd" not in self.text
        self.content = content if exact else self.text.encode()
        self.relpath, self.language = relpath, language
        self.sha = hashlib.sha1(content).hexdigest()
        self.t = tokens_of(self.text, language)
        self.chunks: list[dict] = []
        self.byte_at = (lambda i: i) if self.text.isascii() else (lambda i: len(self.text[:i].encode()))

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def body(self, i: int, stop: str = ";") -> int:
        """The next ``{`` at this level, or -1 if the statement ends first."""
        depth_end = len(self.t)
        while i < depth_end:
            x = self.t[i]
            if x.text == "{":
                return i
            if x.text == stop or x.text == "}":
                return -1
            i = x.match + 1 if x.text in ("(", "[") and x.match > i else i + 1
        return -1

    def emit(self, kind: str, name: str, parent: str | None, first: int, last: int, supers: list[str] | None = None) -> None:
        a, b = self.byte_at(self.t[first].at), self.byte_at(self.t[last].end)
        calls = self.calls(first, last) if self.language in ("javascript", "typescript") else []
        self.chunks.append(chunk_row(self.relpath, self.language, kind, name, parent, self.content, a, b, self.sha, len(self.chunks), calls, supers or []))

    def calls(self, first: int, last: int) -> list[str]:
        found = []
        for i in range(first, last + 1):
            if self.t[i].kind != "word" or self.word(i) in _KEYWORDS:
                continue
            j = i + 1
            if self.word(i - 1) == "new" or self.word(j) == "(":
                declares = self.word(i - 1) in ("function", "get", "set", "class", "interface") or (self.word(i - 1) == "*" and self.word(i - 2) == "function")
                method = self.word(j) == "(" and self.t[j].match > 0 and self.word(self.t[j].match + 1) in ("{", ":") and self.word(i - 1) in ("{", "}", ";", "async", "static", "public", "private", "protected", "readonly", "override")
                if not declares and not method:
                    while self.word(i - 1) == "new" and self.word(j) == "." and j + 1 <= last:
                        i, j = j + 1, j + 2
                    found.append(self.word(i))
        return found

    def end_of(self, i: int) -> int:
        return self.t[i].match if self.t[i].match > i else len(self.t) - 1

    # JavaScript and TypeScript

    def scripts(self, lo: int, hi: int, parent: str | None) -> None:
        i = lo
        while i < hi:
            w = self.word(i)
            starts = self.word(i - 1) not in (".", "=", "(", ",", "new", ":", "return")
            if w in ("class", "interface", "enum") and starts and self.t[i + 1 : i + 2] and self.t[i + 1].kind == "word" and (w == "class" or self.language == "typescript"):
                b = self.body(i)
                if b > 0:
                    first = i - 1 if self.word(i - 1) in ("abstract", "const") and w != "interface" else i
                    end, name = self.end_of(b), self.word(i + 1)
                    self.emit(w, name, parent, first, end, self.heritage(i + 2, b))
                    if w == "class":
                        self.members(b + 1, end, name)
                    i = end + 1
                    continue
            if w == "function" and starts:
                j = i + 2 if self.word(i + 1) == "*" else i + 1
                b = self.body(j)
                if b > 0 and self.t[j].kind == "word":
                    first = i - 1 if self.word(i - 1) == "async" else i
                    self.emit("function", self.word(j), parent, first, self.end_of(b))
                    i = self.end_of(b) + 1
                    continue
            i += 1

    def heritage(self, i: int, hi: int) -> list[str]:
        names, on, angle, last = [], False, 0, ""
        while i < hi:
            w = self.word(i)
            if w == "<":
                angle += 1
            elif w == ">":
                angle -= 1
            elif not angle:
                if w in ("extends", "implements", ","):
                    names += [last] if on and last else []
                    on, last = on or w != ",", ""
                elif self.t[i].kind == "word":
                    last = w
            i += 1
        return names + ([last] if on and last else [])

    def members(self, lo: int, hi: int, parent: str) -> None:
        i = lo
        while i < hi:
            first = i
            while self.word(i) == "@":
                i += 2
                while self.word(i) == ".":
                    i += 2
                i = self.t[i].match + 1 if self.word(i) == "(" and self.t[i].match > 0 else i
                first = i
            while self.word(i) in ("static", "async", "public", "private", "protected", "readonly", "override", "abstract", "get", "set", "*", "#") and self.word(i + 1) not in ("(", "=", ";", ":"):
                i += 1
            j = i + 1
            if self.word(j) == "<":
                depth = 0
                while j < hi:
                    depth += {"<": 1, ">": -1}.get(self.word(j), 0)
                    j += 1
                    if not depth:
                        break
            if i < hi and self.t[i].kind in ("word", "string") and self.word(j) == "(" and self.t[j].match > 0:
                b = self.body(self.t[j].match + 1)
                if b > 0:
                    self.emit("method", self.word(i).strip("\"'"), parent, first, self.end_of(b))
                    i = self.end_of(b) + 1
                    continue
                if self.language == "typescript":
                    end = self.statement_end(i, hi)
                    self.emit("method", self.word(i), parent, first, end - 1 if self.word(end) == ";" else end)
                    i = end + 1
                    continue
            i = self.statement_end(i, hi) + 1

    def statement_end(self, i: int, hi: int) -> int:
        """Last token of a member without a body of its own: at ``;``, or where the next line starts anew."""
        while i < hi:
            x = self.t[i]
            if x.text == ";":
                return i
            if x.text in ("{", "(", "[") and x.match > i:
                i = x.match
            if i + 1 >= hi:
                return i
            if "\n" in self.text[self.t[i].end : self.t[i + 1].at] and self.word(i) not in ("=", ",", "=>", "(", "+", "|", "&", "?", ":") and self.word(i + 1) not in (".", "=", "|", "&", "?", ":", "{"):
                return i
            i += 1
        return hi - 1

    def script_imports(self) -> list[dict]:
        out = []

        def add(i: int) -> None:
            target = self.word(i)[1:-1]
            if target:
                relative = target in (".", "..") or target.startswith(("./", "../"))
                out.append({"importer": self.relpath, "language": self.language, "target": target, "is_relative": relative})

        for i, x in enumerate(self.t):
            if x.text == "import" and self.word(i - 1) != "." and self.word(i + 1) not in ("(", "."):
                j = i + 1
                while j < len(self.t) and self.t[j].kind != "string" and self.word(j) != ";":
                    j += 1
                if j < len(self.t) and self.t[j].kind == "string":
                    add(j)
            elif x.text == "require" and self.word(i - 1) != "." and self.word(i + 1) == "(" and self.t[i + 2 : i + 3] and self.t[i + 2].kind == "string":
                add(i + 2)
        return out

    # Go

    def go(self) -> None:
        i = 0
        while i < len(self.t):
            w = self.word(i)
            fresh = i == 0 or "\n" in self.text[self.t[i - 1].end : self.t[i].at] or self.word(i - 1) in (";", "}")
            if w == "func" and fresh:
                method = self.word(i + 1) == "("
                j = self.t[i + 1].match + 1 if method and self.t[i + 1].match > 0 else i + 1
                b = self.body(j)
                if b > 0 and j < len(self.t) and self.t[j].kind == "word":
                    self.emit("method" if method else "function", self.word(j), None, i, self.end_of(b))
                    i = self.end_of(b) + 1
                    continue
            if w == "type" and fresh:
                j = i + 2 if self.word(i + 1) == "(" else i + 1
                end = self.t[i + 1].match if self.word(i + 1) == "(" and self.t[i + 1].match > 0 else self.statement_end(i, len(self.t))
                if j < len(self.t) and self.t[j].kind == "word":
                    self.emit("struct", self.word(j), None, i, end)
                i = end + 1
                continue
            i += 1

    # Rust

    def rust(self, lo: int, hi: int, parent: str | None) -> None:
        kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "interface", "impl": "class"}
        i = lo
        while i < hi:
            w = self.word(i)
            if w in kinds and self.word(i - 1) not in (":", "(", ",", "<", "->", "=", "&") and i + 1 < hi:
                first = i
                while self.word(first - 1) in ("pub", "async", "unsafe", "const", "extern") or (self.word(first - 1) == ")" and self.word(self.t[first - 1].match - 1) == "pub"):
                    first = self.t[first - 1].match if self.word(first - 1) == ")" else first - 1
                b = self.body(i)
                name = self.impl_name(i + 1, b) if w == "impl" else self.word(i + 1)
                end = self.end_of(b) if b > 0 else self.statement_end(i, hi)
                if (b > 0 or w == "struct") and name:
                    self.emit(kinds[w], name, parent, first, end)
                    if w in ("impl", "trait"):
                        self.rust(b + 1, end, name)
                i = end + 1
                continue
            i += 1

    def impl_name(self, i: int, hi: int) -> str:
        """Type of ``impl Type`` and ``impl Trait for Type``, generics left out."""
        name, angle = "", 0
        while i < hi:
            w = self.word(i)
            if w in ("<", ">"):
                angle += 1 if w == "<" else -1
            elif not angle and w == "where":
                break
            elif not angle and w == "for":
                name = ""
            elif not angle and self.t[i].kind == "word":
                name = w
            i += 1
        return name

    # Java

    def java(self, lo: int, hi: int, parent: str | None) -> None:
        i = first = lo
        while i < hi:
            w = self.word(i)
            if w in ("class", "interface", "enum") and self.word(i - 1) != "." and i + 1 < hi and self.t[i + 1].kind == "word":
                b = self.body(i)
                if b > 0:
                    end, name = self.end_of(b), self.word(i + 1)
                    self.emit(w, name, parent, first, end)
                    self.java(b + 1, end, name)
                    i = first = end + 1
                    continue
            if self.t[i].kind == "word" and parent and self.word(i + 1) == "(" and self.t[i + 1].match > 0 and self.word(i - 1) not in (".", "new", "@", "="):
                b = self.body(self.t[i + 1].match + 1)
                end = self.end_of(b) if b > 0 else self.statement_end(i, hi)
                if b > 0 or self.word(end) == ";":
                    self.emit("method", w, parent, first, end)
                    i = first = end + 1
                    continue
            if w == "@" and self.word(i + 2) == "(" and self.t[i + 2].match > 0:
                i = self.t[i + 2].match + 1
                continue
            if w in (";", "}"):
                first = i + 1
            elif w == "{":
                i = first = self.end_of(i) + 1
                continue
            elif w == "=":
                i = first = self.statement_end(i, hi) + 1
                continue
            i += 1


def parse_brace(relpath: str, language: str, content: bytes) -> Parsed:
    """Chunks (pre-order) and imports; interface bodies of scripts are not entered."""
    r = _Reader(relpath, language, content)
    n = len(r.t)
    if language in ("javascript", "typescript"):
        r.scripts(0, n, None)
        return Parsed(r.chunks, r.script_imports())
    {"go": r.go, "rust": lambda: r.rust(0, n, None), "java": lambda: r.java(0, n, None)}[language]()
    return Parsed(r.chunks, [])
