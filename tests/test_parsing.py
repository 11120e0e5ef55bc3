"""Chunks, imports, calls and supertypes of the six languages."""

from __future__ import annotations

from tracelode.parsing import parse_source

PYTHON = '''"""Sample."""
import os


def top(x):
    return helper(x, len(x))


class Greeter(Base, abc.ABC, metaclass=Meta):
    def __init__(self, name):
        self.name = name

    @property
    def greet(self):
        return self.make(print(1))


def _last():
    def inner():
        pass
'''
SCRIPT = """import { a } from './a';
import b from "lib";
const c = require('../c');
export interface User { id: string; name(): void }
export function makeUser(n: string): User {
  return new Foo(n) || build('}');
}
export abstract class Service<T> extends Base<T> implements One, ns.Two<X> {
  private m = new Map();
  constructor(x) { super(x); }
  async add(u: User): Promise<void> { const r = /[}/]{/.test(`}${u}`); this.m.set(u); }
  get(k) { return k; }
}
"""


def names(parsed):
    return [(c["qualified_name"], c["kind"], c["start_line"], c["end_line"]) for c in parsed.chunks]


def test_python():
    p = parse_source("a/b.py", "python", PYTHON.encode())
    assert names(p) == [("top", "function", 5, 6), ("Greeter", "class", 9, 15), ("Greeter.__init__", "method", 10, 11), ("Greeter.greet", "method", 13, 15), ("_last", "function", 18, 20)]
    assert p.chunks[0]["calls"] == ["helper"]
    assert p.chunks[1]["supers"] == ["Base", "ABC"]
    assert p.chunks[3]["parent"] == "Greeter" and p.chunks[3]["code"].startswith("@property")
    assert [c["emit_seq"] for c in p.chunks] == list(range(5))
    raw = PYTHON.encode()
    assert all(raw[c["start_byte"] : c["end_byte"]].decode() == c["code"] for c in p.chunks)
    assert [i["target"] for i in p.imports] == ["os"]


def test_python_relative_imports():
    p = parse_source("a.py", "python", b"from . import x\nfrom ..b.c import d\nimport e.f as g, h\n")
    assert [(i["target"], i["is_relative"]) for i in p.imports] == [(".", True), ("..b.c", True), ("e.f", False), ("h", False)]


def test_python_that_does_not_parse_still_has_chunks():
    p = parse_source("a.py", "python", b"def f(:\n    g()\n\nclass K:\n    def m(self):\n        pass\n")
    assert [(c["qualified_name"], c["kind"]) for c in p.chunks] == [("f", "function"), ("K", "class"), ("K.m", "method")]


def test_decorated_definition_is_one_chunk():
    p = parse_source("a.py", "python", b"@one\n@two(3)\nclass A:\n    @three\n    def f(self): pass\n")
    assert [(c["qualified_name"], c["kind"], c["start_line"]) for c in p.chunks] == [("A", "class", 1), ("A.f", "method", 4)]


def test_giant_function_is_capped():
    body = "".join(f"    x{i} = {i}\n" for i in range(4000))
    [c] = parse_source("g.py", "python", f"def giant():\n{body}".encode()).chunks
    assert len(c["code"]) <= 8200 and "truncated" in c["code"] and c["end_line"] - c["start_line"] > 1000


def test_typescript():
    p = parse_source("s.ts", "typescript", SCRIPT.encode())
    assert [n[:2] for n in names(p)] == [("User", "interface"), ("makeUser", "function"), ("Service", "class"), ("Service.constructor", "method"), ("Service.add", "method"), ("Service.get", "method")]
    assert p.chunks[1]["calls"] == ["Foo", "build"]
    assert p.chunks[2]["supers"] == ["Base", "One", "Two"]
    assert [(i["target"], i["is_relative"]) for i in p.imports] == [("./a", True), ("lib", False), ("../c", True)]


def test_go_rust_java():
    go = parse_source("a.go", "go", b"package a\n\ntype P struct {\n  x int\n}\n\nfunc (p *P) Get() int { return 1 }\nfunc New() *P { return &P{} }\n")
    assert names(go) == [("P", "struct", 3, 5), ("Get", "method", 7, 7), ("New", "function", 8, 8)]
    rust = parse_source("a.rs", "rust", b"pub struct P<'a> { x: &'a str }\nimpl<'a> Show for P<'a> {\n  fn show(&self) { }\n}\ntrait T { fn b(&self) { } }\nenum E { A }\nfn main() {}\n")
    assert [n[:2] for n in names(rust)] == [("P", "struct"), ("P", "class"), ("P.show", "method"), ("T", "interface"), ("T.b", "method"), ("E", "enum"), ("main", "function")]
    java = parse_source("A.java", "java", b'@An("{")\npublic class A<T> extends B {\n  int x = f(1);\n  public A() { }\n  @Override\n  public int get() { return h(); }\n  interface I { void m(); }\n}\n')
    assert [n[:2] for n in names(java)] == [("A", "class"), ("A.A", "method"), ("A.get", "method"), ("A.I", "interface"), ("I.m", "method")]


def test_nothing_to_parse():
    assert parse_source("a.py", "python", b"").chunks == []
    assert parse_source("a.md", "markdown", b"# x").chunks == []
    assert parse_source("a.ts", "typescript", "class {{{ ' ` \ufffd".encode()).chunks == []


def test_small_tables_of_sources_are_parsed_in_many_tasks(spark):
    from tracelode.plans import code_queries

    rows = code_queries.py_chunks(spark, "/root/testdata/sf0.001").rdd
    assert rows.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    sizes = rows.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(sizes) <= 10 * sum(sizes) / len(sizes)


def test_calls_and_imports_in_every_kind_of_statement():
    text = b"""@deco(arg())
def f(x=default(), *, y: note() = 1) -> result():
    import a
    try:
        from b import c
    except error() as e:
        import d
    else:
        import g
    finally:
        import h
    with ctx() as w, lock():
        import i
    match x:
        case Point(y=0) if guard():
            import j
    return f"{fmt(lambda: inner())}" if test() else [item() for item in items() if keep()]
if flag():
    import k
    def g(): pass
"""
    p = parse_source("a.py", "python", text)
    assert p.chunks[0]["calls"] == "deco arg note default ctx lock guard test fmt inner item items keep result".split()
    assert [i["target"] for i in p.imports] == ["a", "b", "g", "h", "d", "i", "j", "k"] and [c["name"] for c in p.chunks] == ["f", "g"]


def test_graph_query_parses_once(spark):
    from tracelode.plans import code_queries

    plan = code_queries.graph_build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parquet" in plan
