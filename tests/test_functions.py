"""Globs, ignore rules, diffs, intervals, findings, rank fusion and metering against plain Python."""

from __future__ import annotations

import fnmatch
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.functions import globs, text
from tracelode.operators import embedding, graph, incremental, intervals, meter, packs, review, search
from tracelode.sources import diffs, repo
from tracelode.sources.state import RepoState, load_state, save_state

DIFF = """diff --git a/web/cart.ts b/web/cart.ts
index 1..2 100644
--- a/web/cart.ts
+++ b/web/cart.ts
@@ -10,5 +10,8 @@ class Cart {
 one
 two
+three
+four
+five
 six
-old
+new
 seven
diff --git a/docs/NEW.md b/docs/NEW.md
new file mode 100755
--- /dev/null
+++ b/docs/NEW.md
@@ -0,0 +1,2 @@
+a
+b
diff --git a/x.bin b/x.bin
Binary files a/x.bin and b/x.bin differ
diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


@settings(max_examples=300, deadline=None)
@given(st.text("ab/.*?[]!-", max_size=8), st.text("ab/.-", max_size=8))
def test_glob_equals_fnmatch(pattern, path):
    want = fnmatch.fnmatchcase(path, pattern) or ("/" in pattern and not pattern.startswith("**/") and fnmatch.fnmatchcase(path, "**/" + pattern))
    try:
        got = re.match(globs.glob_regex(pattern), path) is not None
    except re.error:
        return
    assert got == want or "[" in pattern


def test_ignore_rules():
    rules = globs.ignore_rules("# c\n*.log\n!keep.log\n/root.py\nbuild/\ndocs/**/x.py\n")
    ignored = lambda p: [not n for n, r in rules if re.match(r, p)][-1:] == [True]
    assert ignored("a/b.log") and not ignored("a/keep.log") and ignored("root.py") and not ignored("a/root.py")
    rules = globs.ignore_rules("x[0-9].py\n[!a]z.py\nodd\\ name\nend\\ \n\\#lit\n")
    assert ignored("x4.py") and not ignored("xa.py") and ignored("bz.py") and not ignored("az.py") and not ignored("a/z.py")
    assert ignored("odd name") and ignored("end ") and ignored("#lit")
    rules = globs.ignore_rules("# c\n*.log\n!keep.log\n/root.py\nbuild/\ndocs/**/x.py\n")
    assert ignored("a/build/z.py") and not ignored("build") and ignored("docs/a/b/x.py") and ignored("docs/x.py")


def test_diff():
    rows = {(r["path"], r["hunk"]): r for r in diffs.parse_diff(DIFF)}
    first = rows["web/cart.ts", 0]
    assert (first["new_start"], first["new_length"], first["added"], first["removed_count"], first["section_header"]) == (10, 8, [12, 13, 14, 16], 1, "class Cart {")
    new = rows["docs/NEW.md", 0]
    assert new["is_added"] and new["added"] == [1, 2] and new["old_path"] is None
    assert rows["x.bin", -1]["is_binary"]
    assert rows["new.py", -1]["is_renamed"] and rows["new.py", -1]["old_path"] == "old.py"
    assert rows["gone.py", 0]["is_removed"]
    assert diffs.parse_diff("") == []


def test_diff_table_and_ranges(spark):
    hunks = diffs.diff_hunks(spark.createDataFrame([(DIFF, 7), (None, 8), ("", 9)], "diff string, id int"))
    assert {r["id"] for r in hunks.collect()} == {7}
    assert {r["path"] for r in diffs.reviewable(hunks).collect()} == {"web/cart.ts", "docs/NEW.md"}
    ranges = {(r["path"], r["range_start"], r["range_end"]) for r in diffs.added_ranges(hunks).collect()}
    assert ranges == {("web/cart.ts", 12, 14), ("web/cart.ts", 16, 16), ("docs/NEW.md", 1, 2)}


def test_islands_random(spark):
    random.seed(1)
    rows = [(random.randrange(3), random.randrange(30)) for _ in range(80)]
    got = {tuple(r) for r in intervals.islands(spark.createDataFrame(rows, "k int, n int"), ["k"], "n").collect()}
    want = set()
    for k in range(3):
        have = sorted({n for q, n in rows if q == k})
        while have:
            end = have[0]
            while end + 1 in have:
                end += 1
            want.add((k, have[0], end))
            have = [n for n in have if n > end]
    assert got == want


def test_rank_fusion(spark):
    pool = spark.createDataFrame([(0, 0.9, 0.0), (1, 0.8, 5.0), (2, 0.7, 0.5), (3, 0.6, 0.0)], "id int, score double, lex double")
    assert [r["id"] for r in search.fuse_ranks(pool).orderBy("rank").collect()] == [1, 0, 2, 3]
    silent = pool.withColumn("lex", F.lit(0.0))
    assert [r["id"] for r in search.fuse_ranks(silent).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_batch_nearest_equals_brute_force(spark):
    random.seed(2)
    vectors = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    queries = [(100 + i, [random.gauss(0, 1) for _ in range(6)]) for i in range(5)]
    out = search.batch_nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(4), spark.createDataFrame(queries, "query_id bigint, q array<double>"), 7)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in out.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q, v in queries:
        best = sorted(vectors, key=lambda x: -cos(x[1], v))[:7]
        assert [got[q, i + 1] for i in range(7)] == [x[0] for x in best]


def test_graph_golden(spark):
    """Callers, containers and importers of a function, with depth, kinds and scores."""
    nodes = spark.createDataFrame([(n, k) for n, k in [("users.py", "file"), ("auth.py", "file"), ("billing.py", "file"), ("get_user", "function"), ("login", "function"), ("charge", "function"), ("Store.get", "method")]], "id string, kind string")
    rows = [("users.py", "get_user", "contains"), ("auth.py", "login", "contains"), ("billing.py", "charge", "contains"), ("auth.py", "users.py", "imports"), ("billing.py", "users.py", "imports"), ("login", "get_user", "calls"), ("charge", "get_user", "calls"), ("get_user", "Store.get", "calls")]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    found = graph.impact(nodes, edges, spark.createDataFrame([("get_user",)], "node string"))
    assert {tuple(r) for r in found.collect()} == {
        ("login", "function", 1, "calls", 1.15), ("charge", "function", 1, "calls", 1.15), ("users.py", "file", 1, "contains", 0.69),
        ("auth.py", "file", 2, "contains,imports", 0.345), ("billing.py", "file", 2, "contains,imports", 0.345),
    }
    assert graph.risk(found).first()["risk"] == "medium"
    assert graph.risk(found.limit(0)).first()["risk"] == "none"


def test_bfs_equals_plain_search(spark):
    random.seed(5)
    rows = [(str(random.randrange(40)), str(random.randrange(40)), random.choice("ab")) for _ in range(90)]
    got = {r["node"]: r["depth"] for r in graph.bfs(spark.createDataFrame(rows, "src string, dst string, kind string"), spark.createDataFrame([("1",), ("2",)], "node string"), "out", 4).collect()}
    want = {"1": 0, "2": 0}
    for d in range(1, 5):
        for s, t, _ in rows:
            if want.get(s) == d - 1 and t not in want:
                want[t] = d
    assert got == want


def test_import_candidates(spark):
    rows = [("a/b/c.py", "python", "..x.y", True), ("a/b/c.py", "python", "x.y", False), ("a/b/c.ts", "typescript", "../d/e", True), ("a/b/c.ts", "typescript", "lib", False), ("a/c.py", "python", ".", True)]
    imports = graph.import_candidates(spark.createDataFrame(rows, "importer string, language string, target string, is_relative boolean"))
    paths = spark.createDataFrame([("a/x/y.pyi",), ("x/y/__init__.py",), ("a/d/e/index.ts",), ("a/__init__.py",)], "relpath string")
    got = {(r["importer"], r["target"]): (r["resolved"], r["weight"]) for r in graph.resolve_imports(imports, paths).collect()}
    assert got == {
        ("a/b/c.py", "..x.y"): ("file:a/x/y.pyi", 0.5), ("a/b/c.py", "x.y"): ("file:x/y/__init__.py", 0.5),
        ("a/b/c.ts", "../d/e"): ("file:a/d/e/index.ts", 0.5), ("a/b/c.ts", "lib"): ("module:lib", 0.3), ("a/c.py", "."): ("file:a/__init__.py", 0.5),
    }


def test_findings(spark):
    raw = '{"findings": [{"file": "a", "line": 14, "severity": "LOW", "message": "m"}, {"file": "a", "line": 99, "category": "security", "message": "n", "severity": "critical"}, {"file": "ghost", "line": 1, "severity": "high", "message": "o"}, {"file": "a", "line": null, "severity": "low", "message": "p"}, {"file": "a", "line": 1, "severity": "odd", "message": "q"}, 5]}'
    answers = spark.createDataFrame([(f"Sure!\n```json\n{raw}\n```",), ("no json",), (None,)], "raw string")
    found = review.parse_findings(answers)
    assert [r["line"] for r in review.order_findings(found).collect()] == [99, 1, 14]
    ranges = spark.createDataFrame([("a", 12, 14)], "path string, range_start int, range_end int")
    assert [r["line"] for r in review.clamp(found, ranges).collect()] == [14]


def test_clamp_meets_ranges_of_one_file_without_pairing_them(spark):
    random.seed(3)
    span = lambda: (random.choice("ab"), random.randrange(-40, 60_000), random.choice([None, 0, 3, 40_000, -5]))
    found = [(i, f, n, None if d is None else n + d) for i, (f, n, d) in enumerate(span() for _ in range(300))] + [(300, None, 1, 2), (301, "a", None, None), (302, "c", 1, 2)]
    told = [(f, n, n + (d or 0) % 50 - 3) for f, n, d in (span() for _ in range(60))] + [(None, 1, 2), ("a", None, 9), ("a", 9, None)]
    findings = spark.createDataFrame(found, "id int, file string, line int, end_line int")
    ranges = spark.createDataFrame(told, "path string, range_start bigint, range_end bigint")
    got = review.clamp(findings, ranges)
    assert got.columns == findings.columns
    know = lambda *v: None not in v
    want = {i for i, f, n, e in found for p, a, b in told if know(f, n, a, b) and f == p and n <= b and a <= (n if e is None else e)}
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    joins = re.findall(r"Join [^\n]*", got._jdf.queryExecution().optimizedPlan().toString())
    assert joins and all("__block" in j and "range_start" not in j for j in joins)


def test_lenient_json(spark):
    rows = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'well {"a": 3} so', "garbage", "", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "raw string").select(text.lenient_json(F.col("raw"))).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', "{}", "{}", "{}"]


def test_meter(spark):
    usage = spark.createDataFrame([("tier", "large", 1234, 567), ("local", "x", 5, 5), ("tier", "large", -5, None)], "provider string, model string, input_tokens bigint, output_tokens bigint")
    rows = {r["input_tokens"]: r for r in meter.cost_line(meter.price_usage(usage, meter.price_table(spark))).collect()}
    assert rows[1234]["line"] == "1,234 in + 567 out tok | $0.0185 + $0.0425 = $0.0610 (tier:large)"
    assert rows[5]["total_usd"] == 0 and rows[5]["line"] == "5 in + 5 out tokens | no API cost (local:x)"
    assert rows[0]["line"].startswith("~0 in + ~500 out") and not rows[0]["exact"]
    odd = spark.createDataFrame([("tier", "none", 100, 50, 7), ("TIER", "small", 999, None, 70)], "provider string, model string, input_tokens bigint, output_tokens bigint, estimated_input bigint")
    rows = {r["model"]: r["line"] for r in meter.cost_line(meter.price_usage(odd, meter.price_table(spark))).collect()}
    assert rows["none"] == "100 in + 50 out tokens | pricing unknown (tier:none)"
    assert rows["small"].startswith("~70 in + ~500 out tok | $0.0001")
    assert [r[0] for r in spark.createDataFrame([("abcdefgh",), (None,)], "x string").select(meter.token_count(F.col("x"), "no such encoding")).collect()] == [2, 0]


def test_merging_keeps_one_row_per_key(spark, tmp_path):
    row = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    out = incremental.upsert(row((1, "a"), (2, "b")), row((2, "c"), (2, "d"), (3, None)), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "d"), (3, None)]
    t = incremental.VersionedTable(spark, str(tmp_path / "t"), "k", 4)
    t.replace(row(*[(i, "x") for i in range(40)]))
    before = set(t._pointer()["folders"])
    assert t.upsert(row((7, "y"), (7, "z")), "k") == 1
    assert len(before & set(t._pointer()["folders"])) == len(before) - 1  # one folder was rewritten
    assert {r["k"]: r["v"] for r in t.read().collect()} == {i: "z" if i == 7 else "x" for i in range(40)}
    assert t.delete(row(*[(i, "") for i in range(40)]), "k") == 40 and t.read().count() == 0 and t.read().columns == ["k", "v"]


def test_odd_vectors_are_never_found(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.5, 0.5]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, q array<double>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in search.batch_nearest(v, q, 2).orderBy("rank").collect()] == [(1, 1, 1), (1, 6, 2)]
    assert search.batch_nearest(v, q.limit(0)).count() == 0
    assert [r["vec_id"] for r in search.nearest(v.where("vec_id <> 5"), q.where("query_id = 1")).orderBy("rank").collect()] == [1, 6, 4]


def test_text_functions(spark):
    d = spark.createDataFrame([("Auth Module",), ("API / Gateway",), ("pack_already",)], "x string")
    assert [r[0] for r in d.select(text.slug(F.col("x"))).collect()] == ["pack_auth_module", "pack_api_gateway", "pack_already"]
    e = spark.createDataFrame([("",), ("abc",), ("x" * 9,), (None,)], "x string")
    assert [r[0] for r in e.select(text.token_estimate(F.col("x"))).collect()] == [0, 1, 2, 0]


def test_walk(spark, tmp_path):
    for path, body in {"a.py": "def f(): pass\n", "node_modules/x.py": "x", ".git/y.py": "y", ".hidden.py": "z = 1\n", "pkg/__init__.py": "w = 1\n", "empty.py": "", "big.js": "x" * 1_500_001, "n.md": "n", "skip/z.py": "z", "src/B.TS": "class B {}"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    (tmp_path / ".gitignore").write_text("skip/\n")
    files = repo.scan_repo(spark, str(tmp_path))
    assert {r["relpath"]: r["language"] for r in files.collect()} == {"a.py": "python", ".hidden.py": "python", "pkg/__init__.py": "python", "src/B.TS": "typescript"}
    chunks = repo.chunks_of(repo.parse_files(files))
    assert {(r["file_relpath"], r["name"]) for r in chunks.collect()} == {("a.py", "f"), ("src/B.TS", "B")}


def test_state(tmp_path):
    path = str(tmp_path / "s.json")
    assert load_state(path) == RepoState()
    s = RepoState()
    s.add("pinned", "a", "b", "a")
    s.add("attached", "c", "a")
    s.excluded = ["b"]
    assert s.active == ["a", "c"]
    save_state(path, s)
    assert load_state(path) == s
    s.clear_attached()
    assert s.active == ["a"]
    (tmp_path / "s.json").write_text("{")
    assert load_state(path) == RepoState()


def test_versioned_table(spark, tmp_path):
    t = incremental.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists()
    row = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    t.replace(row((1, "a"), (2, "b")))
    old = t.read()
    assert t.upsert(row((2, "c"), (3, "d")), "k") == 2
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert old.count() == 2
    assert t.delete(row((1, ""), (9, "")), "k") == 1
    t.vacuum()
    assert t.read().count() == 2


def test_packs(spark):
    paths = spark.createDataFrame([("backend/auth/login.ts",), ("frontend/index.tsx",)], "relpath string")
    tagged = packs.tag_paths(paths, [("pack_auth", ["**/auth/**"]), ("pack_none", [])])
    assert [r["packs"] for r in tagged.collect()] == [["pack_auth"], []]
    chunks = spark.createDataFrame([(f"{d}/f{i}.py", 40) for d in ("backend", "cms") for i in range(3)] + [("root.py", 9)], "file_relpath string, n_chars int")
    assert [(r["label"], r["chunk_count"], r["token_estimate"]) for r in packs.suggest(chunks).collect()] == [("Backend", 3, 30), ("Cms", 3, 30)]


def test_embeddings(spark):
    texts = spark.createDataFrame([("s1", "alpha beta"), ("s1", "alpha beta"), ("s2", "gamma"), ("s3", "")], "sha string, text string")
    cache = spark.createDataFrame([("m", "s2", 4, [1.0])], "model string, sha string, dim int, vector array<float>")
    new = embedding.embed_misses(texts, cache, "m", embedding.hashing_embedder(16)).collect()
    assert {r["sha"] for r in new} == {"s1", "s3"} and all(r["dim"] == 16 for r in new)


def test_distinct_pairs_of_edges_are_dealt_by_size_not_by_the_session(spark):
    from tracelode.plans import star_graph
    from tracelode.settle import parts_of

    lines = star_graph.table(spark, "/root/testdata/sf0.001", "lineitem")
    cores, was = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    assert parts_of(lines) == cores and parts_of(lines, 1000) > 50
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert star_graph.edges(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_incident_edges_are_picked_before_pairs_are_made_distinct(spark):
    from tracelode.plans import star_graph

    edges = star_graph.edges(spark, "/root/testdata/sf0.001")
    ids = spark.createDataFrame([("p:12",), ("p:12",), ("n:1",), (None,)], "node string")
    got = graph.incident_edges(edges, ids)
    assert got.columns == ["direction", "of", "node", "kind"]
    want = [("out", e["src"], e["dst"], e["kind"]) for e in edges.collect() if e["src"] in ("p:12", "n:1")] + [("in", e["dst"], e["src"], e["kind"]) for e in edges.collect() if e["dst"] in ("p:12", "n:1")]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 14 and "Join Inner" not in plan


def test_containing_meets_only_near_ranges_of_a_file(spark):
    random.seed(5)
    span = lambda i, most: (i, random.choice("ab"), (n := random.randrange(-300, 3000)), n + random.choice([0, 0, 1, 2, 3, 7, 8, 64, most, -1, -4]))
    left, right = [span(i, 200) for i in range(150)] + [(150, None, 1, 2), (151, "a", None, 2)], [span(i, 2500) for i in range(150)] + [(150, None, 1, 2), (151, "a", 1, None)]
    hunks = spark.createDataFrame(left, "hunk_id int, path string, new_start int, new_end int")
    chunks = spark.createDataFrame(right, "chunk_id int, path string, start_line int, end_line int")
    got = sorted(map(tuple, review.containing(hunks, chunks, 5).collect()))
    want = []
    for h, p, a, b in left:
        met = sorted((e - s, s, c) for c, q, s, e in right if None not in (p, a, b, q, s, e) and p == q and s <= b and a <= e)
        want += [(h, c, r + 1) for r, (_, _, c) in enumerate(met[:5])]
    assert got == sorted(want) and len(got) > 300
    assert review.containing(hunks.where("false"), chunks).count() == 0 == review.containing(hunks, chunks.where("false")).count()
    joins = re.findall(r"Join Inner, [^\n]*", review.containing(hunks, chunks)._jdf.queryExecution().optimizedPlan().toString())
    assert len(joins) == 1 and "bin" in joins[0] and "at" in joins[0]
