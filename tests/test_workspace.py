"""Index, graph, search, impact and review over a small repository."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tracelode import cli, models, tools
from tracelode.api import EchoModel, Workspace


@pytest.fixture
def repo_dir(tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "users.py").write_text("class UserStore:\n    def get(self, k):\n        return self.d[k]\n\n\ndef get_user(k):\n    return UserStore().get(k)\n")
    (root / "auth.py").write_text("from users import get_user\n\n\ndef login(k):\n    return issue(get_user(k))\n\n\ndef issue(u):\n    return u\n")
    (root / "pkg" / "a.ts").write_text("import {b} from './b';\nexport class A extends B { go() { return helper(1); } }\n")
    (root / "pkg" / "b.ts").write_text("export class B {}\nexport function helper(x) { return x; }\n")
    return root


def test_incremental_index(spark, repo_dir, tmp_path):
    w = Workspace(spark, str(tmp_path / "home"))
    first = w.index(str(repo_dir))
    assert (first["indexed"], first["embeddings_computed"]) == (4, first["chunks"])
    again = w.index(str(repo_dir))
    assert (again["indexed"], again["reused"], again["embeddings_computed"]) == (0, 4, 0)
    (repo_dir / "pkg" / "b.ts").unlink()
    (repo_dir / "auth.py").write_text((repo_dir / "auth.py").read_text() + "\n\ndef more():\n    return login(2)\n")
    third = w.index(str(repo_dir))
    assert (third["indexed"], third["gone"], third["reused"]) == (1, 1, 2)
    names = {r["name"] for r in w.table("chunks").read().collect()}
    assert "more" in names and "helper" not in names


def test_graph_search_and_review(spark, repo_dir, tmp_path):
    w = Workspace(spark, str(tmp_path / "home"))
    w.index(str(repo_dir))
    w.build_graph(str(repo_dir))
    found, risk = w.impact(["get_user"])
    assert {r["qualified_name"]: r["via"] for r in found.collect()} == {"login": "calls", "users.py": "contains", "auth.py": "contains,imports"}
    assert risk.first()["risk"] == "medium"
    assert w.impact(["nowhere"])[1].first()["risk"] == "none"
    edges = {(r["kind"], r["n"]) for r in w.table("edges").read().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert ("implements", 1) in edges and ("imports", 2) in edges

    w.create_pack("Script Code", ["pkg/**"])
    w.retag()
    scoped = w.search(["which helper is called?"], scope=["pack_script_code"])
    assert {r["file_relpath"] for r in scoped.collect()} == {"pkg/a.ts", "pkg/b.ts"}
    out = w.ask("how does login get a user?", EchoModel("see auth.py"))
    assert out["hits"].orderBy("rank").first()["name"] == "login" and out["answer"] == "see auth.py"
    assert "auth.py:4-5" in out["prompt"]

    diff = "--- a/auth.py\n+++ b/auth.py\n@@ -4,2 +4,3 @@\n def login(k):\n+    check(k)\n     return issue(get_user(k))\n"
    model = EchoModel('{"findings": [{"file": "auth.py", "line": 5, "severity": "high", "message": "m"}, {"file": "auth.py", "line": 80, "severity": "low", "message": "n"}]}')
    assert [r["line"] for r in w.review(diff, model).collect()] == [5]
    assert "def login" in model.prompts[0]
    changed = "--- a/users.py\n+++ b/users.py\n@@ -6,2 +6,3 @@\n def get_user(k):\n+    check(k)\n     return UserStore().get(k)\n"
    assert {r["qualified_name"] for r in w.impact(diff=changed)[0].collect()} == {"login", "auth.py"}


class Flaky(EchoModel):
    """Fails for one file, tells its usage for the others."""

    def generate_structured(self, system, prompt, schema):
        assert schema["required"] == ["findings"]
        self.prompts.append(prompt)
        if "# File: pkg/b.ts" in prompt:
            raise RuntimeError("no answer")
        return models.Answer(self.answer, 1234, 567)


def test_review_counts_failures_and_shows_neighbours(spark, repo_dir, tmp_path):
    w = Workspace(spark, str(tmp_path / "home"))
    w.index(str(repo_dir))
    diff = "--- a/auth.py\n+++ b/auth.py\n@@ -4,2 +4,3 @@\n def login(k):\n+    get_user(k)\n     return issue(get_user(k))\n"
    diff += "--- a/pkg/b.ts\n+++ b/pkg/b.ts\n@@ -1,1 +1,2 @@\n export class B {}\n+export class C {}\ndiff --git a/x.bin b/x.bin\nBinary files a/x.bin and b/x.bin differ\n"
    model = Flaky('{"findings": [{"file": "auth.py", "line": 5, "severity": "high", "message": "m"}]}')
    model.provider, model.name = "tier", "large"
    out = w.review_report(diff, model)
    assert [(r["file"], r["line"]) for r in out["findings"].collect()] == [("auth.py", 5)]
    assert (out["files"], out["files_reviewed"], out["files_skipped"], out["errors"]) == (3, 1, 2, {"pkg/b.ts": "no answer"})
    assert out["cost"] == "1,234 in + 567 out tok | $0.0185 + $0.0425 = $0.0610 (tier:large)"
    near = next(p for p in model.prompts if "# File: auth.py" in p)
    related = near.split("## Related code")[1]
    assert "get_user" in related and "auth.py:" not in related


def test_answers_hold_what_the_graph_adds(spark, repo_dir, tmp_path):
    w = Workspace(spark, str(tmp_path / "home"))
    w.index(str(repo_dir))
    w.build_graph(str(repo_dir))
    out = w.ask("login", EchoModel("ok"), k=1)
    rows = out["hits"].orderBy("rank").collect()
    assert rows[0]["name"] == "login" and rows[0]["source"] == "vector"
    added = {r["name"]: (r["edge"], r["depth"], r["citation"]) for r in rows[1:]}
    assert added["get_user"] == ("calls", 1, "users.py:6-7") and added["issue"][0] == "calls"
    assert all(r["source"] == "graph" for r in rows[1:]) and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert "users.py:6-7" in out["prompt"] and "no API cost" in out["cost"]


def test_a_broken_run_is_made_good(spark, repo_dir, tmp_path, monkeypatch):
    from tracelode.operators.incremental import VersionedTable

    w = Workspace(spark, str(tmp_path / "home"))
    whole = VersionedTable.replace
    said = []

    def stop(self, df, partition=None):
        if self.path.endswith("manifest"):
            raise RuntimeError("power cut")
        whole(self, df, partition)

    monkeypatch.setattr(VersionedTable, "replace", stop)
    with pytest.raises(RuntimeError):
        w.index(str(repo_dir))
    monkeypatch.setattr(VersionedTable, "replace", whole)
    w.index(str(repo_dir), progress=lambda step, counts: said.append(step))
    chunks = w.table("chunks").read()
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0
    assert said == ["scanned", "embedded", "merged", "done"]
    # A pointer that can't be read counts as no table: everything is read again.
    (tmp_path / "home" / "manifest" / "CURRENT").write_text("{")
    (tmp_path / "home" / "manifest" / ".CURRENT.crc").unlink(missing_ok=True)
    assert w.index(str(repo_dir))["indexed"] == 4
    assert w.table("chunks").read().count() == chunks.count()
    w.reset()
    assert not w.table("chunks").exists() and w.status()["files"] == 0


def test_tools_answer_in_plain_text(spark, repo_dir, tmp_path):
    w = Workspace(spark, str(tmp_path / "home"))
    assert "no index" in tools.search_code(w, "x") and "no index" in tools.index_status(w) and "no graph" in tools.find_impact(w, "x")
    assert tools.index_repository(w, str(tmp_path / "none")).startswith("Not a directory")
    assert "4 read" in tools.index_repository(w, str(repo_dir))
    assert "auth.py:4-5" in tools.search_code(w, "login", limit=2) and "tokens" in tools.search_code(w, "login")
    assert "medium" in tools.find_impact(w, "get_user") and "not in the graph" in tools.find_impact(w, "nowhere")
    assert "no packs" in tools.list_packs(w)
    w.create_pack("Script Code", ["pkg/**"])
    w.retag()
    assert "pack_script_code" in tools.list_packs(w) and "chunks: " in tools.index_status(w)


def test_command_line(spark, repo_dir, tmp_path, capsys):
    home = ["--home", str(tmp_path / "home")]
    assert cli.run([*home, "quickstart", str(repo_dir)]) == 0
    assert cli.run([*home, "ask", "who logs in?"]) == 0
    assert cli.run([*home, "impact", "get_user"]) == 0 and cli.run([*home, "impact", "nothing"]) == 1
    (tmp_path / "d").write_text("--- a/auth.py\n+++ b/auth.py\n@@ -4,1 +4,2 @@\n def login(k):\n+    x()\n")
    (tmp_path / "a").write_text('{"findings": [{"file": "auth.py", "line": 5, "severity": "high", "message": "look"}]}')
    assert cli.run([*home, "review", str(tmp_path / "a"), "--diff", str(tmp_path / "d")]) == 1
    assert cli.run([*home, "packs", "pin", "pack_pkg"]) == 0 and cli.run([*home, "status"]) == 0
    assert cli.run([*home, "index", str(tmp_path / "none")]) == 3
    assert cli.run([*home, "impact", "get_user", "--json", "--kinds", "calls"]) == 0
    assert cli.run([*home, "packs", "exclude", "pack_odd"]) == 0 and cli.run([*home, "packs", "show", "pack_pkg"]) == 0 and cli.run([*home, "packs", "show", "none"]) == 1
    assert cli.run([*home, "impact", "--staged", "--repo", str(tmp_path)]) == 2 and cli.run([*home, "examples"]) == 0
    said = capsys.readouterr().out
    assert "auth.py:4-5" in said and "risk medium" in said and "auth.py:5" in said and "'active': ['pack_pkg']" in said


def test_provider_order():
    assert models.choose_provider({"OPENAI_API_KEY": "x", "LLM_BASE_URL": "y"}) == "local"
    assert models.choose_provider({"OPENAI_API_KEY": "x"}) == "openai"
    assert models.choose_provider({"OPENAI_API_KEY": "x"}, "local") == "local"
    with pytest.raises(LookupError):
        models.choose_provider({})
    models.register("mine", lambda env: EchoModel(env["A"]))
    assert models.make_model({"A": "said"}, "mine").generate("", "") == "said"


def test_missing_repository(spark, tmp_path):
    with pytest.raises(NotADirectoryError):
        Workspace(spark, str(tmp_path / "h")).index(str(tmp_path / "none"))
