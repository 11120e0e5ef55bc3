"""Command line: index, graph, ask, impact, review and packs over a repository.

Exit codes: 0 done, 1 findings or nothing found, 2 bad use (a diff that git
can't give, too), 3 no repository.
"""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from .api import EchoModel, Workspace, quickstart
from .session import local_session


def run(arguments: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tracelode")
    p.add_argument("--home", default=".tracelode")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("index", "graph", "quickstart", "analyze"):
        s = sub.add_parser(verb)
        s.add_argument("root")
        s.add_argument("--full", action="store_true")
    s = sub.add_parser("ask")
    s.add_argument("question")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--all-packs", action="store_true")
    s = sub.add_parser("impact")
    s.add_argument("targets", nargs="*")
    _add_diff(s)
    s.add_argument("--depth", type=int, default=3)
    s.add_argument("--limit", default=25, type=int)
    s.add_argument("--kinds", default="", help="kinds of edges to follow, with commas; all of them if left out")
    s.add_argument("--json", action="store_true", help="one JSON object a line")
    s = sub.add_parser("review", help="clamps a model's findings to a diff and prints them, worst first")
    s.add_argument("answer", help="file with the model's answer")
    _add_diff(s)
    s.add_argument("--json", action="store_true", help="one JSON object a line")
    sub.add_parser("examples", help="prints a few ways to call this")
    sub.add_parser("status")
    s = sub.add_parser("packs")
    s.add_argument("what", choices="list show suggest apply create delete attach detach pin unpin exclude include status".split())
    s.add_argument("names", nargs="*")
    a = p.parse_args(arguments)
    spark = local_session()
    w = Workspace(spark, a.home)
    try:
        return _run(a, w)
    except NotADirectoryError as e:
        print(f"not a directory: {e}", file=sys.stderr)
        return 3
    except subprocess.CalledProcessError as e:
        print(f"git gives no diff: {e.stderr.strip()}", file=sys.stderr)
        return 2


def _add_diff(s: argparse.ArgumentParser) -> None:
    s.add_argument("--diff", help="file with a unified diff, or - for standard input")
    s.add_argument("--staged", action="store_true", help="the staged changes of --repo")
    s.add_argument("--rev", help="what HEAD of --repo has changed since it left this revision")
    s.add_argument("--repo", default=".")


def _diff(a: argparse.Namespace, w: Workspace) -> str | None:
    if a.staged or a.rev:
        from .sources.diffs import git_diff

        return git_diff(w.spark, a.repo, a.rev).first()[0]
    return _text(a.diff) if a.diff else None


def _lines(rows) -> str:
    return "\n".join(json.dumps(r.asDict(True), ensure_ascii=False) for r in rows)


EXAMPLES = """tracelode quickstart PATH
tracelode ask "where are users loaded?"
tracelode impact get_user --json
tracelode impact --staged --repo PATH
tracelode review ANSWER.json --rev main --repo PATH
tracelode packs create "Script Code" "pkg/**\""""


def _text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Verb to what it does with which list of the state.
_STATE_VERBS = {
    "attach": ("add", "attached"), "detach": ("drop", "attached"), "pin": ("add", "pinned"), "unpin": ("drop", "pinned"),
    "exclude": ("add", "excluded"), "include": ("drop", "excluded"),
}


def _run(a: argparse.Namespace, w: Workspace) -> int:
    if a.verb == "index":
        print(w.index(a.root, a.full))
    elif a.verb == "graph":
        print(w.build_graph(a.root))
    elif a.verb == "quickstart":
        quickstart(w.spark, a.root, a.home)
    elif a.verb == "analyze":
        from .sources import repo

        repo.chunks_of(repo.parse_files(repo.scan_repo(w.spark, a.root))).groupBy("language", "kind").count().orderBy("count", ascending=False).show(100, False)
    elif a.verb == "ask":
        out = w.ask(a.question, k=a.k, all_packs=a.all_packs)
        print(w.render_hits(out["hits"]))
        print(f"about {out['prompt_tokens']} prompt tokens")
    elif a.verb == "examples":
        print(EXAMPLES)
    elif a.verb == "impact":
        kinds = {"kinds": tuple(a.kinds.split(","))} if a.kinds else {}
        found, risk = w.impact(a.targets, _diff(a, w), a.depth, **kinds)
        print(_lines(found.limit(a.limit).collect()) if a.json else w.render_impact(found, risk, a.limit))
        return 1 if risk.first()["n_affected"] == 0 else 0
    elif a.verb == "review":
        out = w.review_report(_diff(a, w) or "", EchoModel(_text(a.answer)))
        rows = out["findings"].collect()
        print(_lines(rows) if a.json else w.render_findings(out["findings"]))
        if not a.json:
            print(f"{out['files_reviewed']} of {out['files']} files reviewed, {out['files_skipped']} skipped | {out['cost']}")
        return 1 if rows else 0
    elif a.verb == "status":
        print(w.status())
    elif a.what in _STATE_VERBS:
        state, (change, where) = w.state(), _STATE_VERBS[a.what]
        if change == "add" and (unknown := w.unknown_packs(a.names)):
            print(f"no such pack yet: {', '.join(unknown)}", file=sys.stderr)
        getattr(state, change)(where, *a.names)
        w.save(state)
    elif a.what == "show":
        rows = [w.show_pack(n) for n in a.names]
        print(*(json.dumps(r) if r else "no such pack" for r in rows), sep="\n")
        return 0 if all(rows) else 1
    elif a.what == "create":
        w.create_pack(a.names[0], a.names[1:])
    elif a.what == "delete":
        for name in a.names:
            w.delete_pack(name)
    elif a.what == "status":
        print(w.state())
    elif a.what == "list":
        print(w.render_packs())
    else:
        w.suggest_packs(apply=a.what == "apply").show(40, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(run(sys.argv[1:]))
