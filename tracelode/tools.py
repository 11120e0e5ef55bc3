"""Five functions with plain-text results, for assistants that call tools: search, impact, packs, status, indexing.

Each takes a workspace; what would be an error for a person (nothing indexed,
nothing found) is a sentence in the result.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .api import Workspace
from .functions.text import token_estimate

_NO_INDEX = "This repository has no index yet: call index_repository first."


def search_code(w: Workspace, query: str, packs: list[str] | None = None, limit: int = 8) -> str:
    """Ranked code with citations and an estimate of its tokens."""
    if not w.table("chunks").exists():
        return _NO_INDEX
    hits = w.search([query], limit, packs).cache()
    rows = hits.orderBy("rank").select("rank", "citation", "kind", "qualified_name", "score", "language", "code").collect()
    if not rows:
        return f"Nothing matches {query!r}" + (f" in the packs {', '.join(packs)}" if packs else "") + "."
    tokens = hits.agg(F.sum(token_estimate(F.col("code")))).first()[0]
    scope = f", packs: {', '.join(packs)}" if packs else ""
    told = [f"{len(rows)} results for {query!r} (about {tokens:,} tokens{scope})"]
    told += [f"[{r['rank']}] {r['citation']}  {r['kind']} {r['qualified_name']}  score {r['score']:.3f}\n```{r['language']}\n{r['code'].rstrip()}\n```" for r in rows]
    return "\n\n".join(told)


def find_impact(w: Workspace, symbol: str, max_depth: int = 3, most: int = 25) -> str:
    """What depends on a name, a qualified name or a file, and how risky a change is."""
    if not w.table("edges").exists():
        return "This repository has no graph yet: call index_repository first."
    found, risk = w.impact([symbol], depth=max_depth)
    known = w.resolve([symbol])
    if not known:
        return f"{symbol!r} is not in the graph. Check its spelling, or give a file path."
    told = risk.first()
    if not told["n_affected"]:
        return f"Targets: {', '.join(known[:6])}\nNothing depends on {symbol!r}."
    more = [f"and {told['n_affected'] - most} more"] if told["n_affected"] > most else []
    return "\n".join([f"Targets: {', '.join(known[:6])}", w.render_impact(found, risk, most), *more])


def list_packs(w: Workspace) -> str:
    """The packs that searches can be scoped to."""
    return w.render_packs() or "There are no packs yet: apply suggested ones or create one."


def index_status(w: Workspace) -> str:
    """Is there an index, and how large is it?"""
    if not w.table("chunks").exists():
        return _NO_INDEX
    told = w.status()
    graph = "yes" if w.table("edges").exists() else "no"
    return f"home: {w.home}\nfiles: {told['files']}\nchunks: {told['chunks']}\ngraph: {graph}\npacks: {len(told['packs'])}\nindexed at: {told['indexed_at']}"


def index_repository(w: Workspace, root: str, reset: bool = False) -> str:
    """Brings index and graph up to date."""
    if "://" not in root and not os.path.isdir(root):
        return f"Not a directory: {root}"
    n, g = w.index(root, reset), w.build_graph(root)
    return (
        f"Indexed {root}\nfiles: {n['indexed']} read, {n['reused']} unchanged, {n['gone']} gone\nchunks: {n['chunks']}\n"
        f"embeddings: {n['embeddings_computed']} computed, {n['embeddings_cached']} known\ngraph: {g['nodes']} nodes, {g['edges']} edges"
    )
