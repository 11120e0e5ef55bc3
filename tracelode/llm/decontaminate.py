"""Benchmark decontamination over a positional inverted index split by documents.

``build_index`` writes the postings (term, positions) of every block of training
documents, sorted by term; test phrases go to the blocks, so searching needs no
shuffle and a stored index answers any number of test sets. A phrase is matched
from its rarest term in the block: that term's postings give candidate starts,
which the offset-adjusted lists of the other terms, rarest first, thin out. With
a slop the same lists give proximity matches. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ddl, free_name, others, quoted
from .scratch import cut
from .textblocks import ALNUM, blocks, flat, word_hashes, word_spans
from .workers import lean

WINDOW = 13
#: Test text sent to the tasks at once; larger test sets go in several parts.
PART_BYTES = 8 << 20
INDEX_SCHEMA = "doc_ids array<bigint>, bounds array<int>, terms array<bigint>, lists array<int>, positions array<int>"
OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit")
_RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_hit bigint"


@dataclass
class Index:
    """Postings of a block: ``positions[lists[i]:lists[i+1]]`` are the places of ``terms[i]`` (sorted)."""

    terms: np.ndarray
    lists: np.ndarray
    positions: np.ndarray
    bounds: np.ndarray  # first word of every document, and the number of words


@dataclass
class Phrases:
    """Distinct phrases of ``length`` words: ``codes[start:start + length]`` each; items of phrase i are ``items[begin[i]:begin[i+1]]``."""

    length: int
    start: np.ndarray
    begin: np.ndarray
    items: np.ndarray


@dataclass
class TestSet:
    """Word hashes of the test texts, once each (sorted), the texts as places in it, their phrases, and the names of items."""

    vocabulary: np.ndarray
    codes: np.ndarray
    phrases: list[Phrases]
    names: list[str]


def text_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the block, and the first word of every row."""
    mapped = ALNUM[data]
    at, row = word_spans(mapped, off)
    return word_hashes(mapped, at), np.searchsorted(row, np.arange(len(off)))


def index_words(words: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray | None = None) -> Index:
    """Index of the block; with a vocabulary (sorted) only those terms are stored."""
    if vocabulary is None:
        place = np.arange(len(words))
    else:
        bloom = np.zeros(1 << 16, bool)
        bloom[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        place = np.flatnonzero(bloom[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(vocabulary, words[place]), len(vocabulary) - 1)
        place = place[vocabulary[at] == words[place]] if len(vocabulary) else place[:0]
    order = np.argsort(words[place], kind="stable")
    place = place[order]
    terms, begin = np.unique(words[place], return_index=True)
    return Index(terms, np.append(begin, len(place)), place, bounds)


def test_set(data: np.ndarray, off: np.ndarray, names: list[str], window: int = WINDOW) -> TestSet:
    """All ``window``-word phrases of the texts, of which text i belongs to item ``names[i]``; a shorter text is one phrase."""
    words, bounds = text_words(data, off)
    vocabulary, codes = np.unique(words, return_inverse=True)
    codes = codes.astype(np.int32)
    known = {x: i for i, x in enumerate(dict.fromkeys(names))}
    item_of = np.array([known[x] for x in names], np.int64)
    count = np.diff(bounds)
    length = np.minimum(count, window)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        which = np.flatnonzero(length == n)
        m = count[which] - n + 1
        start = np.repeat(bounds[which] - np.cumsum(m) + m, m) + np.arange(m.sum())
        rows = np.ascontiguousarray(codes[start[:, None] + np.arange(n)])
        _, first, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * n))).ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same.ravel(), np.repeat(item_of[which], m)]), axis=1)
        out.append(Phrases(n, start[first], np.searchsorted(pairs[0], np.arange(len(first) + 1)), pairs[1]))
    return TestSet(vocabulary, codes, out, list(known))


def places(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word of the vocabulary among the index's terms, -1 where it has none."""
    if not len(index.terms):
        return np.full(len(vocabulary), -1, np.int64)
    at = np.minimum(np.searchsorted(index.terms, vocabulary), len(index.terms) - 1)
    return np.where(index.terms[at] == vocabulary, at, -1)


def search(index: Index, tests: TestSet, phrases: Phrases, place: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase number, start and document of every match within a document.

    ``place`` is what ``places`` gave. Exact phrases for slop 0; else every term
    must stand within ``slop`` words of its place, counted from the rarest term's.
    """
    none = np.zeros(0, np.int64)
    length = phrases.length
    # Most phrases lack a word in the block: the first word thins them out before the others are looked up.
    live = np.flatnonzero(place[tests.codes[phrases.start]] >= 0)
    at = place[tests.codes[phrases.start[live][:, None] + np.arange(length)]]
    whole = (at >= 0).all(axis=1)
    live, at = live[whole], at[whole]
    if not len(live):
        return none, none, none
    size = (index.lists[1:] - index.lists[:-1])[at]
    order = np.argsort(size, axis=1, kind="stable")
    rarest = order[:, 0]
    rows = np.arange(len(live))
    n = size[rows, rarest]
    which = np.repeat(rows, n)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = index.positions[np.repeat(index.lists[at[rows, rarest]], n) + inner] - rarest[which]
    doc = np.searchsorted(index.bounds, start + rarest[which], "right") - 1
    if not slop:
        inside = (start >= index.bounds[doc]) & (start + length <= index.bounds[doc + 1])
        which, start, doc = which[inside], start[inside], doc[inside]
    if not len(which):
        return none, none, none
    span = int(index.bounds[-1]) + 1
    listed = np.repeat(np.arange(len(index.terms)), np.diff(index.lists)) * span + index.positions
    for k in range(1, length):
        if not len(which):
            break
        offset = order[which, k]
        term = at[which, offset]
        low = start + offset - slop if not slop else np.maximum(start + offset - slop, index.bounds[doc])
        high = start + offset + slop if not slop else np.minimum(start + offset + slop, index.bounds[doc + 1] - 1)
        spot = np.minimum(np.searchsorted(listed, term * span + low), len(listed) - 1)
        found = (listed[spot] >= term * span + low) & (listed[spot] <= term * span + high)
        which, start, doc = which[found], start[found], doc[found]
    return live[which], start, doc


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """Postings of all words of ``docs`` as rows of ``INDEX_SCHEMA``, a block of documents each.

    To be written as Parquet and searched any number of times. Null ids stay null;
    null texts have no words.
    """

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in blocks(batch):
                words, bounds = text_words(data, off)
                index = index_words(words, bounds)
                one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t) if not isinstance(v, pa.Array) else v)
                yield pa.record_batch({
                    "doc_ids": one(part.column(0), pa.int64()),
                    "bounds": one(index.bounds.astype(np.int32), pa.int32()),
                    "terms": one(index.terms.view(np.int64), pa.int64()),
                    "lists": one(index.lists.astype(np.int32), pa.int32()),
                    "positions": one(index.positions.astype(np.int32), pa.int32()),
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX_SCHEMA)


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Index]]:
    """Ids and postings of each row of a stored index."""
    for i in range(batch.num_rows):
        v = {c: batch.column(batch.schema.get_field_index(c))[i].values for c in ("doc_ids", "bounds", "terms", "lists", "positions")}
        n = {c: x.to_numpy(zero_copy_only=False) for c, x in v.items() if c != "doc_ids"}
        yield v["doc_ids"], Index(n["terms"].view(np.uint64), n["lists"].astype(np.int64), n["positions"].astype(np.int64), n["bounds"].astype(np.int64))


def search_index(index: DataFrame, items: DataFrame, slop: int = 0, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, start, n_words`` of every match in a stored index (start: 0-based word)."""
    spark = index.sparkSession
    schema = "doc_id bigint, item_id string, start bigint, n_words bigint"
    out = spark.createDataFrame([], schema)
    for sent in _parts_broadcast(spark, items, window):

        @lean()
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests: TestSet = sent.value
            names = pa.array(tests.names, pa.string())
            for batch in batches:
                for ids, block in _stored(batch):
                    place = places(block, tests.vocabulary)
                    for p in tests.phrases:
                        which, start, doc = search(block, tests, p, place, slop)
                        n = np.diff(p.begin)[which]
                        pick = np.repeat(p.begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        start, doc = np.repeat(start, n), np.repeat(doc, n)
                        yield pa.record_batch({"doc_id": ids.take(pa.array(doc)), "item_id": names.take(pa.array(p.items[pick])), "start": start - block.bounds[doc], "n_words": np.full(len(doc), p.length, np.int64)})

        out = out.unionByName(index.mapInArrow(run, schema))
    return out.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))


def _parts(items: DataFrame) -> Iterator[list]:
    """The test rows in parts of bounded text size, one at a time on the driver; texts of one id may be in several."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    items = cut(items, "test-items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(-(-size // PART_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield rows


def _parts_broadcast(spark, items: DataFrame, window: int) -> Iterator:
    for rows in _parts(items):
        data, off = flat(pa.array([r["text"] for r in rows], pa.large_string()))
        tests = test_set(data, off, [r["item_id"] for r in rows], window)
        if tests.phrases:
            yield spark.sparkContext.broadcast(tests)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """All columns of ``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated, longest_hit``.

    A word is hit if it lies in a match of any item phrase; ``longest_hit`` is the
    longest run of such words. Items with null id or text, or without words, are
    ignored; repeated items count once, texts of one id are one item. Null texts
    have no words. Documents keep their rows, repeated ones too, whatever their
    ids; existing columns of these names, in upper or lower case, are replaced.
    Without items or documents nothing is hit. A test set above ``PART_BYTES`` goes
    over the documents in parts, whose hits are added up row by row. The postings
    of each block are made on the way and not kept; ``index_contamination`` answers
    from stored ones.
    """
    if "text" not in docs.columns:
        raise ValueError("documents need a column text")
    kept = others(docs, OWN)
    hits, found = (free_name(docs, x) for x in ("__hits", "__items"))
    step = docs.select(*quoted(kept), F.lit(None).cast("binary").alias(hits), F.lit(None).cast("array<string>").alias(found))
    parts = list(_parts_broadcast(docs.sparkSession, items, window)) or [None]
    for i, sent in enumerate(parts):
        last = i == len(parts) - 1
        step = step.mapInArrow(_hit_rows(sent, slop, last, hits, found), f"{ddl(docs, kept)}, " + (_RESULT if last else f"`{hits}` binary, `{found}` array<string>"))
    return step


def index_contamination(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``doc_id`` and the columns of ``contamination`` for every document of a stored index, in one pass over it."""
    parts = list(_parts_broadcast(index.sparkSession, items, window))

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _stored(batch):
                total = _Hits(block.bounds)
                for sent in parts:
                    total.add(block, sent.value, slop)
                yield pa.record_batch({"doc_id": ids} | total.columns())

    return index.mapInArrow(run, f"doc_id bigint, {_RESULT}")


class _Hits:
    """Hit words and items found of a block's documents, added up over parts of a test set."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.hit = bounds, np.zeros(int(bounds[-1]), bool)
        self.found: dict[int, set[str]] = {}

    def add(self, index: Index, tests: TestSet, slop: int) -> None:
        edge = np.zeros(len(self.hit) + 1, np.int64)
        place = places(index, tests.vocabulary)
        for p in tests.phrases:
            which, start, doc = search(index, tests, p, place, slop)
            if not len(which):
                continue
            low = np.maximum(start - slop, self.bounds[doc]) if slop else start
            high = np.minimum(start + p.length + slop, self.bounds[doc + 1]) if slop else start + p.length
            np.add.at(edge, low, 1)
            np.add.at(edge, high, -1)
            m = np.diff(p.begin)[which]
            pick = np.repeat(p.begin[which] - np.cumsum(m) + m, m) + np.arange(m.sum())
            for d, i in np.unique(np.stack([np.repeat(doc, m), p.items[pick]]), axis=1).T.tolist():
                self.found.setdefault(d, set()).add(tests.names[i])
        self.hit |= np.cumsum(edge[:-1]) > 0

    def columns(self) -> dict[str, pa.Array]:
        n, n_words = len(self.bounds) - 1, np.diff(self.bounds)
        total = np.concatenate([[0], np.cumsum(self.hit)])
        n_hit = total[self.bounds[1:]] - total[self.bounds[:-1]]
        longest = np.zeros(n, np.int64)
        # Runs end where a document ends.
        first = np.zeros(len(self.hit) + 1, bool)
        first[self.bounds] = True
        before = np.concatenate([[False], self.hit[:-1]])
        begins = np.flatnonzero(self.hit & (~before | first[:-1]))
        after = np.concatenate([self.hit[1:], [False]])
        ends = np.flatnonzero(self.hit & (~after | first[1:])) + 1
        np.maximum.at(longest, np.searchsorted(self.bounds, begins, "right") - 1, ends - begins)
        found = [sorted(self.found.get(i, ())) for i in range(n)]
        return {
            "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in found], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
            "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words)), "longest_hit": pa.array(longest, pa.int64()),
        }


def _hit_rows(sent, slop: int, last: bool, hits: str, found: str):
    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value if sent is not None else TestSet(np.zeros(0, np.uint64), np.zeros(0, np.int32), [], [])
        for batch in batches:
            for rows, data, off in blocks(batch):
                words, bounds = text_words(data, off)
                total = _Hits(bounds)
                earlier, seen = (rows.column(rows.schema.get_field_index(c)) for c in (hits, found))
                if earlier.null_count < rows.num_rows:
                    for i in range(rows.num_rows):
                        total.hit[bounds[i] : bounds[i + 1]] = np.unpackbits(np.frombuffer(earlier[i].as_py(), np.uint8), count=int(bounds[i + 1] - bounds[i])).astype(bool)
                    total.found = {i: set(x) for i, x in enumerate(seen.to_pylist()) if x}
                total.add(index_words(words, bounds, tests.vocabulary), tests, slop)
                kept = {name: rows.column(rows.schema.get_field_index(name)) for name in rows.schema.names if name not in (hits, found)}
                if last:
                    yield pa.record_batch(kept | total.columns())
                else:
                    packed = [np.packbits(total.hit[bounds[i] : bounds[i + 1]]).tobytes() for i in range(rows.num_rows)]
                    lists = [sorted(total.found.get(i, ())) for i in range(rows.num_rows)]
                    yield pa.record_batch(kept | {hits: pa.array(packed, pa.binary()), found: pa.array(lists, pa.list_(pa.string()))})

    return run
