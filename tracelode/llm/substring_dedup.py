"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where the hash is the greatest
within ``REACH`` bytes on both sides (of equal ones in a row, the first, the
last and some between), so cuts depend on nearby bytes alone, an insertion moves
only the chunks around it, and a stretch of one repeated pattern has like chunks
in any surroundings. Chunks are matched by 128-bit BLAKE2 digests, within
a document as well as across documents: counting combines before the shuffle,
and occurrences are joined to the repeated digests only, so a passage in a third
of all texts stays a count until then. Last, passages are taken out of the texts
everywhere but in their first place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, fresh_path
from .textblocks import blocks
from .workers import lean

#: The hash has 16 bits and doubles with every byte, so it forgets a byte after as many.
GEAR_BYTES = 16
REACH = 24
MOST_CHUNK = 4096
PATTERN = 64
_BLOCK = 256 << 10
#: Consecutive repeated chunks of at least this many bytes are a repeated passage. Passages of over 50 words hold
#: such a run but for rare ones of very short words; chance repeats of a single short chunk don't.
LEAST_PASSAGE = 100

_GEAR = np.random.default_rng(7).integers(1, 2**16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = 2 * h + gear[byte]`` after every byte, by doubling."""
    h = _GEAR[data]
    k = 1
    with np.errstate(over="ignore"):
        while k < GEAR_BYTES:
            if len(h) > k:
                h[k:] += h[:-k].copy() << np.uint16(k)
            k *= 2
    return h


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First byte of every chunk of the block; rows are chunked independently of one another."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(data)
    # No cut within a character, nor where the hash or its surroundings reach over the start of a row.
    h[:-1][(data[1:] & 0xC0) == 0x80] = 0
    row_start = off[:-1][off[:-1] < off[1:]]
    for i in range(REACH):
        at = row_start + i
        h[at[at < n]] = 0
    top = h
    k = 1
    while 2 * k <= REACH:
        wider = top.copy()
        np.maximum(top[:-k], top[k:], out=wider[:-k])
        top, k = wider, 2 * k
    # top[i] is the greatest of h[i : i + 16]; two of them cover REACH.
    ahead = np.zeros(n + 2 * REACH + 1, np.uint16)
    ahead[REACH : REACH + n] = top
    at = np.arange(n) + REACH
    before = np.maximum(ahead[at - REACH], ahead[at - k])
    after = np.maximum(ahead[at + 1], ahead[at + 1 + REACH - k])
    top_at = np.flatnonzero((h >= before) & (h >= after) & (h > 0))
    # Equal ones within reach of each other are a chain, as in a repeated pattern. Its ends are cut, and between them whole
    # numbers of gaps that make up ``PATTERN`` bytes, which are alike wherever in the pattern the chain begins.
    if len(top_at):
        far = np.diff(top_at) > REACH
        head, tail = np.append(True, far), np.append(far, True)
        first = np.flatnonzero(head)
        gap = np.append(np.diff(top_at), 1)[first]
        chain = np.cumsum(head) - 1
        place = np.arange(len(top_at)) - first[chain]
        last = top_at[tail | (place % -(-PATTERN // gap)[chain] == 0)]
    else:
        last = top_at
    start = np.unique(np.concatenate([row_start, last + 1]))
    start = start[start < n]
    size = np.diff(np.append(start, n))
    if size.max() > MOST_CHUNK:
        pieces = -(-size // MOST_CHUNK)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + inner * MOST_CHUNK
        for _ in range(3):
            start -= (data[start] & 0xC0) == 0x80
    return start


def _chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the digest, row, place in the row and size of every chunk."""
    start = chunk_starts(data, off)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    row = np.searchsorted(off, start, "right") - 1
    ends = np.append(start, len(data))
    raw = data.tobytes()
    digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise(ends.tolist())])
    half = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return half[:, 0].copy(), half[:, 1].copy(), row, start - off[row], np.diff(ends)


@lean()
def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A head for every row (``at`` -1, bytes in ``h1``, chunks in ``h2``), and its chunks."""
    for batch in batches:
        for part, data, off in blocks(batch, most=_BLOCK):
            h1, h2, row, place, size = _chunks(data, off)
            n = part.num_rows
            per_row = np.bincount(row, minlength=n)
            ids = part.select(["row", "doc_id"])
            yield _rows(ids, np.diff(off).astype(np.int64), per_row, np.full(n, -1, np.int64), np.zeros(n, np.int32))
            yield _rows(ids.take(pa.array(row)), h1, h2, place, size.astype(np.int32))


def _rows(ids: pa.RecordBatch, h1: np.ndarray, h2: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"h1": h1, "h2": h2, "row": ids.column("row"), "doc_id": ids.column("doc_id"), "at": at, "size": size})


def _chunked(docs: DataFrame) -> DataFrame:
    """Heads and chunks of all rows, written once: ``row`` tells rows apart whose ids are equal or null."""
    numbered = docs.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(numbered.mapInArrow(_chunk_rows, "h1 bigint, h2 bigint, row bigint, doc_id bigint, at bigint, size int"), "chunks")


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """``row, at, size, elsewhere, again, within`` for occurrences of chunks that occur more than once.

    ``elsewhere``: some other row has the chunk; ``again``: some occurrence has a
    lower (doc_id with nulls last, row, at); ``within``: one of the same row has.
    """
    chunks = rows.where("at >= 0")
    null_row = F.when(F.col("doc_id").isNull(), F.col("row"))
    seen = chunks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.min(null_row).alias("lo_null"), F.min("row").alias("least"), F.max("row").alias("most"))
    seen = cut(seen.where("n > 1").drop("n"), "chunk-repeats")
    in_first = F.when(F.col("lo").isNull(), F.col("row") == F.col("lo_null")).otherwise(F.coalesce(F.col("doc_id") == F.col("lo"), F.lit(False)))
    hit = chunks.join(seen, ["h1", "h2"]).select("h1", "h2", "row", "doc_id", "at", "size", in_first.alias("in_first"), (F.col("least") != F.col("most")).alias("elsewhere"))
    # Only rows that share an id other than null are compared here, so that many rows without ids don't meet in one task.
    # They are dealt anew for it, as a chunk of very many rows would else stay in the task that joined it.
    own = Window.partitionBy("doc_id", "null_row", "h1", "h2").orderBy("row", "at")
    hit = hit.withColumn("null_row", null_row).repartition("doc_id", "null_row", "h1", "h2").withColumn("before", F.lag("row").over(own))
    return hit.select("row", "at", "size", "elsewhere", (~F.col("in_first") | F.col("before").isNotNull()).alias("again"), F.coalesce(F.col("before") == F.col("row"), F.lit(False)).alias("within"))


def _passages(rows: DataFrame, least: int) -> DataFrame:
    """Repeated chunks with ``shared_run``, the bytes of the run of chunks shared with other rows around them, and
    ``drop``: the chunk stands in a run of at least ``least`` bytes of chunks that all occur before."""
    hit = repeated_chunks(rows)
    place = Window.partitionBy("row").orderBy("at")
    joined = F.coalesce(F.lag(F.col("at") + F.col("size")).over(place) == F.col("at"), F.lit(False))
    for flag in ("elsewhere", "again"):
        goes_on = joined & F.coalesce(F.lag(flag).over(place), F.lit(False))
        hit = hit.withColumn(f"{flag}_begins", (F.col(flag) & ~goes_on).cast("int"))
    for flag in ("elsewhere", "again"):
        hit = hit.withColumn(f"{flag}_run", F.sum(f"{flag}_begins").over(place))
    for flag in ("elsewhere", "again"):
        held = F.when(F.col(flag), F.col("size")).otherwise(0)
        hit = hit.withColumn(f"{flag}_bytes", F.when(F.col(flag), F.sum(held).over(Window.partitionBy("row", f"{flag}_run"))).otherwise(0).cast("long"))
    return hit.select("row", "at", "size", "elsewhere", "within", F.col("elsewhere_bytes").alias("shared_run"), (F.col("again") & (F.col("again_bytes") >= least)).alias("drop"))


_COUNTS = ("n_shared", "shared_bytes", "longest_shared", "within_bytes", "removed_bytes")


def _per_row(rows: DataFrame, least: int) -> DataFrame:
    """``row, doc_id, n_bytes, n_chunks``, the counts and ``repeated`` of ``shared_passages``, and ``spans``: the chunks to take
    out (``at, size``), null where there are none."""
    one = _passages(rows, least).groupBy("row").agg(
        F.count_if(F.col("shared_run") >= least).alias("n_shared"),
        F.sum(F.when(F.col("shared_run") >= least, F.col("size")).otherwise(0)).alias("shared_bytes"),
        F.max("shared_run").alias("longest_shared"),
        F.sum(F.when(F.col("within"), F.col("size")).otherwise(0)).alias("within_bytes"),
        F.sum(F.when(F.col("drop"), F.col("size")).otherwise(0)).alias("removed_bytes"),
        F.collect_list(F.when(F.col("drop"), F.struct("at", "size"))).alias("spans"),
    )
    counts = rows.where("at = -1").select("row", "doc_id", F.col("h1").alias("n_bytes"), F.col("h2").alias("n_chunks"))
    out = counts.join(one, "row", "left").select("row", "doc_id", "n_bytes", "n_chunks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], "spans")
    return out.withColumn("repeated", (F.col("longest_shared") >= least) | (F.col("removed_bytes") > 0))


def shared_passages(docs: DataFrame, least: int = LEAST_PASSAGE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_chunks, n_shared, shared_bytes, longest_shared, within_bytes, removed_bytes, repeated``.

    ``n_shared`` and ``shared_bytes`` count the chunks of passages that other rows
    have: runs of shared chunks of at least ``least`` bytes, so that chance repeats
    of a few words leave a row alone. ``longest_shared`` is the longest run of
    shared chunks, however short. ``within_bytes`` are the bytes
    of chunks that occur before in the same row. ``removed_bytes`` are the bytes
    that ``remove_passages`` takes out: runs of at least ``least`` bytes whose
    chunks all occur before, in this row or another. ``repeated`` says that a run
    shared with other rows has at least ``least`` bytes, or that bytes are removed.

    Null and empty texts have no chunks. Every row is a document of its own, also
    where ids are equal or null; rows are in the order of their ids, nulls last,
    and of reading where ids are equal. Extra columns are ignored; an empty table
    gives no rows.
    """
    return _per_row(_chunked(docs.withColumn("__row", F.monotonically_increasing_id())), least).drop("row", "spans")


def _without_spans(folder: str, names: list[str]):
    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{folder}")
        loaded, found, known = -1, None, np.zeros(0, np.int64)
        for batch in batches:
            told = [c for c in names if c not in batch.schema.names]
            for part, data, off in blocks(batch):
                rows = part.column("__row").to_numpy(zero_copy_only=False)
                if rows[0] >> 33 != loaded:
                    loaded = int(rows[0] >> 33)
                    found = pq.read_table(f"{root}/part={loaded}", columns=list({"row", "n_bytes", "spans", *told}), filesystem=store, partitioning=None)
                    found = found.sort_by("row").combine_chunks().to_batches()[0]
                    known = found.column("row").to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(known, rows), len(known) - 1)
                mine = found.take(pa.array(place))
                if not (np.array_equal(known[place], rows) and np.array_equal(mine.column("n_bytes").to_numpy(zero_copy_only=False), np.diff(off))):
                    raise RuntimeError("the rows differ between two readings")
                spans = mine.column("spans")
                held = spans.flatten()
                of = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                begin = off[of] + held.field("at").to_numpy(zero_copy_only=False)
                edge = np.zeros(len(data) + 1, np.int8)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + held.field("size").to_numpy(zero_copy_only=False), -1)
                stays = np.cumsum(edge[:-1], dtype=np.int8) == 0
                ends = np.concatenate([[0], np.cumsum(stays)])[off].astype(np.int64)
                valid = pa.py_buffer(np.packbits(np.asarray(part.column("text").is_valid()), bitorder="little"))
                text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [valid, pa.py_buffer(ends), pa.py_buffer(data[stays])]).cast(pa.string())
                column = lambda c: text if c == "text" else mine.column(c) if c in told else part.column(c)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column(c) for c in names], names)

    return run


def _taken_out(numbered: DataFrame, least: int, names: list[str]) -> DataFrame:
    """Columns ``names``, of ``numbered`` or else of ``_per_row``, with passages taken out of ``text``.

    What is found lies in a folder for each part of the first reading; in the second
    reading each task takes the one of its own part, so texts are not shuffled.
    """
    found = _per_row(_chunked(numbered), least)
    path = fresh_path(numbered.sparkSession, "passages")
    part = F.shiftright("row", 33).alias("part")
    found.select("*", part).repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)
    types = {**{f.name: f for f in found.schema.fields}, **{f.name: f for f in numbered.schema.fields}}
    told = ", ".join(f"`{c.replace('`', '``')}` {types[c].dataType.simpleString()}" for c in names)
    return numbered.drop(*[c for c in numbered.columns if c not in (*names, "__row", "text")]).mapInArrow(_without_spans(path, names), told)


def remove_passages(docs: DataFrame, least: int = LEAST_PASSAGE) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` everywhere but in their first place.

    Other columns are unchanged (``__row`` is reserved). Rows are written once, so
    that they are read alike twice and rows with equal or null ids keep apart.
    """
    held = cut(docs, "rows")
    return _taken_out(held.withColumn("__row", F.monotonically_increasing_id()), least, docs.columns)


def deduplicated(docs: DataFrame, least: int = LEAST_PASSAGE) -> DataFrame:
    """The columns of ``shared_passages`` and ``text`` without repeated passages but in their first place, one row per row of ``docs``.

    ``docs`` has to come from files without a shuffle, so that both readings meet
    the rows in the same parts and places; a difference raises an error.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _taken_out(numbered, least, ["doc_id", "n_bytes", "n_chunks", *_COUNTS, "repeated", "text"])
