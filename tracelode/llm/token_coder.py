"""Token-id files by an adaptive context-mixing range coder.

Ids are coded in blocks that start from scratch and carry checksums, so any
block can be read on its own. In a block, the id last seen after the two ids
before (order 2) and after the one before (order 1) are candidates; adaptive
probabilities, chosen by how well both candidates' contexts have done, mix them
with an adaptive order-0 distribution over classes of ids into one interval for
a carry-less range coder. All blocks of a file advance in step as numpy lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, fresh_path
from .textblocks import blocks
from .wordpieces import encoder
from .workers import lean

MAGIC = b"TLCM2\0\0\0"
BLOCK_IDS = 8192
#: Small files have few lanes, whose steps cost almost as much as those of many.
FILE_IDS = 8_000_000
_H2, _H1 = 12, 11
_LOW32 = np.uint64(0xFFFFFFFF)
_S24, _S32 = np.uint64(24), np.uint64(32)
#: By trust in a candidate, plus 8 if it was right: the change of its entry, and whether a new one takes its place.
_STEP = np.array([0, 0, 0, -2, -2, -2, -2, -2, 1, 1, 1, 1, 1, 1, 1, 0], np.int64)
_ANEW = np.arange(16) < 3
_THREE = np.int64(3)
#: Steps whose contexts the encoder looks up at once, as it knows the ids.
_AHEAD = 64


class BadBlock(ValueError):
    """A block's checksum does not fit its contents."""


class Classes:
    """Contiguous id ranges of at most 256 ids and about equal mass under a 1/(id + 50) law."""

    def __init__(self, vocabulary: int):
        mass = np.cumsum(1.0 / (np.arange(vocabulary) + 50.0))
        target = np.minimum((mass / mass[-1] * 160).astype(np.int64), 159)
        begin = np.flatnonzero(np.diff(target, prepend=-1))
        cuts = [np.arange(a, b, 256) for a, b in zip(begin, np.append(begin[1:], vocabulary), strict=True)]
        self.first = np.concatenate(cuts).astype(np.int64)
        self.size = np.diff(np.append(self.first, vocabulary))
        self.of = np.repeat(np.arange(len(self.first)), self.size)
        self.n = len(self.first)
        if self.n >= 2048:
            raise ValueError("vocabulary too large for this coder")


class Lanes:
    """Model and coder state of n blocks in step."""

    def __init__(self, n: int, classes: Classes):
        self.k, self.n = classes, n
        lane = np.arange(n)
        self.at2, self.at1, self.atp, self.atc, self.atl = lane << _H2, lane << _H1, lane << 7, lane * (classes.n + 1), lane << 12
        self.ath = lane * classes.n
        self.t2, self.t1 = np.zeros(n << _H2, np.int32), np.zeros(n << _H1, np.int32)
        q2, q1 = np.arange(128) >> 4, (np.arange(128) >> 1) & 7
        self.p2 = np.tile((q2 * 2 + 1) * 57344 // 18, n)
        self.p1 = np.tile((q1 * 2 + 1) * 32768 // 18, n)
        self.hist = np.full((n, classes.n), 2, np.int64)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.rebuild()

    def rebuild(self) -> None:
        """Order-0 distribution from the counts so far, in 4096ths, at least one each."""
        c = self.k.n
        freq = self.hist * (4096 - c) // self.hist.sum(axis=1, keepdims=True) + 1
        freq[:, 0] += 4096 - freq.sum(axis=1)
        cum = np.zeros((self.n, c + 1), np.int64)
        np.cumsum(freq, axis=1, out=cum[:, 1:])
        self.cum = cum.ravel()
        self.lut = np.repeat(np.tile(np.arange(c, dtype=np.int16), self.n), freq.ravel())
        self.hist -= self.hist >> 2
        np.maximum(self.hist, 1, out=self.hist)

    def places(self, c1: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table places of the contexts, for lanes along the last axis."""
        m = c1.shape[-1]
        mixed = c1 * 0x9E3779B1
        k1 = ((mixed & 0xFFFFFFFF) >> (32 - _H1)) + self.at1[:m]
        return k1, (((mixed + c2 * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - _H2)) + self.at2[:m]

    def predict(self, m: int, k1: np.ndarray, k2: np.ndarray):
        """For the first m lanes: table places, entries, and the three widths in 2^24ths."""
        e1, e2 = self.t1.take(k1).astype(np.int64), self.t2.take(k2).astype(np.int64)
        s1, s2, f1, f2 = e1 >> 3, e2 >> 3, e1 & 7, e2 & 7
        agree = s1 == s2
        ctx = (f2 << 4) + (f1 << 1) + agree + self.atp[:m]
        p2, p1 = self.p2.take(ctx), self.p1.take(ctx)
        w2 = p2 << 8
        rest = (1 << 24) - w2
        w1 = (rest * p1) >> 16
        w1[agree] = 0
        return k1, k2, e1, e2, s1, s2, ctx, p2, p1, w2, w1, rest - w1, f1, f2

    def update(self, m: int, seen, fresh, cls, hit2, hit1, same1) -> None:
        """``same1``: the order-1 candidate is the id, also where order 2 has it; ``fresh``: a new entry for the id."""
        k1, k2, e1, e2, _, _, ctx, p2, p1, *_, f1, f2 = seen
        self.p2[ctx] = np.maximum(p2 + ((hit2 * 57344 - p2) >> 5), 32)
        moved = np.maximum(p1 + ((hit1 * 32768 - p1) >> 5), 32)
        np.copyto(moved, p1, where=hit2)
        self.p1[ctx] = moved
        for table, k, e, f, same in ((self.t2, k2, e2, f2, hit2), (self.t1, k1, e1, f1, same1)):
            f = f + (same << _THREE)
            e = e + _STEP.take(f)
            np.copyto(e, fresh, where=_ANEW.take(f))
            table[k] = e
        gone = np.flatnonzero(~(hit2 | hit1))
        self.hist.ravel()[(self.ath[:m] + cls)[gone]] += 24

    def narrow(self, m: int, unit, start, width):
        """Takes the interval; returns which lanes shift 32 bits out, and their low ends before."""
        low = self.low[:m] + unit * start.astype(np.uint64)
        rng = unit * width.astype(np.uint64)
        small = rng <= _LOW32
        if small.any():
            apart = small & (((low ^ (low + rng)) >> _S32) != 0)
            rng = np.where(apart, (np.uint64(0) - low) & _LOW32, rng)
            self.low[:m] = np.where(small, low << _S32, low)
            self.range[:m] = np.where(small, rng << _S32, rng)
            return np.flatnonzero(small), low
        self.low[:m], self.range[:m] = low, rng
        return None, low


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole quotient; exact in doubles, as a < 2^37 and b < 2^25 keep quotients 2^-25 away from the next integer."""
    return np.true_divide(a, b).astype(np.int64)


def _due(t: int) -> bool:
    return t in (64, 192) or (t > 0 and t % 512 == 0)


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Coded blocks of ``BLOCK_IDS`` ids (the last may be shorter)."""
    total = len(ids)
    if not total:
        return []
    if int(ids.max()) >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    n = -(-total // BLOCK_IDS)
    longest = min(total, BLOCK_IDS)
    tail = total - (n - 1) * BLOCK_IDS
    # Two rows of zeros go before, as the contexts of the first ids.
    grid = np.zeros((longest + 2, n), np.int32)
    grid[2:, : n - 1] = ids[: (n - 1) * BLOCK_IDS].reshape(n - 1, -1).T if n > 1 else 0
    grid[2 : tail + 2, n - 1] = ids[(n - 1) * BLOCK_IDS :]
    k = _classes(vocabulary)
    lanes = Lanes(n, k)
    out, filled = np.zeros((n, longest + 2), np.uint32), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for t in range(longest):
            if _due(t):
                lanes.rebuild()
            m, i = n if t < tail else n - 1, t % _AHEAD
            if not i:
                told = grid[t : t + _AHEAD + 2].astype(np.int64)
                k1s, k2s = lanes.places(told[1:-1], told[:-2])
                xs = told[2:]
                news, clss = (xs << 3) + 1, k.of.take(xs)
                sizes, insides, ats = k.size.take(clss), xs - k.first.take(clss), clss + lanes.atc
            x, cls, at = xs[i, :m], clss[i, :m], ats[i, :m]
            seen = lanes.predict(m, k1s[i, :m], k2s[i, :m])
            s1, s2, w2, w1, rest = seen[4], seen[5], seen[9], seen[10], seen[11]
            hit2, same1 = s2 == x, s1 == x
            hit1 = same1 & ~hit2
            a = (lanes.cum.take(at) * rest) >> 12
            width = _ratio(((lanes.cum.take(at + 1) * rest) >> 12) - a, sizes[i, :m])
            start = w2 + w1 + a + insides[i, :m] * width
            np.copyto(start, w2, where=hit1)
            np.copyto(start, 0, where=hit2)
            np.copyto(width, w1, where=hit1)
            np.copyto(width, w2, where=hit2)
            gone, low = lanes.narrow(m, lanes.range[:m] >> _S24, start, width)
            if gone is not None:
                out[gone, filled[gone]] = low[gone] >> _S32
                filled[gone] += 1
            lanes.update(m, seen, news[i, :m], cls, hit2, hit1, same1)
    rows = np.arange(n)
    out[rows, filled] = lanes.low >> _S32
    out[rows, filled + 1] = lanes.low & _LOW32
    result = []
    for i in range(n):
        payload = out[i, : filled[i] + 2].astype("<u4").tobytes()
        mine = np.ascontiguousarray(ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS], "<u4")
        result.append(struct.pack("<IIII", len(mine), len(payload), zlib.crc32(payload), zlib.crc32(mine.tobytes())) + payload)
    return result


def decode_blocks(coded: list[bytes], vocabulary: int) -> np.ndarray:
    """The ids of full blocks and at most one shorter last block; raises ``BadBlock`` on damage."""
    if not coded:
        return np.zeros(0, np.uint32)
    heads = [struct.unpack_from("<IIII", b) for b in coded]
    for (_, size, crc, _), b in zip(heads, coded, strict=True):
        if len(b) != 16 + size or zlib.crc32(memoryview(b)[16:]) != crc:
            raise BadBlock("the checksum of a block's bytes differs")
    n = len(coded)
    longest, tail = heads[0][0], heads[-1][0]
    words = np.zeros((n, max(h[1] for h in heads) // 4 + 2), np.uint64)
    for i, b in enumerate(coded):
        words[i, : heads[i][1] // 4] = np.frombuffer(b, "<u4", offset=16)
    k = _classes(vocabulary)
    lanes = Lanes(n, k)
    code = (words[:, 0] << _S32) | words[:, 1]
    read = np.full(n, 2)
    grid = np.zeros((longest, n), np.uint32)
    c1 = c2 = np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for t in range(longest):
            if _due(t):
                lanes.rebuild()
            m = n if t < tail else n - 1
            seen = lanes.predict(m, *lanes.places(c1[:m], c2[:m]))
            s1, s2, w2, w1, rest = seen[4], seen[5], seen[9], seen[10], seen[11]
            unit = lanes.range[:m] >> _S24
            v = np.minimum((code[:m] - lanes.low[:m]) // unit, np.uint64((1 << 24) - 1)).astype(np.int64)
            hit2 = v < w2
            u = v - w2 - w1
            hit1 = (u < 0) & ~hit2
            u = np.maximum(u, 0)
            cls = lanes.lut.take(np.minimum(_ratio((u << 12) + 4095, rest), 4095) + lanes.atl[:m]).astype(np.int64)
            at, size = lanes.atc[:m] + cls, k.size.take(cls)
            a = (lanes.cum.take(at) * rest) >> 12
            width = _ratio(((lanes.cum.take(at + 1) * rest) >> 12) - a, size)
            place = np.minimum(_ratio(u - a, width), size - 1)
            x = k.first.take(cls) + place
            start = w2 + w1 + a + place * width
            np.copyto(x, s1, where=hit1)
            np.copyto(start, w2, where=hit1)
            np.copyto(width, w1, where=hit1)
            np.copyto(x, s2, where=hit2)
            np.copyto(start, 0, where=hit2)
            np.copyto(width, w2, where=hit2)
            gone, _ = lanes.narrow(m, unit, start, width)
            if gone is not None:
                code[gone] = (code[gone] << _S32) | words[gone, read[gone]]
                read[gone] += 1
            # Where a candidate was hit, its class is not counted.
            lanes.update(m, seen, (x << 3) + 1, cls, hit2, hit1, s1 == x)
            c1, c2 = x, c1
            grid[t, :m] = x
    out = np.concatenate([grid[:, : n - 1].T.ravel(), grid[:tail, n - 1]])
    for i, (size, _, _, crc) in enumerate(heads):
        if zlib.crc32(out[i * BLOCK_IDS : i * BLOCK_IDS + size].astype("<u4").tobytes()) != crc:
            raise BadBlock("the checksum of a block's ids differs")
    return out


_CLASSES: dict[int, Classes] = {}


def _classes(vocabulary: int) -> Classes:
    if vocabulary not in _CLASSES:
        _CLASSES[vocabulary] = Classes(vocabulary)
    return _CLASSES[vocabulary]


def pack_file(doc_ids: np.ndarray, has_id: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A file: header, document table (ids, which ids are null, lengths; deflated, checksummed), blocks."""
    table = zlib.compress(np.diff(doc_ids, prepend=0).astype("<i8").tobytes() + has_id.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes(), 1)
    coded = encode_blocks(ids, vocabulary)
    head = MAGIC + struct.pack("<IIIII", vocabulary, len(doc_ids), len(table), zlib.crc32(table), len(coded))
    return b"".join([head, table, *coded])


def unpack_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, has_id, counts, ids`` of a file."""
    if raw[:8] != MAGIC:
        raise BadBlock("not a token file")
    vocabulary, n, size, crc, n_blocks = struct.unpack_from("<IIIII", raw, 8)
    at = 28 + size
    if zlib.crc32(raw[28:at]) != crc:
        raise BadBlock("the checksum of the document table differs")
    table = zlib.decompress(raw[28:at])
    coded = []
    for _ in range(n_blocks):
        end = at + 16 + struct.unpack_from("<II", raw, at)[1]
        coded.append(raw[at:end])
        at = end
    doc_ids = np.cumsum(np.frombuffer(table, "<i8", n))
    return doc_ids, np.frombuffer(table, np.uint8, n, 8 * n).astype(bool), np.frombuffer(table, "<i8", n, 9 * n), decode_blocks(coded, vocabulary)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


def _writer(folder: str, tokenizer: str, end_id: int, vocabulary: int):
    @lean("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        pid, attempt = task.partitionId(), task.taskAttemptId()
        store, root = _store(folder)
        held: list[tuple] = []
        n_file = size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, has, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"part-{pid:07d}-{n_file:05d}.tok"
            # Whole files appear at once and alike from every attempt, so a retried task replaces its own.
            with store.open_output_stream(f"{root}/.{name}.{attempt}") as f:
                f.write(pack_file(doc_ids, has, counts, ids, vocabulary))
            store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            held.clear()
            return pa.record_batch({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for batch in batches:
            for part, data, off in blocks(batch, most=2 << 20):
                ids, counts = encoder(tokenizer).encode(data, off)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                col = part.column(0)
                held.append((col.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(col.is_valid()), counts + 1, ids))
                size += len(ids)
                if size >= FILE_IDS:
                    yield flush()
                    n_file, size = n_file + 1, 0
        if held:
            yield flush()

    return run


@lean()
def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc_ids, has, counts, ids = unpack_file(batch.column(1)[i].as_py())
            ends = np.cumsum(counts)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
            yield pa.record_batch({"file": pa.array([name] * len(ends)), "doc_id": pa.array(doc_ids, pa.int64(), mask=~has), "at": ends - counts, "n_tokens": counts.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Writes token files to ``folder`` and returns their manifest: ``file, n_docs, n_ids``.

    Rows go in ascending ``doc_id`` order (null first; ties by a hash of the
    text, then the text), files in name order. Null texts are empty and have the
    end id only; repeated rows are written each. Extra columns are ignored. An
    empty table writes no files.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return cut(dealt.mapInArrow(_writer(folder, tokenizer, end_id, vocabulary), "file string, n_docs bigint, n_ids bigint"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the manifest's files.

    ``start`` counts the ids of all documents before. Damaged blocks raise.
    """
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")
    files = manifest.select("file", before.alias("before"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select("path", "content")
    rows = raw.mapInArrow(_reader, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes and reads back; see ``write_tokens`` and ``read_tokens``."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id), folder)
