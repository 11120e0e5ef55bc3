"""Vectorised word arithmetic over Arrow text columns.

All functions work on one flat byte buffer per block, so the cost is a handful
of numpy passes per byte instead of Python objects per word. Blocks are cut by
bytes, never by rows, so memory does not depend on how long texts are (a single
text larger than a block is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15


def _byte_values(seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    return values * U64(2) + U64(1)


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    filled = 1
    step = base & (2**64 - 1)
    while filled < n:
        take = min(filled, n - filled)
        with np.errstate(over="ignore"):
            out[filled : filled + take] = out[:take] * U64(step)
        filled += take
        step = (step * step) & (2**64 - 1)
    return out


class Powers:
    """Powers of an odd number modulo 2^64 and their inverses, grown on demand."""

    def __init__(self, base: int = _PRIME):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _odd_powers(self.base, size), _odd_powers(self.inverse, size)
        return self.up[:n], self.down[:n]


POWERS = Powers()

#: Bytes of words under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased; 0 separates.
ALNUM = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    ALNUM[_b] = _b
for _b in range(0x41, 0x5B):
    ALNUM[_b] = _b + 32


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix); a bijection, so it adds no collisions."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` of about ``most`` text bytes, with flat bytes and offsets."""
    data, off = flat(batch.column(batch.schema.get_field_index(name)))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(mapped: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every maximal run of nonzero bytes (runs end at row ends), and its row."""
    inside = mapped != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = inside[first]
    at = np.flatnonzero(start)
    return at, np.searchsorted(off, at, "right") - 1


def word_hashes(mapped: np.ndarray, at: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each run that starts in ``at``, equal for equal bytes wherever they stand."""
    if not len(at):
        return np.zeros(0, U64)
    table = _byte_values(seed)
    table[0] = 0
    up, down = POWERS.upto(len(mapped))
    with np.errstate(over="ignore"):
        value = table[mapped] * up
        return mix(np.add.reduceat(value, at) * down[at])


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their rows; fewer words than k make one window."""
    count = np.bincount(row, minlength=n_rows)
    with np.errstate(over="ignore"):
        factor = _odd_powers(0xD6E8FEB86659FD93, k)
        n = len(words)
        if n >= k:
            h = np.zeros(n - k + 1, U64)
            for i in range(k):
                h += words[i : n - k + 1 + i] * factor[i]
            whole = row[: n - k + 1] == row[k - 1 :]
            h, of = h[whole], row[: n - k + 1][whole]
        else:
            h, of = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            begin = np.searchsorted(row, short)
            extra = np.zeros(len(short), U64)
            for i in range(k - 1):
                has = count[short] > i
                extra[has] += words[begin[has] + i] * factor[i]
            h, of = np.concatenate([h, extra]), np.concatenate([of, short])
            order = np.argsort(of, kind="stable")
            h, of = h[order], of[order]
    return mix(h), of
