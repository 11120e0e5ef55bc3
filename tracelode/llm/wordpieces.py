"""Exact token ids of whole texts, each distinct piece encoded once.

A tokenizer that drops white space and never lets a token cross it gives a text
the concatenated ids of its space-separated pieces. Natural text repeats its
pieces, so a block's pieces are dictionary-encoded in Arrow, only pieces not
seen by this worker are given to the library, and ids are gathered by position.
For any other tokenizer whole texts are encoded.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa

from .workers import on_leave

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: ASCII letters; what is left of a piece without them and the accented Latin-1 letters is white space.
_PLAIN = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LATIN = re.compile(rb"\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]")
_BLANK = {b"", b" ", b"\n", b"\t", b"\r"}
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True


def drops_space(spec: dict) -> bool:
    """Is the tokenizer known to treat space-separated pieces on their own?"""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x.get("type") for x in norm.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "")
        and spec.get("post_processor") is None
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or t["content"][-1:] in ".," for t in spec["added_tokens"])
    )


class Encoder:
    """Ids of texts, in blocks; remembers the first ``most`` distinct pieces that it meets."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.piecewise = drops_space(spec)
        self.most = most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = spec["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.seen: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum())), count

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encode`` for words of letters only: many in one text, parted by their last tokens."""
        joined = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        ids, _ = self._encode(joined)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words) or (len(ids) and last[-1] != len(ids) - 1):
            return self._encode(words)
        return ids, np.diff(last, prepend=-1)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [_LATIN.sub(b"", p.translate(None, _PLAIN)) in _BLANK for p in pieces]
        words = [p.decode("utf-8").strip() for p, w in zip(pieces, plain, strict=True) if w]
        rest = [p.decode("utf-8") for p, w in zip(pieces, plain, strict=True) if not w]
        count = np.zeros(len(pieces), np.int64)
        mask = np.array(plain, bool)
        a, count[mask] = self._encode_words(words) if words else (np.zeros(0, np.uint32), 0)
        b, count[~mask] = self._encode(rest) if rest else (np.zeros(0, np.uint32), 0)
        ids = np.empty(int(count.sum()), np.uint32)
        of_word = np.repeat(mask, count)
        ids[of_word], ids[~of_word] = a, b
        return ids, count

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of every piece of the block, pieces per row, and the ids and bounds that numbers point to."""
        word = ~_SPACE[data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        first = off[:-1][off[:-1] < off[1:]]
        start[first] = word[first]
        ends = np.zeros(len(data) + 1, bool)
        ends[:-1] = ~word
        ends[off] = True
        cut = _STOP[data[1:]] & _LETTER[data[:-1]] & ends[2:]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[first] = True
        start[1:] |= cut & ~fresh[1:-1]
        at = np.flatnonzero(start)
        per_row = np.diff(np.searchsorted(at, off))
        if not len(at):
            return np.zeros(0, np.int64), per_row, self.ids, self.begin
        bounds = np.append(at, len(data)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = array.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        seen, new = self.seen, []
        place = np.empty(len(keys), np.int64)
        keep = len(seen) < self.most
        known = len(self.begin) - 1
        for i, key in enumerate(keys):
            k = seen.get(key)
            if k is None:
                k = known + len(new)
                new.append(key)
                if keep:
                    seen[key] = k
            place[i] = k
        ids, begin = self.ids, self.begin
        if new:
            more, count = self._encode_pieces(new)
            ids = np.concatenate([ids, more])
            begin = np.concatenate([begin, begin[-1] + np.cumsum(count)])
            if keep:
                self.ids, self.begin = ids, begin
        return place[coded.indices.to_numpy(zero_copy_only=False)], per_row, ids, begin

    def _texts(self, data: np.ndarray, off: np.ndarray) -> list[str]:
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8") for a, b in itertools.pairwise(off.tolist())]

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens per row."""
        if not self.piecewise:
            return self._encode(self._texts(data, off))[1] if len(off) > 1 else np.zeros(0, np.int64)
        piece, per_row, _, begin = self._pieces(data, off)
        total = np.concatenate([[0], np.cumsum(np.diff(begin)[piece])])
        edge = np.concatenate([[0], np.cumsum(per_row)])
        return total[edge[1:]] - total[edge[:-1]]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block in order, and tokens per row."""
        if not self.piecewise:
            return self._encode(self._texts(data, off)) if len(off) > 1 else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        piece, per_row, ids, begin = self._pieces(data, off)
        size = np.diff(begin)[piece]
        total = np.concatenate([[0], np.cumsum(size)])
        edge = np.concatenate([[0], np.cumsum(per_row)])
        place = np.repeat(begin[:-1][piece] - total[:-1], size) + np.arange(total[-1])
        return ids[place], total[edge[1:]] - total[edge[:-1]]


_ENCODERS: dict[str, Encoder] = {}
on_leave("tokens", _ENCODERS.clear)


def encoder(path: str) -> Encoder:
    """This worker's encoder for the file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
