"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

Words (with what is inserted into them by punctuation or single-letter spacing
undone) are compared with a few landmark strings by the string subsequence
kernel, so gapped and padded spellings stay close. A text's vector holds its
greatest similarity to each landmark; the Nystroem map (the inverse root of the
landmarks' own kernel matrix) turns it into coordinates for a linear support
vector machine, and a logistic curve turns margins into scores. Landmarks,
weights and the machine's cost are learned on the driver from a bounded sample
of labelled rows; scoring sees every word of every text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ddl, free_name
from .textblocks import ALNUM, blocks, mix
from .workers import lean

LENGTH = 3
DECAY = 0.6
#: Stands before the first character of every word, so that landmarks can be stems.
START = 1
#: The kernel is raised to this power (a kernel again), which keeps weak likenesses from adding up.
POWER = 3
#: Toxic rows that the model is fitted to at most (and twice as many others), and the longest text among them (bytes).
SAMPLE = 1500
SAMPLE_BYTES = 16 << 10
#: More than any table at hand gives evidence for; what qualifies is used, and scoring takes time in proportion.
LANDMARKS = 256
#: Bytes of a word that the kernel looks at together: every run of so many is compared, and a word is as close to a
#: landmark as its closest run. A subsequence spread over more would weigh next to nothing (DECAY to that power).
REACH = 32
_RUNS = 4096
COSTS = (1.0, 10.0, 100.0)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def units(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Normalised words of the block and their rows.

    A word is what stands between white space, lower-cased, without ASCII signs;
    three or more single characters in a row, of any alphabet, also make up one word.
    """
    mapped = ALNUM[data]
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    start[first] = ~space[first]
    at = np.flatnonzero(start)
    kept = mapped != 0
    text = np.ascontiguousarray(mapped[kept])
    below = np.concatenate([[0], np.cumsum(kept)])
    begin = below[at]
    end = below[np.append(at[1:], len(data))] if len(at) else begin
    row = np.searchsorted(off, at, "right") - 1
    full = end > begin
    begin, end, row = begin[full], end[full], row[full]
    if not len(begin):
        return pa.array([], pa.large_binary()), row
    bounds = np.append(begin, len(text)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    # Characters, not bytes: those that continue a character don't count.
    starts = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    single = starts[end] - starts[begin] == 1
    if single.sum() >= 3:
        edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Runs end at row ends.
        raw, more, of = text.tobytes(), [], []
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if b - a >= 3:
                cuts = [a, *(np.flatnonzero(np.diff(row[a:b])) + a + 1).tolist(), b]
                for p, q in zip(cuts, cuts[1:], strict=False):
                    if q - p >= 3:
                        more.append(raw[begin[p] : end[q - 1]])
                        of.append(row[p])
        if more:
            words = pa.concat_arrays([words, pa.array(more, pa.large_binary())])
            row = np.concatenate([row, of])
            order = np.argsort(row, kind="stable")
            words, row = words.take(pa.array(order)), row[order]
    return words, row


def _decays(n: int) -> np.ndarray:
    """Strictly lower triangle of DECAY ** distance."""
    d = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(d > 0, DECAY ** np.maximum(d, 0), 0.0).astype(np.float32)


def subsequence_kernel(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Kernel of each row of ``words`` (n x length) with ``other``: shared subsequences of three
    characters, each weighted by DECAY to the number of characters it spans in both."""
    n, length = words.shape
    m = len(other)
    equal = (words.T[:, :, None] == other).astype(np.float32)
    along, across = _decays(length), _decays(m).T
    weight = equal
    for _ in range(LENGTH - 1):
        spread = weight.reshape(length * n, m) @ across
        spread = (along @ spread.reshape(length, n * m)).reshape(length, n, m)
        weight = equal * spread
    return weight.sum(axis=(0, 2)) * np.float32(DECAY**2)


def similarities(words: pa.Array, landmarks: list[bytes]) -> np.ndarray:
    """Kernel of every word with every landmark as a share of the landmark's own, 1 at most: 1 for words that
    hold the landmark, less the more of it is missing or spread out; the greatest over all runs of ``REACH`` bytes."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not len(words) or not landmarks:
        return out
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    marks = [np.frombuffer(z, np.uint8) for z in landmarks]
    own = [float(subsequence_kernel(z[None, :], z)[0]) for z in marks]
    # The sign before the first character is part of the word, so that a landmark may be a stem.
    size = np.diff(offsets) + 1
    runs = np.maximum(size - REACH, 0) + 1
    for length in np.unique(np.minimum(size, REACH)):
        if length < LENGTH:
            continue
        which = np.flatnonzero(np.minimum(size, REACH) == length)
        # Words in pieces of so many runs, so that memory doesn't grow with the length of a word.
        of = np.repeat(which, -(-runs[which] // _RUNS))
        piece = np.arange(len(of)) - np.searchsorted(of, of)
        count = np.minimum(runs[of] - piece * _RUNS, _RUNS)
        edge = np.cumsum(count) // _RUNS
        for g in np.unique(edge):
            part = np.flatnonzero(edge == g)
            word = np.repeat(of[part], count[part])
            first = np.repeat(piece[part] * _RUNS - np.cumsum(count[part]) + count[part], count[part]) + np.arange(count[part].sum())
            at = first[:, None] + np.arange(length) - 1
            taken = np.where(at < 0, START, data[np.maximum(offsets[word][:, None] + at, 0)]).astype(np.uint8)
            unlike, back = np.unique(taken.view(np.dtype((np.void, int(length)))).ravel(), return_inverse=True)
            unlike = unlike.view(np.uint8).reshape(-1, length)
            got = np.stack([subsequence_kernel(unlike, z) / k for z, k in zip(marks, own, strict=True)], axis=1)
            np.maximum.at(out, word, got[back.ravel()])
    return np.minimum(out, 1.0) ** POWER


class Memo:
    """Similarities of the first ``most`` distinct words that a task meets, so that common words are compared once."""

    def __init__(self, most: int = 150_000):
        self.most, self.seen = most, {}
        self.table: np.ndarray | None = None

    def similarities(self, words: pa.Array, landmarks: list[bytes]) -> np.ndarray:
        keys = words.to_pylist()
        place = np.fromiter((self.seen.get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        found = similarities(words.take(pa.array(new)), landmarks)
        if self.table is None:
            self.table = np.zeros((self.most, len(landmarks)), np.float32)
        out = self.table[np.maximum(place, 0)]
        out[new] = found
        begin = len(self.seen)
        room = min(self.most - begin, len(new))
        self.table[begin : begin + room] = found[:room]
        self.seen.update((keys[i], begin + k) for k, i in enumerate(new[:room].tolist()))
        return out


def text_vectors(data: np.ndarray, off: np.ndarray, landmarks: list[bytes], memo: Memo | None = None) -> np.ndarray:
    """Greatest similarity of any word of each row to each landmark."""
    words, row = units(data, off)
    out = np.zeros((len(off) - 1, len(landmarks)), np.float32)
    if not len(words):
        return out
    coded = words.dictionary_encode()
    known = memo.similarities(coded.dictionary, landmarks) if memo else similarities(coded.dictionary, landmarks)
    index = coded.indices.to_numpy(zero_copy_only=False)
    has, begin = np.unique(row, return_index=True)
    for j in range(len(landmarks)):
        out[has, j] = np.maximum.reduceat(known[:, j][index], begin)
    return out


@dataclasses.dataclass
class Model:
    """Without landmarks every text gets ``prior``."""

    prior: float = 0.0
    landmarks: list[bytes] = dataclasses.field(default_factory=list)
    nystroem: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def scores(self, data: np.ndarray, off: np.ndarray, memo: Memo | None = None) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(off) - 1, self.prior)
        margin = text_vectors(data, off, self.landmarks, memo) @ self.nystroem @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -40, 40)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model to at most ``sample`` toxic and twice as many other rows that are not held out.

    Rows are chosen by a hash of their id. Labels of null id or class are
    ignored; of repeated labels of a row the greatest counts, of several texts
    with one id the least. Null and empty texts are examples without words. With one class only the model always
    answers it; without labels the score is 0.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    ids = [r for y in (0, 1) for r in usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * (2 - y)).collect()]
    if not ids:
        return Model()
    known = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "d bigint, y int")
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES
    # The sample is bounded by its parameter, so it is the side to send.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(short)
    rows = texts.join(F.broadcast(known), F.col("doc_id") == F.col("d")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64))


def _text_blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    batch = pa.record_batch({"text": pa.array(texts, pa.large_string())})
    for _, data, off in blocks(batch, most=1 << 20):
        yield data, off


def fit(texts: list[str], y: np.ndarray, n_landmarks: int = LANDMARKS) -> Model:
    """Model of labelled texts; works in blocks, so that the driver holds little more than the texts."""
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.max()) if len(y) else 0.0)
    landmarks = choose_landmarks(texts, y, n_landmarks)
    if not landmarks:
        return Model(prior=float(y.mean()))
    x = np.concatenate([text_vectors(data, off, landmarks) for data, off in _text_blocks(texts)]).astype(np.float64)
    marks = [np.frombuffer(z, np.uint8) for z in landmarks]
    among = np.array([[subsequence_kernel(a[None, :], b)[0] for b in marks] for a in marks], np.float64)
    own = np.sqrt(np.diag(among))
    value, vector = np.linalg.eigh((among / own[:, None] / own[None, :]) ** POWER)
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    phi = x @ root
    weights, bias = _svm(phi, y, _cost(phi, y))
    margin = phi @ weights + bias
    return Model(0.0, landmarks, root, weights, bias, _curve(margin, y))


def _cost(x: np.ndarray, y: np.ndarray) -> float:
    """The cost whose machines do best on the half of the rows that they have not seen (mean of both classes), the least of equals."""
    half = np.random.default_rng(6).permutation(len(y)) % 2
    best, least = -1.0, COSTS[0]
    for cost in COSTS:
        right = []
        for k in (0, 1):
            fit_to, other = half == k, half != k
            if len(np.unique(y[fit_to])) < 2 or len(np.unique(y[other])) < 2:
                return COSTS[-1]
            w, b = _svm(x[fit_to], y[fit_to], cost, 20)
            hit = (x[other] @ w + b > 0) == (y[other] > 0)
            right += [hit[y[other] > 0].mean(), hit[y[other] <= 0].mean()]
        if np.mean(right) > best + 1e-9:
            best, least = float(np.mean(right)), cost
    return least


def _svm(x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; classes weigh alike."""
    sign = np.where(y > 0, 1.0, -1.0)
    z = np.hstack([x, np.ones((len(x), 1))])
    upper = np.where(y > 0, cost * len(y) / (2 * y.sum()), cost * len(y) / (2 * (len(y) - y.sum())))
    norm = (z * z).sum(axis=1)
    alpha, w = np.zeros(len(y)), np.zeros(z.shape[1])
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (sign[i] * (z[i] @ w) - 1.0) / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, classes weighing alike, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ (margin * margin), h @ margin], [h @ margin, h.sum()]]) + np.eye(2) * 1e-4
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(b)


def _different(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Documents without those whose words are mostly those of an earlier one (five of eight least hashes agree)."""
    rng = np.random.default_rng(3)
    least = np.full((n, 8), -1, np.int64)
    has, begin = np.unique(doc, return_index=True)
    for k in range(8):
        h = mix(word.astype(np.uint64) + rng.integers(1, 2**62, dtype=np.uint64)) >> np.uint64(1)
        least[has, k] = np.minimum.reduceat(h, begin).astype(np.int64)
    keep = np.zeros(n, bool)
    for i in has.tolist():
        keep[i] = not ((least[:i][keep[:i]] == least[i]).sum(axis=1) >= 5).any()
    return keep


def _documents_and_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct (document, word) pairs in order, and the words that the numbers stand for."""
    number: dict[bytes, int] = {}
    docs, found = [], []
    before = 0
    for data, off in _text_blocks(texts):
        words, row = units(data, off)
        if len(words):
            coded = words.dictionary_encode()
            place = np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int64)
            pair = np.unique(row.astype(np.int64) << 40 | place[coded.indices.to_numpy(zero_copy_only=False)])
            docs.append((pair >> 40) + before)
            found.append(pair & ((1 << 40) - 1))
        before += len(off) - 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(docs or none), np.concatenate(found or none), list(number)


def choose_landmarks(texts: list[str], y: np.ndarray, most: int) -> list[bytes]:
    """Character sequences of toxic texts that clean texts lack, beyond what chance explains.

    Near copies of a text count once. A sequence qualifies if so many of the
    texts with it are toxic that labels dealt at random would not be expected to
    give that to any; each one chosen removes the words that it stands in before
    others are judged.
    """
    doc, word, names = _documents_and_words(texts)
    if not names:
        return []
    keys = pa.array([bytes([START]) + w for w in names], pa.large_binary())
    del names
    alone = _different(doc, word, len(y))[doc]
    doc, word = doc[alone], word[alone]
    toxic_doc = y[doc] > 0
    docs_of = np.unique(doc)
    n_toxic = int((y[docs_of] > 0).sum())
    share = np.clip(n_toxic / max(len(docs_of), 1), 0.02, 0.98)
    tox_of = np.bincount(word[toxic_doc], minlength=len(keys))
    all_of = np.bincount(word, minlength=len(keys))
    bounds = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    raw, size = np.frombuffer(keys.buffers()[2], np.uint8), np.diff(bounds)
    chosen: list[bytes] = []
    gone = np.zeros(len(keys), bool)

    def choose(z: bytes) -> None:
        chosen.append(z)
        gone[pc.match_substring(keys, z).to_numpy(zero_copy_only=False)] = True

    by_word = np.argsort(word, kind="stable")
    first = np.searchsorted(word[by_word], np.arange(len(keys) + 1))

    def judged(holders: np.ndarray) -> tuple[float, float]:
        """Evidence of the texts that have any of the words, and the toxic share of them."""
        docs = np.unique(np.concatenate([doc[by_word[first[w] : first[w + 1]]] for w in holders.tolist()]))
        tox = (y[docs] > 0).sum()
        return float(_evidence(np.array([tox]), np.array([len(docs)]), share)[0]), tox / max(len(docs), 1)

    def family(w: bytes, own: float) -> bytes:
        """The part of a word, a stem if possible, that the evidence of many more texts speaks for, or the word."""
        for starts in (range(1), range(1, len(w))):
            best, z = 1.25 * own, w
            for n, i in ((n, i) for n in range(4, len(w)) for i in starts if i + n <= len(w)):
                holders = np.flatnonzero(pc.match_substring(keys, w[i : i + n]).to_numpy(zero_copy_only=False) & (all_of > 0))
                if _evidence(tox_of[holders].sum()[None], all_of[holders].sum()[None], share)[0] > best:
                    value, purity = judged(holders)
                    if value > best and purity >= 0.99:
                        best, z = value, w[i : i + n]
            if z != w:
                break
        return z

    # Whole words first: there are fewer of them, so less can be chance.
    many = np.flatnonzero((all_of >= 2) & (size > LENGTH) & (size <= 16))
    evidence = _evidence(tox_of[many], all_of[many], share) - np.log(2.0 * max(len(many), 1))
    good = (evidence > 0) & (tox_of[many] >= 0.95 * all_of[many])
    for w in many[good][np.argsort(-evidence[good], kind="stable")].tolist():
        if len(chosen) < most and not gone[w]:
            choose(family(keys[w].as_py(), judged(np.array([w]))[0]))

    found: list[tuple[float, int, bytes, np.ndarray]] = []
    for n in (4, 5, 6):
        long = np.flatnonzero((size >= n) & (all_of > 0) & ~gone)
        count = size[long] - n + 1
        of = np.repeat(long, count)
        at = bounds[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gram = np.zeros(len(at), np.uint64)
        for i in range(n):
            gram |= raw[at + i].astype(np.uint64) << np.uint64(8 * i)
        order = np.argsort(gram, kind="stable")
        gram, of = gram[order], of[order]
        value, begin = np.unique(gram, return_index=True)
        if not len(value):
            continue
        # Sums over words are at least the numbers of texts, and cheap for all sequences.
        tox, all_ = np.add.reduceat(tox_of[of], begin), np.add.reduceat(all_of[of], begin)
        likely = _evidence(tox, all_, share)
        end = np.append(begin[1:], len(of))
        for k in np.flatnonzero((likely > np.log(2.0 * max((tox >= 3).sum(), 1))) & (tox >= 0.9 * all_)):
            found.append((float(likely[k]), n, int(value[k]).to_bytes(n, "little"), np.unique(of[begin[k] : end[k]])))
    found.sort(key=lambda f: (-f[0], -f[1], f[2]))
    for _, _, z, holders in found:
        if len(chosen) >= most:
            break
        left = holders[~gone[holders]]
        if not len(left) or tox_of[left].sum() < 0.5 * tox_of[holders].sum():
            continue
        value, purity = judged(left)
        if value > np.log(20.0 * len(found)) and purity >= 0.95:
            choose(z)
    return chosen


def _evidence(tox: np.ndarray, all_: np.ndarray, share: float) -> np.ndarray:
    """Minus log of a bound on the chance that so many of ``all_`` texts are toxic (Chernoff)."""
    all_ = np.maximum(all_, 1)
    p = np.clip(tox / all_, 1e-9, 1 - 1e-9)
    return np.where(p > share, all_ * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share))), 0.0)


def _score_rows(sent, name: str):
    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            for part, data, off in blocks(batch, most=1 << 20):
                score = pa.array(sent.value.scores(data, off, memo), pa.float64())
                yield pa.record_batch([*part.columns, score], [*part.schema.names, name])

    return run


def add_scores(docs: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """All columns of ``docs`` and the score, from the whole text (null: empty) alone.

    A column of the score's name, in upper or lower case, is an error: callers
    choose a free one (``columns.free_name``).
    """
    if free_name(docs, name) != name:
        raise ValueError(f"the table has a column {name}")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score_rows(sent, name), f"{ddl(docs, docs.columns)}, `{name}` double")


def keep_mild(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) that score under the threshold, by a model of the labels of these rows."""
    score = free_name(docs, "toxicity_score")
    return add_scores(docs, train(docs, labels), score).where(F.col(score) < threshold).drop(score)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null texts are empty, rows with null ids are not held out, repeated rows are
    scored each; extra columns are ignored.
    """
    model = train(docs, labels)
    scored = add_scores(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
