"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. One pass over the texts takes a digest of each text's words and counts the
   document frequency of hashed shingles in a table of fixed size.
2. A second pass draws consistent weighted samples of each text's shingles,
   weighted by term frequency times inverse document frequency, and hashes them
   in bands.
3. Exact copies share a digest and are one node from here on. The shingles of
   nodes in shared buckets are packed once, with their weights. Nodes of one band
   bucket are compared with the bucket's least node only, and a least node's
   shingles move once for hundreds of others.
4. Nodes that this leaves apart from their bucket's least node meet all nodes of
   their buckets by a prefix join on the shingles that the fewest of these nodes
   have, which is exact, so no link that a bucket shows is lost to the shortcut.
5. Connected components of the links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import ddl, free_name, quoted
from .components import components
from .scratch import cut
from .textblocks import ALNUM, blocks, mix, shingles, word_hashes, word_spans
from .workers import lean

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
#: Document frequencies are kept for this many hash slots, whatever the input: slots are shared by
#: shingles in the same proportion at every size, so weights behave alike.
SLOT_BITS = 17
#: Levels of weights, e^28 at most: no count of a shingle in one text reaches it, so nothing is clipped.
LEVELS = 128
_LEVEL_STEP, _LEVEL_ZERO = 0.25, 12
_TABLE_BITS = 16
_BLOCK = 1 << 19


def _text_shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every shingle, and words per row."""
    mapped = ALNUM[data]
    at, row = word_spans(mapped, off)
    n = len(off) - 1
    h, of = shingles(word_hashes(mapped, at), row, n, WORDS)
    return h, of, np.bincount(row, minlength=n)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in (row, hash) order, and how often each occurs there."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))


def _digests(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums over a row's words and places, equal for equal word sequences; words per row."""
    mapped = ALNUM[data]
    at, row = word_spans(mapped, off)
    n = len(off) - 1
    count = np.bincount(row, minlength=n)
    first = np.searchsorted(row, np.arange(n))
    place = (np.arange(len(row)) - first[row]).astype(np.uint64)
    out = []
    has = np.flatnonzero(count)
    for seed in (1, 2):
        w = word_hashes(mapped, at, seed)
        with np.errstate(over="ignore"):
            w = mix(w + place * np.uint64(0x9E3779B97F4A7C15))
        total = np.zeros(n, np.uint64)
        if len(has):
            total[has] = np.add.reduceat(w, first[has])
        out.append(mix(total + np.uint64(seed)).view(np.int64))
    return out[0], out[1], count


FIRST_SCHEMA = "doc_id bigint, d1 bigint, d2 bigint, n_words bigint, slot int, counts binary"
#: Slots whose counts travel in one row.
_SLOTS_A_ROW = 1 << 11


@lean()
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << SLOT_BITS, np.int64)
    shift = np.uint64(64 - SLOT_BITS)
    for batch in batches:
        for part, data, off in blocks(batch, most=_BLOCK):
            h, row, _ = _text_shingles(data, off)
            h, row, _ = _distinct(h, row)
            df += np.bincount((h >> shift).astype(np.int64), minlength=len(df))
            d1, d2, count = _digests(data, off)
            m = part.num_rows
            yield pa.record_batch({"doc_id": part.column(0), "d1": d1, "d2": d2, "n_words": count.astype(np.int64), "slot": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})
    rows = [(i, df[lo : lo + _SLOTS_A_ROW]) for i, lo in enumerate(range(0, len(df), _SLOTS_A_ROW))]
    rows = [(i, x.astype("<i8").tobytes()) for i, x in rows if x.any()]
    none = pa.nulls(len(rows), pa.int64())
    yield pa.record_batch({"doc_id": none, "d1": none, "d2": none, "n_words": none, "slot": pa.array([i for i, _ in rows], pa.int32()), "counts": pa.array([x for _, x in rows], pa.binary())})


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of slots: the sums of the rows of this task, which has all rows of its runs."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[slot] = total.get(slot, 0) + np.frombuffer(counts, "<i8")
    yield pa.record_batch({"slot": pa.array(list(total), pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def _idf_of(counts: DataFrame, n_docs: int) -> np.ndarray:
    """Logarithm of the inverse document frequency of every slot, from a table of fixed size."""
    df = np.zeros(1 << SLOT_BITS)
    for row in counts.repartition("slot").coalesce(8).mapInArrow(_add_slots, "slot int, counts binary").toLocalIterator():
        lo = row["slot"] * _SLOTS_A_ROW
        df[lo : lo + _SLOTS_A_ROW] = np.frombuffer(bytes(row["counts"]), "<i8")
    return np.log(np.log1p(max(n_docs, 1) / np.maximum(df, 1.0))).astype(np.float32)


def _levels(h: np.ndarray, tf: np.ndarray, log_idf: np.ndarray) -> np.ndarray:
    """Weights tf * idf on a logarithmic grid: level i stands for exp((i - zero) * step)."""
    log_weight = np.log(tf.astype(np.float32)) + log_idf[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    return np.clip(np.rint(log_weight / _LEVEL_STEP) + _LEVEL_ZERO, 0, LEVELS - 1).astype(np.int64)


WEIGHTS = np.exp((np.arange(LEVELS) - _LEVEL_ZERO) * _LEVEL_STEP)


def _weights(h: np.ndarray, tf: np.ndarray, log_idf: np.ndarray) -> np.ndarray:
    """Weights tf * idf as similarities use them, off the grid that samples are drawn on."""
    return (tf * np.exp(log_idf[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])).astype(np.float32)


class Sampler:
    """Consistent weighted samples; draws of r, c and beta come from a table indexed by the shingle's hash.

    ``table[level, i]`` is ln a = ln c - r (t - beta) - r with
    t = floor(ln S / r + beta), as an integer that sorts alike. Equal shingle
    and equal a mean equal (shingle, t), so the least (a, shingle) is the sample.
    """

    def __init__(self) -> None:
        n = 1 << _TABLE_BITS
        rng = np.random.default_rng(20)
        r, c, beta = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
        self.table = np.empty((LEVELS, n), np.uint32)
        log_c = np.log(c)
        # A level at a time, so that no wide table of doubles is ever held.
        for level, log_s in enumerate(np.log(WEIGHTS)):
            t = np.floor(log_s / r + beta)
            bits = (log_c - r * (t - beta) - r).astype(np.float32).view(np.uint32)
            self.table[level] = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        self.factor = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.spread = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, h: np.ndarray, row: np.ndarray, level: np.ndarray, n_rows: int) -> np.ndarray:
        """Band hashes (n_rows x BANDS); rows without shingles get zeros."""
        out = np.zeros((n_rows, BANDS), np.uint64)
        step = 1 << 16
        bounds = np.searchsorted(row, np.arange(n_rows + 1))
        lo = 0
        while lo < n_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + step, "right")) - 1)
            hi = min(hi, n_rows)
            a, b = bounds[lo], bounds[hi]
            has = np.flatnonzero(np.diff(bounds[lo : hi + 1]))
            if len(has):
                self._fill(out[lo:hi], has, bounds[lo:hi][has] - a, h[a:b], level[a:b])
            lo = hi
        return out

    def _fill(self, out, has, begin, h, level) -> None:
        flat_table = self.table.ravel()
        base = level << _TABLE_BITS
        low = h & np.uint64(0xFFFFFFFF)
        shift = np.uint64(64 - _TABLE_BITS)
        for band in range(BANDS):
            total = np.zeros(len(has), np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                with np.errstate(over="ignore"):
                    at = ((h * self.factor[k]) >> shift).astype(np.int64)
                    at += base
                    key = flat_table[at].astype(np.uint64)
                    key <<= np.uint64(32)
                    key |= low
                    total += mix(np.minimum.reduceat(key, begin)) * self.spread[k]
            with np.errstate(over="ignore"):
                out[has, band] = mix(total + np.uint64(band + 1))


def _bands_pass(sent):
    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, log_idf = Sampler(), sent.value
        for batch in batches:
            for part, data, off in blocks(batch, most=_BLOCK):
                h, row, count = _text_shingles(data, off)
                h, row, tf = _distinct(h, row)
                n = part.num_rows
                bands = sampler.bands(h, row, _levels(h, tf, log_idf), n).view(np.int64)
                d1, d2, _ = _digests(data, off)
                keep = pa.array(count > 0)
                lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.ravel()))
                yield pa.record_batch({"doc_id": part.column(0), "d1": d1, "d2": d2, "bands": lists}).filter(keep)

    return run


PACKED = "node bigint, h array<bigint>, weights array<float>, weight double"


def _pack_pass(sent):
    """A node's distinct shingles in hash order with their weights, and their total weight."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_idf = sent.value
        for batch in batches:
            for part, data, off in blocks(batch, most=_BLOCK):
                d1, d2, _ = _digests(data, off)
                # Other texts under the same id are not this node.
                own = (d1 == part.column("d1").to_numpy(zero_copy_only=False)) & (d2 == part.column("d2").to_numpy(zero_copy_only=False))
                h, row, _ = _text_shingles(data, off)
                h, row, tf = _distinct(h, row)
                w = _weights(h, tf, log_idf)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                packed = {
                    "node": part.column("node"), "h": pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))),
                    "weights": pa.ListArray.from_arrays(ends, pa.array(w)), "weight": np.bincount(row, w, part.num_rows),
                }
                yield pa.record_batch(packed).filter(pa.array(own))

    return run


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes and weights of a batch of packed nodes, and where each node's begin."""
    h, w = batch.column("h"), batch.column("weights")
    ends, at = np.asarray(h.offsets), np.asarray(w.offsets)
    hashes, weights = (x.values.to_numpy(zero_copy_only=False) for x in (h, w))
    return hashes[ends[0] : ends[-1]].view(np.uint64), weights[at[0] : at[-1]].astype(np.float64), ends - ends[0]


#: Nodes that are compared with one copy of a centre's shingles.
_RUN = 512


@lean()
def _compare_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarities of runs of rows: a centre (``b`` null), then the nodes to compare it with."""
    mine = None
    for batch in batches:
        h, w, ends = _arrays(batch)
        a = batch.column("a").to_numpy(zero_copy_only=False)
        centre = np.asarray(batch.column("b").is_null())
        b = batch.column("b").fill_null(0).to_numpy(zero_copy_only=False)
        total = batch.column("weight").to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(centre)
        sim = np.zeros(len(a))
        for lo, hi in zip(np.append(0, heads), np.append(heads, len(a)), strict=True):
            if lo < hi and centre[lo]:
                mine = h[ends[lo] : ends[lo + 1]].copy(), w[ends[lo] : ends[lo + 1]].copy(), total[lo]
                lo += 1
            if lo >= hi:
                continue
            hashes, weights, whole = mine
            theirs = h[ends[lo] : ends[hi]]
            at = np.minimum(np.searchsorted(hashes, theirs), len(hashes) - 1)
            both = np.where(hashes[at] == theirs, np.minimum(weights[at], w[ends[lo] : ends[hi]]), 0.0)
            shared = np.add.reduceat(both, ends[lo:hi] - ends[lo])
            sim[lo:hi] = shared / np.maximum(whole + total[lo:hi] - shared, 1e-9)
        found = np.flatnonzero(~centre)
        yield pa.record_batch({"a": a[found], "b": b[found], "sim": sim[found]})


@lean()
def _spread_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of every node: node, hash, weight, total weight of the node."""
    for batch in batches:
        h, w, ends = _arrays(batch)
        of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        node, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight"))
        for lo in range(0, len(h), 1 << 16):
            i = of[lo : lo + (1 << 16)]
            yield pa.record_batch({"y": node[i], "h": h[lo : lo + (1 << 16)].view(np.int64), "w": w[lo : lo + (1 << 16)], "total": weight[i]})


class _Verifier:
    """Similarities of node pairs, from whole texts; each pair is computed once."""

    def __init__(self, docs: DataFrame, sent, wanted: DataFrame):
        # The texts of nodes in shared buckets only: one pass over the documents, dealt by id.
        texts = docs.join(wanted.withColumnRenamed("lo", "doc_id").hint("merge"), "doc_id").select("node", "text", "d1", "d2")
        self.packed = cut(texts.mapInArrow(_pack_pass(sent), PACKED), "near-packed")
        self.done: DataFrame | None = None

    def single(self) -> None:
        """One row per node where ids are repeated; the rows of a node are alike."""
        self.packed = cut(self.packed.groupBy("node").agg(*[F.first(c).alias(c) for c in ("h", "weights", "weight")]), "near-packed")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """``a, b, sim`` of the distinct pairs, and of no pair computed before."""
        pairs = pairs.distinct()
        if self.done is not None:
            pairs = pairs.join(self.done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = cut(pairs, "near-pairs")
        runs = pairs.groupBy("a").agg((F.count("*") / _RUN).cast("int").alias("runs"))
        dealt = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs") + 1).alias("run"), "b")
        others = dealt.join(self.packed, F.col("b") == F.col("node")).drop("node")
        centres = runs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs").cast("long"))).alias("run"), F.lit(None).cast("long").alias("b"))
        centres = centres.join(self.packed, F.col("a") == F.col("node")).drop("node")
        rows = centres.unionByName(others).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
        found = cut(rows.select("a", "b", "h", "weights", "weight").mapInArrow(_compare_pass, "a bigint, b bigint, sim double"), "near-sims")
        self.done = found if self.done is None else self.done.unionByName(found)
        return found


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size, n_words`` for every row of ``docs``.

    Rows are in one class if a chain of pairs with weighted Jaccard similarity of
    at least ``threshold`` over five-word shingles joins them; ``class_id`` is
    the least id of the class. Texts are compared by their words (letters and
    digits; case and punctuation don't count); a text under five words has all
    its words as one shingle. Rows without words, null texts among them, are
    classes of their own. Rows with null ids get their exact copies' class if
    one has an id, else a null class. Repeated rows share a class; rows with the
    same id but other words are told apart, each under its own words' class: two
    classes may then have one least id, but are counted apart. Extra columns are
    ignored; an empty table gives no rows.
    """
    out = cut(_classes(docs, threshold), "near-classes")
    sizes = out.groupBy(F.col("class_key").alias("k"), F.col("class_id").alias("c")).agg(F.count("*").alias("class_size"))
    same = F.col("class_id").eqNullSafe(F.col("c")) & F.col("class_key").eqNullSafe(F.col("k"))
    return out.join(sizes, same).select("doc_id", "class_id", "class_size", "n_words")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """``doc_id, d1, d2, n_words, class_key, class_id`` of every row; keys tell classes with one least id apart."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut(docs.mapInArrow(_first_pass, FIRST_SCHEMA), "near-first")
    rows = first.where("slot is null").select("doc_id", "d1", "d2", "n_words")
    n_docs = rows.count()
    sent = spark.sparkContext.broadcast(_idf_of(first.where("slot is not null").select("slot", "counts"), n_docs))

    digests = rows.where("n_words > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("lo"))
    # A node has its least id as its key; of several texts with one least id, the others have a hash of their digest.
    heads = digests.where("lo is not null").groupBy("lo").agg(F.min(F.struct("d1", "d2")).alias("d"))
    key = F.when((F.col("d.d1") == F.col("d1")) & (F.col("d.d2") == F.col("d2")), F.col("lo")).otherwise(F.xxhash64("d1", "d2"))
    nodes = cut(digests.join(heads, "lo", "left").select("d1", "d2", "lo", F.when(F.col("lo").isNotNull(), key).alias("node")), "near-nodes")
    bands = docs.mapInArrow(_bands_pass(sent), "doc_id bigint, d1 bigint, d2 bigint, bands array<bigint>")
    held = nodes.where("lo is not null").select("node", "lo", F.col("d1").alias("n1"), F.col("d2").alias("n2"))
    mine = (F.col("doc_id") == F.col("lo")) & (F.col("d1") == F.col("n1")) & (F.col("d2") == F.col("n2"))
    entry = cut(bands, "near-bands").join(held, mine).select(F.explode("bands").alias("bucket"), "node").distinct()
    full = entry.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    entry = cut(entry.join(full, "bucket"), "near-entries")

    verify = _Verifier(docs, sent, entry.select("node").distinct().join(nodes, "node").select("node", "lo", "d1", "d2"))
    if _has_repeats(rows):
        verify.single()
    # One star per bucket, from its least node; both ways of counting a bucket are partial sums.
    centre = entry.groupBy("bucket").agg(F.min("node").alias("a"))
    star = entry.join(centre, "bucket").where("node <> a").select("a", F.col("node").alias("b"))
    verify(star)
    labels = cut(_labels(verify, threshold), "near-labels")
    open_ = cut(_open_pairs(verify, entry, labels, threshold), "near-open")
    if not open_.isEmpty():
        # The likeliest partner in each other component first; what that leaves apart is compared in full.
        best = Window.partitionBy("x", "cy").orderBy(F.desc("shared"), "y")
        verify(_ordered(open_.withColumn("k", F.row_number().over(best)).where("k = 1")))
        labels = cut(_labels(verify, threshold), "near-labels")
        apart = _labelled(_labelled(open_.select("x", "y"), labels, "x", "cx"), labels, "y", "cy").where("cx <> cy")
        rest = cut(_ordered(apart), "near-rest")
        if not rest.isEmpty():
            verify(rest)
            labels = cut(_labels(verify, threshold), "near-labels")

    keyed = nodes.join(labels, "node", "left").select("d1", "d2", "lo", F.coalesce("component", "node").alias("class_key"))
    # Keys that aren't ids may be the least of their component, so the least id is taken anew.
    least = keyed.where("class_key is not null").groupBy("class_key").agg(F.min("lo").alias("class_id"))
    classed = keyed.join(least, "class_key", "left").select("d1", "d2", "class_key", "class_id")
    words = rows.where("n_words > 0").join(classed, ["d1", "d2"])
    empty = rows.where("n_words = 0").withColumns({"class_key": F.lit(None).cast("long"), "class_id": F.col("doc_id")})
    return words.unionByName(empty)


def _labels(verify: _Verifier, threshold: float) -> DataFrame:
    return components(verify.done.where(F.col("sim") >= threshold).select("a", "b"))


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    of = labels.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return df.join(of, F.col(node) == F.col("__n"), "left").withColumn(name, F.coalesce("__c", node)).drop("__n", "__c")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _open_pairs(verify: _Verifier, entry: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``x, y, cx, cy, shared`` of different components that may still be linked.

    Two nodes of one bucket that are not in one component can't both be in its
    centre's, so one of them is x: a node apart from its centre. Only nodes of the
    buckets of such nodes are looked at. With shingles in one order, those that
    the fewest nodes have first, two texts as similar as the threshold have their
    first common shingle in both their prefixes, a prefix being the shingles from
    which on the text still has ``threshold`` of its weight. Shingles that no
    other node has can't be shared, so they bound the similarity of a pair from
    above. Neither filter loses a link.
    """
    apart = _labelled(_labelled(verify.done.where(F.col("sim") < threshold).select("a", "b"), labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
    x = cut(apart.select(F.col("b").alias("x")).distinct(), "near-apart")
    buckets = entry.join(x, F.col("node") == F.col("x")).select("bucket").distinct()
    near = entry.join(buckets, "bucket", "left_semi").select("node").distinct()
    spread = cut(verify.packed.join(near, "node", "left_semi").mapInArrow(_spread_pass, "y bigint, h bigint, w double, total double"), "near-spread")
    shared = spread.groupBy("h").agg(F.count("*").alias("nodes")).where("nodes > 1")
    of_node = Window.partitionBy("y")
    rare = of_node.orderBy("nodes", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = spread.join(shared, "h").withColumns({"before": F.sum("w").over(rare) - F.col("w"), "common": F.sum("w").over(of_node)})
    # What no other node has comes before everything else in the order.
    alone = F.greatest(F.col("total") - F.col("common"), F.lit(0.0))
    kept = F.col("total") - alone - F.col("before") >= (threshold - 1e-9) * F.col("total")
    prefix = met.withColumn("u", alone).where(kept).select("y", "h", F.col("total").alias("t"), "u")
    prefix = cut(_labelled(prefix, labels, "y", "cy"), "near-prefix")
    left = prefix.join(x, F.col("y") == F.col("x")).select("x", "h", F.col("t").alias("tx"), F.col("u").alias("ux"), F.col("cy").alias("cx"))
    most = F.least(F.col("tx") - F.col("ux"), F.col("t") - F.col("u"))
    least = F.greatest(F.col("tx") + F.col("u"), F.col("t") + F.col("ux"))
    found = left.join(prefix.alias("r"), "h").where("cx <> cy").where(most >= least * (threshold - 1e-9))
    return found.groupBy("x", "y", "cx", "cy").agg(F.count("*").alias("shared"))


def _has_repeats(rows: DataFrame) -> bool:
    return not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _with_digests(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """All columns of ``docs`` and, under the names, both digests and the number of words of each text."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in blocks(batch, most=_BLOCK):
                d1, d2, count = _digests(data, off)
                yield pa.record_batch([*part.columns, pa.array(d1), pa.array(d2), pa.array(count, pa.int64())], [*part.schema.names, *names])

    return docs.mapInArrow(run, f"{ddl(docs, docs.columns)}, {names[0]} bigint, {names[1]} bigint, {names[2]} bigint")


def keep_one(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand for their class: of each class, one with its least id.

    Rows without words are kept, whatever their id. Of rows with one id and the
    same words one stays, the least by text and then by a hash of all columns; of
    several texts with one id each stands for its own class. Rows with null ids
    go if a row with an id has the same words; else one stays for each different
    word sequence.
    """
    classes = cut(_classes(docs, threshold), "near-keep")
    if not _has_repeats(classes) and classes.where("doc_id is null").isEmpty():
        own = free_name(docs, "__own")
        ids = classes.where("doc_id = class_id").select(F.col("doc_id").alias(own))
        return docs.join(ids, F.col("doc_id").cast("long") == F.col(own), "left_semi")
    d1, d2, n = names = tuple(free_name(docs, x) for x in ("__d1", "__d2", "__n"))
    # The texts that stand for their classes, and their ids: the least id, then the least digest.
    stands = classes.where("n_words > 0 and class_key is not null and doc_id is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "d1", "d2")).alias("s")).select("s.*")
    lone = classes.where("n_words > 0 and class_key is null").select(F.lit(None).cast("long").alias("doc_id"), "d1", "d2").distinct()
    stands = stands.unionByName(lone).select(F.col("doc_id").alias("s0"), F.col("d1").alias("s1"), F.col("d2").alias("s2"))
    tagged = _with_digests(docs, names)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("s0")) & (F.col(d1) == F.col("s1")) & (F.col(d2) == F.col("s2"))
    mine = quoted(docs.columns)
    chosen = tagged.where(F.col(n) > 0).join(stands, same, "left_semi").groupBy(d1, d2).agg(F.min_by(F.struct(*mine), F.struct(F.col("text"), F.xxhash64(*mine))).alias("row"))
    return chosen.select("row.*").unionByName(tagged.where(F.col(n) == 0).select(*mine))
