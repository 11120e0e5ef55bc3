"""Decontamination, token counts, substring dedup, near duplicates, token files, toxicity, pipeline."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracelode.llm import components, decontaminate, near_dup, queries, substring_dedup, token_coder, token_count, toxicity
from tracelode.llm.scratch import shared_dir
from tracelode.llm.textblocks import flat
from tracelode.llm.wordpieces import Encoder

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.TOKENIZER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


# op3


def brute_hits(text, items, slop=0):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for s in range(len(words) - n + 1):
                if words[s : s + n] == w[p : p + n]:
                    hit.update(range(s, s + n))
                    found.add(item)
    runs = [len(r.split()) for r in "".join("x " if i in hit else "| " for i in range(len(words))).split("|")]
    return len(words), len(hit), found, max(runs, default=0)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, sentence(rng, rng.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(50, ""), (51, "Zu kurz"), (51, "Zu kurz")]
    texts = [None, "", "zu, KURZ! zu kurz", "zu", items[3][1]]
    for _ in range(40):
        bits = [sentence(rng, rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].split()
            a = rng.randrange(max(1, len(w)))
            bits.append(" ".join(w[a:]).upper())
        texts.append(". ".join(bits))
    docs = documents(spark, [*enumerate(texts), (2, texts[2])]).withColumn("n_hit", F.lit("clash"))
    table = spark.createDataFrame([*items, (None, "null id"), (60, None)], "item_id bigint, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}

    def check():
        index = decontaminate.build_index(docs)
        for rows in (decontaminate.contamination(docs, table).collect(), decontaminate.index_contamination(index, table).collect()):
            assert len(rows) == len(texts) + 1
            for r in rows:
                n, hit, found, longest = want[r["doc_id"]]
                assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0 and 20 * hit >= n)
                assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() and r["longest_hit"] == longest

    check()
    monkeypatch.setattr(decontaminate, "PART_BYTES", 300)  # several parts add up to the same
    check()
    # Many texts of one id go in several parts, too, and ids may be strings.
    one = table.where("text is not null and item_id is not null").withColumn("item_id", F.lit("one"))
    for r in decontaminate.contamination(docs, one).collect():
        n, hit, found, _ = want[r["doc_id"]]
        assert (r["n_hit"], r["n_items"]) == (hit, int(hit > 0))
    assert {r["n_hit"] for r in decontaminate.contamination(docs, table.limit(0)).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), table).count() == 0
    assert decontaminate.index_contamination(decontaminate.build_index(docs.limit(0)), table).count() == 0


def test_decontamination_replaces_names_in_either_case(spark):
    docs = documents(spark, [(None, "a b c"), (None, None)]).withColumns({"N_HIT": F.lit(1), "__Hits": F.lit(2)})
    items = spark.createDataFrame([(1, "b c")], "item_id int, text string")
    rows = decontaminate.contamination(docs, items)
    assert [c for c in rows.columns if c.lower() == "n_hit"] == ["n_hit"] and "__Hits" in rows.columns
    assert sorted(r["n_hit"] for r in rows.collect()) == [0, 2]
    assert sorted(r["n_hit"] for r in decontaminate.index_contamination(decontaminate.build_index(docs), items).where("doc_id is null").collect()) == [0, 2]


def test_stored_index_and_proximity(spark):
    docs = documents(spark, [(1, "one two three four five"), (2, "one two extra three four five"), (3, "five four three two one")])
    items = spark.createDataFrame([(7, "two three four")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    exact = decontaminate.search_index(index, items).collect()
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in exact] == [(1, 7, 1)]
    assert {r["doc_id"] for r in decontaminate.search_index(index, items, slop=1).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontaminate.search_index(index, items, slop=4).collect()} == {1, 2, 3}


# op4, op10


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_library_s_ids(tokenizer):
    rng = random.Random(1)
    bits = ["a", "B", "é", "e\u0301", "\u0301", "'s", "'", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x0b", "\x85", ".", ",", "..", "<|endoftext|>", "<|ENDOFTEXT|>", "%", "9", "日本", "ΑΣ", "İ", "ß", "😀", "\x00", "<", "|>", "ll", "ﬁ", "Straße", "naïve,"]
    texts = ["", None, ".", " ,"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(4000)]
    encoder = Encoder(PATH, most=500)
    assert encoder.piecewise
    ids, count = encoder.encode(*flat(pa.array(texts)))
    want = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert count.tolist() == list(map(len, want)) and ids.tolist() == list(itertools.chain.from_iterable(want))
    assert encoder.counts(*flat(pa.array(texts))).tolist() == count.tolist()


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path)
    assert not encoder.piecewise
    texts = ["Hello  world", "", "é\n"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(*flat(pa.array(texts)))[1].tolist() == list(map(len, want))


def test_token_counts_and_cache(spark, tokenizer, tmp_path):
    texts = [None, "", "a b", "a  b", "a\nb", "x " * 2049, "x " * 2048, "<|endoftext|>"]
    rows = [*enumerate(texts), (2, "other text"), (2, "a b"), (None, "null id"), (None, None)]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("clash"))
    cache = f"file://{tmp_path}/cache"
    got = sorted(map(tuple, token_count.count_tokens(docs, PATH, cache).collect()), key=str)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 2048) for i, t in rows), key=str)
    stored = spark.read.parquet(cache).count()
    assert stored == len({re.sub(r"[ \t\n\r]+", " ", t or "") for _, t in rows})
    more = documents(spark, [(9, "a b"), (10, "fresh")])
    assert token_count.count_tokens(more, PATH, cache).count() == 2
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_count.count_tokens(docs.limit(0), PATH).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    n = token_coder.BLOCK_IDS
    for ids in (np.zeros(0), np.array([49407]), rng.integers(0, 49408, 3 * n + 5), np.full(n, 7), rng.integers(0, 3, n + 1), rng.zipf(1.3, 2 * n) % 49408):
        ids = ids.astype(np.uint32)
        coded = token_coder.encode_blocks(ids, 49408)
        assert np.array_equal(token_coder.decode_blocks(coded, 49408), ids)
        for i in range(len(coded)):  # blocks stand alone
            assert np.array_equal(token_coder.decode_blocks([coded[i]], 49408), ids[i * n : (i + 1) * n])
    raw = bytearray(token_coder.encode_blocks(np.arange(100, dtype=np.uint32), 49408)[0])
    raw[20] ^= 1
    with pytest.raises(token_coder.BadBlock):
        token_coder.decode_blocks([bytes(raw)], 49408)
    assert sum(map(len, token_coder.encode_blocks(np.tile(np.arange(50, dtype=np.uint32), 200), 49408))) < 5000


def test_coder_uses_two_ids_before():
    """What follows 7 is told by the id before it: random are only 3 bits of every three ids."""
    rng = np.random.default_rng(18)
    first = rng.integers(100, 108, 2 * token_coder.BLOCK_IDS)
    ids = np.stack([first, np.full(len(first), 7), first * 31], axis=1).ravel().astype(np.uint32)
    coded = token_coder.encode_blocks(ids, 5000)
    assert (token_coder.decode_blocks(coded, 5000) == ids).all()
    assert sum(map(len, coded)) < 0.8 * len(first)


def test_token_files(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(5, "b c"), (1, None), (9, "x " * 9000), (5, "b c"), (5, "a"), (None, "n"), (7, "")]
    docs = documents(spark, rows).withColumn("start", F.lit("clash")).repartition(3)
    got = token_coder.round_trip(docs, PATH, f"file://{tmp_path}/t").collect()
    at, want = 0, []
    from_id = lambda r: (r[0] is not None, r[0] or 0)
    for i, group in itertools.groupby(sorted(rows, key=from_id), key=lambda r: r[0]):
        for t in [r[1] for r in group]:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            at += len(ids)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == [0, *itertools.accumulate(r["n_tokens"] for r in order)][:-1]
    assert [from_id((r["doc_id"],)) for r in order] == sorted(from_id((r["doc_id"],)) for r in order)
    assert token_coder.round_trip(docs.limit(0), PATH, f"file://{tmp_path}/e").count() == 0


# op6


def test_chunks_resist_shifts_and_stand_alone():
    rng = random.Random(4)
    texts = [sentence(rng, 200) for _ in range(20)] + ["", "é" * 9000, "a" * 20000, "日本語" * 700]
    data, off = flat(pa.array(texts))
    starts = substring_dedup.chunk_starts(data, off)
    for i, t in enumerate(texts):
        alone = substring_dedup.chunk_starts(*flat(pa.array([t])))
        assert np.array_equal(alone, starts[(starts >= off[i]) & (starts < off[i + 1])] - off[i])
        raw = t.encode()
        for a, b in itertools.pairwise([*alone.tolist(), len(raw)]):
            assert 0 < b - a <= substring_dedup.MOST_CHUNK + 3
            raw[a:b].decode()
    passage = sentence(rng, 60)
    rows = [f"{sentence(rng, 33)} {passage} {sentence(rng, 20)}", f"x{sentence(rng, 47)} {passage}"]
    cut = []
    for t in rows:
        s = [*substring_dedup.chunk_starts(*flat(pa.array([t]))).tolist(), len(t)]
        cut.append({t[a:b] for a, b in itertools.pairwise(s)})
    assert sum(map(len, cut[0] & cut[1])) > len(passage) / 2


def test_shared_passages(spark):
    rng = random.Random(5)
    passage, own = sentence(rng, 60), [sentence(rng, 80) for _ in range(8)]
    rows = [(i, own[i]) for i in range(4)] + [(i, f"{own[i]} {passage} {sentence(rng, 30)}") for i in range(4, 8)] + [(8, None), (9, ""), (10, own[0]), (None, own[1])]
    docs = documents(spark, rows).withColumn("n_bytes", F.lit("clash"))
    out = {r["doc_id"]: r for r in substring_dedup.shared_passages(docs).collect()}
    assert len(out) == len(rows)
    assert {i for i, r in out.items() if r["repeated"]} == {0, 1, 4, 5, 6, 7, 10, None}
    assert out[4]["removed_bytes"] == 0 and all(out[i]["removed_bytes"] > 200 for i in (5, 6, 7))
    assert out[10]["removed_bytes"] == len(own[0]) and out[0]["removed_bytes"] == 0
    assert (out[8]["n_chunks"], out[9]["n_bytes"]) == (0, 0)
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(documents(spark, rows[:-1])).collect()}
    assert left[4] == rows[4][1] and left[10] == "" and left[8] is None
    for i in (5, 6, 7):
        assert len(left[i].encode()) == len(rows[i][1].encode()) - out[i]["removed_bytes"]
    assert substring_dedup.shared_passages(docs.limit(0)).count() == 0


def test_passages_repeat_within_a_document_and_under_one_id(spark):
    rng = random.Random(6)
    passage, other, third, alone = (sentence(rng, 80) for _ in range(4))
    within = " ".join([passage, *[f"{sentence(rng, 20)} {passage}" for _ in range(9)]])
    rows = [(1, within), (2, other), (2, f"{sentence(rng, 30)} {other}"), (None, third), (None, third), (3, alone)]
    docs = documents(spark, rows)
    out = collections.defaultdict(list)
    for r in substring_dedup.shared_passages(docs).collect():
        out[r["doc_id"]].append(r)
    one = out[1][0]
    assert one["repeated"] and one["n_shared"] == one["shared_bytes"] == one["longest_shared"] == 0
    assert 9 * (len(passage) - 150) < one["removed_bytes"] <= one["within_bytes"] < 9 * (len(passage) + 2)
    for i in (2, None):
        assert all(r["repeated"] and r["within_bytes"] == 0 for r in out[i])
        assert min(r["removed_bytes"] for r in out[i]) == 0 and max(r["removed_bytes"] for r in out[i]) > 200
    assert not out[3][0]["repeated"] and out[3][0]["within_bytes"] == 0
    left = collections.defaultdict(list)
    for r in substring_dedup.remove_passages(docs).collect():
        left[r["doc_id"]].append(r["text"])
    assert left[1][0].startswith(passage) and len(left[1][0]) == len(within) - one["removed_bytes"]
    assert sorted(left[None]) == ["", third] and other in left[2] and left[3] == [alone]


def brute_passages(rows, least):
    """All columns of ``shared_passages`` from the chunks of each text, in the order (id with nulls last, place in the list)."""
    chunks, out = [], []
    for _, t in rows:
        raw = (t or "").encode()
        at = [*substring_dedup.chunk_starts(*flat(pa.array([t or ""]))).tolist(), len(raw)] if raw else []
        chunks.append([raw[a:b] for a, b in itertools.pairwise(at)])
    holders = collections.defaultdict(set)
    for i, c in enumerate(chunks):
        for x in c:
            holders[x].add(i)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, result = set(), {}
    for i in order:
        own = set()
        flags = []
        for x in chunks[i]:
            flags.append((len(x), len(holders[x]) > 1, x in seen or x in own, x in own))
            own.add(x)
        seen |= own

        def runs(k, flags=flags):
            """The length of the run of flagged chunks that each chunk stands in."""
            sizes, bytes_ = [], [0] * len(flags)
            for on, group in itertools.groupby(range(len(flags)), key=lambda j: flags[j][k]):
                group = list(group)
                if on:
                    total = sum(flags[j][0] for j in group)
                    for j in group:
                        bytes_[j] = total
            return bytes_

        shared, again = runs(1), runs(2)
        longest = max(shared, default=0)
        removed = sum(f[0] for f, n in zip(flags, again, strict=True) if f[2] and n >= least)
        result[i] = (
            rows[i][0], len((rows[i][1] or "").encode()), len(flags), sum(n >= least for n in shared), sum(f[0] for f, n in zip(flags, shared, strict=True) if n >= least),
            longest, sum(f[0] for f in flags if f[3]), removed, longest >= least or removed > 0,
        )
    return [result[i] for i in range(len(rows))]


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    passages = [sentence(rng, n) for n in (12, 30, 60, 90)] + ["tick tock " * 40, "é" * 300]
    rows = []
    for i in range(120):
        bits = [sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(4))]
        bits += [rng.choice(passages) for _ in range(rng.randrange(3))]
        rng.shuffle(bits)
        rows.append((rng.choice([i, i, i, 7, None]), " ".join(bits)))
    rows += [(500, None), (501, ""), (502, rows[3][1])]
    docs = documents(spark, rows).coalesce(1)
    for least in (100, 1):
        got = sorted(map(tuple, substring_dedup.shared_passages(docs, least).collect()), key=str)
        assert got == sorted(brute_passages(rows, least), key=str)


def test_a_repeated_pattern_is_set_off_from_its_surroundings(spark):
    rng = random.Random(15)
    pattern = "tick " * 60
    rows = [(i, f"{sentence(rng, 40)} {pattern}{sentence(rng, 40)}") for i in range(4)] + [(9, sentence(rng, 80))]
    out = {r["doc_id"]: r for r in substring_dedup.shared_passages(documents(spark, rows)).collect()}
    assert all(out[i]["repeated"] and out[i]["n_shared"] > 0 for i in range(4)) and out[9]["n_shared"] == 0


def test_gear_hash_and_digests_are_what_they_are_called():
    data, off = flat(pa.array([sentence(random.Random(16), 300), "", "é" * 300]))
    hashes, h = [], 0
    for b in data.tolist():
        h = (2 * h + int(substring_dedup._GEAR[b])) % (1 << (8 * substring_dedup._GEAR.itemsize))
        hashes.append(h)
    assert substring_dedup.gear_hashes(data).tolist() == hashes
    h1, h2, row, place, size = substring_dedup._chunks(data, off)
    for i in range(len(row)):
        at = int(off[row[i]] + place[i])
        assert h1[i].tobytes() + h2[i].tobytes() == hashlib.blake2b(data[at : at + size[i]].tobytes(), digest_size=16).digest()


def test_op6_takes_passages_out(spark, tmp_path):
    rng = random.Random(17)
    passages = [sentence(rng, 60), sentence(rng, 90), "é" * 300, "日本語 " * 60]
    rows = []
    for i in range(150):
        bits = [sentence(rng, rng.randrange(1, 50)) for _ in range(rng.randrange(4))] + [rng.choice(passages) for _ in range(rng.randrange(3))]
        rng.shuffle(bits)
        rows.append((i, " ".join(bits)))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (None, passages[0])]
    documents(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    left, seen = {}, set()
    for i, t in rows:
        raw = (t or "").encode()
        at = [*substring_dedup.chunk_starts(*flat(pa.array([t or ""]))).tolist(), len(raw)]
        chunks = [raw[a:b] for a, b in itertools.pairwise(at)]
        again = [c in seen or c in chunks[:j] for j, c in enumerate(chunks)]
        kept = b""
        for old, group in itertools.groupby(range(len(chunks)), key=again.__getitem__):
            run = b"".join(chunks[j] for j in group)
            kept += b"" if old and len(run) >= substring_dedup.LEAST_PASSAGE else run
        left[i] = kept
        seen.update(chunks)
    out = {r["doc_id"]: r for r in queries.op6_substring_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["left_bytes"], r["left_sha256"]) for i, r in out.items()} == {i: (len(t), hashlib.sha256(t).hexdigest()) for i, t in left.items()}
    assert all(r["left_bytes"] == r["n_bytes"] - r["removed_bytes"] for r in out.values()) and out[502]["left_bytes"] == 0 < out[502]["n_bytes"]
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(documents(spark, rows)).collect()}
    assert texts[500] is None and {i: (t or "").encode() for i, t in texts.items()} == left


# op9


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(9, 9)]
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]} | {i: find(i) for i in got}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def bags(rows, exact=False):
    """Weighted five-word shingles of every row, made from strings; document frequencies are true counts if
    ``exact``, else counted in the operator's slots."""
    found = []
    for _, text in rows:
        w = words_of(text)
        found.append(collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    names = sorted(set().union(*found))
    if exact:
        slot = {k: k for k in names}
    else:
        h, _, _ = near_dup._text_shingles(*flat(pa.array(names, pa.large_string())))
        slot = {k: int(x) >> (64 - near_dup.SLOT_BITS) for k, x in zip(names, h, strict=True)}
    df = collections.Counter(slot[k] for bag in found for k in bag)
    idf = {k: math.log(1 + len(rows) / df[slot[k]]) for k in names}
    return [{k: n * idf[k] for k, n in bag.items()} for bag in found]


def jaccard(a, b):
    low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute_classes(rows):
    """Classes by weighted Jaccard over all pairs."""
    bag = bags(rows)
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bag[i] and bag[j] and jaccard(bag[i], bag[j]) >= 0.8:
            x, y = find(rows[i][0]), find(rows[j][0])
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    rows, common = [], sentence(rng, 60)
    for f in range(12):
        base = sentence(rng, rng.choice([6, 40, 150, 300])).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 30, len(w) // 12])):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((len(rows) * 3 + 1, (f"{common} " if f % 3 == 0 else "") + " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(["a b", "A, b!", "a b c d", "", None, "..."])]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(documents(spark, rows).repartition(5)).collect()}
    assert got == brute_classes(rows)
    assert got[1000] == got[1001] == 1000 and got[1003] == 1003 and got[1004] == 1004


def test_near_duplicates_of_odd_tables(spark):
    rng = random.Random(8)
    t, u = sentence(rng, 50), sentence(rng, 50)
    rows = [(1, t), (1, t), (2, u), (2, t), (None, u), (None, "only here now and never again"), (3, t + " end"), (4, sentence(rng, 30))]
    docs = documents(spark, rows).withColumn("class_id", F.lit("clash"))
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dup.near_duplicate_classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (2, 1), (None, 2), (None, None), (3, 1), (4, 4)], key=str)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect())[1] == 1
    assert near_dup.near_duplicate_classes(docs.limit(0)).count() == 0


def test_planted_edits_are_found(spark):
    """Every pair of at least 0.8 by exact weights is in one class, and no class joins texts below 0.7 only."""
    rng = random.Random(12)
    rows, groups = [], []
    for share in (0.01, 0.05, 0.1, 0.2):
        for _ in range(5):
            base, group = sentence(rng, 250).split(), []
            for _ in range(9):
                w = list(base)
                for at in rng.sample(range(250), round(250 * share)):
                    w[at] = sentence(rng, 1)
                group.append(len(rows))
                rows.append((len(rows), " ".join(w)))
            groups.append((share, group))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(documents(spark, rows).repartition(6)).collect()}
    bag = bags(rows, exact=True)
    near = found = 0
    for share, group in groups:
        for i, j in itertools.combinations(group, 2):
            sim = jaccard(bag[i], bag[j])
            near += sim >= 0.8
            found += sim >= 0.8 and got[i] == got[j]
            if share >= 0.1:
                assert sim < 0.7 and got[i] != got[j]
    assert near > 100 and found >= 0.98 * near
    assert all(a == b or any(a in g and b in g for _, g in groups) for a, b in got.items())


def test_one_large_group_of_unlike_copies(spark):
    """Copies that are all near one another but under 0.8: every pair is looked at or ruled out, none is linked."""
    rng = random.Random(13)
    base = sentence(rng, 120).split()
    rows = []
    for i in range(700):
        w = list(base)
        for at in rng.sample(range(120), 4):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{t} and") for i, t in rows[:5]]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(documents(spark, rows).repartition(4)).collect()}
    bag = bags(rows)
    for i in range(5):
        assert got[1000 + i] == (got[i] if jaccard(bag[i], bag[700 + i]) >= 0.8 else 1000 + i)
    sample = rng.sample(range(700), 60)
    for i, j in itertools.combinations(sample, 2):
        assert (got[i] == got[j]) >= (jaccard(bag[i], bag[j]) >= 0.8)


def test_clashing_and_null_ids_stand_for_their_own_texts(spark):
    rng = random.Random(14)
    u, v, t, x = (sentence(rng, 60) for _ in range(4))
    rows = [(2, u), (None, u), (None, v), (None, v.upper()), (7, t), (7, x), (8, t + " more"), (9, x + " more"), (None, ""), (None, None), (7, t)]
    docs = documents(spark, rows).withColumn("__D1", F.lit(5))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, u), (None, min(v, v.upper())), (7, t), (7, x), (None, ""), (None, None)], key=str)
    sizes = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_dup.near_duplicate_classes(docs).where("doc_id > 6").collect()]
    assert collections.Counter(sizes) == collections.Counter({(7, 7, 3): 2, (7, 7, 2): 1, (8, 7, 3): 1, (9, 7, 2): 1})


def test_sampler_agrees_as_often_as_weights_do(monkeypatch):
    monkeypatch.setattr(near_dup, "ROWS", 1)
    monkeypatch.setattr(near_dup, "BANDS", 64)
    rng = np.random.default_rng(1)
    sampler, seen, want = near_dup.Sampler(), [], []
    for _ in range(40):
        shared, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (300, 80, 80))
        low, high = rng.integers(8, 16, 300), rng.integers(8, 16, 300)
        parts = [(np.concatenate([shared, x]), np.concatenate([v, rng.integers(8, 16, 80)])) for x, v in ((a, low), (b, high))]
        order = [np.argsort(h) for h, _ in parts]
        h, level = (np.concatenate([p[k][o] for p, o in zip(parts, order, strict=True)]) for k in (0, 1))
        bands = sampler.bands(h, np.repeat([0, 1], 380), level, 2)
        seen.append((bands[0] == bands[1]).mean())
        x, y = (dict(zip(p[0].tolist(), near_dup.WEIGHTS[p[1]].tolist(), strict=True)) for p in parts)
        want.append(jaccard(x, y))
        assert (sampler.bands(h[:380], np.zeros(380, np.int64), level[:380], 1) == bands[:1]).all()
    assert abs(np.mean(seen) - np.mean(want)) < 0.03


# op7


def brute_kernel(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), toxicity.LENGTH):
        for b in itertools.combinations(range(len(t)), toxicity.LENGTH):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_brute_force():
    for s, t in ((b"idxiot", b"idiot"), (b"toidi", b"idiot"), (b"aabbaa", b"aba"), (b"abc", b"xyz")):
        got = toxicity.subsequence_kernel(np.frombuffer(s, np.uint8)[None, :], np.frombuffer(t, np.uint8))[0]
        assert got == pytest.approx(brute_kernel(s, t), rel=1e-5, abs=1e-6)


def brute_scores(model, texts):
    """Scores word by word from the kernel's definition, with words taken by a regular expression."""
    out = []
    own = [brute_kernel(z, z) for z in model.landmarks]
    for text in texts:
        raw = re.split(r"[\x20\x09-\x0D]+", text or "")
        words = [w for w in ("".join(words_of(x)) for x in raw) if w]
        run = []
        for w in [*words, "##"]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 3:
                words.append("".join(run))
            run = []
        x = np.zeros(len(model.landmarks))
        for w in words:
            coded = bytes([toxicity.START]) + w.encode()
            for at in range(max(1, len(coded) - toxicity.REACH + 1)):
                part = coded[at : at + toxicity.REACH]
                x = np.maximum(x, [min(1.0, brute_kernel(part, z) / k) ** toxicity.POWER for z, k in zip(model.landmarks, own, strict=True)])
        margin = x @ model.nystroem @ model.weights + model.bias
        out.append(1 / (1 + math.exp(-min(40, max(-40, model.curve[0] * margin + model.curve[1])))))
    return out


def test_scores_equal_brute_force(insults):
    model = toxicity.fit([t for _, t, _ in insults], np.array([y for _, _, y in insults]))
    model.landmarks = [z[:8] for z in model.landmarks]  # brute force is slow
    texts = ["", None, "a b", "zwonker", "a z w o n k e r b", "Z-wonk-er, z.x.w.o.n.k", "é à ü zwonké plufty", "plu fty plufty abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyzabcdzwonkerq", "б о л г x plufyty"]
    assert model.scores(*flat(pa.array(texts))).tolist() == pytest.approx(brute_scores(model, texts), rel=1e-4, abs=1e-6)


def test_landmarks_are_found_at_any_place_of_a_long_word():
    mark = b"abcdefghijklmnop"
    spots = [("q" * 1 * k + mark.decode() + "r" * (60 - k)) for k in range(60)]
    near = toxicity.similarities(pa.array([s.encode() for s in spots], pa.large_binary()), [mark])[:, 0]
    assert near.min() == pytest.approx(1.0)
    spread = toxicity.similarities(pa.array([b"zqwqoqnqkqeqr" + b"y" * n for n in (0, 8, 30, 5000)], pa.large_binary()), [b"zwonker"])[:, 0]
    assert spread.max() - spread.min() < 1e-6 and spread.min() > 0


def test_units():
    words, row = toxicity.units(*flat(pa.array(["You are an I-D.i.o.t!", None, "a b c dd", "", "x y", " . ", "é à ü", "p a t h é"])))
    got = collections.defaultdict(list)
    for w, r in zip(words.to_pylist(), row.tolist(), strict=True):
        got[r].append(w.decode())
    assert got == {0: ["you", "are", "an", "idiot"], 2: ["a", "b", "c", "dd", "abc"], 4: ["x", "y"], 6: ["é", "à", "ü", "éàü"], 7: ["p", "a", "t", "h", "é", "pathé"]}


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        w = sentence(rng, 60).split()
        if bad := i % 4 == 0:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(60)] = rng.choice(["zwonker", "plufty" + sentence(rng, 1)])
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_held_out_accuracy(spark, insults):
    docs = documents(spark, [(i, t) for i, t, _ in insults] + [(900, None), (901, ""), (None, "zwonker"), (902, "zwonker zwonker " + "x" * 200_000)]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in insults] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 404
    truth = {i: y for i, _, y in insults}
    seen = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in seen) >= 0.97 * len(seen)
    by = {r["doc_id"]: r for r in rows}
    assert by[900]["score"] < 0.5 and by[901]["score"] < 0.5 and by[902]["predicted"] == 1 and by[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gapped_insults(insults):
    model = toxicity.fit([t for _, t, _ in insults], np.array([y for _, _, y in insults]))
    plain, dotted, spaced, padded, clean = model.scores(*flat(pa.array(["a zwonker b", "z.w-o.n.k.e.r", "q z w o n k e r q", "a zwoxnker b", "some thing else"])))
    assert min(plain, dotted) >= 0.7 and spaced > clean and padded > clean


def test_columns_that_clash_and_repeated_ids(spark, insults):
    docs = documents(spark, [(i, t) for i, t, _ in insults] + [(0, "another text"), (None, None)]).withColumns({"Toxicity_Score": F.lit(1), "__score": F.lit(2)})
    labels = spark.createDataFrame([(i, y) for i, _, y in insults], "doc_id bigint, toxic int")
    kept = toxicity.keep_mild(docs, labels)
    assert kept.columns == docs.columns
    truth = {i: y for i, _, y in insults}
    rows = kept.collect()
    assert any(r["doc_id"] is None for r in rows) and sum(truth.get(r["doc_id"], 0) for r in rows) < 10
    first, again = (toxicity.train(docs.repartition(n), labels) for n in (2, 7))
    assert first.landmarks == again.landmarks and first.bias == pytest.approx(again.bias)


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    assert toxicity.fit(["a", "b"], np.array([1, 1])).prior == 1.0


# pipeline


def test_pipeline_equals_its_operators(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    stage = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}

    mild = stage["toxicity"](spark, docs, SMALL)
    assert mild.columns == docs.columns
    bad = {r["doc_id"] for r in queries.op7_toxicity(spark, SMALL).collect() if r["predicted"]}
    assert {r["doc_id"] for r in mild.collect()} == set(rows) - bad

    single = stage["near_duplicates"](spark, mild, SMALL)
    classes = brute_classes([(r["doc_id"], r["text"]) for r in mild.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c in classes.items() if i == c)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = stage["decontamination"](spark, single, SMALL)
    assert clean.columns == docs.columns
    windows = {tuple(w[p : p + 13]) for _, t in items for w in [words_of(t)] for p in range(max(1, len(w) - 12))}

    def contaminated(text):
        w, hit = words_of(text), set()
        for p in range(len(w)):
            hit.update(range(p, p + 13) if tuple(w[p : p + 13]) in windows else ())
        return bool(hit)  # every item has 13 words at least

    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not contaminated(r["text"])}

    mixed = stage["mixing"](spark, clean, SMALL)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    assert max(collections.Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    out = stage["token_files"](spark, mixed, SMALL).collect()
    want = collections.Counter()
    for r in mixed.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    again = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_scratch_is_in_the_cluster_s_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (before.rstrip("/") if before else shared_dir(spark))
