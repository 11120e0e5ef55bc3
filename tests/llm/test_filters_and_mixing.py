"""URL filters, mixing, quality rules and chat formatting."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tracelode.llm import chat_format, mixing, quality, queries, url_filter

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(spark, queries.queries()[name], queries.oracle_sql()[name])


# op1


def test_url_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x", "x://a.com/en/", "x://com/en/1", "x://acom/en/", "x://a.net/de/9#f", "x://example.net/de/80", "x://a.org?/es/", "x://É.org/es/", "x://a.com/EN/"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(4, urls[4], "old")], "page_id int, url string, rule string")
    rows = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block") and got[6][2:] == ("com/en/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("net/de/", "allow") and got[9][2:] == ("example.net/de/8", "block")
    assert got[10] == ("a.org", "", None, "allow") and got[11][2:] == ("org/es/", "block") and got[12][2:] == (None, "allow")
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)] + [(None,)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    cascade = url_filter.build_cascade(listed, universe, rate=0.3)
    assert len(cascade.levels) > 2
    h1, h2 = url_filter._hashes(F.col("key"))
    rows = universe.select("key", h1.alias("a"), h2.alias("b")).collect()
    member = cascade.member(*(np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in ("a", "b")))
    assert [bool(m) for m in member] == [int(r["key"][1:]) % 3 == 0 for r in rows]
    assert url_filter.build_cascade(listed.limit(0), universe).levels == []
    with pytest.raises(url_filter.TooLarge):
        url_filter.build_cascade(listed, universe, most_bytes=8)


def test_rules_of_any_number_of_shapes(spark):
    # 121 shapes: one more than two groups.
    rules = [url_filter.Rule("block" if i % 3 else "allow", ["a.com", "b.a.com"][i % 2], "/" + "x" * i) for i in range(121)]
    urls = [f"http://{h}/{'x' * i}{t}" for h in ("a.com", "b.a.com", "c.b.a.com", "other.org") for i in (0, 1, 2, 59, 60, 61, 62, 119, 120, 130) for t in ("", "y")]
    got = {r["url"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()}
    assert len({r.shape for r in rules}) == 121 and len(got) == len(urls)
    # The same from a table of rules, and by the join that takes over where filters would be too large to send.
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in rules] + [("block", None, "/"), ("block", "a.com", "x")], "action string, host string, path string")
    pages = spark.createDataFrame([(u, 1, 2) for u in urls + urls[:3]], "url string, HOST int, __k0 int")
    for most in (64 << 20, 8):
        judged = url_filter.judge_urls(pages, table, most_bytes=most)
        assert sorted(judged.columns) == ["__k0", "host", "path", "rule", "url", "verdict"]
        rows = judged.collect()
        assert len(rows) == len(urls) + 3 and {r["url"]: (r["rule"], r["verdict"]) for r in rows} == got
    for u in urls:
        host, _, path = u[7:].partition("/")
        fits = [r for r in rules if f".{host}".endswith(f".{r.host}") and f"/{path}".startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.key), r.shape[0]), default=None)
        assert got[u] == ((best.key, best.action) if best else (None, "allow"))


# op2


def test_mix_edge_cases(spark):
    rows = [(1, "a", "x y z", 9), (1, "a", "x y z", 9), (2, None, "a " * 400, 9), (3, "b", None, 9), (4, "b", "", 9), (None, "c", "q " * 50, 9), (5, "c", "r " * 60, 9)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, taken int")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in plan)
    assert {r["size"] for r in plan if r["doc_id"] in (3, 4)} == {0}
    total = {}
    for r in plan:
        total[r["source_size"], r["target"]] = total.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert sum(t for _, t in total) == pytest.approx(516)
    assert all(t <= 3 * s + 1e-9 for s, t in total)
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mix_rows(docs.limit(0)).count() == 0


def test_mix_comes_near_targets(spark):
    random.seed(1)
    rows = [(i, random.choice("aaaabcd"), "w " * random.randrange(1, 40)) for i in range(900)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id int, source string, text string")).join(spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id int, source string"), "doc_id")
    for r in plan.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 20


# op5


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python(spark):
    random.seed(3)
    texts = [None, "", " \n\t ", "a", "a b", "a b c a b c a b", "x\nx\n\nx \n", "é ü\u00a0ö \x0b#|<", "word " * 20000, "a" * 100_000]
    texts += [" ".join(random.choice(["the", "of", "a", "b#", "c\n"]) for _ in range(random.randrange(120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string, words int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.text_counts(docs).collect():
        assert tuple(r[n] for n in names) == plain_counts(texts[r["doc_id"]]), texts[r["doc_id"]]


def concentrate(z, m, cov):
    """Concentration steps from an estimate until the determinant stops falling: mean, covariance, its determinant's logarithm."""
    floors, best = np.diag(np.square(quality.FLOORS)), math.inf
    while True:
        far = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(cov), z - m)
        inner = z[far <= np.sort(far)[math.ceil(quality.SUPPORT * len(far)) - 1]]
        new = inner.mean(axis=0), np.cov(inner.T, bias=True) * quality.CONSISTENCY + floors
        det = np.linalg.slogdet(new[1])[1]
        if best - det <= quality.GAIN:
            return m, cov, best
        (m, cov), best = new, det


def brute_mcd(z, seed, tries=300):
    """The least determinant from many random starts of five rows each."""
    rng, floors = np.random.default_rng(seed), np.diag(np.square(quality.FLOORS))
    found = []
    for _ in range(tries):
        some = z[rng.choice(len(z), 5, replace=False)]
        found.append(concentrate(z, some.mean(axis=0), np.cov(some.T, bias=True) + floors))
    return min(found, key=lambda f: f[2])


def prose(rng, n=80, tail=""):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + tail for _ in range(n))


def test_estimates_come_near_the_least_determinant(spark):
    """The logarithm of the determinant is within 0.05 of the least of 300 random starts, in one cloud, in two, and with
    outliers. It was 0.03 above in one cloud when this was written: the steps end in local minima, as they do from any start."""
    rng = np.random.default_rng(5)
    cloud = lambda n, at, wide: rng.normal(at, wide, (n, 4))
    groups = {"one": cloud(120, 0, 1), "two": np.vstack([cloud(90, 0, 0.3), cloud(40, 4, 0.3)]), "wild": np.vstack([cloud(100, 1, 0.5), cloud(30, 0, 9)]), "few": cloud(6, 0, 1)}
    rows = [(g, *map(float, v)) for g, z in groups.items() for v in z] + [("four", 0.0, 0.0, 0.0, 0.0)] * 4
    out = {r["grp"]: r for r in quality.estimates(spark.createDataFrame(rows, "grp string, z0 double, z1 double, z2 double, z3 double")).collect()}
    assert set(out) == set(groups)
    for g, z in groups.items():
        m, cov, det = brute_mcd(z, 6)
        assert out[g]["log_det"] <= det + 0.05
        assert out[g]["log_det"] == pytest.approx(np.linalg.slogdet(np.array([[out[g][f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]))[1], rel=1e-6)
        if g in ("two", "wild"):
            assert np.abs(m - [out[g][f"m{i}"] for i in range(4)]).max() < 0.1


def test_outliers_of_groups_of_any_size(spark):
    """A text of symbols is an outlier among 5 rows as among 51; four rows have no estimate."""
    rng, rows = random.Random(4), []
    for size in (4, 5, 6, 49, 50, 51, 160):
        for i in range(size):
            rows.append((len(rows), prose(rng, tail="%%%%%%" if i == 1 else ""), "en" if size % 2 else None, f"s{size}"))
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    out = quality.outlier_flags(quality.text_counts(docs)).collect()
    assert all((r["distance"] is None) == (r["source"] == "s4") for r in out)
    gone = {r["source"] for r in out if not r["kept"]}
    assert gone == {"s5", "s6", "s49", "s50", "s51", "s160"} and sum(not r["kept"] for r in out) == 6
    stats = {r["doc_id"]: [r[z] for z in quality.STATS] for r in quality.statistics(quality.text_counts(docs)).collect()}
    for s in ("s49", "s50", "s51", "s160"):
        mine = [r for r in out if r["source"] == s]
        z = np.array([stats[r["doc_id"]] for r in mine])
        m, cov, _ = brute_mcd(z, 7, 60)
        far = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(cov), z - m)
        assert [r["distance"] > quality.CUTOFF for r in mine] == [f > quality.CUTOFF for f in far]


def test_rounds_take_moving_groups_only_and_distances_are_products(spark, monkeypatch):
    """A group that has settled is left out of later rounds, and no row of the data takes a root for its distance."""
    rng, sizes, write = np.random.default_rng(8), [], quality.cut

    def spy(df, label):
        out = write(df, label)
        if label == "quality-edge":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(quality, "cut", spy)
    z = {"same": np.ones((40, 4)), "wide": np.vstack([rng.normal(0, 1, (200, 4)), rng.normal(3, 2, (60, 4))])}
    rows = [(g, *map(float, v)) for g, x in z.items() for v in x]
    out = {r["grp"]: r for r in quality.estimates(spark.createDataFrame(rows, "grp string, z0 double, z1 double, z2 double, z3 double")).collect()}
    assert sizes[0] == 6 and len(sizes) > 3 and sizes == sorted(sizes, reverse=True) and sizes[-1] < 4
    for g in z:
        cov = np.array([[out[g][f"c{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        w = np.array([[out[g][f"w{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose(w, np.linalg.inv(np.linalg.cholesky(cov)))
    empty = spark.createDataFrame([], "doc_id int, text string, lang string, source string")
    plan = quality.outlier_flags(quality.text_counts(empty))._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" not in plan.upper()


def test_small_groups_and_empty_tables_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "%% " * 60 + "a b c", "en", "s"), (2, None, None, None)], "doc_id int, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in quality.outlier_flags(quality.text_counts(docs)).collect()}
    assert rows[1]["base_failed"] and not rows[1]["kept"] and rows[2]["base_failed"]
    assert quality.outlier_flags(quality.text_counts(docs.limit(0))).count() == 0


def test_native_plans_hold_no_python(spark):
    for name in ("op5_quality_rules", "op8_chat_format"):
        plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# op8


def test_chat_round_trip_and_validation(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\0 <\\1 \\", "<", "|x<|", "\n\n", "", None, "é😀", "<<||>>", "\\\\<|\\2"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t, 0) for i, t in enumerate(nasty)]
    turns += [(2, 0, "assistant", "x", 0), (3, 0, "user", "q", 0), (3, 1, "user", "q", 0), (4, 0, "system", "s", 0), (4, 1, "user", "u", 0), (4, 2, "assistant", "a", 0), (None, 0, None, None, 0), (5, None, "odd\nrole\\2<|", "t", 0)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string, seq int")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.assemble(chat_format.format_segments(df))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, t or "") for _, _, r, t, _ in turns[:10]]
    assert back[1]["loss_text"] == "".join(t or "" for t in nasty[1::2])
    assert [(t["role"], t["text"]) for t in back[5]["turns"]] == [("odd\nrole\\2<|", "t")]
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("", "")]
    told = {r["conv_id"]: (r["n_turns"], r["first_bad"], r["valid"]) for r in chat_format.validate(df).collect()}
    assert told[1] == (10, None, True) and told[4] == (3, None, True)
    assert told[2] == (1, 0, False) and told[3] == (2, 1, False) and told[None][2] is False
    assert chat_format.validate(df.limit(0)).count() == 0
    first = hashlib.sha256("user\nq\nuser\nq\n".encode()).hexdigest()
    shown = back[3]["turns"]
    assert hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in shown).encode()).hexdigest() == first


TEMPLATES = [
    chat_format.TEMPLATE, chat_format.ChatTemplate(open="[INST]", close="[/INST]"), chat_format.ChatTemplate(open="\\u", close="\\e^"), chat_format.ChatTemplate(open="#", close="$"),
    chat_format.ChatTemplate(open="<s>", close="</s>", loss=("user",), follows={"(start)": ("user",), "user": ("user", "assistant"), "assistant": ("user",)}, final=("user",)),
]


@pytest.mark.parametrize("template", TEMPLATES, ids=lambda t: t.open)
def test_chat_round_trip_of_any_template(spark, template):
    rng = random.Random(3)
    bits = [template.open, template.close, template.open[:1], template.open[:2], template.close[1:], "\\", "\\0", "\x1b", "1", "\n", "^", "é😀", "word ", "[", "<", "$E", "\\E"]
    rows = [(c, i, rng.choice(["user", "assistant", "odd\n" + template.open]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for c in range(60) for i in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    segments = chat_format.format_segments(df, template)
    whole = chat_format.assemble(segments)
    back = {r["conv_id"]: r for r in chat_format.read_back(whole, template).collect()}
    for c in range(60):
        mine = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [r[2:] for r in mine]
        assert back[c]["loss_text"] == "".join(t for _, _, role, t in mine if role in template.loss)
        states = [template.start, *[r[2] for r in mine]]
        assert back[c]["order_ok"] == all(b in template.follows.get(a, ()) for a, b in zip(states, states[1:]))


def test_chat_templates_that_can_not_be_read_back_are_refused():
    for o, c in (("", "x"), ("a\nb", "c"), ("ab", "xabx"), ("aab", "ab"), ("<", "</x>")):
        with pytest.raises(ValueError):
            chat_format.ChatTemplate(open=o, close=c)


def test_long_conversations_and_repeated_rows(spark):
    n = 3000
    long = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<|"), F.col("id").cast("string")).alias("text"))
    again = spark.createDataFrame([(2, 5, "user", "same")] * 3, "conv_id int, turn bigint, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.assemble(chat_format.format_segments(long.unionByName(again)))).collect()}
    assert [t["text"] for t in back[1]["turns"]] == [f"<|{i}" for i in range(n)] and back[1]["order_ok"]
    assert back[1]["loss_text"] == "".join(f"<|{i}" for i in range(1, n, 2))
    assert [t["text"] for t in back[2]["turns"]] == ["same"] * 3 and not back[2]["order_ok"]
