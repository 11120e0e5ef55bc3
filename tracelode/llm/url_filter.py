"""URL rules by Bloom filter cascades.

A cascade answers "is this key listed?" exactly for every key of a known
universe. Level 0 encodes the listed keys, level 1 the universe keys that level
0 lets through wrongly, level 2 the listed keys that level 1 catches wrongly,
and so on until nothing is wrong. A lookup walks the levels until one says no.
Building passes over the universe are distributed; only filters whose size is
checked reach the driver and the tasks, and a lookup needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free_name, free_prefix, others, quoted
from .scratch import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Shapes looked up in one step of the plan; further ones take further steps.
_MAX_SHAPES = 60


class TooLarge(ValueError):
    """A filter level is larger than what may be sent to every task."""


@dataclass(frozen=True)
class Rule:
    """``action`` ('allow' or 'block') for a host with all subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    first: int = 0  # number of the level's first hash: no two levels share one

    def hit(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for i in range(self.hashes):
            at = ((h1 >> np.uint64(20)) + np.uint64(self.first + i) * (h2 >> np.uint64(20))) % np.uint64(self.size)
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


@dataclass
class Cascade:
    levels: list[Level]

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe that the cascade was built over."""
        verdict = np.zeros(len(h1), bool)
        open_ = np.ones(len(h1), bool)
        for i, level in enumerate(self.levels):
            open_ &= level.hit(h1, h2)
            verdict = np.where(open_, i % 2 == 0, verdict)
        return verdict

    @property
    def n_bytes(self) -> int:
        return sum(x.bits.nbytes for x in self.levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _UPPER.lower()), path


def _shape_key(host: Column, path: Column, shape: tuple[int, int]) -> Column:
    """The key that a rule of this shape would have for the url, else null."""
    labels, chars = shape
    n_labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.when((n_labels >= labels) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key).bitwiseOR(F.lit(1))


def _probe(levels: list[Level], want_open: bool):
    """Column function: do all levels let the key pass (``want_open``), or is it a member?"""

    @F.pandas_udf("boolean")
    def probe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(np.int64).view(np.uint64), h2.to_numpy(np.int64).view(np.uint64)
        if not want_open:
            return pd.Series(Cascade(levels).member(a, b))
        out = np.ones(len(a), bool)
        for level in levels:
            out &= level.hit(a, b)
        return pd.Series(out)

    return probe


def _encode(keys: DataFrame, n: int, rate: float, most_bytes: int, number: int = 0) -> Level:
    """Bloom filter of the (h1, h2) rows, its words or-ed together on the cluster."""
    size = max(1024, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    # Odd and different from level to level, so that keys that agree modulo one size don't modulo the next.
    size = -(-size // 64) * 64 - 1 - 2 * number
    if size // 8 > most_bytes:
        raise TooLarge(f"a level of {size // 8} bytes is over the bound of {most_bytes}")
    hashes = max(1, round(size / max(n, 1) * math.log(2)))
    hashes = min(hashes, 16)
    first = 16 * number
    at = [(F.shiftrightunsigned("h1", 20) + F.lit(first + i) * F.shiftrightunsigned("h2", 20)) % F.lit(size) for i in range(hashes)]
    bit = keys.select(F.explode(F.array(*at)).alias("at"))
    words = bit.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(size // 64 + 1, np.int64)
    for row in words.toLocalIterator():
        out[row["word"]] = row["bits"]
    return Level(out.view(np.uint64), size, hashes, first)


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.01, most_bytes: int = 64 << 20) -> Cascade:
    """Cascade for the distinct ``key`` strings in ``listed`` against those in ``universe``.

    Null keys are ignored. An empty list gives a cascade without levels, which
    holds nothing. ``most_bytes`` bounds one level; a larger one raises
    ``TooLarge``, as levels are sent to every task. There are as many levels as it
    takes: each keeps a part of the keys before it, and two keys that share both
    64-bit hashes, which no level could tell apart, raise an error.
    """
    def hashed(df: DataFrame) -> DataFrame:
        h1, h2 = _hashes(F.col("key"))
        return df.where(F.col("key").isNotNull()).select("key", h1.alias("h1"), h2.alias("h2"))

    inside = cut(hashed(listed.select("key").distinct()), "cascade-listed")
    n = inside.count()
    levels: list[Level] = []
    if n == 0:
        return Cascade(levels)
    levels.append(_encode(inside, n, rate, most_bytes))
    wrong = hashed(universe.select("key")).where(_probe(levels, True)("h1", "h2")).distinct().join(inside.select("key"), "key", "left_anti")
    outside = cut(wrong, "cascade-outside")
    turn, (now, other) = 1, (outside, inside)
    clash = inside.select("h1", "h2").join(outside.select("h1", "h2"), ["h1", "h2"], "left_semi")
    if not clash.isEmpty():
        raise ValueError("two keys of the list and the universe share both hashes")
    while n := now.count():
        levels.append(_encode(now, n, 0.5 if turn > 1 else rate, most_bytes, turn))
        caught = cut(other.where(_probe(levels[-1:], True)("h1", "h2")), "cascade-caught")
        now, other, turn = caught, now, turn + 1
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow", url: str = "url", rate: float = 0.01, most_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    A rule fits its host and all subdomains when the path starts with the
    rule's; the longest fitting rule wins (of equally long ones, the longer
    host); without one the rule is null and the verdict is ``default``: no
    listed key covers the url. Rules are found by exact membership of the url's
    suffix-and-prefix keys in a cascade built over all such keys of ``pages``.

    Null urls and urls without ``://`` have an empty host and path. Repeated rows
    each get a verdict; other columns pass through, but for existing columns
    with the four names in upper or lower case, which are replaced. No rules: all
    rows get ``default``. Rules may have any number of shapes, and be a list or a
    table ``action, host, path`` of any length; equal host and path count once,
    by the least action. A list whose levels would be over ``most_bytes`` is
    looked up by an exact join instead, as levels of that size are not sent.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.action, r.host, r.path) for r in rules], "action string, host string, path string")
    # Paths of urls are empty or start with a slash; rules of another kind fit none of them.
    table = rules.where("action is not null and (path = '' or path like '/%') and not host rlike '[/?#]'")
    table = table.select(F.concat("host", "path").alias("key"), "action", (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("chars"))
    # Shapes are far fewer than rules: numbers of labels times lengths of paths.
    shapes = sorted((r["labels"], r["chars"]) for r in table.select("labels", "chars").distinct().toLocalIterator())
    listed = table.groupBy("key").agg(F.min("action").alias("action"))
    host, path = url_parts(F.col(url))
    kept = others(pages, ("host", "path", "rule", "verdict"))
    pre = free_prefix(pages, "__")
    best_name = f"{pre}best"
    parts = pages.select(*quoted(kept), host.alias("host"), path.alias("path"))
    if not shapes:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = [_shape_key(F.col("host"), F.col("path"), s) for s in shapes]
    universe = parts.select(F.explode(F.array(*keys)).alias("key"))
    try:
        member = build_cascade(listed, universe, rate, most_bytes)
        blocks = build_cascade(listed.where("action = 'block'"), listed, rate, most_bytes)
    except TooLarge:
        return _judge_by_join(parts, kept, keys, shapes, listed, default)

    is_member, is_block = _probe(member.levels, False), _probe(blocks.levels, False)
    hit, best = parts, None
    for at in range(0, len(shapes), _MAX_SHAPES):
        group = list(enumerate(shapes))[at : at + _MAX_SHAPES]
        named = hit.select("*", *[keys[i].alias(f"{pre}k{i}") for i, _ in group])
        found = named.select("*", *[F.when(F.col(f"{pre}k{i}").isNotNull() & is_member(*_safe(F.col(f"{pre}k{i}"))), F.struct(F.length(f"{pre}k{i}").alias("n"), F.lit(s[0]).alias("labels"), F.col(f"{pre}k{i}").alias("key"))).alias(f"{pre}s{i}") for i, s in group])
        options = [*([] if best is None else [best]), *[F.col(f"{pre}s{i}") for i, _ in group]]
        best = F.col(best_name)
        hit = found.select(*quoted(kept), "host", "path", (options[0] if len(options) == 1 else F.greatest(*options)).alias(best_name))
    out = hit.select(*quoted(kept), "host", "path", best["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(is_block(*_safe(F.col("rule"))), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("*", verdict.alias("verdict"))


def _judge_by_join(parts: DataFrame, kept: list[str], keys: list[Column], shapes: list[tuple[int, int]], listed: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join of each distinct host and path's keys with the list, for lists too large to send."""
    n, at = F.length("key").alias("n"), ("host", "path")
    spread = F.array(*[F.struct(k.alias("key"), F.lit(s[0]).alias("labels")) for k, s in zip(keys, shapes, strict=True)])
    asked = parts.select(*at).distinct().withColumn("o", F.explode(spread)).select(*at, "o.key", "o.labels").where("key is not null")
    found = asked.join(listed, "key").groupBy(*at).agg(F.max(F.struct(n, "labels", "key", "action")).alias("r"))
    h, p = (free_name(parts, x) for x in ("__h", "__p"))
    found = found.select(F.col("host").alias(h), F.col("path").alias(p), F.col("r.key").alias("rule"), F.when(F.col("r.action") == "block", "block").otherwise("allow").alias("verdict"))
    out = parts.join(found, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return out.select(*quoted(kept), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _safe(key: Column) -> tuple[Column, Column]:
    return _hashes(F.coalesce(key, F.lit("")))
