"""URL filtering by suffix rules and an exact Bloom filter cascade, in DataFrame functions only.

The cascade knows the whole key universe. Level 0 holds the listed keys; level 1 the unlisted keys that
level 0 lets through; level 2 the listed keys that level 1 lets through; and so on until nothing is let
through wrongly. Walking the levels gives exact membership for every key of the universe. A level is
one array of 64-bit words that every task reads as a value, so rows are judged without any join. A
larger universe is dealt by hash to several cascades, each with its own pass over the rows, so that all
keys of one, listed or not, would fit a level of MAX_BITS (as evenly as the hash deals them).
"""
from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage

HASHES = 4
BITS_PER_KEY = 6
MAX_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no `://`."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Cascade:
    """The levels of one cascade; `contains` is a column expression."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int]] = []

    def _passes(self, key: Column, level: int) -> Column:
        table, bits = self.levels[level]
        words = table.select("words").scalar()
        hits = []
        for j in range(HASHES):
            at = _place(key, level, j, bits)
            hits.append(F.call_function("shiftright", F.element_at(words, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return functools.reduce(lambda a, b: a & b, hits)

    def reaches(self, key: Column) -> Column:
        """Whether every level lets the key through."""
        return functools.reduce(lambda a, b: a & b, [self._passes(key, i) for i in range(len(self.levels))], F.lit(True))

    def contains(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, i), out).otherwise(F.lit(i % 2 == 1))
        return out


def _place(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits).cast("long"))


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the level's words in order. At most MAX_BITS / 64 numbers meet in one group."""
    spark, n_words = keys.sparkSession, bits // 64
    at = F.explode(F.array(*[_place(F.col("key"), level, j, bits) for j in range(HASHES)])).alias("at")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    marks = keys.select(at).select(F.shiftright("at", 6).alias("word"), bit.alias("bits"))
    blank = spark.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marks.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return cut_lineage(words.agg(F.transform(ordered, lambda w: w["bits"]).alias("words")))


def build_cascade(universe: DataFrame) -> Cascade:
    """The cascade of a table (key, listed) with distinct keys that are not null."""
    cascade = Cascade()
    while True:
        i = len(cascade.levels)
        keys = universe.filter(F.col("listed") == F.lit(i % 2 == 0)).filter(cascade.reaches(F.col("key"))).select("key")
        n = keys.count()
        if not n:
            return cascade
        bits = max(64, math.ceil(n * BITS_PER_KEY / 64) * 64)
        cascade.levels.append((_level(keys, i, bits), bits))


def mark_listed(rows: DataFrame, key: str, listed: DataFrame, out: str = "listed", max_bits: int = MAX_BITS) -> DataFrame:
    """rows with `out`: whether the row's key is among listed.key; exact, and no join of the rows.

    The universe is every distinct key of rows; listed keys outside it do not matter. Null keys (on
    either side) count as the empty string; repeated keys and rows do no harm; no rows give no rows,
    and an empty list marks nothing. Other columns pass through.
    """
    keys = rows.select(F.coalesce(F.col(key), F.lit("")).alias("key"), F.lit(False).alias("listed"))
    named = listed.select(F.coalesce(F.col("key"), F.lit("")).alias("key"), F.lit(True).alias("listed"))
    both = keys.unionByName(named).groupBy("key").agg(F.max("listed").alias("listed"), F.min("listed").alias("outside"))
    universe = cut_lineage(both.filter(~F.col("outside")).select("key", "listed"))
    parts = max(1, math.ceil(universe.count() * BITS_PER_KEY / max_bits))
    probe = F.coalesce(F.col(key), F.lit(""))

    def part_of(k: Column) -> Column:
        return F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts))

    marked = []
    for p in range(parts):
        cascade = build_cascade(universe.filter(part_of(F.col("key")) == p) if parts > 1 else universe)
        marked.append((rows.filter(part_of(probe) == p) if parts > 1 else rows).withColumn(out, cascade.contains(probe)))
    return functools.reduce(DataFrame.unionByName, marked)


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages: the longest rule's verdict, else
    block where the page's key is listed (listed.key), else allow. The key is the host, or what `by`
    names (`host`, `path`) put together."""
    host, path = host_and_path()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    marked = mark_listed(split.withColumn("key", F.concat(*by)), "key", listed)
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
