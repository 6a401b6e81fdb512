"""Many phrases looked for at once in many texts, by Aho-Corasick automata.

Phrases go into groups of bounded size, each an automaton inside a task, and a text is read once for
a group: its grams are never rows. A list that fits one group is sent to the tasks whole and texts stay
where they are. Beyond that, groups and texts meet by a shuffle, each task seeing the phrases of its
group first and then a stream of texts.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship

ANCHOR, LONG = 8, 32  # characters of an anchor, and of the least text in which one is chosen
GROUP_CHARS = 1_000_000  # of phrases in one automaton
HIT = "__phrase"
_STEP = 1024
_LAST: dict[int, object] = {}  # the automaton of the last list sent to this worker


def automaton(phrases: list[str]):
    """An automaton that yields the number of each phrase at each of its places."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        a.add_word(p, i)
    a.make_automaton()
    return a


def _hits(b: pa.RecordBatch | pa.Table, text: int, find, phrases: list[str]) -> tuple[pa.Array, pa.Array]:
    """Row numbers and phrases of a batch, each pair once."""
    rows, found = [], []
    for i, t in enumerate(b.column(text).to_pylist()):
        if t:
            own = {n for _, n in find.iter(t)}
            rows += [i] * len(own)
            found += own
    return pa.array(rows, pa.int64()), pa.array([phrases[n] for n in found], pa.string())


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _STEP):
            yield b.slice(at, _STEP)


def _schema(rows: DataFrame) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"`{HIT}` string"])


def _sent(rows: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """The list fits one group: it is broadcast and the texts are scanned where they are."""
    listed = rows.sparkSession.sparkContext.broadcast([r[HIT] for r in phrases.collect()])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = listed) -> Iterator[pa.RecordBatch]:
        key, words = id(sent.value), sent.value
        if not words:
            return
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = automaton(words), words  # holds the list, so that its id is not used again
        find = _LAST[key][0]
        for b in _steps(batches):
            of, found = _hits(b, at, find, words)
            if len(of):
                yield pa.RecordBatch.from_arrays([*b.take(of).columns, found], [*b.schema.names, HIT])

    return rows.mapInArrow(run, _schema(rows))


def _dealt(rows: DataFrame, text: str, phrases: DataFrame, groups: int) -> DataFrame:
    """Groups of phrases and all texts, dealt by group and part; phrases come first in each part."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shape = [f"CAST(NULL AS {t}) AS `{n}`" for n, t in rows.dtypes]
    lists = phrases.select(F.pmod(F.xxhash64(HIT), F.lit(groups)).cast("int").alias("__g"), every(parts).alias("__part"), F.lit(0).alias("__kind"), HIT, *map(F.expr, shape))
    texts = rows.select(every(groups).alias("__g"), "*").select(
        "__g", F.pmod(F.xxhash64(text), F.lit(parts)).cast("int").alias("__part"), F.lit(1).alias("__kind"), F.lit(None).cast("string").alias(HIT), *[F.col(f"`{n}`") for n in rows.columns])
    n_text = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, find = None, [], None
        for b in _steps(batches):
            part, kind = (list(zip(*(b.column(i).to_pylist() for i in (0, 1)))), b.column(2).to_pylist())
            at = 0
            while at < b.num_rows:
                end = at + 1
                while end < b.num_rows and part[end] == part[at] and kind[end] == kind[at]:
                    end += 1
                if part[at] != key:
                    key, words, find = part[at], [], None
                piece = b.slice(at, end - at)
                if kind[at] == 0:
                    words += piece.column(3).to_pylist()
                elif words:
                    find = find or automaton(words)
                    own = piece.select(rows_at)
                    of, found = _hits(own, n_text, find, words)
                    if len(of):
                        yield pa.RecordBatch.from_arrays([*own.take(of).columns, found], [*own.schema.names, HIT])
                at = end

    rows_at = list(range(4, 4 + len(rows.columns)))
    dealt = lists.union(texts).repartition("__g", "__part").sortWithinPartitions("__g", "__part", "__kind")
    return dealt.mapInArrow(run, _schema(rows))


def anchors(text: str) -> np.ndarray:
    """Hashes of the text's anchors: in every LONG characters the gram of the least hash. Whatever holds a
    text has the text's anchors; a text below LONG characters has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < LONG:
        return np.zeros(0, np.int64)
    code = np.zeros(len(points) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(code)] + np.uint64(1)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    least = code
    width, step = LONG - ANCHOR + 1, 1  # of windows in grams; minima of 1, 2, 4, ... grams
    while 2 * step <= width:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    rest = width - step
    return np.unique(np.minimum(least[: len(least) - rest], least[rest:])).view(np.int64)


def _anchored(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, __anchor) for every different anchor of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            found = [anchors(t or "") for t in b.column(1).to_pylist()]
            of = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(np.concatenate(found))], [key, "__anchor"])

    return rows.select(key, text).mapInArrow(run, f"{key} long, __anchor long")


def _by_anchor(rows: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Rows and phrases of LONG characters or more that meet in the phrase's rarest anchor, if the text holds
    the phrase. Work follows the texts, the phrases and the places of their rarest anchors."""
    base = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    asked = cut_lineage(phrases.withColumn("__asked", F.monotonically_increasing_id()))
    there = cut_lineage(_anchored(base, "__row", text))
    sizes = there.groupBy("__anchor").agg(F.count(F.lit(1)).alias("__n"))
    wanted = _anchored(asked, "__asked", HIT).join(sizes, "__anchor", "left").fillna(0, ["__n"])
    rarest = wanted.groupBy("__asked").agg(F.min(F.struct("__n", "__anchor")).alias("__r")).filter("__r.__n > 0").select("__asked", F.col("__r.__anchor").alias("__anchor"))
    met = there.join(rarest, "__anchor").select("__row", "__asked").join(asked, "__asked").join(base, "__row")
    return met.filter(F.contains(F.col(f"`{text}`"), F.col(HIT))).select(*[F.col(f"`{n}`") for n in rows.columns], HIT)


def match_phrases(rows: DataFrame, text: str, queries: DataFrame, phrase: str = "query", group: int = GROUP_CHARS) -> DataFrame:
    """Rows joined to every query whose phrase their text contains; blank and null phrases match nothing.

    Phrases may be of any length and number, equal ones included. Up to `group` characters of different phrases
    are one automaton. Beyond that, phrases of LONG characters or more are found by their anchors, and the texts
    are read once for each `group` characters of the shorter ones.
    """
    ship(rows.sparkSession)
    live = queries.filter(tx.strip_space(phrase) != "")
    different = live.select(F.col(phrase).alias(HIT)).distinct()
    chars = different.agg(F.sum(F.length(HIT))).first()[0] or 0
    if chars <= group:
        found = _sent(rows, text, different)
    else:
        short = different.filter(F.length(HIT) < LONG)
        groups = math.ceil((short.agg(F.sum(F.length(HIT))).first()[0] or 0) / group)
        found = _by_anchor(rows, text, different.filter(F.length(HIT) >= LONG))
        if groups:
            found = found.unionByName(_sent(rows, text, short) if groups == 1 else _dealt(rows, text, short, groups))
    return found.join(live.withColumn(HIT, F.col(phrase)), HIT).select(*rows.columns, *queries.columns)
