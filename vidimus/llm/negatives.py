"""Hard negatives, with exact scores, found through summaries of vector segments.

Each vector is stored with the mean and the deviation of its segments: the whole vector, its halves,
quarters and so on. The inner product of two segments is their length times the product of the means,
give or take their length times the product of the deviations. Summed over the segments of a level this
bounds a score from both sides, and each finer level bounds it closer. Pairs that a level rules out are
gone; what is left after the finest level gets its exact score.

Anchors and rows meet in tiles of bounded size; a tile keeps the best few of each anchor, and these are
ranked over all tiles.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship

POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score
TILE_ANCHORS = TILE_ROWS = 8192
FINEST = 4  # components in a segment of the last level
STEP_ANCHORS, STEP_ROWS = 512, 2048  # of a tile, looked at together
LIMIT = 2.0**56  # of a vector's squared length, so that scores times 100 are long
SLACK = 1e-9


def prepared(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, labels and components as the contract changes them."""
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**23))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.col("label").isNotNull() & F.coalesce(fits, F.lit(False)))
    rows = rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * 256).cast("int")).alias("q"))
    rows = rows.filter(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v) < LIMIT)
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def levels(width: int) -> list[int]:
    """Lengths of the segments of each level, coarsest first; width is the padded length."""
    out = [width]
    while out[-1] > FINEST:
        out.append(out[-1] // 2)
    return out


def padded(width: int) -> int:
    return max(FINEST, 1 << max(0, width - 1).bit_length())


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, each times the root of the segment's length,
    so that bounds are plain sums of products."""
    mean, dev = [], []
    for size in levels(q.shape[1]):
        part = q.reshape(len(q), -1, size).astype(np.float64)
        total = part.sum(2)
        mean.append(total / math.sqrt(size))
        dev.append(np.sqrt(np.maximum((part * part).sum(2) - total * total / size, 0)))
    return np.concatenate(mean, 1), np.concatenate(dev, 1)


def stored(rows: DataFrame) -> DataFrame:
    """The rows written with a number of their own and the summaries of their segments, shorter vectors
    as if zeros followed."""
    ship(rows.sparkSession)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    width = padded(rows.agg(F.max(F.size("q"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 2048) for x in batches for i in range(0, x.num_rows, 2048)):
            q = np.zeros((b.num_rows, width), np.int64)
            for i, v in enumerate(b.column(3).to_pylist()):
                q[i, : len(v)] = v
            mean, dev = summaries(q)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in (q.astype(np.int32), mean, dev)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), *(x.cast(pa.list_(x.type.value_type)) for x in lists)], ["row", "vec_id", "label", "q", "mean", "dev"]
            )

    return cut_lineage(rows.select("row", "vec_id", "label", "q").mapInArrow(run, "row long, vec_id long, label int, q array<int>, mean array<double>, dev array<double>"))


class Vectors:
    """The vectors of one side of a tile as arrays."""

    def __init__(self, table: pa.Table):
        self.row = table["row"].to_numpy()
        self.label = table["label"].to_numpy()
        self.none = np.asarray(table["vec_id"].is_null())
        self.id = table["vec_id"].fill_null(0).to_numpy()
        wide = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(self.row), -1)
        self.q, self.mean, self.dev = wide("q").astype(np.int64), wide("mean"), wide("dev")
        self.length = float((self.q.astype(np.float64) ** 2).sum(1).max(initial=0))

    def part(self, at: slice) -> Vectors:
        out = object.__new__(Vectors)
        out.__dict__ = {k: v[at] if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out


def survivors(a: Vectors, b: Vectors, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in a, place in b, exact score) of the allowed ones whose score lies in least..most
    of the anchor."""
    i, j = np.nonzero(allowed)
    sizes, at = levels(a.q.shape[1]), 0
    for size in sizes:
        if not len(i):
            break
        k = slice(at, at + a.q.shape[1] // size)
        at = k.stop
        if len(i) * 4 > allowed.size:  # many are left: all products at once
            mid, off = (a.mean[:, k] @ b.mean[:, k].T)[i, j], (a.dev[:, k] @ b.dev[:, k].T)[i, j]
        else:
            mid, off = np.einsum("ij,ij->i", a.mean[i, k], b.mean[j, k]), np.einsum("ij,ij->i", a.dev[i, k], b.dev[j, k])
        off = off + SLACK * (1 + a.length**0.5 * b.length**0.5)
        stay = (mid + off >= least[i]) & (mid - off <= most[i])
        i, j = i[stay], j[stay]
    if len(i) * 4 > allowed.size and a.length * b.length < 2.0**104:  # then doubles hold all sums exactly
        score = (a.q.astype(np.float64) @ b.q.astype(np.float64).T)[i, j].astype(np.int64)
    else:
        score = np.concatenate([np.zeros(0, np.int64), *((a.q[i[s : s + 65536]] * b.q[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536))])
    stay = (score >= least[i]) & (score <= most[i])
    return i[stay], j[stay], score[stay]


class Best:
    """The first k rows of each query so far: higher scores first, then smaller ids, then null ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.kept = k, [np.zeros(0, np.int64)] * 5
        self.last = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, b: Vectors, j: np.ndarray) -> None:
        if not len(query):
            return
        query, score, none, key, row = (np.concatenate(x) for x in zip(self.kept, (query, score, b.none[j].astype(np.int64), b.id[j], b.row[j])))
        order = np.lexsort((row, key, none, -score, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        order = order[place < self.k]
        self.last[query[place == self.k - 1]] = score[order[place[place < self.k] == self.k - 1]]
        query = query[place < self.k]
        self.kept = [query, score[order], none[order], key[order], row[order]]

    def columns(self) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
        """Query, score, id and row of what is kept."""
        query, score, none, key, row = self.kept
        return query, pa.array(score), pa.array(key, mask=none.astype(bool)), pa.array(row)


def _steps(a: Vectors, b: Vectors) -> Iterator[tuple[slice, Vectors, Vectors]]:
    for i in range(0, len(a.row), STEP_ANCHORS):
        own = slice(i, min(i + STEP_ANCHORS, len(a.row)))
        for j in range(0, len(b.row), STEP_ROWS):
            yield own, a.part(own), b.part(slice(j, j + STEP_ROWS))


_POSITIVE = "anchor long, positive long, positive_id long, positive_score long"
_NEGATIVE = "anchor long, positive long, negative long, negative_id long, negative_score long"


def _empty(ddl: str) -> pa.Table:
    return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in ddl.split(", ")})


def _tile_positives(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _empty(_POSITIVE)
    a, b = Vectors(left), Vectors(right)
    best = Best(len(a.row), POSITIVES)
    for own, x, y in _steps(a, b):
        same = (x.label[:, None] == y.label[None, :]) & (x.row[:, None] != y.row[None, :])
        i, j, score = survivors(x, y, same, best.last[own], np.full(len(x.row), np.inf))
        best.add(i + own.start, score, y, j)
    query, score, key, row = best.columns()
    return pa.table({"anchor": pa.array(a.row[query]), "positive": row, "positive_id": key, "positive_score": score})


def _tile_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _empty(_NEGATIVE)
    a, b = Vectors(left), Vectors(right)
    found = left["positives"].to_pylist()
    target = np.full((len(a.row), POSITIVES), np.iinfo(np.int64).min)
    for i, own in enumerate(found):
        target[i, : len(own)] = [p["positive_score"] for p in own]
    there = target != np.iinfo(np.int64).min
    target = np.where(there, target, 0)
    low = np.where(there, -(-LOWEST * target // 100), np.iinfo(np.int64).max)  # least and greatest whole score
    high = np.where(there, HIGHEST * target // 100, np.iinfo(np.int64).min)
    best = Best(len(a.row) * POSITIVES, NEGATIVES)
    for own, x, y in _steps(a, b):
        lasts = best.last.reshape(-1, POSITIVES)[own]
        useful = np.where(low[own] <= high[own], np.maximum(low[own], lasts), np.inf)
        other = x.label[:, None] != y.label[None, :]
        i, j, score = survivors(x, y, other, useful.min(1), np.where(low[own] <= high[own], high[own], -np.inf).max(1))
        for p in range(POSITIVES):
            fits = (score >= low[own][i, p]) & (score <= high[own][i, p])
            best.add((i[fits] + own.start) * POSITIVES + p, score[fits], y, j[fits])
    query, score, key, row = best.columns()
    chosen = [found[i][p]["positive"] for i, p in zip((query // POSITIVES).tolist(), (query % POSITIVES).tolist())]
    return pa.table({"anchor": pa.array(a.row[query // POSITIVES]), "positive": pa.array(chosen, pa.int64()), "negative": row, "negative_id": key, "negative_score": score})


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, work, ddl: str) -> DataFrame:
    """work() over every block of anchors with every block of rows."""
    across, down = max(1, -(-n_anchors // TILE_ANCHORS)), max(1, -(-n_rows // TILE_ROWS))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.withColumn("a", block(across)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = rows.withColumn("b", block(down)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(work, ddl)


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (vec_id
    divisible by `every`) and each of its first five other rows of the same label, the first three rows
    of other labels that score 50 to 95 per cent of the positive.

    Every row counts as a row of its own, repeated ones too; a null vec_id is no anchor, keeps its label
    and comes last among ties. Rows with a null label or vector, or a null or non-finite component, take
    no part, nor do vectors whose components reach 2^23 or whose squared length times 256^2 reaches 2^56,
    as their scores are no longs. Vectors of other lengths than the longest count as if zeros followed;
    empty vectors score 0. An empty table gives no rows; other columns are not read.
    """
    rows = stored(prepared(embeddings))
    n = rows.count()
    anchors = cut_lineage(rows.filter(F.col("vec_id") % every == 0))
    n_anchors = anchors.count()
    first = _tiles(anchors, rows, n_anchors, n, _tile_positives, _POSITIVE)
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), F.asc("positive")]
    positives = cut_lineage(first.withColumn("_r", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("_r") <= POSITIVES).drop("_r"))
    listed = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("positive", "positive_score")).alias("positives"))
    second = _tiles(anchors.join(listed, "row"), rows, n_anchors, n, _tile_negatives, _NEGATIVE)
    order = [F.desc("negative_score"), F.asc_nulls_last("negative_id"), F.asc("negative")]
    ranked = second.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(*order))).filter(F.col("rank") <= NEGATIVES)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return ranked.join(positives, ["anchor", "positive"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
