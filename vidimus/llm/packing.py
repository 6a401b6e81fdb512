"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is its histogram: at most `capacity`
numbers however many documents there are. The histogram alone is reduced and packed on the driver; the
plan says, for each length, which ranks go to which sequences at which offset. Ranks of documents
within a length are counted in chunks of bounded size, and each document then finds its own place.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.bpe import load
from vidimus.llm.common import longs, sliced

CAPACITY = 2048
SEPARATOR = 0
CHUNK_BITS = 16

Bins = tuple[list[tuple[int, int]], int]  # ((length, how many) in one bin, how many such bins)


def _pair_below(count: np.ndarray, w: int, room: int) -> int:
    """The largest sum of two items that fit in room beside an item w (which is taken already)."""
    sizes = np.flatnonzero(count)
    sizes = sizes[sizes < room]
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        total = int(sizes[lo] + sizes[hi])
        if total > room or (lo == hi and count[sizes[lo]] < 2):
            hi -= 1
        else:
            best, lo = max(best, total), lo + 1
    return best


def reduce_instance(count: np.ndarray, capacity: int) -> list[Bins]:
    """Fix bins that dominate every other way to pack their largest item; count is lowered in place.

    For an item w with room r beside it: alone, where nothing fits; with the largest item that fits,
    where that one fills r, where no two others fit together, or where at most two others fit and no
    two fill more than it does. Repeated until nothing more can be fixed.
    """
    fixed: list[Bins] = []

    def fix(w: int, other: int | None) -> None:
        if other is None:
            n = int(count[w])
            fixed.append(([(w, 1)], n))
            count[w] -= n
        elif other == w:
            n = int(count[w] // 2)
            fixed.append(([(w, 2)], n))
            count[w] -= 2 * n
        else:
            n = int(min(count[w], count[other]))
            fixed.append(([(w, 1), (other, 1)], n))
            count[w] -= n
            count[other] -= n

    for w in range(capacity, (capacity + 1) // 2 - 1, -1):  # perfect pairs first: they need no search
        r = capacity - w
        if count[w] and r and count[r] and (r != w or count[w] > 1):
            fix(w, r)
    moved = True
    while moved:
        moved = False
        for w in range(capacity, 0, -1):
            while count[w]:
                count[w] -= 1  # the item itself
                r = capacity - w
                small = np.flatnonzero(count[: r + 1])
                other, dominated = None, not len(small)
                if len(small):
                    other = int(small[-1])
                    least = np.repeat(small[:3], np.minimum(count[small[:3]], 3).astype(int))[:3]
                    if other == r or len(least) < 2 or least[0] + least[1] > r:
                        dominated = True
                    elif len(least) < 3 or least.sum() > r:
                        dominated = _pair_below(count, w, r) <= other
                count[w] += 1
                if not dominated:
                    break
                fix(w, other)
                moved = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit of the histogram in order of decreasing length; equal bins are handled together."""
    open_bins: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for w in range(capacity, 0, -1):
        n = int(count[w])
        while n:
            room = next((r for r in range(w, capacity) if open_bins[r]), None)
            items, m = open_bins[room].pop() if room is not None else ([], n)
            room = capacity if room is None else room
            k = room // w
            if n >= k:
                used = min(m, n // k)
                open_bins[room - k * w].append((items + [(w, k)], used))
                n -= used * k
            else:
                used = 1
                open_bins[room - n * w].append((items + [(w, n)], 1))
                n = 0
            if items and m > used:
                open_bins[room].append((items, m - used))
    return [b for group in open_bins for b in group]


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Bins]:
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    return reduce_instance(count, capacity) + best_fit(count, capacity)


def segments(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, how many a bin, first sequence, offset), sorted by length and rank."""
    rows, taken, sequence = [], {}, 0
    for items, m in bins:
        at = 0
        for w, k in items:
            rows.append((w, taken.get(w, 0), k, sequence, at))
            taken[w] = taken.get(w, 0) + m * k
            at += w * k
        sequence += m
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one separator, cut only where
    longer than the capacity. A null or empty text is the separator alone."""
    ship(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(path), np.array([separator], "<u4").tobytes()
        for b in sliced(batches):
            of, rows = [], []
            flat, n = bpe.encode(b.column(1).to_pylist())
            stop = np.cumsum(n)
            for at, (i, j) in enumerate(zip((stop - n).tolist(), stop.tolist())):
                ids = flat[i:j].tobytes() + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    of.append(at)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, i].copy()) for i in (1, 2, 3))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset; `length` of each row must be 1 to capacity.

    All rows are placed, equal ones too; sequences are gapless from 0. An empty table gives no rows.
    """
    ship(parts.sparkSession)
    names = parts.columns
    parts = cut_lineage(parts.withColumn("__row", F.monotonically_increasing_id()))
    parts = parts.withColumn("__chunk", F.shiftright("__row", CHUNK_BITS))
    # at most `capacity` rows reach the driver: one for each length
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("lengths must be 1 to the capacity")
    plan = segments(plan_bins(histogram, capacity))
    key, table = plan[:, 0] << 44 | plan[:, 1], plan

    sizes = parts.groupBy("length", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__chunk").orderBy("__row")
    ranked = parts.withColumn("__rank", F.row_number().over(inside) - 1).join(firsts, ["length", "__chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, rank = longs(b.column("length")), longs(b.column("__rank"))
            s = table[np.searchsorted(key, w << 44 | rank, side="right") - 1]
            step = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(s[:, 3] + step // s[:, 2]), pa.array(s[:, 4] + step % s[:, 2] * w)], [*names, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in parts.select(*names).dtypes)
    return ranked.select(*names, (F.col("__first") + F.col("__rank")).cast("long").alias("__rank")).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document of docs, cut into pieces where too long, with its sequence and offset."""
    return pack(pieces(docs, path, capacity), capacity)
