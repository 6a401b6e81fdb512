"""SimHash near-duplicates by tables of distances to reference fingerprints (pivots).

Equal fingerprints are one vertex. Two fingerprints that differ in at most `bits` bits agree wholly on
at least `same` of `blocks` aligned blocks of bits, and equal bits there are the key by which candidates
meet; pivots select no candidate. Where candidates meet, a table of Hamming distances to many reference
fingerprints (the pivots) is filled once and only discards: pairs
whose largest coordinate difference is over `bits` are discarded (triangle inequality), the survivors
are verified bit by bit. A set that shares a key gives a spanning forest of its links, never its pairs,
and is dealt in tiles of bounded size: nothing is capped, and no task holds more than two tiles.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions.components import components
from vidimus.functions.frames import by_shuffle, cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.common import longs, raw, semi, sliced

SHINGLE, BITS, SEED = 4, 4, 42
BLOCKS, SAME = 7, 3
TILE = 1024
SMALL = 24
PIVOTS = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; a text without words has 0."""
    words = raw(text).lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size)[: n - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    m, ones = len(begins), np.zeros(64, np.int64)
    for at in range(0, m, 1 << 15):
        part = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[at : at + (1 << 15)], ends[at : at + (1 << 15)])), np.uint64)
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for every row; a null text is a text without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def references(n: int = PIVOTS) -> np.ndarray:
    """n reference fingerprints, spread by a fixed rule."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The table: Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def block_masks(blocks: int, same: int) -> list[int]:
    """For every choice of `same` of the blocks, the bits in them, as signed numbers."""
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(blocks)]
    full = [sum(one[i] for i in pick) for pick in itertools.combinations(range(blocks), same)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in full]


def _survive(fp, table, i, j, bits):
    """Of the pairs (i, j), those that the table cannot discard and that really are within bits."""
    for c in range(0, table.shape[1], 8):
        ok = np.abs(table[i, c : c + 8] - table[j, c : c + 8]).max(axis=1) <= bits
        i, j = i[ok], j[ok]
        if not len(i):
            return i, j
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    return i[ok], j[ok]


def forest(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the rows: each row is compared with the rows not reached yet."""
    left, us, vs, queue = np.arange(len(fp)), [], [], []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = left[0], left[1:]
        i, _ = _survive(fp, table, left, np.full(len(left), x), bits)
        if len(i):
            us.append(np.full(len(i), x))
            vs.append(i)
            queue.extend(i.tolist())
            left = left[~np.isin(left, i, assume_unique=True)]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _link_groups(bits: int, small: int = SMALL):
    """Rows sorted by (k, a, b) in, links out; a group may span batches."""

    def groups(k, a, b, fp, refs):
        cut = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[cut, len(k)])
        table, out = distances(fp, refs), []
        group = np.repeat(np.arange(len(cut)), size)
        few = np.repeat(size <= small, size)
        for o in range(1, min(small, int(size.max(initial=0)))):
            i = np.flatnonzero((group[:-o] == group[o:]) & few[:-o])
            if not len(i):
                break
            out.append(_survive(fp, table, i, i + o, bits))
        for s, n in zip(cut[size > small], size[size > small]):
            i, j = forest(fp[s : s + n], table[s : s + n], bits)
            out.append((i + s, j + s))
        if out:
            i, j = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, held = references(), None
        for batch in batches:
            new = [longs(batch.column(i)) for i in range(4)]
            cols = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(cols[0]):
                continue
            k, a, b, fp = cols
            last = np.flatnonzero((k != k[-1]) | (a != a[-1]) | (b != b[-1]))
            at = last[-1] + 1 if len(last) else 0
            held = [c[at:] for c in cols]
            if at:
                yield from groups(k[:at], a[:at], b[:at], fp[:at].view(np.uint64), refs)
        if held is not None and len(held[0]):
            yield from groups(held[0], held[1], held[2], held[3].view(np.uint64), refs)

    return run


def links(points: DataFrame, bits: int = BITS, blocks: int = BLOCKS, same: int = SAME, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect whatever is within `bits` of one another among distinct fingerprints fp.

    Complete as to components: two fingerprints within bits are in one component of the result.
    """
    if bits > blocks - same:
        raise ValueError("bits must be at most blocks - same, or linked fingerprints may share no key")
    ship(points.sparkSession)
    masks = block_masks(blocks, same)
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("pos", "part")).select(
        F.xxhash64("pos", "part").alias("k"), "fp"
    )
    met = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mine, tiles = F.pmod(F.xxhash64("fp"), F.col("t")), F.sequence(F.lit(0).cast("long"), F.col("t") - 1)
    # a table that explodes counts as large as what it was made from, so Spark would broadcast the keys of some 10 MB of points
    dealt = (
        keyed.join(by_shuffle(met), "k").withColumn("t", F.ceil(F.col("n") / tile)).withColumn("mine", mine).select("k", "fp", "mine", F.explode(tiles).alias("other"))
        .select("k", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
    )
    return dealt.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b").mapInArrow(_link_groups(bits), "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, blocks: int = BLOCKS, same: int = SAME, tile: int = TILE,
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id that links lead to. Rows without words (null, empty, white
    space) have fingerprint zero and are linked like any other. Equal texts and repeated rows share a
    fingerprint. A row whose doc_id is null is kept, gets a component, and never names one; a component
    of such rows only has a null component_id. An empty table gives no rows; other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    points = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp"), bits, blocks, same, tile), shuffled=True)
    rooted = points.join(by_shuffle(roots.select(F.col("node").alias("fp"), "root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(by_shuffle(rooted.groupBy("root").agg(F.min("least").alias("component_id"))), "root").select("fp", "component_id")
    return prints.join(by_shuffle(named), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id names their component, with their own columns: one document of
    each group stays. Rows without a doc_id stay only where their whole component has none."""
    near = near_duplicates(docs, **options)
    return semi(docs, near.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
