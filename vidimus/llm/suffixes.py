"""Repeated passages, found by suffix arrays built by linear grouping.

Every `width`-byte window of a text has an anchor: the least hash of the short grams inside it. Equal
windows have equal anchors, so windows are gathered by anchor and nothing is lost. Consecutive windows
of one anchor are one segment. Segments whose anchor occurs once in the corpus are done; equal segments
of one anchor are one segment with a weight, and an anchor whose segments are all equal is done too: each
window is there again. The others of an anchor meet in one task, many anchors in one batch, and a suffix array of the batch puts equal windows side by side.

The array is built without renaming in rounds: suffixes are first gathered by their Lyndon prefix,
groups being taken in descending order, where each suffix of a group hands the group to the nearest
suffix before it that lies in a lower group (its previous-smaller pointer), which then splits off from
its own group. The order inside groups is then emitted in one walk along these pointers. Symbols are
words (letters up to the next other byte, that byte included), which are named once; as no word is a
prefix of another, the order at any byte is that of what is left of its word, then of the next word.
"""
from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.common import longs, raw, sliced

WIDTH = 200
GRAM = 32  # bytes of an anchor, a power of two
LONGEST = 2048  # windows in a segment, so that monotonous texts are cut into equal segments
BLOCK = 1 << 22  # windows looked at together
_PLACE = np.uint64((BLOCK << 1) - 1)  # the low bits of a gram's hash give way to its place: of equal grams, the first counts
BATCH = 3 << 20  # bytes of segments in one suffix array
HOT = BATCH  # bytes of different segments of one anchor; beyond it windows are counted by their hashes

_BYTE = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
WORD = 10  # bytes of a word, about
_PER_KEY, _BITS = 7, 9  # symbols in a 64-bit key, bits of each: 0 behind a word, 1 end of a segment, byte + 2


# ---- suffix arrays

def lyndon_groups(symbols: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Groups of the suffixes that share a Lyndon prefix, in descending order, and for each suffix the
    nearest one before it that lies in a lower group (-1: none). Symbols are dense ranks from 0."""
    n, kinds = len(symbols), int(symbols.max()) + 1
    order = np.argsort(symbols, kind="stable")
    size = np.bincount(symbols, minlength=kinds)
    upto, order = np.cumsum(size).tolist(), order.tolist()
    members = [order[i:j] for i, j in zip([0, *upto], upto)]
    size, group = size.tolist(), symbols.tolist()
    below, above = list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    smaller, done, out = [-1] * n, bytearray(n), []

    def raised(suffixes: list[int], g: int) -> None:
        """These suffixes of group g become the group right above it."""
        new, over = len(size), above[g]
        size[g] -= len(suffixes)
        size.append(len(suffixes))
        members.append(suffixes)
        for j in suffixes:
            group[j] = new
        below.append(g)
        above.append(over)
        above[g] = new
        below[over] = new  # a group above exists: the one in work

    at = kinds - 1
    while at >= 0:
        own = members[at]
        if len(own) != size[at]:
            own = [j for j in own if group[j] == at]
        members[at] = None
        out.append(own)
        if len(own) == 1:
            s = own[0]
            done[s] = 1
            p = s - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                if size[g] > 1:
                    raised([p], g)
        else:
            own.sort()
            for s in own:
                done[s] = 1
            times: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by_times: dict[int, dict[int, list[int]]] = {}
            for p, k in times.items():
                by_times.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(by_times, reverse=True):
                for g, split in by_times[k].items():
                    if len(split) < size[g]:
                        raised(split, g)
        at = below[at]
    return out, smaller


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a text whose last symbol is 0 and occurs nowhere else."""
    groups, smaller = lyndon_groups(symbols)
    n = len(symbols)
    group, place, at = [0] * n, [0] * len(groups), n
    for g, own in enumerate(groups):
        at -= len(own)
        place[g] = at
        for j in own:
            group[j] = g
    order, rank = [-1] * n, [-1] * n
    order[0], rank[n - 1] = n - 1, 0
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and rank[j] < 0:
            g = group[j]
            k = place[g]
            order[k], rank[j], place[g] = j, k, k + 1
            j = smaller[j]
    return np.array(rank, np.int64)


def _word_ends(symbols: np.ndarray) -> np.ndarray:
    """Which symbols end a word: the end of a segment, and as many byte values, common ones first, as make
    words of some WORD bytes."""
    count = np.bincount(symbols, minlength=258)
    count[:2] = 0
    chosen, left = np.zeros(258, bool), len(symbols) / WORD
    for v in np.argsort(-count, kind="stable").tolist():
        if 0 < count[v] <= left:
            chosen[v] = True
            left -= count[v]
    if not chosen.any() and count.any():
        chosen[np.flatnonzero(count)[np.argmin(count[count > 0])]] = True
    chosen[1] = True
    return chosen[symbols]


def _word_ranks(text: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense ranks of what is left of the word at each place; last: end of the word of every symbol."""
    left, rank = last[at] - at, np.zeros(len(at), np.int64)
    by_length = np.argsort(-left, kind="stable")
    at, left = at[by_length], left[by_length]
    text = np.r_[text, np.zeros(_PER_KEY, text.dtype)]
    for column in range(int(left.max(initial=0)) // _PER_KEY, -1, -1):  # from the far ends of long words
        n = int(np.searchsorted(-left, -column * _PER_KEY, "right"))  # the words that reach this far
        place, more = at[:n] + column * _PER_KEY, left[:n] - column * _PER_KEY
        key = np.zeros(n, np.int64)
        for t in range(_PER_KEY):
            key = key << _BITS | np.where(more >= t, text[place + t], 0)
        order = np.lexsort((rank[:n], key))
        a, b = key[order], rank[:n][order]
        rank[order] = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    out = np.empty(len(at), np.int64)
    out[by_length] = rank
    return out


def repeated_windows(segments: list[bytes], weights: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, last) of window starts whose window occurs elsewhere among these segments,
    or in a segment of a weight over one. Each segment holds one window at least."""
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    symbols = text.astype(np.int64) + 2
    symbols[start + size] = 1
    stop = np.flatnonzero(_word_ends(symbols))
    head = np.r_[0, stop[:-1] + 1]
    last = np.repeat(stop, np.diff(np.r_[-1, stop]))
    of = np.repeat(np.arange(len(segments)), size - width + 1)
    asked = np.arange(len(of)) - np.repeat(np.cumsum(size - width + 1) - (size - width + 1), size - width + 1) + start[of]

    names = _word_ranks(symbols, last, np.concatenate([head, asked]))
    words = np.unique(names[: len(head)], return_inverse=True)[1] + 1
    rank = suffix_array(np.r_[words, 0])
    follows = rank[np.searchsorted(stop, asked) + 1]
    order = np.lexsort((follows, names[len(head) :]))
    a, b = asked[order[:-1]], asked[order[1:]]
    same = np.arange(len(a))
    for step in [*range(0, width - 8, 8), width - 8] if width >= 8 else range(width):
        wide = np.ndarray(len(text) - 7, "<u8", text, strides=(1,)) if width >= 8 else text
        same = same[wide[a[same] + step] == wide[b[same] + step]]
    twice = weights[of] > 1
    twice[order[same]] = True
    twice[order[same + 1]] = True
    edge = np.r_[True, of[1:] != of[:-1]]
    begins = np.flatnonzero(twice & (edge | ~np.r_[False, twice[:-1]]))
    ends = np.flatnonzero(twice & np.r_[edge[1:] | ~twice[1:], True])
    return of[begins], asked[begins] - start[of[begins]], asked[ends] - start[of[ends]]


# ---- anchors

def _grams(text: np.ndarray) -> np.ndarray:
    h, k = _BYTE[text], 1
    while k < GRAM:
        h = (h[:-k] * _ODD[0] ^ h[:-k] >> np.uint64(29)) + h[k:] * _ODD[1]
        k *= 2
    return h ^ h >> np.uint64(32)


def _sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    rows = full.reshape(-1, w)
    left, right = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: len(h) - w + 1], left[w - 1 : len(h)])


def segments_of(text: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, window behind the last, and whether the anchor's gram is there more than
    once (then windows may repeat inside), of each segment of a text."""
    codes, parts = np.frombuffer(text, np.uint8), []
    for at in range(0, len(text) - width + 1, BLOCK):
        gram = _grams(codes[at : at + BLOCK + width - 1])
        place = np.arange(len(gram), dtype=np.uint64)
        place = (_sliding_least(gram & ~_PLACE | place, width - GRAM + 1) & _PLACE).astype(np.int64)
        least = gram[place]
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        since = np.arange(len(least)) - np.repeat(begin, np.diff(np.r_[begin, len(least)]))
        begin = np.flatnonzero(since % LONGEST == 0)
        end = np.r_[begin[1:], len(least)]
        parts.append((least[begin].view(np.int64), at + begin, at + end, place[begin] != place[end - 1]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


# ---- Spark

_TABLE = "doc_id long, n_bytes long, text_sha256 string, packed binary, anchor array<long>, sig array<long>, lo array<int>, hi array<int>, inner array<boolean>"


def _lists(rows: list[np.ndarray], kind: str) -> pa.ListArray:
    at = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*rows, np.zeros(0, kind)]).astype(kind)))


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """One row a document: its bytes, compressed, and its segments with their anchors and signatures."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in sliced(batches):
            texts = [raw(t) for t in b.column(1).to_pylist()]
            found = [segments_of(t, width) for t in texts]
            sigs = []
            for t, (_, lo, hi, _) in zip(texts, found):
                view = memoryview(t)
                sigs.append(np.array([xxhash.xxh3_64_intdigest(view[i : j + width - 1]) for i, j in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([press.compress(t) for t in texts], pa.binary()), _lists([f[0] for f in found], "i8"), _lists(sigs, "i8"),
                    _lists([f[1] for f in found], "i4"), _lists([f[2] for f in found], "i4"), _lists([f[3] for f in found], "?"),
                ],
                [c.split()[0] for c in _TABLE.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TABLE)


def _fetch(table: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(anchor, sig, weight, segment) of the chosen segments (row, anchor, sig, weight, lo, hi)."""
    wanted = chosen.groupBy("row").agg(F.collect_list(F.struct("anchor", "sig", "weight", "lo", "hi")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, text=0, rows=64):
            of, pieces = [], []
            asked = b.column(1)
            lo, hi = (longs(asked.flatten().field(f)).tolist() for f in ("lo", "hi"))
            at = 0
            for packed, n in zip(b.column(0), np.diff(asked.offsets.to_numpy()).tolist()):
                view = memoryview(unpack.decompress(packed.as_py()))
                pieces += [bytes(view[lo[i] : hi[i] + width - 1]) for i in range(at, at + n)]
                at += n
            flat = asked.flatten()
            yield pa.RecordBatch.from_arrays([*(flat.field(f) for f in ("anchor", "sig", "weight")), pa.array(pieces, pa.binary())], ["anchor", "sig", "weight", "segment"])

    return table.select("row", "packed").join(wanted, "row").select("packed", "asked").mapInArrow(run, "anchor long, sig long, weight long, segment binary")


_RUNS = "anchor long, sig long, first int, last int"


def _by_suffix_array(fetched: DataFrame, width: int, batch: int) -> DataFrame:
    """Runs of repeated windows; all segments of an anchor lie in one batch."""

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        of, first, last = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), width)
        anchor, sig = (np.array([r[i] for r in rows], np.int64)[of] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(sig), pa.array(first.astype("i4")), pa.array(last.astype("i4"))], ["anchor", "sig", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the many small groups are no cycles
        held, size, before = [], 0, None
        for b in sliced(batches, text=3, rows=4096):
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= batch and row[0] != before:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                before = row[0]
        if held:
            yield solve(held)

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RUNS)


def _by_window(fetched: DataFrame, width: int) -> DataFrame:
    """The same for anchors with more different segments than a task should hold: windows are counted
    by 128-bit hashes, partial counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text=3, rows=64):
            n = [len(x.as_py()) - width + 1 for x in b.column(3)]
            of = np.repeat(np.arange(b.num_rows), n)
            at = np.concatenate([np.arange(k) for k in n])
            both = [xxhash.xxh3_128_digest(s[i : i + width]) for s, k in zip(map(memoryview, b.column(3).to_pylist()), n) for i in range(k)]
            halves = np.frombuffer(b"".join(both), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(pa.array(of)) for i in range(3)), pa.array(at.astype("i4")), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["anchor", "sig", "weight", "first", "h1", "h2"],
            )

    windows = cut_lineage(fetched.mapInArrow(run, "anchor long, sig long, weight long, first int, h1 long, h2 long"))
    twice = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).filter("n > 1")
    return windows.join(twice, ["h1", "h2"], "left_semi").select("anchor", "sig", "first", F.col("first").alias("last"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<begin, end>>) per document:
    without the bytes that lie in a `width`-byte string which starts anywhere else too.

    Texts are UTF-8 bytes and compared whole; matches never cross documents. A null text is empty. Each
    row counts as a document of its own, so two rows with the same id and text repeat each other; a null
    id is carried along. Texts shorter than `width` bytes lose nothing; an empty table gives no rows;
    other columns are not read. `width` is 64 at least.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be {2 * GRAM} at least")
    ship(docs.sparkSession)
    table = cut_lineage(_cut(docs, width).withColumn("row", F.monotonically_increasing_id()))
    one = table.select("row", F.explode(F.arrays_zip("anchor", "sig", "lo", "hi", "inner")).alias("s")).select("row", "s.*")
    again = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("within")).filter("n > 1 or within")
    met = cut_lineage(one.drop("inner").join(again, "anchor", "left_semi"))
    groups = cut_lineage(
        met.groupBy("anchor", "sig").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("row", "lo", "hi")).alias("_s")).select("anchor", "sig", "weight", "_s.*")
    )
    size = F.col("hi") - F.col("lo")
    load = groups.groupBy("anchor").agg(
        F.sum(size + width - 1).alias("load"), F.count(F.lit(1)).alias("kinds"), F.max("weight").alias("weight"), F.min("sig").alias("sig"), F.max(size).alias("windows")
    )
    # all segments of the anchor are equal and there are several: every window is there again, nothing is left to compare
    lone = load.filter("kinds = 1 and weight > 1")
    groups = groups.join(lone.select("anchor"), "anchor", "left_anti")
    crowded = load.filter(F.col("load") > hot).select("anchor")
    if crowded.isEmpty():
        runs = _by_suffix_array(_fetch(table, groups, width), width, batch)
    else:
        crowded = cut_lineage(crowded)
        few, many = groups.join(crowded, "anchor", "left_anti"), groups.join(crowded, "anchor", "left_semi")
        runs = _by_suffix_array(_fetch(table, few, width), width, batch).unionByName(_by_window(_fetch(table, many, width), width))
    runs = runs.unionByName(lone.select("anchor", "sig", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    found = met.join(runs, ["anchor", "sig"]).select("row", (F.col("lo") + F.col("first")).alias("begin"), (F.col("lo") + F.col("last") + width).alias("end"))
    spans = found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in sliced(batches, text=3, rows=64):
            out = []
            for n, sha, packed, pairs in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if not pairs:
                    out.append((0, sha, []))
                    continue
                merged: list[list[int]] = []
                for begin, end in sorted((p["begin"], p["end"]) for p in pairs):
                    if merged and begin <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([begin, end])
                text, at, kept = memoryview(unpack.decompress(packed)), 0, hashlib.sha256()
                for begin, end in merged:
                    kept.update(text[at:begin])
                    at = end
                kept.update(text[at:])
                out.append((sum(e - s for s, e in merged), kept.hexdigest(), [{"begin": s, "end": e} for s, e in merged]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([len(o[2]) for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                    pa.array([o[2] for o in out], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    joined = table.select("row", "doc_id", "n_bytes", "text_sha256", "packed").join(spans, "row", "left")
    return joined.select("doc_id", "n_bytes", "text_sha256", F.when(F.col("found").isNotNull(), F.col("packed")).alias("packed"), "found").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: int, end: int>>"
    )
