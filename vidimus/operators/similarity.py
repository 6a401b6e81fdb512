"""Nearest windows by exact cosine, and verbatim reuse between texts."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions import runs
from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, top_k_per
from vidimus.functions.workers import ship

BLOCK_ROWS = 512
PIVOTS = 1024  # at most: their vectors pass through the driver and go to every task
GRID = 8  # least number of tiles of asked windows and of slices of the pool
TILE_BYTES = 64 << 20  # vectors of one tile
DEFAULT_WINDOW = 400
UNLABELLED = "grey"
GRAM = 10
MIN_RUN = 12
MAX_RUNS = 8
SLACK = 1e-6


# --- exact nearest windows ---------------------------------------------------------------------------
def _unit(v: np.ndarray) -> np.ndarray:
    """Directions of the rows; a zero vector stays zero."""
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)


def _assign(pivots: np.ndarray):
    """Batch function: nearest pivot of each window and the cosine to it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            v = np.stack(b["vec"].to_numpy()).astype(np.float32)
            cos = _unit(v) @ pivots.T
            cell = cos.argmax(axis=1)
            yield pd.DataFrame({
                "idx": b["idx"], "work": b["work"], "pooled": b["pooled"], "cell": cell.astype(np.int32),
                "near": cos[np.arange(len(b)), cell], "norm": np.linalg.norm(v.astype(np.float64), axis=1), "vec": [x.tobytes() for x in v],
            })
    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bounded block of windows as one row, ordered by window index."""
    pdf = pdf.sort_values("idx")
    return pd.DataFrame({
        "cell": [int(pdf["cell"].iloc[0])], "sub": [int(pdf["sub"].iloc[0])],
        "idx": [pdf["idx"].to_numpy(np.int64).tobytes()], "works": [list(pdf["work"])],
        "pooled": [pdf["pooled"].to_numpy(np.int8).tobytes()], "vecs": [b"".join(pdf["vec"])],
    })


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32).reshape(rows, -1).astype(np.float64)


def _cosines(q: np.ndarray, p: np.ndarray, q_works: list, p_works: list, pooled: np.ndarray, other: bool) -> np.ndarray:
    """Inner product (for unit vectors the cosine) of every pair of two blocks, pairs that may not match set to -inf. Rounded well below any
    real difference, so exact copies tie and the tie goes by index."""
    cos = np.round(q @ p.T, 12)
    cos[:, pooled == 0] = -np.inf
    if other:
        _, codes = np.unique(np.array([*q_works, *p_works], dtype=object).astype(str), return_inverse=True)
        cos[codes[: len(q_works), None] == codes[None, len(q_works):]] = -np.inf
    return cos


def _plan_block(pivots: np.ndarray, radius: np.ndarray, norms: np.ndarray, k: int, other: bool):
    """Each block with `kth`, the k-th best product each window already has inside its own block, and `cells`,
    those that could still hold something as good: a cell's windows lie within the angle `radius` of its pivot
    and their norms within `norms` (least, greatest). Cells without pooled windows are skipped."""
    cells_used = np.flatnonzero(np.isfinite(radius))
    reach, least, most = radius[cells_used], norms[0, cells_used], norms[1, cells_used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.itertuples(index=False):
                n = len(r.works)
                v = _matrix(r.vecs, n)
                cos = _cosines(v, v, r.works, r.works, np.frombuffer(r.pooled, np.int8), other)
                kth = np.sort(cos, axis=1)[:, -k] if n >= k else np.full(n, -np.inf)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                angle = np.arccos(np.clip(_unit(v) @ pivots[cells_used].T, -1.0, 1.0))
                cosine = np.cos(np.maximum(0.0, angle - reach))
                bound = size * np.where(cosine >= 0, cosine * most, cosine * least) + SLACK * size * most
                made.append((kth.tobytes(), cells_used[(bound >= kth[:, None]).any(axis=0)].tolist()))
            yield b.assign(kth=[m[0] for m in made], cells=[m[1] for m in made])
    return run


class _Best:
    """The best k of a block of asked windows, over the pool blocks it has met so far."""

    def __init__(self, idx: bytes, works: np.ndarray, vecs: bytes, kth: bytes, k: int, most: float):
        self.idx, self.works, self.k = np.frombuffer(idx, np.int64), works, k
        self.vecs = np.frombuffer(vecs, np.float32).reshape(len(self.idx), -1)
        # the same product may differ in its last bits from one matrix shape to another
        self.slack = 1e-12 * (1 + most * np.linalg.norm(self.vecs.astype(np.float64), axis=1))
        self.floor = np.frombuffer(kth, np.float64).copy()
        self.row, self.near, self.cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, idx: np.ndarray, works: np.ndarray, vecs: np.ndarray, other: bool) -> None:
        cos = self.vecs.astype(np.float64) @ vecs.T
        row, col = np.nonzero(cos >= (self.floor - self.slack)[:, None])
        if other:
            apart = self.works[row] != works[col]
            row, col = row[apart], col[apart]
        if not len(row):
            return
        self.row, self.near = np.r_[self.row, row], np.r_[self.near, idx[col]]
        self.cos = np.r_[self.cos, np.round(cos[row, col], 12)]
        order = np.lexsort((self.near, -self.cos, self.row))
        row = self.row[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        order = order[rank < self.k]
        full = order[rank[rank < self.k] == self.k - 1]
        self.row, self.near, self.cos, last = self.row[order], self.near[order], self.cos[order], (self.row[full], self.cos[full])
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1])


_MET = "part INT, kind INT, cell INT, idx BINARY, works ARRAY<STRING>, pooled BINARY, vecs BINARY, kth BINARY, cells ARRAY<INT>"


def _best_in_part(k: int, other: bool, most: float):
    """Batch function over sorted rows, in each part blocks of asked windows first (kind 0), which stay, and
    then the pool blocks, which stream past: the best k of each asked window in that part of the pool."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, codes = None, [], {}

        def results() -> Iterator[pa.RecordBatch]:
            for _, best in held:
                yield pa.RecordBatch.from_arrays([pa.array(best.idx[best.row]), pa.array(best.near), pa.array(best.cos)], ["idx", "near_idx", "cosine"])

        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                if r["part"] != part:
                    yield from results()
                    part, held, codes = r["part"], [], {}
                works = np.array([codes.setdefault(w, len(codes)) for w in r["works"]], np.int64)
                if r["kind"] == 0:
                    held.append((frozenset(r["cells"]), _Best(r["idx"], works, r["vecs"], r["kth"], k, most)))
                    continue
                pooled = np.frombuffer(r["pooled"], np.int8) == 1
                if not pooled.any():
                    continue
                idx, works, vecs = np.frombuffer(r["idx"], np.int64)[pooled], works[pooled], _matrix(r["vecs"], len(works))[pooled]
                for cells, best in held:
                    if r["cell"] in cells:
                        best.meet(idx, works, vecs, other)
        yield from results()
    return run


def nearest_indices(
    windows: DataFrame, k: int, other: str = "work", labelled_only: bool = False, block: int = BLOCK_ROWS, asked: DataFrame | None = None,
) -> DataFrame:
    """Exact k nearest windows of every window, or of those in `asked` (`idx`), as `idx, near_idx,
    cosine, rank` (N1 core). Nearness is the inner product, so unit vectors give cosines.

    Windows are grouped around as many pivots as the square root of their number, PIVOTS at most, and packed
    into blocks of about `block` rows; a cell that holds most windows is simply many blocks. A block is compared with
    the blocks of exactly those cells that could improve a result (bound by the angle to the pivot and
    the norms in the cell), one matrix product per block pair, and only each window's best k leave a
    task. A task holds a tile of the asked blocks while a slice of the pool streams past. Pruning drops only what cannot enter the top k, for vectors of any length.
    """
    spark = windows.sparkSession
    ship(spark)
    pool = F.lit(True) if not labelled_only else F.coalesce(F.col("label") != UNLABELLED, F.lit(True))
    base = windows.select("idx", F.coalesce(F.col(other).cast("string"), F.lit("")).alias("work"), pool.cast("int").alias("pooled"), "vec")
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], "idx BIGINT, near_idx BIGINT, cosine DOUBLE, rank INT")
    wanted = min(math.isqrt(n - 1) + 1, PIVOTS)
    rows = base.orderBy(F.xxhash64("idx"), "idx").limit(wanted).select("vec").collect()  # bounded, however many windows there are
    pivots = _unit(np.array([r["vec"] for r in rows], dtype=np.float64))
    placed = base.mapInPandas(_assign(pivots), "idx BIGINT, work STRING, pooled INT, cell INT, near DOUBLE, norm DOUBLE, vec BINARY")
    placed = cut_lineage(placed)
    in_pool = lambda c: F.when(F.col("pooled") == 1, F.col(c))
    sizes = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min(in_pool("near")).alias("near"), F.min(in_pool("norm")).alias("least"), F.max(in_pool("norm")).alias("most")
    ).collect()  # one row per pivot
    radius, subs, norms = np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64), np.zeros((2, len(pivots)))
    for r in sizes:
        subs[r["cell"]] = -(-r["n"] // block)
        if r["near"] is not None:
            radius[r["cell"]] = np.arccos(np.clip(r["near"], -1.0, 1.0))
            norms[:, r["cell"]] = r["least"], r["most"]
    subs_of = F.array(*[F.lit(int(s)) for s in subs])
    cut = placed.withColumn("sub", F.pmod(F.xxhash64("idx"), F.get(subs_of, F.col("cell"))).cast("int"))
    packed = "cell INT, sub INT, idx BINARY, works ARRAY<STRING>, pooled BINARY, vecs BINARY"
    blocks = cut_lineage(cut.groupBy("cell", "sub").applyInPandas(lambda pdf: _pack(pdf), packed))
    mine = blocks
    if asked is not None:  # only asked windows look for neighbours; the pool stays whole
        mine = cut_lineage(cut.join(asked.select("idx").distinct(), "idx", "left_semi").groupBy("cell", "sub").applyInPandas(lambda pdf: _pack(pdf), packed))
    planned = cut_lineage(mine.mapInPandas(_plan_block(pivots, radius, norms, k, other is not None), f"{packed}, kth BINARY, cells ARRAY<INT>"))
    # a grid: each part holds one tile of the asked blocks and meets one slice of the pool, so a window is sent
    # `side` times in each role, however many blocks there are; more sides only beyond TILE_BYTES of vectors each
    side = max(-(-n * pivots.shape[1] * 4 // TILE_BYTES), min(GRID, math.isqrt(int(subs.sum()))))
    piece = lambda seed: F.pmod(F.xxhash64("cell", "sub", F.lit(seed)), F.lit(side)).cast("int")
    every = F.sequence(F.lit(0), F.lit(side - 1))
    tiles = planned.withColumn("tile", piece(1))
    needs = cut_lineage(tiles.select("tile", F.explode("cells").alias("cell")).distinct())  # what no block of a tile asks for is not sent there
    cols = [c.split()[0] for c in _MET.split(", ")]
    ask = tiles.withColumn("slice", F.explode(every)).withColumn("kind", F.lit(0))
    pool = blocks.join(needs, "cell").withColumn("slice", piece(2)).selectExpr("*", "1 AS kind", "CAST(NULL AS BINARY) AS kth", "CAST(NULL AS ARRAY<INT>) AS cells")
    numbered = [x.withColumn("part", (F.col("tile") * side + F.col("slice")).cast("int")).select(cols) for x in (ask, pool)]
    met = numbered[0].unionByName(numbered[1]).repartition("part").sortWithinPartitions("part", "kind")
    part = met.mapInArrow(_best_in_part(k, other is not None, float(norms[1].max())), "idx BIGINT, near_idx BIGINT, cosine DOUBLE")
    return top_k_per(part, ["idx"], [F.desc("cosine"), F.col("near_idx")], k)


def neighbours(
    windows: DataFrame, k: int = 3, other: str = "work", labelled_only: bool = False,
    max_windows: int | None = None, block: int = BLOCK_ROWS, asked: DataFrame | None = None,
) -> DataFrame:
    """For each window (or each in `asked`), the k most similar windows of other works (N1); optionally
    only the first windows of each unit. What is not listed is not computed."""
    mine = windows.select("idx", "uid", "work", "start")
    if asked is not None:
        mine = mine.join(asked.select("idx").distinct(), "idx", "left_semi")
    if max_windows is not None:
        w = Window.partitionBy("uid").orderBy("start", "idx")
        mine = mine.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_windows).drop("_n")
    near = nearest_indices(windows, k, other, labelled_only, block, None if asked is None and max_windows is None else mine)
    there = windows.select(
        F.col("idx").alias("near_idx"), F.col("uid").alias("near_uid"), F.col("label").alias("near_label"), F.col("start").alias("near_start")
    )
    return near.join(mine, "idx").join(there, "near_idx").select(
        "idx", "uid", "work", "start", "rank", "near_idx", "near_uid", "near_label", "near_start", F.round("cosine", 3).alias("cosine")
    )


def nearest_tally(near: DataFrame, by: str = "near_uid", top: int = 8) -> DataFrame:
    """Which unit (or label) the single nearest window belongs to, over all windows of a unit."""
    counted = near.filter("rank = 1").groupBy("uid", F.col(by).alias("nearest")).agg(F.count(F.lit(1)).alias("n"))
    return top_k_per(counted, ["uid"], [F.desc("n"), F.col("nearest")], top)


def related(windows: DataFrame, queries: DataFrame, limit: int = 5, block: int = BLOCK_ROWS) -> DataFrame:
    """Ranked passages in other works for chosen windows, with the size of the candidate pool.

    `queries` holds `uid, start`; a position no window has is reported as `unknown_position`."""
    if not 1 <= limit <= 10:
        raise ValueError("limit must be between 1 and 10")
    asked = queries.select("uid", "start").distinct().join(windows.select("uid", "start", "idx", "work"), ["uid", "start"], "left")
    near = neighbours(windows, limit, block=block, asked=asked.filter("idx IS NOT NULL")).drop("uid", "work", "start")
    per_work = windows.groupBy("work").agg(F.count(F.lit(1)).alias("own_windows"))
    total = windows.agg(F.count(F.lit(1)).alias("all_windows")).withColumn("_k", F.lit(1))
    j = asked.join(near, "idx", "left").join(per_work, "work", "left").withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return j.select(
        "uid", "start", F.when(F.col("idx").isNull(), "unknown_position").otherwise("ok").alias("status"), "rank",
        "near_uid", "near_start", "cosine", F.when(F.col("idx").isNotNull(), F.col("all_windows") - F.col("own_windows")).alias("candidate_windows"),
    )


def window_positions(windows: DataFrame) -> DataFrame:
    return windows.groupBy("uid").agg(F.array_sort(F.collect_list("start")).alias("positions"))


def window_length(windows: DataFrame, default: int = DEFAULT_WINDOW) -> DataFrame:
    """Least positive gap between consecutive offsets of one unit."""
    w = Window.partitionBy("uid").orderBy("idx")
    gaps = windows.select((F.col("start") - F.lag("start").over(w)).alias("g"))
    return gaps.agg(F.coalesce(F.min(F.when(F.col("g") > 0, F.col("g"))), F.lit(default)).cast("bigint").alias("window_chars"))


def describe_windows(windows: DataFrame) -> DataFrame:
    """Windows, units, vector size and window length."""
    base = windows.agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("uid").alias("units"), F.max(F.size("vec")).alias("dim"))
    return base.withColumn("_k", F.lit(1)).join(window_length(windows).withColumn("_k", F.lit(1)), "_k").drop("_k")


def window_text(windows: DataFrame, docs: DataFrame, size: int = DEFAULT_WINDOW) -> DataFrame:
    """Text, bounds and source hash of each window; an offset outside the text is flagged."""
    j = windows.select("idx", "uid", "start").join(docs.select("uid", "text"), "uid", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.length("text"))
    return j.select(
        "idx", "uid", "start",
        F.when(F.col("text").isNull(), "no source").when(inside, "ok").otherwise("outside the source").alias("status"),
        F.when(inside, F.least(F.col("start") + size, F.length("text"))).alias("end"),
        F.when(inside, tx.slice_text("text", F.col("start"), F.lit(size))).alias("text"),
        F.when(inside, tx.sha256("text")).alias("source_sha256"),
    )


def snippets(windows: DataFrame, docs: DataFrame, size: int = 40) -> DataFrame:
    """First characters of each window without line breaks."""
    j = windows.select("idx", "uid", "start").join(docs.select("uid", "text"), "uid", "left")
    cut = tx.slice_text(F.coalesce("text", F.lit("")), F.col("start"), F.lit(size))
    return j.select("idx", "uid", "start", F.regexp_replace(cut, "\n", "").alias("snippet"))


# --- verbatim reuse ----------------------------------------------------------------------------------------
def script_only(docs: DataFrame, cls: str = tx.HAN) -> DataFrame:
    """Each text reduced to its script characters (`kept`)."""
    kept = tx.script_text("text", cls)
    return docs.select("uid", kept.alias("kept"))


def _paired(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("uid_a", "uid_b")).alias("uid")).distinct()
    return docs.join(ids, "uid", "left_semi")


def _side_by_side(docs: DataFrame, pairs: DataFrame, cls: str) -> DataFrame:
    """Each asked pair once, with both texts reduced to script characters; a text without a row is empty."""
    kept = script_only(_paired(docs, pairs), cls)
    ask = pairs.select("uid_a", "uid_b").distinct()
    side = lambda c: kept.select(F.col("uid").alias(f"uid_{c}"), F.coalesce("kept", F.lit("")).alias(f"text_{c}"))
    return ask.join(side("a"), "uid_a", "left").join(side("b"), "uid_b", "left").fillna("", ["text_a", "text_b"]).select("uid_a", "uid_b", "text_a", "text_b")


def _on_pairs(pairs: DataFrame, work, names: str) -> DataFrame:
    """work(text_a, text_b) -> columns of equal length, for every pair; the texts stay in their row."""
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            made = [work(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            of = pa.array(np.repeat(np.arange(b.num_rows), [len(m[0]) for m in made]))
            cols = [np.concatenate([np.asarray(m[k], np.int64) for m in made]) for k in range(len(made[0]))] if made else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *map(pa.array, cols)], ["uid_a", "uid_b", *names.split()])

    return pairs.mapInArrow(run, ", ".join([f"uid_a {kinds['uid_a']}", f"uid_b {kinds['uid_b']}", *(f"{n} long" for n in names.split())]))


def coverage(docs: DataFrame, pairs: DataFrame, gram: int = GRAM, cls: str = tx.HAN) -> DataFrame:
    """Share of each text's distinct grams found in the other, both ways, whole texts.

    `pairs` holds `uid_a, uid_b`. Each asked pair is worked out once, in its row; no other pair is looked
    at and no gram is shuffled. A text asked for in many pairs is dealt over tasks by Spark's split of
    skewed joins.
    """
    found = _on_pairs(_side_by_side(docs, pairs, cls), lambda a, b: [[n] for n in runs.shared_grams(a, b, gram)], "shared grams_a grams_b")
    share = lambda c: F.when(F.col(c) > 0, F.bround(F.col("shared") / F.col(c), 4)).otherwise(0.0)
    return found.select("*", share("grams_a").alias("share_of_a_in_b"), share("grams_b").alias("share_of_b_in_a"))


def maximal_runs(docs: DataFrame, pairs: DataFrame, min_run: int = MIN_RUN, cls: str = tx.HAN) -> DataFrame:
    """Every maximal common run of at least `min_run` script characters per asked pair (N8 core, N9).

    Both texts lie in one row; grams of that length that begin or end a run are the only ones that are
    paired, so work and memory follow the texts and their runs. Offsets `a`, `b` count script characters.
    """
    return _on_pairs(_side_by_side(docs, pairs, cls), lambda a, b: runs.maximal_runs(a, b, min_run), "a b chars")


def pick_blocks(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """In-order matching blocks from all maximal runs: longest first (ties: least a, then b), then the
    same on both sides of it, runs clipped to what is left."""
    big = 1 << 60
    todo, out = [(0, big, 0, big, runs)], []
    while todo:
        a_lo, a_hi, b_lo, b_hi, cand = todo.pop()
        inside, best = [], None
        for a, b, n in cand:
            cut = max(0, a_lo - a, b_lo - b)
            a, b, n = a + cut, b + cut, n - cut
            n = min(n, a_hi - a, b_hi - b)
            if n >= least:
                inside.append((a, b, n))
                if best is None or (-n, a, b) < (-best[2], best[0], best[1]):
                    best = (a, b, n)
        if best is not None:
            a, b, n = best
            out.append(best)
            todo.append((a_lo, a, b_lo, b, inside))
            todo.append((a + n, a_hi, b + n, b_hi, inside))
    out.sort()
    merged: list[tuple[int, int, int]] = []
    for a, b, n in out:
        if merged and merged[-1][0] + merged[-1][2] == a and merged[-1][1] + merged[-1][2] == b:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + n)
        else:
            merged.append((a, b, n))
    return merged


def in_order_runs(docs: DataFrame, pairs: DataFrame, min_run: int = MIN_RUN, cls: str = tx.HAN) -> DataFrame:
    """The non-crossing selection of each pair's maximal runs, made where the runs are found."""
    def choose(a: str, b: str) -> tuple:
        blocks = pick_blocks(list(zip(*(x.tolist() for x in runs.maximal_runs(a, b, min_run)))), min_run)
        return tuple(np.array(x, np.int64) for x in zip(*blocks)) if blocks else (np.zeros(0, np.int64),) * 3

    return _on_pairs(_side_by_side(docs, pairs, cls), choose, "a b chars")


def shared_runs(
    docs: DataFrame, pairs: DataFrame, min_run: int = MIN_RUN, max_runs: int | None = MAX_RUNS,
    in_order: bool = True, cls: str = tx.HAN,
) -> DataFrame:
    """Longest shared runs per pair with their text and original offsets.

    Offsets count characters of the original texts, punctuation included; `*_end` is exclusive."""
    found = (in_order_runs if in_order else maximal_runs)(docs, pairs, min_run, cls)
    if max_runs is not None:
        found = top_k_per(found, ["uid_a", "uid_b"], [F.desc("chars"), F.col("a"), F.col("b")], max_runs)
    used = docs.select("uid", "text")
    pos = lambda side: _paired(used, pairs).select(
        F.col("uid").alias(f"uid_{side}"), tx.script_offsets("text", cls).alias(f"_o{side}"), tx.script_text("text", cls).alias(f"_k{side}")
    )
    j = found.join(pos("a"), "uid_a").join(pos("b").drop("_kb"), "uid_b")
    end = lambda o, c: F.get(F.col(o), (F.col(c) + F.col("chars") - 1).cast("int")) + 1
    return j.select(
        "uid_a", "uid_b", "chars", tx.slice_text("_ka", F.col("a"), F.col("chars")).alias("text"),
        F.get("_oa", F.col("a").cast("int")).alias("a_start"), end("_oa", "a").alias("a_end"),
        F.get("_ob", F.col("b").cast("int")).alias("b_start"), end("_ob", "b").alias("b_end"),
    )


def longest_run(found: DataFrame) -> DataFrame:
    """Longest shared run per pair."""
    return found.groupBy("uid_a", "uid_b").agg(F.max("chars").alias("longest_shared_run"))


def confirm(near: DataFrame, windows: DataFrame, docs: DataFrame, size: int = DEFAULT_WINDOW, min_run: int = 4, cls: str = tx.HAN) -> DataFrame:
    """Neighbours told apart: verbatim reuse within the two windows, or only a likeness."""
    texts = window_text(windows, docs, size).filter("status = 'ok'").select(F.col("idx").cast("string").alias("uid"), "text")
    ask = near.select(F.col("idx").cast("string").alias("uid_a"), F.col("near_idx").cast("string").alias("uid_b")).distinct()
    best = longest_run(maximal_runs(texts, ask, min_run, cls))
    j = near.withColumn("uid_a", F.col("idx").cast("string")).withColumn("uid_b", F.col("near_idx").cast("string"))
    return j.join(best, ["uid_a", "uid_b"], "left").drop("uid_a", "uid_b").withColumn(
        "longest_shared_run", F.coalesce("longest_shared_run", F.lit(0))
    ).withColumn("kind", F.when(F.col("longest_shared_run") > 0, "verbatim reuse").otherwise("semantic candidate"))


def method_report(verdict_rows: DataFrame, near: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Per unit: both vocabularies' verdicts, the nearest unit over all its windows, and the nearest
    match of its first window with the longest run they share (T19)."""
    words = verdict_rows.filter("feature_set <> 'both'").groupBy("uid").agg(
        *[F.max(F.when(F.col("feature_set") == s, F.col(c))).alias(f"{s}_{c}") for s in ("curated", "generic") for c in ("first", "margin", "distinct")]
    )
    tally = nearest_tally(near, "near_uid", 1).select("uid", F.col("nearest").alias("nearest_unit"), F.col("n").alias("nearest_windows"))
    first = confirmed.filter("rank = 1").groupBy("uid").agg(
        F.min_by(F.struct("start", "near_uid", "near_start", "cosine", "longest_shared_run"), F.struct("start", "idx")).alias("w"),
        F.count_distinct("idx").alias("windows"),
    ).select("uid", "windows", F.col("w.start").alias("example_start"), F.col("w.near_uid").alias("example_uid"), F.col("w.cosine").alias("cosine"), F.col("w.longest_shared_run").alias("longest_shared_run"))
    return words.join(first, "uid").join(tally, "uid", "left")
