"""Hard negatives against brute force: ties, repeated rows, odd vectors; bounds of segment summaries."""
import math
import random

import numpy as np
import pytest

from vidimus.llm import negatives


def _brute(rows, every):
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        if any(abs(x) >= 2.0**23 for x in vector) or sum(x * x for x in q) >= 2**56:
            continue
        kept.append((key, (label + 1) % 10 if key is not None and key % 7 == 0 else label, q))
    out = []
    rank = lambda c: (-c[0], c[1] is None, c[1] or 0)
    for i, (key, label, q) in enumerate(kept):
        if key is None or key % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), k, own == label) for j, (k, own, v) in enumerate(kept) if j != i]
        positives = sorted((c for c in scored if c[2]), key=rank)[:5]
        for score, name, _ in positives:
            fit = [c for c in scored if not c[2] and 50 * score <= 100 * c[0] <= 95 * score]
            out += [(key, name, r + 1, c[1], score, c[0]) for r, c in enumerate(sorted(fit, key=rank)[:3])]
    return sorted(out, key=repr)


def _rows(seed, n, wide):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(wide)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.randint(0, 3)) for i in range(n)]
    rows += [rows[5], rows[0], rows[12], (None, rows[3][1], 1), (None, rows[3][1], 2), (n, None, 1), (n + 1, [0.1] * wide, None), (n + 2, [None] * wide, 1)]
    rows += [(n + 3, [float("nan")] * wide, 1), (n + 4, [float("inf")] * wide, 1), (n + 5, [1e30] * wide, 1), (n + 6, [], 1), (n + 7, [0.3] * (wide // 2), 2), (n + 8, [9e5] * wide, 0)]
    return rows + [(n + 10 + i, [0.25] * wide, i % 3) for i in range(30)]


@pytest.mark.parametrize("wide", [5, 64])
def test_against_brute_force(spark, wide, monkeypatch):
    rows = _rows(wide, 160, wide)
    table = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, anchor string, row int").repartition(3)
    for tile in (8192, 20):
        monkeypatch.setattr(negatives, "TILE_ANCHORS", tile)
        monkeypatch.setattr(negatives, "TILE_ROWS", 2 * tile)
        got = negatives.hard_negatives(table, every=4).collect()
        assert sorted((tuple(r) for r in got), key=repr) == _brute(rows, 4)


def test_steps_prune_and_lose_nothing(monkeypatch):
    """Many small steps, so that thresholds from earlier steps act."""
    rng = np.random.default_rng(2)
    q = rng.integers(-200, 200, (300, 16)) + np.repeat(rng.integers(-300, 300, (300, 4)), 4, axis=1)
    import pyarrow as pa

    mean, dev = negatives.summaries(q)
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.array(x.ravel()).type))
    table = pa.table({"row": np.arange(300), "vec_id": np.arange(300), "label": rng.integers(0, 3, 300), "q": lists(q), "mean": lists(mean), "dev": lists(dev)})
    monkeypatch.setattr(negatives, "STEP_ANCHORS", 7)
    monkeypatch.setattr(negatives, "STEP_ROWS", 11)
    got = negatives._tile_positives(table, table).to_pylist()
    score, label = q @ q.T, table["label"].to_numpy()
    for a in range(300):
        want = sorted((-score[a, j], j) for j in range(300) if j != a and label[j] == label[a])[:5]
        assert sorted((-g["positive_score"], g["positive_id"]) for g in got if g["anchor"] == a) == want


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    q = rng.integers(-300, 300, (40, 32))
    mean, dev = negatives.summaries(q)
    at, gaps = 0, []
    for size in negatives.levels(32):
        k = slice(at, at + 32 // size)
        at = k.stop
        mid, off = mean[:, k] @ mean[:, k].T, dev[:, k] @ dev[:, k].T
        assert (np.abs(q @ q.T - mid) <= off + 1e-6).all()
        gaps.append(off.mean())
    assert gaps == sorted(gaps, reverse=True)


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (1, [1.0], 1)], [(50, None, 1), (50, [], None)]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, kind)).collect() == []
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)], kind)).collect()] == [(50, 1, 1, 2, 65536, 49152)]
