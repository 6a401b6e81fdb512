import math
import zlib
from collections import Counter

import pytest

from vidimus.llm import lm


def katz(docs):
    """The same model, spelled out with dictionaries."""
    split = lambda t: [w.decode("utf-8") for w in (t or "").encode().lower().split()] + ["\n"]
    rows = [(i, split(t), i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in docs]
    uni, big, ctx = Counter(), Counter(), Counter()
    for _, ws, held in rows:
        if not held:
            uni.update(ws)
            for h, w in zip([None, *ws], ws):
                big[h, w] += 1
                ctx[h] += 1
    d1 = lm.discounts([sum(v == r for v in uni.values()) for r in range(1, 7)])
    d2 = lm.discounts([sum(v == r for v in big.values()) for r in range(1, 7)])
    n = sum(uni.values())
    cut = lambda c, d: c * (d[c] if c <= lm.K else 1.0)
    left = sum(c - cut(c, d1) for c in uni.values())
    whole, left = (n, left) if left > 0 else (n + 0.5, 0.5)
    p1 = lambda w: (cut(uni[w], d1) if w in uni else left) / whole

    def p2(h, w):
        if ctx[h] == 0:
            return p1(w)
        after = {b: c for (a, b), c in big.items() if a == h}
        rest = sum(c - cut(c, d2) for c in after.values())
        total, rest = (ctx[h], rest) if rest > 0 else (ctx[h] + 0.5, 0.5)
        if w in after:
            return cut(after[w], d2) / total
        return rest / total / (1 - sum(p1(b) for b in after)) * p1(w)

    out = {}
    for i, ws, held in rows:
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in ws)
        out[i] = (held, len(ws), sum(w in uni for w in ws), n, base, sum(math.log10(p2(h, w)) for h, w in zip([None, *ws], ws)))
    return out, p2, uni, ctx


DOCS = [(i, " ".join(["the cat", "The dog", "a cat sat", "on the mat", "the end"][(i * k) % 5] for k in range(1, 2 + i % 7)) + (f" rare{i}" if i % 3 else "")) for i in range(60)]
DOCS += [(100, None), (101, ""), (102, " \t\n "), (103, "unseen words only here"), (1, "the cat"), (207, "naïve É é the"), (None, "the mat"), (200, "the " * 3000)]


@pytest.mark.parametrize("split, block_bytes", [(lm.SPLIT, lm.BLOCK_BYTES), (3, 200)])
def test_scores_equal_the_plain_model(spark, split, block_bytes):
    rows = [(i, t, "x", 1.0) for i, t in DOCS]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, score double").repartition(3)
    got = lm.score_texts(df, buckets=3, split=split, block_bytes=block_bytes).collect()
    assert len(got) == len(DOCS)
    want, *_ = katz(DOCS)
    for r in got:
        if r["doc_id"] == 1:
            continue  # two texts share this id
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-9)


def test_probabilities_behind_each_context_sum_to_one():
    _, p2, uni, ctx = katz(DOCS)
    for h in list(ctx)[:12] + ["never"]:
        assert sum(p2(h, w) for w in [*uni, "<unknown>"]) == pytest.approx(1)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(empty).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert rows[0]["n_known"] == 0 and rows[0]["score"] == 0.0


def test_one_word_of_a_megabyte_beside_many(spark):
    words = [f"w{i}" for i in range(20_000)]
    rows = [(i, " ".join(words[i * 500 : i * 500 + 500])) for i in range(40)] + [(900, "x" * 1_000_000 + " w1"), (901, "y" * 1_000_000)]
    got = {r["doc_id"]: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), buckets=1).collect()}
    assert len(got) == len(rows) and got[900]["n_tokens"] == 3 and all(math.isfinite(r["score"]) for r in got.values())


def test_buckets_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 10)
    seen = []
    code = lm._code
    monkeypatch.setattr(lm, "_code", lambda buckets, size: seen.append(buckets) or code(buckets, size))
    assert lm.score_texts(spark.createDataFrame([(1, "a" * 55), (2, None)], "doc_id long, text string")).count() == 2
    assert seen == [6]
