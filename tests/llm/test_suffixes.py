"""Suffix arrays by linear grouping, repeated windows, and the operator against brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vidimus.llm import suffixes


def _ranks(s):
    order = sorted(range(len(s)), key=lambda i: s[i:])
    return [order.index(i) for i in range(len(s))]


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(5)
    for _ in range(400):
        s = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 40))]
        dense = {v: i + 1 for i, v in enumerate(sorted(set(s)))}
        s = [dense[v] for v in s] + [0]
        assert suffixes.suffix_array(np.array(s)).tolist() == _ranks(s)


@pytest.mark.parametrize("letters", [b"ab ", b"abcdefgh ", b"a\0 \xff", b"abcdefghijklmnop", b"a"])
def test_repeated_windows_are_all_found(letters):
    rng = random.Random(7)
    for _ in range(150):
        width = rng.choice([8, 9, 12, 20])
        base = bytes(rng.choice(letters) for _ in range(100))
        segments = [base[rng.randint(0, 30) :][: width + rng.randint(0, 40)] for _ in range(rng.randint(1, 8))]
        weights = np.array([rng.choice([1, 1, 1, 2]) for _ in segments])
        seen = Counter(s[i : i + width] for s in segments for i in range(len(s) - width + 1))
        want = {(j, i) for j, s in enumerate(segments) for i in range(len(s) - width + 1) if weights[j] > 1 or seen[s[i : i + width]] > 1}
        of, first, last = suffixes.repeated_windows(segments, weights, width)
        assert {(int(x), i) for x, f, t in zip(of, first, last) for i in range(f, t + 1)} == want


def _brute(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        gone = gone[: len(t)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()


def _texts(rng):
    words = ["".join(rng.choice("abcdeß ,.\n") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(60) for _ in range(3)]
    out = [prose(rng.randint(0, 120)) for _ in range(12)]
    out += [prose(rng.randint(0, 40)) + shared[i % 3] + prose(rng.randint(0, 40)) for i in range(9)]
    out += [shared[0][:90], shared[0][:101] + "x" + shared[0][101:], "q" * 5000, "ab" * 900, "ab" * 300, out[0], "", None, None, "\x00" * 300, "short", "long" + "z" * 70_000]
    return out


@pytest.mark.parametrize("hot", [1 << 20, 1500, 1])
def test_operator_against_brute_force(spark, hot):
    """The same with no anchor, some anchors and all anchors held to be crowded."""
    texts = _texts(random.Random(3))
    docs = spark.createDataFrame([(i if i % 7 else 7, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, anchor string, row int")
    got = suffixes.remove_repeats(docs.repartition(3), width=100, batch=4000, hot=hot).collect()
    want = list(_brute([(t or "").encode() for t in texts], 100))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((i if i % 7 else 7, *w) for i, w in enumerate(want))
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_odd_tables(spark):
    kind = "doc_id long, text string"
    assert suffixes.remove_repeats(spark.createDataFrame([], kind)).collect() == []
    same = "word " * 50 + "end"
    got = suffixes.remove_repeats(spark.createDataFrame([(None, same), (None, same), (1, None), (1, same[:199])], kind)).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == [(0, 0), (199, 0), (253, 253), (253, 253)]


def test_equal_segments_of_an_anchor_are_not_fetched(spark, monkeypatch):
    """Texts that only repeat as a whole need no suffix array; one text more that shares a part of them does."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    copies = [prose(60), prose(80)]
    asked, fetch = [], suffixes._fetch
    monkeypatch.setattr(suffixes, "_fetch", lambda table, chosen, width: asked.append(chosen.count()) or fetch(table, chosen, width))
    for texts, any_asked in ((copies * 3, False), (copies * 2 + [prose(30) + copies[0][50:300] + prose(30)], True)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect()}
        assert got == dict(enumerate(_brute([t.encode() for t in texts], 200)))
        assert (asked.pop() > 0) == any_asked
