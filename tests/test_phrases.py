"""Phrase matching by automata and the stored phrase index, against plain containment."""
import random

import numpy as np
import pytest

from vidimus.operators import phrase_index as pi
from vidimus.operators import phrases as ph


def _texts(rng, letters, n, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def _made(seed):
    rng = random.Random(seed)
    texts = _texts(rng, "abc ", 60, 40) + _texts(rng, "天地玄黃😀", 20, 12) + ["", None, "x" * 5000, "\0a\0"]
    asked = _texts(rng, "abc", 30, 9) + _texts(rng, "天地😀", 10, 4) + ["  ", None, "a", "x" * 400, "\0a", "nowhere", texts[3], texts[3]]
    return texts, asked


@pytest.mark.parametrize("group", [1_000_000, 60, 1])
def test_phrases_match_what_texts_contain(spark, group):
    """The whole list in one automaton, a few phrases in each, one phrase in each."""
    texts, asked = _made(5)
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc BIGINT, span STRING, extra INT").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id BIGINT, query STRING")
    want = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(asked) if t and q and q.strip() and q in t}
    got = [(r["doc"], r["query_id"]) for r in ph.match_phrases(rows, "span", queries, group=group).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_phrases_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "abc")], "doc BIGINT, span STRING")
    none = spark.createDataFrame([], "query_id BIGINT, query STRING")
    assert ph.match_phrases(rows, "span", none).collect() == []
    assert ph.match_phrases(rows.limit(0), "span", spark.createDataFrame([(1, "b")], none.schema)).collect() == []


def test_postings_decode_to_every_place():
    rng = random.Random(2)
    texts = _texts(rng, "abé天😀\0", 300, 30)
    grams, n, places = pi.encode_segment(texts)
    want = {}
    for i, t in enumerate(texts):
        code = [ord(c) + 1 for c in t] + [0, 0]
        for k in range(len(t)):
            want.setdefault(code[k] << 42 | code[k + 1] << 21 | code[k + 2], []).append((i, k))
    assert sorted(want) == grams.tolist()
    for g, count, data in zip(grams.tolist(), n.tolist(), places.to_pylist()):
        span, offset = pi.decode(data)
        assert list(zip(span.tolist(), offset.tolist())) == want[g] and len(want[g]) == count


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 31])
    data, ends = pi.varints(v)
    assert pi.unvarints(data.tobytes()).tolist() == v.tolist() and ends[-1] == len(data)
    assert len(pi.unvarints(b"")) == 0


def test_index_built_in_parts_finds_what_spans_contain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pi, "SEGMENT_CHARS", 300)
    texts, asked = _made(9)
    spans = [(f"d{i // 3}", i % 3, t) for i, t in enumerate(texts)]
    frame = lambda rows: spark.createDataFrame(rows, "doc STRING, span_no INT, span STRING").repartition(2)
    root = str(tmp_path / "index")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id BIGINT, query STRING")
    assert pi.search_index(spark, root, queries).collect() == []
    cut = 3 * (len(spans) // 6)
    first = {r["build"]: r["documents"] for r in pi.add_spans(frame(spans[:cut]), root).collect()}
    # the second call brings the first documents again: only new ones are added
    both = {r["build"]: r["documents"] for r in pi.add_spans(frame(spans), root).collect()}
    assert first == {0: cut // 3} and set(both) == {0, 1} and sum(both.values()) == len({d for d, _, t in spans if t})
    want = {}
    for d, no, t in spans:
        for j, q in enumerate(asked):
            if t and q and q.strip() and q in t:
                want[(j, d)] = min(want.get((j, d), (no, t)), (no, t))
    got = {(r["query_id"], r["doc"]): (r["span_no"], r["span"]) for r in pi.search_index(spark, root, queries).collect()}
    assert got == want
    # a build without its row in `builds` is never read
    spark.read.parquet(f"{root}/spans/build=0").write.parquet(f"{root}/spans/build=7")
    assert {(r["query_id"], r["doc"]): (r["span_no"], r["span"]) for r in pi.search_index(spark, root, queries).collect()} == want


def test_long_phrases_of_a_long_list_are_found_by_anchors(spark, monkeypatch):
    rng = random.Random(12)
    texts = _texts(rng, "ab ", 40, 300) + _texts(rng, "天地😀", 20, 90) + ["x" * 900, "ab" * 200, None, "", "\0" * 40]
    cut = lambda t, n: t[(at := rng.randrange(len(t) - n + 1)) : at + n]
    asked = [cut(t, n) for t in texts if t for n in (31, 32, 33, 60, len(t)) if n <= len(t)] + ["b" * 33, "x" * 32, " " * 40, "ab" * 16, texts[0] + "!", None]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[1])], "doc BIGINT, span STRING").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id BIGINT, query STRING")
    dealt = []
    monkeypatch.setattr(ph, "_dealt", lambda r, t, p, g, deal=ph._dealt: dealt.append(p.selectExpr("max(length(__phrase))").first()[0]) or deal(r, t, p, g))
    got = sorted((r["doc"], r["query_id"]) for r in ph.match_phrases(rows, "span", queries, group=40).collect())
    want = sorted((i, j) for i, t in [*enumerate(texts), (0, texts[1])] for j, q in enumerate(asked) if t and q and q.strip() and q in t)
    assert got == want and all(n < ph.LONG for n in dealt)


def test_a_full_segment_is_encoded_in_bounded_memory():
    import tracemalloc

    texts = ["the quick brown fox jumps over a lazy dog %d" % i for i in range(pi.SEGMENT_CHARS // 44)]
    tracemalloc.start()
    pi.encode_segment(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20  # each core of an executor encodes one
