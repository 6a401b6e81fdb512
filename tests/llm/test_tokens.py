import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vidimus.llm import bpe, packing

ODD = [
    None, "", "  \n", "<|endoftext|>hi<|startoftext|> a<|endoftext|", "a" * 3000, "!" * 3000, "İstanbul ΣΑΣ ΟΣ ﬁ ½ ²x³ é", "don't I'LL we've 've''s 'l x'r",
    "日本語テキスト 한국어 ١٢٣ \U0001f389 \x1c\x1d x　y\x85z\xa0q", "x\x00y\x7f", "ªºµß ÿ ÀÉ ×÷", "a_b-c__d", "'s", "'", "it's'", "12'3 É'S",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def noise(n, seed=5):
    rnd = random.Random(seed)
    pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), 39, 115, rnd.randrange(9, 256), rnd.randrange(160, 700), rnd.randrange(0x4E00, 0x4F00), 32]))
    latin = lambda: chr(rnd.choice([rnd.randrange(32, 127), 39, 115, 108, rnd.randrange(9, 256), 32, 32]))
    return ["".join((latin if k % 2 else pick)() for _ in range(60)) for k in range(n)]


def test_round_trip_equals_the_library(spark, library):
    texts = ODD + noise(200)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1), (0, None, "x", 1)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.round_trip(df).collect()
    assert len(rows) == len(texts) + 2
    got = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), " ".join(map(str, ids)))
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    arrays = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert arrays[3] == library.encode(texts[3], add_special_tokens=False).ids
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[3] == got[3]["decoded"] and back[1] == ""
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_tables_of_known_words_do_not_change_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "ARENA", 64)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 8)
    monkeypatch.setattr(bpe, "PART", 40)
    small = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    for t in noise(60, 9):
        ids, n = small.encode([t, None, t])
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]


def test_a_new_word_takes_the_slot_of_a_known_word_of_its_batch(monkeypatch, library):
    monkeypatch.setattr(bpe, "SLOT_BITS", 6)
    monkeypatch.setattr(bpe, "SLOTS", 1 << 6)
    coder, rnd = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    for at in range(0, 400, 20):
        texts = [" ".join(words[max(at - 20, 0) : at + 20]), words[at]]
        ids, n = coder.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(ids, n[:1])] == want


def test_every_character_as_in_the_library(library):
    points = [c for c in [*range(0x3400), *range(0x9F00, 0xAC40), *range(0xD700, 0xD800), *range(0xF900, 0x20010), *range(0x323A0, 0x33500), *range(0xE0000, 0xE0200)]]
    coder = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(f"a{chr(c)}1!{chr(c)}? e{chr(c)}\u0323\u0301 " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["\u2019 'l", "\u2019 'll", "\u2019 'r", "\u2019'"]
    ids, n = coder.encode(texts)
    for t, got, want in zip(texts, np.split(ids, np.cumsum(n)[:-1]), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, t


def test_long_words_with_structure_are_told_apart(library):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1 << 12))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    ids, n = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json")).encode(texts)
    assert [x.tolist() for x in np.split(ids, n[:1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + lengths[i] <= capacity:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, bins + [lengths[i]])

    place(0, [])
    return best if lengths else 0


def test_reduction_keeps_an_optimal_packing():
    for seed in range(120):
        rng = np.random.default_rng(seed)
        capacity, n = int(rng.integers(4, 24)), int(rng.integers(0, 9))
        lengths = rng.integers(1, capacity + 1, n).tolist()
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        fixed = packing.reduce_instance(count, capacity)
        rest = [w for w in range(capacity + 1) for _ in range(count[w])]
        assert all(sum(w * k for w, k in items) <= capacity for items, _ in fixed)
        assert sorted(rest + [w for items, m in fixed for w, k in items for _ in range(k * m)]) == sorted(lengths)
        assert sum(m for _, m in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)


def test_best_fit_places_every_item():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 65, int(rng.integers(0, 400)))
        bins = packing.plan_bins({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}, 64)
        assert sorted(w for items, m in bins for w, k in items for _ in range(k * m)) == sorted(lengths.tolist())
        least = max(-(-int(lengths.sum()) // 64), int((lengths > 32).sum()))  # no two of these share a bin
        assert sum(m for _, m in bins) <= 11 / 9 * least + 1


def test_packed_documents(spark, library):
    texts = ODD + noise(80) + ["many words here " * k for k in (50, 100, 400, 900)] + ["many words here"] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in rows], "doc_id long, text string, length int, offset int").repartition(3)
    capacity = 256
    out = packing.pack_documents(df, capacity=capacity).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:5] for r in out], key=key) == sorted(want, key=key)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_pieces_of_newer_characters_and_of_words_at_the_end(spark, library):
    texts = ["a\u05581!\u0558?", "\u2019 'l", "x\U00011dbey " * 900, "\ua7cb\u1c89" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in packing.pack_documents(df).collect()) == want


def test_digests_of_the_query(spark, library, tmp_path):
    from vidimus.llm.queries import QUERIES

    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op6_bpe_rounds"](spark, str(tmp_path)).collect():
        ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
