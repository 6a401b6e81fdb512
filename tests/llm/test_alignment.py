"""Two tokenizers side by side, against the libraries and a plain count of links."""
import hashlib
import random
from collections import Counter

import numpy as np

from vidimus.llm import alignment


def _tokenizers():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def _brute(texts):
    from vidimus.llm.bpe import byte_symbols

    byte = {c: i for i, c in enumerate(byte_symbols())}
    a, b = _tokenizers()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a_ids, b_ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes)]
        links, j = [], 0
        for i, end in enumerate(ends[0]):
            while True:
                links.append((a_ids[i], b_ids[j]))
                if ends[1][j] > end:
                    break
                j += 1
                if ends[1][j - 1] == end:
                    break
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for c in common:
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, es) if before < e <= c) for ids, es in zip((a_ids, b_ids), ends)))
            before = c
        docs.append((len(a_ids), len(b_ids), len(groups), links, ";".join(groups)))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    for d in docs:
        if d is None:
            yield (0,) * 6 + ("",)
        else:
            yield d[0], d[1], d[2], len(d[3]), sum(count[p] == most[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest()


def _texts():
    rng = random.Random(4)
    words = "the tokenizer splits strangely größer 日本語 2048 don't  <|endoftext|> <s> </s> <0x41> ▁ \n\n \t  naïve 😀 ---- ==".split(" ")
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    odd = ["", None, " ", "  two", "tail  ", "\n", "a", "a\x00b", "ﬁ ① Ａ", "é", "▁", "<|endoftext|>", "<s>", "x" * 5000, "ab " * 3000, "﻿q", "\U0010ffff", "\u0085 "]
    return prose + odd + prose[:3] + ["the"] * 20


def test_against_brute_force(spark, monkeypatch):
    texts = _texts()
    want = [(i if i % 5 else None, *w) for i, w in enumerate(_brute(texts))]
    docs = spark.createDataFrame([(i if i % 5 else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, pair long, container string").repartition(3)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] == 0 for w in want) < len(texts) / 2


def test_containers_hold_their_postings():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        code = np.unique(rng.integers(0, 200, n) << 12 | np.minimum(rng.integers(0, 4096, n), rng.integers(0, 4096, n)))
        pair, doc, times = code >> 12, code & 4095, rng.integers(1, 1000, len(code))
        shuffled = rng.permutation(len(code))
        pairs, n_docs, n_links, blob = alignment.build(pair[shuffled], doc[shuffled], times[shuffled])
        of, where, often = alignment.postings(blob)
        assert pairs.tolist() == np.unique(pair).tolist()
        assert n_docs.tolist() == [int((pair == p).sum()) for p in pairs] and n_links.tolist() == [int(times[pair == p].sum()) for p in pairs]
        assert sorted(zip(pairs[of].tolist(), where.tolist(), often.tolist())) == sorted(zip(pair.tolist(), doc.tolist(), times.tolist()))


def test_small_containers_add_up(spark, monkeypatch):
    texts = _texts()[:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tok = alignment.load(None, None)
    links = [p for i, t in enumerate(texts) for p in alignment.Aligned(tok, [t]).pair.tolist()]
    counts = {r["pair"]: (r["n_docs"], r["n_links"]) for r in alignment.pair_counts(alignment.containers(docs)).collect()}
    assert {p: n[1] for p, n in counts.items()} == dict(Counter(links))


def test_odd_tables(spark):
    kind = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(None, None), (None, "")], kind)).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2
