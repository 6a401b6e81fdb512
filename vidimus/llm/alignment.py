"""Two tokenizers side by side: groups of tokens that cover the same bytes, and how usual each link is.

Tokens of the two overlap where their byte ranges do. The links of all documents form an inverted index:
for each pair of ids a bitmap of the documents that hold it, in words of 64 documents of which only those
with a bit are kept, and further planes of the same form for the binary digits of how often a document
holds it. Batches of documents are OR-merged into containers of bounded size. The number of set bits is
the number of documents; the planes give the number of links. Counts of all containers are added up by
pair, compared within an A id, and handed back to each container, whose postings return the scores.
"""
from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.bpe import byte_symbols
from vidimus.llm.common import raw, sliced

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_BITS = 16  # of a pair's code below the A id
MOST_DOCS = 1 << 12  # of a container: 64 words of 64 documents
MOST_POSTINGS = 1 << 20  # of a container before it is closed


# ---- tokenizers

def _table(tokens: list[bytes]) -> pa.Array:
    return pa.array(tokens, pa.large_binary())


def _numbered(n: int, seps: tuple[bytes, bytes]) -> pa.Array:
    """Decimal ids, each with either separator behind it: at 2 * id and 2 * id + 1."""
    return _table([b"%d%s" % (i, s) for i in range(n) for s in seps])


class Tokenizers:
    """Both vocabularies, the bytes of each token, and batch encoding into flat arrays."""

    def __init__(self, a_path: str | None, b_path: str | None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path or public_tokenizers.path(A_VOCABULARY), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = {c: i for i, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # ranks are ids here; equal to the tokenizers library's encoding, which the tests check
        self._a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = {i: t for t, i in ranks.items()}
        self.a_bytes = _table([names.get(i, b"") for i in range(max(names) + 1)])
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_VOCABULARY))
        n = self._b.get_piece_size()
        self.b_bytes = _table([bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self._b.id_to_piece, range(n)))])
        #: decimal ids with what stands behind them in a written group; B ids follow the A ids
        self.written = pa.concat_arrays([_numbered(len(self.a_bytes), (b",", b"|")), _numbered(n, (b",", b";"))])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self._a.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int32) for t in texts]
        return a, [np.array(ids, np.int32) for ids in self._b.encode(texts, num_threads=1)] if texts else []


@functools.lru_cache(2)
def load(a_path: str | None, b_path: str | None) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _spelled(ids: np.ndarray, table: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens in one buffer, and where each token ends there."""
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    return memoryview(taken.buffers()[2] or b"").cast("B"), ends


def _whole(ids: list[np.ndarray], table: pa.Array, texts: list[bytes]) -> tuple[list[bool], list[np.ndarray]]:
    """Whether each text is its tokens' bytes behind one another, and the tokens' ends in each text."""
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    data, ends = _spelled(flat, table)
    at = np.cumsum([0, *(len(x) for x in ids)])
    same = [data[ends[i] : ends[j]] == t for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)]
    return same, [ends[i + 1 : j + 1] - ends[i] for i, j in zip(at[:-1], at[1:])]


class Aligned:
    """Aligned tokens of a batch: counts and written groups per text, links as flat arrays."""

    def __init__(self, tok: Tokenizers, texts: list[str | None]):
        full = [b" " + raw(t) for t in texts]
        asked = [i for i, t in enumerate(texts) if t]
        a, b = tok.encode([texts[i] for i in asked])
        a_same, a_ends = _whole(a, tok.a_bytes, [full[i] for i in asked])
        b_same, b_ends = _whole(b, tok.b_bytes, [full[i] for i in asked])
        good = [k for k in range(len(asked)) if a_same[k] and b_same[k]]
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.sha = [""] * n
        self.doc, self.pair = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not good:
            return
        which = np.array([asked[k] for k in good])
        size = np.array([len(full[i]) for i in which], np.int64)
        start = np.cumsum(size) - size
        a_n, b_n = (np.array([len(x[k]) for k in good], np.int64) for x in (a, b))
        a_id, b_id = np.concatenate([a[k] for k in good]), np.concatenate([b[k] for k in good])
        a_end = np.concatenate([a_ends[k] for k in good]) + np.repeat(start, a_n)
        b_end = np.concatenate([b_ends[k] for k in good]) + np.repeat(start, b_n)
        a_cut, b_cut = np.zeros(size.sum() + 1, bool), np.zeros(size.sum() + 1, bool)
        a_cut[a_end] = True
        b_cut[b_end] = True
        common = np.flatnonzero(a_cut & b_cut)
        # an overlap of an A and a B token ends at every place where one of them ends
        ends = np.flatnonzero(a_cut | b_cut)
        a_of = np.cumsum(a_cut)[ends] - a_cut[ends]
        b_of = np.cumsum(b_cut)[ends] - b_cut[ends]
        self.pair = a_id[a_of].astype(np.int64) << B_BITS | b_id[b_of]
        behind = start + size
        links, groups = np.searchsorted(ends, behind, "right"), np.searchsorted(common, behind, "right")
        for to, value in ((self.n_a, a_n), (self.n_b, b_n), (self.n_links, np.diff(links, prepend=0)), (self.n_groups, np.diff(groups, prepend=0))):
            to[which] = value
        self.doc = np.repeat(which, self.n_links[which])
        # written order: the A ids of a group, its B ids, the next group
        last = a_cut & b_cut
        group_a, group_b = (np.cumsum(last) - last)[a_end], (np.cumsum(last) - last)[b_end]
        a_upto, b_upto = np.searchsorted(a_end, common, "right"), np.searchsorted(b_end, common, "right")
        place_a = np.arange(len(a_id)) + np.r_[0, b_upto][group_a]
        place_b = np.arange(len(b_id)) + a_upto[group_b]
        order = np.empty(len(a_id) + len(b_id), np.int64)
        order[place_a] = 2 * a_id.astype(np.int64) + last[a_end]
        order[place_b] = 2 * (b_id.astype(np.int64) + len(tok.a_bytes)) + last[b_end]
        data, written = _spelled(order, tok.written)
        upto = written[np.cumsum(a_n + b_n)]
        for i, begin, end in zip(which.tolist(), [0, *upto[:-1].tolist()], upto.tolist()):
            self.sha[i] = hashlib.sha256(data[begin : end - 1]).hexdigest()


# ---- containers

def build(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Distinct pairs, ascending, their numbers of documents and links, and the packed bitmaps, of
    postings (pair, document number in the container, how often)."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order], times[order]
    word = pair << 6 | doc >> 6
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    bit = np.uint64(1) << (doc & 63).astype(np.uint64)
    merged = lambda keep: np.bitwise_or.reduceat(np.where(keep, bit, np.uint64(0)), first) if len(first) else np.zeros(0, np.uint64)
    planes = [merged(np.ones(len(bit), bool))] + [merged(times >> k & 1 == 1) for k in range(int(times.max(initial=0)).bit_length())]
    head = np.flatnonzero(np.r_[True, pair[first][1:] != pair[first][:-1]]) if len(first) else first
    ones = np.stack([np.bitwise_count(p).astype(np.int64) for p in planes])
    sums = np.add.reduceat(ones, head, axis=1) if len(head) else ones[:, :0]
    links = (sums[1:] << np.arange(len(planes) - 1)[:, None]).sum(0)
    parts = [np.diff(np.r_[head, len(first)]).astype(np.uint8), (word[first] & 63).astype(np.uint8)]
    blob = np.array([len(head), len(first), len(planes)], "<i8").tobytes() + b"".join(p.tobytes() for p in parts)
    for p in planes:
        there = p != 0
        blob += np.packbits(there).tobytes() + p[there].tobytes()
    return pair[first][head], sums[0], links, blob


def postings(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the pair in the container, document number, how often) of what build() has packed."""
    n, words, planes = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    per_pair, place = (np.frombuffer(blob, np.uint8, k, o).astype(np.int64) for k, o in ((n, at), (words, at + n)))
    at += n + words
    bits = []
    for _ in range(planes):
        there = np.unpackbits(np.frombuffer(blob, np.uint8, -(-words // 8), at), count=words).astype(bool)
        at += -(-words // 8)
        full = np.zeros(words, "<u8")
        full[there] = np.frombuffer(blob, "<u8", int(there.sum()), at)
        at += 8 * int(there.sum())
        bits.append(full)
    pair_of = np.repeat(np.arange(n), np.where(per_pair == 0, 256, per_pair))
    spread = lambda w: np.unpackbits(w.view(np.uint8), bitorder="little").astype(bool)
    pairs, docs, times = [], [], []
    for s in range(0, words, 1 << 14):
        part = slice(s, s + (1 << 14))
        set_bits = np.flatnonzero(spread(bits[0][part]))
        w = s + (set_bits >> 6)
        pairs.append(pair_of[w])
        docs.append(place[w] << 6 | set_bits & 63)
        times.append(sum((spread(p[part])[set_bits].astype(np.int64) << k for k, p in enumerate(bits[1:])), np.zeros(len(set_bits), np.int64)))
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (pairs, docs, times))


_CONTAINER = (
    "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pair array<long>, docs array<long>, links array<long>, packed binary"
)
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NAMES = [c.split()[0] for c in _CONTAINER.split(", ")]


def _one(values, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def containers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The index: one written row for each container, its documents beside its pairs and bitmaps."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(a_path, b_path)
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            pair, docs, links, blob = build(*(np.concatenate([h[k] for h in held]) for k in (0, 1, 2)))
            meta = [np.concatenate([h[k] for h in held]) for k in (4, 5, 6, 7)]
            lists = [_one(pa.concat_arrays([h[3] for h in held]), pa.int64()), *(_one(m, pa.int64()) for m in meta), _one([s for h in held for s in h[8]], pa.string())]
            return pa.RecordBatch.from_arrays([*lists, *(_one(x, pa.int64()) for x in (pair, docs, links)), pa.array([blob], pa.binary())], _NAMES)

        n_docs = n_postings = 0
        for b in sliced(batches):
            got = Aligned(tok, b.column(1).to_pylist())
            code, times = np.unique(got.pair << 8 | got.doc, return_counts=True)
            if held and (n_docs + b.num_rows > MOST_DOCS or n_postings + len(code) > MOST_POSTINGS):
                yield close()
                held, n_docs, n_postings = [], 0, 0
            held.append((code >> 8, (code & 255) + n_docs, times, b.column(0), got.n_a, got.n_b, got.n_groups, got.n_links, got.sha))
            n_docs += b.num_rows
            n_postings += len(code)
        if held:
            yield close()

    table = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _CONTAINER)
    return cut_lineage(table.withColumn("container", F.monotonically_increasing_id()))


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links) over all containers; a pair's code is A id << 16 | B id."""
    listed = index.select(F.explode(F.arrays_zip("pair", "docs", "links")).alias("p")).select("p.*")
    return listed.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document.

    A text takes part if it is not empty and both tokenizers spell it byte for byte behind one space;
    others (null ones too) have zeros and an empty `groups_sha256`. Every row counts as a document of
    its own, repeated rows and null ids too. A text is encoded whole, in one task, with some 40 bytes of
    memory a token. An empty table gives no rows; other columns are not read.
    """
    index = containers(docs, a_path, b_path)
    counts = cut_lineage(pair_counts(index))
    best = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n_docs").alias("most"))
    marked = counts.withColumn("a", F.shiftright("pair", B_BITS)).join(best, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    asked = index.select("container", F.explode("pair").alias("pair")).join(marked, "pair")

    def score(box: pa.Table, found: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _DOC.split(", ")]
        kinds = [pa.string() if n == "groups_sha256" else pa.int64() for n in names]
        if not box.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        row = {n: box[n].combine_chunks().flatten() for n in _NAMES[:6]}
        n = len(row["doc_id"])
        order = pc.sort_indices(found["pair"])
        count, top = (found[c].take(order).to_numpy() for c in ("n_docs", "best"))
        of, doc, times = postings(box["packed"][0].as_py())
        sums = np.zeros((2, n), np.int64)
        np.add.at(sums[0], doc, times * top[of])
        np.add.at(sums[1], doc, times * count[of])
        return pa.table([row[c] if c in row else pa.array(sums[0 if c == "n_best" else 1]) for c in names], names)

    boxes = index.drop("pair", "docs", "links").withColumnRenamed("container", "box")
    return boxes.groupBy("box").cogroup(asked.groupBy("container")).applyInArrow(score, _DOC)
