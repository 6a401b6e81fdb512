"""Katz back-off language model over a whole corpus, and the score of every text under it.

Texts are coded once, in blocks of consecutive rows with a vocabulary of their own. Blocks then ask
tables that are dealt by hash: first the word table (identifier and count of each word), then the pair
table (count of each pair of neighbours). A block asks once for each word and once for each pair it
holds, with its own training counts, so asking is counting, and what is shuffled is distinct n-grams
per block in packed, compressed arrays. Pairs of a very frequent first word are dealt by both words; the
sums that such a word needs are put together afterwards, so no bucket holds a third of the corpus.

Counts up to K are discounted by Good-Turing; what discounting leaves goes to words not seen behind
the context, in proportion to their own discounted probability, divided by what exactly these words
have: the probabilities behind each context sum to one over the vocabulary and one unknown word.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import scratch_path
from vidimus.functions.workers import ship
from vidimus.llm.common import fold, raw, sliced

FOLDS, HELD = 5, 1
K = 5
BUCKET_BYTES = 16 << 20  # of text for each hash bucket of the tables
BLOCK_BYTES = 16 << 20
SPLIT = 200_000  # a first word this frequent has its pairs dealt by both words
END_WORD = b"\n"  # no word can be white space
BEGIN, UNKNOWN, FIRST_ID = 0, 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)
PACKED = "kind string, block long, bucket int, p0 binary, p1 binary, p2 binary, p3 binary, p4 binary, p5 binary"
_NAMES = ["kind", "block", "bucket", "p0", "p1", "p2", "p3", "p4", "p5"]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def put(a: np.ndarray) -> bytes:
    """An array, compressed byte plane by byte plane."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def get(b: bytes) -> np.ndarray:
    kind, data = np.dtype(chr(b[0])), zstandard.ZstdDecompressor().decompress(b[1:])
    return np.frombuffer(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.tobytes(), kind)


def put_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words) + b" ")


def get_words(b: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(b).split(b" ")[:-1]


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*[r + (None,) * (len(_NAMES) - len(r)) for r in rows])) if rows else [[]] * len(_NAMES)
    kinds = [pa.string(), pa.int64(), pa.int32()] + [pa.binary()] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return ((a.astype(np.uint64) * MIX >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def tokens(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (A-Z lower-cased), and how many each text has."""
    data = [raw(t) for t in texts]
    flat = np.frombuffer(b" ".join([*data, b""]).lower(), np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[~space].tobytes())])
    return words, np.diff(np.r_[0, np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))])


def _code(buckets: int, block_bytes: int):
    """(doc_id, text, train) in; `text` rows (coded blocks) and `words` rows (what a block asks) out."""

    def flush(block, docs, known):
        ids, flags, n = (np.concatenate(x) for x in zip(*[d[:3] for d in docs]))
        codes = np.concatenate([d[3] for d in docs])
        learnt = np.bincount(codes[np.repeat((flags & 1).astype(bool), n)], minlength=len(known)).astype(np.uint32)
        words = list(known)
        of = _bucket(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64), buckets)
        rows = [("text", block, None, put(ids), put(flags), put(n), put(codes), put(of))]
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True])
        for a, b in zip(cut[:-1], cut[1:]):
            part = order[a:b]
            rows.append(("words", block, int(of[part[0]]), put_words([words[i] for i in part]), put(learnt[part])))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, docs, known = TaskContext.get().partitionId() << 32, 0, [], {END_WORD: 0}
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            words, n = tokens(texts)
            coded = words.dictionary_encode()
            place = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int32)
            codes = np.zeros(len(words) + len(texts), np.int32)  # the word behind each text is the end: 0
            inside = np.ones(len(codes), bool)
            inside[np.cumsum(n + 1) - 1] = False
            codes[inside] = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else 0
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            flags = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            docs.append((ids, flags, (n + 1).astype(np.int32), codes))
            size += sum(len(t) for t in texts if t)
            if size >= block_bytes:
                yield from flush(block, docs, known).to_batches()
                block, size, docs, known = block + 1, 0, [], {END_WORD: 0}
        if docs:
            yield from flush(block, docs, known).to_batches()

    return run


def _count_words(buckets: int):
    """One bucket of asked words in; identifiers and counts for each block, the table and sums out."""

    def run(key, asked):
        bucket = key[0].as_py()
        lists = [get_words(b) for b in asked["p0"].to_pylist()]
        coded = pa.array([w for part in lists for w in part], pa.binary()).dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        total = np.bincount(at, weights=np.concatenate([get(b) for b in asked["p1"].to_pylist()]), minlength=len(names)).astype(np.int64)
        seen = np.flatnonzero(total)
        ids = np.full(len(names), UNKNOWN, np.int64)
        ids[seen] = FIRST_ID + np.arange(len(seen)) * buckets + bucket
        if len(seen) and ids.max() >= 1 << 32:
            raise ValueError("word identifiers must stay below 2**32: use more buckets")
        rows, upto = [], 0
        for block, part in zip(asked["block"].to_pylist(), lists):
            own = at[upto : upto + len(part)]
            upto += len(part)
            rows.append(("ids", block, bucket, put(ids[own].astype(np.uint32)), put(total[own])))
        order = np.array(sorted(seen.tolist(), key=names.__getitem__), np.int64)  # a list: words may be of any length
        rows.append(("table", None, bucket, put_words([names[i] for i in order]), put(ids[order]), put(total[order])))
        end = int(total[names.index(END_WORD)]) if END_WORD in names else 0
        sums = [int(total.sum()), len(seen), end, *(int((total == r).sum()) for r in range(1, K + 2))]
        rows.append(("sums", None, bucket, put(np.array(sums, np.int64))))
        return _rows(rows)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factors for counts 0..K from the numbers of n-grams that occur 1..K+1 times.

    Where these numbers do not give a falling, positive discount (small corpora), half a count is
    taken off instead, so some mass is always left.
    """
    out = np.ones(K + 1)
    top = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        turing = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
        d = (turing - top) / (1 - top) if top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c > K, 1.0, d[np.minimum(c, K)]) * c


class Words:
    """The word level of the model: what every task needs of it, a few numbers."""

    def __init__(self, sums: np.ndarray):
        self.n, self.types, self.texts = (int(x) for x in sums[:3])
        self.d = discounts([int(x) for x in sums[3:]])
        left = float((sums[3 : 3 + K] * np.arange(1, K + 1) * (1 - self.d[1:])).sum())
        #: what discounting leaves; half a count where no word is rare enough to be discounted
        self.whole, self.left = (self.n, left) if left else (self.n + 0.5, 0.5)

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of words by their count; all words without a count are one unknown word."""
        return np.where(c > 0, _discounted(c, self.d), self.left) / self.whole

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.types + 1)))


def _block(text: dict, replies: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's words as identifiers, their counts, contexts, and the tokens of each text."""
    codes, of, n = get(text["p3"]), get(text["p4"]), get(text["p2"])
    order = np.argsort(of, kind="stable")
    ids, count = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    got = sorted((b, i, c) for b, i, c in replies)
    ids[order] = np.concatenate([get(i) for _, i, _ in got])
    count[order] = np.concatenate([get(c) for _, _, c in got])
    word = ids[codes]
    context = np.r_[BEGIN, word[:-1]]
    context[np.cumsum(n) - n] = BEGIN
    return word, count[codes], context, n


def _replies(table: pa.Table, kind: str) -> list[tuple]:
    return [(r["bucket"], r["p0"], r["p1"]) for r in table.select(["kind", "bucket", "p0", "p1"]).to_pylist() if r["kind"] == kind]


def _pairs(word, count, context, words: Words, buckets: int, split: int):
    """Distinct pairs (context, word) of a block by bucket: keys in order, bucket of each, its context's
    count, and whether that context is split; pairs behind an unknown word need no table."""
    ok = context != UNKNOWN
    keys, which = np.unique(context[ok].astype(np.uint64) << np.uint64(32) | word[ok].astype(np.uint64), return_inverse=True)
    h, w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count_of = np.zeros(len(keys), np.int64)
    # a context's count is the count of the word before; the begin of a text is as frequent as its end
    before = np.r_[0, count[:-1]]
    before[context == BEGIN] = words.texts
    count_of[which] = before[ok]
    shares = np.maximum(1, -(-count_of // split))
    salt = np.where(shares > 1, _bucket(w.astype(np.uint64) ^ np.uint64(0x5BD1E995), 1 << 30) % shares, 0)
    return ok, which, h, w, count_of, shares > 1, _bucket(h.astype(np.uint64) + salt.astype(np.uint64) * np.uint64(0x100000001B3), buckets)


def _ask_pairs(words: Words, buckets: int, split: int):
    def run(key, text, ids):
        rows, block = [], key[0].as_py()
        for t in text.to_pylist():
            word, count, context, n = _block(t, _replies(ids, "ids"))
            ok, which, h, w, c, hot, of = _pairs(word, count, context, words, buckets, split)
            train = np.repeat((get(t["p1"]) & 1).astype(bool), n)[ok]
            learnt = np.bincount(which[train], minlength=len(h)).astype(np.uint32)
            count_of = np.zeros(len(h), np.int64)
            count_of[which] = count[ok]
            order = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0, True])
            for a, b in zip(cut[:-1], cut[1:]):
                part = order[a:b]
                own, first = np.unique(w[part], return_index=True)
                heads = np.diff(np.r_[0, h[part]]).astype(np.uint32)
                rows.append(("pairs", block, int(of[part[0]]), put(heads), put(w[part].astype(np.uint32)), put(learnt[part]), put(own.astype(np.uint32)), put(count_of[part][first]), put(np.unique(h[part][hot[part]]))))
        return _rows(rows)

    return run


def _count_pairs(words: Words):
    """One bucket of asked pairs in; counts for each block, sums by context, and the table out.

    For a context: how many of its followers occur 1..K times, and the word-level probability of all
    its followers. Contexts that are split find only part of their sums here.
    """

    def run(key, asked):
        bucket, rows = key[0].as_py(), []
        parts = asked.to_pylist()
        heads = [np.cumsum(get(r["p0"]).astype(np.int64)) for r in parts]
        tails = [get(r["p1"]).astype(np.int64) for r in parts]
        keys, at = np.unique(np.concatenate(heads) << 32 | np.concatenate(tails), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([get(r["p2"]) for r in parts]), minlength=len(keys)).astype(np.int64)
        own, first = np.unique(np.concatenate([get(r["p3"]) for r in parts]).astype(np.int64), return_index=True)
        p1 = words.probability(np.concatenate([get(r["p4"]) for r in parts])[first])
        h, w, seen = keys >> 32, keys & 0xFFFFFFFF, total > 0
        context, of = np.unique(h, return_inverse=True)
        covered = np.bincount(of, weights=np.where(seen, p1[np.searchsorted(own, w)], 0.0), minlength=len(context))
        few = [np.bincount(of[total == r], minlength=len(context)).astype(np.uint32) for r in range(1, K + 1)]
        upto = 0
        for r, head in zip(parts, heads):
            place = np.searchsorted(context, np.unique(head))
            rows.append(("counts", r["block"], bucket, put(total[at[upto : upto + len(head)]].astype(np.uint32)), put(np.concatenate([f[place] for f in few])), put(covered[place])))
            upto += len(head)
        rows.append(("table", None, bucket, put(np.diff(np.r_[0, h[seen]]).astype(np.uint32)), put(w[seen].astype(np.uint32)), put(total[seen].astype(np.uint32))))
        rows.append(("sums", None, bucket, put(np.array([(total == r).sum() for r in range(1, K + 2)], np.int64))))
        split = np.unique(np.concatenate([get(r["p5"]) for r in parts]))
        if len(split):
            place = np.searchsorted(context, split)
            rows.append(("contexts", None, bucket, put(split), put(np.concatenate([f[place] for f in few])), put(covered[place])))
            rows += [("hot", r["block"], bucket, r["p5"]) for r in parts if len(get(r["p5"]))]
        return _rows(rows)

    return run


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`contexts` rows to one row a context."""
    for b in batches:
        for r in b.to_pylist():
            h, few, covered = get(r["p0"]), get(r["p1"]).reshape(K, -1), get(r["p2"])
            yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(few[i].astype(np.int64)) for i in range(K)), pa.array(covered)], ["h", *[f"n{i + 1}" for i in range(K)], "covered"])


def _asked_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            h = get(r["p0"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), r["block"])), pa.array(h)], ["block", "h"])


def _score(words: Words, d: np.ndarray, buckets: int, split: int):
    """A coded block and all replies to it in; one row a text out."""

    def run(key, text, got):
        out, replies = [], got.to_pylist()
        for t in text.to_pylist():
            word, count, context, n = _block(t, _replies(got, "ids"))
            ok, which, h, w, count_h, hot, of = _pairs(word, count, context, words, buckets, split)
            del word, context
            total, left, covered = np.zeros(len(h), np.uint32), np.zeros(len(h)), np.zeros(len(h))
            freed = np.arange(1, K + 1) * (1 - d[1:])  # what discounting leaves of a follower that occurs 1..K times
            for r in replies:
                if r["kind"] == "counts":
                    part = np.flatnonzero(of == r["bucket"])
                    total[part] = get(r["p0"])
                    _, place = np.unique(h[part], return_inverse=True)
                    left[part], covered[part] = (freed @ get(r["p1"]).reshape(K, -1))[place], get(r["p2"])[place]
            for r in replies:
                if r["kind"] == "hot":
                    hot_h = np.array([x["h"] for x in r["hot"]])
                    order = np.argsort(hot_h)
                    place = order[np.searchsorted(hot_h[order], h[hot])]
                    left[hot] = (freed @ np.array([[x[f"n{i}"] for x in r["hot"]] for i in range(1, K + 1)]))[place]
                    covered[hot] = np.array([x["covered"] for x in r["hot"]])[place]
            del h, w, hot, of
            p = words.probability(count)
            if len(left):
                # half a count is left where no follower is rare enough to be discounted
                whole = np.where(left > 0, count_h, count_h + 0.5)
                left = np.where(left > 0, left, 0.5)
                back = np.where(count_h > 0, left / whole / (1 - covered), 1.0)
                own = _discounted(total, d) / whole
                p[ok] = np.where(total[which] > 0, own[which], back[which] * p[ok])
            at = np.cumsum(n) - n
            ids, flags = get(t["p0"]), get(t["p1"])
            out.append(pa.Table.from_arrays(
                [pa.array(ids, mask=(flags & 2) > 0), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                 pa.array(np.add.reduceat(words.base(count), at)), pa.array(np.add.reduceat(np.log10(p), at))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            ))
        return pa.concat_tables(out)

    return run


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kind(table: DataFrame, *kinds: str) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds)).select(*_NAMES)


def _sums(table: DataFrame) -> np.ndarray:
    """A few numbers from each bucket, added up."""
    return np.sum([get(r["p0"]) for r in _kind(table, "sums").select("p0").collect()], axis=0)


def score_texts(docs: DataFrame, buckets: int | None = None, split: int = SPLIT, block_bytes: int = BLOCK_BYTES, model_path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model is learnt from rows outside the held-out fold and left as two tables, partitioned by
    bucket, below model_path (words and pairs, `kind` = table). A null or empty text is one end token;
    a null doc_id counts as training; rows that repeat are counted and scored each; an empty table, or
    one without training rows, knows no word: everything is then the unknown word. Columns other than
    doc_id and text are not read. `buckets` is the number of hash buckets of the tables; by default as
    many as keep BUCKET_BYTES of text each, and no fewer than the session's shuffle partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    path = model_path or scratch_path(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold("doc_id", FOLDS) != HELD).alias("train"))
    coded = _written(rows.mapInArrow(_code(buckets, block_bytes), PACKED), f"{path}/blocks")
    word_table = _written(_kind(coded, "words").groupBy("bucket").applyInArrow(_count_words(buckets), PACKED), f"{path}/words")
    sums = _sums(word_table)
    words = Words(sums if np.ndim(sums) else np.zeros(3 + K + 1, np.int64))

    texts, ids = _kind(coded, "text"), _kind(word_table, "ids")
    pairs = texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_ask_pairs(words, buckets, split), PACKED)
    table = _written(pairs.groupBy("bucket").applyInArrow(_count_pairs(words), PACKED), f"{path}/pairs")
    sums = _sums(table)
    d = discounts([int(x) for x in sums] if np.ndim(sums) else [0] * (K + 1))
    asked_hot = _kind(table, "hot").mapInArrow(_asked_hot, "block long, h long").distinct()
    whole = _kind(table, "contexts").mapInArrow(_hot_sums, "h long, n1 long, n2 long, n3 long, n4 long, n5 long, covered double").groupBy("h").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(1, K + 1)], F.sum("covered").alias("covered"))
    # contexts that are split: their parts added up, then sent to the blocks that hold them
    hot = asked_hot.join(whole, "h").groupBy("block").agg(F.collect_list(F.struct("h", *[f"n{i}" for i in range(1, K + 1)], "covered")).alias("hot"))
    replies = ids.unionByName(_kind(table, "counts")).unionByName(hot.withColumn("kind", F.lit("hot")), allowMissingColumns=True)
    scored = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _score(words, d, buckets, split), "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
