"""Byte-pair encoding with batched numpy merge rounds, and decoding, for a word-end vocabulary file.

Symbols of many words lie in one flat array. In each round the pair at every place is looked up by
binary search over the sorted pair keys, the lowest rank of every word is taken by a segmented minimum,
and all words merge at once. Words that are done leave the array, so rounds shrink. Words already seen
are kept in a bounded table; texts are then joins of known words.
"""
from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from vidimus.functions.workers import ship
from vidimus.llm.common import SLICE_ROWS, sliced

VOCABULARY = "word_bpe_49k.json"
KNOWN_WORDS = 250_000
NONE = np.iinfo(np.int64).max

GAP = re.compile(r"[ \n\t]")

# The white space of the vocabulary file's splitting pattern.
_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point 0 white space, 1 letter, 2 number, 3 other, as the splitting pattern has it.

    The library's own pattern matcher is asked once, for its Unicode version is neither Python's nor that
    of another matcher. No code point past plane 3 is a letter or a number."""
    kind = np.full(0x110000, 3, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x40000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for _, (i, j) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            kind[points[i:j]] = k
    kind[_SPACE] = 0
    return kind


@functools.lru_cache(maxsize=1)
def _settled() -> np.ndarray:
    """Code points assigned since Unicode 3.2: all later versions normalise texts of these alike."""
    known = unicodedata.ucd_3_2_0.category
    return np.array([known(chr(c)) != "Cn" for c in range(0x30000)])


def normalised(text: str, char: np.ndarray) -> str:
    """Composed (NFC) and lower case as the library has them; `char` holds the code points of the text. Python
    does it many times faster, but knows other versions' characters."""
    if int(char.max(initial=0)) < len(_settled()) and _settled()[char].all():
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    return NORMALISER.normalize_str(text)


NORMALISER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
SLOT_BITS = 20
SLOTS, ARENA = 1 << SLOT_BITS, 1 << 23
PART = 1 << 20  # longer texts are encoded in parts, cut at white space
MIX = np.uint64(0x9E3779B97F4A7C15)
_CHAR_KEYS = np.array([[xxhash.xxh64_intdigest(bytes([i]), seed) for i in range(256)] for seed in (1, 2)], np.uint64)
_SEEDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def word_bounds(char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-case characters (code points), as the pattern finds them."""
    kind = kinds()[char]
    before = np.r_[np.uint8(0), kind[:-1]]
    start = (kind != 0) & ((kind != before) | (kind == 2))
    # an apostrophe that stands alone takes s, t, m, d, re, ve or ll from the letters behind it
    quote = np.flatnonzero((char == 39) & start)
    quote = quote[quote + 1 < len(char)]
    quote = quote[kind[quote + 1] == 1]
    if len(quote):
        one = char[quote + 1]
        two = np.where(quote + 2 < len(char), char[np.minimum(quote + 2, len(char) - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        take = np.where(short, 2, np.where(long, 3, 0))
        quote, take = quote[take > 0], take[take > 0]
        start[quote + 1] = False
        rest = quote + take
        rest = rest[rest < len(char)]
        start[rest] = kind[rest] != 0
    starts = np.flatnonzero(start)
    stop = np.flatnonzero(start | ((kind == 0) & (before != 0)))
    return starts, np.r_[stop, len(char)][np.searchsorted(stop, starts, side="right")]


def _weights(n: int, seed: int) -> np.ndarray:
    """A scattered odd weight for each place; powers of one number would give some long words equal sums."""
    x = np.arange(1, n + 1, dtype=np.uint64) * MIX + np.uint64(seed)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)) | np.uint64(1)


def word_keys(char: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit keys of each word: sums over its characters, weighted by their places."""
    flat = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
    place = flat - np.repeat(starts, size)
    symbols, first = char[flat], np.cumsum(size) - size
    keys = []
    for table, seed in zip(_CHAR_KEYS, _SEEDS):
        keys.append(np.add.reduceat(table[symbols] * _weights(int(size.max()), seed)[place], first))
    return keys[0] * MIX, keys[1]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    stands = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [stands[b] for b in range(256)]


class Bpe:
    """Vocabulary, merges as sorted pair keys, and bounded tables of words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right, kind="stable")
        self.keys, self.rank = (left << 32 | right)[order], order.astype(np.int64)
        first_use = np.full(max(vocab.values()) + 1, NONE)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        #: a merge whose result is in no earlier pair: all its places in a word may merge in one round
        self.together = first_use[self.into] > np.arange(len(pairs))
        stands = byte_symbols()
        self.inner = np.array([vocab[s] for s in stands], np.int64)
        self.final = np.array([vocab[s + end] for s in stands], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.decimals = pa.array([str(i) for i in range(max(names) + 1)], pa.string())
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        """Empty both tables of known words (they are caches; results do not depend on them)."""
        self.ids = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.slot_a, self.slot_b = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.slot_at, self.slot_n = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.arena, self.used = np.zeros(ARENA, np.uint32), 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, how many each has); words are not empty."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.frombuffer(b"".join(words), np.uint8)
        word, last = np.repeat(np.arange(len(words)), lens), np.cumsum(lens) - 1
        ids = self.inner[sym]
        ids[last] = self.final[sym[last]]
        rank = np.full(len(ids), NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._ranks(ids[inside], ids[inside + 1])
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[starts, len(ids)])
            best = np.repeat(np.minimum.reduceat(rank, starts), length)
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                go = ~over
                ids, word, rank, best = ids[go], word[go], rank[go], best[go]
            pick = np.flatnonzero(rank == best)
            if not len(pick):
                break
            same = word[pick[1:]] == word[pick[:-1]]
            # overlapping places of one pair: every other one, from the left
            fresh = np.r_[True, (pick[1:] != pick[:-1] + 1) | ~same]
            begin = np.maximum.accumulate(np.where(fresh, pick, 0))
            # pairs that may not merge together: the leftmost place only
            pick = pick[((pick - begin) % 2 == 0) & (self.together[rank[pick]] | np.r_[True, ~same])]
            ids[pick] = self.into[rank[pick]]
            keep = np.ones(len(ids), bool)
            keep[pick + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            # only pairs next to a merged place have changed
            now = pick - np.arange(len(pick))
            near = np.zeros(len(ids), bool)
            near[now] = near[np.maximum(now - 1, 0)] = True
            near = np.flatnonzero(near)
            rank[near] = NONE
            near = near[near < len(ids) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._ranks(ids[near], ids[near + 1])
        of = np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return np.concatenate(done_ids)[order].astype(np.uint32), np.bincount(of, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """Words of a text in order; strings of special tokens stand for themselves."""
        out = []
        for part in self._cut.split(text) if self._cut is not None and "<|" in text else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                low = normalised(part, np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"))
                starts, ends = word_bounds(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4"))
                out += [low[i:j] for i, j in zip(starts.tolist(), ends.tolist())]
        return out

    def _encode_wide(self, text: str) -> np.ndarray:
        parts = self.split(text)
        new = list(set(parts).difference(self.ids))
        if len(self.ids) + len(new) > KNOWN_WORDS:
            self._forget()
            new = list(set(parts).difference(self.ids))
        if new:
            flat, n = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
            buf, end = flat.tobytes(), np.cumsum(4 * n)
            self.ids |= {w: buf[a:b] for w, a, b in zip(new, (end - 4 * n).tolist(), end.tolist())}
        return np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), np.uint32)

    def _encode_narrow(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of Latin-1 texts, all at once, and how many each has."""
        joined = b" ".join([*texts, b""])
        char = LOWER[np.frombuffer(joined, np.uint8)]
        starts, ends = word_bounds(char)
        text_end = np.cumsum([len(t) + 1 for t in texts])
        words_of = np.diff(np.r_[0, np.searchsorted(starts, text_end)])
        if not len(starts):
            return np.zeros(0, np.uint32), words_of
        size = ends - starts
        a, b = word_keys(char, starts, size)
        if self.used > ARENA // 2:
            self._forget()
        slot = (a >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        missing = (self.slot_a[slot] != a) | (self.slot_b[slot] != b)
        # read before new words are put in, which may take the slot of a known word of this very batch
        where, n = self.slot_at[slot].astype(np.int64), self.slot_n[slot].astype(np.int64)
        if missing.any():
            at = np.flatnonzero(missing)
            _, first, which = np.unique(a[at] ^ b[at] * MIX, return_index=True, return_inverse=True)
            first = at[first]
            lower = char.tobytes()
            flat, made = self.merge([lower[i:j].decode("latin-1").encode() for i, j in zip(starts[first].tolist(), ends[first].tolist())])
            if self.used + len(flat) > len(self.arena):
                self.arena = np.r_[self.arena[: self.used], flat, np.zeros(ARENA, np.uint32)]
            self.arena[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(made) - made
            self.used += len(flat)
            new = slot[first]
            self.slot_a[new], self.slot_b[new], self.slot_at[new], self.slot_n[new] = a[first], b[first], begin, made
            where[missing], n[missing] = begin[which], made[which]
        end = np.cumsum(n)
        flat = self.arena[np.arange(end[-1]) + np.repeat(where - end + n, n)]
        upto = np.r_[0, end][np.cumsum(words_of)]
        return flat, np.diff(np.r_[0, upto])

    def _encode_parts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A long text in parts: words and special tokens hold no white space, so it may be cut there."""
        ids, at = [], 0
        while at < len(text):
            cut = GAP.search(text, at + PART // 2)
            stop = cut.end() if cut else len(text)
            part = text[at:stop]
            # a part without white space stays whole however long it is
            ids.append(self.encode([part])[0] if len(part) <= PART else self._encode_wide(part))
            at = stop
        flat = np.concatenate(ids)
        return flat, np.array([len(flat)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each has); null is an empty text."""
        if any(t and len(t) > PART for t in texts):
            done = [self._encode_parts(t) if t and len(t) > PART else self.encode([t]) for t in texts]
            return np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done])
        narrow, at, wide = [], [], {}
        for i, t in enumerate(texts):
            t = t or ""
            try:
                raw = None if "<|" in t else t.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None:
                wide[i] = self._encode_wide(t)
            else:
                narrow.append(raw)
                at.append(i)
        ids, n = self._encode_narrow(narrow) if narrow else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if not wide:
            return ids, n
        parts, count = dict(zip(at, np.split(ids, np.cumsum(n)[:-1]))) | wide, np.zeros(len(texts), np.int64)
        for i, p in parts.items():
            count[i] = len(p)
        return np.concatenate([parts[i] for i in range(len(texts))]), count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The tokens of each text's ids, special ones too, joined by one space (the file names no decoder)."""
        return self._joined(self.tokens, ids, count)

    def written(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """Each text's ids in decimal, joined by one space."""
        return self._joined(self.decimals, ids, count)

    @staticmethod
    def _joined(names: pa.Array, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        ends = np.r_[0, np.cumsum(count)].astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(ids))), " ")


@functools.lru_cache(maxsize=2)
def load(path: str | None = None) -> Bpe:
    """The vocabulary at path; without a path, the installed package of public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text. Null and empty texts have no ids; repeated rows
    are encoded each; an empty table gives no rows; other columns are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in sliced(batches):
            ids, n = bpe.encode(b.column(1).to_pylist())
            at = np.r_[0, np.cumsum(n)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the tokens joined by one space; null ids count as none."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in (x.slice(at, SLICE_ROWS) for x in batches for at in range(0, x.num_rows, SLICE_ROWS)):
            rows = [ids or [] for ids in b.column(1).to_pylist()]
            flat = np.array([i for ids in rows for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), bpe.decode(flat, np.array([len(r) for r in rows], np.int64))], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text: ids in decimal, joined by one space, and
    the text they decode to. Same rules for odd rows as `encode`."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in sliced(batches):
            ids, n = bpe.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), bpe.written(ids, n), bpe.decode(ids, n)], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids string, decoded string"
    )
