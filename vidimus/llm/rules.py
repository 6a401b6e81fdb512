"""Quality rules whose thresholds are risk-controlled on labelled holdouts.

Each rule is a figure of the text with a fixed ladder of cutoffs, from lax to strict. The ladders are
merged into one walk in a fixed order, each step one cutoff further in one rule. In every stratum
(language) it is walked on the labelled good documents: a step holds as long as the exact binomial
bound on the share of them that all rules together reject there stays under the allowed risk. The walk
stops at the first step that fails, so neither steps nor rules need a correction (fixed-sequence
testing); the confidence is divided by the number of strata only (Bonferroni). Then, with the given
confidence, no stratum loses more than the allowed share of its good documents to all rules.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.common import SLICE_ROWS, raw, sliced

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
RISK, CONFIDENCE = 0.02, 0.95
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"

#: Rules: figure, and its cutoffs from lax to strict; a document is rejected where figure > cutoff.
LADDERS: dict[str, list[float]] = {
    "symbols_per_char": [0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005],
    "dup_lines_per_word": [0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005],
    "repeat_share": [0.28, 0.25, 0.22, 0.2, 0.15, 0.1, 0.05],
    "chars_per_word": [30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0],
    "words_per_char": [0.9, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3],
}
#: The walk: (rule, cutoff) of each step. Rules advance alike, each by its share of its own ladder.
WALK = [(rule, cutoff) for _, rule, cutoff in sorted(((i + 1) / len(v), rule, c) for rule, v in LADDERS.items() for i, c in enumerate(v))]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def repeated_words(words: np.ndarray, of: np.ndarray, texts: int, window: int = WINDOW) -> np.ndarray:
    """Words per text that lie in a window found twice or more in that text.

    words: a number for each distinct word, in order; of: the text of each word. Windows get exact
    numbers by doubling: pairs of numbers are numbered anew at lengths 2, 4, 8.
    """
    n, size, ids = len(words), 1, words.astype(np.int64)
    if n < window:
        return np.zeros(texts, np.int64)
    while size < window:
        ids = pd.factorize(ids[:-size] * (int(ids.max()) + 1) + ids[size:])[0].astype(np.int64)
        size *= 2
    inside = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
    key = pd.factorize(ids[inside] * texts + of[inside])[0]
    twice = inside[np.bincount(key)[key] > 1] if len(key) else inside
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + window, -1)
    return np.bincount(of[np.cumsum(depth[:-1]) > 0], minlength=texts)


def base_figures(texts: list[str | None]) -> np.ndarray:
    """Rows of BASE for whole texts; null and empty texts give zeros."""
    if not texts:
        return np.zeros((0, len(BASE)), np.int64)
    data = [raw(t) for t in texts]
    flat = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    stop = np.cumsum([len(d) + 1 for d in data])
    begin = np.r_[0, stop[:-1]]
    space = _SPACE[flat]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    n_words = np.diff(np.r_[0, np.searchsorted(starts, stop)])
    first_bytes = ((flat & 0xC0) != 0x80) & ~space
    chars, symbols = (np.add.reduceat(x, begin, dtype=np.int64) for x in (first_bytes, _SYMBOL[flat]))
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[~space].tobytes())])
    numbered = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
    repeated = repeated_words(numbered, np.repeat(np.arange(len(texts)), n_words), len(texts))
    dup = []
    for d in data:
        lines = [x for x in d.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return np.stack([n_words, chars, symbols, np.array(dup), repeated], axis=1).astype(np.int64)


def figure_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of every row with its BASE figures; the text is read here."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(keep)):
            rows = base_figures(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(rows[:, i].copy()) for i in range(len(BASE)))], [*keep, *BASE])

    chosen = docs.select(*keep, F.col("text").cast("string"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in chosen.dtypes[:-1])
    return chosen.mapInArrow(run, f"{kinds}, " + ", ".join(f"{n} long" for n in BASE))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def rule_figures(get) -> dict[str, Column]:
    """The figure of each rule; get(name) is a column of BASE. Texts without words have none over 0."""
    per = lambda a, b: F.coalesce(F.try_divide(get(a), get(b)), F.lit(0.0))
    return {
        "symbols_per_char": per("n_symbols", "word_chars"), "dup_lines_per_word": per("n_dup_lines", "n_words"), "repeat_share": per("n_repeat_words", "n_words"),
        "chars_per_word": per("word_chars", "n_words"), "words_per_char": per("n_words", "word_chars"),
    }


def tail_probability(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly (by logarithms of each term)."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log(n - i[:-1]) - np.log(i[:-1] + 1.0) if k else np.zeros(0)
    log_choose = np.r_[0.0, np.cumsum(steps)]
    return float(min(1.0, np.exp(log_choose + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified(rejected: list[int], n: int, risk: float, error: float) -> int:
    """How many cutoffs of a ladder hold: rejected counts good documents over each, lax to strict.

    A cutoff holds while the exact upper bound (at level 1 - error) on the rejection rate is at most
    risk, that is while so few rejections are improbable at that rate.
    """
    held = 0
    for k in rejected:
        if not n or k > risk * n or tail_probability(k, n, risk) > error:
            break
        held += 1
    return held


def cutoffs(table: DataFrame, labels: DataFrame, stratum: str = "stratum", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, rule, cutoff, n, rejected): the cutoff of each rule where its stratum's walk ends.

    Learnt from documents that labels call good (quality = 1) and the base rules let pass; rejected
    counts those of the n over any cutoff of the stratum. Rules that the walk does not reach have no
    row. Ids with two different labels are not used.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    holdout = table.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(good, "doc_id", "left_semi")
    figures = rule_figures(F.col)
    first = F.least(*[F.when(figures[rule] > c, F.lit(i)) for i, (rule, c) in enumerate(WALK)], F.lit(len(WALK)))
    counted = cut_lineage(holdout.select(stratum, first.alias("first")).groupBy(stratum, "first").agg(F.count(F.lit(1)).alias("n")))
    error = (1 - confidence) / max(1, counted.select(stratum).distinct().count())

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        n = int(part["n"].sum())
        # each step is at least as strict as the one before, so a document rejected there stays rejected
        rejected = [int(part.loc[part["first"] <= i, "n"].sum()) for i in range(len(WALK))]
        held = certified(rejected, n, risk, error)
        limits = dict(WALK[:held])
        return pd.DataFrame([(part[stratum].iloc[0], rule, c, n, rejected[held - 1]) for rule, c in limits.items()], columns=[stratum, "rule", "cutoff", "n", "rejected"])

    kind = dict(counted.dtypes)[stratum]
    return counted.groupBy(stratum).applyInPandas(choose, f"{stratum} {kind}, rule string, cutoff double, n long, rejected long")


def passes(limits: Column, get) -> Column:
    """Whether no figure is over its stratum's cutoff; limits: a map from rule to cutoff, or null."""
    ok = F.lit(True)
    for name, fig in rule_figures(get).items():
        ok = ok & ~F.coalesce(fig > F.try_element_at(limits, F.lit(name)), F.lit(False))
    return ok


def limit_maps(chosen: DataFrame, stratum: str = "stratum") -> DataFrame:
    """One row a stratum: its cutoffs as a map. At most len(LADDERS) entries each."""
    return chosen.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))


def _stratified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), "text")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, BASE, base_failed, kept) for every row of docs.

    A null or empty text has no words and fails the base rules. A null language is a stratum of its
    own; a stratum without enough labelled documents certifies nothing and loses nothing to the rules.
    Repeated rows are judged each; no rows give no rows; other columns are not read.
    """
    table = cut_lineage(figure_table(_stratified(docs), ["doc_id", "stratum"]))
    limits = cut_lineage(limit_maps(cutoffs(table, labels, risk=risk, confidence=confidence)))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return table.join(limits, "stratum", "left").select(
        "doc_id", *BASE, failed.alias("base_failed"), (~failed & passes(F.col("limits"), F.col)).alias("kept")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of docs that are kept, with their own columns: thresholds first, then one pass over
    the texts that filters in place."""
    ship(docs.sparkSession)
    table = cut_lineage(figure_table(_stratified(docs), ["doc_id", "stratum"]))
    limits = cut_lineage(limit_maps(cutoffs(table, labels, risk=risk, confidence=confidence)))

    @F.pandas_udf("struct<" + ", ".join(f"{n}: long" for n in BASE) + ">")
    def figures(texts: pd.Series) -> pd.DataFrame:
        parts = [base_figures(texts[at : at + SLICE_ROWS].tolist()) for at in range(0, len(texts), SLICE_ROWS)]
        return pd.DataFrame(np.concatenate([np.zeros((0, len(BASE)), np.int64), *parts]), columns=BASE)

    get = lambda n: F.col(f"__figures.{n}")
    right = limits.select(F.col("stratum").alias("__stratum"), F.col("limits").alias("__limits"))
    seen = docs.withColumn("__figures", figures(F.col("text").cast("string"))).join(right, F.coalesce(docs["lang"].cast("string"), F.lit("")) == right["__stratum"], "left")
    good = ~base_failed(get("n_words"), get("n_repeat_words")) & passes(F.col("__limits"), get)
    return seen.filter(good).select(*[docs[c] for c in docs.columns])
