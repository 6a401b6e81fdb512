"""Quality classifier from positives and unlabelled text by the non-negative unbiased risk.

Texts become yes/no features: figures of the text and of its worst lines, each against fixed cuts. With
the squared loss the risk needs only counts of feature pairs among the positives and among the
unlabelled, so one pass over all rows gives everything a fit needs; counts are whole numbers, hence
exact in any order. The fit itself is a small linear system. The class prior comes from the corpus
too: the lowest ratio of unlabelled to positive share over sets of high score, with a confidence bound.
Labels of the other class are never used.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.functions.workers import ship
from vidimus.llm.common import fold, raw, sliced

FOLDS, HELD = 3, 1
RIDGE = 1e-2
SHARPNESS = 4.0

_KINDS = ["upper", "lower", "digit", "space", "symbol", "shout", "stop", "other", "wide"]
_KIND = np.full(256, 7, np.uint8)
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b"#*$%&|<>~^=_{}[]\\", b"!?", b".,;:"]):
    _KIND[list(_chars)] = _i
_KIND[128:] = 8

#: Figures of a text, with the cuts that turn each into yes/no features (value > cut).
FIGURES: dict[str, list[float]] = {
    "words": [0, 5, 20, 50, 100, 2000],
    "upper": [0.02, 0.06, 0.15, 0.4],
    "digit": [0.005, 0.02, 0.06, 0.15],
    "symbol": [0.0, 0.002, 0.01, 0.03, 0.08],
    "shout": [0.0, 0.002, 0.01, 0.03, 0.08],
    "stop": [0.005, 0.01, 0.03, 0.06],
    "other": [0.0, 0.005, 0.02, 0.06],
    "wide": [0.0, 0.05, 0.3],
    "word_length": [2.5, 3.5, 4.5, 6.0, 8.0, 12.0],
    "repeated_lines": [0.0, 0.1, 0.3],
    "fresh_words": [0.1, 0.2, 0.35, 0.5, 0.7],
    "worst_upper": [0.1, 0.3, 0.6],
    "worst_symbol": [0.005, 0.02, 0.06, 0.12],
    "worst_shout": [0.005, 0.02, 0.06, 0.12],
    "bad_lines": [0.0, 0.1, 0.3, 0.6],
}
WIDTH = 1 + sum(map(len, FIGURES.values()))
_CUTS = [(i, c) for i, cuts in enumerate(FIGURES.values()) for c in cuts]
_FIGURE_OF, _CUT = np.array([i for i, _ in _CUTS]), np.array([c for _, c in _CUTS])


def figures(text: str | None) -> list[float]:
    """The figures of one whole text, in the order of FIGURES; all zero for an empty one."""
    data = raw(text)
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    kind = _KIND[np.frombuffer(data, np.uint8)]
    count = np.bincount(kind, minlength=9)
    solid = int(count.sum() - count[3])
    lines = [x for x in (line.strip() for line in data.split(b"\n")) if x]
    size = np.array([len(x) for x in lines])
    joined = _KIND[np.frombuffer(b"".join(lines), np.uint8)]
    at = np.cumsum(size) - size
    per_line = [np.add.reduceat(joined == k, at, dtype=np.int64) / size for k in (0, 4, 5)]
    long = size >= 40
    worst = [float(p[long].max(initial=0)) for p in per_line]
    bad = (per_line[0] > 0.4) | (per_line[1] > 0.03) | (per_line[2] > 0.04)
    return [
        float(n), count[0] / solid, count[2] / solid, count[4] / solid, count[5] / solid, count[6] / solid, count[7] / solid, count[8] / solid,
        solid / n, 1 - len(set(lines)) / len(lines), len(set(words)) / n, *worst, float(size[bad].sum() / size.sum()),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    """Rows of 0/1: a constant, then each figure against each of its cuts."""
    table = np.array([figures(t) for t in texts], float).reshape(-1, len(FIGURES))
    return np.concatenate([np.ones((len(table), 1)), table[:, _FIGURE_OF] > _CUT], axis=1).astype(np.uint8)


def pack(bits: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.packbits(bits, axis=1)]


def unpack(packed: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(rows, axis=1)[:, :WIDTH]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    prior: float

    def score(self, bits: np.ndarray) -> np.ndarray:
        """0 to 1, over one half where the estimated posterior of the good class is."""
        margin = bits.astype(float) @ np.array(self.weights)
        return 1 / (1 + np.exp(-SHARPNESS * np.clip(margin, -20, 20)))


def fit_weights(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Minimise prior * E+[l(g)] + max(0, E?[l(-g)] - prior * E+[l(-g)]) for l(z) = (1 - z)^2 / 4.

    positive and unlabelled hold E[x x'] with the constant first. The max is a multiplier in [0, 1] for
    which the minimiser is one linear system; where the unbiased solution makes the second term
    negative, the multiplier that brings it to zero is found by halving.
    """
    p, u, eye = positive, unlabelled, ridge * np.eye(len(positive))

    def solve(t: float) -> np.ndarray:
        return np.linalg.solve(prior * (1 - t) * p + t * u + eye, prior * (1 + t) * p[0] - t * u[0])

    def negative_risk(w: np.ndarray) -> float:
        loss = lambda m: (m[0, 0] + 2 * m[0] @ w + w @ m @ w) / 4
        return loss(u) - prior * loss(p)

    w = solve(1.0)
    if negative_risk(w) >= 0:
        return w
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if negative_risk(solve(mid)) > 0 else (low, mid)
    return solve(low)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.05) -> float:
    """Share of positives among the unlabelled, from counts by falling score.

    Over sets of the highest scores, unlabelled share / positive share is at least the prior; the
    least upper bound of that ratio (with a band for chance) is the estimate.
    """
    np_, nu = positive.sum(), unlabelled.sum()
    if not np_ or not nu:
        return 0.5
    band = math.sqrt(math.log(4 / delta) / 2)
    q, r = np.cumsum(positive) / np_, np.cumsum(unlabelled) / nu
    ep, eu = band / math.sqrt(np_), band / math.sqrt(nu)
    ok = q > 2 * ep
    bound = (r[ok] + eu + ep) / q[ok]
    best = int(np.argmin(bound)) if ok.any() else -1
    return float(np.clip(r[ok][best] / q[ok][best] if ok.any() else 0.5, 0.01, 0.99))


def _moments(patterns: DataFrame) -> dict[bool, tuple[np.ndarray, int]]:
    """E[x x'] of positives (True) and unlabelled (False) from counts of feature patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            bits, trusted = unpack(b.column(0).to_pylist()).astype(float), b.column(1).to_numpy(zero_copy_only=False)
            n = b.column(2).to_numpy(zero_copy_only=False)
            for t in (True, False):
                x, m = bits[trusted == t], n[trusted == t]
                total[t] = total.get(t, 0) + (x * m[:, None]).T @ x
        for t, m in total.items():
            i = np.arange(WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(WIDTH, t)), pa.array(i), pa.array(list(m.astype(np.int64)), pa.list_(pa.int64()))], ["trusted", "i", "row"])

    rows = patterns.mapInArrow(run, "trusted boolean, i long, row array<long>")
    sums = rows.select("trusted", "i", F.posexplode("row").alias("j", "v")).groupBy("trusted", "i", "j").agg(F.sum("v").alias("v"))
    out = {}
    for trusted, part in sums.toPandas().groupby("trusted"):  # WIDTH squared numbers a class
        m = np.zeros((WIDTH, WIDTH))
        m[part["i"], part["j"]] = part["v"]
        if m[0, 0]:
            out[bool(trusted)] = (m / m[0, 0], int(m[0, 0]))
    return out


def _histogram(patterns: DataFrame, model: Model, bins: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Counts of positives and of unlabelled by falling score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(unpack(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(((1 - s) * bins).astype(np.int64), bins - 1)), b.column(1), b.column(2)], ["bin", "trusted", "n"])

    rows = patterns.mapInArrow(run, "bin long, trusted boolean, n long").groupBy("bin", "trusted").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, bins))
    for r in rows:
        out[int(r["trusted"]), r["bin"]] = r["n"]
    return out[1], out[0]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) of every row; the text is read here and nowhere else."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(features(b.column(1).to_pylist())), pa.binary())], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, bits binary")


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """Fit on (doc_id, bits): trusted are rows that labels call good (quality = 1), learnt from ids
    outside the held-out fold only; unlabelled are the rows of the same folds that have no label.

    Without unlabelled rows all rows of these folds stand for them; without positives there is
    nothing to learn and every score is one half. A doc_id with two different labels is not trusted.
    """
    good = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    open_rows = table.filter(fold("doc_id", FOLDS) != HELD)
    joined = open_rows.join(good, "doc_id", "left")
    counted = cut_lineage(joined.groupBy("bits", "quality").agg(F.count(F.lit(1)).alias("n")))
    trusted = counted.filter("quality = 1").select("bits", F.lit(True).alias("trusted"), "n")
    loose = counted.filter("quality is null")
    patterns = trusted.unionByName((counted if loose.isEmpty() else loose).select("bits", F.lit(False).alias("trusted"), "n"))
    m = _moments(patterns)
    if True not in m:
        return Model(tuple([0.0] * WIDTH), 0.5)
    first = Model(tuple(fit_weights(m[True][0], m[False][0], 0.5)), 0.5)
    prior = estimate_prior(*_histogram(patterns, first))
    return Model(tuple(fit_weights(m[True][0], m[False][0], prior)), prior)


def score_table(table: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of (doc_id, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(1).to_pylist()
            score = model.score(unpack(packed)) if packed else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts are scored like any other; repeated rows are scored each; a null doc_id is
    never held out; no rows give no rows. Columns other than doc_id and text are not read.
    """
    table = cut_lineage(feature_table(docs))
    scored = score_table(table, fit(table, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_column(model: Model, text: str = "text") -> Column:
    """The score of a text column, for filtering rows in place."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(texts.tolist())) if len(texts) else [], dtype=float)

    return score(F.col(text).cast("string"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted good, with their own columns, in one pass over the text
    after the fit."""
    ship(docs.sparkSession)
    model = fit(cut_lineage(feature_table(docs)), labels)
    return docs.filter(score_column(model) >= 0.5)
