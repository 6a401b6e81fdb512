"""N-gram log-odds attribution with the target's own work withheld.

Every document is scored against every profiled class in one plan. Leaving a work out is a
subtraction: class counts minus what that work contributed, never a rebuilt profile per target.
Frames used throughout:

* units    `uid, label, work, text` (label null or `grey` = unlabelled)
* vocab    `feature_set, gram`
* counts   `feature_set, uid, gram, n`
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import top_k_per
from vidimus.functions.workers import ship

# The method's constants.
MIN_CHARS = 2000
MIN_UNITS = 5
LOW_EVIDENCE = 10
LENGTHS = (2, 3, 4)
WINDOW = 400
MAX_CELLS = 600
EXCERPT = 2400
TOP_GRAMS = 12
BANDS = 6
FEATURE_SETS = ("curated", "generic", "both")
UNLABELLED = "grey"
METHOD_VERSION = 1

KEY = ["feature_set", "uid"]


def _labelled() -> Column:
    return F.col("label").isNotNull() & (F.col("label") != UNLABELLED)


# --- units and vocabulary ---------------------------------------------------------------------------
def judge_units(units: DataFrame, min_chars: int = MIN_CHARS, min_units: int = MIN_UNITS, cls: str = tx.HAN) -> DataFrame:
    """Units with their script length and what became of them.

    Fate is one of kept, unlabelled, no text, under the floor, class too small. Class sizes are a
    small aggregate joined back, so no class is gathered in one place.
    """
    sized = units.withColumn("chars", tx.script_count("text", cls))
    first = sized.withColumn(
        "fate",
        F.when(F.col("text").isNull() & ~_labelled(), "unlabelled, no text").when(F.col("text").isNull(), "no text")
        .when(~_labelled(), "unlabelled").when(F.col("chars") < min_chars, "under the floor").otherwise("kept"),
    )
    sizes = first.filter("fate = 'kept'").groupBy("label").agg(F.count(F.lit(1)).alias("_class_units"))
    # a row for each class, which every scoring task knows; by a shuffle all texts of a class would be one task
    return first.join(F.broadcast(sizes), "label", "left").withColumn(
        "fate", F.when((F.col("fate") == "kept") & (F.col("_class_units") < min_units), "class too small").otherwise(F.col("fate"))
    ).drop("_class_units")


def select_units(units: DataFrame, min_chars: int = MIN_CHARS, min_units: int = MIN_UNITS, cls: str = tx.HAN) -> DataFrame:
    return judge_units(units, min_chars, min_units, cls).filter("fate = 'kept'").drop("fate")


def discard_ledger(judged: DataFrame) -> DataFrame:
    """Units by fate, the labelled and unlabelled totals, and whether the parts add up (A10)."""
    n = lambda cond: F.count_if(cond)
    fates = ["kept", "no text", "under the floor", "class too small"]
    row = judged.agg(
        n(_labelled()).alias("labelled"), n(~_labelled()).alias("unlabelled"),
        *[n(F.col("fate") == f).alias(f.replace(" ", "_")) for f in fates],
        n(F.col("fate") == "unlabelled, no text").alias("unlabelled_no_text"),
        F.count_distinct(F.when(F.col("fate") == "kept", F.col("label"))).alias("classes"),
    )
    parts = F.col("kept") + F.col("no_text") + F.col("under_the_floor") + F.col("class_too_small")
    return row.withColumn("adds_up", parts == F.col("labelled"))


def common_grams(texts: DataFrame, shape: dict[int, int], cls: str = tx.HAN) -> DataFrame:
    """The commonest all-script grams of the texts, k per length.

    Exact counts (nothing is pruned on the way); equal counts go by the gram. Reads no labels.
    """
    if not shape:
        return texts.select(F.lit("").alias("gram")).filter("false")
    grams = texts.select(F.explode(tx.char_grams("text", sorted(shape), cls)).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("len", F.length("gram"))
    ranked = top_k_per(counted, ["len"], [F.desc("n"), F.col("gram")], max(shape.values()))
    k = F.lit(0)
    for length, size in shape.items():
        k = F.when(F.col("len") == length, F.lit(size)).otherwise(k)
    return ranked.filter(F.col("rank") <= k).select("gram")


def vocabulary_shape(marks: DataFrame) -> dict[int, int]:
    """How many grams of each length a marker list holds (a handful of lengths)."""
    rows = marks.groupBy(F.length("gram").alias("len")).agg(F.count(F.lit(1)).alias("k")).collect()
    return {r["len"]: r["k"] for r in rows}


def shortfall(vocab: DataFrame, shape: dict[int, int]) -> list[str]:
    """Lengths for which fewer grams exist than asked for; a non-empty answer is an error to raise."""
    got = vocabulary_shape(vocab)
    return [f"only {got.get(n, 0)} distinct {n}-grams; wanted {k}" for n, k in sorted(shape.items()) if got.get(n, 0) < k]


def feature_sets(marks: DataFrame, generic: DataFrame) -> DataFrame:
    """Curated, generic and both as one long vocabulary."""
    tagged = marks.select("gram", F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(
        generic.select("gram", F.lit(0).alias("c"), F.lit(1).alias("g"))
    ).groupBy("gram").agg(F.max("c").alias("c"), F.max("g").alias("g"))
    sets = F.array_compact(F.array(F.when(F.col("c") == 1, F.lit("curated")), F.when(F.col("g") == 1, F.lit("generic")), F.lit("both")))
    return tagged.select(F.explode(sets).alias("feature_set"), "gram")


def shared_count(vocab: DataFrame) -> DataFrame:
    per = vocab.groupBy("gram").agg(F.count_if(F.col("feature_set") != "both").alias("in_sets"))
    return per.agg(F.count(F.lit(1)).alias("union_size"), F.count_if(F.col("in_sets") == 2).alias("shared"))


def _sets_of(vocab: DataFrame) -> DataFrame:
    # one row per gram with the few sets it belongs to, so a text is counted once for all sets
    return vocab.groupBy("gram").agg(F.array_sort(F.collect_set("feature_set")).alias("sets"))


def unit_gram_counts(units: DataFrame, vocab: DataFrame, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """How often each vocabulary gram occurs in each unit, per feature set (T4).

    The vocabulary decides what counts. It is joined while the text is being cut up, so only hits are
    shuffled, already counted per task.
    """
    grams = units.select("uid", F.explode(tx.char_grams("text", lengths)).alias("gram"))
    sets = _sets_of(vocab)
    hits = grams.join(sets.select("gram"), "gram", "left_semi").groupBy("uid", "gram").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(sets, "gram").select(F.explode("sets").alias("feature_set"), "uid", "gram", "n")


def class_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Units and tokens per class and feature set."""
    j = counts.join(kept.select("uid", "label"), "uid")
    return j.groupBy("feature_set", "label").agg(F.count_distinct("uid").alias("units_with_hits"), F.sum("n").alias("tokens"))


# --- profiles and scores ------------------------------------------------------------------------------
class Profiles(NamedTuple):
    """Class counts, what each work contributed to them, and class sizes."""

    grams: DataFrame      # feature_set, gram, label, c
    own: DataFrame        # feature_set, work, gram, own: map label -> count
    totals: DataFrame     # feature_set, label, total
    own_totals: DataFrame  # feature_set, work, label, own_total
    units: DataFrame      # label, units
    own_units: DataFrame  # work, label, own_units
    sizes: DataFrame      # feature_set, n_features
    extra_units: DataFrame | None  # label, extra


def build_profiles(counts: DataFrame, kept: DataFrame, vocab: DataFrame, withhold: DataFrame | None = None) -> Profiles:
    """Profiles of the kept units, minus any units the caller withholds (T5).

    `withhold` holds `uid`; naming a unit that is not profiled is an error.
    """
    extra = None
    feed = kept.select("uid", "label", "work")
    if withhold is not None:
        asked = withhold.select("uid").distinct()
        unknown = [r["uid"] for r in asked.join(feed, "uid", "left_anti").limit(3).collect()]
        if unknown:
            raise ValueError(f"cannot withhold units that are not profiled: {unknown}")
        extra = feed.join(asked, "uid", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("extra"))
        feed = feed.join(asked, "uid", "left_anti")
    by_work = counts.join(feed, "uid").groupBy("feature_set", "label", "work", "gram").agg(F.sum("n").alias("own"))
    # a work's labels per gram: as many entries as labels the work carries
    own = by_work.groupBy("feature_set", "work", "gram").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "own"))).alias("own")
    )
    return Profiles(
        by_work.groupBy("feature_set", "gram", "label").agg(F.sum("own").alias("c")), own,
        by_work.groupBy("feature_set", "label").agg(F.sum("own").alias("total")),
        by_work.groupBy("feature_set", "work", "label").agg(F.sum("own").alias("own_total")),
        kept.groupBy("label").agg(F.count(F.lit(1)).alias("units")),
        feed.groupBy("work", "label").agg(F.count(F.lit(1)).alias("own_units")),
        vocab.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_features")), extra,
    )


def target_hits(targets: DataFrame, counts: DataFrame, sets: Sequence[str] = FEATURE_SETS) -> DataFrame:
    """Every target under every feature set with hits and distinct grams, zeros included."""
    skeleton = targets.select("uid", "work", "label", F.explode(F.array(*[F.lit(s) for s in sets])).alias("feature_set"))
    seen = counts.groupBy(*KEY).agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("distinct"))
    return skeleton.join(seen, KEY, "left").fillna(0, ["hits", "distinct"])


def _beside(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """Every target with every class of its feature set. The classes, a row for each set and label, travel
    as one value, so no join has a key of three values."""
    per_set = classes.groupBy("feature_set").agg(F.collect_list(F.struct(*classes.columns)).alias("classes"))
    listed = per_set.agg(F.map_from_entries(F.collect_list(F.struct("feature_set", "classes")))).scalar()
    rows = hits.withColumn("_c", F.explode(F.try_element_at(listed, F.col("feature_set"))))
    return rows.select(*hits.columns, *[F.col(f"_c.{c}").alias(c) for c in classes.columns if c != "feature_set"])


def profile_summary(hits: DataFrame, prof: Profiles, sequence: DataFrame | None = None, min_units: int = MIN_UNITS) -> DataFrame:
    """Per target and class: units left after withholding, units before, tokens left, thin flag, place in
    the historical sequence, and why an empty profile is empty (T6, T14)."""
    classes = prof.units.select("label", "units")
    if prof.extra_units is not None:
        classes = classes.join(prof.extra_units, "label", "left").fillna(0, ["extra"])
    else:
        classes = classes.withColumn("extra", F.lit(0))
    per_set = classes.select("*", F.explode(F.array(*[F.lit(s) for s in FEATURE_SETS])).alias("feature_set"))
    per_set = per_set.join(prof.totals, ["feature_set", "label"], "left").join(prof.sizes, "feature_set").fillna(0, ["total"])
    j = _beside(hits.withColumnRenamed("label", "own_label"), per_set)
    j = j.join(prof.own_totals, ["feature_set", "work", "label"], "left").join(prof.own_units, ["work", "label"], "left")
    j = j.fillna(0, ["own_total", "own_units"])
    out = j.select(
        *KEY, "work", "own_label", "label", "hits", "distinct", "n_features",
        (F.col("units") - F.col("extra") - F.col("own_units")).alias("units_left"), F.col("units").alias("units_before"),
        (F.col("total") - F.col("own_total")).alias("tokens"),
    )
    out = out.withColumn("thin", F.col("units_left") < min_units).withColumn(
        "no_profile",
        F.when((F.col("tokens") == 0) & (F.col("units_left") == 0), "no units left after withholding")
        .when(F.col("tokens") == 0, "no hits in this vocabulary"),
    )
    return out if sequence is None else out.join(sequence, "label", "left")


def score(hits: DataFrame, counts: DataFrame, prof: Profiles, summary: DataFrame | None = None) -> DataFrame:
    """Log-probability of each target under each non-empty profile, and its rank.

    Only grams a class really has are joined: with N hits and V grams in the vocabulary,
    `score = sum n (ln(c' + 0.5) - ln 0.5) + N ln 0.5 - N ln(total' + 0.5 V)`.
    """
    summary = profile_summary(hits, prof) if summary is None else summary
    tg = counts.join(hits.select(*KEY, "work"), KEY)
    cells = tg.join(prof.own, ["feature_set", "work", "gram"], "left").join(prof.grams, ["feature_set", "gram"])
    left = F.col("c") - F.coalesce(F.try_element_at("own", F.col("label")), F.lit(0))
    gain = F.col("n") * (F.log(left + 0.5) - F.log(F.lit(0.5)))
    sums = cells.groupBy(*KEY, "label").agg(F.sum(gain).alias("gain"))
    live = summary.filter("no_profile IS NULL AND hits > 0").join(sums, [*KEY, "label"], "left")
    total = F.col("tokens") + F.lit(0.5) * F.col("n_features")
    scored = live.withColumn(
        "score", F.coalesce("gain", F.lit(0.0)) + F.col("hits") * (F.log(F.lit(0.5)) - F.log(total))
    ).withColumn("smooth", total)
    # ties by label; the score is rounded far below any real difference so that summation order cannot decide
    w = Window.partitionBy(*KEY)
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("score", 6)), "label")))
    return ranked.withColumn("delta", F.col("score") - F.max("score").over(w)).select(
        *KEY, "work", "own_label", "label", "hits", "distinct", "score", "delta", "rank", "tokens", "n_features", "smooth", "units_left", "thin"
    )


def verdicts(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Leader, runner-up, margin per distinct gram, gap and verdict per target.

    No hits names nobody; fewer than ten distinct grams is low evidence."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    tops = scores.groupBy(*KEY).agg(
        at(1, "label").alias("first"), at(2, "label").alias("second"), at(1, "score").alias("s1"), at(2, "score").alias("s2"),
        F.count(F.lit(1)).alias("profiles"),
    )
    j = hits.join(tops, KEY, "left")
    enough = F.col("profiles") >= 2
    gap = F.when(enough, F.col("s1") - F.col("s2")).otherwise(0.0)
    verdict = (
        F.when(F.col("hits") == 0, "no evidence").when(F.coalesce(~enough, F.lit(True)), "too few profiles")
        .when(F.col("distinct") < LOW_EVIDENCE, "low evidence").otherwise("leans")
    )
    return j.select(
        *KEY, "work", "label", "hits", "distinct", verdict.alias("verdict"), F.when(enough, F.col("first")).alias("first"),
        F.when(enough, F.col("second")).alias("second"), F.coalesce(F.try_divide(gap, F.col("distinct")), F.lit(0.0)).alias("margin"),
        F.coalesce(gap, F.lit(0.0)).alias("gap"),
    )


def pairs(scores: DataFrame, pinned: tuple[str, str] | None = None) -> DataFrame:
    """The two classes painted against each other (T9): the target's own label when profiled, else the
    leader, against the strongest other; or a pinned pair, which must be two profiled classes."""
    if pinned is not None and pinned[0] == pinned[1]:
        raise ValueError(f"pair must name two distinct profiled classes; got {pinned!r}")
    base = scores
    if pinned is not None:
        a = F.max(F.when(F.col("label") == pinned[0], F.struct("label", "score", "smooth", "tokens")))
        b = F.max(F.when(F.col("label") == pinned[1], F.struct("label", "score", "smooth", "tokens")))
        out = base.groupBy(*KEY, "work").agg(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    else:
        me = F.struct("rank", "label", "score", "smooth", "tokens")
        is_own = F.col("label").eqNullSafe(F.col("own_label"))
        out = base.groupBy(*KEY, "work").agg(
            F.min_by(me, F.struct(F.when(is_own, 0).otherwise(1), F.col("rank"))).alias("a"),
            F.min(me).alias("lead"), F.min(F.when(F.col("rank") == 2, me)).alias("next"),
        )
        # the strongest class that is not `a`: the leader, or the runner-up when the leader is `a`
        out = out.withColumn("b", F.when(F.col("a.label") == F.col("lead.label"), F.col("next")).otherwise(F.col("lead")))
        out = out.filter("b IS NOT NULL")
    return out.select(
        *KEY, "work", F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.col("a.smooth").alias("smooth_a"),
        F.col("b.smooth").alias("smooth_b"), F.col("a.tokens").alias("tokens_a"), F.col("b.tokens").alias("tokens_b"),
        (F.col("a.score") - F.col("b.score")).alias("pair_gap"),
    )


def gram_weights(pair: DataFrame, counts: DataFrame, prof: Profiles) -> DataFrame:
    """Per target and gram: counts in both profiles after withholding, and the log-odds weight."""
    table = prof.grams.groupBy("feature_set", "gram").agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("table"))
    j = counts.join(pair, KEY).join(table, ["feature_set", "gram"], "left").join(prof.own, ["feature_set", "work", "gram"], "left")
    left = lambda lab: (
        F.coalesce(F.try_element_at("table", F.col(lab)), F.lit(0)) - F.coalesce(F.try_element_at("own", F.col(lab)), F.lit(0))
    )
    j = j.withColumn("count_a", left("a")).withColumn("count_b", left("b"))
    weight = (F.log(F.col("count_a") + 0.5) - F.log("smooth_a")) - (F.log(F.col("count_b") + 0.5) - F.log("smooth_b"))
    return j.withColumn("weight", weight).drop("table", "own")


def pair_weights(weights: DataFrame, top: int = TOP_GRAMS) -> DataFrame:
    """The grams that pull hardest each way, at most twelve a side; grams neither profile has are no
    evidence and are left out (T10)."""
    seen = weights.filter("count_a > 0 OR count_b > 0").withColumn("contrib", F.round(F.col("n") * F.col("weight"), 9))
    rate = lambda c, t: F.round(F.when(F.col(t) > 0, F.lit(1e5) * F.col(c) / F.col(t)).otherwise(0.0), 1)
    pick = lambda df, side, order: top_k_per(df, KEY, order, top).withColumn("side", F.lit(side))
    both = pick(seen.filter("contrib > 0"), "for", [F.desc("contrib"), F.desc("gram")]).unionByName(
        pick(seen.filter("contrib < 0"), "against", [F.col("contrib"), F.col("gram")])
    )
    return both.select(
        *KEY, "side", "rank", "gram", F.col("n").alias("hits"), "count_a", "count_b", rate("count_a", "tokens_a").alias("rate_a"),
        rate("count_b", "tokens_b").alias("rate_b"), F.round("contrib", 2).alias("weight"),
    )


# --- evidence along the text ---------------------------------------------------------------------------
def spread_weights(text: str, grams: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence at each character of a text and whether any gram covers it, one row for each row of
    `weights` (sets x grams; a gram that a set lacks is NaN).

    A place of a gram adds its weight / length from the gram's first character to its last. Places are
    found for all grams of one length at once and added by whole shifted arrays, so nothing is a row for a
    hit or a character, and a character without a hit stays exactly zero."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known, char = np.unique(chars, return_inverse=True)
    number = {chr(c): i + 1 for i, c in enumerate(known.tolist())}
    base = len(known) + 1
    total, cover = np.zeros((len(weights), len(chars))), np.zeros((len(weights), len(chars)), bool)
    lengths = np.array([len(g) for g in grams])
    for n in sorted(set(lengths.tolist()) - {0}):
        own = [i for i in np.flatnonzero(lengths == n).tolist() if all(c in number for c in grams[i])]
        if not own or n > len(chars):
            continue
        code, keys = np.zeros(len(chars) - n + 1, np.int64), np.zeros(len(own), np.int64)
        for k in range(n):  # the gram at each place as one number
            code, keys = code * base + char[k : k + len(code)] + 1, keys * base + np.array([number[grams[i][k]] for i in own])
            if base ** (k + 2) >= 1 << 62:  # too many different characters to write more: ranks instead
                both = np.unique(np.concatenate([code, keys]), return_inverse=True)[1]
                code, keys = both[: len(code)], both[len(code) :]
        order = np.argsort(keys)
        found = np.minimum(np.searchsorted(keys[order], code), len(own) - 1)
        at = np.flatnonzero(keys[order][found] == code)
        per = weights[:, np.array(own)[order]][:, found[at]] / n
        there = ~np.isnan(per)
        per = np.where(there, per, 0.0)
        for k in range(n):
            total[:, at + k] += per
            cover[:, at + k] |= there
    return total, cover


def text_evidence(weights: DataFrame, units: DataFrame) -> DataFrame:
    """(feature_set, uid, evidence): one number for each character of the text, null where no hit covers
    it (T11). `weights` holds feature_set, uid, gram, weight; `units` holds uid, text.

    One row for a text and set; a text's grams are gathered beside it, at most as many as it has places.
    """
    ship(units.sparkSession)
    listed = weights.groupBy("uid", "gram").agg(F.collect_list(F.struct("feature_set", "weight")).alias("sets"))
    listed = listed.groupBy("uid").agg(F.collect_list(F.struct("gram", "sets")).alias("grams"))
    kind = dict(units.dtypes)["uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 16) for x in batches for i in range(0, x.num_rows, 16)):
            of, names, rows = [], [], []
            for i, (text, grams) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                sets = sorted({s["feature_set"] for g in grams for s in g["sets"]})
                row = {s: k for k, s in enumerate(sets)}
                table = np.full((len(sets), len(grams)), np.nan)
                for j, g in enumerate(grams):
                    for s in g["sets"]:
                        table[row[s["feature_set"]], j] = s["weight"]
                total, cover = spread_weights(text, [g["gram"] for g in grams], table)
                for k, s in enumerate(sets):
                    of.append(i)
                    names.append(s)
                    rows.append(pa.array(total[k], pa.float64(), mask=~cover[k]))
            upto = pa.array(np.cumsum([0, *(len(r) for r in rows)]), pa.int32())
            flat = pa.concat_arrays([pa.array([], pa.float64()), *rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), b.column(0).take(pa.array(of, pa.int64())), pa.ListArray.from_arrays(upto, flat)], ["feature_set", "uid", "evidence"])

    return units.select("uid", "text").filter("text IS NOT NULL").join(listed, "uid").mapInArrow(run, f"feature_set string, uid {kind}, evidence array<double>")


def char_evidence(evidence: DataFrame) -> DataFrame:
    """A row for each character that a hit covers (T11), for reports that want rows."""
    rows = evidence.select(*KEY, F.posexplode("evidence").alias("pos", "evidence"))
    return rows.filter("evidence IS NOT NULL")


def _magnitude(values: Column, name: str, evidence: DataFrame, all_rows: bool = False) -> DataFrame:
    """Lower 95th percentile of the magnitudes above zero, inside each row."""
    sizes = F.sort_array(F.filter(F.transform(values, lambda v: F.round(F.abs(v), 12)), lambda v: v > 0))
    at = F.floor(F.lit(0.95) * (F.size("_s") - 1)).cast("int")
    return evidence.withColumn("_s", sizes).filter(F.lit(all_rows) | (F.size("_s") > 0)).withColumn(name, F.get("_s", at)).drop("_s")


def with_scale(evidence: DataFrame) -> DataFrame:
    """The texts with their scale beside them, inside the row; null where no evidence is above zero."""
    return _magnitude(F.col("evidence"), "scale", evidence, all_rows=True)


def evidence_scale(evidence: DataFrame) -> DataFrame:
    return _magnitude(F.col("evidence"), "scale", evidence).select(*KEY, "scale")


def strip(evidence: DataFrame) -> DataFrame:
    """Mean evidence per cell of the whole text, zero cells included (T12). A cell is 400 characters, more
    when the text would otherwise need over 600 cells."""
    n = F.size("evidence").cast("bigint")
    cell = F.greatest(F.lit(WINDOW), F.ceil(n / MAX_CELLS)).cast("bigint")
    shape = evidence.withColumn("n_chars", n).filter("n_chars > 0").withColumn("cell", cell)
    begins = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_chars") - 1) / F.col("cell")))

    def one(no: Column) -> Column:
        start = no * F.col("cell")
        end = F.least(start + F.col("cell"), F.col("n_chars"))
        inside = F.slice("evidence", (start + 1).cast("int"), (end - start).cast("int"))
        total = F.aggregate(inside, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
        return F.struct(no.alias("no"), start.alias("start"), end.alias("end"), (total / (end - start)).alias("mean"))

    return shape.select(*KEY, F.explode(F.transform(begins, one)).alias("c")).select(*KEY, "c.*")


def strip_scale(cells: DataFrame) -> DataFrame:
    """The same percentile over a strip's cells (at most 600)."""
    return _magnitude(F.col("m"), "strip_scale", cells.groupBy(*KEY).agg(F.collect_list("mean").alias("m"))).select(*KEY, "strip_scale")


def excerpt_rows(evidence: DataFrame, texts: DataFrame, offset: int = 0, size: int = EXCERPT) -> DataFrame:
    """One row per character of a bounded excerpt from a clamped offset, zeros included.

    `texts` holds uid, text."""
    at = F.greatest(F.lit(0), F.least(F.lit(offset), F.length("text") - 1))
    cut = evidence.join(texts.select("uid", "text"), "uid").select(
        *KEY, at.alias("from"), F.split(tx.slice_text("text", at, F.lit(size)), "").alias("_t"), F.slice("evidence", at + 1, F.lit(size)).alias("_e"))
    chars = cut.select(*KEY, "from", "_e", F.posexplode("_t").alias("i", "ch")).filter("ch <> ''")
    return chars.select(*KEY, (F.col("from") + F.col("i")).alias("pos"), "ch", F.round(F.coalesce(F.get("_e", F.col("i")), F.lit(0.0)), 4).alias("evidence"))


def excerpt(rows: DataFrame) -> DataFrame:
    """The excerpt as one row: its bounds, text and evidence values in order (at most 2,400)."""
    got = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "ch", "evidence"))).alias("x"))
    return got.select(
        *KEY, F.element_at("x", 1)["pos"].alias("start"), (F.element_at("x", -1)["pos"] + 1).alias("end"),
        F.array_join(F.transform("x", lambda e: e["ch"]), "").alias("text"), F.transform("x", lambda e: e["evidence"]).alias("evidence"),
    )


def evidence_bands(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Equal-coloured stretches of an excerpt (T20): side and strength 0-6 per character, line breaks
    skipped, neighbours of one band merged. `rows` come from `excerpt_rows`, so a text's window is small."""
    j = rows.filter(~F.col("ch").isin("\n", "\r")).join(scales, KEY, "left").fillna(1.0, ["scale"])
    level = F.least(F.lit(BANDS), F.floor(F.abs("evidence") / F.col("scale") * BANDS + 0.5)).cast("int")
    band = F.when(F.col("evidence") != 0, F.concat(F.when(F.col("evidence") > 0, "a").otherwise("b"), level.cast("string"))).otherwise("")
    w = Window.partitionBy(*KEY).orderBy("pos")
    flagged = j.withColumn("band", band).withColumn("_new", (~F.lag("band").over(w).eqNullSafe(F.col("band"))).cast("int"))
    island = flagged.withColumn("stretch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*KEY, "stretch").agg(
        F.first("band").alias("band"), F.min("pos").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda e: e["ch"]), "").alias("text"),
    )


# --- reports ----------------------------------------------------------------------------------------------
def unit_listing(judged: DataFrame) -> DataFrame:
    """Every unit with a text: id, label, script characters, whether it is profiled."""
    return judged.filter("text IS NOT NULL").select("uid", "label", "chars", (F.col("fate") == "kept").alias("profiled"))


def leaks(targets: DataFrame, feed: DataFrame, withhold: DataFrame | None = None) -> DataFrame:
    """Units that would feed a profile they must stay out of: withheld ones still in the feed, and units
    that the feed files under another work than the target list does, so that withholding a target's work
    would leave its own text in (T5). Frames hold `uid`, `work`; empty is right."""
    moved = feed.select("uid", F.col("work").alias("_w")).join(targets.select("uid", "work"), "uid").filter(~F.col("_w").eqNullSafe(F.col("work")))
    out = moved.select("uid", F.lit("under another work").alias("why"))
    if withhold is None:
        return out
    return out.unionByName(feed.select("uid").join(withhold.select("uid").distinct(), "uid", "left_semi").select("uid", F.lit("withheld").alias("why")))


def sensitivity(targets: DataFrame, counts: DataFrame, kept: DataFrame, vocab: DataFrame, withhold: DataFrame) -> DataFrame:
    """Leader, margin and gap of every target with and without some units withheld.

    Both scenarios are columns of one pass: every count is summed for all units and for those that are
    left, and what leaves a profile is a difference of the two, so counts are joined once. A unit that
    would leak into a profile, and a withheld unit that is not profiled, are errors.
    """
    asked = withhold.select("uid").distinct()
    unknown = [r["uid"] for r in asked.join(kept, "uid", "left_anti").limit(3).collect()]
    if unknown:
        raise ValueError(f"cannot withhold units that are not profiled: {unknown}")
    leaked = [r["uid"] for r in leaks(targets, kept).limit(3).collect()]
    if leaked:
        raise ValueError(f"profiles would hold units of the target's own work: {leaked}")
    cases = ("all", "withheld")
    fed = counts.join(kept.select("uid", "label", "work").join(asked.withColumn("_out", F.lit(True)), "uid", "left"), "uid")
    n = {"all": F.col("n"), "withheld": F.when(F.col("_out").isNull(), F.col("n")).otherwise(0)}
    by_work = fed.groupBy("feature_set", "label", "work", "gram").agg(*[F.sum(n[c]).alias(c) for c in cases])
    both = lambda: [F.sum(c).alias(c) for c in cases]
    grams = by_work.groupBy("feature_set", "gram", "label").agg(*both())
    own = by_work.groupBy("feature_set", "work", "gram").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct(*cases)))).alias("own"))
    totals = by_work.groupBy("feature_set", "label").agg(*[F.sum(c).alias(f"total_{c}") for c in cases])
    own_totals = by_work.groupBy("feature_set", "work", "label").agg(*[F.sum(c).alias(f"own_{c}") for c in cases])
    sizes = vocab.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_features"))

    hits = target_hits(targets, counts)
    cells = counts.join(hits.select(*KEY, "work"), KEY).join(own, ["feature_set", "work", "gram"], "left").join(grams, ["feature_set", "gram"])
    mine = F.try_element_at("own", F.col("label"))
    gain = lambda c: F.col("n") * (F.log(F.col(c) - F.coalesce(mine[c], F.lit(0)) + 0.5) - F.log(F.lit(0.5)))
    sums = cells.groupBy(*KEY, "label").agg(*[F.sum(gain(c)).alias(f"gain_{c}") for c in cases])
    live = _beside(hits.filter("hits > 0").drop("label"), totals.join(sizes, "feature_set")).join(own_totals, ["feature_set", "work", "label"], "left").join(sums, [*KEY, "label"], "left")

    def scored(c: str) -> Column:
        tokens = F.col(f"total_{c}") - F.coalesce(f"own_{c}", F.lit(0))
        score = F.coalesce(f"gain_{c}", F.lit(0.0)) + F.col("hits") * (F.log(F.lit(0.5)) - F.log(tokens + F.lit(0.5) * F.col("n_features")))
        return F.struct(F.lit(c).alias("case"), F.when(tokens > 0, score).alias("score"))

    rows = live.select(*KEY, "label", F.explode(F.array(*[scored(c) for c in cases])).alias("s")).select(*KEY, "label", "s.*").filter("score IS NOT NULL")
    best = F.min(F.struct(-F.round("score", 6), "label", "score"))
    lead = rows.groupBy(*KEY, "case").agg(best.alias("lead"), F.count(F.lit(1)).alias("profiles"))
    rest = rows.join(lead.select(*KEY, "case", F.col("lead.label").alias("_l")), [*KEY, "case"]).filter("label <> _l").groupBy(*KEY, "case").agg(F.max("score").alias("second"))
    found = lead.join(rest, [*KEY, "case"], "left").withColumn("gap", F.when(F.col("profiles") >= 2, F.col("lead.score") - F.col("second")))
    at = lambda c, v: F.max(F.when((F.col("case") == c) & (F.col("profiles") >= 2), v))
    wide = found.groupBy(*KEY).agg(*[x for c in cases for x in (at(c, F.col("lead.label")).alias(f"first_{c}"), at(c, F.col("gap")).alias(f"gap_{c}"))])
    out = hits.join(wide, KEY, "left")
    for c in cases:
        out = out.withColumn(f"margin_{c}", F.coalesce(F.try_divide(f"gap_{c}", "distinct"), F.lit(0.0))).withColumn(f"gap_{c}", F.coalesce(f"gap_{c}", F.lit(0.0)))
    return out.select(*KEY, *[f"{m}_{c}" for c in cases for m in ("first", "margin", "gap")]).withColumn("leader_flips", ~F.col("first_all").eqNullSafe(F.col("first_withheld")))


def with_provenance(df: DataFrame, ledger: DataFrame, dataset: str) -> DataFrame:
    """Stamp answers with the hash of the text they came from, the dataset and the method version.

    `ledger` comes from `content_ledger` and holds uid, sha256."""
    return df.join(ledger.select("uid", F.col("sha256").alias("text_sha256")), "uid", "left").withColumn(
        "dataset", F.lit(dataset)
    ).withColumn("method_version", F.lit(METHOD_VERSION))


def compact_evidence(verdict: DataFrame, pair: DataFrame, top_rows: DataFrame, rows: int = 5) -> DataFrame:
    """The short read of one answer: verdict, pair and the first few grams each way."""
    few = top_rows.filter(F.col("rank") <= rows)
    side = lambda s: F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "gram")))), lambda e: e["gram"]))
    lists = few.groupBy(*KEY).agg(side("for").alias("grams_for"), side("against").alias("grams_against"))
    return verdict.join(pair.select(*KEY, "a", "b", "pair_gap"), KEY, "left").join(lists, KEY, "left")
