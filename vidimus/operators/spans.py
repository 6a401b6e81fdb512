"""Citable spans, phrase search and passages in context."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, top_k_per
from vidimus.operators.phrase_index import add_spans
from vidimus.operators.phrases import match_phrases

MIN_RUN_CHARS = 2
TAG = "<[^>]+>"


def judged_runs(body: Column | str, min_chars: int = MIN_RUN_CHARS, cls: str = tx.HAN_RUN) -> Column:
    """Array of the distinct tag-free runs of a body in order, each with why it is or is not citable.

    Everything happens inside the row: no shuffle, and the body is never copied per run.
    """
    body = F.col(body) if isinstance(body, str) else body
    runs = F.array_distinct(F.transform(F.split(body, TAG), tx.strip_space))
    outcome = lambda r: (
        F.when((F.length(r) < min_chars) | ~tx.has_script(r, cls), "too_short")
        .when(~tx.is_unique_in(body, r), "not_unique")
        .otherwise("citable")
    )
    return F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.struct(r.alias("span"), outcome(r).alias("outcome")))


def citable_spans(docs: DataFrame, min_chars: int = MIN_RUN_CHARS, cls: str = tx.HAN_RUN) -> tuple[DataFrame, DataFrame]:
    """Spans that can be located without doubt, with their place among the document's distinct runs, and
    the ledger of the rest (C1)."""
    runs = docs.select("doc", F.posexplode(judged_runs("body", min_chars, cls)).alias("ord", "r")).select("doc", "ord", "r.*")
    ledger = runs.groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"))
    return runs.filter("outcome = 'citable'").select("doc", F.col("ord").alias("span_no"), "span"), ledger


def span_report(docs: DataFrame, min_chars: int = MIN_RUN_CHARS, cls: str = tx.HAN_RUN) -> DataFrame:
    """Entries indexed and skipped, runs kept, not unique and too short, in one pass."""
    j = docs.select("doc", judged_runs("body", min_chars, cls).alias("runs"))
    n = lambda kind: F.size(F.filter("runs", lambda r: r["outcome"] == kind))
    per = j.select(n("citable").alias("ok"), n("not_unique").alias("nu"), n("too_short").alias("ts"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(
        F.count_if(F.col("ok") > 0).alias("entries_indexed"), F.count_if(F.col("ok") == 0).alias("entries_skipped"),
        total("ok").alias("runs_indexed"), total("nu").alias("runs_not_unique"), total("ts").alias("runs_too_short"),
    )


def build_span_table(docs: DataFrame, root: str, **kw) -> tuple[DataFrame, DataFrame]:
    """Index the citable spans of documents the index below `root` does not hold yet; the builds so far
    and the report of these documents (C2). Search it with `phrase_index.search_index`."""
    spans, _ = citable_spans(docs, **kw)
    return add_spans(spans, root), span_report(docs, **kw)


# --- phrase search --------------------------------------------------------------------------------------
def search(spans: DataFrame, queries: DataFrame, k: int | None = 20, order: list[str] | None = None) -> DataFrame:
    """Documents with a span that contains the phrase, the first such span each, in corpus order.

    `queries` holds `query_id`, `query`. `k` keeps the first k documents per query, which is a corpus
    order cut and not a ranking; None keeps all.
    """
    hits = match_phrases(spans, "span", queries)
    first = hits.groupBy("query_id", "query", "doc").agg(F.min_by("span", "span_no").alias("span"), F.min("span_no").alias("span_no"))
    if k is None:
        return first
    return top_k_per(first, ["query_id"], [F.col(c) for c in (order or ["doc"])], k)


def filter_collection(hits: DataFrame, prefix: str, k: int, column: str = "doc") -> DataFrame:
    """Hits of one collection, cut after the filter so nothing starves (P10). Feed uncut hits."""
    kept = hits.filter(F.startswith(F.col(column), F.lit(prefix)))
    return top_k_per(kept, ["query_id"], [F.col("doc")], k)


def search_text(docs: DataFrame, queries: DataFrame, k: int | None = 20, around: int = 10) -> DataFrame:
    """Phrase search over whole texts with case, marks, spaces and punctuation folded away (C4).

    The snippet shows the literal match with a little context, null when only the folded form matched.
    """
    rows = docs.select("ref", "title", "text").withColumn("_folded", tx.fold("text"))
    folded = queries.withColumn("_phrase", tx.fold("query"))
    hits = match_phrases(rows, "_folded", folded, "_phrase")
    at = tx.first_at("text", "query")
    start = F.greatest(at - around, F.lit(0))
    snippet = F.when(at >= 0, tx.slice_text("text", start, at + F.length("query") + around - start))
    out = hits.select("query_id", "query", "ref", "title", snippet.alias("snippet"))
    return out if k is None else top_k_per(out, ["query_id"], [F.col("ref")], k)


def search_excerpts(excerpts: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Search in a hand-made list of excerpts: every matching excerpt is a hit.

    `excerpts` holds `doc`, `ord`, `excerpt`."""
    hits = match_phrases(excerpts, "excerpt", queries)
    return top_k_per(hits, ["query_id"], [F.col("doc"), F.col("ord")], k)


def phrase_df(spans: DataFrame, queries: DataFrame, cap: int | None = None) -> DataFrame:
    """In how many documents each phrase occurs; a capped count says it is a floor."""
    docs = match_phrases(spans, "span", queries).select("query_id", "doc").distinct()
    counted = docs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    full = queries.select("query_id").join(counted, "query_id", "left").fillna(0, ["n"])
    if cap is None:
        return full.withColumn("saturated", F.lit(False))
    return full.select("query_id", F.least("n", F.lit(cap)).alias("n"), (F.col("n") >= cap).alias("saturated"))


def locate_spans(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """Cited excerpts looked up in their document: found once, not found, or not unique.

    `cites` holds `doc`, `excerpt`; `docs` holds `doc`, `body`."""
    j = cites.join(docs, "doc", "left")
    status = (
        F.when(F.col("body").isNull(), "no_document")
        .when(tx.first_at("body", "excerpt") < 0, "not_found")
        .when(tx.occurs_again("body", "excerpt"), "not_unique")
        .otherwise("located")
    )
    start = tx.first_at("body", "excerpt")
    located = F.col("status") == "located"
    return j.withColumn("status", status).select(
        *cites.columns, "status", F.when(located, start).alias("span_start"),
        F.when(located, start + F.length("excerpt")).alias("span_end"),
    )


def resolve_numbers(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Bare numbers to every reference they may name.

    `refs` holds `number`; `catalogue` holds `number` (bare, lower case), `ref`. An exact match wins,
    otherwise lettered siblings are all returned. Ambiguity is reported, never guessed away.
    """
    want = cut_lineage(refs.select("number").distinct()).withColumn("key", F.lower(F.trim("number")))
    cat = catalogue.select(F.lower("number").alias("key"), "ref").distinct()
    exact = want.join(cat, "key")
    rest = want.join(cat.select("key").distinct(), "key", "left_anti").withColumn("stem", tx.strip_letters("key"))
    sibling = rest.join(cat.select(tx.strip_letters("key").alias("stem"), "ref").distinct(), "stem").select("key", "number", "ref")
    found = exact.select("number", "ref").union(sibling.select("number", "ref")).distinct()
    got = found.groupBy("number").agg(F.array_sort(F.collect_list("ref")).alias("candidates"))
    return want.select("number").join(got, "number", "left").select(
        "number", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")
    ).withColumn(
        "outcome",
        F.when(F.size("candidates") == 0, "unknown").when(F.size("candidates") == 1, "resolved").otherwise("ambiguous"),
    )


# --- passages in context ---------------------------------------------------------------------------------
def located(text: Column, excerpt: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Start offset and how it was found: the recorded span if it still holds, else the first match."""
    holds = start.isNotNull() & (tx.slice_text(text, start, end - start) == excerpt)
    first = tx.first_at(text, excerpt)
    at = F.when(holds, start).when(first >= 0, first)
    how = (
        F.when(excerpt.isNull() | (excerpt == ""), "no_excerpt").when(text.isNull(), "no_source").when(holds, "verified_span")
        .when(first < 0, "not_found").when(start.isNotNull(), "stale_verified_span").otherwise("first_match")
    )
    return at, how


def kwic(passages: DataFrame, docs: DataFrame, window: int = 10) -> DataFrame:
    """Passages with text on both sides.

    `passages` holds `id`, `source_ref`, `excerpt`, `span_start`, `span_end` (the last recorded span or
    null); `docs` holds `ref`, `text`. Passages that cannot be placed come out with the reason.
    """
    j = passages.join(docs.select(F.col("ref").alias("source_ref"), "text"), "source_ref", "left")
    at, how = located(F.col("text"), F.col("excerpt"), F.col("span_start"), F.col("span_end"))
    j = j.withColumn("location", how).withColumn("_at", F.when(~how.isin("no_excerpt", "no_source", "not_found"), at))
    end = F.col("_at") + F.length("excerpt")
    left = F.greatest(F.col("_at") - window, F.lit(0))
    return j.select(
        "id", "source_ref", "location", F.col("_at").alias("start"),
        tx.slice_text("text", left, F.col("_at") - left).alias("before"),
        F.when(F.col("_at").isNotNull(), F.col("excerpt")).alias("excerpt"),
        tx.slice_text("text", end, F.lit(window)).alias("after"),
        (F.col("_at") - window > 0).alias("has_more_before"), (end + window < F.length("text")).alias("has_more_after"),
    )


def record_window(docs: DataFrame, max_chars: int, offset: int = 0, strip: bool = False) -> DataFrame:
    """A window of each record with its true size; an offset past the end is flagged, never wrapped."""
    shown = tx.strip_markup("text") if strip else F.col("text")
    j = docs.select("ref", F.length("text").alias("raw_total_chars"), shown.alias("_t"))
    past = F.lit(offset) > F.length("_t")
    return j.select(
        "ref", "raw_total_chars", F.length("_t").alias("total_chars"),
        F.when(past, F.lit(None)).otherwise(tx.slice_text("_t", F.lit(offset), F.lit(max_chars))).alias("text"),
        (F.length("_t") > offset + max_chars).alias("truncated"), F.lit(not strip).alias("offsets_align"),
        past.alias("offset_past_end"),
    )


def segments(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Alternating shared and plain stretches of each text window.

    `windows` holds `key`, `start`, `text`; `runs` holds `key`, `run_start`, `run_end` in document
    offsets. Runs are clipped to the window, touching ones merge, gaps come out as plain stretches.
    A window is one short text, so its runs are worked on inside one row.
    """
    got = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run_start", "run_end"))).alias("runs"))
    j = windows.join(got, "key", "left").withColumn("_len", F.length("text"))
    clipped = F.filter(
        F.transform(
            F.coalesce("runs", F.array().cast("array<struct<run_start:bigint,run_end:bigint>>")),
            lambda r: F.struct(
                F.greatest(F.lit(0), r["run_start"] - F.col("start")).cast("bigint").alias("a"),
                F.least(F.col("_len"), r["run_end"] - F.col("start")).cast("bigint").alias("b"),
            ),
        ),
        lambda r: r["a"] < r["b"],
    )
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def merge(acc: Column, r: Column) -> Column:
        touching = (F.size(acc) > 0) & (r["a"] <= F.try_element_at(acc, F.lit(-1))["b"])
        grown = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], r["b"]).alias("b"))),
        )
        return F.when(touching, grown).otherwise(F.concat(acc, F.array(r)))

    merged = F.aggregate(F.array_sort(clipped), empty, merge)
    j = j.withColumn("_m", merged)
    # ends of the stretches: window edges plus both ends of every merged run
    cuts = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0).cast("bigint"), F.col("_len").cast("bigint")),
        F.flatten(F.transform("_m", lambda r: F.array(r["a"], r["b"]))),
    )))
    j = j.withColumn("_cuts", cuts)
    pieces = F.transform(
        F.slice("_cuts", F.lit(1), F.greatest(F.size("_cuts") - 1, F.lit(0))),
        lambda a, i: F.struct(a.alias("a"), F.get(F.col("_cuts"), i + 1).alias("b")),
    )
    out = j.select("key", "start", "text", "_m", F.posexplode(pieces).alias("ord", "p"))
    return out.select(
        "key", "ord", (F.col("start") + F.col("p.a")).alias("start"), (F.col("start") + F.col("p.b")).alias("end"),
        tx.slice_text("text", F.col("p.a"), F.col("p.b") - F.col("p.a")).alias("text"),
        F.exists("_m", lambda r: (r["a"] <= F.col("p.a")) & (F.col("p.b") <= r["b"])).alias("shared"),
    )
