"""Queries over texts: spans, phrase search, verification, intake, cross-references."""
from __future__ import annotations

from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, scratch_path
from vidimus.operators import phrase_index as pi
from vidimus.operators import spans as sp
from vidimus.operators import verify as vf
from vidimus.operators import xref as xr
from vidimus.plans import inputs as inp
from vidimus.plans.registry import query
from vidimus.sources import catalogue as cat
from vidimus.sources import corpus as co

LET = tx.LETTER


def _pages(spark, sf):
    return inp.table(spark, sf, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("body"))


# --- spans ---------------------------------------------------------------------------------------------
SPAN_SQL = r"""
ch AS (SELECT page_id AS doc, html, unnest(string_split_regex(html, '<[^>]+>')) AS raw, generate_subscripts(string_split_regex(html, '<[^>]+>'), 1) AS i FROM pages),
tr AS (SELECT doc, html, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS span FROM ch),
uq AS (SELECT doc, any_value(html) AS html, span, min(i) AS i FROM tr WHERE span <> '' GROUP BY doc, span),
jd AS (SELECT doc, span, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS span_no, CASE WHEN length(span) < 2 OR NOT regexp_matches(span, '\p{L}') THEN 'too_short'
  WHEN strpos(html, span) = 0 OR strpos(substr(html, strpos(html, span) + 1), span) > 0 THEN 'not_unique' ELSE 'citable' END AS outcome FROM uq),
spn AS (SELECT doc, span_no, span FROM jd WHERE outcome = 'citable')
"""


@query("citable_spans", f"WITH {SPAN_SQL} SELECT doc, span_no, span FROM spn")
def citable_spans(spark, sf):
    return sp.citable_spans(_pages(spark, sf), cls=LET)[0].withColumn("span_no", F.col("span_no").cast("bigint"))


@query("span_ledger", f"WITH {SPAN_SQL} SELECT outcome, count(*) AS runs FROM jd GROUP BY 1")
def span_ledger(spark, sf):
    return sp.citable_spans(_pages(spark, sf), cls=LET)[1]


@query("span_report", f"WITH {SPAN_SQL}, d AS (SELECT p.page_id, count(spn.span) AS n FROM pages p LEFT JOIN spn ON spn.doc = p.page_id GROUP BY 1) SELECT (SELECT count(*) FROM d WHERE n > 0) AS entries_indexed, (SELECT count(*) FROM d WHERE n = 0) AS entries_skipped, count(*) FILTER (outcome = 'citable') AS runs_indexed, count(*) FILTER (outcome = 'not_unique') AS runs_not_unique, count(*) FILTER (outcome = 'too_short') AS runs_too_short FROM jd")
def span_report(spark, sf):
    return sp.span_report(_pages(spark, sf), cls=LET)


@query("display_text", r"SELECT page_id AS doc, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS t FROM pages)")
def display_text(spark, sf):
    t = _pages(spark, sf).select("doc", tx.strip_markup("body").alias("t"))
    return t.select("doc", F.length("t").alias("chars"), F.md5("t").alias("digest"))


# --- search --------------------------------------------------------------------------------------------
HITS_SQL = f"""
ln AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS span, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS span_no FROM documents),
{inp.PHRASES_SQL},
hit AS (SELECT query_id, query, doc, min(span_no) AS span_no, arg_min(span, span_no) AS span FROM qs JOIN ln ON contains(ln.span, qs.query) WHERE trim(query) <> '' GROUP BY 1, 2, 3)
"""


@query("phrase_search", f"WITH {HITS_SQL} SELECT query_id, doc, span_no, span FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc) <= 5")
def phrase_search(spark, sf):
    return sp.search(inp.line_spans(spark, sf), inp.phrases(spark, sf), k=5).select("query_id", "doc", "span_no", "span")


# one phrase of every document (its longest line), every turn of a conversation and every benchmark sentence, over whole texts
@query("phrase_search_many", f"""WITH {inp.PHRASES_SQL}, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
many AS (SELECT query FROM qs UNION SELECT line FROM (SELECT line FROM ln QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, i) = 1) UNION SELECT text FROM conversations)
SELECT query, count(*) AS docs, min(doc_id) AS first_doc FROM many JOIN documents d ON contains(d.text, many.query) WHERE trim(query) <> '' GROUP BY 1""")
def phrase_search_many(spark, sf):
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    said = inp.table(spark, sf, "conversations").select(F.col("text").alias("query"))
    many = inp.phrases(spark, sf).select("query").union(docs.select(longest.alias("query"))).union(said).distinct()
    hits = sp.match_phrases(docs, "text", many)
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("first_doc"))


# pieces of five lengths of every page's first citable span, looked up in the index that holds all pages
PIECES_SQL = """pc AS (SELECT DISTINCT q FROM (SELECT unnest([span, substr(span, 1, 12), substr(span, 2, 3), substr(span, 2, 2), substr(span, 1, 1)]) AS q FROM spn QUALIFY row_number() OVER (PARTITION BY doc ORDER BY span_no) = 1) WHERE trim(q) <> '')"""


def _span_index(spark, sf):
    """The index of all pages, built in two steps: first the pages with even ids, then all."""
    root = scratch_path(spark, "span-index")
    pages = _pages(spark, sf)
    sp.build_span_table(pages.filter("doc % 2 = 0"), root, cls=LET)
    return root, sp.build_span_table(pages, root, cls=LET)[0]


@query("span_index_builds", f"WITH {SPAN_SQL} SELECT CAST(doc % 2 AS INT) AS build, count(DISTINCT doc) AS documents, count(*) AS spans FROM spn GROUP BY 1")
def span_index_builds(spark, sf):
    return _span_index(spark, sf)[1].select("build", "documents", "spans")


@query("span_index_search", f"WITH {SPAN_SQL}, {PIECES_SQL} SELECT q AS query, doc, min(span_no) AS span_no, arg_min(span, span_no) AS span FROM pc JOIN spn ON contains(span, q) GROUP BY 1, 2")
def span_index_search(spark, sf):
    root, _ = _span_index(spark, sf)
    first = sp.citable_spans(_pages(spark, sf), cls=LET)[0].groupBy("doc").agg(F.min_by("span", "span_no").alias("span"))
    cut = lambda at, n: F.substring("span", at, n)
    pieces = first.select(F.explode(F.array(F.col("span"), cut(1, 12), cut(2, 3), cut(2, 2), cut(1, 1))).alias("query")).distinct()
    hits = pi.search_index(spark, root, pieces.withColumn("query_id", F.xxhash64("query")))
    return hits.select("query", F.col("doc").cast("bigint").alias("doc"), "span_no", "span")


@query("collection_search", f"WITH {HITS_SQL} SELECT query_id, doc FROM (SELECT * FROM hit WHERE starts_with(CAST(doc AS VARCHAR), '1')) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CAST(doc AS VARCHAR)) <= 3")
def collection_search(spark, sf):
    hits = sp.search(inp.line_spans(spark, sf), inp.phrases(spark, sf), k=None).withColumn("doc", F.col("doc").cast("string"))
    return sp.filter_collection(hits, "1", 3).select("query_id", F.col("doc").cast("bigint").alias("doc"))


@query("folded_search", r"""WITH d AS (SELECT doc_id AS ref, text, regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', '', 'g') AS f FROM documents),
q AS (SELECT item_id AS query_id, translate(text, 'aeionrst', 'AEIONRST') AS query, regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', '', 'g') AS f FROM benchmark UNION ALL SELECT item_id + 1000000, text, regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', '', 'g') FROM benchmark)
SELECT query_id, ref, CASE WHEN strpos(d.text, query) > 0 THEN substr(d.text, greatest(strpos(d.text, query) - 10, 1), strpos(d.text, query) + length(query) + 10 - greatest(strpos(d.text, query) - 10, 1)) END AS snippet
FROM q JOIN d ON contains(d.f, q.f) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ref) <= 20""")
def folded_search(spark, sf):
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), F.col("source").alias("title"), "text")
    b = inp.table(spark, sf, "benchmark")
    both = b.select(F.explode(F.array(
        F.struct(F.col("item_id").alias("query_id"), F.translate("text", "aeionrst", "AEIONRST").alias("query")), F.struct((F.col("item_id") + 1000000).alias("query_id"), F.col("text").alias("query")))).alias("q")).select("q.*")
    return sp.search_text(docs, both, k=20).select("query_id", "ref", "snippet")


@query("excerpt_search", """WITH x AS (SELECT conv_id AS doc, turn AS ord, text AS excerpt FROM conversations), q AS (SELECT DISTINCT text AS query FROM conversations)
SELECT query, doc, ord FROM q JOIN x ON contains(excerpt, query) WHERE trim(query) <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc, ord) <= 20""")
def excerpt_search(spark, sf):
    conv = inp.table(spark, sf, "conversations")
    q = conv.select(F.col("text").alias("query")).distinct().withColumn("query_id", F.col("query"))
    x = conv.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.col("text").alias("excerpt"))
    return sp.search_excerpts(x, q).select("query", "doc", "ord")


@query("phrase_counts", f"WITH {HITS_SQL} SELECT qs.query_id, least(count(hit.doc), 2) AS n, count(hit.doc) >= 2 AS saturated FROM qs LEFT JOIN hit USING (query_id) GROUP BY 1")
def phrase_counts(spark, sf):
    return sp.phrase_df(inp.line_spans(spark, sf), inp.phrases(spark, sf), cap=2).withColumn("n", F.col("n").cast("bigint"))


@query("located_cites", """WITH c AS (SELECT doc_id AS doc, substr(text, CAST(5 + (doc_id * 131) % greatest(length(text) - 30, 1) AS INTEGER), CAST(6 + doc_id % 40 AS INTEGER)) AS excerpt, text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'no such text here', text FROM documents WHERE doc_id % 7 = 0)
SELECT doc, excerpt, CASE WHEN p = 0 THEN 'not_found' WHEN again THEN 'not_unique' ELSE 'located' END AS status, CASE WHEN p > 0 AND NOT again THEN p - 1 END AS span_start, CASE WHEN p > 0 AND NOT again THEN p - 1 + length(excerpt) END AS span_end
FROM (SELECT *, strpos(text, excerpt) AS p, strpos(substr(text, strpos(text, excerpt) + 1), excerpt) > 0 AS again FROM c) WHERE excerpt <> ''""")
def located_cites(spark, sf):
    docs = inp.table(spark, sf, "documents")
    cut = F.expr("CASE WHEN doc_id % 7 = 0 THEN 'no such text here' ELSE substring(text, cast(5 + (doc_id * 131) % greatest(length(text) - 30, 1) AS int), cast(6 + doc_id % 40 AS int)) END")
    cites = docs.select(F.col("doc_id").alias("doc"), cut.alias("excerpt")).filter("excerpt <> ''")
    return sp.locate_spans(cites, docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body")))


# every document cited once, anywhere in its text; a third of the recorded spans are five characters off
CITED_AT = "CAST(10 + (doc_id * 131) % greatest(length(text) - 40, 1) AS INT)"


def _passages(docs):
    off = F.expr(f"{CITED_AT} + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END")
    cited = F.expr(f"CASE WHEN doc_id % 11 = 0 THEN 'not in there' WHEN doc_id % 13 = 0 THEN NULL ELSE substring(text, {CITED_AT} + 1, 20) END")
    has = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("source_ref"), cited.alias("excerpt"),
        F.when(has, off.cast("bigint")).alias("span_start"), F.when(has, (off + 20).cast("bigint")).alias("span_end"),
        F.when(has, tx.sha256(cited)).alias("excerpt_hash"),
    )


PASSAGE_SQL = f"""
psg AS (SELECT doc_id AS id, text, CASE WHEN doc_id % 11 = 0 THEN 'not in there' WHEN doc_id % 13 = 0 THEN NULL ELSE substr(text, {CITED_AT} + 1, 20) END AS excerpt,
  CASE WHEN doc_id % 2 = 0 THEN {CITED_AT} + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END END AS s FROM documents),
loc AS (SELECT *, coalesce(excerpt, '') = '' AS none, strpos(text, excerpt) - 1 AS first_, s IS NOT NULL AND substr(text, s + 1, 20) = excerpt AS holds FROM psg)
"""


@query("passages_in_context", f"""WITH {PASSAGE_SQL}, k AS (SELECT *, CASE WHEN none THEN 'no_excerpt' WHEN holds THEN 'verified_span' WHEN first_ < 0 THEN 'not_found' WHEN s IS NOT NULL THEN 'stale_verified_span' ELSE 'first_match' END AS location,
  CASE WHEN none THEN NULL WHEN holds THEN s WHEN first_ >= 0 THEN first_ END AS at_ FROM loc)
SELECT id, location, CAST(at_ AS BIGINT) AS start, substr(text, greatest(at_ - 10, 0) + 1, at_ - greatest(at_ - 10, 0)) AS before, CASE WHEN at_ IS NOT NULL THEN excerpt END AS excerpt, substr(text, at_ + length(excerpt) + 1, 10) AS after,
  at_ - 10 > 0 AS has_more_before, at_ + length(excerpt) + 10 < length(text) AS has_more_after FROM k""")
def passages_in_context(spark, sf):
    docs = inp.table(spark, sf, "documents")
    out = sp.kwic(_passages(docs), docs.select(F.col("doc_id").alias("ref"), "text"))
    return out.drop("source_ref").withColumn("start", F.col("start").cast("bigint"))


@query("span_verification", f"""WITH {PASSAGE_SQL}
SELECT id, CASE WHEN none THEN 'indeterminate' WHEN first_ < 0 THEN 'fail' WHEN s IS NOT NULL AND s <> first_ THEN 'fail' WHEN s IS NOT NULL AND length(excerpt) <> 20 THEN 'fail' ELSE 'pass' END AS result,
  CASE WHEN NOT none AND first_ >= 0 AND (s IS NULL OR (s = first_ AND length(excerpt) = 20)) THEN 'A2_EXACT_SPAN_MATCHED' ELSE 'A0_UNCHECKED' END AS assurance_level,
  CASE WHEN NOT none THEN sha256(text) END AS source_hash, CASE WHEN NOT none AND first_ >= 0 THEN sha256(excerpt) END AS excerpt_hash,
  CASE WHEN NOT none AND first_ >= 0 THEN first_ END AS span_start, CASE WHEN NOT none AND first_ >= 0 THEN first_ + length(excerpt) END AS span_end FROM loc""")
def span_verification(spark, sf):
    docs = inp.table(spark, sf, "documents")
    p = _passages(docs)
    prior = p.filter("span_start IS NOT NULL").select("id", "span_start", "span_end", "excerpt_hash")
    return vf.verify_spans(p, docs.select(F.col("doc_id").alias("ref"), "text"), prior).drop("method", "detail")


@query("tamper_control", """SELECT altered, result, integrity, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 0 THEN true ELSE false END AS altered, 'intact' AS integrity, CASE WHEN doc_id % 10 = 0 THEN 'fail' ELSE 'pass' END AS result FROM documents WHERE length(text) > 10) GROUP BY 1, 2, 3""")
def tamper_control(spark, sf):
    docs = inp.table(spark, sf, "documents").filter("length(text) > 10")
    payload = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source_ref"), F.expr("substring(text, cast(11 + (doc_id * 131) % greatest(length(text) - 40, 1) AS int), 20)").alias("excerpt")))
    nodes = docs.select(F.concat(F.lit("passage:"), F.col("doc_id").cast("string")).alias("id"), F.lit("passage").alias("type"), payload.alias("payload")).withColumn("payload_hash", tx.sha256("payload"))
    out = vf.tamper_control(nodes, docs.select(F.col("doc_id").cast("string").alias("ref"), "text"), pick=F.col("id").rlike("0$"))
    return out.groupBy("altered", "result", "integrity").agg(F.count(F.lit(1)).alias("n"))


@query("record_windows", "SELECT doc_id AS ref, length(text) AS total_chars, CASE WHEN 50 > length(text) THEN NULL ELSE substr(text, 51, 120) END AS text, length(text) > 170 AS truncated, 50 > length(text) AS offset_past_end FROM documents")
def record_windows(spark, sf):
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("ref"), "text")
    return sp.record_window(docs, 120, offset=50).drop("raw_total_chars", "offsets_align")


# every text in windows of 200 characters, with runs of up to 60 characters all along it, some of which touch, overlap or cross a window's edge
@query("shared_segments", """WITH w AS (SELECT doc_id, i * 200 AS start, substr(text, CAST(i * 200 + 1 AS INTEGER), 200) AS text FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 200) AS BIGINT))) AS i FROM documents)),
r AS (SELECT doc_id, j * 97 + doc_id % 50 AS a, j * 97 + doc_id % 50 + (j * 13 + doc_id) % 120 AS b FROM (SELECT doc_id, unnest(range(CAST(length(text) // 97 + 1 AS BIGINT))) AS j FROM documents)),
c AS (SELECT doc_id, start, text, unnest(range(CAST(length(text) AS BIGINT))) AS i FROM w), h AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS at_ FROM r),
f AS (SELECT c.*, h.at_ IS NOT NULL AS shared FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.at_ = c.start + c.i),
g AS (SELECT *, sum(CASE WHEN shared = lag_ THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, start ORDER BY i) AS island FROM (SELECT *, lag(shared) OVER (PARTITION BY doc_id, start ORDER BY i) AS lag_ FROM f))
SELECT doc_id, start + min(i) AS start, start + max(i) + 1 AS "end", shared, substr(any_value(text), CAST(min(i) AS INTEGER) + 1, CAST(count(*) AS INTEGER)) AS text FROM g GROUP BY doc_id, start, island, shared""")
def shared_segments(spark, sf):
    docs = inp.table(spark, sf, "documents").filter("length(text) > 0")
    key = F.struct("doc_id", "no")
    w = docs.select("doc_id", "text", F.explode(F.expr("sequence(0L, (length(text) - 1) div 200)")).alias("no"))
    w = w.select(key.alias("key"), (F.col("no") * 200).alias("start"), F.expr("substring(text, cast(no * 200 + 1 AS int), 200)").alias("text"))
    runs = docs.select("doc_id", F.explode(F.expr("sequence(0L, length(text) div 97)")).alias("j"))
    runs = runs.select("doc_id", F.expr("j * 97 + doc_id % 50").alias("run_start"), F.expr("j * 97 + doc_id % 50 + (j * 13 + doc_id) % 120").alias("run_end")).filter("run_start < run_end")
    # a run goes to each window it touches
    runs = runs.withColumn("no", F.explode(F.expr("sequence(run_start div 200, (run_end - 1) div 200)"))).select(key.alias("key"), "run_start", "run_end")
    return sp.segments(runs, w).drop("ord").withColumn("doc_id", F.col("key.doc_id")).drop("key")


@query("corpus_stats", "SELECT count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def corpus_stats(spark, sf):
    return co.corpus_stats(inp.table(spark, sf, "documents"))


# --- predictions and proposals -----------------------------------------------------------------------------
PREDICT_SQL = HITS_SQL + """,
pred AS (SELECT query_id, query, CASE WHEN query_id % 5 = 4 THEN NULL WHEN query_id % 2 = 0 THEN 'at_most' ELSE 'at_least' END AS expectation, query_id % 3 AS expected_hits FROM qs),
obs AS (SELECT pred.*, count(hit.doc) AS seen FROM pred LEFT JOIN hit USING (query_id) GROUP BY 1, 2, 3, 4)"""


def _predictions(spark, sf):
    expect = F.expr("CASE WHEN query_id % 5 = 4 THEN NULL WHEN query_id % 2 = 0 THEN 'at_most' ELSE 'at_least' END")
    return inp.phrases(spark, sf).select(F.concat(F.lit("conjecture:"), F.col("query_id").cast("string")).alias("conjecture_id"), "query_id", "query", expect.alias("expectation"), (F.col("query_id") % 3).alias("expected_hits"))


@query("prospective_tests", f"WITH {PREDICT_SQL} SELECT 'conjecture:' || query_id AS conjecture_id, seen AS observed_hits, CASE WHEN expectation IS NULL THEN 'indeterminate' WHEN expectation = 'at_most' AND seen <= expected_hits OR expectation = 'at_least' AND seen >= expected_hits THEN 'pass' ELSE 'fail' END AS result FROM obs")
def prospective_tests(spark, sf):
    return vf.prospective(_predictions(spark, sf), inp.line_spans(spark, sf)).select("conjecture_id", "observed_hits", "result")


@query("prospective_tests_capped", f"""WITH {PREDICT_SQL} SELECT 'conjecture:' || query_id AS conjecture_id, least(seen, 1) AS observed_hits, seen >= 1 AS saturated, CASE WHEN expectation IS NULL THEN 'indeterminate'
  WHEN expectation = 'at_most' THEN CASE WHEN seen >= 1 AND expected_hits >= 1 THEN 'indeterminate' WHEN least(seen, 1) <= expected_hits THEN 'pass' ELSE 'fail' END
  WHEN seen >= 1 AND expected_hits > 1 THEN 'indeterminate' WHEN least(seen, 1) >= expected_hits THEN 'pass' ELSE 'fail' END AS result FROM obs""")
def prospective_tests_capped(spark, sf):
    out = vf.prospective(_predictions(spark, sf), inp.line_spans(spark, sf), cap=1)
    return out.select("conjecture_id", F.col("observed_hits").cast("bigint").alias("observed_hits"), "saturated", "result")


@query("grounded_claims", f"WITH {HITS_SQL}, n AS (SELECT query_id, query, count(hit.doc) AS n FROM qs LEFT JOIN hit USING (query_id, query) GROUP BY 1, 2) SELECT query_id AS proposal_id, CASE WHEN n = 0 THEN 'refused' ELSE 'propose,propose,add_edge' END AS events, CASE WHEN n > 0 THEN n END AS hits FROM n")
def grounded_claims(spark, sf):
    asked = inp.phrases(spark, sf).select(F.col("query_id").alias("proposal_id"), F.lit("agent:1").alias("authored_by"), F.lit("it says so").alias("text"), F.col("query").alias("grounding_query"))
    events, refused = vf.ground(asked, inp.line_spans(spark, sf))
    hits = tx.grounding_phrase(F.get_json_object("detail", "$.payload.text"))["hits"]
    per = events.groupBy("proposal_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "event"))), lambda e: e["event"]), ",").alias("events"), F.max(hits).alias("hits"))
    return per.unionByName(refused.select("proposal_id", F.col("event").alias("events"), F.lit(None).cast("bigint").alias("hits")))


@query("conjecture_intake", f"WITH {HITS_SQL}, n AS (SELECT query_id, count(hit.doc) AS n FROM qs LEFT JOIN hit USING (query_id) GROUP BY 1) SELECT query_id AS proposal_id, 'propose,propose,add_edge,propose,add_edge' AS events, '(' || n || ' hits)' AS tail, query_id % 3 AS expected_hits FROM n")
def conjecture_intake(spark, sf):
    fields = [F.lit(f).alias(f) for f in ("derivation", "corpus_boundary", "selection_risks", "alternative_explanations")]
    asked = inp.phrases(spark, sf).select(
        F.col("query_id").alias("proposal_id"), F.lit("agent:1").alias("authored_by"), F.lit("maybe").alias("text"), *fields, F.col("query").alias("prior_art_query"),
        F.lit("never seen").alias("tests_query"), F.lit("at_most").alias("expectation"), (F.col("query_id") % 3).alias("expected_hits"))
    ev = vf.intake(asked, inp.line_spans(spark, sf))
    text = F.get_json_object("detail", "$.payload.text")
    return ev.groupBy("proposal_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "event"))), lambda e: e["event"]), ",").alias("events"),
        F.max(F.when(F.col("step") == 0, F.regexp_extract(text, r"(\(\d+ hits\))$", 1))).alias("tail"),
        F.max(F.get_json_object("detail", "$.payload.expected_hits").cast("bigint")).alias("expected_hits"))


@query("gathered_citations", f"""WITH {HITS_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc) AS hit_no FROM hit QUALIFY hit_no <= 5),
x AS (SELECT top.*, d.source AS w, 'witness:' || d.source AS wid, d.source || '#' || top.doc || '::' || span AS pref FROM top JOIN documents d ON d.doc_id = top.doc),
stop AS (SELECT query_id, min(hit_no) AS at_ FROM x WHERE w = 'src7' GROUP BY 1), live AS (SELECT x.* FROM x LEFT JOIN stop USING (query_id) WHERE at_ IS NULL OR hit_no < at_),
f AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY query_id, hit_no) = 1 AS wfirst, row_number() OVER (PARTITION BY pref ORDER BY query_id, hit_no) = 1 AS pfirst FROM live),
ev AS (
  SELECT 'propose' AS event, 'witness' AS kind, NOT wfirst AS converge, count(*) AS n FROM f GROUP BY 3 UNION ALL SELECT 'propose', 'passage', NOT pfirst, count(*) FROM f GROUP BY 3
  UNION ALL SELECT 'attest', 'passage', NULL, count(*) FROM f WHERE pfirst UNION ALL SELECT 'add_edge', 'attests', false, count(*) FROM f
  UNION ALL SELECT 'refused', 'PersistentRejection', NULL, count(*) FROM stop
  UNION ALL SELECT 'attest', 'claim', NULL, count(DISTINCT query_id) FROM f WHERE query_id % 3 <> 0 AND query_id NOT IN (SELECT query_id FROM stop))
SELECT event, kind, converge, n FROM ev WHERE n > 0""")
def gathered_citations(spark, sf):
    docs = inp.table(spark, sf, "documents")
    q = inp.phrases(spark, sf)
    targets = q.select(F.col("query_id").alias("call_no"), F.concat(F.lit("claim:"), F.col("query_id").cast("string")).alias("target_id"), F.lit("agent:1").alias("authored_by"), "query")
    src = docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("witness_ref"), F.col("lang").alias("title"), F.lit("text").alias("locator"), F.lit("licence").alias("note"))
    # one source was rejected before; a third of the claims were written by the caller itself
    nodes = targets.select(F.col("target_id").alias("id"), F.lit("claim").alias("type"), F.lit("proposed").alias("status")).unionByName(
        docs.filter("source = 'src7'").select(F.concat(F.lit("witness:"), "source").alias("id"), F.lit("witness").alias("type"), F.lit("rejected").alias("status")).distinct())
    wrote = targets.select(F.col("target_id").alias("node_id"), F.when(F.col("call_no") % 3 == 0, "agent:1").otherwise("agent:2").alias("author"), F.lit("proposed").alias("action"))
    edges = spark.createDataFrame([], "id STRING, type STRING, src STRING, dst STRING")
    agents = spark.createDataFrame([], "id STRING, model STRING")
    ev = vf.gather(targets, inp.line_spans(spark, sf), src, nodes, edges, wrote, agents)
    kind = F.coalesce(F.get_json_object("detail", "$.rule"), F.when(F.col("event") == "add_edge", F.col("edge_type")).otherwise(F.col("node_type")))
    return ev.groupBy("event", kind.alias("kind"), F.get_json_object("detail", "$.converge").cast("boolean").alias("converge")).agg(F.count(F.lit(1)).alias("n"))


@query("content_ledger", "SELECT doc_id AS uid, sha256(text) AS sha256 FROM documents")
def content_ledger(spark, sf):
    return vf.content_ledger(inp.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text"))


@query("content_fingerprint")
def content_fingerprint(spark, sf):
    led = vf.content_ledger(inp.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text"))
    return vf.fingerprint(led, "letters 2-4 floor 500")


# --- sources over table rows ----------------------------------------------------------------------------------
@query("markup_bodies", """SELECT CASE WHEN page_id % 5 = 0 THEN 'no header' WHEN page_id % 5 = 1 THEN 'header never closed' WHEN page_id % 5 = 2 THEN 'no text element after the header' ELSE 'read' END AS outcome, count(*) AS n,
  CAST(sum(CASE WHEN page_id % 5 > 2 THEN length(html) ELSE 0 END) AS BIGINT) AS chars FROM pages GROUP BY 1""")
def markup_bodies(spark, sf):
    head = F.expr("""CASE page_id % 5 WHEN 0 THEN '<TEI>' WHEN 1 THEN '<teiHeader><text>' WHEN 2 THEN '<teiHeader>x</teiHeader>' ELSE '<teiHeader><text>no</text></teiHeader><text xml:id="a">' END""")
    files = inp.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("entry_path"), F.concat(head, "html").cast("binary").alias("content"))
    docs, skipped = co.markup_bodies(files)
    read = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).cast("bigint").alias("chars")).select(F.lit("read").alias("outcome"), "n", "chars")
    return read.unionByName(skipped.select(F.col("reason").alias("outcome"), F.col("entries").alias("n"), F.lit(0).cast("bigint").alias("chars")))


@query("entry_checks", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN page_id % 7 = 0 THEN 'outside the expected layout' WHEN page_id % 7 = 1 THEN 'entry appears more than once' WHEN octet_length(encode(html)) > 3000 THEN 'over the size cap' ELSE 'ok' END AS reason,
  unnest(CASE WHEN page_id % 7 = 1 THEN [1, 2] ELSE [1] END) FROM pages) GROUP BY 1""")
def entry_checks(spark, sf):
    path = F.expr("concat(CASE WHEN page_id % 7 = 0 THEN 'Y/' ELSE 'X/' END, page_id, '.xml')")
    copies = F.expr("CASE WHEN page_id % 7 = 1 THEN array(1, 2) ELSE array(1) END")
    files = inp.table(spark, sf, "pages").withColumn("c", F.explode(copies)).select(path.alias("entry_path"), F.col("html").cast("binary").alias("content"))
    ok, bad = co.check_entries(files, "X/", max_bytes=3000)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("reason"), "n"))


@query("edition_choice", "SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '大.txt' WHEN doc_id % 2 = 0 THEN 'CB.txt' ELSE '麗-CB.txt' END AS file FROM documents")
def edition_choice(spark, sf):
    names = F.expr("CASE WHEN doc_id % 4 = 0 THEN array('notes.txt') WHEN doc_id % 3 = 0 THEN array('麗-CB.txt', '大.txt') WHEN doc_id % 2 = 0 THEN array('CB.txt', '麗-CB.txt') ELSE array('麗-CB.txt', 'x.txt') END")
    files = inp.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uid"), F.explode(names).alias("file"))
    return co.pick_edition(files).select("uid", "file")


# a hundred suppliers make one catalogue file, their nations its blocks; every third line is unlabelled
@query("catalogue_blocks", """WITH u AS (SELECT s_suppkey // 100 AS file, s_nationkey AS b, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'grey' ELSE 'N' || s_nationkey END AS label FROM supplier),
c AS (SELECT file, b, label, count(*) AS n, min(s_suppkey) AS f FROM u GROUP BY 1, 2, 3)
SELECT CAST(file AS VARCHAR) AS file, label AS majority, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS units FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, b ORDER BY n DESC, f) = 1) GROUP BY file, label""")
def catalogue_blocks(spark, sf):
    line = F.expr("concat('T', lpad(cast(s_suppkey AS string), 9, '0'), ' ', CASE WHEN s_suppkey % 3 = 0 THEN 'grey' ELSE concat('N', s_nationkey) END)")
    rows = inp.table(spark, sf, "supplier").select(F.expr("s_suppkey div 100").alias("f"), "s_nationkey", line.alias("line"))
    blocks = rows.groupBy("f", "s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("line")), "\r\n").alias("b"))
    raw = blocks.groupBy(F.col("f").cast("string").alias("file")).agg(F.array_join(F.array_sort(F.collect_list("b")), "\r\n\r\n").alias("value"))
    units, owners, notes = cat.parse_catalogue(raw)
    stray = notes.groupBy("file", "block").agg(F.sum("units").alias("stray"))
    lines = raw.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n\n")).alias("block", "b")).select("file", "block", F.size(F.split("b", "\n")).alias("lines"))
    own = owners.join(lines, ["file", "block"]).join(stray, ["file", "block"], "left")
    return own.groupBy("file", "majority").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("lines") - F.coalesce("stray", F.lit(0))).cast("bigint").alias("units"))


@query("marker_list", r"SELECT DISTINCT w AS gram FROM (SELECT unnest(string_split_regex(text, '[^\p{L}]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 4")
def marker_list(spark, sf):
    raw = inp.table(spark, sf, "benchmark").select(F.array_join(F.transform(F.split("text", r"[^\p{L}]+"), lambda w: F.concat(F.lit("<ngram>"), w, F.lit("</ngram>"))), "\n").alias("value"))
    return cat.parse_markers(raw)


@query("reader_addresses", """SELECT p_partkey, 'https://cbetaonline.dila.edu.tw/zh/T' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || CASE WHEN p_size > 0 THEN '_' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE '' END AS url,
  'T' || lpad(CAST(p_size AS VARCHAR), 2, '0') || 'n' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'T' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS work FROM part""")
def reader_addresses(spark, sf):
    path = F.expr("concat('X/T/T', lpad(cast(p_size AS string), 2, '0'), 'n', lpad(cast(p_partkey AS string), 6, '0'), '_', lpad(cast(p_size AS string), 3, '0'), '.xml')")
    uid = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('T', lpad(cast(p_partkey % 10000 AS string), 4, '0'), '-1') ELSE concat('T', lpad(cast(p_partkey % 10000 AS string), 4, '0'), '7') END")
    return inp.table(spark, sf, "part").select("p_partkey", tx.reader_url(path).alias("url"), tx.entry_ref(path).alias("ref"), tx.work_of(uid).alias("work"))


# --- cross-references and apparatus ------------------------------------------------------------------------------
X = inp.GRAPH_SQL.split("psg AS (")[0].rstrip().rstrip(",") + "," + inp.REFS_SQL


@query("cross_references", f"WITH {X}, un AS (SELECT CAST(o AS VARCHAR) AS doc, 'unparsed' AS bucket, count(DISTINCT o) AS n FROM rl WHERE o % 17 = 0 GROUP BY o) SELECT doc, bucket, number, sub_ref FROM refs UNION ALL SELECT doc, bucket, NULL, NULL FROM un")
def cross_references(spark, sf):
    out = xr.extract_refs(inp.reference_docs(spark, sf))
    return out.select("doc", "bucket", F.when(F.col("bucket") != "unparsed", F.col("number")).alias("number"), "sub_ref")


@query("reference_order", f"WITH {X} SELECT doc, bucket, string_agg(number, ' ' ORDER BY place) AS numbers FROM refs GROUP BY 1, 2")
def reference_order(spark, sf):
    out = xr.extract_refs(inp.reference_docs(spark, sf)).filter("bucket <> 'unparsed'")
    return out.groupBy("doc", "bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "number"))), lambda e: e["number"]), " ").alias("numbers"))


RES = X + "," + inp.CATALOGUE_SQL


@query("self_numbers", f"WITH {X} SELECT DISTINCT CAST(o AS VARCHAR) AS doc, CAST(o AS VARCHAR) AS self_number FROM rl")
def self_numbers(spark, sf):
    return xr.self_numbers(inp.reference_docs(spark, sf))


@query("resolved_numbers", f"WITH {RES} SELECT number, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, refs FROM res")
def resolved_numbers(spark, sf):
    refs = xr.extract_refs(inp.reference_docs(spark, sf)).filter("bucket = 'asserted'")
    out = sp.resolve_numbers(refs, xr.catalogue_of(inp.catalogue_entries(spark, sf)))
    return out.select("number", "outcome", F.array_join("candidates", " ").alias("refs"))


@query("scan_tallies", f"""WITH {RES}, rr AS (SELECT refs.*, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM refs JOIN res USING (number) WHERE bucket = 'asserted')
SELECT 'references' AS measure, bucket AS value, count(*) AS n FROM refs GROUP BY 2 UNION ALL SELECT 'references', 'unparsed', count(DISTINCT o) FROM rl WHERE o % 17 = 0 HAVING count(*) > 0
UNION ALL SELECT 'entries', 'read', count(DISTINCT o) FROM rl UNION ALL SELECT 'entries', 'with references', count(DISTINCT o) FROM rl
UNION ALL SELECT 'resolution', outcome, count(*) FROM rr GROUP BY 2 UNION ALL SELECT 'distinct numbers', outcome, count(DISTINCT number) FROM rr WHERE outcome <> 'resolved' GROUP BY 2""")
def scan_tallies(spark, sf):
    docs = cut_lineage(inp.reference_docs(spark, sf))
    refs = cut_lineage(xr.extract_refs(docs))
    return xr.scan_tallies(docs, refs, xr.resolve_counts(refs, xr.catalogue_of(inp.catalogue_entries(spark, sf))))


@query("unresolved_top", f"WITH {RES} SELECT number, count(*) AS n FROM refs JOIN res USING (number) WHERE bucket = 'asserted' AND res.n > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def unresolved_top(spark, sf):
    refs = xr.extract_refs(inp.reference_docs(spark, sf))
    return xr.most_often(xr.resolve_counts(refs, xr.catalogue_of(inp.catalogue_entries(spark, sf))), "ambiguous")


@query("reference_map", f"""WITH {RES}, one AS (SELECT doc, string_agg(res.refs, ' ' ORDER BY place) AS resolved FROM refs JOIN res USING (number) WHERE bucket = 'asserted' AND res.n = 1 GROUP BY 1)
SELECT d.doc, d.n AS refs, coalesce(one.resolved, '') AS resolved FROM (SELECT doc, count(*) AS n FROM (SELECT doc FROM refs UNION ALL SELECT DISTINCT CAST(o AS VARCHAR) FROM rl WHERE o % 17 = 0) GROUP BY 1) d LEFT JOIN one USING (doc)""")
def reference_map(spark, sf):
    refs = cut_lineage(xr.extract_refs(inp.reference_docs(spark, sf)))
    m = xr.reference_map(refs, xr.resolve_refs(refs, xr.catalogue_of(inp.catalogue_entries(spark, sf))))
    total = sum((F.size(b) for b in xr.BUCKETS[1:]), F.size(xr.BUCKETS[0]))
    return m.select("doc", total.cast("bigint").alias("refs"), F.array_join("resolved_refs", " ").alias("resolved"))


# parts with one catalogue entry are the witnesses held; an order stands for the part it lists first
@query("parallel_links", f"""WITH {RES}, holds AS (SELECT DISTINCT ref FROM cat WHERE CAST(regexp_extract(number, '\\d+', 0) AS BIGINT) % 4 <> 2),
w AS (SELECT doc, min(ref) AS own FROM (SELECT refs.doc, res.refs AS ref FROM refs JOIN res USING (number) WHERE bucket = 'asserted' AND n = 1) JOIN holds USING (ref) GROUP BY 1 QUALIFY row_number() OVER (PARTITION BY own ORDER BY doc) = 1),
b AS (SELECT refs.doc, refs.place, w.own, res.refs AS ref, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN res.refs = w.own THEN 'self' WHEN h.ref IS NULL THEN 'absent_from_graph' ELSE 'link' END AS bucket
  FROM refs JOIN w USING (doc) JOIN res USING (number) LEFT JOIN holds h ON h.ref = res.refs WHERE refs.bucket = 'asserted'),
l AS (SELECT least(own, ref) AS x, greatest(own, ref) AS y, count(*) AS n FROM b WHERE bucket = 'link' GROUP BY 1, 2)
SELECT bucket, n FROM (SELECT bucket, count(*) AS n FROM b WHERE bucket <> 'link' GROUP BY 1 UNION ALL SELECT 'linked', count(*) FROM l UNION ALL SELECT 'already_linked', CAST(sum(n - 1) AS BIGINT) FROM l
  UNION ALL SELECT refs.bucket, count(*) FROM refs JOIN w USING (doc) WHERE refs.bucket <> 'asserted' GROUP BY 1) WHERE n > 0""")
def parallel_links(spark, sf):
    refs = cut_lineage(xr.extract_refs(inp.reference_docs(spark, sf)))
    catalogue = xr.catalogue_of(inp.catalogue_entries(spark, sf))
    held = catalogue.filter(F.regexp_extract("number", r"\d+", 0).cast("bigint") % 4 != 2).select("ref").distinct()
    nodes = held.select(F.concat(F.lit("witness:"), "ref").alias("id"), F.lit("witness").alias("type"), F.to_json(F.struct(F.col("ref").alias("canonical_ref"))).alias("payload"))
    first = xr.resolve_refs(refs, catalogue).filter("outcome = 'resolved'").select("doc", F.get("candidates", F.lit(0)).alias("ref")).join(held, "ref")
    own = cut_lineage(first.groupBy("doc").agg(F.min("ref").alias("own")).groupBy("own").agg(F.min("doc").alias("doc")))
    edges = spark.createDataFrame([], "type STRING, src STRING, dst STRING, retracted_at STRING")
    _, report = xr.link_parallels(nodes, edges, own.select(F.concat(F.lit("witness:"), "own").alias("witness_id"), "doc"), refs, catalogue)
    return report.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


A = inp.GRAPH_SQL.split("psg AS (")[0].rstrip().rstrip(",")


@query("apparatus_readings", f"""WITH {A} SELECT CAST(o AS VARCHAR) AS doc, concat_ws('.', l, p, s) AS n, 'lemma' AS kind, CASE flag WHEN 'A' THEN '【大】' WHEN 'R' THEN '【CB】' ELSE 'W1|W2' END AS sigla, CASE flag WHEN 'A' THEN 'a' WHEN 'R' THEN 'b' ELSE 'c' END AS text, CASE flag WHEN 'R' THEN 'CBETA.x' END AS resp FROM line
UNION ALL SELECT CAST(o AS VARCHAR), concat_ws('.', l, p, s), 'variant', CASE stat WHEN 'O' THEN '【宋】|【元】|【明】' ELSE '' END, CASE stat WHEN 'O' THEN 'd e' ELSE 'f' END, CASE stat WHEN 'O' THEN NULL ELSE 'Taisho' END FROM line""")
def apparatus_readings(spark, sf):
    return xr.extract_apparatus(inp.apparatus_docs(spark, sf)).select("doc", "n", "kind", F.array_join("sigla", "|").alias("sigla"), "text", "resp")


FAM = A + ", fam AS (SELECT o, CASE flag WHEN 'A' THEN '【大】' WHEN 'R' THEN '【CB】' ELSE 'W1 W2' END AS family FROM line UNION ALL SELECT o, '【宋】 【元】 【明】' FROM line WHERE stat = 'O')"


@query("edition_families", f"WITH {FAM} SELECT family, count(*) AS n FROM fam GROUP BY 1")
def edition_families(spark, sf):
    return xr.edition_families(xr.extract_apparatus(inp.apparatus_docs(spark, sf)))


@query("collation", f"""WITH {FAM}, c AS (SELECT o, family, count(*) AS n FROM fam GROUP BY 1, 2),
g AS (SELECT o, string_agg(family || ' x' || n, '; ' ORDER BY n DESC, family) AS families, coalesce(string_agg(family, ', ' ORDER BY family) FILTER (contains(family, ' ')), '') AS joint_groups FROM c GROUP BY 1)
SELECT CAST(o.o_orderkey AS VARCHAR) AS witness_id, CASE WHEN g.o IS NULL THEN 'indeterminate' ELSE 'pass' END AS result, CASE WHEN g.o IS NULL THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'no apparatus' ELSE 'no source' END ELSE 'collated' END AS finding,
  coalesce(n.n, 0) AS entries, coalesce(g.families, '') AS families, coalesce(g.joint_groups, '') AS joint_groups, coalesce(n.e, 0) AS editorial_lemmas
FROM orders o LEFT JOIN g ON g.o = o.o_orderkey LEFT JOIN (SELECT o, count(*) AS n, count(*) FILTER (flag = 'R') AS e FROM line GROUP BY 1) n ON n.o = o.o_orderkey""")
def collation(spark, sf):
    app = xr.extract_apparatus(inp.apparatus_docs(spark, sf))
    # orders with lines lead back to their document; of the others, odd keys have no source at all
    have = app.select("doc").distinct().withColumn("_h", F.lit(1))
    w = inp.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("witness_id"), "o_orderkey")
    w = w.join(have, w.witness_id == have.doc, "left").select("witness_id", F.when(F.col("_h").isNotNull() | (F.col("o_orderkey") % 2 == 0), F.col("witness_id")).alias("doc"))
    return xr.collate(w, app).drop("method", "assurance_level")
