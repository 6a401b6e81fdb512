"""Nearest windows over the embeddings and verbatim reuse between documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage
from vidimus.operators import similarity as si
from vidimus.plans import inputs as inp
from vidimus.plans.registry import query

LET = tx.LETTER

NEAR_SQL = """
win AS (SELECT vec_id AS idx, 'u' || (vec_id // 10) AS uid, 'L' || label AS work, CAST(vec_id % 10 * 40 AS INTEGER) AS start, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nn AS MATERIALIZED (SELECT a.idx, a.uid, a.work, a.start, b.idx AS near_idx, b.uid AS near_uid, b.work AS near_label, b.start AS near_start, c AS cosine, rank FROM (
  SELECT a.idx AS ai, b.idx AS bi, round(list_dot_product(a.v, b.v), 12) AS c, row_number() OVER (PARTITION BY a.idx ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.idx) AS rank
  FROM win a JOIN win b ON a.work <> b.work QUALIFY rank <= 5) t JOIN win a ON a.idx = ai JOIN win b ON b.idx = bi)
"""


def _near(spark, sf, k):
    return si.neighbours(inp.windows(spark, sf), k)


@query("nearest_windows", f"WITH {NEAR_SQL} SELECT idx, uid, rank, near_idx, near_uid, near_label, near_start, round(cosine, 3) AS cosine FROM nn")
def nearest_windows(spark, sf):
    return _near(spark, sf, 5).select("idx", "uid", F.col("rank").cast("bigint").alias("rank"), "near_idx", "near_uid", "near_label", "near_start", "cosine")


@query("first_windows_labelled", """WITH win AS (SELECT vec_id AS idx, 'u' || (vec_id // 10) AS uid, 'L' || label AS work, CASE WHEN label = 3 THEN 'grey' ELSE 'L' || label END AS label, vec_id % 10 * 40 AS start, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY uid ORDER BY start, idx) <= 2)
SELECT a.idx, b.idx AS near_idx, round(list_dot_product(a.v, b.v), 3) AS cosine FROM q a JOIN win b ON a.work <> b.work AND b.label <> 'grey' QUALIFY row_number() OVER (PARTITION BY a.idx ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.idx) <= 3""")
def first_windows_labelled(spark, sf):
    w = inp.windows(spark, sf).withColumn("label", F.when(F.col("label") == "L3", "grey").otherwise(F.col("label")))
    return si.neighbours(w, 3, labelled_only=True, max_windows=2).select("idx", "near_idx", "cosine")


@query("nearest_unit_tally", f"WITH {NEAR_SQL} SELECT uid, near_uid AS nearest, count(*) AS n FROM nn WHERE rank = 1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, near_uid) <= 8")
def nearest_unit_tally(spark, sf):
    return si.nearest_tally(_near(spark, sf, 1)).drop("rank")


@query("nearest_label_tally", f"WITH {NEAR_SQL} SELECT uid, near_label AS nearest, count(*) AS n FROM nn WHERE rank = 1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, near_label) <= 8")
def nearest_label_tally(spark, sf):
    return si.nearest_tally(_near(spark, sf, 1), "near_label").drop("rank")


@query("related_passages", f"""WITH {NEAR_SQL}, q AS (SELECT DISTINCT uid, 40 AS start FROM win UNION ALL SELECT DISTINCT uid, 7 FROM win)
SELECT q.uid, q.start, CASE WHEN w.idx IS NULL THEN 'unknown_position' ELSE 'ok' END AS status, nn.rank, nn.near_uid, nn.near_start, round(nn.cosine, 3) AS cosine, CASE WHEN w.idx IS NOT NULL THEN (SELECT count(*) FROM win) - (SELECT count(*) FROM win x WHERE x.work = w.work) END AS candidate_windows
FROM q LEFT JOIN win w ON w.uid = q.uid AND w.start = q.start LEFT JOIN nn ON nn.idx = w.idx AND nn.rank <= 5""")
def related_passages(spark, sf):
    w = inp.windows(spark, sf)
    q = w.select("uid").distinct().select("uid", F.explode(F.array(F.lit(40), F.lit(7))).alias("start"))
    return si.related(w, q, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("window_summary", "SELECT count(*) AS windows, count(DISTINCT vec_id // 10) AS units, max(len(embedding)) AS dim, CAST(40 AS BIGINT) AS window_chars FROM embeddings")
def window_summary(spark, sf):
    return si.describe_windows(inp.windows(spark, sf)).withColumn("dim", F.col("dim").cast("bigint"))


# every text in windows of 400 characters, and one more behind its end
@query("window_texts", """WITH w AS (SELECT doc_id, text, i * 400 AS start FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400) AS BIGINT) + 1)) AS i FROM documents))
SELECT doc_id, start, CASE WHEN start < length(text) THEN 'ok' ELSE 'outside the source' END AS status, CASE WHEN start < length(text) THEN least(start + 400, length(text)) END AS "end",
  CASE WHEN start < length(text) THEN substr(text, CAST(start + 1 AS INTEGER), 400) END AS text, CASE WHEN start < length(text) THEN sha256(text) END AS source_sha256 FROM w""")
def window_texts(spark, sf):
    w, docs = _tiles(spark, sf)
    out = si.window_text(w, docs).withColumnRenamed("uid", "doc_id").drop("idx")
    return out.withColumn("end", F.col("end").cast("bigint")).withColumn("start", F.col("start").cast("bigint"))


def _tiles(spark, sf):
    """Windows of 400 characters over every whole text, and one behind its end; the documents."""
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")
    tiles = docs.select("uid", F.explode(F.expr("sequence(0, cast(ceil(length(text) / 400) AS int))")).alias("i"))
    return tiles.select(F.concat_ws(":", "uid", "i").alias("idx"), "uid", (F.col("i") * 400).alias("start")), docs


def _text_windows(spark, sf):
    """Each vector is a window of 400 characters of the document with its number, at a place that its
    number picks among all windows of that text."""
    docs = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")
    e = inp.table(spark, sf, "embeddings").join(docs, F.col("vec_id") == F.col("uid"), "left")
    w = e.select(
        F.col("vec_id").alias("idx"), F.col("vec_id").alias("uid"), F.expr("concat('W', vec_id div 3)").alias("work"), F.expr("concat('L', label)").alias("label"),
        F.expr("cast(vec_id * 7 % greatest(1, coalesce(ceil(length(text) / 400), 1)) * 400 AS int)").alias("start"), F.col("embedding").alias("vec"))
    return w, docs


@query("window_snippets", "SELECT doc_id, i * 400 AS start, replace(substr(text, CAST(i * 400 + 1 AS INTEGER), 40), chr(10), '') AS snippet FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 400) AS BIGINT) + 1)) AS i FROM documents)")
def window_snippets(spark, sf):
    w, docs = _tiles(spark, sf)
    return si.snippets(w, docs).select(F.col("uid").alias("doc_id"), F.col("start").cast("bigint").alias("start"), "snippet")


# --- verbatim reuse ----------------------------------------------------------------------------------------
KEPT_SQL = inp.COPIES_SQL + r""",
ids AS (SELECT uid_a AS uid FROM cp UNION SELECT uid_b FROM cp), kt AS (SELECT doc_id AS uid, regexp_replace(text, '[^\p{L}]+', '', 'g') AS t FROM documents WHERE doc_id IN (SELECT uid FROM ids))
"""


def _docs(spark, sf):
    return inp.table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text")


@query("copy_coverage", f"""WITH {KEPT_SQL}, gm AS (SELECT DISTINCT uid, substr(t, CAST(i AS INTEGER), 10) AS g FROM (SELECT uid, t, unnest(range(1, CAST(length(t) AS BIGINT) - 8)) AS i FROM kt WHERE length(t) >= 10)),
sz AS (SELECT uid, count(*) AS n FROM gm GROUP BY 1), sh AS (SELECT uid_a, uid_b, count(*) AS n FROM cp JOIN gm a ON a.uid = uid_a JOIN gm b ON b.uid = uid_b AND b.g = a.g GROUP BY 1, 2)
SELECT cp.uid_a, cp.uid_b, coalesce(sh.n, 0) AS shared, coalesce(a.n, 0) AS grams_a, coalesce(b.n, 0) AS grams_b, CASE WHEN a.n > 0 THEN round_even(coalesce(sh.n, 0) / a.n, 4) ELSE 0 END AS share_of_a_in_b, CASE WHEN b.n > 0 THEN round_even(coalesce(sh.n, 0) / b.n, 4) ELSE 0 END AS share_of_b_in_a
FROM cp LEFT JOIN sh USING (uid_a, uid_b) LEFT JOIN sz a ON a.uid = cp.uid_a LEFT JOIN sz b ON b.uid = cp.uid_b""")
def copy_coverage(spark, sf):
    return si.coverage(_docs(spark, sf), inp.copies(spark, sf), cls=LET)


RUNS_SQL = KEPT_SQL + """,
pg AS (SELECT uid, i - 1 AS at, substr(t, CAST(i AS INTEGER), 12) AS g FROM (SELECT uid, t, unnest(range(1, CAST(length(t) AS BIGINT) - 10)) AS i FROM kt WHERE length(t) >= 12)),
mt AS (SELECT uid_a, uid_b, a.at AS a, b.at AS b FROM cp JOIN pg a ON a.uid = uid_a JOIN pg b ON b.uid = uid_b AND b.g = a.g),
il AS (SELECT *, a - row_number() OVER (PARTITION BY uid_a, uid_b, a - b ORDER BY a) AS island FROM mt),
rn AS (SELECT uid_a, uid_b, min(a) AS a, min(b) AS b, count(*) + 11 AS chars FROM il GROUP BY uid_a, uid_b, a - b, island)
"""


@query("maximal_runs", f"WITH {RUNS_SQL} SELECT uid_a, uid_b, a, b, chars FROM rn")
def maximal_runs(spark, sf):
    return si.maximal_runs(_docs(spark, sf), inp.copies(spark, sf), cls=LET)


@query("longest_runs", f"WITH {RUNS_SQL} SELECT uid_a, uid_b, max(chars) AS longest_shared_run FROM rn GROUP BY 1, 2")
def longest_runs(spark, sf):
    return si.longest_run(si.maximal_runs(_docs(spark, sf), inp.copies(spark, sf), cls=LET))


@query("shared_runs")
def shared_runs(spark, sf):
    return si.shared_runs(_docs(spark, sf), inp.copies(spark, sf), cls=LET)


@query("confirmed_neighbours", r"""WITH win AS (SELECT vec_id AS idx, vec_id AS uid, vec_id // 3 AS work, CAST(vec_id * 7 % greatest(1, coalesce(ceil(length(text) / 400), 1)) AS BIGINT) * 400 AS start, CAST(embedding AS DOUBLE[]) AS v FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
nn AS MATERIALIZED (SELECT a.idx, b.idx AS near_idx, row_number() OVER (PARTITION BY a.idx ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.idx) AS rank FROM win a JOIN win b ON a.work <> b.work QUALIFY rank <= 2),
t AS (SELECT idx, regexp_replace(substr(text, CAST(start AS INTEGER) + 1, 400), '[^\p{L}]+', '', 'g') AS t FROM win JOIN documents ON doc_id = win.uid WHERE start < length(text)),
pg AS MATERIALIZED (SELECT idx, i AS at, substr(t, CAST(i AS INTEGER), 4) AS g FROM (SELECT idx, t, unnest(range(1, CAST(length(t) AS BIGINT) - 2)) AS i FROM t WHERE length(t) >= 4)),
mt AS (SELECT nn.idx, nn.near_idx, a.at AS a, b.at AS b FROM nn JOIN pg a ON a.idx = nn.idx JOIN pg b ON b.idx = nn.near_idx AND b.g = a.g),
il AS (SELECT *, a - row_number() OVER (PARTITION BY idx, near_idx, a - b ORDER BY a) AS island FROM mt), rn AS (SELECT idx, near_idx, count(*) + 3 AS chars FROM il GROUP BY idx, near_idx, a - b, island)
SELECT nn.idx, nn.near_idx, coalesce(max(chars), 0) AS longest_shared_run, CASE WHEN max(chars) IS NULL THEN 'semantic candidate' ELSE 'verbatim reuse' END AS kind FROM nn LEFT JOIN rn USING (idx, near_idx) GROUP BY 1, 2""")
def confirmed_neighbours(spark, sf):
    w, docs = _text_windows(spark, sf)
    near = cut_lineage(si.neighbours(w, 2))
    return si.confirm(near, w, docs, cls=LET).select("idx", "near_idx", "longest_shared_run", "kind")


@query("method_report")
def method_report(spark, sf):
    from vidimus.operators import scoring as sc
    from vidimus.plans.attribution_queries import answers

    w, docs = _text_windows(spark, sf)
    near = cut_lineage(si.neighbours(w, 1))
    return si.method_report(sc.verdicts(answers(spark, sf)), near, si.confirm(near, w, docs, cls=LET))
