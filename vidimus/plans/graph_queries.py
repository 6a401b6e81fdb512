"""Queries over the evidence graph laid over order lines, suppliers and parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.operators import evidence as evd
from vidimus.operators import projection as pj
from vidimus.operators import verify as vf
from vidimus.operators import xref as xr
from vidimus.plans import inputs as inp
from vidimus.plans.registry import query

G = inp.GRAPH_SQL


def _n(spark, sf):
    return inp.graph_nodes(spark, sf)


def _e(spark, sf):
    return inp.graph_edges(spark, sf)


# --- filters and counts -----------------------------------------------------------------------------
ALL_NODES = G + """,
nod AS (
  SELECT id, 'witness' AS type, status, s AS created_seq FROM wit
  UNION ALL SELECT id, 'passage', CASE flag WHEN 'A' THEN 'attested' WHEN 'R' THEN 'accepted' ELSE 'proposed' END, cseq FROM psg
  UNION ALL SELECT id, type, status, cseq FROM hyp
  UNION ALL SELECT 'question:Q' || (p_partkey // 40), 'question', 'accepted', 4000000000 + p_partkey FROM part WHERE p_partkey % 40 = 0
  UNION ALL SELECT 'query:P' || p, 'query', 'proposed', 6000000000 + p FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0
  UNION ALL SELECT 'verification:V' || substr(id, 9), 'verification', 'accepted', cseq + 10000000000 FROM psg
  UNION ALL SELECT 'verification:R' || substr(id, 9), 'verification', 'accepted', cseq + 20000000000 FROM psg WHERE l = 1
  UNION ALL SELECT 'verification:T' || substr(id, 9), 'verification', 'accepted', cseq + 30000000000 FROM psg WHERE l = 2 AND p % 3 = 2)
"""


LIVE_EDGES = ALL_NODES + """,
ctr AS (SELECT x.id AS a, y.id AS b FROM hyp x JOIN hyp y ON y.p = x.p + 1 WHERE x.p % 9 = 0 AND x.p % 2 <> 0),
edg AS (
  SELECT 'part_of' AS type, id AS src, 'witness:S' || s AS dst FROM psg WHERE q % 10 <> 0 UNION ALL SELECT 'attests', passage, node FROM live_att
  UNION ALL SELECT 'verifies', 'verification:V' || substr(id, 9), id FROM psg UNION ALL SELECT 'verifies', 'verification:R' || substr(psg.id, 9), hyp.id FROM psg JOIN hyp USING (p) WHERE l = 1
  UNION ALL SELECT 'verifies', 'verification:T' || substr(psg.id, 9), hyp.id FROM psg JOIN hyp USING (p) WHERE l = 2 AND p % 3 = 2
  UNION ALL SELECT type, a, b FROM par WHERE s % 6 <> 0 UNION ALL SELECT type, b, a FROM par WHERE s % 6 <> 0 AND type = 'parallel_of'
  UNION ALL SELECT 'tests', 'query:P' || p, id FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0 UNION ALL SELECT 'addresses', id, 'question:Q' || (p // 40) FROM hyp WHERE p % 11 <> 0
  UNION ALL SELECT 'contradicts', a, b FROM ctr UNION ALL SELECT 'contradicts', b, a FROM ctr)
"""


@query("node_page", f"WITH {ALL_NODES} SELECT id, type, status, created_seq FROM nod WHERE type = 'conjecture' ORDER BY created_seq, id LIMIT 40 OFFSET 20")
def node_page(spark, sf):
    return evd.nodes_of(_n(spark, sf), "conjecture", limit=40, offset=20).select("id", "type", "status", "created_seq")


@query("live_edges_by_type", f"WITH {LIVE_EDGES} SELECT type, count(*) AS n FROM edg GROUP BY 1")
def live_edges_by_type(spark, sf):
    return evd.edges_of(_e(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("edge_flags", f"WITH {G} SELECT type, true AS discounts, s % 6 = 0 AS retracted, count(*) * CASE type WHEN 'parallel_of' THEN 2 ELSE 1 END AS n FROM par GROUP BY 1, 3 UNION ALL SELECT 'attests', false, q % 7 = 0, count(*) FROM att GROUP BY 3")
def edge_flags(spark, sf):
    v = evd.edge_view(_e(spark, sf)).filter("type IN ('parallel_of', 'descends_from', 'attests')")
    return v.groupBy("type", "discounts", "retracted").agg(F.count(F.lit(1)).alias("n"))


@query("citable_nodes", f"WITH {ALL_NODES} SELECT id, type FROM nod WHERE status = 'accepted' AND type NOT IN ('decision', 'verification', 'question')")
def citable_nodes(spark, sf):
    return evd.citable(_n(spark, sf)).select("id", "type")


@query("rejected_digest", f"WITH {G} SELECT type, id, p_name AS text, CASE WHEN cseq % 2 = 0 THEN 'not supported' ELSE '(no reason recorded)' END AS reason FROM hyp WHERE status = 'rejected'")
def rejected_digest(spark, sf):
    return evd.rejected_digest(_n(spark, sf))


@query("type_counts", f"WITH {ALL_NODES} SELECT 'node' AS kind, type, count(*) AS n FROM nod GROUP BY 2")
def type_counts(spark, sf):
    return evd.type_counts(_n(spark, sf), _e(spark, sf)).filter("kind = 'node'")


@query("payload_quality", f"""WITH {G} SELECT 'passage' AS type, 'locator is empty' AS reason, count(*) AS n FROM psg WHERE q % 13 = 0
UNION ALL SELECT 'witness', 'dating basis is no sentence', count(*) FROM wit WHERE s % 8 = 0
UNION ALL SELECT 'conjecture', 'derivation is empty', count(*) FROM hyp WHERE type = 'conjecture' AND p_size % 2 <> 0""")
def payload_quality(spark, sf):
    _, bad = evd.payload_quality(_n(spark, sf))
    return bad.groupBy("type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("legend", f"WITH {LIVE_EDGES}, vis AS (SELECT id, status FROM nod WHERE type <> 'verification') SELECT 'edge' AS kind, type AS value FROM edg WHERE src IN (SELECT id FROM vis) AND dst IN (SELECT id FROM vis) GROUP BY 2 UNION ALL SELECT DISTINCT 'status', status FROM vis")
def legend(spark, sf):
    return evd.legend(_n(spark, sf), evd.edges_of(_e(spark, sf))).select("kind", "value")


AUTHOR_SQL = G + """,
act AS (SELECT id, 'agent:' || (p % 5) AS author, 'proposed' AS action FROM hyp UNION ALL SELECT id, 'agent:' || (p % 3), 'attested' FROM hyp WHERE p % 4 IN (1, 2)
  UNION ALL SELECT id, 'researcher', 'accepted' FROM hyp WHERE p % 4 = 2 UNION ALL SELECT id, 'researcher', 'rejected' FROM hyp WHERE p % 4 = 3)"""


@query("agent_report", f"""WITH {AUTHOR_SQL}, d AS (SELECT author AS agent_id, count(*) FILTER (action = 'proposed') AS proposed, count(*) FILTER (action = 'attested') AS attested,
  count(*) FILTER (action = 'accepted') AS accepted, count(*) FILTER (action = 'rejected') AS rejected FROM act GROUP BY 1),
x AS (SELECT 'agent:' || (s % 5) AS agent_id, CAST(sum(CASE type WHEN 'parallel_of' THEN 2 ELSE 1 END) AS BIGINT) AS n FROM par GROUP BY 1)
SELECT coalesce(d.agent_id, x.agent_id) AS agent_id, coalesce(proposed, 0) AS proposed, coalesce(attested, 0) AS attested, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected,
  coalesce(n, 0) AS discount_edges_contributed, CASE WHEN coalesce(d.agent_id, x.agent_id) <> 'researcher' THEN 'worker' END AS kind FROM d FULL JOIN x ON d.agent_id = x.agent_id""")
def agent_report(spark, sf):
    rep = evd.agent_report(inp.graph_authorship(spark, sf), inp.graph_edge_authorship(spark, sf), _e(spark, sf))
    cols = ["agent_id", "proposed", "attested", "accepted", "rejected", "discount_edges_contributed", "kind"]
    return evd.agent_profile(rep, inp.graph_agents(spark, sf)).select(*cols)


@query("near_misses", f"""WITH {G}, w AS (SELECT 'P' || p AS id FROM hyp WHERE p % 2 = 0 UNION ALL SELECT 'Z' || p FROM hyp WHERE p % 5 = 0),
ids AS (SELECT id FROM hyp UNION ALL SELECT 'query:P' || p FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0)
SELECT w.id, coalesce(string_agg(ids.id, ' ' ORDER BY ids.id), '') AS near FROM w LEFT JOIN ids ON lower(split_part(ids.id, ':', 2)) = lower(w.id) GROUP BY 1""")
def near_misses(spark, sf):
    part = inp.table(spark, sf, "part")
    asked = F.array_compact(F.array(F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('P', p_partkey) END"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat('Z', p_partkey) END")))
    return evd.near_miss(part.select(F.explode(asked).alias("id")), _n(spark, sf)).withColumn("near", F.array_join("near", " "))


# --- support --------------------------------------------------------------------------------------------
@query("independent_support", f"WITH {G} SELECT *, non_independent_pairs = 0 AS independent, attesting_count = 0 AS vacuous FROM sup")
def independent_support(spark, sf):
    return evd.independent_support(_n(spark, sf), _e(spark, sf))


@query("dependent_pairs", f"WITH {G} SELECT x.node, links.a, links.b FROM links JOIN subj x ON x.subject = links.a JOIN subj y ON y.subject = links.b AND y.node = x.node")
def dependent_pairs(spark, sf):
    edges = _e(spark, sf)
    return evd.linked_pairs(evd.support_subjects(edges), evd.discount_links(edges))


# verifications: one span check per passage, reviewer records on hypotheses from first lines, predictions run on second lines
CHECK_SQL = G + """,
chk AS (
  SELECT id AS subject_id, 'verification:V' || substr(id, 9) AS vid, cseq + 10000000000 AS seq, 'exact_span' AS method, CASE stat WHEN 'O' THEN 'pass' ELSE 'fail' END AS result,
    CASE stat WHEN 'O' THEN 2 ELSE 0 END AS level, NULL AS verdict, q FROM psg
  UNION ALL SELECT hyp.id, 'verification:R' || substr(psg.id, 9), psg.cseq + 20000000000, 'exact_span', CASE flag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE CASE stat WHEN 'O' THEN 'pass' ELSE 'indeterminate' END END,
    2, list_extract(['sound', 'unsound', 'indeterminate'], CAST(q % 3 AS INTEGER) + 1), q FROM psg JOIN hyp USING (p) WHERE l = 1
  UNION ALL SELECT hyp.id, 'verification:T' || substr(psg.id, 9), psg.cseq + 30000000000, 'prospective_test', CASE stat WHEN 'O' THEN 'pass' ELSE 'fail' END, 0, NULL, q FROM psg JOIN hyp USING (p) WHERE l = 2 AND p % 3 = 2),
lat AS (SELECT * FROM chk QUALIFY row_number() OVER (PARTITION BY subject_id, method ORDER BY seq DESC, vid DESC) = 1),
asr AS (SELECT subject_id AS id, max(level) AS level FROM lat WHERE result = 'pass' GROUP BY 1),
tst AS (SELECT p FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0),
rev AS (
  SELECT hyp.id, hyp.type, CASE WHEN l.vid IS NULL THEN 'unreviewed' WHEN l.result = 'fail' THEN 'citation_failed' WHEN l.result = 'indeterminate' THEN 'citations_missing'
    WHEN l.verdict = 'unsound' THEN 'objected' WHEN l.verdict = 'indeterminate' THEN 'inconclusive' WHEN hyp.type = 'conjecture' AND tst.p IS NULL THEN 'test_missing' ELSE 'not_attested' END AS code,
    l.vid AS verification_id, l.verdict, 'read ' || l.q AS comment
  FROM hyp LEFT JOIN lat l ON l.subject_id = hyp.id AND l.method = 'exact_span' LEFT JOIN tst ON tst.p = hyp.p WHERE hyp.status = 'proposed')
"""


@query("assurance_levels", f"WITH {CHECK_SQL} SELECT id, CASE WHEN level = 2 THEN 'A2_EXACT_SPAN_MATCHED' ELSE 'A0_UNCHECKED' END AS assurance FROM (SELECT id FROM psg UNION ALL SELECT id FROM hyp UNION ALL SELECT id FROM wit) LEFT JOIN asr USING (id)")
def assurance_levels(spark, sf):
    nodes, edges = inp.graph(spark, sf)
    return evd.assurance(nodes, edges, nodes.filter("type IN ('passage', 'claim', 'conjecture', 'witness')")).select("id", "assurance")


@query("verification_list", f"WITH {CHECK_SQL} SELECT subject_id, vid AS verification_id, method, result FROM chk")
def verification_list(spark, sf):
    return evd.verifications(_n(spark, sf), _e(spark, sf)).select("subject_id", "verification_id", "method", "result")


@query("review_states", f"WITH {CHECK_SQL} SELECT id, type, code, verification_id, verdict, comment FROM rev")
def review_states(spark, sf):
    return evd.review_state(_n(spark, sf), _e(spark, sf)).drop("citation_result")


@query("span_states", f"WITH {CHECK_SQL} SELECT psg.id, psg.stat = 'O' AND psg.l > 1 AS verified, lat.vid AS latest FROM psg JOIN lat ON lat.subject_id = psg.id")
def span_states(spark, sf):
    return evd.span_state(_n(spark, sf), _e(spark, sf))


@query("passage_checks", f"WITH {CHECK_SQL} SELECT DISTINCT vid AS id FROM chk JOIN psg ON psg.id = chk.subject_id")
def passage_checks(spark, sf):
    return evd.passage_checks(_n(spark, sf), _e(spark, sf))


FIND_SQL = CHECK_SQL + """,
pro AS (SELECT subject_id AS id, result FROM lat WHERE method = 'prospective_test')"""


@query("findings", f"""WITH {FIND_SQL}
SELECT hyp.id, hyp.type, hyp.status, CASE WHEN asr.level = 2 THEN 'A2_EXACT_SPAN_MATCHED' ELSE 'A0_UNCHECKED' END AS assurance, p_name AS assertion, rev.code AS review_code, 'agent:' || (hyp.p % 5) AS authors,
  CASE WHEN hyp.p % 4 IN (1, 2) THEN 'agent:' || (hyp.p % 3) ELSE '' END AS attesters, sup.attesting_count, sup.distinct_witnesses, sup.non_independent_pairs, hyp.type = 'conjecture' AND p_size % 2 = 0 AS has_dossier,
  tst.p IS NOT NULL AS has_prospective_query, pro.result AS prospective_result, cseq AS created_seq
FROM hyp LEFT JOIN asr USING (id) LEFT JOIN rev USING (id) JOIN sup USING (id) LEFT JOIN tst ON tst.p = hyp.p LEFT JOIN pro ON pro.id = hyp.id""")
def findings(spark, sf):
    out = evd.findings(*inp.graph(spark, sf), inp.graph_authorship(spark, sf))
    return out.withColumn("authors", F.array_join("authors", " ")).withColumn("attesters", F.array_join("attesters", " ")).drop("rejected_reason", "independent", "vacuous")


@query("dossiers", f"""WITH {FIND_SQL}, e AS (SELECT node, count(*) AS evidence, count(DISTINCT CASE WHEN q % 10 <> 0 THEN s END) AS witnesses FROM live_att GROUP BY 1)
SELECT hyp.id, p_name AS assertion, CASE WHEN hyp.type = 'conjecture' AND p_size % 2 = 0 THEN 'derivation ' || p_size END AS derivation, coalesce(e.evidence, 0) AS evidence, coalesce(e.witnesses, 0) AS witnesses,
  CASE WHEN tst.p IS NULL THEN 0 ELSE 1 END AS prospective_queries, coalesce(l.n, 0) AS latest_checks FROM hyp LEFT JOIN e ON e.node = hyp.id LEFT JOIN tst ON tst.p = hyp.p
  LEFT JOIN (SELECT subject_id, count(*) AS n FROM lat GROUP BY 1) l ON l.subject_id = hyp.id""")
def dossiers(spark, sf):
    nodes, edges = inp.graph(spark, sf)
    ids = nodes.filter(F.col("type").isin(*schemas.REVIEWABLE_TYPES))
    d = evd.dossier(nodes, edges, ids)
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("bigint").alias(c)
    wits = F.size(F.array_distinct(F.filter(F.transform("evidence", lambda x: x["witness_id"]), lambda w: w.isNotNull())))
    return d.select(
        "id", "assertion", "derivation", n("evidence"), F.when(F.col("evidence").isNull(), 0).otherwise(wits).cast("bigint").alias("witnesses"),
        n("prospective_queries"), n("latest_verifications").alias("latest_checks"),
    )


@query("node_details", f"""WITH {FIND_SQL}
SELECT hyp.id, 'agent:' || (hyp.p % 5) AS first_author, 1 + CASE WHEN hyp.p % 9 = 0 AND EXISTS (SELECT 1 FROM hyp h2 WHERE h2.p = hyp.p + 1) THEN 1 ELSE 0 END + CASE WHEN hyp.p % 9 = 1 THEN 1 ELSE 0 END AS edges_out,
  coalesce(v.n, 0) AS verifications, sup.attesting_count FROM hyp LEFT JOIN (SELECT subject_id, count(*) AS n FROM chk GROUP BY 1) v ON v.subject_id = hyp.id JOIN sup USING (id)""")
def node_details(spark, sf):
    nodes, edges = inp.graph(spark, sf)
    ids = nodes.filter(F.col("type").isin(*schemas.REVIEWABLE_TYPES))
    d = pj.node_detail(nodes, edges, inp.graph_authorship(spark, sf), ids)
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("bigint").alias(c)
    return d.select("id", F.get("authorship", F.lit(0))["author"].alias("first_author"), "edges_out", n("verifications"), F.col("support.attesting_count").alias("attesting_count"))


# all edges of every witness, withdrawn ones too, in pages of 50
@query("witness_pages", f"""WITH {G}, e AS (SELECT 'edge:po' || substr(id, 9) AS eid, id AS src, 'witness:S' || s AS dst, 10000000000 + o * 8 + l AS seq FROM psg
  UNION ALL SELECT CASE type WHEN 'parallel_of' THEN 'edge:pl' ELSE 'edge:ds' END || s, a, b, s FROM par UNION ALL SELECT 'edge:pl' || s || ':rev', b, a, s FROM par WHERE type = 'parallel_of'),
ends AS (SELECT src AS id, 'out' AS side, eid, seq FROM e WHERE src LIKE 'witness:%' UNION ALL SELECT dst, 'in', eid, seq FROM e),
pg AS (SELECT *, (row_number() OVER (PARTITION BY id, side ORDER BY seq, eid) - 1) // 50 AS page FROM ends)
SELECT id, side, page, count(*) AS edges, string_agg(eid, ' ' ORDER BY seq, eid) AS ids FROM pg GROUP BY 1, 2, 3""")
def witness_pages(spark, sf):
    pages = pj.edge_pages(_e(spark, sf), _n(spark, sf).filter("type = 'witness'").select("id"), size=50, span=1_000_000_000)
    return pages.select("id", "side", "page", F.size("edges").cast("bigint").alias("edges"), F.array_join(F.transform("edges", lambda e: e["id"]), " ").alias("ids"))


@query("question_tally", f"""WITH {G}, adr AS (SELECT 'question:Q' || (p // 40) AS id, hyp.status, sup.* EXCLUDE (id, type) FROM hyp JOIN sup USING (id) WHERE p % 11 <> 0)
SELECT id, count(*) FILTER (status = 'proposed') AS proposed, count(*) FILTER (status = 'attested') AS attested, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (attesting_count = 0) AS unsupported, count(*) FILTER (attesting_count > 0 AND non_independent_pairs > 0) AS discounted FROM adr GROUP BY 1""")
def question_tally(spark, sf):
    return evd.question_tally(*inp.graph(spark, sf))


@query("questions", "SELECT 'question:Q' || (p_partkey // 40) AS id, min('which of ' || p_brand) FILTER (p_partkey % 40 = 0) AS question, count(*) FILTER (p_partkey % 11 <> 0) AS addressed_by FROM part GROUP BY 1")
def questions(spark, sf):
    return evd.questions(_n(spark, sf), _e(spark, sf)).select("id", "question", "addressed_by")


@query("latest_question", "SELECT 'question:Q' || max(p_partkey // 40) AS id FROM part WHERE p_partkey % 40 = 0")
def latest_question(spark, sf):
    return evd.latest_question(_n(spark, sf))


@query("graph_page", f"WITH {LIVE_EDGES}, pg AS (SELECT id FROM nod ORDER BY created_seq, id LIMIT 300) SELECT (SELECT count(*) FROM pg) AS nodes, (SELECT count(*) FROM edg WHERE src IN (SELECT id FROM pg) AND dst IN (SELECT id FROM pg)) AS edges, (SELECT count(*) FROM nod) > 300 AS truncated")
def graph_page(spark, sf):
    shown, inside, flag = evd.graph_page(_n(spark, sf), _e(spark, sf), 300)
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c)).withColumn("_k", F.lit(1))
    return one(shown, "nodes").join(one(inside, "edges"), "_k").join(flag.withColumn("_k", F.lit(1)), "_k").drop("_k")


# agents 0 and 2 share a family, so do 1 and 3; agent 4 has none
# every registered agent as a reviewer
PENDING_SQL = """r AS (SELECT unnest([0, 1, 2, 3, 4]) AS a),
ok AS (SELECT 'agent:' || a AS agent_id, id, type, cseq, p_name FROM hyp, r WHERE status = 'proposed' AND NOT (p % 5 = a OR (a <> 4 AND p % 5 <> 4 AND (p % 5) % 2 = a % 2)))"""


@query("pending_reviews", f"""WITH {G}, {PENDING_SQL}
SELECT agent_id, CAST(row_number() OVER (PARTITION BY agent_id ORDER BY type = 'conjecture', cseq, id) AS INTEGER) AS place, id, type, p_name AS text FROM ok QUALIFY place <= 25""")
def pending_reviews(spark, sf):
    return _pending(spark, sf)[0]


@query("pending_totals", f"WITH {G}, {PENDING_SQL} SELECT agent_id, count(*) AS pending, greatest(count(*) - 25, 0) AS not_listed FROM ok GROUP BY 1")
def pending_totals(spark, sf):
    return _pending(spark, sf)[1]


def _pending(spark, sf):
    agents = inp.graph_agents(spark, sf)
    who = agents.select(F.col("id").alias("agent_id"))
    return evd.pending_reviews(_n(spark, sf), inp.graph_authorship(spark, sf), agents, who)


@query("review_conflicts", f"""WITH {G}, r AS (SELECT unnest([0, 1, 2, 3, 4]) AS a)
SELECT id AS node_id, 'agent:' || a AS agent_id, CASE WHEN p % 5 = a THEN 'SelfAttestation' ELSE 'ReviewerNotIndependent' END AS rule FROM hyp, r WHERE p % 5 = a OR (a <> 4 AND p % 5 <> 4 AND (p % 5) % 2 = a % 2)""")
def review_conflicts(spark, sf):
    agents = inp.graph_agents(spark, sf)
    return evd.attest_conflicts(_n(spark, sf), inp.graph_authorship(spark, sf), agents, agents.select(F.col("id").alias("agent_id")))


# hide every even question: hypotheses go with it, then their queries, checks and passages, then witnesses
HIDE_SQL = CHECK_SQL + """,
hh AS (SELECT id, p FROM hyp WHERE (p // 40) % 2 = 0),
hq AS (SELECT 'query:P' || p AS id FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0 AND (p // 40) % 2 = 0),
hp AS (SELECT att.passage AS id, any_value(att.s) AS s FROM att GROUP BY 1 HAVING bool_and(node IN (SELECT id FROM hh))),
hv AS (SELECT vid AS id FROM chk WHERE subject_id IN (SELECT id FROM hh) OR subject_id IN (SELECT id FROM hp))
"""


@query("hidden_support", f"""WITH {HIDE_SQL} SELECT id FROM hh UNION SELECT id FROM hq UNION SELECT id FROM hp UNION SELECT id FROM hv UNION SELECT 'question:Q' || (p_partkey // 40) FROM part WHERE p_partkey % 80 = 0
  UNION SELECT 'witness:S' || s FROM psg WHERE q % 10 <> 0 GROUP BY s HAVING bool_and(id IN (SELECT id FROM hp))""")
def hidden_support(spark, sf):
    nodes, edges = inp.graph(spark, sf)
    hidden = nodes.filter("type = 'question'").filter(F.substring("id", 11, 20).cast("bigint") % 2 == 0).select("id")
    return evd.hide_questions(nodes, edges, hidden)


@query("undirected_edges", f"WITH {G} SELECT type, count(*) AS n FROM (SELECT DISTINCT type, least(a, b) AS a, greatest(a, b) AS b FROM par) GROUP BY 1")
def undirected_edges(spark, sf):
    one = evd.dedupe_undirected(_e(spark, sf).filter("type IN ('parallel_of', 'descends_from')"))
    return one.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("display_states", f"""WITH {G}, c AS (SELECT x.id AS a, y.id AS b FROM hyp x JOIN hyp y ON y.p = x.p + 1 WHERE x.p % 9 = 0 AND x.p % 2 <> 0)
SELECT id, CASE WHEN status = 'rejected' THEN 'rejected' WHEN id IN (SELECT a FROM c UNION SELECT b FROM c) THEN 'contradicted' ELSE status END AS state FROM hyp""")
def display_states(spark, sf):
    return evd.display_state(_n(spark, sf), _e(spark, sf)).filter("type IN ('claim', 'conjecture')").select("id", "state")


@query("evidence_layers", f"WITH {ALL_NODES} SELECT id, layer, row_number() OVER (PARTITION BY layer ORDER BY created_seq, id) - 1 AS row FROM (SELECT *, CASE type WHEN 'witness' THEN 0 WHEN 'passage' THEN 1 WHEN 'query' THEN 3 WHEN 'question' THEN 4 ELSE 2 END AS layer FROM nod WHERE type <> 'verification')")
def evidence_layers(spark, sf):
    return evd.layers(_n(spark, sf), span=100_000)


@query("integrity", f"WITH {ALL_NODES} SELECT count(*) AS checked, count(*) FILTER (created_seq % 10 = 3) AS mismatched, count(*) FILTER (created_seq % 10 = 4) AS unhashed FROM nod")
def integrity(spark, sf):
    nodes = _n(spark, sf)
    bad = nodes.withColumn("payload", F.when(F.col("created_seq") % 10 == 3, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return pj.integrity(bad.withColumn("payload_hash", F.when(F.col("created_seq") % 10 == 4, None).otherwise(F.col("payload_hash"))))


@query("hash_backfill", f"WITH {G} SELECT id, sha256('{{\"text\":\"' || p_name || '\"}}') AS payload_hash FROM hyp WHERE type = 'claim'")
def hash_backfill(spark, sf):
    bare = _n(spark, sf).filter("type = 'claim'").withColumn("payload_hash", F.lit(None).cast("string"))
    return pj.backfill_hash(bare).select("id", "payload_hash")


@query("witness_sources", f"WITH {G} SELECT 'witness:S' || s AS witness_id, 'doc' || arg_min(o, (cseq, id)) AS source_ref FROM psg WHERE q % 10 <> 0 GROUP BY 1")
def witness_sources(spark, sf):
    return xr.witness_source(_n(spark, sf), _e(spark, sf))


@query("claim_reviews", f"""WITH {CHECK_SQL}, c AS (SELECT node, count(*) AS n, count(*) FILTER (a.flag = 'A') AS ok FROM live_att a GROUP BY 1), stand AS (SELECT DISTINCT node FROM att WHERE flag IN ('A', 'R')),
r AS (SELECT id AS claim_id, type, p, status, 'agent:' || ((p // 5) % 5) AS reviewer, list_extract(['sound', 'unsound', 'guess'], CAST(p % 7 % 3 AS INTEGER) + 1) AS verdict, (p // 5) % 5 AS ra, p % 5 AS wa FROM hyp)
SELECT claim_id, reviewer, verdict, CASE WHEN verdict = 'guess' THEN 'InvalidVerdict' WHEN ra = wa THEN 'SelfAttestation' WHEN ra <> 4 AND wa <> 4 AND ra % 2 = wa % 2 THEN 'ReviewerNotIndependent' END AS refused,
  coalesce(c.n, 0) AS spans_checked, coalesce(c.ok, 0) AS spans_matched, CASE WHEN refused IS NULL THEN CASE WHEN coalesce(c.n, 0) = 0 THEN 'indeterminate' WHEN c.n = c.ok THEN 'pass' ELSE 'fail' END END AS result,
  refused IS NULL AND coalesce(c.n, 0) > 0 AND c.n = c.ok AND verdict = 'sound' AND status = 'proposed' AND CASE type WHEN 'claim' THEN stand.node IS NOT NULL ELSE tst.p IS NOT NULL END AS attested
FROM r LEFT JOIN c ON c.node = claim_id LEFT JOIN stand ON stand.node = claim_id LEFT JOIN tst ON tst.p = r.p""")
def claim_reviews(spark, sf):
    nodes, edges = _n(spark, sf), _e(spark, sf)
    asked = inp.table(spark, sf, "part").select(
        F.expr("concat(CASE WHEN p_partkey % 3 < 2 THEN 'claim' ELSE 'conjecture' END, ':P', p_partkey)").alias("claim_id"),
        F.expr("concat('agent:', (p_partkey div 5) % 5)").alias("reviewer"),
        F.expr("element_at(array('sound', 'unsound', 'guess'), cast(p_partkey % 7 % 3 AS int) + 1)").alias("verdict"), F.lit("read it").alias("detail"))
    checks = nodes.filter("type = 'passage'").select("id", F.when(F.col("status") == "attested", "pass").otherwise("fail").alias("result"))
    out = vf.review(asked, nodes, edges, inp.graph_authorship(spark, sf), inp.graph_agents(spark, sf), checks)
    return out.select("claim_id", "reviewer", "verdict", "refused", "spans_checked", "spans_matched", "result", "attested")


@query("newest_predictions", f"WITH {G} SELECT id AS conjecture_id, 'query:P' || p AS query_id, p_name AS query, 'at_most' AS expectation, p_size AS expected_hits FROM hyp WHERE type = 'conjecture' AND p_size % 3 <> 0")
def newest_predictions(spark, sf):
    return vf.newest_tests(_n(spark, sf), _e(spark, sf)).select("conjecture_id", "query_id", "query", "expectation", F.col("expected_hits").cast("int").alias("expected_hits"))
