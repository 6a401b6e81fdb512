"""Queries over event logs: census, runs, projection, audit."""
from __future__ import annotations

from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions.frames import by_shuffle, cut_lineage, scratch_path, tail
from vidimus.operators import audit as au
from vidimus.operators import census as ce
from vidimus.operators import projection as pj
from vidimus.plans import inputs as inp
from vidimus.plans.registry import query
from vidimus.sources.eventlog import parse_lines, to_line

REF, RUN, LAD = inp.REFUSED_SQL, inp.RUNS_SQL, inp.LADDER_SQL


# --- refusals --------------------------------------------------------------------------------------
@query("log_scan", f"WITH {RUN} SELECT event, count(*) AS n, min(seq) AS first_seq, sum(CASE WHEN event = 'model_call' THEN k END) AS input_tokens FROM runs GROUP BY 1")
def log_scan(spark, sf):
    log = inp.run_log(spark, sf)
    events, _ = parse_lines(log.select(to_line(log).alias("value")))
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.sum("input_tokens").alias("input_tokens"))


@query("log_rejects", "SELECT reason, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'UnknownEventType' WHEN 1 THEN 'no seq' WHEN 2 THEN 'no author' ELSE 'not an event' END AS reason FROM events) GROUP BY 1")
def log_rejects(spark, sf):
    ev = inp.table(spark, sf, "events")
    bad = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"seq":', event_id, ',"event":"guess","authored_by":"a"}')
      WHEN 1 THEN '{"event":"refused","authored_by":"a"}' WHEN 2 THEN concat('  {"seq":', event_id, ',"event":"ask","authored_by":""}')
      ELSE concat('not json ', event_id) END""")
    _, rejects = parse_lines(ev.select(F.explode(F.array(bad, F.lit("   "))).alias("value")))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("refusal_rows", f"WITH {RUN} SELECT seq, author AS authored_by, attempted, rule, 'm' || k AS message, CASE WHEN k % 6 <> 0 THEN 'claim:' || (k % 10) END AS node_id FROM runs WHERE event = 'refused'")
def refusal_rows(spark, sf):
    return ce.refusals(inp.run_log(spark, sf)).select("seq", "authored_by", "attempted", "rule", "message", "node_id")


@query("refusal_tail", f"WITH {REF} SELECT seq, author AS authored_by, rule FROM ref ORDER BY seq DESC LIMIT 50")
def refusal_tail(spark, sf):
    return ce.refusals(inp.refused_log(spark, sf), limit=50).select("seq", "authored_by", "rule")


@query("refusal_census", f"""WITH {REF}
SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'rule' AS dimension, rule AS value, count(*) AS n FROM ref GROUP BY 2 UNION ALL SELECT 'author', author, count(*) FROM ref GROUP BY 2
  UNION ALL SELECT 'attempted', attempted, count(*) FROM ref GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM ref GROUP BY 2
  UNION ALL SELECT 'category', unnest(['evidence', 'standing', 'expression', 'operational', 'unclassified']), 0) GROUP BY 1, 2""")
def refusal_census(spark, sf):
    return ce.refusal_census(ce.refusals(inp.refused_log(spark, sf)))


@query("refusal_summary", f"WITH {REF} SELECT count(*) AS total, count(*) FILTER (category = 'expression') AS expression_count, arg_min('at' || seq, seq) AS first_at, arg_max('at' || seq, seq) AS last_at FROM ref")
def refusal_summary(spark, sf):
    return ce.census_summary(ce.refusals(inp.refused_log(spark, sf)))


STREAK_SQL = REF + """,
s1 AS (SELECT *, CASE WHEN rule = lag(rule) OVER (PARTITION BY author ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM ref),
s2 AS (SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY seq) AS island FROM s1),
s3 AS (SELECT author, island, any_value(rule) AS rule, any_value(category) AS category, count(*) AS count, min(seq) AS first_seq, max(seq) AS last_seq FROM s2 GROUP BY 1, 2 HAVING count(*) >= 2),
a1 AS (SELECT author, island, attempted, min(seq) AS s FROM s2 GROUP BY 1, 2, 3), a2 AS (SELECT author, island, string_agg(attempted, ' ' ORDER BY s) AS attempted FROM a1 GROUP BY 1, 2),
n1 AS (SELECT author, island, node_id, min(seq) AS s FROM s2 WHERE node_id IS NOT NULL GROUP BY 1, 2, 3), n2 AS (SELECT author, island, string_agg(node_id, ' ' ORDER BY s) AS node_ids FROM n1 GROUP BY 1, 2)
"""
STREAK_OUT = "SELECT s3.author AS authored_by, s3.rule, s3.category, s3.count, s3.first_seq, s3.last_seq, a2.attempted, coalesce(n2.node_ids, '') AS node_ids FROM s3 JOIN a2 USING (author, island) LEFT JOIN n2 USING (author, island)"


def _flat(streaks):
    return streaks.withColumn("attempted", F.array_join("attempted", " ")).withColumn("node_ids", F.array_join("node_ids", " "))


@query("refusal_streaks", f"WITH {STREAK_SQL} {STREAK_OUT}")
def refusal_streaks(spark, sf):
    return _flat(ce.refusal_streaks(ce.refusals(inp.refused_log(spark, sf))))


@query("streak_totals", f"WITH {STREAK_SQL} SELECT count(*) AS streaks, CAST(coalesce(sum(count), 0) AS BIGINT) AS streaked_count, coalesce(max(count), 0) AS longest FROM s3")
def streak_totals(spark, sf):
    return ce.streak_totals(ce.refusal_streaks(ce.refusals(inp.refused_log(spark, sf))))


# --- model calls, runs, spend --------------------------------------------------------------------------
_CALLS = "count(*) AS calls, CAST(sum(k) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(CASE WHEN k % 3 <> 0 THEN k * 2 END), 0) AS BIGINT) AS total_output_tokens, CAST(sum(k * 10) AS BIGINT) AS total_latency_ms, round(coalesce(sum(cost_usd), 0), 6) AS total_cost_usd"


@query("model_calls", f"WITH {RUN} SELECT {_CALLS} FROM runs WHERE event = 'model_call'")
def model_calls(spark, sf):
    return ce.model_call_summary(inp.run_log(spark, sf)).withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query("model_calls_by_run", f"WITH {RUN} SELECT run_id, {_CALLS} FROM runs WHERE event = 'model_call' GROUP BY 1")
def model_calls_by_run(spark, sf):
    return ce.model_call_summary(inp.run_log(spark, sf), by_run=True).withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query("run_history", f"""WITH {RUN},
s AS (SELECT run_id, max(seq) AS s FROM runs WHERE event = 'run_started' GROUP BY 1), f AS (SELECT run_id, max(seq) AS f FROM runs WHERE event = 'run_finished' GROUP BY 1),
c AS (SELECT run_id, count(*) AS events, count(*) FILTER (event = 'refused') AS refusals FROM runs GROUP BY 1)
SELECT s.run_id, 'at' || s.s AS started_at, 'question:' || a.k AS question_id, CASE WHEN f.f > s.s THEN 'at' || f.f END AS finished_at,
  CASE WHEN f.f > s.s THEN CASE WHEN b.k % 2 = 0 THEN 'finished' ELSE 'stopped' END END AS state, a.k / 10 AS budget_usd,
  CASE WHEN f.f > s.s THEN b.k / 20 END AS spent_usd, CASE WHEN f.f > s.s THEN b.k ELSE 0 END AS calls, c.events, c.refusals
FROM s JOIN runs a ON a.seq = s.s LEFT JOIN f ON f.run_id = s.run_id LEFT JOIN runs b ON b.seq = f.f JOIN c ON c.run_id = s.run_id""")
def run_history(spark, sf):
    return ce.run_history(inp.run_log(spark, sf)).drop("agents", "error")


_TOOLS = """acts AS (SELECT *, CASE k % 4 WHEN 0 THEN 'semantic_neighbors' WHEN 1 THEN 'align_passages' WHEN 2 THEN 'attribution_evidence' ELSE 'find_attestations' END AS tool FROM runs WHERE event = 'tool_action'),
rs AS (SELECT seq - 1 - k % 5 AS action_seq, max(seq) AS last FROM runs WHERE event = 'tool_result' GROUP BY 1),
calls AS (SELECT a.*, rs.last, r.k AS rk, rs.last IS NULL AS pending, coalesce(r.k % 9 = 0, false) AS failed FROM acts a LEFT JOIN rs ON rs.action_seq = a.seq LEFT JOIN runs r ON r.seq = rs.last)"""


@query("run_activity", f"""WITH {RUN}, {_TOOLS},
per AS (SELECT run_id, author AS agent_id, count(*) AS calls, count(*) FILTER (pending) AS pending, count(*) FILTER (failed) AS errors, arg_max(tool, seq) AS last_tool FROM calls GROUP BY 1, 2),
ana AS (SELECT run_id, author AS agent_id, 'reading ' || max(seq) AS analysis FROM runs WHERE event = 'analysis' GROUP BY 1, 2)
SELECT coalesce(per.run_id, ana.run_id) AS run_id, coalesce(per.agent_id, ana.agent_id) AS agent_id, calls, pending, errors, last_tool, analysis
FROM per FULL JOIN ana ON per.run_id = ana.run_id AND per.agent_id = ana.agent_id""")
def run_activity(spark, sf):
    return ce.run_activity(inp.run_log(spark, sf))


@query("activity_summary", f"""WITH {RUN}, {_TOOLS}
SELECT run_id, author AS agent_id, seq, tool, pending, CASE WHEN pending THEN NULL ELSE CAST(rk AS VARCHAR) END AS longest_shared_run,
  CASE WHEN pending THEN '' ELSE 'u' || rk || ' u' || (rk + 1) END AS neighbours, NULL::VARCHAR AS excerpt FROM calls""")
def activity_summary(spark, sf):
    out = ce.activity_summary(ce.tool_calls(inp.run_log(spark, sf)))
    return out.select(
        "run_id", "agent_id", "seq", "tool", "pending", F.try_element_at("kept", F.lit("longest_shared_run")).alias("longest_shared_run"),
        F.coalesce(F.array_join("neighbour_uids", " "), F.lit("")).alias("neighbours"), F.try_element_at("kept", F.lit("excerpt")).alias("excerpt"),
    )


@query("activity_overlay", f"""WITH {RUN}, {_TOOLS}, done AS (SELECT * FROM calls WHERE NOT pending),
o AS (
  SELECT run_id, author AS agent_id, 'u' || user_id AS uid, seq, CASE WHEN failed THEN 'search failed' ELSE 'similarity search' END AS kind FROM done WHERE tool = 'semantic_neighbors'
  UNION ALL SELECT run_id, author, 'u' || (rk + i), seq, 'candidate returned' FROM done, (SELECT unnest([0, 1]) AS i) WHERE tool = 'semantic_neighbors' AND NOT failed
  UNION ALL SELECT DISTINCT run_id, author, CASE i WHEN 0 THEN 'u' || user_id ELSE 'u' || k END, seq, CASE WHEN failed THEN 'comparison failed' ELSE 'wording compared' END FROM done, (SELECT unnest([0, 1]) AS i) WHERE tool = 'align_passages'
  UNION ALL SELECT run_id, author, 'u' || user_id, seq, CASE WHEN failed THEN 'calculation failed' ELSE 'vocabulary compared' END FROM done WHERE tool = 'attribution_evidence'
  UNION ALL SELECT run_id, author, 'u' || rk, seq, 'citation recorded' FROM done WHERE tool = 'find_attestations' AND NOT failed)
SELECT run_id, agent_id, uid, count(*) AS actions, min(seq) AS first_seq FROM o GROUP BY 1, 2, 3""")
def activity_overlay(spark, sf):
    return ce.overlay_units(ce.activity_overlay(inp.run_log(spark, sf))).drop("last_kind")


_SPEND = "charge AS (SELECT run_id, seq, cost_usd, coalesce(cost_usd, 0.01) AS c FROM runs WHERE event = 'model_call'), steps AS (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY seq) AS spent FROM charge)"


@query("spend", f"""WITH {RUN}, {_SPEND}
SELECT run_id, count(*) AS calls, count(*) FILTER (cost_usd IS NULL) AS unpriced_calls, round(sum(c), 6) AS spent_usd, min(seq) FILTER (spent >= 0.5) AS exhausted_at_seq,
  round(greatest(0, 0.5 - sum(c)), 6) AS remaining_usd FROM steps GROUP BY 1""")
def spend(spark, sf):
    out = ce.spend(inp.run_log(spark, sf), 0.5)
    return out.withColumn("spent_usd", F.round("spent_usd", 6)).withColumn("remaining_usd", F.round("remaining_usd", 6))


@query("spend_steps", f"WITH {RUN}, {_SPEND} SELECT run_id, seq, round(spent, 6) AS spent FROM steps")
def spend_steps(spark, sf):
    return ce.spend_steps(inp.run_log(spark, sf), 0.5).select("run_id", "seq", F.round("spent", 6).alias("spent"))


@query("roster_clashes", f"""WITH {RUN}, s AS (SELECT run_id, max(seq) AS s FROM runs WHERE event = 'run_started' GROUP BY 1),
r AS (SELECT s.run_id, a.user_id, a.k FROM s JOIN runs a ON a.seq = s.s)
SELECT run_id, 'fam' || (k % 4) AS family, CAST(2 AS BIGINT) AS agents, list_aggregate(list_sort(['agent:' || user_id, 'agent:' || (user_id + 1)]), 'string_agg', ' ') AS agent_ids FROM r WHERE k % 4 = k % 3""")
def roster_clashes(spark, sf):
    return ce.roster_clashes(inp.run_log(spark, sf)).withColumn("agent_ids", F.array_join("agent_ids", " "))


@query("conversation_threads", """WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'c' || (conv_id // 3) AS conversation_id, 'run:' || arg_max(conv_id, n * 1000000000000 + conv_id) AS run_id, max(n) AS messages FROM t GROUP BY 1""")
def conversation_threads(spark, sf):
    conv = inp.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    ctx = F.to_json(F.struct(
        F.lit(1).alias("version"), F.expr("concat('c', conv_id div 3)").alias("conversation_id"),
        F.transform("t", lambda m: F.struct(m["role"].alias("role"), F.lit("text").alias("content"))).alias("messages"),
    ))
    who = F.array(F.struct(F.lit("analyst").alias("role"), F.concat(F.lit("STORED CONTEXT 1\n"), ctx, F.lit("\n\nguide")).alias("instructions")))
    starts = inp._event_frame(
        conv, seq=F.col("conv_id"), event=F.lit("run_started"), authored_by=F.lit("researcher"), run_id=F.expr("concat('run:', conv_id)"),
        detail=F.to_json(F.struct(who.alias("agents"))),
    )
    return ce.threads(starts, "STORED CONTEXT 1").withColumn("messages", F.col("messages").cast("bigint"))


@query("merged_histories", """WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT 'run:' || conv_id AS run_id, CASE WHEN conv_id % 5 = 0 THEN 'current' WHEN conv_id % 2 = 0 THEN 'memory' ELSE 'recorded' END AS came_from, n FROM t WHERE conv_id % 7 <> 0""")
def merged_histories(spark, sf):
    conv = inp.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    roles = F.to_json(F.array(F.struct(F.when(F.col("conv_id") % 7 == 0, "analyst").otherwise("worker").alias("role"))))
    base = conv.select(F.concat(F.lit("run:"), F.col("conv_id").cast("string")).alias("run_id"), "n", roles.alias("agents"), "conv_id")
    part = lambda name, cond: base.filter(cond).withColumn("came_from", F.lit(name)).drop("conv_id")
    return ce.inquiry_runs(part("recorded", "true"), part("memory", "conv_id % 2 = 0"), part("current", "conv_id % 5 = 0")).select("run_id", "came_from", "n")


# --- projection --------------------------------------------------------------------------------------------
# state of a node: first propose creates it, later moves count only after that
FOLD_SQL = LAD + """,
born AS (SELECT node_id AS id, min(seq) AS created_seq, arg_min(node_type, seq) AS type, 't' || min(seq) AS text FROM lad WHERE event = 'propose' GROUP BY 1),
mv AS (SELECT lad.*, b.created_seq, CASE event WHEN 'attest' THEN 'attested' WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reopen' THEN 'proposed' END AS to_status
  FROM lad JOIN born b ON b.id = lad.node_id WHERE seq > created_seq),
fold AS (
  SELECT b.id, b.type, b.created_seq, b.text, coalesce(arg_max(mv.to_status, mv.seq) FILTER (mv.event <> 'propose'), 'proposed') AS status,
    CASE WHEN arg_max(mv.event, mv.seq) FILTER (mv.event IN ('accept', 'reject', 'reopen')) = 'reject' THEN arg_max(mv.reason, mv.seq) FILTER (mv.event IN ('accept', 'reject', 'reopen')) END AS rejected_reason,
    greatest(b.created_seq, coalesce(max(mv.seq), 0)) AS updated_seq
  FROM born b LEFT JOIN mv ON mv.node_id = b.id GROUP BY 1, 2, 3, 4),
dec AS (SELECT 'decision:' || seq AS id, 'decision' AS type, seq AS created_seq, 'accepted' AS status, NULL AS rejected_reason, seq AS updated_seq FROM lad WHERE event IN ('accept', 'reject', 'reopen'))
"""
_NODE_COLS = ["id", "type", "status", "rejected_reason", "created_seq", "updated_seq"]


@query("projected_nodes", f"WITH {FOLD_SQL} SELECT id, type, status, rejected_reason, created_seq, updated_seq FROM fold UNION ALL SELECT id, type, status, rejected_reason, created_seq, updated_seq FROM dec")
def projected_nodes(spark, sf):
    return pj.project(inp.ladder_log(spark, sf)).nodes.select(*_NODE_COLS)


@query("projected_authorship", f"""WITH {FOLD_SQL}
SELECT node_id, author, CASE event WHEN 'attest' THEN 'attested' WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'reopen' THEN 'reopened' ELSE CASE WHEN seq = created_seq THEN 'proposed' ELSE 'converged' END END AS action, seq
FROM lad LEFT JOIN born ON born.id = lad.node_id WHERE event <> 'propose' OR created_seq IS NOT NULL
UNION ALL SELECT 'decision:' || seq, author, 'proposed', seq FROM lad WHERE event IN ('accept', 'reject', 'reopen')""")
def projected_authorship(spark, sf):
    return pj.project(inp.ladder_log(spark, sf)).node_authorship.select("node_id", "author", "action", "seq")


def _edge_log(spark, sf):
    """Users as witnesses: every event draws, withdraws or restores an edge between two of them."""
    ev = inp.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("u"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.expr("CASE WHEN k % 2 = 0 THEN 'parallel_of' ELSE 'descends_from' END")
    event = F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'add_edge' WHEN event_type = 'error' THEN 'restore_edge' ELSE 'retract_edge' END")
    eid = F.expr("concat('edge:', u, '-', k div 4, CASE WHEN k % 2 = 0 THEN 'p' ELSE 'd' END)")
    detail = F.to_json(F.struct(
        F.expr("concat('witness:', u)").alias("src"), F.expr("concat('witness:x', k div 4)").alias("dst"), F.expr("concat('because ', seq)").alias("reason")))
    ref = F.when(F.col("k") % 10 == 0, F.concat(eid, F.lit(":rev"))).otherwise(eid)
    return inp._event_frame(
        ev, seq=F.col("seq"), event=event, authored_by=F.expr("concat('agent:', u % 9)"), at=F.expr("concat('at', seq)"),
        edge_id=F.when(event == "add_edge", eid).otherwise(ref), edge_type=kind, detail=detail,
    )


_EDGES = """e0 AS (SELECT event_id AS seq, user_id AS u, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e1 AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'error' THEN 'restore' ELSE 'retract' END AS ev,
  'edge:' || u || '-' || (k // 4) || CASE WHEN k % 2 = 0 THEN 'p' ELSE 'd' END AS id, 'agent:' || (u % 9) AS author FROM e0),
drawn AS (SELECT id, min(seq) AS created_seq, any_value(u) AS u, any_value(k // 4) AS g, any_value(k % 2 = 0) AS sym FROM e1 WHERE ev = 'add' GROUP BY 1),
lastmove AS (SELECT d.id, max(e1.seq) AS m FROM drawn d JOIN e1 ON e1.id = d.id AND e1.ev <> 'add' AND e1.seq > d.created_seq GROUP BY 1),
edge1 AS (SELECT d.*, CASE WHEN x.ev = 'retract' THEN x.seq END AS gone FROM drawn d LEFT JOIN lastmove l ON l.id = d.id LEFT JOIN e1 x ON x.seq = l.m)"""


@query("projected_edges", f"""WITH {_EDGES}, two AS (
  SELECT id, sym, 'witness:' || u AS src, 'witness:x' || g AS dst, created_seq, gone FROM edge1 UNION ALL SELECT id || ':rev', sym, 'witness:x' || g, 'witness:' || u, created_seq, gone FROM edge1 WHERE sym)
SELECT id, CASE WHEN sym THEN 'parallel_of' ELSE 'descends_from' END AS type, src, dst, created_seq, 'because ' || created_seq AS reason, 'at' || gone AS retracted_at, 'because ' || gone AS retracted_reason FROM two""")
def projected_edges(spark, sf):
    return pj.project(_edge_log(spark, sf)).edges


@query("projected_edge_authorship", f"""WITH {_EDGES}, acts AS (
  SELECT id, author, 'proposed' AS action, seq, sym FROM (SELECT e1.*, k % 2 = 0 AS sym FROM e1 WHERE ev = 'add')
  UNION ALL SELECT e1.id, author, CASE ev WHEN 'retract' THEN 'retracted' ELSE 'restored' END, seq, d.sym FROM e1 JOIN drawn d ON d.id = e1.id WHERE ev <> 'add' AND seq > d.created_seq)
SELECT id AS edge_id, author, action, seq FROM acts UNION ALL SELECT id || ':rev', author, action, seq FROM acts WHERE sym""")
def projected_edge_authorship(spark, sf):
    return pj.project(_edge_log(spark, sf)).edge_authorship.select("edge_id", "author", "action", "seq")


@query("projected_agents", """WITH r AS (SELECT event_id AS seq, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'signup')
SELECT 'agent:' || user_id AS id, arg_max(CASE WHEN k % 2 = 0 THEN 'worker' ELSE 'reviewer' END, seq) AS kind, arg_max('scope ' || k, seq) AS corpus_scope,
  CASE WHEN arg_max(k, seq) % 5 <> 0 THEN 'fam' || arg_max(k, seq) || '/m' END AS model, min(seq) AS created_seq FROM r GROUP BY user_id""")
def projected_agents(spark, sf):
    ev = inp.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("seq"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    profile = F.struct(
        F.expr("concat('agent:', user_id)").alias("id"), F.expr("CASE WHEN k % 2 = 0 THEN 'worker' ELSE 'reviewer' END").alias("kind"),
        F.expr("concat('scope ', k)").alias("corpus_scope"), F.expr("CASE WHEN k % 5 <> 0 THEN concat('fam', k, '/m') END").alias("model"))
    log = inp._event_frame(ev, seq=F.col("seq"), event=F.lit("register_agent"), authored_by=F.lit("researcher"), detail=F.to_json(F.struct(profile.alias("payload"))))
    return pj.project(log).agents.select("id", "kind", "corpus_scope", "model", "created_seq")


@query("rebuild_diff", f"""WITH {FOLD_SQL}
SELECT 'nodes' AS "table", id, side, CAST(1 AS BIGINT) AS n FROM fold, (SELECT unnest(['replay', 'stored']) AS side) WHERE created_seq % 10 = 0 AND status <> 'rejected' AND type = 'claim'
UNION ALL SELECT 'node_authorship', 'decision:' || seq, 'replay', 1 FROM lad WHERE event IN ('accept', 'reject', 'reopen') AND seq % 50 = 0""")
def rebuild_diff(spark, sf):
    log = inp.ladder_log(spark, sf)
    # a stored copy that went wrong: some claims flipped, some decision authorship lost
    g = pj.Graph(*map(cut_lineage, pj.project(log)))
    nodes = g.nodes.withColumn("status", F.when((F.col("created_seq") % 10 == 0) & (F.col("type") == "claim"), "rejected").otherwise(F.col("status")))
    lost = F.startswith("node_id", F.lit("decision:")) & (F.col("seq") % 50 == 0)
    return pj.rebuild_diff(log, nodes, g.edges, g.node_authorship.filter(~lost), g.edge_authorship, g.agents).select("table", "id", "side", "n")


# the log and its projection copied, replayed, committed and read back; a first try with a damaged table leaves a stale stage
@query("graph_snapshot", f"""WITH {FOLD_SQL}, n AS (SELECT 'events' AS "table", count(*) AS rows FROM lad UNION ALL SELECT 'nodes', (SELECT count(*) FROM fold) + (SELECT count(*) FROM dec)
  UNION ALL SELECT 'node_authorship', count(*) FILTER (event <> 'propose' OR created_seq IS NOT NULL) + count(*) FILTER (event IN ('accept', 'reject', 'reopen')) FROM lad LEFT JOIN born ON born.id = lad.node_id
  UNION ALL SELECT 'edges', (SELECT count(*) FROM lad WHERE event = 'propose' AND node_type = 'passage') UNION ALL SELECT 'edge_authorship', (SELECT count(*) FROM lad WHERE event = 'propose' AND node_type = 'passage') UNION ALL SELECT 'agents', 0)
SELECT "table", CAST(rows AS BIGINT) AS rows, true AS intact, CAST(1 AS INTEGER) AS stale_stages FROM n""")
def graph_snapshot(spark, sf):
    from vidimus.sources import artifacts as ar
    from vidimus.sources.corpus import SourceError

    log = inp.ladder_log(spark, sf)
    graph, dest = pj.project(log)._asdict(), scratch_path(spark, "snapshot")
    try:
        ar.snapshot({**graph, "nodes": graph["nodes"].withColumn("status", F.lit("accepted"))}, log, dest)
    except SourceError:
        pass  # as it should: the copied state is not what the log replays to
    ar.snapshot(graph, log, dest)
    _, checked = ar.read_snapshot(spark, dest)
    return checked.select("table", "rows", "intact").withColumn("stale_stages", F.lit(len(ar.stale_stages(spark, dest))))


@query("creation_provenance", f"""WITH {RUN}, {_TOOLS.split('rs AS')[0].rstrip().rstrip(',')},
calls2 AS (SELECT seq, 'fam' || (k % 4) || '/m' AS model FROM runs WHERE event = 'model_call'),
made AS (SELECT seq AS created_seq, author, run_id, user_id, seq - 1 AS call_id FROM acts),
st AS (SELECT m.created_seq, max(s.seq) AS s FROM made m JOIN runs s ON s.run_id = m.run_id AND s.event = 'run_started' AND s.seq <= m.created_seq AND m.user_id IN (s.user_id, s.user_id + 1) GROUP BY 1)
SELECT 'node:' || m.created_seq AS id, m.author, CASE WHEN s.user_id = m.user_id THEN 'worker' WHEN s.user_id + 1 = m.user_id THEN 'reviewer' END AS role, c.model, 'because ' || a.k AS reason, a.tool
FROM made m JOIN acts a ON a.seq = m.created_seq LEFT JOIN calls2 c ON c.seq = m.call_id LEFT JOIN st ON st.created_seq = m.created_seq LEFT JOIN runs s ON s.seq = st.s""")
def creation_provenance(spark, sf):
    log = inp.run_log(spark, sf)
    made = log.filter("event = 'tool_action'").select(F.concat(F.lit("node:"), F.col("seq").cast("string")).alias("id"), F.col("seq").alias("created_seq"))
    return pj.creation_provenance(made, log)


# --- rules -----------------------------------------------------------------------------------------------------
AUDIT_SQL = FOLD_SQL + """,
line AS (
  SELECT id AS node_id, created_seq AS seq, 'proposed' AS to_status FROM born
  UNION ALL SELECT node_id, seq, CASE event WHEN 'attest' THEN 'attested' WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'proposed' END FROM lad WHERE event <> 'propose'
  UNION ALL SELECT node_id, seq, NULL FROM lad JOIN born ON born.id = node_id WHERE event = 'propose' AND seq > created_seq),
was_ AS (SELECT node_id, seq, last_value(to_status IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM line),
authored AS (SELECT node_id, author, min(seq) AS first_seq FROM lad WHERE event = 'propose' GROUP BY 1, 2),
ctx AS (SELECT lad.*, was_.was, born.created_seq, born.type, coalesce(born.created_seq < lad.seq, false) AS known, a.first_seq
  FROM lad LEFT JOIN was_ ON was_.node_id = lad.node_id AND was_.seq = lad.seq LEFT JOIN born ON born.id = lad.node_id
  LEFT JOIN authored a ON a.node_id = lad.node_id AND a.author = lad.author),
wit AS (SELECT id, created_seq FROM born WHERE type = 'witness'),
v AS (
  SELECT seq, event, CASE
    WHEN event IN ('accept', 'reject', 'reopen') AND author <> 'researcher' THEN 'NotResearcher'
    WHEN event IN ('reject', 'reopen') AND reason = '' THEN 'MissingRejectionReason'
    WHEN event <> 'propose' AND NOT known THEN 'NodeNotFound'
    WHEN event = 'attest' AND was <> 'proposed' OR event = 'accept' AND was <> 'attested' OR event = 'reject' AND was NOT IN ('proposed', 'attested') OR event = 'reopen' AND was <> 'rejected' THEN 'RungSkipped'
    WHEN event = 'attest' AND type IN ('claim', 'conjecture') AND author <> 'researcher' AND first_seq < seq THEN 'SelfAttestation'
    WHEN event = 'attest' AND type = 'claim' THEN 'UnattestableClaim'
    WHEN event = 'attest' AND type = 'conjecture' THEN 'UnattestableConjecture'
    WHEN event = 'propose' AND node_type = 'passage' AND NOT EXISTS (SELECT 1 FROM wit WHERE wit.id = 'witness:n' || (user_id // 10) || '-3' AND wit.created_seq < ctx.seq) THEN 'EdgeEndpointMissing'
    WHEN event = 'propose' AND node_type IN ('witness', 'passage') AND known AND was = 'rejected' THEN 'PersistentRejection' END AS rule
  FROM ctx)
"""


@query("rule_audit", f"WITH {AUDIT_SQL} SELECT seq, event, rule, CASE rule WHEN 'NotResearcher' THEN 'standing' WHEN 'RungSkipped' THEN 'standing' WHEN 'SelfAttestation' THEN 'standing' WHEN 'PersistentRejection' THEN 'standing' WHEN 'UnattestableClaim' THEN 'evidence' WHEN 'UnattestableConjecture' THEN 'evidence' ELSE 'expression' END AS category FROM v WHERE rule IS NOT NULL")
def rule_audit(spark, sf):
    return au.audit(inp.ladder_log(spark, sf)).drop("message")


@query("rule_counts", f"WITH {AUDIT_SQL} SELECT event, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1, 2")
def rule_counts(spark, sf):
    return au.audit(inp.ladder_log(spark, sf)).groupBy("event", "rule").agg(F.count(F.lit(1)).alias("n"))


# every user is made a witness first, so only the state of the edge itself is at issue
@query("edge_rule_audit", f"""WITH {_EDGES},
moves AS (SELECT e1.*, d.created_seq, last_value(CASE WHEN ev = 'add' THEN NULL ELSE ev END IGNORE NULLS) OVER (PARTITION BY e1.id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e1 LEFT JOIN drawn d ON d.id = e1.id)
SELECT seq + 1000000000000 AS seq, rule FROM (
  SELECT seq, CASE
    WHEN ev = 'add' AND created_seq < seq AND was = 'retract' THEN 'PersistentRetraction' WHEN ev = 'add' AND created_seq < seq THEN 'MalformedEvent'
    WHEN ev <> 'add' AND (created_seq IS NULL OR created_seq > seq OR (k % 10 = 0 AND k % 2 <> 0)) THEN 'EdgeNotFound'
    WHEN ev = 'retract' AND was = 'retract' OR ev = 'restore' AND coalesce(was, 'restore') <> 'retract' THEN 'EdgeAlreadyRetracted' END AS rule FROM moves) WHERE rule IS NOT NULL""")
def edge_rule_audit(spark, sf):
    log = _edge_log(spark, sf).withColumn("authored_by", F.lit(schemas.RESEARCHER)).withColumn("seq", F.col("seq") + 1000000000000)
    d = lambda k: F.get_json_object("detail", f"$.{k}")
    ends = log.filter("event = 'add_edge'").select("seq", F.explode(F.array(d("src"), d("dst"))).alias("id")).groupBy("id").agg(F.min("seq").alias("s"))
    made = inp._event_frame(
        ends, seq=F.expr("(s - 1000000000000) * 2 + cast(startswith(id, 'witness:x') AS int)"), event=F.lit("propose"), authored_by=F.lit("a"), node_id=F.col("id"), node_type=F.lit("witness"),
        detail=F.lit('{"payload":{"canonical_ref":"w"}}'))
    return au.audit(made.unionByName(log)).filter("seq >= 1000000000000").select("seq", "rule")


@query("refusals_tail_runs", f"WITH {RUN} SELECT DISTINCT run_id, max(seq) AS last_seq FROM runs GROUP BY run_id ORDER BY last_seq DESC LIMIT 10")
def refusals_tail_runs(spark, sf):
    last = inp.run_log(spark, sf).groupBy("run_id").agg(F.max("seq").alias("last_seq"))
    return tail(last, "last_seq", 10)


# every part keeps or breaks one rule, in a log where all parts' stories are mixed
@query("rule_stories", f"WITH {inp.STORIES_SQL} SELECT p_partkey AS part, place, rule FROM part JOIN stories ON story = p_partkey % {len(inp.STORIES)}")
def rule_stories(spark, sf):
    found = au.audit(inp.story_log(spark, sf))
    return found.select(F.expr("seq div 32").alias("part"), F.expr("cast(seq % 32 AS int)").alias("place"), "rule")



# --- admission --------------------------------------------------------------------------------------------
@query("admitted_events", f"""WITH {inp.ADMISSION_SQL}, first AS (SELECT d, min(k) FILTER (WHERE who <> 'agent:a') AS k FROM ask GROUP BY 1)
SELECT 1000000000000 + d * 10 + ask.k AS seq, ask.k = first.k AS admitted,
  CASE WHEN ask.k = first.k THEN '' WHEN who = 'agent:a' AND ask.k < first.k THEN 'SelfAttestation' ELSE 'later' END AS rule FROM ask JOIN first USING (d)""")
def admitted_events(spark, sf):
    log, batch = inp.claim_log(spark, sf)
    admitted, refused = au.admit(log, batch)
    went = admitted.groupBy(F.get(F.split("node_id", ":"), F.lit(1)).alias("d")).agg(F.min("seq").alias("at"))
    out = refused.select("seq", F.lit(False).alias("admitted"), "rule", F.floor((F.col("seq") - 1_000_000_000_000) / 10).cast("string").alias("d")).join(by_shuffle(went), "d")
    rule = F.when(F.col("seq") < F.col("at"), F.col("rule")).otherwise("later")
    return out.select("seq", "admitted", rule.alias("rule")).unionByName(admitted.select("seq", F.lit(True).alias("admitted"), F.lit("").alias("rule")))
