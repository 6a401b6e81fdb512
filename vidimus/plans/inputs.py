"""Operator inputs derived from the given tables by plain Spark expressions.

The given tables hold no evidence log, graph or catalogued corpus, so each is laid over them: every
event, node, edge, unit and window below comes from rows of a table and grows with it. The `*_SQL`
texts are the same derivations for the reference SQL.
"""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, spread


# tables of long texts, with the key their rows may be dealt out by
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _event_frame(df: DataFrame, **cols) -> DataFrame:
    """Fill the event schema; columns not given are null."""
    types = dict(p.split(" ") for p in schemas.EVENT_DDL.split(", "))
    return df.select(*[
        (cols[c] if c in cols else F.lit(None)).cast(t.lower()).alias(c) for c, t in types.items()
    ])


def _s(e: str):
    return F.expr(e)


# --- events as a log of ladder writes ----------------------------------------------------------------
# node = user group and k group; type by k group; a third of the writers is the researcher
LADDER_SQL = """
raw AS (SELECT event_id AS seq, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
lad AS (
  SELECT seq, user_id, k,
    CASE event_type WHEN 'signup' THEN 'propose' WHEN 'view' THEN 'attest' WHEN 'purchase' THEN 'accept'
      WHEN 'error' THEN 'reject' ELSE 'reopen' END AS event,
    CASE (k // 5) % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'conjecture' WHEN 2 THEN 'passage' ELSE 'witness' END AS node_type,
    CASE (k // 5) % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'conjecture' WHEN 2 THEN 'passage' ELSE 'witness' END
      || ':n' || (user_id // 10) || '-' || (k // 5) AS node_id,
    CASE WHEN seq % 3 = 0 THEN 'researcher' ELSE 'agent:' || (user_id % 7) END AS author,
    CASE WHEN event_type IN ('purchase', 'error', 'click') THEN CASE WHEN seq % 5 = 0 THEN '' ELSE 'r' || seq END END AS reason
  FROM raw)
"""


def ladder_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    event = _s("CASE event_type WHEN 'signup' THEN 'propose' WHEN 'view' THEN 'attest' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' ELSE 'reopen' END")
    kind = _s("CASE (k div 5) % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'conjecture' WHEN 2 THEN 'passage' ELSE 'witness' END")
    ev = ev.withColumn("event", event).withColumn("kind", kind)
    node = _s("concat(kind, ':n', user_id div 10, '-', k div 5)")
    reason = _s("CASE WHEN seq % 5 = 0 THEN '' ELSE concat('r', seq) END")
    payload = F.struct(F.concat(F.lit("t"), F.col("seq").cast("string")).alias("text"), F.col("kind").alias("canonical_ref"))
    detail = (
        F.when(F.col("event") == "propose", F.to_json(F.struct(
            payload.alias("payload"), F.lit(False).alias("converge"), _s("concat('witness:n', user_id div 10, '-', 3)").alias("witness_id"))))
        .when(F.col("event") == "attest", F.lit("{}"))
        .otherwise(F.to_json(F.struct(F.concat(F.lit("decision:"), F.col("seq").cast("string")).alias("decision_node_id"), reason.alias("reason"))))
    )
    draws = (F.col("event") == "propose") & (F.col("kind") == "passage")
    return _event_frame(
        ev, seq=F.col("seq"), event=F.col("event"), authored_by=_s("CASE WHEN seq % 3 = 0 THEN 'researcher' ELSE concat('agent:', user_id % 7) END"),
        at=_s("concat('at', seq)"), node_id=node, node_type=F.col("kind"), detail=detail,
        edge_id=F.when(draws, _s("concat('edge:', seq)")), edge_type=F.when(draws, F.lit("part_of")),
        run_id=_s("concat('run:', user_id div 25)"),
    )


# --- parts as small stories, one for each way to keep or break a rule ---------------------------------------------------
def _story(event, node=None, by="agent:b§", edge=None, kind=None, **detail) -> dict:
    """One event of a story; § stands for the part, so each part has nodes, edges and agents of its own."""
    name = node if node is None or node.startswith("decision") else f"{node}§"
    return {"event": event, "authored_by": by, "node_id": name, "node_type": node.split(":")[0] if node and event in ("propose", "verify") else None, "edge_id": edge and f"{edge}§", "edge_type": kind, "detail": detail}


def _proposed(node, witness=None, by="agent:a§") -> dict:
    where = {"witness_id": f"{witness}§"} if witness else {}
    return _story("propose", node, by, f"edge:{node}" if witness else None, "part_of" if witness else None, payload={"text": node}, converge=False, **where)


def _edge(kind, src, dst, edge="edge:x", **more) -> dict:
    return _story("add_edge", None, "agent:a§", edge, kind, src=f"{src}§", dst=f"{dst}§", **more)


def _shift(event, edge="edge:x", by="researcher", reason="wrong") -> dict:
    return _story(event, None, by, edge, reason=reason)


def _agent(name, model) -> dict:
    return _story("register_agent", None, "researcher", payload={"id": f"{name}§", "kind": "worker", "model": model})


def _verdict(event, node, by="researcher", reason="because", n=1) -> dict:
    return _story(event, node, by, decision_node_id=f"decision:{n}§", reason=reason)


_START = [
    _proposed("witness:w1"), _proposed("witness:w2"), _proposed("passage:p1", "witness:w1"), _proposed("passage:p2", "witness:w2"), _proposed("claim:c"), _story("attest", "passage:p1"),
    _story("attest", "passage:p2"), _edge("attests", "passage:p1", "claim:c", "edge:a1"), _edge("attests", "passage:p2", "claim:c", "edge:a2"),
]
_TWIN = _edge("parallel_of", "witness:w1", "witness:w2")
_KIN = [_agent("agent:a", "Fam/x"), _agent("agent:k", "fam/y")]
#: What follows the same start, and the rule that its last event breaks (null: none).
STORIES = [
    ([_story("attest", "claim:c")], None), ([_story("attest", "claim:c", "agent:a§")], "SelfAttestation"),
    ([*_KIN, _story("attest", "claim:c", "agent:k§")], "ReviewerNotIndependent"), ([*_KIN, _agent("agent:a", "other/x"), _story("attest", "claim:c", "agent:k§")], None),
    ([_story("attest", "claim:c"), _story("attest", "claim:c", "agent:d§")], "RungSkipped"), ([_story("attest", "nothing:x")], "NodeNotFound"),
    ([_proposed("claim:d"), _story("attest", "claim:d")], "UnattestableClaim"), ([_proposed("claim:d"), _edge("attests", "passage:p1", "claim:d"), _story("attest", "claim:d")], None),
    ([_proposed("conjecture:d"), _story("attest", "conjecture:d")], "UnattestableConjecture"),
    ([_proposed("conjecture:d"), _proposed("query:q"), _edge("tests", "query:q", "conjecture:d"), _story("attest", "conjecture:d")], None),
    ([_proposed("passage:d")], "EdgeEndpointMissing"), ([_proposed("passage:d", "witness:none")], "EdgeEndpointMissing"),
    ([_edge("attests", "passage:p1", "passage:p1")], "EdgeSelfLoop"), ([_edge("attests", "passage:p1", "claim:none")], "EdgeEndpointMissing"), ([_edge("attests", "passage:none", "claim:c")], "EdgeEndpointMissing"),
    ([_edge("attests", "witness:w1", "claim:c")], "EdgeDomainViolation"), ([_TWIN], None), ([_TWIN, {**_TWIN, "detail": {**_TWIN["detail"], "converge": True}}], None), ([_TWIN, _TWIN], "MalformedEvent"),
    ([_TWIN, _shift("retract_edge"), _edge("parallel_of", "witness:w2", "witness:w1", "edge:y")], "PersistentRetraction"), ([_TWIN, _shift("retract_edge"), _shift("restore_edge")], None),
    ([_shift("retract_edge", "edge:none")], "EdgeNotFound"), ([_TWIN, _shift("restore_edge")], "EdgeAlreadyRetracted"), ([_TWIN, _shift("retract_edge"), _shift("retract_edge")], "EdgeAlreadyRetracted"),
    ([_TWIN, _shift("retract_edge", by="agent:b§")], "NotResearcher"), ([_TWIN, _shift("retract_edge", reason=" ")], "MissingRejectionReason"),
    ([_story("ask", "question:q", payload={"text": "?"})], "NotResearcher"), ([_story("ask", "question:q", "researcher", payload={"text": "?"})], None),
    ([_story("attest")], "MalformedEvent"), ([_edge("contradicts", "claim:c", "passage:p1")], "ValidationError"), ([_edge("contradicts", "claim:c", "passage:p1", reason="so")], None),
    ([_verdict("accept", "claim:c")], "RungSkipped"), ([_story("attest", "claim:c"), _verdict("accept", "claim:c")], None), ([_verdict("reject", "claim:c", reason=" ")], "MissingRejectionReason"),
    ([_verdict("reject", "witness:w1"), _proposed("witness:w1")], "PersistentRejection"), ([_verdict("reject", "witness:w1"), _verdict("reopen", "witness:w1", n=2), _proposed("witness:w1")], None),
]
STORIES_SQL = "stories AS (SELECT * FROM (VALUES {}) v(story, place, rule))".format(", ".join(
    f"({i}, {len(_START) + len(more) - 1}, '{rule}')" for i, (more, rule) in enumerate(STORIES) if rule))


def story_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part tells one of the stories, by its number; sequence numbers are part * 32 + place."""
    rows = [(i, place, e["event"], e["authored_by"], e["node_id"], e["node_type"], e["edge_id"], e["edge_type"], json.dumps(e["detail"], ensure_ascii=False)) for i, (more, _) in enumerate(STORIES) for place, e in enumerate([*_START, *more])]
    told = spark.createDataFrame(rows, "story INT, place INT, event STRING, authored_by STRING, node_id STRING, node_type STRING, edge_id STRING, edge_type STRING, detail STRING")
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(STORIES)).cast("int").alias("story"))
    own = lambda c: F.replace(F.col(c), F.lit("§"), F.concat(F.lit("~"), F.col("p_partkey").cast("string")))
    named = {c: own(c) for c in ("authored_by", "node_id", "edge_id", "detail")}
    return _event_frame(part.join(told, "story"), seq=F.col("p_partkey") * 32 + F.col("place"), event=F.col("event"), at=_s("concat('t', p_partkey)"), node_type=F.col("node_type"), edge_type=F.col("edge_type"), **named)


# --- labelled documents as claims, each with three proposed attests -----------------------------------------------
ADMISSION_SQL = """
ask AS (SELECT doc_id AS d, k, CASE WHEN (toxic + quality + k) % 2 = 0 THEN 'agent:a' ELSE 'agent:b' || k END AS who FROM labels, (SELECT unnest([0, 1, 2]) AS k))
"""


def claim_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A log in which every labelled document is a claim with one attested passage, proposed by agent:a;
    and three attests a claim as proposals, in which the claim's own author turns up by label."""
    docs = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "d")
    node = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("d").cast("string"))
    none = F.lit(None).cast("string")
    payload = F.struct(F.concat(F.lit("r"), F.col("d").cast("string")).alias("canonical_ref"))
    detail = lambda **f: F.to_json(F.struct(*[c.alias(n) for n, c in f.items()]))
    step = lambda event, by, id=none, kind=None, edge=none, edge_type=None, d=F.lit("{}"): F.struct(
        F.lit(event).alias("event"), F.lit(by).alias("by"), id.alias("id"), F.lit(kind).cast("string").alias("kind"), edge.alias("edge"), F.lit(edge_type).cast("string").alias("edge_type"), d.alias("detail"))
    steps = F.array(
        step("propose", "agent:a", node("witness"), "witness", d=detail(payload=payload, converge=F.lit(False))),
        step("propose", "agent:a", node("passage"), "passage", node("edge:p"), "part_of", detail(payload=payload, converge=F.lit(False), witness_id=node("witness"))),
        step("propose", "agent:a", node("claim"), "claim", d=detail(payload=payload, converge=F.lit(False))),
        step("attest", "agent:b9", node("passage"), "passage"),
        step("add_edge", "agent:a", edge=node("edge:s"), edge_type="attests", d=detail(src=node("passage"), dst=node("claim"), converge=F.lit(False))),
    )
    rows = docs.select("d", F.posexplode(steps).alias("i", "e")).select("d", "i", "e.*")
    log = _event_frame(
        rows, seq=F.col("d") * 10 + F.col("i"), event=F.col("event"), authored_by=F.col("by"), at=_s("concat('t', d)"), node_id=F.col("id"),
        node_type=F.col("kind"), edge_id=F.col("edge"), edge_type=F.col("edge_type"), detail=F.col("detail"),
    )
    ask = docs.select("d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "toxic", "quality")
    who = _s("CASE WHEN (toxic + quality + k) % 2 = 0 THEN 'agent:a' ELSE concat('agent:b', k) END")
    batch = _event_frame(
        ask, seq=F.lit(1_000_000_000_000) + F.col("d") * 10 + F.col("k"), event=F.lit("attest"), authored_by=who, at=_s("concat('t', d)"), node_id=node("claim"), detail=F.lit("{}"),
    )
    return log, batch


# --- events as a log of runs ----------------------------------------------------------------------------
RULES = ("RungSkipped", "UnattestableClaim", "NodeNotFound", "SelfAttestation", "EdgeSelfLoop", "NoEventLog", "SomethingNew")
_RULE_SQL = "list_extract(['" + "','".join(RULES) + f"'], CAST(k % {len(RULES)} AS INTEGER) + 1)"
RUNS_SQL = f"""
raw AS (SELECT event_id AS seq, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
runs AS (
  SELECT seq, user_id, k, value,
    CASE WHEN event_type = 'signup' THEN 'run_started' WHEN event_type = 'click' THEN 'model_call'
      WHEN event_type = 'view' AND k < 90 THEN 'tool_action' WHEN event_type = 'view' THEN 'analysis'
      WHEN event_type = 'purchase' AND k < 80 THEN 'tool_result' WHEN event_type = 'purchase' THEN 'run_finished' ELSE 'refused' END AS event,
    'run:' || (user_id // 5) AS run_id, 'agent:' || user_id AS author, 'at' || seq AS at,
    CASE WHEN seq % 7 = 0 THEN NULL ELSE value / 1000 END AS cost_usd,
    {_RULE_SQL} AS rule, 'write' || (k % 4) AS attempted
  FROM raw)
"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return run_log_of(ev)


def run_log_of(ev: DataFrame) -> DataFrame:
    event = _s("""CASE WHEN event_type = 'signup' THEN 'run_started' WHEN event_type = 'click' THEN 'model_call'
      WHEN event_type = 'view' AND k < 90 THEN 'tool_action' WHEN event_type = 'view' THEN 'analysis'
      WHEN event_type = 'purchase' AND k < 80 THEN 'tool_result' WHEN event_type = 'purchase' THEN 'run_finished' ELSE 'refused' END""")
    ev = ev.withColumn("event", event)
    agent = lambda who, role, fam: F.struct(_s(who).alias("agent_id"), F.lit(role).alias("role"), _s(fam).alias("model"))
    rule = F.get(F.array(*[F.lit(r) for r in RULES]), F.col("k") % len(RULES))
    tool = _s("CASE k % 4 WHEN 0 THEN 'semantic_neighbors' WHEN 1 THEN 'align_passages' WHEN 2 THEN 'attribution_evidence' ELSE 'find_attestations' END")
    args = F.struct(_s("concat('u', user_id)").alias("uid"), _s("concat('u', user_id)").alias("uid_a"), _s("concat('u', k)").alias("uid_b"))
    result = F.struct(
        _s("array(struct(array(struct(concat('u', k) AS uid), struct(concat('u', k + 1) AS uid)) AS neighbors))").alias("shown"),
        _s("array(concat('witness:u', k))").alias("witnesses"), F.col("k").alias("longest_shared_run"), F.lit("dropped").alias("excerpt"),
    )
    is_ = lambda e: F.col("event") == e
    detail = (
        F.when(is_("run_started"), F.to_json(F.struct(
            F.array(agent("concat('agent:', user_id)", "worker", "concat('Fam', k % 4, '/m')"), agent("concat('agent:', user_id + 1)", "reviewer", "concat('fam', k % 3, '/n')")).alias("agents"),
            _s("k / 10").alias("budget_usd"), _s("concat('question:', k)").alias("question_id"))))
        .when(is_("run_finished"), F.to_json(F.struct(_s("CASE WHEN k % 2 = 0 THEN 'finished' ELSE 'stopped' END").alias("state"), _s("k / 20").alias("spent_usd"), F.col("k").alias("calls"))))
        .when(is_("refused"), F.to_json(F.struct(_s("concat('write', k % 4)").alias("attempted"), rule.alias("rule"), _s("concat('m', k)").alias("message"))))
        .when(is_("tool_action"), F.to_json(F.struct(tool.alias("tool"), _s("concat('because ', k)").alias("reason"), args.alias("args"))))
        .when(is_("tool_result"), F.to_json(F.struct(_s("seq - 1 - k % 5").alias("action_seq"), _s("k % 9 = 0").alias("is_error"), result.alias("result"))))
        .when(is_("analysis"), F.to_json(F.struct(_s("concat('reading ', seq)").alias("text"))))
        .otherwise(F.lit("{}"))
    )
    call = is_("model_call")
    return _event_frame(
        ev, seq=F.col("seq"), event=F.col("event"), authored_by=_s("concat('agent:', user_id)"), at=_s("concat('at', seq)"),
        run_id=_s("concat('run:', user_id div 5)"), detail=detail, node_id=F.when(is_("refused") & (F.col("k") % 6 != 0), _s("concat('claim:', k % 10)")),
        model=F.when(call, _s("concat('fam', k % 4, '/m')")), latency_ms=F.when(call, F.col("k") * 10), input_tokens=F.when(call, F.col("k")),
        output_tokens=F.when(call & (F.col("k") % 3 != 0), F.col("k") * 2), cost_usd=F.when(call & (F.col("seq") % 7 != 0), F.col("value") / 1000),
        model_call_id=F.when(is_("tool_action"), F.col("seq") - 1),
    )


# --- events as a log of refusals -------------------------------------------------------------------------
RULE_OF = {"click": "RungSkipped", "view": "UnattestableClaim", "signup": "NodeNotFound", "purchase": "SelfAttestation", "error": "SomethingNew"}
_RULE_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in RULE_OF.items()) + " END"
_CATEGORY_CASE = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{schemas.RULE_CATEGORY[r]}'" for r in dict.fromkeys([*RULE_OF.values(), *RULES]) if r in schemas.RULE_CATEGORY) + " ELSE 'unclassified' END"
REFUSED_SQL = f"""
raw AS (SELECT event_id AS seq, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ref0 AS (
  SELECT seq, 'u' || user_id AS author, {_RULE_CASE} AS rule, 'write' || (k % 4) AS attempted,
    CASE WHEN k % 6 = 0 THEN NULL ELSE 'n' || (k % 10) END AS node_id FROM raw),
ref AS (SELECT *, {_CATEGORY_CASE} AS category FROM ref0)
"""


def refused_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    return refused_log_of(ev)


def refused_log_of(ev: DataFrame) -> DataFrame:
    detail = F.to_json(F.struct(_s("concat('write', k % 4)").alias("attempted"), _s(_RULE_CASE).alias("rule")))
    return _event_frame(
        ev, seq=F.col("seq"), event=F.lit("refused"), authored_by=_s("concat('u', user_id)"), at=_s("concat('at', seq)"), detail=detail,
        node_id=_s("CASE WHEN k % 6 = 0 THEN NULL ELSE concat('n', k % 10) END"), run_id=_s("concat('run:', user_id div 25)"),
    )


# --- order lines as an evidence graph ---------------------------------------------------------------------
# supplier = witness, order line = passage, part = claim or conjecture, 40 parts = one question;
# neighbouring suppliers of one nation group are parallels, every third supplier descends from the tenth next
GRAPH_SQL = """
line AS (
  SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, min(l_returnflag) AS flag, min(l_linestatus) AS stat, min(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem GROUP BY 1, 2, 3, 4),
psg AS (SELECT *, 'passage:L' || o || '.' || l || '.' || p || '.' || s AS id, 10000000000 + o * 8 + l AS cseq FROM line),
wit AS (SELECT 'witness:S' || s_suppkey AS id, s_suppkey AS s, s_nationkey AS nk, CASE WHEN s_suppkey % 5 < 4 THEN 'accepted' ELSE 'proposed' END AS status FROM supplier),
hyp AS (
  SELECT CASE WHEN p_partkey % 3 < 2 THEN 'claim' ELSE 'conjecture' END AS type,
    CASE WHEN p_partkey % 3 < 2 THEN 'claim' ELSE 'conjecture' END || ':P' || p_partkey AS id, p_partkey AS p, p_size, p_name,
    list_extract(['proposed', 'attested', 'accepted', 'rejected'], CAST(p_partkey % 4 AS INTEGER) + 1) AS status, 5000000000 + p_partkey AS cseq FROM part),
att AS (SELECT psg.id AS passage, psg.s, psg.q, psg.flag, hyp.id AS node, psg.cseq FROM psg JOIN hyp USING (p)),
par AS (
  SELECT a.id AS a, b.id AS b, a.s AS s, 'parallel_of' AS type FROM wit a JOIN wit b ON b.s = a.s + 1 AND a.nk % 5 = b.nk % 5
  UNION ALL SELECT a.id, b.id, a.s, 'descends_from' FROM wit a JOIN wit b ON b.s = a.s + 10 WHERE a.s % 3 = 0),
live_att AS (SELECT * FROM att WHERE q % 7 <> 0),
subj AS (
  SELECT DISTINCT node, passage AS subject, 'passage' AS kind FROM live_att
  UNION SELECT DISTINCT node, 'witness:S' || s, 'witness' FROM live_att WHERE q % 10 <> 0),
links AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM par WHERE s % 6 <> 0),
flips AS (SELECT x.node, count(*) AS n FROM links JOIN subj x ON x.subject = links.a JOIN subj y ON y.subject = links.b AND y.node = x.node GROUP BY 1),
sup AS (
  SELECT hyp.id, hyp.type, coalesce(c.passages, 0) AS attesting_count, coalesce(c.witnesses, 0) AS distinct_witnesses, coalesce(flips.n, 0) AS non_independent_pairs
  FROM hyp LEFT JOIN (SELECT node, count(*) FILTER (kind = 'passage') AS passages, count(*) FILTER (kind = 'witness') AS witnesses FROM subj GROUP BY 1) c ON c.node = hyp.id
  LEFT JOIN flips ON flips.node = hyp.id)
"""


def _lines(spark, sf_dir, by_order: bool = False) -> DataFrame:
    """Order lines, once each; by_order: dealt by order, so that what is grouped by order next needs no shuffle of its own."""
    li = table(spark, sf_dir, "lineitem")
    if by_order:
        li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").repartition("l_orderkey")
    return li.groupBy(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")
    ).agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("stat"), F.min(F.col("l_quantity").cast("bigint")).alias("q"))


_HYP = "CASE WHEN p_partkey % 3 < 2 THEN 'claim' ELSE 'conjecture' END"
_PID = "concat('passage:L', o, '.', l, '.', p, '.', s)"
_HID = "concat(CASE WHEN p % 3 < 2 THEN 'claim' ELSE 'conjecture' END, ':P', p)"


def _node_frame(df: DataFrame, id: str, type: str, status: str, payload, seq: str) -> DataFrame:
    out = df.select(_s(id).alias("id"), _s(type).alias("type"), _s(status).alias("status"), payload.alias("payload"), _s(seq).cast("bigint").alias("created_seq"))
    reason = F.when((F.col("status") == "rejected") & (F.col("created_seq") % 2 == 0), F.lit("not supported"))
    return out.select(
        "id", "type", "status", "payload", tx.sha256("payload").alias("payload_hash"), reason.alias("rejected_reason"), "created_seq",
        F.col("created_seq").alias("updated_seq"),
    )


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges over one written table of order lines: for plans that read both several times, in which the
    lines would be grouped anew for each kind of node and edge."""
    line = cut_lineage(_lines(spark, sf_dir))
    return graph_nodes(spark, sf_dir, line), graph_edges(spark, sf_dir, line)


def graph_nodes(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    sup, part, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), _lines(spark, sf_dir) if line is None else line
    j = lambda **kw: F.to_json(F.struct(*[_s(v).alias(k) for k, v in kw.items()]))
    wit = _node_frame(
        sup, "concat('witness:S', s_suppkey)", "'witness'", "CASE WHEN s_suppkey % 5 < 4 THEN 'accepted' ELSE 'proposed' END",
        j(canonical_ref="concat('S', s_suppkey)", label="s_name", dating="CASE WHEN s_suppkey % 8 = 0 THEN named_struct('confidence', 'unknown', 'basis', 'no route') ELSE named_struct('confidence', 'unknown', 'basis', 'no route was run') END"), "s_suppkey")
    psg = _node_frame(
        line, _PID, "'passage'", "CASE flag WHEN 'A' THEN 'attested' WHEN 'R' THEN 'accepted' ELSE 'proposed' END",
        j(canonical_ref=f"concat('S', s, '#', {_PID})", locator="CASE WHEN q % 13 = 0 THEN '' ELSE concat('line ', l) END", excerpt="concat('x', q)", source_ref="concat('doc', o)"),
        "10000000000 + o * 8 + l")
    fields = {f: f"CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 0 THEN concat('{f} ', p_size) END" for f in schemas.DOSSIER_FIELDS}
    hyp = _node_frame(
        part, f"concat({_HYP}, ':P', p_partkey)", _HYP, "element_at(array('proposed', 'attested', 'accepted', 'rejected'), cast(p_partkey % 4 AS int) + 1)",
        j(text="p_name", **fields), "5000000000 + p_partkey")
    que = _node_frame(
        part.filter("p_partkey % 40 = 0"), "concat('question:Q', p_partkey div 40)", "'question'", "'accepted'",
        j(text="concat('which of ', p_brand)", answerable_by="p_type"), "4000000000 + p_partkey")
    tests = _node_frame(
        part.filter("p_partkey % 3 = 2 AND p_size % 3 <> 0"), "concat('query:P', p_partkey)", "'query'", "'proposed'",
        j(text="p_name", expectation="'at_most'", expected_hits="p_size"), "6000000000 + p_partkey")
    span = _node_frame(
        line, "concat('verification:V', substring(" + _PID + ", 9))", "'verification'", "'accepted'",
        j(method="'exact_span'", result="CASE stat WHEN 'O' THEN 'pass' ELSE 'fail' END", assurance_level="CASE stat WHEN 'O' THEN 'A2_EXACT_SPAN_MATCHED' ELSE 'A0_UNCHECKED' END",
          detail="'checked'", span_start="q", span_end="q + l - 1"), "20000000000 + o * 8 + l")
    rev = _node_frame(
        line.filter("l = 1"), "concat('verification:R', substring(" + _PID + ", 9))", "'verification'", "'accepted'",
        j(method="'exact_span'", result="CASE flag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE CASE stat WHEN 'O' THEN 'pass' ELSE 'indeterminate' END END",
          assurance_level="'A2_EXACT_SPAN_MATCHED'", detail="'re-fetched'", limitations="concat('reviewer verdict ', element_at(array('sound', 'unsound', 'indeterminate'), cast(q % 3 AS int) + 1), ': read ', q)"),
        "30000000000 + o * 8 + l")
    pros = _node_frame(
        line.filter("l = 2 AND p % 3 = 2"), "concat('verification:T', substring(" + _PID + ", 9))", "'verification'", "'accepted'",
        j(method="'prospective_test'", result="CASE stat WHEN 'O' THEN 'pass' ELSE 'fail' END", assurance_level="'A0_UNCHECKED'", detail="'ran'"), "40000000000 + o * 8 + l")
    out = wit
    for part_ in (psg, hyp, que, tests, span, rev, pros):
        out = out.unionByName(part_)
    return out


def graph_edges(spark: SparkSession, sf_dir: str, line: DataFrame | None = None) -> DataFrame:
    from vidimus.operators.projection import with_twins

    sup, part, line = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part"), _lines(spark, sf_dir) if line is None else line

    def rows(df, id, type, src, dst, seq, gone="false"):
        return df.select(
            _s(id).alias("id"), F.lit(type).alias("type"), _s(src).alias("src"), _s(dst).alias("dst"), _s(seq).cast("bigint").alias("created_seq"),
            F.lit(None).cast("string").alias("reason"), F.when(_s(gone), F.lit("later")).alias("retracted_at"), F.when(_s(gone), F.lit("withdrawn")).alias("retracted_reason"),
        )

    at, tail = "10000000000 + o * 8 + l", f"substring({_PID}, 9)"
    a = sup.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nk"))
    nxt = a.join(a.select(F.col("s").alias("s2"), F.col("nk").alias("nk2")), _s("s2 = s + 1")).filter("nk % 5 = nk2 % 5")
    ten = a.join(a.select(F.col("s").alias("s2")), _s("s2 = s + 10")).filter("s % 3 = 0")
    hid, other = _HID, "concat(CASE WHEN (p + 1) % 3 < 2 THEN 'claim' ELSE 'conjecture' END, ':P', p + 1)"
    hyp = part.select(F.col("p_partkey").alias("p"), "p_size")
    pairs = hyp.filter("p % 9 = 0").join(hyp.select(F.col("p").alias("p2")), _s("p2 = p + 1"))
    parts = [
        rows(line, f"concat('edge:po', {tail})", "part_of", _PID, "concat('witness:S', s)", at, "q % 10 = 0"),
        rows(line, f"concat('edge:at', {tail})", "attests", _PID, hid, at, "q % 7 = 0"),
        rows(line, f"concat('edge:vs', {tail})", "verifies", f"concat('verification:V', {tail})", _PID, "20000000000 + o * 8 + l"),
        rows(line.filter("l = 1"), f"concat('edge:vr', {tail})", "verifies", f"concat('verification:R', {tail})", hid, "30000000000 + o * 8 + l"),
        rows(line.filter("l = 2 AND p % 3 = 2"), f"concat('edge:vt', {tail})", "verifies", f"concat('verification:T', {tail})", hid, "40000000000 + o * 8 + l"),
        rows(nxt, "concat('edge:pl', s)", "parallel_of", "concat('witness:S', s)", "concat('witness:S', s2)", "s", "s % 6 = 0"),
        rows(ten, "concat('edge:ds', s)", "descends_from", "concat('witness:S', s)", "concat('witness:S', s2)", "s", "s % 6 = 0"),
        rows(hyp.filter("p % 3 = 2 AND p_size % 3 <> 0"), "concat('edge:ts', p)", "tests", "concat('query:P', p)", hid, "6000000000 + p"),
        rows(hyp, "concat('edge:ad', p)", "addresses", hid, "concat('question:Q', p div 40)", "5000000000 + p", "p % 11 = 0"),
        rows(pairs, "concat('edge:ct', p)", "contradicts", hid, other, "5000000000 + p", "p % 2 = 0"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_twins(out)


def graph_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorship of hypotheses: proposed by one of five agents, attested by one of three."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    acts = F.array_compact(F.array(
        F.struct(_s("concat('agent:', p % 5)").alias("author"), F.lit("proposed").alias("action"), _s("5000000000 + p").alias("seq")),
        F.when(_s("p % 4 IN (1, 2)"), F.struct(_s("concat('agent:', p % 3)").alias("author"), F.lit("attested").alias("action"), _s("5500000000 + p").alias("seq"))),
        F.when(_s("p % 4 = 2"), F.struct(F.lit("researcher").alias("author"), F.lit("accepted").alias("action"), _s("5600000000 + p").alias("seq"))),
        F.when(_s("p % 4 = 3"), F.struct(F.lit("researcher").alias("author"), F.lit("rejected").alias("action"), _s("5600000000 + p").alias("seq"))),
    ))
    return part.select(_s(_HID).alias("node_id"), F.explode(acts).alias("a")).select("node_id", "a.author", "a.action", _s("concat('at', a.seq)").alias("at"), "a.seq")


def graph_edge_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(spark, sf_dir).select(
        F.col("id").alias("edge_id"), _s("concat('agent:', created_seq % 5)").alias("author"), F.lit("proposed").alias("action"),
        _s("concat('at', created_seq)").alias("at"), F.col("created_seq").alias("seq"),
    )


def graph_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents that appear as authors, agent 4 without a model."""
    who = table(spark, sf_dir, "part").groupBy(_s("p_partkey % 5").alias("i")).agg(F.min("p_partkey").alias("m"))
    return who.select(
        _s("concat('agent:', i)").alias("id"), F.lit("worker").alias("kind"), _s("concat('scope ', i)").alias("corpus_scope"), F.lit(None).cast("string").alias("method_label"),
        F.when(_s("i <> 4"), _s("concat(CASE WHEN i % 2 = 0 THEN 'Fam' ELSE 'fam' END, i % 2, '/m', i)")).alias("model"), F.col("m").alias("created_seq"),
    )


# --- texts ---------------------------------------------------------------------------------------------------
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalogued units: class = language where a label row exists, work = source."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_l", F.lit(True))
    return docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("uid"), F.when(F.col("_l"), F.col("lang")).alias("label"), F.col("source").alias("work"), "text"
    )


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as spans."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("span_no", "span"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every benchmark text as a phrase."""
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "q"))
    return parts.select((F.col("item_id") * 1000 + F.col("i") + 1).alias("query_id"), F.trim("q").alias("query"))


PHRASES_SQL = "qs AS (SELECT item_id * 1000 + i AS query_id, trim(q) AS query FROM (SELECT item_id, unnest(string_split(text, '. ')) AS q, generate_subscripts(string_split(text, '. '), 1) AS i FROM benchmark))"


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the least document that has a whole line in common with it, anywhere in the
    text: stars around each line, never all pairs of a group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") >= COPIED_LINE)
    first = docs.groupBy("line").agg(F.min("doc_id").alias("uid_a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return docs.join(first, "line").filter("doc_id <> uid_a").select("uid_a", F.col("doc_id").alias("uid_b")).distinct()


COPIED_LINE = 40
COPIES_SQL = f"""cl AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
ch AS (SELECT line, min(doc_id) AS uid_a FROM cl WHERE length(line) >= {COPIED_LINE} GROUP BY line HAVING count(*) > 1),
cp AS (SELECT DISTINCT uid_a, doc_id AS uid_b FROM cl JOIN ch USING (line) WHERE doc_id <> uid_a)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows: ten vectors make a unit, the label is the work, offsets step by 40."""
    from vidimus.sources.catalogue import read_windows

    return read_windows(
        spark, f"{sf_dir}/embeddings.parquet",
        {"idx": "vec_id", "uid": "concat('u', vec_id div 10)", "label": "concat('L', label)", "start": "cast(vec_id % 10 * 40 AS int)", "vec": "embedding"},
        work="label",
    )


# --- order lines as marked-up documents ---------------------------------------------------------------------------
def reference_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order whose number element lists its parts: accepted lines asserted, all others
    compared, an odd text in every 17th order, containment in every tenth."""
    li = _lines(spark, sf_dir, by_order=True)
    tok = _s("CASE WHEN l = 3 THEN concat(p, '-', p + 2) WHEN stat = 'O' THEN concat(p, '(', l, ')') ELSE cast(p AS string) END")
    per = li.select("o", "flag", F.struct("l", "p", "s", tok.alias("tok")).alias("t")).groupBy("o").agg(
        F.array_sort(F.collect_list(F.when(F.col("flag") == "A", F.col("t")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("flag") != "A", F.col("t")))).alias("r")
    )
    text = lambda c: F.array_join(F.transform(c, lambda t: t["tok"]), ", ")
    head = F.when(F.size("a") > 0, F.concat(F.when(_s("o % 10 = 0"), F.lit("Part of Nos. ")).otherwise(F.lit("Nos. ")), text("a")))
    tail = F.when(F.size("r") > 0, F.concat(F.lit("cf. No. "), text("r")))
    odd = F.when(_s("o % 17 = 0"), F.lit("~M. 5 sutta"))
    inside = F.array_join(F.array_compact(F.array(head, tail, odd)), "; ")
    return per.select(
        F.col("o").cast("string").alias("doc"),
        F.concat(F.lit("<lb n=\"1\"/><cb:docNumber>No. "), F.col("o").cast("string"), F.lit(" <pb/>["), inside, F.lit("]</cb:docNumber><p>text</p>")).alias("body"),
    )


REFS_SQL = """
rl AS (SELECT o, l, p, s, flag, stat FROM line),
rx AS (
  SELECT o, CASE WHEN flag <> 'A' THEN 'compare_only' WHEN o % 10 = 0 THEN 'part_of' ELSE 'asserted' END AS bucket, l, p, s,
    unnest(CASE WHEN l = 3 THEN [0, 1, 2] ELSE [0] END) AS i, CASE WHEN l <> 3 AND stat = 'O' THEN CAST(l AS VARCHAR) END AS sub_ref
  FROM rl WHERE o % 17 <> 0),
refs AS (SELECT CAST(o AS VARCHAR) AS doc, bucket, CAST(p + i AS VARCHAR) AS number, sub_ref, min((l, p, s, i)) AS place FROM rx GROUP BY 1, 2, 3, 4)
"""


def catalogue_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an archive listing: every other part has lettered siblings, some numbers span two volumes."""
    part = table(spark, sf_dir, "part")
    name = lambda vol, letter: _s(f"concat('X/T/T', lpad(cast({vol} AS string), 3, '0'), 'n', lpad(cast(p_partkey AS string), 9, '0'), '{letter}', '_001.xml')")
    every = F.array_compact(F.array(
        F.when(_s("p_partkey % 2 = 0"), name("p_size", "")), F.when(_s("p_partkey % 2 = 1"), name("p_size", "a")),
        F.when(_s("p_partkey % 6 = 1"), name("p_size", "b")), F.when(_s("p_partkey % 10 = 0"), name("p_size + 50", "")),
    ))
    return part.select(F.explode(every).alias("entry_path"))


CATALOGUE_SQL = """
cat AS (
  SELECT CAST(p_partkey AS VARCHAR) || letter AS number, 'T' || lpad(CAST(vol AS VARCHAR), 3, '0') || 'n' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || letter AS ref
  FROM (
    SELECT p_partkey, p_size AS vol, '' AS letter FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, p_size, 'a' FROM part WHERE p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, p_size, 'b' FROM part WHERE p_partkey % 6 = 1
    UNION ALL SELECT p_partkey, p_size + 50, '' FROM part WHERE p_partkey % 10 = 0)),
want AS (SELECT DISTINCT number, lower(number) AS k FROM refs WHERE bucket = 'asserted'),
ex AS (SELECT want.number, cat.ref FROM want JOIN cat ON cat.number = want.k),
sib AS (
  SELECT want.number, cat.ref FROM want JOIN cat ON regexp_replace(cat.number, '[a-z]+$', '') = regexp_replace(want.k, '[a-z]+$', '')
  WHERE want.k NOT IN (SELECT number FROM cat)),
res AS (
  SELECT want.number, coalesce(c.n, 0) AS n, coalesce(c.refs, '') AS refs FROM want
  LEFT JOIN (SELECT number, count(DISTINCT ref) AS n, string_agg(DISTINCT ref, ' ' ORDER BY ref) AS refs FROM (SELECT * FROM ex UNION SELECT * FROM sib) GROUP BY 1) c USING (number))
"""


def apparatus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order with an apparatus entry per line."""
    li = _lines(spark, sf_dir, by_order=True)
    lem = _s("CASE flag WHEN 'A' THEN '<lem wit=\"【大】\">a' WHEN 'R' THEN '<lem resp=\"CBETA.x\" wit=\"【CB】\">b' ELSE '<lem wit=\"W1 W2\">c' END")
    rdg = _s("CASE stat WHEN 'O' THEN '<rdg wit=\"【宋】 【元】 【明】\">d<g/> e' ELSE '<rdg resp=\"Taisho\">f' END")
    one = F.concat(F.lit("<app n=\""), F.concat_ws(".", "l", "p", "s"), F.lit("\">"), lem, F.lit("</lem>"), rdg, F.lit("</rdg></app>"))
    per = li.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("l", "p", "s", one.alias("x")))).alias("apps"))
    return per.select(F.col("o").cast("string").alias("doc"), F.concat(F.lit("<p>"), F.array_join(F.transform("apps", lambda a: a["x"]), "<lb/>"), F.lit("</p>")).alias("body"))
