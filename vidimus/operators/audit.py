"""Which events of a log break the rules of the graph, each judged as of its own place.

State "as of" an event comes from three kinds of plan, all linear in the log:

* existence: nodes and edges are never deleted, so "existed before" is `created_seq < seq`, an equi-join;
* current value: the last status or withdrawal before the event, a chunked carry over the key's timeline;
* "is there one": how many supporters (or same-family authors) stand, a chunked running sum of +1 and -1.

No key's history is enumerated against itself. Every logged event counts as applied.

The judgement joins dozens of tables that all grow with the log, so they meet by shuffles whatever their
size: as broadcasts, each below the threshold, they would all pass through the driver.
"""
from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions import text as tx
from vidimus.functions.components import components
from vidimus.functions.frames import SPAN, by_shuffle, carry_forward, cut_lineage, running_total
from vidimus.operators.census import rule_category
from vidimus.operators.projection import STATUS_OF, _detail, _map_event, base_edge, edge_changes, node_changes, with_twins

LADDER = tuple(STATUS_OF)
STANDING = ("attested", "accepted")


def _blank(c: Column) -> Column:
    return tx.strip_space(F.coalesce(c, F.lit(""))) == ""


def _violation(df: DataFrame, rank: int, rule: str, message: Column) -> DataFrame:
    return df.select("seq", "event", F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), message.alias("message"))


def created_nodes(ev: DataFrame) -> DataFrame:
    made = node_changes(ev).filter("kind = 'create'")
    return made.groupBy("id").agg(F.min("seq").alias("created_seq"), F.min_by("type", "seq").alias("type"), F.min_by("status", "seq").alias("born"))


def drawn_edges(ev: DataFrame) -> DataFrame:
    """Edges in both stored directions with when they were drawn."""
    rows = edge_changes(ev).filter("kind = 'draw'").groupBy("id").agg(F.min_by(F.struct("seq", "type", "src", "dst"), "seq").alias("b"))
    return with_twins(rows.select("id", "b.type", "b.src", "b.dst", F.col("b.seq").alias("created_seq")))


def malformed(ev: DataFrame) -> DataFrame:
    """Events that lack a field their type needs."""
    need = {
        "propose": ["node_id", "node_type", "detail.payload"], "attest": ["node_id"], "accept": ["node_id", "detail.decision_node_id"],
        "reject": ["node_id", "detail.decision_node_id"], "reopen": ["node_id", "detail.decision_node_id"],
        "add_edge": ["edge_id", "edge_type", "detail.src", "detail.dst"], "retract_edge": ["edge_id"], "restore_edge": ["edge_id"],
        "verify": ["node_id", "edge_id", "edge_type", "detail.payload", "detail.subject_node_id"], "ask": ["node_id", "detail.payload"],
        "register_agent": ["detail.payload.id"],
    }
    value = lambda f: _detail(f[7:]) if f.startswith("detail.") else F.col(f)
    gap = F.lit(None).cast("string")
    for event, fields in need.items():
        for f in reversed(fields):
            gap = F.when((F.col("event") == event) & value(f).isNull(), F.lit(f)).otherwise(gap)
    bad = ev.withColumn("_gap", gap).filter("_gap IS NOT NULL")
    return _violation(bad, 0, "MalformedEvent", F.concat(F.lit("event has no "), F.col("_gap")))


def _domain_ok(kind: Column, src: Column, dst: Column) -> Column:
    ok = F.lit(False)
    for edge, domain in schemas.EDGE_DOMAINS.items():
        if domain == "any":
            rule = F.lit(True)
        elif domain == "same_type":
            rule = src == dst
        else:
            rule = functools.reduce(lambda a, b: a | b, [(src == s) & (dst == d) for s, d in domain])
        ok = F.when(kind == edge, rule).otherwise(ok)
    return ok


def _families_at(ev: DataFrame, probes: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Model family of agents as of probe rows (`agent, seq, ...`), and every change of family."""
    reg = ev.filter("event = 'register_agent'").select(
        _detail("payload.id").alias("agent"), "seq",
        F.coalesce(tx.model_family(_detail("payload.model")), F.lit("")).alias("family"),
    )
    keep = [c for c in probes.columns if c not in ("agent", "seq")]
    line = reg.withColumn("_probe", F.lit(False)).unionByName(probes.withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    seen = carry_forward(line, ["agent"], "seq", ["family"], span, shuffled=True)
    at = seen.filter("_probe").select("agent", "seq", *keep, F.coalesce("prev_family", F.lit("")).alias("family"))
    changes = seen.filter("NOT _probe").select("agent", "seq", "family", F.coalesce("prev_family", F.lit("")).alias("old")).filter("family <> old")
    return at, changes


def _kin_conflicts(ev: DataFrame, attests: DataFrame, authors: DataFrame, span: int) -> DataFrame:
    """Attest events whose author's model family an author of the node shares at that moment."""
    asked = attests.select(F.col("authored_by").alias("agent"), "seq", "node_id", F.lit("attest").alias("role"))
    # only nodes that are attested matter, and each author of a node once
    wrote = authors.join(by_shuffle(asked.select("node_id").distinct()), "node_id", "left_semi").select(
        F.col("author").alias("agent"), F.col("first_seq").alias("seq"), "node_id", F.lit("author").alias("role")
    )
    at, changes = _families_at(ev, asked.unionByName(wrote), span)
    joined = at.filter("role = 'author'").select("node_id", "family", "seq", F.lit(1).alias("d"))
    later = wrote.select("agent", "node_id", F.col("seq").alias("since")).join(by_shuffle(changes), "agent").filter("seq > since")
    moved = later.select("node_id", "seq", F.explode(F.array(
        F.struct(F.col("family"), F.lit(1).alias("d")), F.struct(F.col("old").alias("family"), F.lit(-1).alias("d"))
    )).alias("m")).select("node_id", "m.family", "seq", "m.d")
    probe = at.filter("role = 'attest'").select("node_id", "family", "seq", F.lit(0).alias("d"))
    line = joined.unionByName(moved).unionByName(probe).filter("family <> ''").groupBy("node_id", "family", "seq").agg(
        F.sum("d").alias("d")
    )
    held = running_total(line, ["node_id", "family"], "seq", "d", "held", span, shuffled=True).withColumn("held", F.col("held") - F.greatest("d", F.lit(0)))
    return held.filter("held > 0").select("node_id", "seq", "family").join(by_shuffle(probe.select("node_id", "seq", "family")), ["node_id", "seq", "family"], "left_semi")


def _judge(df: DataFrame, *rules: tuple[Column, int, str, Column]) -> DataFrame:
    """Every rule an event breaks, in one pass: rows of (condition, rank, rule, message)."""
    hits = [
        F.when(cond, F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), message.cast("string").alias("message")))
        for cond, rank, rule, message in rules
    ]
    return df.select("seq", "event", F.explode(F.array_compact(F.array(*hits))).alias("v")).select("seq", "event", "v.*")


def audit(ev: DataFrame, list_all: bool = False, span: int = SPAN) -> DataFrame:
    """Violations as `seq, event, rule, category, message`: the first rule each event breaks, or all.

    What several rules look at (nodes made, edges drawn, the node timeline) is written once and read
    back; each family of events is then judged in one pass.
    """
    made = cut_lineage(created_nodes(ev))
    drawn = cut_lineage(drawn_edges(ev))
    before = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
    text = lambda c: F.coalesce(c, F.lit(""))
    node, who = F.col("node_id"), F.col("authored_by")
    not_researcher = who != schemas.RESEARCHER
    needs = F.concat(F.col("event"), F.lit(" requires the researcher, got "), who)

    # --- one timeline per node: creation, moves, later proposals, and attests edges drawn from it ------
    ladder = ev.filter(F.col("event").isin(*LADDER) & F.col("node_id").isNotNull()).select("seq", "event", "authored_by", "node_id", _detail("reason").alias("reason"))
    proposals = ev.filter("event = 'propose' AND node_id IS NOT NULL").select("seq", "event", "authored_by", "node_id", "node_type", _detail("witness_id").alias("witness_id"))
    attest_edges = drawn.filter("type = 'attests'").groupBy("src", "dst").agg(F.min("created_seq").alias("drawn_seq"))
    none = F.lit(None).cast("string")
    once = made.select(F.col("id").alias("node_id"), "created_seq")
    timeline = (
        made.select("id", F.col("created_seq").alias("seq"), F.col("born").alias("status"), F.lit("create").alias("row"))
        .unionByName(ladder.select(F.col("node_id").alias("id"), "seq", _map_event(STATUS_OF).alias("status"), F.lit("move").alias("row")))
        .unionByName(
            proposals.filter("node_type IN ('witness', 'passage')").join(by_shuffle(once), "node_id")
            .filter("seq > created_seq").select(F.col("node_id").alias("id"), "seq", none.alias("status"), F.lit("repeat").alias("row"))
        )
        .unionByName(attest_edges.select(F.col("src").alias("id"), F.col("drawn_seq").alias("seq"), none.alias("status"), F.lit("edge").alias("row")))
    )
    states = cut_lineage(carry_forward(timeline, ["id"], "seq", ["status"], span, shuffled=True))

    # --- the ladder ---------------------------------------------------------------------------------
    moves = ladder.join(by_shuffle(states.filter("row = 'move'").select(F.col("id").alias("node_id"), "seq", "prev_status")), ["node_id", "seq"])
    moves = cut_lineage(moves.join(by_shuffle(made.select(F.col("id").alias("node_id"), "type", "created_seq")), "node_id", "left").withColumn("known", before("created_seq")))
    attests = moves.filter("event = 'attest' AND known")
    contested = attests.filter(F.col("type").isin(*schemas.REVIEWABLE_TYPES) & not_researcher)
    authors = proposals.groupBy("node_id", F.col("authored_by").alias("author")).agg(F.min("seq").alias("first_seq"))
    kin = _kin_conflicts(ev, contested, authors, span).withColumnRenamed("family", "kin")
    held = _standing_support(states, attest_edges, attests.filter("type = 'claim'"), span)
    # the first `tests` edge to a node and the first `part_of` edge from it
    here, drawn_at = F.when(F.col("type") == "tests", F.col("dst")).otherwise(F.col("src")), lambda kind: F.min(F.when(F.col("type") == kind, F.col("created_seq")))
    firsts = drawn.filter("type IN ('tests', 'part_of')").groupBy(here.alias("node_id")).agg(drawn_at("tests").alias("tests_seq"), drawn_at("part_of").alias("part_seq"))
    j = (
        moves.join(by_shuffle(firsts), "node_id", "left").join(by_shuffle(authors.withColumnRenamed("author", "authored_by")), ["node_id", "authored_by"], "left")
        .join(by_shuffle(held), ["node_id", "seq"], "left").join(by_shuffle(kin), ["node_id", "seq"], "left")
    )
    event, kind, known = F.col("event"), F.col("type"), F.col("known")
    allowed = (
        F.when(event == "attest", F.col("prev_status") == "proposed").when(event == "accept", F.col("prev_status") == "attested")
        .when(event == "reject", F.col("prev_status").isin("proposed", "attested")).otherwise(F.col("prev_status") == "rejected")
    )
    attest = known & (event == "attest")
    disputed = attest & kind.isin(*schemas.REVIEWABLE_TYPES) & not_researcher
    found = [malformed(ev), _judge(
        j,
        ((event != "attest") & not_researcher, 1, "NotResearcher", needs),
        (event.isin("reject", "reopen") & _blank(F.col("reason")), 2, "MissingRejectionReason", node),
        (~known, 3, "NodeNotFound", node),
        (known & ~allowed, 4, "RungSkipped", F.concat(node, F.lit(" is "), F.col("prev_status"))),
        (disputed & before("first_seq"), 5, "SelfAttestation", F.concat(who, F.lit(" authored "), node)),
        (disputed & F.col("kin").isNotNull(), 6, "ReviewerNotIndependent", F.concat(F.lit("model family "), F.col("kin"), F.lit(" is shared with an author of "), node)),
        (attest & (kind == "claim") & (F.coalesce("held", F.lit(0)) <= 0), 7, "UnattestableClaim", node),
        (attest & (kind == "conjecture") & ~before("tests_seq"), 7, "UnattestableConjecture", node),
        (attest & (kind == "passage") & ~before("part_seq"), 7, "PassageNotLocated", node),
    )]

    # --- proposals and questions --------------------------------------------------------------------------
    seen = states.filter("row = 'repeat'").select(F.col("id").alias("node_id"), "seq", "prev_status")
    placed = proposals.join(by_shuffle(made.select(F.col("id").alias("witness_id"), F.col("created_seq").alias("w_seq"))), "witness_id", "left").join(by_shuffle(seen), ["node_id", "seq"], "left")
    found.append(_judge(
        placed,
        ((F.col("node_type") == "passage") & ~before("w_seq"), 1, "EdgeEndpointMissing", F.concat(F.lit("witness "), text(F.col("witness_id")), F.lit(" does not exist"))),
        (F.col("prev_status") == "rejected", 2, "PersistentRejection", node),
    ))
    asked = ev.filter("event = 'ask'").select("seq", "event", "authored_by", "node_id").join(by_shuffle(once), "node_id", "left")
    found.append(_judge(
        asked, (before("created_seq"), 0, "MalformedEvent", F.concat(F.lit("node made twice: "), node)),
        (not_researcher, 1, "NotResearcher", F.concat(who, F.lit(" may not ask a research question"))),
    ))

    # --- verification -------------------------------------------------------------------------------------
    checks = ev.filter("event = 'verify'").select("seq", "event", "authored_by", "node_id", _detail("subject_node_id").alias("subject"), _detail("payload.method").alias("method"))
    checks = checks.join(by_shuffle(made.select(F.col("id").alias("subject"), F.col("type").alias("s_type"), F.col("created_seq").alias("s_seq"))), "subject", "left").join(by_shuffle(once), "node_id", "left")
    found.append(_judge(
        checks, (before("created_seq"), 0, "MalformedEvent", F.concat(F.lit("node made twice: "), node)),
        (~before("s_seq"), 1, "NodeNotFound", text(F.col("subject"))),
        (before("s_seq") & ~F.col("s_type").isin(*schemas.VERIFIABLE_TYPES), 2, "EdgeDomainViolation", F.concat(F.lit("cannot verify a "), F.col("s_type"))),
        ((F.col("method") == "human_review") & not_researcher, 3, "NotResearcher", needs),
    ))

    # --- edges ----------------------------------------------------------------------------------------------
    adds = ev.filter("event = 'add_edge'").select(
        "seq", "event", "authored_by", "edge_id", "edge_type", _detail("src").alias("src"), _detail("dst").alias("dst"),
        _detail("reason").alias("reason"), F.coalesce(_detail("converge").cast("boolean"), F.lit(False)).alias("converge"))
    by_triple = drawn.groupBy(F.col("type").alias("edge_type"), "src", "dst").agg(F.min(F.struct("created_seq", "id")).alias("e")).select(
        "edge_type", "src", "dst", F.col("e.created_seq").alias("e_seq"), base_edge(F.col("e.id")).alias("base"))
    end = lambda side: by_shuffle(made.select(F.col("id").alias(side), F.col("type").alias(f"{side}_type"), F.col("created_seq").alias(f"{side}_seq")))
    adds = adds.join(end("src"), "src", "left").join(end("dst"), "dst", "left").join(by_shuffle(by_triple), ["edge_type", "src", "dst"], "left")
    adds = cut_lineage(adds)
    shifts = ev.filter(F.col("event").isin("retract_edge", "restore_edge") & F.col("edge_id").isNotNull()).select(
        "seq", "event", "authored_by", "edge_id", _detail("reason").alias("reason"), base_edge("edge_id").alias("base"))
    mark = F.when(F.col("event") == "retract_edge", "out").otherwise("in")
    redrawn = adds.filter(before("e_seq")).select("base", "seq", none.alias("state"))
    edge_states = carry_forward(shifts.select("base", "seq", mark.alias("state")).unionByName(redrawn), ["base"], "seq", ["state"], span, shuffled=True)
    was = cut_lineage(edge_states.select("base", "seq", F.coalesce(F.col("prev_state") == "out", F.lit(False)).alias("is_out")))
    both = before("src_seq") & before("dst_seq")
    odd = ~F.col("src_type").isin(*schemas.CONTRADICTABLE_TYPES) | ~F.col("dst_type").isin(*schemas.CONTRADICTABLE_TYPES)
    against = both & (F.col("edge_type") == "contradicts")
    ends = F.concat(F.col("edge_type"), F.lit(" "), F.col("src"), F.lit(" -> "), F.col("dst"))
    gone = lambda side: F.concat(F.lit(f"{side} "), text(F.col(side)), F.lit(" does not exist"))
    found.append(_judge(
        adds.join(by_shuffle(was), ["base", "seq"], "left"),
        (against & odd, 1, "WrongNodeType", F.concat(F.col("src_type"), F.lit(" and "), F.col("dst_type"), F.lit(" cannot contradict"))),
        (against & _blank(F.col("reason")), 1, "ValidationError", F.lit("a contradiction needs a stated reason")),
        (F.col("src") == F.col("dst"), 2, "EdgeSelfLoop", F.concat(F.col("src"), F.lit(" -> "), F.col("dst"))),
        (~before("src_seq"), 3, "EdgeEndpointMissing", gone("src")), (~before("dst_seq"), 4, "EdgeEndpointMissing", gone("dst")),
        (both & ~_domain_ok(F.col("edge_type"), F.col("src_type"), F.col("dst_type")), 5, "EdgeDomainViolation", F.concat(F.col("edge_type"), F.lit(" not valid from "), F.col("src_type"), F.lit(" to "), F.col("dst_type"))),
        (both & before("e_seq") & F.col("is_out"), 6, "PersistentRetraction", F.concat(ends, F.lit(" was retracted"))),
        (both & before("e_seq") & ~F.col("is_out") & ~F.col("converge"), 7, "MalformedEvent", F.concat(F.lit("edge drawn again without converging: "), ends)),
    ))
    rows = drawn.select(F.col("id").alias("edge_id"), F.col("created_seq").alias("row_seq"))
    sh = shifts.join(by_shuffle(rows), "edge_id", "left").join(by_shuffle(was), ["base", "seq"])
    wrong = F.when(F.col("event") == "retract_edge", F.col("is_out")).otherwise(~F.col("is_out"))
    found.append(_judge(
        sh, (not_researcher, 1, "NotResearcher", needs), (_blank(F.col("reason")), 2, "MissingRejectionReason", F.col("edge_id")),
        (~before("row_seq"), 3, "EdgeNotFound", F.col("edge_id")),
        (before("row_seq") & wrong, 4, "EdgeAlreadyRetracted", F.concat(F.col("edge_id"), F.when(F.col("is_out"), " is already retracted").otherwise(" is not retracted"))),
    ))

    out = functools.reduce(DataFrame.unionByName, found)
    if not list_all:
        out = out.groupBy("seq").agg(F.min(F.struct("rank", "rule", "event", "message")).alias("v")).select("seq", "v.event", "v.rule", "v.message")
    return out.select("seq", "event", "rule", rule_category("rule").alias("category"), "message")


def _standing_support(states: DataFrame, attest_edges: DataFrame, claims: DataFrame, span: int) -> DataFrame:
    """How many standing passages attest each claim at the moment it is attested (R6): `node_id, seq, held`.

    Withdrawn edges count, as they do at the write boundary. A passage enters the sum when its edge is
    drawn or when it comes to stand, and leaves when it no longer does."""
    stands = lambda c: F.coalesce(F.col(c).isin(*STANDING), F.lit(False)).cast("int")
    toggles = states.filter("status IS NOT NULL").select(F.col("id").alias("src"), "seq", (stands("status") - stands("prev_status")).alias("d")).filter("d <> 0")
    at_draw = states.filter("row = 'edge'").select(F.col("id").alias("src"), F.col("seq").alias("drawn_seq"), stands("prev_status").alias("d"))
    drawn_on = attest_edges.join(by_shuffle(at_draw), ["src", "drawn_seq"]).select(F.col("dst").alias("node_id"), F.col("drawn_seq").alias("seq"), "d")
    later = attest_edges.join(by_shuffle(toggles), "src").filter("seq > drawn_seq").select(F.col("dst").alias("node_id"), "seq", "d")
    asked = claims.select("node_id", "seq", F.lit(0).alias("d"))
    line = drawn_on.unionByName(later).unionByName(asked).groupBy("node_id", "seq").agg(F.sum("d").alias("d"))
    return running_total(line, ["node_id"], "seq", "d", "held", span, shuffled=True).join(by_shuffle(claims.select("node_id", "seq")), ["node_id", "seq"], "left_semi").select("node_id", "seq", "held")


# --- admission -------------------------------------------------------------------------------------------
def _touched(ev: DataFrame) -> DataFrame:
    """(seq, thing): the nodes, edges and agents that an event names and its judgement may depend on."""
    ids = [F.col("node_id"), base_edge(F.col("edge_id")), *[_detail(f) for f in ("src", "dst", "witness_id", "subject_node_id", "decision_node_id")]]
    agents = [F.concat(F.lit("agent/"), c) for c in (F.col("authored_by"), _detail("payload.id"))]
    return ev.select("seq", F.explode(F.array_compact(F.array(*ids, *agents))).alias("thing")).distinct()


def _strands(batch: DataFrame) -> DataFrame:
    """(seq, strand): events of a batch that depend on one another, directly or through others, share a
    strand. An author connects events only where the batch itself registers that agent."""
    things = _touched(batch)
    registered = batch.filter("event = 'register_agent'").select(F.concat(F.lit("agent/"), _detail("payload.id")).alias("thing")).distinct()
    plain = F.startswith("thing", F.lit("agent/"))
    things = things.filter(~plain).unionByName(things.filter(plain).join(by_shuffle(registered), "thing", "left_semi"))
    first = things.groupBy("thing").agg(F.min("seq").alias("v"))
    roots = components(things.join(by_shuffle(first), "thing").select(F.col("seq").alias("u"), "v").distinct(), shuffled=True)
    named = roots.select(F.col("node").alias("seq"), F.col("root").alias("strand"))
    return batch.select("seq").join(by_shuffle(named), "seq", "left").select("seq", F.coalesce("strand", "seq").alias("strand"))


def bearing(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The events of a log that the judgement of a batch can depend on.

    These are the events on nodes and edges that the batch names, the events on passages that attest such
    a node (whether they stand decides whether it may be attested), and the registrations of whoever wrote
    any of these. Everything else is left out before any state is built, so rounds of admission cost what
    the batch touches."""
    ours, things = F.startswith("thing", F.lit("agent/")), _touched(log)
    named = _touched(batch).filter(~ours).select("thing").distinct()
    near = cut_lineage(log.join(by_shuffle(things.filter(~ours).join(by_shuffle(named), "thing", "left_semi").select("seq").distinct()), "seq", "left_semi"))
    passages = near.filter("event = 'add_edge' AND edge_type = 'attests'").select(_detail("src").alias("thing")).distinct()
    around = things.join(by_shuffle(passages), "thing", "left_semi").select("seq")
    writers = near.select("authored_by").unionByName(batch.select("authored_by")).distinct()
    registered = log.filter("event = 'register_agent'").select("seq", _detail("payload.id").alias("authored_by")).join(by_shuffle(writers), "authored_by", "left_semi").select("seq")
    return log.join(by_shuffle(near.select("seq").unionByName(around).unionByName(registered).distinct()), "seq", "left_semi")


def admit(log: DataFrame, proposals: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Split a batch of proposed events into admitted and refused (with the rule), in the order of seq.

    `proposals` are events numbered after the log. Each is judged against the log and the proposals
    admitted before it; a refused one leaves no trace. The whole batch is judged at once as if every
    proposal were applied: the first violation of each strand of dependent events is then certain, for
    all before it were right to count. It is taken out and the rest judged again, until nothing is
    refused, so rounds are as many as the refusals of one strand. Each round is a written table and
    reads, of the log, only what bears on the batch.
    """
    log = cut_lineage(bearing(log, proposals))
    live, refused = cut_lineage(_strands(proposals)), None
    while True:
        step = proposals.join(by_shuffle(live.select("seq")), "seq", "left_semi")
        bad = audit(log.unionByName(step), span=span).join(by_shuffle(live), "seq")
        first = F.min(F.struct("seq", *[c for c in bad.columns if c not in ("seq", "strand")])).alias("v")
        now = cut_lineage(bad.groupBy("strand").agg(first).select("v.*"))
        refused = now if refused is None else refused.unionByName(now)
        if now.isEmpty():
            return step, refused
        live = cut_lineage(live.join(by_shuffle(now.select("seq")), "seq", "left_anti"))
