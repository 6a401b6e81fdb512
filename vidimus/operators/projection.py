"""Fold an append-only event log into a typed graph, and check the fold.

Every state column is a `min_by` / `max_by` / `min` / `max` over sequence numbers, so the fold is one
partially aggregated pass per table, independent of input order, and mergeable: `fold_*` make the
partial frames, `merge_*` combine partials, `finish_*` shape the stored tables. The streaming
projection reuses the same three steps per micro-batch.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions import text as tx
from vidimus.functions.frames import SPAN, cut_lineage, multiset_diff

PAGE = 1000  # edges of a node in one row

STATUS_OF = {"attest": "attested", "accept": "accepted", "reject": "rejected", "reopen": "proposed"}
VERDICT_OF = {"accept": "accepted", "reject": "rejected", "reopen": "reopened"}
VERDICTS = list(VERDICT_OF)


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    node_authorship: DataFrame
    edge_authorship: DataFrame
    agents: DataFrame


def _detail(path: str) -> Column:
    return F.get_json_object("detail", f"$.{path}")


def base_edge(c) -> Column:
    """Edge id without the suffix of its reverse twin."""
    return F.regexp_replace(c, ":rev$", "")


def _map_event(mapping: dict[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for event, value in mapping.items():
        expr = F.when(F.col("event") == event, F.lit(value)).otherwise(expr)
    return expr


# --- nodes -----------------------------------------------------------------------------------------
def node_changes(ev: DataFrame) -> DataFrame:
    """One row per (node, event) that creates or moves it. A verdict yields two rows: the move of its
    subject and the creation of its decision node."""
    subject = ev.filter(
        F.col("event").isin("propose", "verify", "ask", "attest", *VERDICTS) & F.col("node_id").isNotNull()
    ).select(
        F.col("node_id").alias("id"), "seq", "event",
        F.when(F.col("event").isin("propose", "verify", "ask"), F.lit("create"))
        .when(F.col("event") == "attest", F.lit("attest")).otherwise(F.lit("verdict")).alias("kind"),
        F.when(F.col("event") == "verify", F.lit("verification"))
        .when(F.col("event") == "ask", F.lit("question")).otherwise(F.col("node_type")).alias("type"),
        F.when(F.col("event") == "propose", F.lit("proposed"))
        .when(F.col("event").isin("verify", "ask"), F.lit("accepted"))
        .otherwise(_map_event(STATUS_OF)).alias("status"),
        _detail("payload").alias("payload"),
        F.when(F.col("event") == "reject", _detail("reason")).alias("reason"),
    )
    decision = ev.filter(F.col("event").isin(*VERDICTS) & _detail("decision_node_id").isNotNull()).select(
        _detail("decision_node_id").alias("id"), "seq", "event",
        F.lit("create").alias("kind"), F.lit("decision").alias("type"), F.lit("accepted").alias("status"),
        F.to_json(
            F.struct(
                F.col("node_id").alias("subject_node_id"), _map_event(VERDICT_OF).alias("verdict"),
                _detail("reason").alias("reason"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("payload"),
        F.lit(None).cast("string").alias("reason"),
    )
    return subject.unionByName(decision)


def fold_nodes(ev: DataFrame) -> DataFrame:
    """Partial state per node.

    A later propose converges and never moves the status, so only moves after the creation count:
    the fold keeps the first creation and the last move, and `finish_nodes` compares the two.
    """
    ch = node_changes(ev)
    create, move, verdict = F.col("kind") == "create", F.col("kind") != "create", F.col("kind") == "verdict"
    at = lambda cond: F.when(cond, F.col("seq"))
    return ch.groupBy("id").agg(
        F.min_by(F.struct("seq", "type", "status", "payload"), at(create)).alias("born"),
        F.max_by(F.struct("seq", "status"), at(move)).alias("moved"),
        F.max_by(F.struct("seq", "reason"), at(verdict)).alias("judged"),
        F.max("seq").alias("touched"),
    )


def merge_nodes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(
        F.min_by("born", "born.seq").alias("born"), F.max_by("moved", "moved.seq").alias("moved"),
        F.max_by("judged", "judged.seq").alias("judged"), F.max("touched").alias("touched"),
    )


def finish_nodes(parts: DataFrame) -> DataFrame:
    after = lambda c: F.col(f"{c}.seq") > F.col("born.seq")
    return parts.filter("born.seq IS NOT NULL").select(
        "id", F.col("born.type").alias("type"),
        F.when(after("moved"), F.col("moved.status")).otherwise(F.col("born.status")).alias("status"),
        F.col("born.payload").alias("payload"), tx.sha256("born.payload").alias("payload_hash"),
        F.when(after("judged"), F.col("judged.reason")).alias("rejected_reason"),
        F.col("born.seq").alias("created_seq"), F.greatest("touched", "born.seq").alias("updated_seq"),
    )


# --- edges ------------------------------------------------------------------------------------------
def edge_changes(ev: DataFrame) -> DataFrame:
    """One row per (base edge, event) that draws, withdraws or restores it."""
    drawn = ev.filter(
        (
            (F.col("event") == "add_edge") & ~F.coalesce(_detail("converge").cast("boolean"), F.lit(False))
            | (F.col("event") == "propose") & F.col("edge_id").isNotNull() & F.col("edge_type").isNotNull()
            | (F.col("event") == "verify")
        )
    ).select(
        F.col("edge_id").alias("id"), "seq", F.lit("draw").alias("kind"), F.col("edge_type").alias("type"),
        F.when(F.col("event") == "add_edge", _detail("src")).otherwise(F.col("node_id")).alias("src"),
        F.when(F.col("event") == "add_edge", _detail("dst"))
        .when(F.col("event") == "propose", _detail("witness_id")).otherwise(_detail("subject_node_id")).alias("dst"),
        F.when(F.col("event") == "add_edge", _detail("reason")).alias("reason"),
        F.lit(None).cast("string").alias("at"),
    )
    moved = ev.filter(F.col("event").isin("retract_edge", "restore_edge") & F.col("edge_id").isNotNull())
    retract = F.col("event") == "retract_edge"
    none = F.lit(None).cast("string")
    moves = moved.select(
        base_edge("edge_id").alias("id"), "seq", F.lit("move").alias("kind"), none.alias("type"),
        none.alias("src"), none.alias("dst"), F.when(retract, _detail("reason")).alias("reason"),
        F.when(retract, F.col("at")).alias("at"),
    )
    return drawn.unionByName(moves)


def fold_edges(ev: DataFrame) -> DataFrame:
    ch = edge_changes(ev)
    return ch.groupBy("id").agg(
        F.min_by(F.struct("seq", "type", "src", "dst", "reason"), F.when(F.col("kind") == "draw", F.col("seq"))).alias("born"),
        F.max_by(F.struct("seq", "at", "reason"), F.when(F.col("kind") == "move", F.col("seq"))).alias("moved"),
    )


def merge_edges(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(
        F.min_by("born", "born.seq").alias("born"), F.max_by("moved", "moved.seq").alias("moved")
    )


def finish_edges(parts: DataFrame) -> DataFrame:
    live = F.col("moved.seq") > F.col("born.seq")
    one = parts.filter("born.seq IS NOT NULL").select(
        "id", F.col("born.type").alias("type"), F.col("born.src").alias("src"), F.col("born.dst").alias("dst"),
        F.col("born.seq").alias("created_seq"), F.col("born.reason").alias("reason"),
        F.when(live, F.col("moved.at")).alias("retracted_at"),
        F.when(live, F.col("moved.reason")).alias("retracted_reason"),
    )
    return with_twins(one)


def with_twins(edges: DataFrame) -> DataFrame:
    """Symmetric edges in both directions; the twin's id ends in `:rev` (E7). One pass, no self-union."""
    here = F.struct("id", "src", "dst")
    back = F.struct(
        F.concat("id", F.lit(":rev")).alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst")
    )
    sides = F.when(F.col("type").isin(*schemas.SYMMETRIC_EDGE_TYPES), F.array(here, back)).otherwise(F.array(here))
    rest = [c for c in edges.columns if c not in ("id", "src", "dst")]
    return edges.select(F.explode(sides).alias("s"), *rest).select(
        *[F.col(f"s.{c}") if c in ("id", "src", "dst") else F.col(c) for c in edges.columns]
    )


# --- authorship ------------------------------------------------------------------------------------
def node_acts(ev: DataFrame) -> DataFrame:
    """Who did what to which node; `propose` is settled into proposed or converged later."""
    act = {"propose": "propose", "verify": "proposed", "ask": "proposed", "attest": "attested", **VERDICT_OF}
    subject = ev.filter(F.col("event").isin(*act) & F.col("node_id").isNotNull()).select(
        "node_id", F.col("authored_by").alias("author"), _map_event(act).alias("action"), "at", "seq"
    )
    decision = ev.filter(F.col("event").isin(*VERDICTS) & _detail("decision_node_id").isNotNull()).select(
        _detail("decision_node_id").alias("node_id"), F.col("authored_by").alias("author"),
        F.lit("proposed").alias("action"), "at", "seq",
    )
    return subject.unionByName(decision)


def settle_node_acts(acts: DataFrame, created: DataFrame) -> DataFrame:
    """`created` holds id, created_seq: the propose that created a node is its `proposed` row, later
    ones `converged`. Hot nodes are split by adaptive skew handling, since one side is unique per id."""
    fixed = acts.filter("action <> 'propose'")
    open_ = acts.filter("action = 'propose'").join(
        created.select(F.col("id").alias("node_id"), "created_seq"), "node_id"
    )
    settled = open_.withColumn(
        "action", F.when(F.col("seq") == F.col("created_seq"), "proposed").otherwise("converged")
    ).drop("created_seq")
    return fixed.unionByName(settled)


def edge_acts(ev: DataFrame) -> DataFrame:
    converge = F.coalesce(_detail("converge").cast("boolean"), F.lit(False))
    draws = ev.filter(
        (F.col("event").isin("add_edge", "verify"))
        | ((F.col("event") == "propose") & F.col("edge_id").isNotNull() & F.col("edge_type").isNotNull())
    )
    action = F.when((F.col("event") == "add_edge") & converge, "converged").otherwise("proposed")
    twin = (
        (F.col("event") == "add_edge") & ~converge
        & F.col("edge_type").isin(*schemas.SYMMETRIC_EDGE_TYPES)
    )
    ids = F.when(twin, F.array("edge_id", F.concat("edge_id", F.lit(":rev")))).otherwise(F.array("edge_id"))
    return draws.select(
        F.explode(ids).alias("edge_id"), F.col("authored_by").alias("author"), action.alias("action"), "at", "seq"
    )


def edge_move_acts(ev: DataFrame) -> DataFrame:
    moves = ev.filter(F.col("event").isin("retract_edge", "restore_edge") & F.col("edge_id").isNotNull())
    return moves.select(
        base_edge("edge_id").alias("base"), F.col("authored_by").alias("author"),
        F.when(F.col("event") == "retract_edge", "retracted").otherwise("restored").alias("action"), "at", "seq",
    )


def settle_edge_moves(moves: DataFrame, edges: DataFrame) -> DataFrame:
    """A withdrawal writes a row on every existing direction of the edge drawn before it."""
    rows = edges.select(base_edge("id").alias("base"), F.col("id").alias("edge_id"), "created_seq")
    return moves.join(rows, "base").filter("seq > created_seq").select("edge_id", "author", "action", "at", "seq")


# --- agents -----------------------------------------------------------------------------------------
def fold_agents(ev: DataFrame) -> DataFrame:
    cols = ["id", "kind", "corpus_scope", "method_label", "model"]
    reg = ev.filter("event = 'register_agent'").select(
        *[_detail(f"payload.{c}").alias(c) for c in cols], "seq"
    )
    return reg.groupBy("id").agg(
        F.max_by(F.struct("seq", *cols[1:]), "seq").alias("last"), F.min("seq").alias("first")
    )


def merge_agents(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id").agg(F.max_by("last", "last.seq").alias("last"), F.min("first").alias("first"))


def finish_agents(parts: DataFrame) -> DataFrame:
    return parts.select(
        "id", "last.kind", "last.corpus_scope", "last.method_label", "last.model", F.col("first").alias("created_seq")
    )


def project(ev: DataFrame) -> Graph:
    """The whole fold."""
    nodes = finish_nodes(fold_nodes(ev))
    edges = finish_edges(fold_edges(ev))
    return Graph(
        nodes, edges,
        settle_node_acts(node_acts(ev), nodes.select("id", "created_seq")),
        edge_acts(ev).unionByName(settle_edge_moves(edge_move_acts(ev), edges)),
        finish_agents(fold_agents(ev)),
    )


# --- checks of a stored projection --------------------------------------------------------------------
def rebuild_diff(
    ev: DataFrame, nodes: DataFrame, edges: DataFrame, node_authorship: DataFrame,
    edge_authorship: DataFrame, agents: DataFrame,
) -> DataFrame:
    """Rows that differ between a replay of the log and the stored tables; empty means they agree.

    Edge reasons, agent models and payload hashes are not compared. Each table of the replay is written
    before it is compared, so that no task holds a fold, a join and the comparison at once.
    """
    replay = Graph(*map(cut_lineage, project(ev)))
    plan = [
        ("nodes", replay.nodes, nodes, ["id", "type", "status", "payload", "rejected_reason"]),
        ("edges", replay.edges, edges, ["id", "type", "src", "dst", "retracted_at", "retracted_reason"]),
        ("node_authorship", replay.node_authorship, node_authorship, ["node_id", "author", "action", "seq"]),
        ("edge_authorship", replay.edge_authorship, edge_authorship, ["edge_id", "author", "action", "seq"]),
        ("agents", replay.agents, agents, ["id", "kind", "corpus_scope", "method_label"]),
    ]
    out = None
    for name, mine, theirs, keep in plan:
        d = multiset_diff(mine, theirs, keep)
        key = keep[0]
        part = d.select(
            F.lit(name).alias("table"), F.col(key).alias("id"),
            F.when(F.col("side") == "mine", "replay").otherwise("stored").alias("side"),
            F.abs("surplus").alias("n"), F.to_json(F.struct(*keep)).alias("row"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def rebuild_report(ev: DataFrame, diff: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    parts = [one(ev, "events_replayed"), one(nodes, "nodes"), one(edges, "edges"), one(diff, "differences")]
    keyed = [p.withColumn("_k", F.lit(1)) for p in parts]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.join(p, "_k")
    return out.drop("_k").withColumn("ok", F.col("differences") == 0)


def integrity_rows(nodes: DataFrame) -> DataFrame:
    """Per node: unhashed, mismatched or intact."""
    return nodes.select(
        "id",
        F.when(F.col("payload_hash").isNull(), "unhashed")
        .when(tx.sha256("payload") != F.col("payload_hash"), "mismatched")
        .otherwise("intact").alias("integrity"),
    )


def integrity(nodes: DataFrame) -> DataFrame:
    return integrity_rows(nodes).agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("integrity") == "mismatched").alias("mismatched"),
        F.count_if(F.col("integrity") == "unhashed").alias("unhashed"),
    )


def backfill_hash(nodes: DataFrame) -> DataFrame:
    """Hash rows stored before hashing existed."""
    return nodes.withColumn("payload_hash", F.coalesce("payload_hash", tx.sha256("payload")))


# --- views -------------------------------------------------------------------------------------------
def authorship_list(authorship: DataFrame, key: str) -> DataFrame:
    """Authorship rows of each id in sequence order, as one array."""
    entry = F.struct("seq", "author", "at", "action")
    return authorship.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["author"].alias("author"), e["at"].alias("at"), e["action"].alias("action"))
        ).alias("authorship")
    )


def node_view(nodes: DataFrame, edges: DataFrame, node_authorship: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Node rows with authorship, assurance, review state and reader address (E15). `checks` are their
    verifications, where these are at hand."""
    from vidimus.operators.evidence import assurance, review_state

    who = authorship_list(node_authorship, "node_id").withColumnRenamed("node_id", "id")
    rank = assurance(nodes, edges, checks=checks).select("id", "assurance")
    review = review_state(nodes, edges, checks).select("id", F.col("code").alias("review_state"))
    ref = F.coalesce(F.get_json_object("payload", "$.canonical_ref"), F.lit(""))
    return (
        nodes.join(who, "id", "left").join(rank, "id", "left").join(review, "id", "left")
        .select(
            "id", "type", "status", "payload", "rejected_reason", "review_state", "authorship",
            "created_seq", "updated_seq", "assurance", tx.reader_url(ref).alias("reader_url"),
        )
    )


def edge_pages(edges: DataFrame, ids: DataFrame, size: int = PAGE, span: int = SPAN) -> DataFrame:
    """The edges of the wanted nodes (`id`), withdrawn ones included, as numbered pages of at most `size`
    in the order they were made: (id, side, page, edges), side `out` or `in`, pages from 0 (E16, G6).

    A hub is many pages. Places are counted within chunks of the sequence and shifted by the sizes of the
    chunks before, so neither a window nor a row ever holds all edges of a node.
    """
    from vidimus.operators.evidence import edge_view

    shown = edge_view(edges)
    entry = F.struct("created_seq", "id", "type", "src", "dst", "discounts", "reason", "retracted").alias("edge")
    ends = shown.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("side")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("side")))).alias("end"), entry)
    mine = ends.select("end.id", "end.side", "edge", F.floor(F.col("edge.created_seq") / span).alias("_chunk")).join(ids.select("id").distinct(), "id", "left_semi")
    key = ["id", "side", "_chunk"]
    before = Window.partitionBy("id", "side").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = mine.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*key).orderBy("edge.created_seq", "edge.id")
    placed = mine.withColumn("_place", F.row_number().over(inside) - 1).join(sizes, key).withColumn("page", F.floor((F.col("_place") + F.col("_before")) / size))
    return placed.groupBy("id", "side", "page").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def node_detail(
    nodes: DataFrame, edges: DataFrame, node_authorship: DataFrame, ids: DataFrame,
) -> DataFrame:
    """Wanted nodes (`ids`: see `evidence.wanted`) with their verifications, how many edges they have each way
    (withdrawn ones included; the edges themselves are `edge_pages`) and, for claims and conjectures only, the
    independence of their support (E16)."""
    from vidimus.operators.evidence import checks_on, independent_support, wanted

    want = cut_lineage(wanted(nodes, ids))
    ids = want.select("id")
    found = checks_on(nodes, edges, ids)
    view = node_view(want, edges, node_authorship, found)

    degree = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    checks = found.groupBy(F.col("subject_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("created_seq", "verification_id", "method", "result", "assurance_level"))).alias("verifications")
    )
    support = independent_support(want, edges).select(
        "id", F.struct("attesting_count", "distinct_witnesses", "independent", "vacuous").alias("support")
    )
    out = view.join(checks, "id", "left").join(degree("src", "edges_out"), "id", "left").join(degree("dst", "edges_in"), "id", "left").join(support, "id", "left")
    return out.fillna(0, ["edges_out", "edges_in"])


def creation_provenance(nodes: DataFrame, ev: DataFrame) -> DataFrame:
    """Author, role, model of the causal call, stated reason and tool of each node's creation.

    The call and the roster come by equality; the tool action is the last one of the same call that
    was logged up to the creation. Current agent profiles are not consulted.
    """
    made = nodes.select("id", "created_seq").join(
        ev.select("seq", "authored_by", "model_call_id", "run_id"), F.col("created_seq") == F.col("seq")
    ).drop("seq")
    calls = ev.filter("event = 'model_call'").select(
        F.col("seq").alias("model_call_id"), F.col("model").alias("call_model")
    )
    roster = ev.filter("event = 'run_started'").select(
        "run_id", F.col("seq").alias("started"),
        F.explode(F.from_json(_detail("agents"), "array<struct<agent_id:string,role:string>>")).alias("a"),
    )
    roles = roster.select("run_id", "started", F.col("a.agent_id").alias("authored_by"), F.col("a.role").alias("role"))
    acts = ev.filter("event = 'tool_action' AND model_call_id IS NOT NULL").select(
        "model_call_id", F.col("seq").alias("acted"), _detail("reason").alias("reason"), _detail("tool").alias("tool")
    )
    with_role = made.join(roles, ["run_id", "authored_by"], "left").groupBy(
        "id", "created_seq", "authored_by", "model_call_id"
    ).agg(F.max_by("role", F.when(F.col("started") <= F.col("created_seq"), F.col("started"))).alias("role"))
    with_act = with_role.join(acts, "model_call_id", "left").groupBy(
        "id", "created_seq", "authored_by", "model_call_id", "role"
    ).agg(
        F.max_by(F.struct("reason", "tool"), F.when(F.col("acted") <= F.col("created_seq"), F.col("acted"))).alias("t")
    )
    return with_act.join(calls, "model_call_id", "left").select(
        "id", F.col("authored_by").alias("author"), "role",
        F.when(F.col("model_call_id") <= F.col("created_seq"), F.col("call_model")).alias("model"),
        "t.reason", "t.tool",
    )
