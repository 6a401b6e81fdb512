"""Span verification, review, predictions, proposal intake and citation gathering (V1-V8)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus import schemas
from vidimus.functions import text as tx
from vidimus.functions.frames import cut_lineage, latest_per
from vidimus.operators.evidence import attest_conflicts, independent_support, verifications
from vidimus.operators.spans import phrase_df, search

# What a verification says about each state of a check.
SAY = {
    "nothing": "no source or no excerpt on record, so there is nothing to look for",
    "missing": "the source does not hold the excerpt",
    "moved": "the excerpt is not where the last check found it",
    "baseline": "found; this place is what later checks compare with",
    "again": "found at the same place as in the last check",
}


def last_spans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Last recorded exact-span position of each passage."""
    spans = verifications(nodes, edges).filter("method = 'exact_span' AND span_start IS NOT NULL")
    rows = spans.select(F.col("subject_id").alias("id"), "created_seq", "verification_id", "span_start", "span_end", "excerpt_hash")
    return latest_per(rows, ["id"], ["created_seq", "verification_id"]).select("id", "span_start", "span_end", "excerpt_hash")


def verify_spans(passages: DataFrame, docs: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Re-locate every passage's excerpt in its source (V1).

    `passages` holds `id, source_ref, excerpt`; `docs` holds `ref, text`; `prior` holds the last recorded
    `id, span_start, span_end, excerpt_hash`. The first occurrence counts. A source is hashed once, not
    once per passage that cites it.
    """
    hashed = docs.select(F.col("ref").alias("source_ref"), "text", tx.sha256("text").alias("source_hash"))
    j = passages.select("id", "source_ref", "excerpt").join(hashed, "source_ref", "left")
    if prior is None:
        none = F.lit(None)
        j = j.select("*", none.cast("bigint").alias("p_start"), none.cast("bigint").alias("p_end"), none.cast("string").alias("p_hash"))
    else:
        j = j.join(prior.select("id", F.col("span_start").alias("p_start"), F.col("span_end").alias("p_end"), F.col("excerpt_hash").alias("p_hash")), "id", "left")
    usable = (F.coalesce(F.col("source_ref").cast("string"), F.lit("")) != "") & (F.coalesce("excerpt", F.lit("")) != "")
    at = tx.first_at("text", "excerpt")
    j = j.withColumn("_ok", usable).withColumn("_at", F.when(usable, at).cast("bigint"))
    found = F.col("_ok") & (F.col("_at") >= 0)
    j = j.withColumn("_end", F.col("_at") + F.length("excerpt")).withColumn("_hash", F.when(found, tx.sha256("excerpt")))
    moved = F.col("p_start").isNotNull() & ~(
        F.col("p_start").eqNullSafe(F.col("_at")) & F.col("p_end").eqNullSafe(F.col("_end")) & F.col("p_hash").eqNullSafe(F.col("_hash"))
    )
    state = (
        F.when(~F.col("_ok"), "nothing").when(F.col("text").isNull(), "no_source").when(F.col("_at") < 0, "missing")
        .when(moved, "moved").when(F.col("p_start").isNotNull(), "again").otherwise("baseline")
    )
    j = j.withColumn("state", state)
    passed = F.col("state").isin("again", "baseline")
    detail = F.lit(None).cast("string")
    for k, v in SAY.items():
        detail = F.when(F.col("state") == k, F.lit(v)).otherwise(detail)
    return j.select(
        "id", F.lit("exact_span").alias("method"),
        F.when(passed, "pass").when(F.col("state") == "nothing", "indeterminate").when(F.col("state") == "no_source", "error").otherwise("fail").alias("result"),
        F.when(passed, "A2_EXACT_SPAN_MATCHED").otherwise("A0_UNCHECKED").alias("assurance_level"),
        detail.alias("detail"), F.when(F.col("_ok"), F.col("source_hash")).alias("source_hash"), F.col("_hash").alias("excerpt_hash"),
        F.when(F.col("_at") >= 0, F.col("_at")).alias("span_start"), F.when(F.col("_at") >= 0, F.col("_end")).alias("span_end"),
    )


def passages_of(nodes: DataFrame) -> DataFrame:
    p = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    return nodes.filter("type = 'passage'").select("id", p("source_ref"), p("excerpt"))


def review(
    reviews: DataFrame, nodes: DataFrame, edges: DataFrame, node_authorship: DataFrame, agents: DataFrame, checks: DataFrame,
) -> DataFrame:
    """Mechanical side of reviews (V2). `reviews` holds `claim_id, reviewer, verdict, detail`; `checks` are
    fresh results of `verify_spans`.

    The verdict may withhold promotion, never supply it: promotion needs every span re-verified, a sound
    verdict, a proposed claim, no conflict of interest, and the ladder's own gate.
    """
    cited = edges.filter("type = 'attests' AND retracted_at IS NULL").select(F.col("dst").alias("claim_id"), F.col("src").alias("id"))
    spans = cited.join(checks.select("id", "result"), "id", "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("spans_checked"), F.count_if(F.col("result") == "pass").alias("spans_matched")
    )
    support = independent_support(nodes, edges).select(F.col("id").alias("claim_id"), "distinct_witnesses", "independent")
    who = attest_conflicts(nodes, node_authorship, agents, reviews.select(F.col("reviewer").alias("agent_id")).distinct())
    conflict = who.select(F.col("node_id").alias("claim_id"), F.col("agent_id").alias("reviewer"), F.col("rule").alias("conflict"))
    tested = edges.filter("type = 'tests'").select(F.col("dst").alias("claim_id")).distinct().withColumn("tested", F.lit(True))
    standing = attested_support(nodes, edges).select("claim_id").withColumn("standing", F.lit(True))
    j = reviews.join(nodes.select(F.col("id").alias("claim_id"), "type", "status"), "claim_id", "left")
    for part in (spans, support, tested, standing):
        j = j.join(part, "claim_id", "left")
    j = j.join(conflict, ["claim_id", "reviewer"], "left").fillna(0, ["spans_checked", "spans_matched"])
    refused = (
        F.when(~F.col("verdict").isin("sound", "unsound", "indeterminate"), "InvalidVerdict").when(F.col("type").isNull(), "NodeNotFound")
        .when(~F.col("type").isin(*schemas.REVIEWABLE_TYPES), "WrongNodeType").otherwise(F.col("conflict"))
    )
    all_ok = (F.col("spans_checked") > 0) & (F.col("spans_matched") == F.col("spans_checked"))
    gate = (
        F.when((F.col("type") == "claim") & F.col("standing").isNull(), "UnattestableClaim")
        .when((F.col("type") == "conjecture") & F.col("tested").isNull(), "UnattestableConjecture")
    )
    note = (
        F.when(F.col("refused").isNotNull(), "refused").when(F.col("spans_checked") == 0, "nothing cited").when(~all_ok, "spans failed")
        .when(F.col("verdict") != "sound", "verdict withheld promotion").when(F.col("status") != "proposed", "already advanced")
        .when(gate.isNotNull(), F.concat(F.lit("not advanced: "), gate)).otherwise("attested")
    )
    j = j.withColumn("refused", refused).withColumn("note", note)
    done = F.col("refused").isNull()
    return j.select(
        "claim_id", "reviewer", "verdict", "refused", "spans_checked", "spans_matched",
        F.when(done, F.when(all_ok, "pass").when(F.col("spans_checked") > 0, "fail").otherwise("indeterminate")).alias("result"),
        F.when(done & all_ok, "A2_EXACT_SPAN_MATCHED").otherwise("A0_UNCHECKED").alias("assurance_level"),
        "distinct_witnesses", "independent", (F.col("note") == "attested").alias("attested"), "note",
        F.when(done, F.concat(F.lit("reviewer verdict "), "verdict", F.lit(": "), "detail")).alias("limitations"),
    )


def attested_support(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with an attests edge, withdrawn or not, from a passage that stands."""
    stands = nodes.filter("status IN ('attested', 'accepted')").select(F.col("id").alias("src"))
    return edges.filter("type = 'attests'").join(stands, "src", "left_semi").select(F.col("dst").alias("claim_id")).distinct()


def newest_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Newest `tests` query of each conjecture with its recorded prediction."""
    p = lambda f: F.get_json_object("payload", f"$.{f}")
    q = nodes.filter("type = 'query'").select(
        F.col("id").alias("query_id"), "created_seq", p("text").alias("query"), p("expectation").alias("expectation"),
        p("expected_hits").cast("bigint").alias("expected_hits"),
    )
    link = edges.filter("type = 'tests' AND retracted_at IS NULL").select(F.col("src").alias("query_id"), F.col("dst").alias("conjecture_id"))
    return latest_per(link.join(q, "query_id"), ["conjecture_id"], ["created_seq", "query_id"])


def prospective(predictions: DataFrame, spans: DataFrame, cap: int | None = None) -> DataFrame:
    """Run each conjecture's newest query and compare the count with the prediction (V3).

    `predictions` holds `conjecture_id, query_id, query, expectation, expected_hits`. The count is exact
    unless a cap is given; a capped count is a floor and settles only what a floor can settle. No result
    of a prediction raises assurance.
    """
    observed = phrase_df(spans, predictions.select("query_id", "query").distinct(), cap)
    j = predictions.join(observed.withColumnRenamed("n", "observed_hits"), "query_id")
    most = F.col("expectation") == "at_most"
    held = F.when(most, F.col("observed_hits") <= F.col("expected_hits")).otherwise(F.col("observed_hits") >= F.col("expected_hits"))
    decided = ~F.col("saturated") | F.when(most, F.col("observed_hits") > F.col("expected_hits")).otherwise(held)
    result = (
        F.when(F.col("expectation").isNull() | F.col("expected_hits").isNull(), "indeterminate").when(~decided, "indeterminate")
        .when(held, "pass").otherwise("fail")
    )
    return j.select(
        "conjecture_id", "query_id", "query", "expectation", "expected_hits", "observed_hits", "saturated", result.alias("result"),
        F.lit("A0_UNCHECKED").alias("assurance_level"),
    )


# --- proposals ----------------------------------------------------------------------------------------------
def quoted(c: Column) -> Column:
    """A phrase in quotes the way stored search texts carry it."""
    esc = F.regexp_replace(c, r"\\", r"\\\\")
    for raw, shown in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        esc = F.regexp_replace(esc, raw, shown)
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), esc, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'")))
    )


def stable_id(kind: str, *parts: Column) -> Column:
    """Id of an agent-authored node of a batch: fixed by the proposal, so a retried task makes the same."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256), 1, 32))


_ROW = "event STRING, authored_by STRING, node_id STRING, edge_id STRING, node_type STRING, edge_type STRING, detail STRING"


def _emit(event: str, *, node=None, edge=None, node_type=None, edge_type=None, detail: Column | None = None) -> Column:
    s = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    return F.struct(
        F.lit(event).alias("event"), F.col("authored_by"), s(node).alias("node_id"), s(edge).alias("edge_id"),
        s(node_type).alias("node_type"), s(edge_type).alias("edge_type"), (F.lit("{}") if detail is None else detail).alias("detail"),
    )


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def _unroll(df: DataFrame, key: list[str], rows: Column) -> DataFrame:
    return df.select(*key, F.posexplode(rows).alias("step", "r")).select(*key, "step", "r.*")


def ground(proposals: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims with a grounding query (V4): events for those that hit, refusals for those that do not.

    `proposals` holds `proposal_id, authored_by, text, grounding_query`.
    """
    q = proposals.select(F.col("proposal_id").alias("query_id"), F.col("grounding_query").alias("query"))
    n = phrase_df(spans, q).select(F.col("query_id").alias("proposal_id"), "n")
    j = proposals.join(n, "proposal_id")
    refused = j.filter("n = 0").select(
        "proposal_id", F.lit("refused").alias("event"), "authored_by",
        _json(
            attempted=F.lit("propose_claim"), rule=F.lit("UngroundedClaim"),
            message=F.concat(F.lit("grounding query "), quoted(F.col("grounding_query")), F.lit(" returned no hits in this corpus")),
        ).alias("detail"),
    )
    qid, cid = stable_id("query", F.col("proposal_id").cast("string")), stable_id("claim", F.col("proposal_id").cast("string"))
    note = F.concat(F.lit("grounding: "), quoted(F.col("grounding_query")), F.lit(" ("), F.col("n").cast("string"), F.lit(" hits)"))
    no = F.lit(False)
    blank = F.lit(None).cast("string")
    rows = F.array(
        _emit("propose", node=qid, node_type="query", detail=_json(payload=F.struct(note.alias("text"), blank.alias("expectation"), blank.cast("bigint").alias("expected_hits")), converge=no)),
        _emit("propose", node=cid, node_type="claim", detail=_json(payload=F.struct("text"), converge=no)),
        _emit("add_edge", edge=stable_id("edge", qid, cid), edge_type="searched_for", detail=_json(src=qid, dst=cid, converge=no)),
    )
    return _unroll(j.filter("n > 0"), ["proposal_id"], rows), refused


def intake(proposals: DataFrame, spans: DataFrame) -> DataFrame:
    """Conjectures with their prior-art count and recorded prediction, as events (V5).

    `proposals` holds `proposal_id, authored_by, text`, the four dossier fields, `prior_art_query,
    tests_query, expectation, expected_hits`.
    """
    q = proposals.select(F.col("proposal_id").alias("query_id"), F.col("prior_art_query").alias("query"))
    n = phrase_df(spans, q).select(F.col("query_id").alias("proposal_id"), "n")
    j = proposals.join(n, "proposal_id")
    key = F.col("proposal_id").cast("string")
    prior, conj, test = stable_id("query", key, F.lit("prior")), stable_id("conjecture", key), stable_id("query", key, F.lit("tests"))
    note = F.concat(F.lit("prior art: "), quoted(F.col("prior_art_query")), F.lit(" ("), F.col("n").cast("string"), F.lit(" hits)"))
    no, blank = F.lit(False), F.lit(None).cast("string")
    query = lambda text, exp, hits: F.struct(text.alias("text"), exp.alias("expectation"), hits.alias("expected_hits"))
    rows = F.array(
        _emit("propose", node=prior, node_type="query", detail=_json(payload=query(note, blank, blank.cast("bigint")), converge=no)),
        _emit("propose", node=conj, node_type="conjecture", detail=_json(payload=F.struct("text", *schemas.DOSSIER_FIELDS), converge=no)),
        _emit("add_edge", edge=stable_id("edge", prior, conj), edge_type="searched_for", detail=_json(src=prior, dst=conj, converge=no)),
        _emit("propose", node=test, node_type="query", detail=_json(payload=query(F.col("tests_query"), F.col("expectation"), F.col("expected_hits")), converge=no)),
        _emit("add_edge", edge=stable_id("edge", test, conj), edge_type="tests", detail=_json(src=test, dst=conj, converge=no)),
    )
    return _unroll(j, ["proposal_id"], rows)


def gather(
    targets: DataFrame, spans: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame,
    node_authorship: DataFrame, agents: DataFrame, k: int = 5,
) -> DataFrame:
    """Run each target's query and record what it finds, as events in order (V6).

    `targets` holds `call_no, target_id, authored_by, query`; `docs` holds `doc, witness_ref, title,
    locator, note`. Per hit: the witness with the source's licence terms, the passage keyed by witness
    and hit, its attestation, the attests edge. A call stops at the first hit whose witness or passage
    was rejected before. A target with passages, still proposed and with no conflict, advances when its
    own gate holds. First occurrences inside the batch come from one aggregate, never from ordering a
    witness's hits in one task.
    """
    q = targets.select(F.col("call_no").alias("query_id"), "query")
    # everything below looks at the few hits again and again
    hits = cut_lineage(search(spans, q, k).select(F.col("query_id").alias("call_no"), F.col("rank").alias("hit_no"), "doc", "span"))
    j = hits.join(targets, "call_no").join(docs, "doc").withColumn("ref", F.concat("doc", F.lit("::"), "span"))
    j = j.withColumn("wid", F.concat(F.lit("witness:"), "witness_ref")).withColumn(
        "pid", F.concat(F.lit("passage:"), "witness_ref", F.lit("#"), "ref")
    ).withColumn("place", F.struct("call_no", "hit_no"))
    state = lambda key: nodes.select(F.col("id").alias(key), F.col("status").alias(f"{key}_status"))
    j = j.join(state("wid"), "wid", "left").join(state("pid"), "pid", "left")
    bad = F.coalesce((F.col("wid_status") == "rejected") | (F.col("pid_status") == "rejected"), F.lit(False))
    stop = j.filter(bad).groupBy("call_no").agg(F.min("hit_no").alias("stop_at"))
    j = j.join(stop, "call_no", "left")
    refused = j.filter("hit_no = stop_at")
    live = j.filter("stop_at IS NULL OR hit_no < stop_at")
    firsts = lambda key: live.groupBy(key).agg(F.min("place").alias(f"{key}_first"))
    live = live.join(firsts("wid"), "wid").join(firsts("pid"), "pid")
    known = edges.filter("type = 'attests'").select(F.col("src").alias("pid"), F.col("dst").alias("target_id"), F.col("id").alias("known_edge"))
    live = live.join(known, ["pid", "target_id"], "left")
    pair_first = live.groupBy("pid", "target_id").agg(F.min("place").alias("pair_first"))
    live = live.join(pair_first, ["pid", "target_id"])
    w_old = F.col("wid_status").isNotNull() | (F.col("place") != F.col("wid_first"))
    p_old = F.col("pid_status").isNotNull() | (F.col("place") != F.col("pid_first"))
    attest = (F.col("place") == F.col("pid_first")) & (F.col("pid_status").isNull() | (F.col("pid_status") == "proposed"))
    edge_old = F.col("known_edge").isNotNull() | (F.col("place") != F.col("pair_first"))
    eid = F.coalesce("known_edge", stable_id("edge", F.col("pid"), F.col("target_id")))
    dating = F.struct(F.lit(None).cast("string").alias("value"), F.lit("unknown").alias("confidence"), F.lit("no date was looked for when the witness was gathered").alias("basis"))
    witness = F.struct(F.col("witness_ref").alias("canonical_ref"), F.col("title").alias("label"), dating.alias("dating"), F.col("note").alias("source_terms"))
    passage = F.struct(
        F.concat("witness_ref", F.lit("#"), "ref").alias("canonical_ref"), F.coalesce("locator", "ref").alias("locator"),
        F.col("span").alias("excerpt"), F.col("ref").alias("source_ref"),
    )
    rows = F.array_compact(F.array(
        _emit("propose", node=F.col("wid"), node_type="witness", detail=_json(payload=witness, converge=w_old)),
        _emit(
            "propose", node=F.col("pid"), node_type="passage", edge=F.when(~p_old, stable_id("edge", F.col("pid"), F.col("wid"))),
            edge_type=F.when(~p_old, F.lit("part_of")), detail=_json(payload=passage, witness_id=F.col("wid"), converge=p_old),
        ),
        F.when(attest, _emit("attest", node=F.col("pid"), node_type="passage")),
        _emit("add_edge", edge=eid, edge_type="attests", detail=_json(src=F.col("pid"), dst=F.col("target_id"), converge=edge_old)),
    ))
    found = _unroll(live, ["call_no", "hit_no"], rows)
    turned = _unroll(refused, ["call_no", "hit_no"], F.array(_emit(
        "refused", node=F.coalesce(F.when(F.col("wid_status") == "rejected", F.col("wid")), F.col("pid")),
        detail=_json(attempted=F.lit("propose"), rule=F.lit("PersistentRejection"), message=F.col("ref")),
    )))
    who = attest_conflicts(nodes, node_authorship, agents, targets.select(F.col("authored_by").alias("agent_id")).distinct())
    tested = edges.filter("type = 'tests'").select(F.col("dst").alias("target_id")).distinct()
    # only the first call that reaches a target advances it; a call cut short by a refusal never gets there
    reached = live.filter("stop_at IS NULL").groupBy("target_id").agg(F.min(F.struct("call_no", "authored_by")).alias("c")).select("target_id", "c.*")
    ready = (
        reached.join(nodes.filter("status = 'proposed'").select(F.col("id").alias("target_id"), "type"), "target_id")
        .join(who.select(F.col("node_id").alias("target_id"), F.col("agent_id").alias("authored_by")), ["target_id", "authored_by"], "left_anti")
        .join(tested.withColumn("tested", F.lit(True)), "target_id", "left")
    )
    gate_ok = (F.col("type") == "claim") | ((F.col("type") == "conjecture") & F.col("tested").isNotNull())
    up = _unroll(
        ready.withColumn("hit_no", F.lit(k + 1)), ["call_no", "hit_no"],
        F.array(F.when(gate_ok, _emit("attest", node=F.col("target_id"), node_type=F.col("type"))).otherwise(
            _emit("refused", node=F.col("target_id"), node_type=F.col("type"), detail=_json(
                attempted=F.lit("attest"), rule=F.lit("UnattestableConjecture"), message=F.col("target_id")))
        )),
    )
    return found.unionByName(turned).unionByName(up)


# --- controls ------------------------------------------------------------------------------------------------
def tamper_control(nodes: DataFrame, docs: DataFrame, share: int = 10, pick: Column | None = None) -> DataFrame:
    """Negative control (V7): alter the excerpt of about one passage in `share` (or of chosen ones),
    recompute its hash, and re-check. The hashes must all look right, and exactly the altered spans must
    fail."""
    from vidimus.operators.projection import integrity_rows

    pick = F.pmod(F.xxhash64("id"), F.lit(share)) == 0 if pick is None else pick
    pick = (F.col("type") == "passage") & pick & (F.coalesce(F.get_json_object("payload", "$.excerpt"), F.lit("")) != "")
    # a private-use character no source text holds
    forged = F.to_json(F.transform_values(
        F.from_json("payload", "map<string,string>"),
        lambda key, old: F.when(key == "excerpt", F.concat(old, F.lit("\uf8ff"))).otherwise(old),
    ))
    tampered = nodes.withColumn("altered", pick).withColumn("payload", F.when(pick, forged).otherwise(F.col("payload")))
    tampered = tampered.withColumn("payload_hash", F.when(F.col("altered"), tx.sha256("payload")).otherwise(F.col("payload_hash")))
    spans = verify_spans(passages_of(tampered), docs).select("id", "result")
    hashes = integrity_rows(tampered).select("id", "integrity")
    return tampered.filter("type = 'passage'").select("id", "altered").join(spans, "id").join(hashes, "id")


def content_ledger(docs: DataFrame) -> DataFrame:
    """Hash of every input text; an input without text has the empty hash (V8)."""
    return docs.select("uid", F.coalesce(tx.sha256("text"), F.lit("")).alias("sha256"))


def fingerprint(ledger: DataFrame, method: str) -> DataFrame:
    """One key over all inputs and the method's constants, to name a table version by (V8).

    Rows are folded without an order (sums of hash parts), so no task sees the whole ledger."""
    row = F.sha2(F.concat_ws(":", "uid", "sha256"), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    folded = ledger.select(row.alias("h")).agg(F.count(F.lit(1)).alias("inputs"), *parts)
    return folded.select("inputs", F.sha2(F.concat_ws(":", F.lit(method), "inputs", *[f"p{i}" for i in range(8)]), 256).alias("fingerprint"))
