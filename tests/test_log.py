import random

import pytest
from logs import agent, attest, edge, propose, shift, verdict, verify
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.operators import audit as au
from vidimus.operators import census as ce
from vidimus.operators import evidence as evd
from vidimus.operators import projection as pj
from vidimus.sources import eventlog as el


def base():
    return [
        propose("witness", "w1"), propose("witness", "w2"), propose("passage", "p1", witness="w1"), propose("passage", "p2", witness="w2"),
        propose("claim", "c", text="it says"), attest("passage:p1"), attest("passage:p2"),
        edge("attests", "passage:p1", "claim:c"), edge("attests", "passage:p2", "claim:c"),
    ]


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_ladder_convergence_and_reasons(log):
    ev = log(*base(), attest("claim:c"), verdict("reject", "claim:c", "thin"), propose("witness", "w1", by="agent:z"), verdict("reopen", "claim:c", "again"))
    g = pj.project(ev)
    n = by_id(g.nodes)
    assert n["claim:c"]["status"] == "proposed" and n["claim:c"]["rejected_reason"] is None
    assert n["witness:w1"]["created_seq"] == 0 and n["witness:w1"]["updated_seq"] == 11 and n["witness:w1"]["status"] == "proposed"
    acts = {(r["node_id"], r["author"], r["action"]) for r in g.node_authorship.collect()}
    assert ("witness:w1", "agent:z", "converged") in acts and ("claim:c", "researcher", "rejected") in acts
    assert sum(r["type"] == "decision" and r["status"] == "accepted" for r in n.values()) == 2
    early = by_id(pj.project(log(*base(), verdict("reject", "claim:c", "thin"), attest("claim:c"))).nodes)
    assert early["claim:c"]["rejected_reason"] == "thin" and early["claim:c"]["status"] == "attested"


def test_parallel_flips_independence_and_retraction_restores_it(log):
    evs = [*base(), edge("parallel_of", "witness:w1", "witness:w2", id="edge:par")]
    g = pj.project(log(*evs))
    assert {r["id"] for r in g.edges.filter("type = 'parallel_of'").collect()} == {"edge:par", "edge:par:rev"}
    s = evd.independent_support(g.nodes, g.edges).first()
    assert (s["attesting_count"], s["distinct_witnesses"], s["independent"], s["non_independent_pairs"]) == (2, 2, False, 1)
    g = pj.project(log(*evs, shift("retract_edge", "edge:par:rev")))
    assert evd.independent_support(g.nodes, g.edges).first()["independent"] is True
    assert g.edges.filter("retracted_at IS NOT NULL").count() == 2
    assert g.edge_authorship.filter("action = 'retracted'").count() == 2
    g = pj.project(log(*evs, shift("retract_edge", "edge:par"), shift("restore_edge", "edge:par")))
    assert evd.independent_support(g.nodes, g.edges).first()["independent"] is False


def test_vacuous_support_is_said(log):
    g = pj.project(log(propose("conjecture", "c", text="maybe")))
    s = evd.independent_support(g.nodes, g.edges).first()
    assert s["vacuous"] and s["independent"] and s["attesting_count"] == 0


def test_assurance_is_latest_per_method(log):
    p = "passage:p1"
    evs = [*base(), verify(p, "exact_span", "pass", "A2_EXACT_SPAN_MATCHED", 1)]
    level = lambda *more: by_id(evd.assurance(*pj.project(log(*evs, *more))[:2]))[p]["assurance"]
    assert level() == "A2_EXACT_SPAN_MATCHED"
    assert level(verify(p, "exact_span", "fail", "A0_UNCHECKED", 2)) == "A0_UNCHECKED"
    assert level(verify(p, "cross_edition_collation", "pass", "A3_INDEPENDENCE_CHECKED", 3)) == "A3_EDITION_SUPPORT_CHECKED"


def test_review_state_takes_the_newest_review(log):
    say = lambda i, result, verdict_: verify("claim:c", "exact_span", result, "A0_UNCHECKED", i, limitations=f"reviewer verdict {verdict_}: hm")
    code = lambda *more: evd.review_state(*pj.project(log(*base(), *more))[:2]).first()["code"]
    assert code() == "unreviewed"
    assert code(say(1, "pass", "sound")) == "not_attested"
    assert code(say(1, "pass", "sound"), say(2, "pass", "unsound")) == "objected"
    assert code(say(1, "fail", "sound")) == "citation_failed"


def test_replay_equals_stored_and_tampering_shows(spark, log):
    ev = log(*base(), agent("agent:a", "m/x"), edge("contradicts", "passage:p1", "passage:p2", reason="differ"))
    g = pj.project(ev)
    assert pj.rebuild_diff(ev, *g).count() == 0
    bad = g.nodes.selectExpr("id", "type", "IF(id = 'claim:c', 'accepted', status) AS status", "payload", "payload_hash", "rejected_reason", "created_seq", "updated_seq")
    assert {r["side"] for r in pj.rebuild_diff(ev, bad, *g[1:]).collect()} == {"replay", "stored"}
    assert pj.integrity(g.nodes).first().asDict() == {"checked": 5, "mismatched": 0, "unhashed": 0}


def test_scan_keeps_payload_bytes_and_append_numbers_on(spark, log, tmp_path):
    lines = ['{"seq":0,"event":"ask","authored_by":"researcher","node_id":"question:q","detail":{"payload":{"b":null,"a":1.0}}}', "", "  ", '{"seq":1,"event":"guess","authored_by":"x"}']
    events, rejects = el.parse_lines(spark.createDataFrame([(x,) for x in lines], "value STRING"))
    assert pj.project(events).nodes.first()["payload"] == '{"b":null,"a":1.0}'
    assert [r["reason"] for r in rejects.collect()] == ["UnknownEventType"]
    path = str(tmp_path / "log")
    assert el.read_events(spark, path)[0].count() == 0
    el.append_events(log(*base()), path, order=["seq"], run_id="r1")
    el.append_events(log(attest("claim:c"), attest("claim:c")), path, order=["seq"])
    back = el.read_events(spark, path)[0].orderBy("seq").collect()
    assert [r["seq"] for r in back] == list(range(11)) and back[0]["run_id"] == "r1" and back[10]["run_id"] is None
    assert back[4]["node_id"] == "claim:c"


def refused(author, rule, attempted="attest", node=None):
    return {"event": "refused", "authored_by": author, "node_id": node, "detail": {"attempted": attempted, "rule": rule, "message": "m"}}


def test_streaks_are_within_one_author(log):
    ev = log(refused("a", "NodeNotFound", node="x"), refused("b", "RungSkipped"), refused("a", "NodeNotFound", "add_edge", "y"), refused("a", "NodeNotFound", node="x"), refused("a", "RungSkipped"))
    got = ce.refusal_streaks(ce.refusals(ev)).collect()
    assert len(got) == 1
    s = got[0]
    assert (s["authored_by"], s["count"], s["first_seq"], s["last_seq"], s["category"]) == ("a", 3, 0, 3, "expression")
    assert s["attempted"] == ["attest", "add_edge"] and s["node_ids"] == ["x", "y"]


def test_streaks_of_a_busy_author_do_not_depend_on_the_chunk(spark):
    rng = random.Random(1)
    rows = [(s, "hot" if rng.random() < 0.7 else "cold", rng.choice(["r1", "r1", "r2"]), "w", None) for s in range(300)]
    df = spark.createDataFrame(rows, "seq BIGINT, authored_by STRING, rule STRING, attempted STRING, node_id STRING")
    want = set()
    for who in ("hot", "cold"):
        run = []
        for s, _, rule, *_ in [*(r for r in rows if r[1] == who), (None, None, None)]:
            if run and rule != run[0][1]:
                if len(run) > 1:
                    want.add((who, run[0][1], len(run), run[0][0]))
                run = []
            run.append((s, rule))
    for span in (7, 10_000):
        assert {(r["authored_by"], r["rule"], r["count"], r["first_seq"]) for r in ce.refusal_streaks(df, span=span).collect()} == want


def test_empty_census_has_every_category(log):
    got = {r["value"]: r["n"] for r in ce.refusal_census(ce.refusals(log(attest("x")))).collect()}
    assert got == {"evidence": 0, "standing": 0, "expression": 0, "operational": 0, "unclassified": 0}


def rules(df):
    return {r["seq"]: r["rule"] for r in df.collect()}


def test_clean_log_has_no_violation(log):
    assert rules(au.audit(log(*base(), attest("claim:c"), verdict("accept", "claim:c", None)))) == {}


CASES = [
    ([attest("claim:c", by="agent:a")], "SelfAttestation"),
    ([agent("agent:a", "Fam/x"), agent("agent:k", "fam/y"), attest("claim:c", by="agent:k")], "ReviewerNotIndependent"),
    ([agent("agent:a", "fam/x"), agent("agent:k", "fam/y"), agent("agent:a", "other/x"), attest("claim:c", by="agent:k")], None),
    ([attest("claim:c"), attest("claim:c", by="agent:d")], "RungSkipped"),
    ([attest("nothing:x")], "NodeNotFound"),
    ([propose("claim", "d"), attest("claim:d")], "UnattestableClaim"),
    ([propose("conjecture", "d"), attest("conjecture:d")], "UnattestableConjecture"),
    ([propose("passage", "d"), attest("passage:d")], "EdgeEndpointMissing"),
    ([verdict("accept", "claim:c", by="agent:b")], "NotResearcher"),
    ([verdict("reject", "claim:c", reason=" ")], "MissingRejectionReason"),
    ([verdict("reopen", "claim:c")], "RungSkipped"),
    ([verdict("reject", "witness:w1"), propose("witness", "w1")], "PersistentRejection"),
    ([edge("attests", "passage:p1", "passage:p1")], "EdgeSelfLoop"),
    ([edge("attests", "passage:p1", "claim:zz")], "EdgeEndpointMissing"),
    ([edge("attests", "witness:w1", "claim:c")], "EdgeDomainViolation"),
    ([edge("contradicts", "witness:w1", "claim:c")], "ValidationError"),
    ([edge("parallel_of", "witness:w1", "witness:w2", id="edge:par"), shift("retract_edge", "edge:par"), edge("parallel_of", "witness:w2", "witness:w1", id="edge:par2")], "PersistentRetraction"),
    ([edge("parallel_of", "witness:w1", "witness:w2", id="edge:par"), edge("parallel_of", "witness:w1", "witness:w2", id="edge:par", converge=True)], None),
    ([shift("retract_edge", "edge:none")], "EdgeNotFound"),
    ([shift("restore_edge", "edge:p1")], "EdgeAlreadyRetracted"),
    ([{"event": "ask", "node_id": "question:q", "detail": {"payload": {"text": "?"}}}], "NotResearcher"),
    ([verify("claim:c", "human_review", "pass", "A4_HUMAN_APPROVED", 9)], "NotResearcher"),
    ([{"event": "attest"}], "MalformedEvent"),
]


def apart(x, i):
    """The same events about nodes, edges and agents of their own."""
    if isinstance(x, dict):
        return {k: apart(v, i) for k, v in x.items()}
    if isinstance(x, str) and ":" in x and x.split(":")[0] in ("witness", "passage", "claim", "conjecture", "edge", "question", "verification", "decision", "agent"):
        return f"{x[:-4]}~{i}:rev" if x.endswith(":rev") else f"{x}~{i}"
    return x


def test_each_rule(log):
    """Every rule once, all in one log; each case has its own nodes and is judged at its last event."""
    evs, last = [], []
    for i, (more, _) in enumerate(CASES):
        evs += [apart(e, i) for e in [*base(), *more]]
        last.append(len(evs) - 1)
    got = rules(au.audit(log(*evs), span=50))
    want = {}
    for i, (more, rule) in enumerate(CASES):
        if more[0]["event"] == "propose" and rule == "EdgeEndpointMissing":
            want[last[i] - 1], rule = rule, "PassageNotLocated"
        if rule:
            want[last[i]] = rule
    assert {k: got.get(k) for k in want} == want
    assert not [k for k in last if k in got and k not in want]


def test_support_is_read_as_of_the_attest(log):
    # a passage stands only for a while; the retracted edge still counts, as at the write boundary
    start = [propose("witness", "w"), propose("passage", "p", witness="w"), propose("claim", "c"), edge("attests", "passage:p", "claim:c", id="edge:x")]
    never = [*start, attest("claim:c")]
    stands = [*start, attest("passage:p"), shift("retract_edge", "edge:x"), attest("claim:c")]
    gone = [*start, attest("passage:p"), verdict("reject", "passage:p"), attest("claim:c")]
    evs, ends = [], []
    for i, case in enumerate((never, stands, gone)):
        evs += [apart(e, i) for e in case]
        ends.append(len(evs) - 1)
    assert rules(au.audit(log(*evs))) == {ends[0]: "UnattestableClaim", ends[2]: "UnattestableClaim"}


def test_batch_admission_is_layered(log):
    state = log(*base())
    batch = log(attest("claim:new"), propose("claim", "new", by="agent:q"), edge("attests", "passage:p1", "claim:new"), edge("attests", "passage:p1", "claim:lost"), start=100)
    admitted, refused_ = au.admit(state, batch)
    assert {r["seq"] for r in admitted.collect()} == {101, 102}
    assert rules(refused_) == {100: "NodeNotFound", 103: "EdgeEndpointMissing"}


def test_refused_proposals_leave_no_trace(log):
    # the attest by the claim's own author is refused, so the next one is the first and holds
    state = log(*base())
    own, other = attest("claim:c", by="agent:a"), attest("claim:c", by="agent:b")
    batch = log(own, other, attest("claim:c", by="agent:b"), start=100)
    admitted, refused_ = au.admit(state, batch)
    assert {r["seq"] for r in admitted.collect()} == {101}
    assert set(rules(refused_)) == {100, 102}


def test_proposals_are_judged_in_their_own_order(log):
    state = log(*base())
    batch = log(propose("claim", "x"), propose("passage", "p9", witness="none"), edge("attests", "passage:p9", "claim:x"), propose("claim", "y"), start=100)
    admitted, refused_ = au.admit(state, batch)
    # the passage names no witness that exists, so the edge from it has no source
    assert {r["seq"] for r in admitted.collect()} == {100, 103}
    assert set(rules(refused_)) == {101, 102}


def test_hidden_question_takes_what_only_it_holds(spark):
    n = spark.createDataFrame([(i, i.split(":")[0]) for i in ["question:1", "question:2", "claim:a", "claim:b", "passage:p", "passage:s", "witness:w", "witness:v", "query:lone"]], "id STRING, type STRING")
    e = spark.createDataFrame([
        ("addresses", "claim:a", "question:1"), ("addresses", "claim:b", "question:2"), ("attests", "passage:p", "claim:a"), ("attests", "passage:s", "claim:a"),
        ("attests", "passage:s", "claim:b"), ("part_of", "passage:p", "witness:w"), ("part_of", "passage:s", "witness:v")], "type STRING, src STRING, dst STRING")
    got = {r["id"] for r in evd.hide_questions(n, e, spark.createDataFrame([("question:1",)], "id STRING")).collect()}
    assert got == {"question:1", "claim:a", "passage:p", "witness:w"}


def test_snapshot_commits_by_its_manifest(spark, log, tmp_path):
    from vidimus.sources import artifacts as ar
    from vidimus.sources.corpus import SourceError

    ev = log(propose("witness", "w"), propose("passage", "p", witness="w"), propose("claim", "c"), attest("passage:p"), edge("contradicts", "claim:c", "passage:p", id="edge:x"))
    graph = pj.project(ev)
    dest = str(tmp_path / "snap")
    with pytest.raises(SourceError, match="no complete snapshot"):
        ar.read_snapshot(spark, dest)
    wrong = {**graph._asdict(), "nodes": graph.nodes.filter("id <> 'claim:c'")}
    with pytest.raises(SourceError, match="does not replay"):
        ar.snapshot(wrong, ev, dest)
    assert len(ar.stale_stages(spark, dest)) == 1
    manifest = ar.snapshot(graph._asdict(), ev, dest)
    assert {r["table"] for r in manifest.collect()} == {*graph._fields, "events"} and len(ar.stale_stages(spark, dest)) == 1
    tables, checked = ar.read_snapshot(spark, dest)
    assert all(r["intact"] for r in checked.collect()) and tables["events"].count() == 5
    with pytest.raises(SourceError, match="already"):
        ar.snapshot(graph._asdict(), ev, dest)
    stage = manifest.first()["stage"]
    spark.read.parquet(f"{dest}/{stage}/agents").unionByName(tables["agents"].limit(1)).write.parquet(f"{dest}/other")
    changed = tables["nodes"].withColumn("status", F.lit("accepted"))
    changed.write.parquet(f"{dest}/changed")
    spark.read.parquet(f"{dest}/changed").write.mode("overwrite").parquet(f"{dest}/{stage}/nodes")
    assert {r["table"]: r["intact"] for r in ar.read_snapshot(spark, dest)[1].collect()}["nodes"] is False


def test_a_hub_is_many_pages(spark):
    n = 100_000
    edges = spark.range(n).select(
        F.concat(F.lit("edge:"), "id").alias("id"), F.lit("attests").alias("type"), F.concat(F.lit("passage:"), F.col("id") % 5000).alias("src"), F.lit("claim:hub").alias("dst"),
        ((F.col("id") * 7919) % n).alias("created_seq"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("retracted_at"), F.lit(None).cast("string").alias("retracted_reason"))
    want = spark.createDataFrame([("claim:hub",), ("passage:7",), ("claim:none",)], "id STRING")
    pages = pj.edge_pages(edges, want, size=300, span=1000).collect()
    hub = sorted((r for r in pages if r["id"] == "claim:hub"), key=lambda r: r["page"])
    assert {r["side"] for r in hub} == {"in"} and [r["page"] for r in hub] == list(range(334)) and all(len(r["edges"]) == 300 for r in hub[:-1])
    assert [e["created_seq"] for r in hub for e in r["edges"]] == list(range(n))
    assert [(r["side"], r["page"], len(r["edges"])) for r in pages if r["id"] == "passage:7"] == [("out", 0, 20)]


def test_admission_reads_only_what_bears_on_the_batch(spark, log, monkeypatch):
    other = [propose("witness", "far"), propose("passage", "far", witness="far"), propose("claim", "far", text="no"), attest("passage:far"), edge("attests", "passage:far", "claim:far")]
    ev = log(agent("agent:a", model="fam/x"), agent("agent:b", model="fam/y"), agent("agent:c", model="other/z"), *base(), *other)
    ask = log(
        attest("claim:c", by="agent:b"), attest("claim:c", by="agent:c"), attest("claim:far", by="agent:b"), edge("attests", "passage:p1", "claim:none"), propose("claim", "new", text="x"),
        edge("attests", "passage:p1", "claim:new"), attest("claim:new", by="agent:c"), shift("retract_edge", "edge:none"), start=100)
    seqs = {r["seq"] for r in au.bearing(ev, ask.filter("seq = 101")).collect()}
    assert 0 < len(seqs) < ev.count() and not seqs & {r["seq"] for r in ev.filter("node_id LIKE '%far'").collect()}

    def judged():
        admitted, refused_ = au.admit(ev, ask)
        return sorted(r["seq"] for r in admitted.collect()), sorted((r["seq"], r["rule"], r["message"]) for r in refused_.collect())

    near = judged()
    monkeypatch.setattr(au, "bearing", lambda whole, batch: whole)
    assert near == judged() and near[0] and near[1]


def _small_graph(spark):
    """Two claims; passages linked to a passage, to a witness and by their witnesses; one edge withdrawn."""
    edge = "id STRING, type STRING, src STRING, dst STRING, created_seq BIGINT, reason STRING, retracted_at STRING, retracted_reason STRING"
    rows = [("attests", "passage:a", "claim:1"), ("attests", "passage:b", "claim:1"), ("attests", "passage:b", "claim:1"), ("attests", "passage:c", "claim:1"), ("attests", "passage:c", "claim:2"),
            ("part_of", "passage:a", "witness:x"), ("part_of", "passage:b", "witness:y"), ("part_of", "passage:c", "witness:x"), ("addresses", "claim:1", "question:q"), ("addresses", "claim:2", "question:q"),
            ("parallel_of", "passage:a", "passage:b"), ("parallel_of", "passage:b", "passage:a"), ("descends_from", "witness:y", "witness:x"), ("descends_from", "passage:c", "witness:y"),
            ("verifies", "verification:v", "claim:1"), ("verifies", "verification:w", "passage:a")]
    edges = spark.createDataFrame([(f"e{i}", t, a, b, i, None, None, None) for i, (t, a, b) in enumerate(rows)] + [("gone", "attests", "passage:a", "claim:2", 99, None, "later", "")], edge)
    check = '{"method": "exact_span", "result": "pass", "assurance_level": "A2_EXACT_SPAN_MATCHED"}'
    names = ["claim:1", "claim:2", "claim:3", "question:q", "passage:a", "passage:b", "passage:c", "witness:x", "witness:y", "verification:v", "verification:w"]
    rows = [(n, n.split(":")[0], "proposed", check if n.startswith("v") else '{"text": "t"}', None, i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id STRING, type STRING, status STRING, payload STRING, rejected_reason STRING, created_seq BIGINT"), edges


def test_support_with_links_at_passages_and_witnesses(spark):
    nodes, edges = _small_graph(spark)
    got = {r["id"]: (r["attesting_count"], r["distinct_witnesses"], r["non_independent_pairs"], r["independent"], r["vacuous"]) for r in evd.independent_support(nodes, edges).collect()}
    assert got == {"claim:1": (3, 2, 3, False, False), "claim:2": (1, 1, 0, True, False), "claim:3": (0, 0, 0, True, True)}


def test_checks_are_read_once_and_only_where_asked(spark):
    nodes, edges = _small_graph(spark)
    plan = lambda df: df._jdf.queryExecution().toString()
    tally = evd.question_tally(nodes, edges)
    assert "exact_span" not in plan(tally) and "assurance_level" not in plan(tally)  # counts no assurance
    assert [(r["proposed"], r["unsupported"], r["discounted"]) for r in tally.collect()] == [(2, 0, 1)]
    authors = spark.createDataFrame([("claim:1", "agent:a", "proposed", 0)], "node_id STRING, author STRING, action STRING, seq BIGINT")
    found = evd.findings(nodes, edges, authors)
    assert "verifies" not in plan(found)  # comes from one written table
    assert {r["id"]: r["assurance"] for r in found.collect()} == {"claim:1": "A2_EXACT_SPAN_MATCHED", "claim:2": "A0_UNCHECKED", "claim:3": "A0_UNCHECKED"}


def test_what_dossiers_cite_is_read_once(spark):
    nodes, edges = _small_graph(spark)
    made = evd.dossier(nodes, edges, nodes.filter("type = 'claim'").select("id"))
    plan = made._jdf.queryExecution().toString()
    assert "verifies" not in plan and "part_of" not in plan  # both come from written tables
    rows = {r["id"]: r for r in made.collect()}
    got = sorted((e["passage_id"], e["witness_id"], e["assurance"]) for e in rows["claim:1"]["evidence"])
    assert got == [("passage:a", "witness:x", "A2_EXACT_SPAN_MATCHED"), *[("passage:b", "witness:y", "A0_UNCHECKED")] * 2, ("passage:c", "witness:x", "A0_UNCHECKED")]
    assert [c["verification_id"] for c in rows["claim:1"]["latest_verifications"]] == ["verification:v"] and rows["claim:3"]["evidence"] is None


def test_payloads_are_read_before_nodes_move(spark):
    """Payloads of nodes nobody asked for used to go through the shuffles that look nodes up."""
    nodes, edges = _small_graph(spark)
    authors = spark.createDataFrame([("claim:1", "agent:a", "proposed", "t0", 0)], "node_id STRING, author STRING, action STRING, at STRING, seq BIGINT")
    plan = evd.verifications(nodes, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" in plan[plan.index("Join"):] and "get_json_object" not in plan[: plan.index("Join")]
    claims = nodes.filter("type = 'claim'")
    assert "Join" not in evd.wanted(nodes, claims)._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(evd.dossier(nodes, edges, claims)) == rows(evd.dossier(nodes, edges, claims.select("id")))
    nodes = nodes.withColumn("updated_seq", F.col("created_seq"))
    claims = nodes.filter("type = 'claim'")
    assert rows(pj.node_detail(nodes, edges, authors, claims)) == rows(pj.node_detail(nodes, edges, authors, claims.select("id")))


def test_rebuild_diff_compares_written_tables(log):
    """The replay is written before it is compared, so one task does not hold fold, join and comparison."""
    ev = log(*base(), edge("contradicts", "passage:p1", "passage:p2", reason="differ"))
    stored = pj.Graph(*map(cut_lineage, pj.project(ev)))
    diff = pj.rebuild_diff(ev, *stored)
    assert "get_json_object" not in diff._jdf.queryExecution().optimizedPlan().toString()
    assert diff.count() == 0


def test_admission_sends_no_growing_table_through_the_driver(spark, log, monkeypatch):
    # every table here is far below the broadcast threshold
    state = log(*base(), edge("contradicts", "claim:c", "passage:p2", id="edge:x", reason="differ"))
    batch = log(attest("claim:c", by="agent:a"), attest("claim:c", by="agent:b"), propose("claim", "new"), edge("attests", "passage:p1", "claim:new"), shift("retract_edge", "edge:x"), start=100)
    plans = []

    def written(df):
        out = cut_lineage(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(au, "cut_lineage", written)
    admitted, refused_ = au.admit(state, batch)
    assert {r["seq"] for r in admitted.collect()} == {101, 102, 103, 104} and rules(refused_) == {100: "SelfAttestation"}
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
