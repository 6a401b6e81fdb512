"""Table schemas and the closed vocabularies the jobs check against.

Every list below is a set of fixed values: stored data carries these strings, so they may not be
renamed here.
"""

EVENT_DDL = (
    "seq BIGINT, event STRING, authored_by STRING, at STRING, node_id STRING, edge_id STRING, "
    "node_type STRING, edge_type STRING, detail STRING, run_id STRING, model_call_id BIGINT, "
    "model STRING, provider STRING, prompt_version STRING, latency_ms BIGINT, "
    "input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE"
)
NODE_DDL = (
    "id STRING, type STRING, status STRING, payload STRING, payload_hash STRING, "
    "rejected_reason STRING, created_seq BIGINT, updated_seq BIGINT"
)
EDGE_DDL = (
    "id STRING, type STRING, src STRING, dst STRING, created_seq BIGINT, reason STRING, "
    "retracted_at STRING, retracted_reason STRING"
)
NODE_AUTHORSHIP_DDL = "node_id STRING, author STRING, action STRING, at STRING, seq BIGINT"
EDGE_AUTHORSHIP_DDL = "edge_id STRING, author STRING, action STRING, at STRING, seq BIGINT"
AGENT_DDL = (
    "id STRING, kind STRING, corpus_scope STRING, method_label STRING, model STRING, created_seq BIGINT"
)

RESEARCHER = "researcher"

# --- fixed values: vocabularies -------------------------------------------------------------
NODE_TYPES = ("witness", "passage", "claim", "conjecture", "query", "question", "decision", "verification")
EDGE_TYPES = (
    "attests", "contradicts", "parallel_of", "descends_from", "quotes", "tests", "supersedes",
    "part_of", "verifies", "addresses", "searched_for",
)
STATUSES = ("proposed", "attested", "accepted", "rejected")
EVENT_TYPES = (
    "propose", "attest", "accept", "reject", "reopen", "add_edge", "retract_edge", "restore_edge",
    "verify", "ask", "register_agent", "refused", "model_call", "tool_action", "tool_result",
    "analysis", "run_started", "run_finished",
)
AUDIT_ONLY_EVENTS = (
    "refused", "model_call", "tool_action", "tool_result", "analysis", "run_started", "run_finished",
)
ASSURANCE_LEVELS = (
    "A0_UNCHECKED", "A1_LOCATOR_VALID", "A2_EXACT_SPAN_MATCHED", "A3_EDITION_SUPPORT_CHECKED",
    "A4_HUMAN_APPROVED",
)
ASSURANCE_ALIASES = {"A3_INDEPENDENCE_CHECKED": "A3_EDITION_SUPPORT_CHECKED"}
SYMMETRIC_EDGE_TYPES = ("contradicts", "parallel_of")
DISCOUNT_EDGE_TYPES = ("descends_from", "parallel_of")
NOT_CITABLE_TYPES = ("decision", "verification", "question")
REVIEWABLE_TYPES = ("claim", "conjecture")
CONTRADICTABLE_TYPES = ("claim", "conjecture", "passage", "witness")
VERIFIABLE_TYPES = ("claim", "conjecture", "passage", "witness")
DOSSIER_FIELDS = ("derivation", "corpus_boundary", "selection_risks", "alternative_explanations")

# --- fixed values: which node types an edge type may join ("any" and "same_type" are rules) ---
EDGE_DOMAINS = {
    "attests": [("passage", "claim"), ("passage", "conjecture")],
    "contradicts": "any",
    "parallel_of": [("passage", "passage"), ("witness", "witness")],
    "descends_from": [("passage", "passage"), ("witness", "witness")],
    "quotes": [("passage", "passage")],
    "tests": [("query", "conjecture")],
    "addresses": [("claim", "question"), ("conjecture", "question")],
    "supersedes": "same_type",
    "part_of": [("passage", "witness")],
    "verifies": [
        ("verification", "claim"), ("verification", "conjecture"), ("verification", "passage"),
        ("verification", "witness"),
    ],
    "searched_for": [("query", "conjecture"), ("query", "claim")],
}

# --- fixed values: refusal rule name -> category ----------------------------------------------
REFUSAL_CATEGORIES = ("evidence", "standing", "expression", "operational", "unclassified")
RULE_CATEGORY = {
    "UnattestableClaim": "evidence",
    "UnattestableConjecture": "evidence",
    "PassageNotLocated": "evidence",
    "UngroundedClaim": "evidence",
    "NotResearcher": "standing",
    "SelfAttestation": "standing",
    "ReviewerNotIndependent": "standing",
    "RungSkipped": "standing",
    "PersistentRejection": "standing",
    "PersistentRetraction": "standing",
    "EdgeAlreadyRetracted": "standing",
    "NodeNotFound": "expression",
    "EdgeNotFound": "expression",
    "EdgeEndpointMissing": "expression",
    "EdgeSelfLoop": "expression",
    "EdgeDomainViolation": "expression",
    "MissingRejectionReason": "expression",
    "WrongNodeType": "expression",
    "InvalidVerdict": "expression",
    "UnitNotInCorpus": "expression",
    "ValidationError": "expression",
    "NoEventLog": "operational",
    "RebuildMismatch": "operational",
    "SingleWriterViolation": "operational",
    "UnknownEventType": "operational",
    "SourceRefMissing": "operational",
}
