"""Short ways to write events in tests."""


def propose(kind, ref, by="agent:a", witness=None, **payload):
    d = {"payload": {"canonical_ref": ref, **payload}, "converge": False}
    e = {"event": "propose", "node_id": f"{kind}:{ref}", "node_type": kind, "authored_by": by, "detail": d}
    if witness:
        d["witness_id"] = f"witness:{witness}"
        e.update(edge_id=f"edge:{ref}", edge_type="part_of")
    return e


def attest(node, by="agent:b"):
    return {"event": "attest", "node_id": node, "authored_by": by}


def verdict(event, node, reason="because", by="researcher", n=[0]):
    n[0] += 1
    return {"event": event, "node_id": node, "authored_by": by, "detail": {"decision_node_id": f"decision:{n[0]}", "reason": reason}}


def edge(kind, src, dst, id=None, by="agent:a", **detail):
    return {"event": "add_edge", "edge_id": id or f"edge:{kind}:{src}:{dst}", "edge_type": kind, "authored_by": by, "detail": {"src": src, "dst": dst, **detail}}


def shift(event, id, reason="wrong", by="researcher"):
    return {"event": event, "edge_id": id, "authored_by": by, "detail": {"reason": reason}}


def verify(subject, method, result, level, id, **payload):
    return {"event": "verify", "node_id": f"verification:{id}", "node_type": "verification", "edge_id": f"edge:v{id}", "edge_type": "verifies",
            "detail": {"subject_node_id": subject, "payload": {"method": method, "result": result, "assurance_level": level, "detail": "d", **payload}}}


def agent(id, model=None):
    return {"event": "register_agent", "authored_by": "researcher", "detail": {"payload": {"id": id, "kind": "worker", "model": model}}}
