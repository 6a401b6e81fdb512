import random

from logs import attest, edge, propose, shift, verdict

from vidimus.operators import projection as pj
from vidimus.operators.census import refusal_streaks
from vidimus.streaming import log as st


def test_streaks_over_batches_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, rng.choice("ab"), rng.choice(["r1", "r2"]), rng.choice(["w", "x"]), None) for s in range(80)]
    ddl = "seq BIGINT, authored_by STRING, rule STRING, attempted STRING, node_id STRING"
    store = str(tmp_path / "s")
    for epoch, (lo, hi) in enumerate([(0, 30), (30, 31), (31, 31), (31, 80)]):
        for _ in range(2):  # a batch that is run again changes nothing
            st.streak_batch(spark.createDataFrame(rows[lo:hi], ddl), store, epoch, span=9)
    key = lambda df: {(r["authored_by"], r["rule"], r["count"], r["first_seq"], r["last_seq"], tuple(r["attempted"])) for r in df.collect()}
    assert key(st.stored_streaks(spark, store)) == key(refusal_streaks(spark.createDataFrame(rows, ddl)))


def test_streaks_over_late_and_repeated_batches_equal_the_whole_log(spark, tmp_path):
    rng = random.Random(8)
    rows = [(s, rng.choice("aab"), rng.choice(["r1", "r1", "r2"]), rng.choice(["w", "x", None]), rng.choice(["n1", None])) for s in range(120)]
    ddl = "seq BIGINT, authored_by STRING, rule STRING, attempted STRING, node_id STRING"
    key = lambda df: {(r["authored_by"], r["rule"], r["category"], r["count"], r["first_seq"], r["last_seq"], tuple(r["attempted"]), tuple(r["node_ids"])) for r in df.collect()}
    for span in (7, 1000):
        mixed = rng.sample(rows, len(rows))
        store = str(tmp_path / f"s{span}")
        for epoch, part in enumerate([mixed[:50], mixed[40:41], [], mixed[50:], mixed[:9]]):
            for _ in range(2):
                st.streak_batch(spark.createDataFrame(part, ddl), store, epoch, span=span)
        assert key(st.stored_streaks(spark, store)) == key(refusal_streaks(spark.createDataFrame(rows, ddl)))


def test_partial_folds_in_any_order_equal_a_replay(spark, log, tmp_path):
    ev = log(
        propose("witness", "w"), propose("passage", "p", witness="w"), propose("witness", "w", by="agent:z"), propose("claim", "c"), attest("passage:p"),
        edge("contradicts", "claim:c", "passage:p", id="edge:x"), shift("retract_edge", "edge:x"), verdict("reject", "claim:c"),
    )
    store = str(tmp_path / "g")
    for epoch, part in enumerate(["seq % 3 = 2", "seq % 3 = 0", "seq % 3 = 1"]):
        st.project_batch(ev.filter(part), store, epoch)
    assert pj.rebuild_diff(ev, *st.stored_graph(spark, store)).count() == 0
    st.compact(spark, store, str(tmp_path / "g2"))
    assert pj.rebuild_diff(ev, *st.stored_graph(spark, str(tmp_path / "g2"))).count() == 0
