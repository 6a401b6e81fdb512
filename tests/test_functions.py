import random

from pyspark.sql import functions as F

from vidimus.functions import frames as fr
from vidimus.functions import text as tx


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


def test_grams_count_code_points_and_overlap(spark):
    t = "a\U00020000b\nc"
    got = one(spark, tx.char_grams("t", (2, 3)), t=t)
    assert got == [t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1)]
    assert one(spark, tx.char_grams("t", (2,), tx.HAN), t="仁義,禮\U00020000智") == ["仁義", "禮\U00020000", "\U00020000智"]


def test_script_offsets_follow_the_original_text(spark):
    t = "甲,乙\U00020001\n丙"
    assert one(spark, tx.script_text("t"), t=t) == "甲乙\U00020001丙"
    assert one(spark, tx.script_offsets("t"), t=t) == [0, 2, 3, 5]
    assert one(spark, tx.script_count("t"), t=t) == 4


def test_space_and_markup(spark):
    assert one(spark, tx.strip_space("t"), t="　 \tx y \n") == "x y"
    assert one(spark, tx.strip_markup("t"), t=" a<b c='d'>  e\n</b>f ") == "a e f"
    assert one(spark, tx.fold("t"), t="Élan, Ölé 7!") == "elanole7"


def test_uniqueness_counts_overlaps(spark):
    assert one(spark, tx.is_unique_in("t", "n"), t="abab", n="aba") is True
    assert one(spark, tx.occurs_again("t", "n"), t="ababa", n="aba") is True


def test_references(spark):
    assert one(spark, tx.work_of("t"), t="T0150A-12") == "T0150"
    assert one(spark, tx.work_of("t"), t="T06030") is None
    assert one(spark, tx.entry_ref("t"), t="xml/T/T02/T02n0128a_001.xml") == "T02n0128a"
    assert one(spark, tx.t_number("t"), t="xml/T/T08/T08n0251_001.xml") == "251"
    assert one(spark, tx.reader_url("t"), t="T/T08/T08n0251_004.xml") == f"{tx.READER_BASE}/zh/T0251_004"
    assert one(spark, tx.reader_url("t"), t="T08n0251") == f"{tx.READER_BASE}/zh/T0251"
    assert one(spark, tx.reader_url("t"), t="poem.txt") is None
    assert one(spark, tx.unit_reader_url("t"), t="T0150-x.1") == f"{tx.READER_BASE}/zh/T0150"


def test_small_readings(spark):
    assert one(spark, tx.model_family("t"), t=" Deep/x ") == "deep"
    got = one(spark, tx.grounding_phrase("t"), t="grounding: 'a b' (3 hits)")
    assert (got["phrase"], got["hits"]) == ("a b", 3)
    assert one(spark, tx.elapsed_seconds("a", "b"), a="2024-01-01T00:00:00+00:00", b="2024-01-01T00:00:02.600+00:00") == 3


def test_ordered_scans_equal_a_plain_walk_for_any_chunk(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("xyz"), s, rng.choice([None, "p", "q"]), rng.randint(-2, 3)) for s in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k STRING, seq BIGINT, v STRING, n BIGINT")
    want = {}
    last, total = {}, {}
    for k, s, v, n in sorted(rows, key=lambda r: r[1]):
        total[k] = total.get(k, 0) + n
        want[(k, s)] = (last.get(k), total[k])
        last[k] = v if v is not None else last.get(k)
    for span in (5, 64, 1000):
        a = {(r["k"], r["seq"]): r["prev_v"] for r in fr.carry_forward(df, ["k"], "seq", ["v"], span).collect()}
        b = {(r["k"], r["seq"]): r["t"] for r in fr.running_total(df, ["k"], "seq", "n", "t", span).collect()}
        assert {x: (a[x], b[x]) for x in want} == want


def test_lower_percentile_is_the_floor_index(spark):
    rng = random.Random(3)
    rows = [(k, float(rng.randint(1, 9))) for k in "ab" for _ in range(rng.randint(5, 40))]
    got = {r["k"]: r["p"] for r in fr.lower_percentile(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], "v", 0.95, "p").collect()}
    for k in "ab":
        v = sorted(x for kk, x in rows if kk == k)
        assert got[k] == v[int(0.95 * (len(v) - 1))]


def test_multiset_diff_counts_copies(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "v STRING")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "v STRING")
    assert {(r["v"], r["side"], r["surplus"]) for r in fr.multiset_diff(a, b, ["v"]).collect()} == {("x", "mine", 1), ("z", "theirs", -1)}


def test_histories_later_source_wins(spark):
    mk = lambda rows: spark.createDataFrame(rows, "run_id STRING, state STRING")
    out = fr.merge_histories([mk([("1", "old"), ("2", "old")]), mk([("2", "new")])])
    assert {tuple(r) for r in out.collect()} == {("1", "old"), ("2", "new")}
