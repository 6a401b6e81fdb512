import difflib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidimus.functions import runs
from vidimus.functions import text as tx
from vidimus.operators import attribution as at
from vidimus.operators import similarity as si
from vidimus.operators import spans as sp
from vidimus.operators import xref as xr
from vidimus.sources import catalogue as cat
from vidimus.sources import corpus as co


def docs_of(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "doc STRING, body STRING")


def test_citable_spans_are_unique_in_the_raw_body(spark):
    d = docs_of(spark, a="<lb n='1'/>色即是空<lb/>空即是色<lb/>空<lb/>12<lb/>是色<lb/>色即是空", b="如是我聞<p>\n 一時佛在 </p>")
    spans, ledger = sp.citable_spans(d)
    assert {(r["doc"], r["span"]) for r in spans.collect()} == {("a", "空即是色"), ("b", "如是我聞"), ("b", "一時佛在")}
    assert {r["outcome"]: r["runs"] for r in ledger.collect()} == {"citable": 3, "too_short": 2, "not_unique": 2}
    rep = sp.span_report(d).first()
    assert (rep["entries_indexed"], rep["runs_indexed"], rep["runs_not_unique"], rep["runs_too_short"]) == (2, 3, 2, 2)
    # every span can be fetched again
    cites = spans.select("doc", F.col("span").alias("excerpt"))
    assert {r["status"] for r in sp.locate_spans(cites, d).collect()} == {"located"}


def test_phrase_search_equals_containment(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    qs = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(30)] + ["  "]
    d = spark.createDataFrame(list(enumerate(texts)), "doc BIGINT, span STRING")
    q = spark.createDataFrame(list(enumerate(qs)), "query_id BIGINT, query STRING")
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(qs) if x.strip() and x in t}
    pairs = lambda df: {(r["doc"], r["query_id"]) for r in df.collect()}
    assert pairs(sp.match_phrases(d, "span", q)) == want


def test_prediction_floor_decides_only_what_a_floor_can(spark):
    from vidimus.operators.verify import prospective

    s = spark.createDataFrame([(i, 0, "needle") for i in range(5)], "doc BIGINT, span_no INT, span STRING")
    p = spark.createDataFrame([
        ("c1", 1, "needle", "at_most", 2), ("c2", 2, "needle", "at_most", 4), ("c3", 3, "needle", "at_least", 3), ("c4", 4, "needle", "at_least", 9), ("c5", 5, "none", "at_most", 0), ("c6", 6, "needle", None, None),
    ], "conjecture_id STRING, query_id BIGINT, query STRING, expectation STRING, expected_hits BIGINT")
    got = lambda cap: {r["conjecture_id"]: r["result"] for r in prospective(p, s, cap).collect()}
    assert got(None) == {"c1": "fail", "c2": "fail", "c3": "pass", "c4": "fail", "c5": "pass", "c6": "indeterminate"}
    assert got(3) == {"c1": "fail", "c2": "indeterminate", "c3": "pass", "c4": "indeterminate", "c5": "pass", "c6": "indeterminate"}


@pytest.mark.parametrize("inside, want", [
    ("Nos. 12, 13", {"asserted": ["12", "13"]}),
    ("cf. No. 40", {"compare_only": ["40"]}),
    ("Nos. 7, 8; cf. Nos. 10-12, 20", {"asserted": ["7", "8"], "compare_only": ["10", "11", "12", "20"]}),
    ("Nos. 30(4), 31 (5.2), 32", {"asserted": ["30/4", "31/5.2", "32"]}),
    ("Part of No. 9(3), 10", {"part_of": ["9/3", "10"]}),
    ("cf. No. 88B", {"compare_only": ["88B"]}),
    ("No. 5, <lb n='1'/> No. 6", {"asserted": ["5", "6"]}),
    ("Nos. 5, 6; 經卷", {"asserted": ["5", "6"]}),
    ("~M. 3 sutta", {"unparsed": ["~M. 3 sutta"]}),
    ("Nos. 9-5", {"unparsed": ["Nos. 9-5"]}),
    ("Nos. 1-900", {"unparsed": ["Nos. 1-900"]}),
    ("No. 5(2-3)", {"asserted": ["5/2-3", "2", "3"]}),
    ("No. 5] [No. 5, 6", {"asserted": ["5", "6"]}),
    ("", {}),
])
def test_reference_lists(spark, inside, want):
    d = docs_of(spark, x=f"<cb:docNumber>No. 99 [{inside}]</cb:docNumber>")
    got = {}
    for r in xr.extract_refs(d).orderBy("bucket", "ord").collect():
        got.setdefault(r["bucket"], []).append(r["number"] + (f"/{r['sub_ref']}" if r["sub_ref"] else ""))
    assert got == want
    assert xr.self_numbers(d).first()["self_number"] == "99"


def test_apparatus_keeps_joint_groups(spark):
    body = '<app n="1"><lem wit="【大】">甲</lem><rdg wit="【宋】 【元】" resp="Taisho">乙<g/> 丙</rdg></app><app n="2"><rdg wit="A B">x</rdg><lem resp="CBETA.y">z</lem><lem>w</lem></app><app></app>'
    rows = xr.extract_apparatus(docs_of(spark, d=body)).orderBy("app", "ord").collect()
    assert [(r["n"], r["kind"], r["sigla"], r["text"], r["resp"]) for r in rows] == [
        ("1", "lemma", ["【大】"], "甲", None), ("1", "variant", ["【宋】", "【元】"], "乙 丙", "Taisho"), ("2", "variant", ["A", "B"], "x", None),
        ("2", "lemma", [], "z", "CBETA.y"), ("2", "variant", [], "w", None), (None, None, None, None, None)]
    w = spark.createDataFrame([("w1", "d"), ("w2", None), ("w3", "other")], "witness_id STRING, doc STRING")
    got = {r["witness_id"]: (r["finding"], r["entries"], r["joint_groups"], r["editorial_lemmas"]) for r in xr.collate(w, xr.extract_apparatus(docs_of(spark, d=body))).collect()}
    assert got == {"w1": ("collated", 3, "A B, 【宋】 【元】", 1), "w2": ("no source", 0, "", 0), "w3": ("no apparatus", 0, "", 0)}


def test_runs_within_a_row_equal_a_walk_over_all_places():
    rng = random.Random(12)
    for letters in ("a", "ab", "xyz", "abcdefgh天😀"):
        for _ in range(60):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2))
            least = rng.randint(1, 6)
            want = set()
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= least:
                            want.add((i, j, n))
            got = list(zip(*(x.tolist() for x in runs.maximal_runs(a, b, least))))
            assert len(got) == len(set(got)) and set(got) == want
            grams = [{t[i : i + least] for i in range(len(t) - least + 1)} for t in (a, b)]
            assert runs.shared_grams(a, b, least) == (len(grams[0] & grams[1]), len(grams[0]), len(grams[1]))
    assert len(runs.maximal_runs("a" * 20_000, "a" * 20_000, 12)[0]) == 2 * (20_000 - 11) - 1  # one run a diagonal, not a row for each pair of places


def test_selected_blocks_equal_a_sequence_matcher():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ("".join(rng.choice("xyz") for _ in range(rng.randint(0, 30))) for _ in range(2))
        least = rng.randint(2, 4)
        runs = []
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if n >= least:
                        runs.append((i, j, n))
        want = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]
        assert si.pick_blocks(runs, least) == want


def test_shared_runs_cross_punctuation_with_original_offsets(spark):
    quote = "天地玄黃宇宙洪荒日月盈昃辰宿列張"
    d = spark.createDataFrame([("a", "序曰" + quote[:6] + "，\n" + quote[6:] + "完"), ("b", "又" + quote[:10] + "。" + quote[10:] + "終")], "uid STRING, text STRING")
    ask = spark.createDataFrame([("a", "b")], "uid_a STRING, uid_b STRING")
    r = si.shared_runs(d, ask, min_run=12).collect()
    assert len(r) == 1 and r[0]["text"] == quote and r[0]["chars"] == 16
    assert (r[0]["a_start"], r[0]["a_end"], r[0]["b_start"], r[0]["b_end"]) == (2, 20, 1, 18)
    c = si.coverage(d, ask).first()
    assert (c["shared"], c["share_of_a_in_b"]) == (7, round(7 / 10, 4))


def test_segments_merge_and_clip(spark):
    w = spark.createDataFrame([("k", 10, "abcdefghij")], "key STRING, start BIGINT, text STRING")
    runs = spark.createDataFrame([("k", 5, 12), ("k", 12, 14), ("k", 17, 99)], "key STRING, run_start BIGINT, run_end BIGINT")
    got = [(r["text"], r["shared"], r["start"]) for r in sp.segments(runs, w).orderBy("ord").collect()]
    assert got == [("abcd", True, 10), ("efg", False, 14), ("hij", True, 17)]


@pytest.mark.parametrize("block, pivots", [(8, 1024), (16, 3), (512, 1024)])
def test_pruned_neighbours_equal_brute_force(spark, block, pivots, monkeypatch):
    monkeypatch.setattr(si, "PIVOTS", pivots)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6))
    v = np.concatenate([c + 0.15 * rng.normal(size=(20, 6)) for c in centres] + [np.tile(centres[0], (30, 1))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    work = [f"w{i % 7}" for i in range(len(v))]
    rows = [(i, f"u{i // 5}", work[i], "grey" if i % 4 == 0 else "L", i % 5 * 10, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "idx BIGINT, uid STRING, work STRING, label STRING, start INT, vec ARRAY<FLOAT>")
    cos = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 12)
    for labelled in (False, True):
        want = set()
        for i in range(len(v)):
            ok = [j for j in range(len(v)) if work[j] != work[i] and not (labelled and j % 4 == 0)]
            for rank, j in enumerate(sorted(ok, key=lambda j: (-cos[i, j], j))[:4], 1):
                want.add((i, j, rank))
        got = {(r["idx"], r["near_idx"], r["rank"]) for r in si.nearest_indices(df, 4, labelled_only=labelled, block=block).collect()}
        assert got == want


def test_scores_equal_a_direct_count_with_own_work_withheld(spark):
    rng = random.Random(9)
    rows = []
    for i in range(24):
        label = ("A", "B", "C", None)[i % 4]
        letters = {"A": "abcd", "B": "cdef", "C": "ghij", None: "abcdefgh"}[label]
        rows.append((i, label, f"w{i % 5}", "".join(rng.choice(letters) for _ in range(60))))
    rows.append((99, None, "w0", "!!!!"))
    units = spark.createDataFrame(rows, "uid BIGINT, label STRING, work STRING, text STRING")
    kept = at.select_units(units, min_chars=10, min_units=2, cls=tx.LETTER)
    marks = ["ab", "cd", "ef", "abc", "cde", "gh", "zz"]
    vocab = spark.createDataFrame([("curated", g) for g in marks], "feature_set STRING, gram STRING")
    counts = at.unit_gram_counts(units, vocab)
    hits = at.target_hits(units, counts, ["curated"])
    got = {(r["uid"], r["label"]): r["score"] for r in at.score(hits, counts, at.build_profiles(counts, kept, vocab)).collect()}

    def tally(text):
        return {g: n for g in marks if (n := sum(text.startswith(g, i) for i in range(len(text))))}

    want = {}
    for uid, _, work, text in rows:
        mine = tally(text)
        if not mine:
            continue
        for lab in "ABC":
            prof = {}
            for u, label, w, t in rows:
                if label == lab and w != work:
                    for g, n in tally(t).items():
                        prof[g] = prof.get(g, 0) + n
            if prof:
                total = sum(prof.values()) + 0.5 * len(marks)
                want[(uid, lab)] = sum(n * math.log((prof.get(g, 0) + 0.5) / total) for g, n in mine.items())
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    v = {r["uid"]: r["verdict"] for r in at.verdicts(hits, at.score(hits, counts, at.build_profiles(counts, kept, vocab))).collect()}
    assert v[99] == "no evidence" and v[0] == "low evidence"


def test_withholding_in_one_pass_equals_two_passes_and_leaks_are_errors(spark):
    rng = random.Random(14)
    rows = [(i, "ABC"[i % 3] if i % 4 else None, f"w{i % 5}", "".join(rng.choice({0: "abcd", 1: "cdef", 2: "abef"}[i % 3]) for _ in range(40))) for i in range(30)]
    units = spark.createDataFrame(rows, "uid BIGINT, label STRING, work STRING, text STRING")
    kept = at.select_units(units, min_chars=10, min_units=2, cls=tx.LETTER)
    vocab = spark.createDataFrame([(f, g) for f in at.FEATURE_SETS for g in ("ab", "cd", "ef", "abc", "cde")], "feature_set STRING, gram STRING")
    counts = at.unit_gram_counts(units, vocab)
    out = kept.filter("uid % 3 = 1").select("uid")
    hits = at.target_hits(units, counts)
    want = {}
    for case, extra in (("all", None), ("withheld", out)):
        prof = at.build_profiles(counts, kept, vocab, extra)
        for r in at.verdicts(hits, at.score(hits, counts, prof)).collect():
            want.setdefault((r["feature_set"], r["uid"]), {})[case] = (r["first"], round(r["margin"], 9), round(r["gap"], 9))
    got = at.sensitivity(units, counts, kept, vocab, out).collect()
    assert len(got) == len(want) and any(r["leader_flips"] for r in got)
    for r in got:
        for case in ("all", "withheld"):
            assert (r[f"first_{case}"], round(r[f"margin_{case}"], 9), round(r[f"gap_{case}"], 9)) == want[r["feature_set"], r["uid"]][case]
    moved = kept.withColumn("work", F.when(F.col("uid") == 1, "elsewhere").otherwise(F.col("work")))
    with pytest.raises(ValueError, match="own work"):
        at.sensitivity(units, counts, moved, vocab, out)
    assert [tuple(r) for r in at.leaks(units, kept, kept.filter("uid = 5")).collect()] == [(5, "withheld")]


def test_withholding_an_unknown_unit_is_an_error(spark):
    units = spark.createDataFrame([(i, "AB"[i % 2], f"w{i}", "abab") for i in range(6)], "uid BIGINT, label STRING, work STRING, text STRING")
    vocab = spark.createDataFrame([("curated", "ab")], "feature_set STRING, gram STRING")
    counts = at.unit_gram_counts(units, vocab)
    with pytest.raises(ValueError, match="not profiled"):
        at.build_profiles(counts, units, vocab, spark.createDataFrame([(77,)], "uid BIGINT"))


def test_evidence_spreads_over_characters_and_strip_counts_zero_cells(spark):
    text = "abcdab" + "-" * 944
    units = spark.createDataFrame([(1, text), (2, "none here"), (3, None)], "uid BIGINT, text STRING")
    w = spark.createDataFrame([("curated", 1, "ab", 1.0), ("curated", 1, "bcd", -0.9), ("both", 1, "bcd", -0.9), ("both", 1, "zz", 5.0)], "feature_set STRING, uid BIGINT, gram STRING, weight DOUBLE")
    ev = at.text_evidence(w, units)
    assert {r["feature_set"]: len(r["evidence"]) for r in ev.collect()} == {"curated": 950, "both": 950}
    got = {(r["feature_set"], r["pos"]): round(r["evidence"], 6) for r in at.char_evidence(ev).collect()}
    assert got == {**{("curated", p): v for p, v in {0: 0.5, 1: 0.2, 2: -0.3, 3: -0.3, 4: 0.5, 5: 0.5}.items()}, **{("both", p): -0.3 for p in (1, 2, 3)}}
    cells = [c for c in at.strip(ev).orderBy("no").collect() if c["feature_set"] == "curated"]
    assert [(c["start"], c["end"]) for c in cells] == [(0, 400), (400, 800), (800, 950)] and abs(cells[0]["mean"] - 1.1 / 400) < 1e-9
    assert {r["feature_set"]: round(r["scale"], 6) for r in at.evidence_scale(ev).collect()} == {"curated": 0.5, "both": 0.3}
    assert {r["feature_set"]: round(r["strip_scale"], 6) for r in at.strip_scale(at.strip(ev)).collect()} == {"curated": round(1.1 / 400, 6), "both": round(0.9 / 400, 6)}


def test_spread_weights_equal_a_walk_over_hits():
    rng = random.Random(6)
    for letters in ("ab", "abcd天😀", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        text = "".join(rng.choice(letters) for _ in range(4000 if len(letters) > 99 else 90))
        grams = sorted({text[i : i + n] for n in (1, 2, 3, 4, 7) for i in rng.sample(range(len(text) - 7), 9)} | {"nope", "zz"})
        weights = np.array([[rng.gauss(0, 1) if rng.random() < 0.7 else np.nan for _ in grams] for _ in range(2)])
        total, cover = at.spread_weights(text, grams, weights)
        for s in range(2):
            want, seen = np.zeros(len(text)), np.zeros(len(text), bool)
            for g, w in zip(grams, weights[s]):
                for i in range(len(text)):
                    if text.startswith(g, i) and not np.isnan(w):
                        want[i : i + len(g)] += w / len(g)
                        seen[i : i + len(g)] = True
            assert np.allclose(total[s], want) and (cover[s] == seen).all() and not total[s][~seen].any()


@pytest.mark.parametrize("root", ["hdfs://nn:8020/a/corpus", "s3a://bucket/a/corpus/", "file:/a/corpus", "file:///a/corpus", "/a/corpus", "a/corpus", "./a//corpus"])
def test_paths_below_a_root_on_any_file_system(spark, root):
    base = root if root.startswith(("hdfs", "s3a")) else "file:///a/corpus" if root.startswith(("/", "file")) else "file:///home/x/a/corpus"
    files = spark.createDataFrame([(f"{base.rstrip('/')}/sub%20dir/x+y.txt",)], "file_path STRING")
    assert files.select(co._relative("file_path", root).alias("f")).first()["f"] == "sub dir/x+y.txt"


def test_nearest_windows_of_any_length(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    v = (centre[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 8))) * rng.uniform(0.2, 1.8, (400, 1))
    v[7] = 0
    v = v.astype(np.float32)
    work = rng.integers(0, 40, 400)
    df = spark.createDataFrame([(i, f"w{work[i]}", "L", v[i].tolist()) for i in range(400)], "idx BIGINT, work STRING, label STRING, vec ARRAY<FLOAT>")
    dot = np.round(v.astype(float) @ v.astype(float).T, 12)
    dot[work[:, None] == work[None, :]] = -np.inf
    want = {i: [int(j) for j in np.lexsort((np.arange(400), -dot[i]))[:3]] for i in range(400)}
    rows = si.nearest_indices(df, 3, block=8).collect()
    assert {(r["idx"], r["rank"]): r["near_idx"] for r in rows} == {(i, n + 1): j for i, js in want.items() for n, j in enumerate(js)}
    some = spark.createDataFrame([(3,), (7,), (399,)], "idx BIGINT")
    rows = si.nearest_indices(df, 3, block=8, asked=some).collect()
    assert {(r["idx"], r["rank"]): r["near_idx"] for r in rows} == {(i, n + 1): j for i in (3, 7, 399) for n, j in enumerate(want[i])}


def test_windows_are_sent_a_bounded_number_of_times(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 512)).astype(np.float32)  # nothing prunes: every block meets every block
    df = spark.createDataFrame([(i, f"w{i % 9}", "L", v[i].tolist()) for i in range(3000)], "idx BIGINT, work STRING, label STRING, vec ARRAY<FLOAT>")
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert si.nearest_indices(df, 2, block=64).count() == 6000
        time.sleep(1)
        assert shuffled() - before < 25 * v.nbytes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_checkpoint_folder_is_an_error_on_a_cluster():
    from vidimus.functions import frames

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.checkpoint_dir(Session())
    assert [frames.on_one_machine(m) for m in ("local", "local[8]", "local[2,3]", "local-cluster[3,2,1000]", "yarn")] == [True, True, True, False, False]


def test_class_places_are_counted_within_each_file(spark):
    blocks = spark.createDataFrame([("f1", 0, "A"), ("f1", 1, "grey"), ("f1", 2, "B"), ("f2", 0, "C"), ("f2", 1, "D")], "file STRING, block INT, majority STRING")
    assert {tuple(r) for r in cat.class_sequence(blocks).collect()} == {("f1", "A", 0), ("f1", "B", 1), ("f2", "C", 0), ("f2", "D", 1)}


def test_manifest_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("春眠不覺曉", encoding="utf-8")
    (tmp_path / "b.txt").write_text("床前明月光", encoding="utf-8")
    (tmp_path / "manifest.csv").write_text("﻿path , witness_ref,label\na.txt , W1, First \n", encoding="utf-8")
    docs = co.read_manifest_corpus(spark, str(tmp_path))
    r = docs.first()
    assert (r["ref"], r["witness_ref"], r["title"], r["text"]) == ("a.txt", "W1", "First", "春眠不覺曉")
    n, some = co.unlisted_files(spark, str(tmp_path), docs)
    assert n.first()[0] == 1 and [x["file"] for x in some.collect()] == ["b.txt"]
    hits = sp.search_text(docs, spark.createDataFrame([(1, "不 覺")], "query_id BIGINT, query STRING")).collect()
    assert [(h["ref"], h["snippet"]) for h in hits] == [("a.txt", None)]
    (tmp_path / "manifest.csv").write_text("path,witness_ref\n../x.txt,W\n", encoding="utf-8")
    with pytest.raises(co.SourceError, match="leaves the corpus root"):
        co.read_manifest_corpus(spark, str(tmp_path))


def test_catalogue_majority_and_strays(spark, tmp_path):
    from vidimus.sources import catalogue as cat

    p = tmp_path / "cat.txt"
    p.write_bytes("T0001 A\r\nT0002 A\r\nT0003 grey\r\n\r\nT0004 grey\r\n\r\nT0005 B\r\n".encode())
    units, blocks, notes = cat.read_catalogue(spark, str(p))
    assert {(r["uid"], r["label"]) for r in units.collect()} == {("T0001", "A"), ("T0002", "A"), ("T0003", "grey"), ("T0004", "grey"), ("T0005", "B")}
    assert {(r["label"], r["sequence"]) for r in cat.class_sequence(blocks).collect()} == {("A", 0), ("B", 1)}
    assert [(r["majority"], r["label"], r["units"]) for r in notes.collect()] == [("A", "grey", 1)]
    p.write_bytes(b"T0001 A\n")
    with pytest.raises(co.SourceError, match="CRLF"):
        cat.read_catalogue(spark, str(p))


def test_scores_inside_rows_equal_scores_by_joins(spark):
    from vidimus.operators import scoring as sc

    rng = random.Random(21)
    rows = [(i, "ABC"[i % 3] if i % 4 else None, f"w{i % 5}" if i % 7 else None, "".join(rng.choice({0: "abcd天", 1: "cdef😀", 2: "abef"}[i % 3]) for _ in range(40))) for i in range(40)]
    units = spark.createDataFrame([*rows, (90, None, "w1", None), (91, "A", "w1", "")], "uid BIGINT, label STRING, work STRING, text STRING")
    grams = {"curated": ["ab", "cd", "ef", "天a"], "generic": ["abc", "cde", "e😀", "cd", "b"]}
    grams["both"] = sorted({g for x in grams.values() for g in x})
    vocab = spark.createDataFrame([(s, g) for s, x in grams.items() for g in x], "feature_set STRING, gram STRING")
    judged = at.judge_units(units, 10, 2, cls=tx.LETTER)
    kept, out = judged.filter("fate = 'kept'").drop("fate"), F.col("uid") % 3 == 1
    counts = at.unit_gram_counts(units, vocab, (1, 2, 3))
    hits = at.target_hits(units, counts)
    voc = sc.vocabulary(vocab)
    counted = sc.gram_rows(judged, voc)
    for withheld in (None, out):
        old = at.build_profiles(counts, kept, vocab, None if withheld is None else kept.filter(out).select("uid"))
        summary = at.profile_summary(hits, old)
        scores = at.score(hits, counts, old, summary)
        found = sc.answers(counted, sc.build_profiles(counted, voc, withheld), 3)
        # texts stay rows: neither counting nor scoring makes a row of a gram
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        flat = lambda df, cols: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)
        for new, was, cols in (
            (sc.profile_summary(found), summary, ["feature_set", "uid", "label", "hits", "distinct", "n_features", "units_left", "units_before", "tokens", "thin", "no_profile"]),
            (sc.scores(found), scores, ["feature_set", "uid", "label", "score", "delta", "rank", "tokens"]),
            (sc.verdicts(found), at.verdicts(hits, scores), ["feature_set", "uid", "hits", "distinct", "verdict", "first", "second", "margin", "gap"]),
            (sc.pairs(found), at.pairs(scores), ["feature_set", "uid", "a", "b", "pair_gap"]),
            (sc.pair_weights(found), at.pair_weights(at.gram_weights(at.pairs(scores), counts, old), 3), ["feature_set", "uid", "side", "rank", "gram", "hits", "count_a", "count_b", "rate_a", "rate_b", "weight"]),
        ):
            assert flat(new, cols) == flat(was, cols)
    prof = sc.build_profiles(counted, voc)
    old = at.build_profiles(counts, kept, vocab)
    weights = at.gram_weights(at.pairs(at.score(hits, counts, old)), counts, old)
    lists = lambda df: {(r["feature_set"], r["uid"]): [None if e is None else round(e, 9) + 0.0 for e in r["evidence"]] for r in df.collect()}
    ev, was = sc.text_evidence(judged, prof), at.text_evidence(weights, units)
    assert lists(ev) == lists(was)
    cut = lambda df: sorted((r["feature_set"], r["uid"], r["band"], r["start"], r["text"]) for r in df.collect())
    assert cut(sc.bands(sc.excerpts(at.with_scale(ev), 5, 20, ("scale",)))) == cut(at.evidence_bands(at.excerpt_rows(was, units, 5, 20), at.evidence_scale(was)))


def test_common_grams_equal_counts_by_rows(spark):
    from vidimus.operators import scoring as sc

    rng = random.Random(8)
    texts = spark.createDataFrame([("".join(rng.choice("abc天😀é 1\0") for _ in range(rng.randrange(90))),) for _ in range(50)] + [(None,), ("",)], "text STRING")
    shape = {1: 3, 2: 9, 4: 40}
    got, want = (sorted(r["gram"] for r in f(texts, shape, tx.LETTER).collect()) for f in (sc.common_grams, at.common_grams))
    assert got == want


def test_references_need_one_shuffle(spark):
    """Repeats and places are found where a document's elements lie; ranges in parentheses overlap a number."""
    body = "<cb:docNumber>No. 1 [12, 12, 3-5; cf. 7 (a)] [9 (3-4), 2] [5-2]</cb:docNumber><cb:docNumber>[12-14a] [4 - 5 (6)] [8; 3]</cb:docNumber>"
    refs = xr.extract_refs(spark.createDataFrame([("d", body)], "doc string, body string"))
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r["bucket"], r["number"], r["sub_ref"]) for r in refs.collect()}
    asserted = {("asserted", n, None) for n in ("12", "2", "3", "4", "5", "8")} | {("asserted", "9", "3-4")}
    assert got == asserted | {("compare_only", "7", "a")} | {("unparsed", b, None) for b in ("5-2", "12-14a", "4 - 5 (6)")}


def test_counted_references_give_the_same_tallies(spark):
    docs = spark.createDataFrame([("d", "<cb:docNumber>[1, 2, 77]</cb:docNumber>"), ("e", "<cb:docNumber>[2, 77, 3-4]</cb:docNumber>")], "doc string, body string")
    refs = xr.extract_refs(docs)
    cat = spark.createDataFrame([("1", "T1n1"), ("2", "T1n2"), ("2", "T2n2"), ("3a", "T1n3a"), ("3b", "T1n3b")], "number string, ref string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    each, counted = xr.resolve_refs(refs, cat), xr.resolve_counts(refs, cat)
    assert rows(xr.scan_tallies(docs, refs, each)) == rows(xr.scan_tallies(docs, refs, counted))
    assert rows(xr.most_often(each, "ambiguous")) == rows(xr.most_often(counted, "ambiguous")) == [("2", 2), ("3", 1)]


def test_evidence_is_read_in_the_task_that_paints(spark):
    """What the queries read along texts equals the same read from whole arrays, which need not leave a task."""
    from vidimus.operators import scoring as sc

    rng = random.Random(4)
    rows = [(i, "ABC"[i % 3] if i % 4 else None, f"w{i % 3}", "".join(rng.choice("abcdef\n天😀") for _ in range(rng.choice([5, 60, 900])))) for i in range(60)]
    units = spark.createDataFrame([*rows, (90, None, "w1", None), (91, "A", "w1", ""), (92, None, "w9", "xyz"), (93, None, "w9", "ab\0cd")], "uid BIGINT, label STRING, work STRING, text STRING")
    grams = [("curated", "ab"), ("curated", "天a"), ("generic", "cde"), ("generic", "b"), ("generic", "ab")]
    vocab = spark.createDataFrame([*grams, *{("both", g) for _, g in grams}], "feature_set STRING, gram STRING")
    voc = sc.vocabulary(vocab)
    prof = sc.build_profiles(sc.gram_rows(at.judge_units(units, 5, 2, cls=tx.LETTER), voc), voc)
    ev = sc.text_evidence(units, prof).cache()
    rows_of = lambda df: sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect())
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    found = F.array_compact("evidence")
    assert rows_of(sc.totals(units, prof)) == rows_of(ev.select("feature_set", "uid", F.size(found).alias("painted"), add(found), F.array_max("evidence")))
    assert rows_of(sc.scales(units, prof)) == rows_of(at.evidence_scale(ev))
    assert rows_of(sc.strips(units, prof)) == rows_of(at.strip(ev))
    assert rows_of(sc.excerpt_totals(units, prof, 7, 300)) == rows_of(sc.excerpts(ev, 7, 300).select("feature_set", "uid", "start", "end", add("evidence")))
    bands = sc.bands(sc.excerpts(at.with_scale(ev), 7, 300, ("scale",)))
    assert rows_of(sc.band_totals(units, prof, 7, 300)) == rows_of(bands.groupBy("feature_set", "uid", "band").agg(F.count("band"), F.sum(F.length("text"))))
    assert "evidence" not in sc.totals(units, prof)._jdf.queryExecution().executedPlan().toString()


def test_rounding_in_tasks_is_sparks(spark):
    from vidimus.operators import scoring as sc

    rng = random.Random(1)
    values = [0.0, -0.0, 0.00005, -0.00005, 1.00005, 2.67525, -3.33335, 1e-13, 5e-13, 123456.00005] + [rng.uniform(-9, 9) for _ in range(300)] + [k / 2e4 for k in range(-300, 300)]
    for digits in (4, 12):
        want = [r["v"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", digits).alias("v")).collect()]
        assert sc.rounded(np.array(values), digits).tolist() == want


def test_units_are_not_gathered_by_class(spark):
    units = spark.createDataFrame([(i, "AB"[i % 2], "w", "abc") for i in range(9)], "uid BIGINT, label STRING, work STRING, text STRING")
    plan = at.judge_units(units, 1, 2, cls=tx.LETTER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
