import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vidimus.functions.components import components
from vidimus.functions.frames import cut_lineage
from vidimus.llm import exact, simhash

CLASHING = "doc_id long, text string, recipe string, fp string, kept int, u long, component_id string, norm string"


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "r", "f", 1, 2, "c", "n") for i, t in rows], CLASHING)


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    root = {i: i for i in range(len(items))}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_fingerprints_follow_the_definition():
    for t in [None, "", " \n", "One", "a b c", "a b c d", "The QUICK brown fox Jumps über den ÉTÉ", "x " * 5000, "É\x0bé\x0c\tz q r s t u"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("tile", [4, 1024])
def test_components_equal_all_pairs(spark, tile):
    rnd = random.Random(3)
    points = set()
    for _ in range(60):
        c = rnd.getrandbits(64)
        points.add(c)
        for _ in range(rnd.choice([0, 1, 3, 40])):
            p = c
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                p ^= 1 << b
            points.add(p)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), tile=tile)
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = classes(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4)
    mine = [got.get(s, s) for s in signed]
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_the_table_never_discards_a_link():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    both = np.r_[fp, near]
    i, j = simhash._survive(both, simhash.distances(both, simhash.references()), np.arange(300), np.arange(300, 600), 4)
    assert len(i) == 300


def test_near_duplicates_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    a = " ".join(words)
    b = " ".join(words[:-1] + ["other"])
    rows = [(5, a), (3, b), (9, a), (9, a), (None, a), (1, None), (2, ""), (4, " \n"), (7, "alone in here"), (8, "x " * 20000)]
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    group = classes(fps, lambda x, y: bin(x ^ y).count("1") <= 4)
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None]
        assert got[i, signed[k]] == min(ids)
    left = simhash.representatives(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert {r["doc_id"] for r in left.collect()} == {min(rows[m][0] for m in range(len(rows)) if group[m] == g and rows[m][0] is not None) for g in group}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def weak(chunk, salt):
    """Identifiers that clash under the first salts."""
    return [F.pmod(F.xxhash64(chunk, F.lit(salt)), F.lit(7 if salt < 2 else 2**62).cast("long"))]


@pytest.mark.parametrize("identify", [exact.two_hashes, weak])
def test_exact_duplicates_equal_grouping_by_text(spark, identify):
    long = " ".join(f"word{i % 97} and{i}" for i in range(6000))
    rows = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (7, " a b"), (1, None), (3, ""), (8, " "), (5, long), (6, long.replace(" ", "\n")), (10, long + "x")]
    rows += [(11, "same"), (11, "same"), (None, "a b"), (None, "lonely"), (12, "日本語　テキスト"), (13, "日本語　テキスト")]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    got = exact.exact_duplicates(frame(spark, rows), identify).collect()
    want = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min([j for j in ids if j is not None], default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_distinct_documents_keeps_columns_and_one_of_full_repeats(spark):
    rows = [(2, "a  b"), (1, "a b"), (3, "c"), (3, "c"), (4, None), (5, "")]
    left = exact.distinct_documents(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in CLASHING.split(", ")]
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(100, 300)]
    hub = [(5, i) for i in range(1000, 1400)]
    got = components(spark.createDataFrame(path + hub + [(7, 7), (8, 7), (7, 8)], "u long, v long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert roots == {i: 100 for i in range(101, 301)} | {i: 5 for i in range(1000, 1400)} | {8: 7}


def test_small_tables_that_explode_are_not_broadcast(spark):
    """Spark sizes a written table by its files, before it explodes; keys met through the driver that way."""
    points = cut_lineage(spark.range(200).select(F.xxhash64("id").alias("fp")))
    docs = cut_lineage(frame(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "other words here")]))
    for made in (simhash.links(points), simhash.near_duplicates(docs), simhash.representatives(docs)):
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
