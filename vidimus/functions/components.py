"""Connected components of a large edge table by alternating star contraction.

Every round is two joins on a vertex and keeps the edge count from growing; rounds are logarithmic in
the longest path. Each round is a written table, so a lost executor repeats one round at most.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import by_shuffle, cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, shuffled: bool) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(by_shuffle(least) if shuffled else least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, shuffled: bool) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(by_shuffle(least) if shuffled else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, shuffled: bool = False) -> DataFrame:
    """(node, root) for every vertex of edges (u, v) but the roots themselves; root is the smallest
    vertex of the component. Loops and repeated edges do no harm; no edges give no rows. `shuffled`:
    see `frames.by_shuffle`."""
    cur = cut_lineage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    seen = _mark(cur)
    while seen[0]:
        cur = cut_lineage(_small_star(_large_star(cur, shuffled), shuffled))
        now = _mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
