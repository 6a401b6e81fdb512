"""Frame helpers: latest or first per key, top-k, set and multiset work, and ordered scans.

The ordered scans (`carry_forward`, `running_total`, `previous_value`) split each key's rows into
chunks of the order column first. A window then sees at most `span` order values of one key, and
only one summary row per chunk is looked at per key, so a key holding a large share of all rows is
still worked on by many tasks. The order column must be an integer that is unique within a key.
"""
from __future__ import annotations

import functools
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = 1_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a session that runs on one machine may go without:
    it gets a temporary folder; on a cluster a missing setting is an error, because each executor would
    write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not on_one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for tables a job writes and reads back."""
    base = checkpoint_dir(spark)
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{base.rstrip('/')}/{name}-{unique}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and go on from the written table.

    Later steps read it back pruned and with known sizes, and the loss of an executor never replays
    what came before.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out over the session's cores where its files have fewer parts than that.

    A file with a single row group is one task however many cores wait. The rule looks at parts and
    cores only: a table with a part for each core, and so any large one, keeps the parts of its files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def by_shuffle(df: DataFrame) -> DataFrame:
    """The frame, marked to meet others by a shuffle whatever its size.

    Every table below Spark's broadcast threshold passes through the driver. A plan of a few joins stays
    small by that; one that joins dozens of tables, each growing with the input, sends their sum.
    """
    return df.hint("merge")


def literal_map(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    """Look a value up in a small fixed dictionary, inside the expression (no join)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order values per key (W2); partially aggregated before the shuffle."""
    return _extreme(df, keys, order, F.max_by)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least order values per key."""
    return _extreme(df, keys, order, F.min_by)


def _extreme(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(pick(row, by).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key with their rank (L1); Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """Last n rows by order, oldest first (L1)."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def page(df: DataFrame, order: Sequence[str], limit: int | None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def page_with_flag(df: DataFrame, order: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """First `limit` rows, and a one-row frame saying whether more exist (reads limit + 1 rows)."""
    probe = df.orderBy(*order).limit(limit + 1)
    flag = probe.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return df.orderBy(*order).limit(limit), flag


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left_anti")


def multiset_diff(mine: DataFrame, theirs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows whose multiplicity differs between two frames (U2), by one aggregation over both."""
    tagged = mine.select(*keep, F.lit(1).alias("_n")).unionByName(theirs.select(*keep, F.lit(-1).alias("_n")))
    return (
        tagged.groupBy(*keep)
        .agg(F.sum("_n").alias("surplus"))
        .filter("surplus <> 0")
        .withColumn("side", F.when(F.col("surplus") > 0, F.lit("mine")).otherwise(F.lit("theirs")))
    )


def lower_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """The value at index floor(q * (n - 1)) of the ascending order per key.

    Two aggregations instead of a rank over raw rows: equal values collapse first, so a key's
    rank window only sees its distinct values.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn(
        "_upto", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_n", F.sum("_c").over(w))
    at = F.floor(F.lit(q) * (F.col("_n") - 1))
    return (
        ranked.filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at))
        .select(*keys, F.col(value).alias(out))
    )


def _chunked(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / span))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], span: int = SPAN, shuffled: bool = False,
) -> DataFrame:
    """Add `prev_<v>`: the last non-null v of the same key strictly before the row. `shuffled`: see `by_shuffle`."""
    base = _chunked(df, order, span)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        "*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_in_{v}") for v in values]
    )
    ends = base.groupBy(*keys, "_chunk").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_end_{v}") for v in values]
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys, "_chunk", *[F.last(f"_end_{v}", ignorenulls=True).over(across).alias(f"_from_{v}") for v in values]
    )
    joined = local.join(by_shuffle(carried) if shuffled else carried, [*keys, "_chunk"])
    return joined.select(
        *df.columns, *[F.coalesce(f"_in_{v}", f"_from_{v}").alias(f"prev_{v}") for v in values]
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, span: int = SPAN, shuffled: bool = False,
) -> DataFrame:
    """Add the inclusive running sum of `value` per key (W4). `shuffled`: see `by_shuffle`."""
    base = _chunked(df, order, span)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_in", F.sum(value).over(inside))
    sums = base.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    return local.join(by_shuffle(carried) if shuffled else carried, [*keys, "_chunk"]).select(
        *df.columns, (F.coalesce("_in", F.lit(0)) + F.col("_before")).alias(out)
    )


def gap(df: DataFrame, keys: Sequence[str], order: str, out: str = "gap", span: int = SPAN) -> DataFrame:
    """Difference to the previous order value of the same key."""
    seen = carry_forward(df.withColumn("_o", F.col(order)), keys, order, ["_o"], span)
    return seen.withColumn(out, F.col(order) - F.col("prev__o")).drop("_o", "prev__o")


def merge_histories(sources: Sequence[DataFrame], key: str = "run_id") -> DataFrame:
    """Several run lists joined by id, the later source in the list wins."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    merged = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return latest_per(merged, [key], ["_source"]).drop("_source")
