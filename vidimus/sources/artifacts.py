"""Written artifacts: verified snapshots and the cross-reference scan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidimus.functions.frames import union_all
from vidimus.sources.corpus import SourceError


def table_digest(df: DataFrame) -> DataFrame:
    """Content hash of a frame that does not depend on row order or partitioning.

    Row hashes are folded with sums of their eight parts, so the digest is one aggregation with
    partial results and no ordered pass over the rows.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(
        F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    ).alias(f"q{i}")
    folded = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("rows"), *[part(i) for i in range(8)])
    return folded.select(
        "rows", F.sha2(F.concat_ws(":", "rows", *[F.coalesce(F.col(f"q{i}").cast("string"), F.lit("")) for i in range(8)]), 256).alias("digest")
    )


_MANIFEST = "stage STRING, table STRING, rows BIGINT, digest STRING"


def snapshot(tables: dict[str, DataFrame], events: DataFrame, dest: str) -> DataFrame:
    """Copy the log and its state tables into a stage of their own below `dest`, replay the copied log
    against the copied state, and only then write the manifest, which is the commit: one file that names
    the stage and the digest of every table. Returns the manifest.

    A run that dies or whose replay disagrees leaves a stage that no manifest names: readers never see it,
    a later run takes a new stage, and `stale_stages` lists it. A `dest` that has a manifest is an error.
    """
    from vidimus.operators.projection import rebuild_diff

    spark = events.sparkSession
    if _exists(spark, f"{dest}/manifest/_SUCCESS"):
        raise SourceError(f"{dest} holds a snapshot already")
    stage = f"stage-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    for name, df in {**tables, "events": events}.items():
        df.write.parquet(f"{dest}/{stage}/{name}")
    copied = {name: spark.read.parquet(f"{dest}/{stage}/{name}") for name in tables}
    log = spark.read.parquet(f"{dest}/{stage}/events")
    diff = rebuild_diff(
        log, copied["nodes"], copied["edges"], copied["node_authorship"], copied["edge_authorship"], copied["agents"]
    )
    if not diff.isEmpty():
        raise SourceError(f"snapshot {dest}: the copied log does not replay to the copied state")
    rows = [table_digest(df).select(F.lit(stage).alias("stage"), F.lit(name).alias("table"), "rows", "digest") for name, df in sorted({**copied, "events": log}.items())]
    # overwrite: a manifest without its success mark was never a commit
    union_all(rows).coalesce(1).write.mode("overwrite").json(f"{dest}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{dest}/manifest")


def read_snapshot(spark: SparkSession, dest: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a committed snapshot, and the manifest beside the digests that the tables have now.
    No committed manifest is an error."""
    if not _exists(spark, f"{dest}/manifest/_SUCCESS"):
        raise SourceError(f"{dest} holds no complete snapshot")
    manifest = spark.read.schema(_MANIFEST).json(f"{dest}/manifest")
    tables = {r["table"]: spark.read.parquet(f"{dest}/{r['stage']}/{r['table']}") for r in manifest.collect()}  # one row a table
    now = union_all([table_digest(df).select(F.lit(name).alias("table"), F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now")) for name, df in tables.items()])
    checked = manifest.join(now, "table").withColumn("intact", (F.col("rows") == F.col("rows_now")) & (F.col("digest") == F.col("digest_now")))
    return tables, checked.select("table", "rows", "digest", "intact")


def stale_stages(spark: SparkSession, dest: str) -> list[str]:
    """Stages below `dest` that no committed manifest names; they may be removed."""
    held = set()
    if _exists(spark, f"{dest}/manifest/_SUCCESS"):
        held = {r["stage"] for r in spark.read.schema(_MANIFEST).json(f"{dest}/manifest").select("stage").distinct().collect()}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{dest}/stage-*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted({f.getPath().getName() for f in found} - held)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_scan(refs: DataFrame, resolved: DataFrame, tallies: DataFrame, dest: str) -> None:
    """Cross-reference map per document, declined brackets with count and one example, summary."""
    from vidimus.operators.xref import declined_brackets, reference_map

    reference_map(refs, resolved).write.mode("errorifexists").json(f"{dest}/parallel_map")
    declined_brackets(refs).orderBy(F.desc("n"), "bracket").write.mode("errorifexists").json(f"{dest}/unparsed")
    tallies.write.mode("errorifexists").json(f"{dest}/summary")
