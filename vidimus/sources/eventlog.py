"""Event log: scan of JSON lines, append of new events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidimus import schemas

# `detail` stays the bytes that were logged: parsing it into a struct and writing it back would
# drop nulls and reorder keys, and payload hashes are taken over exactly these bytes.
_PLAIN_DDL = ", ".join(p for p in schemas.EVENT_DDL.split(", ") if not p.startswith("detail "))
_FIELDS = [p.split(" ")[0] for p in schemas.EVENT_DDL.split(", ")]


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Log lines to (events, rejects). Blank lines are skipped; a line that is no JSON object, has
    no sequence number or author, or names an unknown event type goes to the rejects with the reason."""
    line = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    rows = lines.select(line.alias("line")).filter("line <> ''")
    parsed = rows.select("line", F.from_json("line", _PLAIN_DDL).alias("e"))
    reason = (
        F.when(F.col("e").isNull() | F.col("e.event").isNull(), F.lit("not an event"))
        .when(~F.col("e.event").isin(*schemas.EVENT_TYPES), F.lit("UnknownEventType"))
        .when(F.col("e.seq").isNull(), F.lit("no seq"))
        .when(F.coalesce(F.col("e.authored_by"), F.lit("")) == "", F.lit("no author"))
    )
    tagged = parsed.withColumn("reason", reason)
    detail = F.coalesce(F.get_json_object("line", "$.detail"), F.lit("{}"))
    events = tagged.filter("reason IS NULL").select(
        *[(detail if f == "detail" else F.col(f"e.{f}")).alias(f) for f in _FIELDS]
    )
    rejects = tagged.filter("reason IS NOT NULL").select("line", "reason")
    return events, rejects


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scan log files under a path; a missing path is an empty log."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
    if not found:
        return parse_lines(spark.createDataFrame([], "value STRING"))
    return parse_lines(spark.read.text(path))


def to_line(df: DataFrame) -> Column:
    """One JSON object per event; the stored detail text is set in as it is."""
    present = [f for f in _FIELDS if f != "detail" and f in df.columns]
    head = F.to_json(F.struct(*present))
    return F.concat(
        F.regexp_replace(head, r"\}$", ""),
        F.lit(',"detail":'), F.coalesce("detail", F.lit("{}")), F.lit("}"),
    )


def number_events(new: DataFrame, after: int, order: list[str]) -> DataFrame:
    """Contiguous sequence numbers after a maximum, without pulling the batch into one task.

    The batch is range-partitioned by its order, each partition is numbered on its own, and the
    offsets come from one count per partition.
    """
    parts = (
        new.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", 33))
        .withColumn("_in", F.col("_slot").bitwiseAND((1 << 33) - 1))
        .drop("_slot")
    )
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn("seq", (F.lit(after + 1) + F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_part", "_in", "_before")
    )


def append_events(new: DataFrame, path: str, *, order: list[str], run_id: str | None = None) -> DataFrame:
    """Append a batch to the log with contiguous sequence numbers and a run id stamped on.

    One writer at a time, as with any append-only log. The numbered batch is checkpointed before it
    is written, so a retried task cannot number rows differently from the ones already written.
    """
    from vidimus.functions.frames import cut_lineage

    spark = new.sparkSession
    unknown = new.filter(~F.col("event").isin(*schemas.EVENT_TYPES)).limit(1).count()
    if unknown:
        raise ValueError("the batch holds an unknown event type")
    events, _ = read_events(spark, path)
    last = events.agg(F.max("seq")).first()[0]
    batch = number_events(new.drop("seq"), -1 if last is None else int(last), order)
    if run_id is not None:
        batch = batch.withColumn("run_id", F.lit(run_id))
    batch = cut_lineage(batch)
    batch.select(to_line(batch).alias("value")).write.mode("append").text(path)
    return batch
