"""Catalogue, marker list and vector windows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidimus.functions import text as tx
from vidimus.sources.corpus import SourceError

UNLABELLED = "grey"
MIN_MARKERS = 1000


def parse_catalogue(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue text to (units, blocks, notes).

    Blocks are separated by blank lines, a line's last token is its label, a block carries its
    majority label (the first seen wins a tie) and the lines that disagree are noted. `raw` holds one
    `value` per catalogue file, and a `file` to tell several apart.
    """
    raw = raw if "file" in raw.columns else raw.withColumn("file", F.lit(""))
    text = F.regexp_replace("value", "\r", "")
    blocks = raw.select("file", F.posexplode(F.split(text, "\n\n")).alias("block", "body"))
    lines = blocks.select("file", "block", F.posexplode(F.split("body", "\n")).alias("line", "row"))
    words = lines.select(
        "file", "block", "line", F.filter(F.split("row", r"(?U)\s+"), lambda w: w != "").alias("w")
    ).filter(F.size("w") > 0)
    units = words.select("file", "block", "line", F.col("w")[0].alias("uid"), F.element_at("w", -1).alias("label"))
    by_label = units.groupBy("file", "block", "label").agg(F.count(F.lit(1)).alias("units"), F.min("line").alias("first_line"))
    pick = Window.partitionBy("file", "block").orderBy(F.desc("units"), "first_line")
    ranked = by_label.withColumn("rn", F.row_number().over(pick))
    owners = ranked.filter("rn = 1").select("file", "block", F.col("label").alias("majority"))
    notes = ranked.filter("rn > 1").join(owners, ["file", "block"]).select("file", "block", "majority", "label", "units")
    last = units.groupBy("uid").agg(F.max_by("label", F.struct("file", "block", "line")).alias("label"))
    return last, owners, notes


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read and check one catalogue file. Lone line feeds, a line without a label and a label that
    owns two blocks are errors."""
    raw = spark.read.text(path, wholetext=True)
    if raw.filter(F.contains("value", F.lit("\r\n"))).limit(1).count() == 0:
        raise SourceError(f"{path}: expected CRLF line endings")
    text = F.regexp_replace("value", "\r", "")
    bare = raw.select(F.explode(F.split(text, "\n")).alias("row")).filter(r"row rlike '^\\s*\\S+\\s*$'")
    if bare.limit(1).count():
        raise SourceError(f"{path}: a catalogue line has no label")
    units, blocks, notes = parse_catalogue(raw)
    if blocks.groupBy("majority").count().filter("count > 1").limit(1).count():
        raise SourceError(f"{path}: a label owns two blocks; the sequence is ambiguous")
    return units, blocks, notes


def class_sequence(blocks: DataFrame) -> DataFrame:
    """Place of each labelled class in the block order of its own file, counted without the unlabelled
    block."""
    kept = blocks.filter(F.col("majority") != UNLABELLED)
    place = F.row_number().over(Window.partitionBy("file").orderBy("block")) - 1
    return kept.select("file", F.col("majority").alias("label"), place.alias("sequence"))


def parse_markers(raw: DataFrame, lengths=(2, 3, 4)) -> DataFrame:
    found = raw.select(F.explode(F.regexp_extract_all("value", F.lit("<ngram>(.*?)</ngram>"), F.lit(1))).alias("gram"))
    return found.filter(F.length("gram").isin(*lengths)).distinct()


def read_markers(spark: SparkSession, path: str, minimum: int = MIN_MARKERS) -> DataFrame:
    """Distinct curated strings of two to four characters; too few means the file did not load."""
    marks = parse_markers(spark.read.text(path, wholetext=True))
    n = marks.count()
    if n < minimum:
        raise SourceError(f"{path}: only {n} entries parsed")
    return marks


def read_windows(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None, work=None, check: bool = True,
) -> DataFrame:
    """Vector windows `idx, uid, work, label, start, vec`.

    `columns` names the stored column (or SQL expression) behind each field. Missing fields, nulls
    and vectors of unequal length are errors.
    """
    raw = spark.read.parquet(path)
    columns = columns or {c: c for c in ("idx", "uid", "label", "start", "vec")}
    for field in ("uid", "label", "start", "vec"):
        if field not in columns:
            raise SourceError(f"{path} lacks the {field!r} column")
    win = raw.select(*[F.expr(e).alias(c) for c, e in columns.items()]).withColumn(
        "vec", F.col("vec").cast("array<float>")
    )
    work = tx.work_of("uid") if work is None else F.expr(work)
    win = win.withColumn("work", work)
    if check:
        bad = win.agg(
            F.count_if(F.col("uid").isNull() | F.col("start").isNull() | F.col("vec").isNull()).alias("nulls"),
            F.count_if(F.col("work").isNull()).alias("no_work"),
            F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"),
        ).first()
        if bad["nulls"] or bad["low"] != bad["high"]:
            raise SourceError(f"{path}: columns disagree in length")
        if bad["no_work"]:
            raise SourceError(f"{path}: a unit id names no work")
    return win
