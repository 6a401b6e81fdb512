"""Document sources: manifest corpora, markup documents, archive entries, editions."""
from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidimus.functions import text as tx

# Manifest columns, and the base-text file names in order of preference.
MANIFEST_COLUMNS = ("path", "witness_ref", "label", "note")
REQUIRED_COLUMNS = ("path", "witness_ref")
EDITIONS = ("大.txt", "CB.txt", "麗-CB.txt")
MAX_ENTRY_BYTES = 50 * 1024 * 1024


class SourceError(ValueError):
    """A source file breaks its contract; the message says where."""


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"


def _relative(path: str, root: str):
    """Path below the root, from a file URI column. Scheme and authority are dropped on both sides; a
    relative root is found at its first place in the path."""
    bare = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), SCHEME, "")
    inside = posixpath.normpath(re.sub(SCHEME, "", root) or "/").rstrip("/")
    if inside == ".":
        raise SourceError("name the root folder itself, not the working folder")
    start = "^" if inside.startswith("/") or not inside else "^.*?/"
    return F.regexp_replace(bare, rf"{start}\Q{inside}\E/+", "")


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Manifest CSV with trimmed header and cells; a byte order mark is tolerated."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = {c: c.replace("﻿", "").strip() for c in raw.columns}
    missing = [c for c in REQUIRED_COLUMNS if c not in clean.values()]
    if missing:
        raise SourceError(f"the manifest lacks required column(s): {', '.join(missing)}")
    named = raw.select(*[tx.strip_space(F.col(f"`{c}`")).alias(n) for c, n in clean.items() if n])
    optional = [F.lit(None).cast("string").alias(c) for c in MANIFEST_COLUMNS if c not in named.columns]
    return named.select("*", *optional).select(*MANIFEST_COLUMNS)


def manifest_problems(rows: DataFrame) -> DataFrame:
    """Manifest rows that may not be read: empty path or reference, or a path that leaves the root."""
    reason = (
        F.when(F.coalesce("path", F.lit("")) == "", "empty path")
        .when(F.coalesce("witness_ref", F.lit("")) == "", "empty witness_ref")
        .when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "path leaves the corpus root")
    )
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL")


def text_files(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(root, wholetext=True)
    )
    return files.select(_relative("_metadata.file_path", root).alias("file"), F.col("value").alias("text"))


def read_manifest_corpus(spark: SparkSession, root: str, manifest: str = "manifest.csv") -> DataFrame:
    """Documents named by a manifest, joined to their text (S2). Contract breaks raise."""
    rows = manifest_rows(spark, f"{root.rstrip('/')}/{manifest}")
    bad = manifest_problems(rows).limit(1).collect()
    if bad:
        raise SourceError(f"manifest row {bad[0]['path']!r}: {bad[0]['reason']}")
    docs = rows.withColumn("ref", F.regexp_replace("path", r"\\", "/")).withColumn(
        "file", F.regexp_replace("ref", r"(^|/)(\./)+", "$1")
    )
    files = text_files(spark, root)
    lost = docs.join(files.select("file"), "file", "left_anti").limit(1).collect()
    if lost:
        raise SourceError(f"the manifest lists a missing file: {lost[0]['path']!r}")
    none_if_blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return docs.join(files, "file").select(
        "ref",
        F.coalesce(none_if_blank("label"), F.col("file")).alias("title"),
        "text", "witness_ref", F.col("file").alias("locator"), none_if_blank("note").alias("note"),
    )


def unlisted_files(spark: SparkSession, root: str, docs: DataFrame, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """Text files on disk the manifest does not name: their count, and the first few (S3)."""
    extra = text_files(spark, root).select("file").join(
        docs.select(F.col("locator").alias("file")), "file", "left_anti"
    )
    return extra.agg(F.count(F.lit(1)).alias("unlisted_files")), extra.orderBy("file").limit(examples)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Records and characters held."""
    return docs.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")
    )


def check_entries(files: DataFrame, prefix: str, max_bytes: int = MAX_ENTRY_BYTES) -> tuple[DataFrame, DataFrame]:
    """Archive entries fit to be read, and the refused ones with the reason.

    `files` holds `entry_path` and `content`. Names are counted on their own so the contents are
    never grouped by name.
    """
    twice = files.groupBy("entry_path").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    reason = (
        F.when(
            ~F.startswith("entry_path", F.lit(prefix)) | F.contains("entry_path", F.lit("..")),
            "outside the expected layout",
        )
        .when(F.col("_n").isNotNull(), "entry appears more than once")
        .when(F.octet_length("content") > max_bytes, "over the size cap")
    )
    tagged = files.join(twice, "entry_path", "left").withColumn("reason", reason).drop("_n")
    return (
        tagged.filter("reason IS NULL").drop("reason"),
        tagged.filter("reason IS NOT NULL").select("entry_path", F.octet_length("content").alias("bytes"), "reason"),
    )


def markup_bodies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies of markup documents, and a ledger of those that cannot be read.

    The body starts after the first `<text ...>` tag that follows the closed header. Decoding is
    strict: a document that is not valid UTF-8 is counted, never repaired.
    """
    shape = r"(?s)^.*?<teiHeader.*?</teiHeader>.*?<text[^>]*>(.*)$"
    decoded = files.withColumn(
        "_t", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    )
    reason = (
        F.when(F.col("_t").isNull(), "not valid UTF-8")
        .when(~F.contains("_t", F.lit("<teiHeader")), "no header")
        .when(~F.contains("_t", F.lit("</teiHeader>")), "header never closed")
        .when(~F.col("_t").rlike(shape), "no text element after the header")
    )
    tagged = decoded.withColumn("reason", reason)
    docs = tagged.filter("reason IS NULL").select(
        F.col("entry_path").alias("doc"), F.regexp_extract("_t", shape, 1).alias("body")
    )
    skipped = tagged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))
    return docs, skipped


def read_markup_docs(spark: SparkSession, path: str, prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan markup files below a folder: (documents, unreadable ledger, refused entries)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
        .load(path).select(_relative("path", path).alias("entry_path"), "content")
    )
    ok, refused = check_entries(files, prefix)
    docs, skipped = markup_bodies(ok)
    return docs, skipped, refused


def pick_edition(files: DataFrame, editions=EDITIONS) -> DataFrame:
    """Per unit, the first existing base text in order of preference.

    `files` holds `uid`, `file`; units with none of the names come out with a null file.
    """
    order = F.array_position(F.array(*[F.lit(e) for e in editions]), F.col("file"))
    return files.groupBy("uid").agg(
        F.min_by("file", F.when(order > 0, order)).alias("file"), F.count("file").alias("files")
    )


def write_manifest(
    editions: DataFrame, labels: DataFrame, path: str, note: str, include_uncatalogued: bool = False,
) -> DataFrame:
    """Write a manifest row per catalogued unit with a base text; return the ledger."""
    joined = editions.join(labels.select("uid", "label"), "uid", "left")
    outcome = (
        F.when(F.col("label").isNull() & ~F.lit(include_uncatalogued), "skipped: not in catalogue")
        .when(F.col("file").isNull(), "skipped: no base text")
        .otherwise("listed")
    )
    tagged = joined.withColumn("outcome", outcome)
    label = F.coalesce("label", F.lit("not in catalogue"))
    (
        tagged.filter("outcome = 'listed'")
        .select(
            F.concat_ws("/", "uid", "file").alias("path"), F.col("uid").alias("witness_ref"),
            F.concat(F.col("uid"), F.lit(" · "), label).alias("label"), F.lit(note).alias("note"),
        )
        .orderBy("path").write.mode("overwrite").option("header", True).csv(path)
    )
    reasons = editions.sparkSession.createDataFrame(
        [("listed",), ("skipped: not in catalogue",), ("skipped: no base text",)], "outcome STRING"
    )
    counted = tagged.groupBy("outcome").agg(F.count(F.lit(1)).alias("units"))
    return reasons.join(counted, "outcome", "left").fillna(0, ["units"])
