"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

Texts are cut where their own content says so, so equal passages in different texts give equal chunks.
Each distinct chunk travels once to be checked: an identifier is used only after it is known that no
two different chunks have it. From then on a document is the ordered list of its chunks' identifiers,
some hundredths of its size, and only these lists are grouped and joined.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import cut_lineage
from vidimus.llm.common import semi

#: A chunk ends after six characters in a row whose code points are 0 or 1 modulo 4, of ASCII.
LEAST, MOST, RUN = 512, 8192, 6


def _half() -> str:
    return "".join(f"\\x{c:02x}" for c in range(0x20, 0x7F) if c % 4 < 2)


def chunk_pattern(least: int = LEAST, most: int = MOST, run: int = RUN) -> str:
    """At least `least` characters up to a cut, or `most` where none comes before (also the rest)."""
    return f"(?s).{{{least},{most - run}}}?[{_half()}]{{{run}}}|.{{1,{most}}}"


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))


def two_hashes(chunk: Column, salt: int) -> list[Column]:
    """The identifier of a chunk: two numbers of 64 bits, other ones for each salt."""
    return [F.xxhash64(chunk, F.lit(2 * salt)), F.xxhash64(chunk, F.lit(2 * salt + 1))]


def verified_salt(texts: DataFrame, identify: Callable[[Column, int], list[Column]]) -> int:
    """The first salt under which no two different chunks of the corpus have one identifier.

    Distinct chunks are compared by their whole content: (identifier, chunk) pairs are made distinct on
    both sides of the shuffle, and an identifier with two chunks is a clash.
    """
    salt = 0
    while True:
        ids = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select("chunk", F.array(*identify(F.col("chunk"), salt)).alias("id"))
        clash = ids.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if clash.isEmpty():
            return salt
        salt += 1


def recipes(docs: DataFrame, identify: Callable[[Column, int], list[Column]] = two_hashes) -> DataFrame:
    """(doc_id, recipe, text_sha256) for every row; recipe lists the verified identifiers in order."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    salt = verified_salt(texts, identify)
    recipe = F.flatten(F.transform(chunks(F.col("norm")), lambda c: F.array(*identify(c, salt))))
    return texts.select("doc_id", recipe.alias("recipe"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, identify: Callable[[Column, int], list[Column]] = two_hashes) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when they are identical after each run of ASCII white space becomes one space; a
    null text is an empty one. The row with the smallest doc_id stays. Rows that repeat one doc_id and
    text all count in group_size and are all marked kept (`distinct_documents` keeps one of them). A row
    with a null doc_id is counted, never names its group, and is kept only where no row of the group
    has an id (keep_id is then null). No rows give no rows; other columns are not read.
    """
    made = cut_lineage(recipes(docs, identify))
    groups = made.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return made.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns; of rows that repeat in full, one.

    Only rows whose doc_id turns up more than once are compared with each other; the list of such ids
    is written first, so its size is known when the join is planned.
    """
    kept = cut_lineage(exact_duplicates(docs).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    repeated = cut_lineage(kept.filter("n > 1").select("doc_id"))
    once = semi(docs, kept.filter("n = 1"))
    return once if repeated.isEmpty() else once.unionByName(semi(docs, repeated).dropDuplicates())
