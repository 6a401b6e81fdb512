"""Chat logs: conversations that were logged again and again as they grew, collapsed to the longest.

A conversation's turns give rolling prefix hashes: each turn hashes its own content together with its
place, and prefixes add these hashes up in four lanes of 31 bits (sums cannot overflow and do not
depend on the order of evaluation). A conversation is a snapshot when its whole hash, with its length,
is the hash of a proper prefix of another one; an anti-join leaves the maximal conversations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidimus.functions.frames import SPAN, cut_lineage, running_total

LANES = 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def turn_table(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, said): one row a turn; messages repeated in full count once, several different
    ones of one turn stand in the order of role and text. Null turns come first, as turn -1."""
    said = F.struct(_text("role").alias("role"), _text("text").alias("text"))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    return messages.filter(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("turn"), said.alias("said")).groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_set("said")).alias("said")
    )


def prefix_hashes(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, turn, place, prefix): place is 1, 2, .., prefix the rolling hash of everything up to
    the turn. Only hashes of the messages go through the running sums, never their texts."""
    own = [F.xxhash64(F.lit(i), F.to_json("said")).alias(f"said{i}") for i in range(LANES)]
    out = running_total(turns.select("conv_id", "turn", *own, F.lit(1).cast("long").alias("one")), ["conv_id"], "turn", "one", "place", span).drop("one")
    for i in range(LANES):
        here = F.xxhash64(f"said{i}", "place").bitwiseAND(F.lit((1 << 31) - 1))
        out = running_total(out.withColumn(f"said{i}", here), ["conv_id"], "turn", f"said{i}", f"lane{i}", span).drop(f"said{i}")
    return cut_lineage(out.select("conv_id", "turn", "place", F.array(*[f"lane{i}" for i in range(LANES)]).alias("prefix")))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, turns): conversations that are no proper prefix of another; of equal ones the smallest id."""
    ends = hashed.groupBy("conv_id").agg(F.max("place").alias("turns"), F.max_by("prefix", "place").alias("prefix"))
    single = ends.groupBy("turns", "prefix").agg(F.min("conv_id").alias("conv_id"))
    inner = hashed.join(ends.select("conv_id", "turns"), "conv_id").filter("place < turns")
    longer = inner.select(F.col("place").alias("turns"), "prefix").distinct()
    return single.join(longer, ["turns", "prefix"], "left_anti").select("conv_id", "turns")


def render(said: Column | str) -> Column:
    """The messages of one turn in chat markup."""
    return F.concat_ws("", F.transform(said, lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"), m["text"], F.lit(CLOSE + "\n"))))


def format_chats(messages: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, place, rendered, char_start, turns) for every turn of every maximal conversation.

    The rendered text of a conversation is its rows in order of place; char_start is where a row
    begins, so a conversation of any length is written by many tasks. Rows without a conv_id are left
    out; null roles and texts count as empty; an empty table gives no rows; other columns are not read.
    """
    said = cut_lineage(turn_table(messages))
    hashed = prefix_hashes(said, span)
    kept = hashed.join(maximal_conversations(hashed), "conv_id").select("conv_id", "turn", "place", "turns")
    shown = said.select("conv_id", "turn", render("said").alias("rendered"))
    chars = shown.select("conv_id", "turn", F.length("rendered").cast("long").alias("chars"))
    sized = running_total(kept.join(chars, ["conv_id", "turn"]), ["conv_id"], "turn", "chars", "char_end", span)
    return sized.join(shown, ["conv_id", "turn"]).select(
        "conv_id", F.col("place").cast("long").alias("place"), "rendered", (F.col("char_end") - F.col("chars")).alias("char_start"), F.col("turns").cast("long").alias("turns")
    )
