"""Chat formatting: logged snapshots of a growing conversation collapse to the longest one, which is rendered.

Every turn gets a hash of its place, role and text; the running combination of
the hashes of a conversation names each of its prefixes.  A conversation whose
last prefix is an inner prefix of another one is a snapshot of it.  Equal prefixes
are made one row before they are joined, so a first turn that a third of all
conversations share is one row as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spiketide.session import stage

# fixed values: marks of the rendered format
BEGIN, END = "<|im_start|>", "<|im_end|>"
GUARDED = ("<|im_", "<|_im_")  # a mark inside a turn is written so that it is none


def _turn_hash(seed: int) -> Column:
    """xxhash64 passes over nulls, so whether a value is null is hashed as well."""
    parts = ["_place", F.col("_role").isNull(), "_role", F.col("_text").isNull(), "_text"]
    return F.xxhash64(F.lit(seed), *parts)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, place, last, h1, h2): the hash of each prefix, and the number of turns of its conversation.

    ``turns`` (_conv, _turn, _role, _text).  128 bits stand for a prefix.
    """
    inside = Window.partitionBy("_conv")
    ordered = inside.orderBy(*(F.col(c).asc_nulls_first() for c in ("_turn", "_role", "_text")))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("_place", F.row_number().over(ordered)).withColumns({"_h1": _turn_hash(1), "_h2": _turn_hash(2)})
    return placed.select(
        F.col("_conv").alias("conv"),
        F.col("_place").alias("place"),
        F.count("*").over(inside).alias("last"),
        F.bit_xor("_h1").over(running).alias("h1"),
        F.bit_xor("_h2").over(running).alias("h2"),
    )


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies): one conversation for each sequence of turns that no longer one begins with."""
    ends = numbered.filter("place = last").groupBy(F.col("last").alias("place"), "h1", "h2").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_copies")
    )
    inner = numbered.filter("place < last").select(F.col("place").cast("long").alias("place"), "h1", "h2").distinct()
    return ends.join(inner, ["place", "h1", "h2"], "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies")


def render(turns: Column) -> Column:
    """Turns (turn, role, text) as marked text; a null role or text is empty."""

    def one(t: Column) -> Column:
        text = F.replace(F.coalesce(t["text"], F.lit("")), F.lit(GUARDED[0]), F.lit(GUARDED[1]))
        return F.concat(F.lit(BEGIN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), text, F.lit(END), F.lit("\n"))

    return F.array_join(F.transform(turns, one), "")


def format_chats(
    logs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Maximal conversations: ``conv_col``, ``n_turns``, ``n_copies`` (logged conversations with the same turns), ``rendered``.

    Turns are ordered by turn, role and text, nulls first; repeated rows are turns
    of their own.  Rows without a conversation id belong to none and are left out.
    Of equal conversations the smallest id stays.  An empty table gives an empty
    one; other columns are not read.  A conversation becomes one value, so its own size, and
    no group's, bounds a row.
    """
    turns = logs.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text")
    )
    kept = stage(maximal(stage(prefixes(turns))))
    shown = turns.join(kept.withColumnRenamed("conv", "_conv"), "_conv")
    each = F.struct(F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"))
    gathered = shown.groupBy("_conv", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(each)).alias("_turns"))
    return gathered.select(F.col("_conv").alias(conv_col), "n_turns", "n_copies", render(F.col("_turns")).alias("rendered"))
