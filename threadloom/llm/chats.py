"""Cumulative-snapshot collapse and chat rendering.

A conversation is often logged again and again while it grows, so that earlier logs are
prefixes of a later one. Every turn gets the hash of all turns up to it: the sum of
position-dependent hashes, so it can be computed in pieces and no conversation has to
pass through one task. The hash of a whole conversation that is found among the inner
prefixes of another one marks it as a snapshot; an anti-join retains the rest, of equal
conversations the one with the least id. Retained turns are rendered, one row each.

Defined cases: turns are ordered by ``turn`` (null first), then role, then text; a null
role or text differs from an empty one in the hash and renders as empty; a conversation
whose id is null is one conversation; rows repeated within a conversation are turns of
it like others; a very long text or conversation is hashed turn by turn like any other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.session import write_scratch

# The marks of the rendered template.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")
WIDE = "decimal(38,0)"
ORDER = ["turn", "role", "text"]


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    opening, between, closing = map(F.lit, TEMPLATE)
    return F.concat(opening, F.coalesce(role, F.lit("")), between, F.coalesce(text, F.lit("")), closing)


def slabbed(turns: DataFrame) -> DataFrame:
    """The turns cut into slabs by range of (conversation, order), written once."""
    return write_scratch(turns.select("conv_id", *ORDER).repartitionByRange("conv_id", *ORDER).withColumn(
        "slab", F.spark_partition_id()), "turns")


def _with_earlier(slabs: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Each row with the sums over the slabs of its conversation that come before its own."""
    before = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    totals = slabs.groupBy("conv_id", "slab").agg(*[value.alias(name) for name, value in sums.items()])
    earlier = totals.select(
        F.col("conv_id").alias("id"), F.col("slab").alias("part"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).cast(totals.schema[name].dataType).alias(name) for name in sums])
    return slabs.join(earlier, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("slab") == F.col("part"))) \
        .drop("id", "part")


def numbered(slabs: DataFrame) -> DataFrame:
    """The slabs' rows with nth, counted from 1 within the conversation."""
    inside = Window.partitionBy("conv_id", "slab").orderBy(*ORDER)
    return _with_earlier(slabs, {"earlier": F.count("*")}).withColumn(
        "nth", F.col("earlier") + F.row_number().over(inside)).drop("earlier")


def prefix_hashes(slabs: DataFrame) -> DataFrame:
    """conv_id, nth and two rolling hashes h1, h2 of the turns up to each; no text."""
    missing = F.concat(F.col("role").isNull().cast("string"), F.col("text").isNull().cast("string"))
    hashed = write_scratch(numbered(slabs).select(
        "conv_id", "slab", "nth", F.xxhash64("nth", "role", "text", missing).cast(WIDE).alias("h1"),
        F.xxhash64(F.lit(7), "text", "nth", missing, "role").cast(WIDE).alias("h2")), "hashed")
    inside = Window.partitionBy("conv_id", "slab").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return _with_earlier(hashed, {"b1": F.sum("h1"), "b2": F.sum("h2")}).select(
        "conv_id", "nth", *[(F.sum(h).over(inside) + F.col(b)).cast(WIDE).alias(h) for h, b in (("h1", "b1"), ("h2", "b2"))])


def collapsed(turns: DataFrame) -> DataFrame:
    """Turns of maximal conversations: conv_id, turn, role, text, nth, n_turns, n_logged.

    ``n_logged`` counts the conversations equal to the retained one, itself included.
    """
    slabs = slabbed(turns)
    prefixes = write_scratch(prefix_hashes(slabs), "prefixes")
    # The row of the last turn of each conversation: its hashes are those of the whole.
    whole = write_scratch(prefixes.groupBy("conv_id").agg(F.max(F.struct("nth", "h1", "h2")).alias("end")).select(
        "conv_id", F.col("end.nth").alias("n_turns"), "end.h1", "end.h2"), "whole")
    least = whole.groupBy("n_turns", "h1", "h2").agg(
        F.min(F.struct("conv_id")).alias("first"), F.count("*").alias("n_logged"))
    inner = prefixes.join(whole.select(F.col("conv_id").alias("id"), F.col("n_turns").alias("n")),
                          F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("nth") < F.col("n"))) \
        .select(F.col("nth").alias("n_turns"), "h1", "h2").distinct()
    kept = write_scratch(least.join(inner, ["n_turns", "h1", "h2"], "left_anti").select(
        F.col("first.conv_id").alias("id"), "n_turns", "n_logged"), "kept")
    return numbered(slabs.join(kept, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")).join(
        kept, F.col("conv_id").eqNullSafe(F.col("id"))).select(
            "conv_id", "turn", "role", "text", "nth", "n_turns", "n_logged")


def chat_turns(turns: DataFrame) -> DataFrame:
    """Retained turns as rendered rows, in order of nth within conv_id."""
    return collapsed(turns).select("conv_id", "nth", "n_turns", "n_logged",
                                   rendered(F.col("role"), F.col("text")).alias("rendered"))
