"""Conversation list, statistics, timeline and per-conversation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.operators.filters import owned_by
from threadloom.session import broadcast_if_small


def count_conversations(conversations: DataFrame, owner_id: str | None = None) -> DataFrame:
    return owned_by(conversations, owner_id).agg(F.count("*").alias("total"))


def conversation_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.count("msg_id").alias("message_count"),
        F.min("ts").alias("first_message_ts"),
        F.max("ts").alias("last_message_ts"),
    )


def conversations_with_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with its message count and time span; messages are reduced before the join."""
    return conversations.select("conv_id", "title", "owner_id") \
        .join(conversation_summary(messages), "conv_id", "left") \
        .withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def list_conversations(conversations: DataFrame, messages: DataFrame, owner_id: str | None = None,
                       limit: int = 50, offset: int = 0, with_total: bool = False) -> DataFrame:
    """One page of conversations, latest activity first; empty conversations last.

    With an owner only the messages of that owner's conversations are counted. A page is
    found by ranking ``offset + limit`` rows; to go through all, sort by range instead.
    ``with_total`` adds the number of conversations that the pages are cut from.
    """
    if limit < 1 or offset < 0:
        raise ValueError(f"a page needs limit >= 1 and offset >= 0, got {limit} and {offset}")
    owned = owned_by(conversations, owner_id)
    if owner_id is not None:
        messages = messages.join(broadcast_if_small(owned.select("conv_id").distinct()), "conv_id", "left_semi")
    page = (
        conversations_with_counts(owned, messages)
        .orderBy(F.col("last_message_ts").desc_nulls_last(), F.col("title").asc_nulls_last(), "conv_id")
        .offset(offset).limit(limit)
    )
    return page.withColumn("total", owned.agg(F.count("*")).scalar()) if with_total else page


def conversation_stats(messages: DataFrame, conv_id: str | None = None) -> DataFrame:
    """Statistics of one conversation, or of all; an unknown id gives no row.

    The first step keeps fixed-width states per (conversation, role), so messages
    are reduced by hashing in the map tasks; the second sees a few rows each.
    """
    scope = messages.where(F.col("conv_id") == conv_id) if conv_id is not None else messages
    per_role = scope.groupBy("conv_id", "role").agg(
        F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"),
        F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"))
    role = F.when(F.col("role") != "", F.col("role"))
    return per_role.groupBy("conv_id").agg(
        F.sum("n").alias("message_count"),
        F.sort_array(F.collect_list(role)).alias("participant_roles"),
        F.min("low").alias("first_message_ts"),
        F.max("high").alias("last_message_ts"),
        F.coalesce(F.try_divide(F.sum("chars"), F.sum("texts")), F.lit(0.0)).alias("average_message_length"),
    )


def timeline(messages: DataFrame, conv_id: str | None = None) -> DataFrame:
    """Messages in time order, per conversation.

    A range sort, not one partition per conversation: a very large conversation
    spreads over several sorted partitions.
    """
    scope = messages.where(F.col("conv_id") == conv_id) if conv_id is not None else messages
    columns = [c for c in ("conv_id", "msg_id", "role", "ts", "text", "parent_id", "meta") if c in scope.columns]
    return scope.select(*columns).orderBy("conv_id", "ts", "msg_id")


def conversation_checksum(messages: DataFrame) -> DataFrame:
    """Order-aware fingerprint of each conversation's messages.

    Every message contributes a digest of its time, id and content hash. The checksum is
    the number of messages and the digests' sum, in four parts of 60 bits modulo 2^60:
    partial results merge map-side, a conversation of any size needs constant memory, and
    a message stored twice changes it.
    """
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    digest = F.sha2(F.concat_ws("|", stamp, F.col("msg_id"), F.col("hash")), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    folded = [F.lpad(F.lower(F.hex((p % F.lit(1 << 60)).cast("bigint"))), 15, "0") for p in parts]
    return messages.groupBy("conv_id").agg(
        F.concat_ws("-", F.count("*").cast("string"), F.concat(*folded)).alias("checksum"))


def duplicate_messages(messages: DataFrame) -> DataFrame:
    """Content hashes shared by several messages, with the first of them."""
    return (
        messages.groupBy("hash").agg(
            F.count("*").alias("copies"),
            F.count_distinct("conv_id").alias("conversations"),
            F.min(F.struct("ts", "conv_id", "msg_id")).alias("first"))
        .where(F.col("copies") > 1)
        .select("hash", "copies", "conversations", F.col("first.conv_id").alias("first_conv_id"),
                F.col("first.msg_id").alias("first_msg_id"))
    )


def table_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    sizes = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
             for name, df in (("conversations", conversations), ("messages", messages))]
    return sizes[0].unionByName(sizes[1])
