"""Row filters shared by the query operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.text import split_message_id
from threadloom.functions.times import normalise_iso, within
from threadloom.schemas import ROLES
from threadloom.session import broadcast_if_small


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def owned_by(conversations: DataFrame, owner_id: str | None) -> DataFrame:
    return conversations.where(F.col("owner_id") == owner_id) if owner_id else conversations


def window(messages: DataFrame, date_from=None, date_to=None, conv_id: str | None = None) -> DataFrame:
    """Messages of a time window and, if given, one conversation; blanks mean no filter."""
    predicates = within(messages, normalise_iso(date_from), normalise_iso(date_to))
    if conv_id:
        predicates.append(F.col("conv_id") == conv_id)
    return messages.where(all_of(predicates))


def search_filters(messages: DataFrame, filters: dict | None) -> DataFrame:
    """Apply the keys that are present; a present null matches nothing, unknown keys are ignored."""
    given = filters or {}
    known = [key for key in ("role", "conv_id", "date_from", "date_to") if key in given]
    if any(given[key] is None for key in known):
        return messages.where(F.lit(False))
    predicates = within(messages, normalise_iso(given.get("date_from")), normalise_iso(given.get("date_to")))
    predicates += [F.col(key) == given[key] for key in ("role", "conv_id") if key in known]
    return messages.where(all_of(predicates))


def by_ids(messages: DataFrame, ids: DataFrame, column: str = "message_id") -> DataFrame:
    """Messages named by ``conv/msg`` ids: exact pairs, each message once."""
    conv_id, msg_id = split_message_id(F.col(column))
    wanted = ids.select(conv_id.alias("conv_id"), msg_id.alias("msg_id")).distinct()
    return messages.join(broadcast_if_small(wanted), ["conv_id", "msg_id"], "left_semi")


def with_tags(messages: DataFrame, tags: DataFrame, wanted: list[str], match: str = "any") -> DataFrame:
    """Messages carrying any, or all, of the wanted tags."""
    names = sorted(set(wanted))
    hits = tags.where(F.col("tag").isin(names)).groupBy("conv_id", "msg_id") \
        .agg(F.count_distinct("tag").alias("n"))
    need = len(names) if match == "all" else 1
    return messages.join(hits.where(F.col("n") >= need), ["conv_id", "msg_id"], "left_semi")


def split_valid(messages: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into rows that satisfy the table constraints and rows that do not.

    Rejected rows carry a ``reason`` array.
    """
    checks = [
        ("conv_id is null", F.col("conv_id").isNull()),
        ("msg_id is null", F.col("msg_id").isNull()),
        ("role not allowed", ~F.col("role").isin(ROLES)),
        ("ts is null", F.col("ts").isNull()),
        ("text is null", F.col("text").isNull()),
    ]
    checked = messages
    if conversations is not None:
        orphans = orphan_conversations(messages, conversations).select("conv_id", F.lit(True).alias("_orphan"))
        checked = messages.join(broadcast_if_small(orphans), "conv_id", "left")
        checks.append(("conversation is unknown", F.coalesce("_orphan", F.lit(False))))
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    checked = checked.withColumn("reason", reasons).drop("_orphan")
    return (checked.where(F.size("reason") == 0).drop("reason"),
            checked.where(F.size("reason") > 0))


def orphan_conversations(children: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversation ids used by a child table but missing from the parent, with row counts.

    Children are reduced to one row per conversation before the join, so a
    conversation holding most of the rows costs no more than any other.
    """
    used = children.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.count("*").alias("orphan_rows"))
    return used.join(conversations.select("conv_id"), "conv_id", "left_anti")


def fk_orphans(children: DataFrame, conversations: DataFrame) -> DataFrame:
    """Child rows whose conversation does not exist."""
    missing = orphan_conversations(children, conversations).select("conv_id")
    return children.join(broadcast_if_small(missing), "conv_id", "left_semi")


def message_orphans(children: DataFrame, messages: DataFrame) -> DataFrame:
    """Tag, embedding or analytics rows whose message does not exist."""
    return children.join(messages.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti")
