"""From raw export conversations to conversation and message rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.normalise import CONVERSATION, content_text, message_columns, moment
from threadloom.operators.filters import split_valid
from threadloom.operators.loads import import_summary, insert_ignore, upsert_title
from threadloom.session import write_scratch

ARRIVAL = ["archive", "ordinal"]
NO_CONVERSATION = "not a conversation object with an id"


def parse_exports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw rows into parsed conversations (column ``c``) and rejected rows with a reason."""
    parsed = raw.withColumn("c", F.from_json("conversation", CONVERSATION))
    good = F.col("error").isNull() & F.col("c.id").isNotNull()
    rejects = parsed.where(~good).select(
        *ARRIVAL, F.coalesce("error", F.lit(NO_CONVERSATION)).alias("reason"))
    return parsed.where(good).drop("conversation", "error"), rejects


def project_conversations(parsed: DataFrame, owner_id: str = "default") -> DataFrame:
    return _conversation_rows(parsed.select(F.col("c.id").alias("conv_id"), F.col("c.title").alias("title"), "modified", *ARRIVAL),
                              owner_id)


def _conversation_rows(headers: DataFrame, owner_id: str) -> DataFrame:
    return headers.select(
        "conv_id", F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.lit(owner_id).alias("owner_id"), F.col("modified").alias("created_at"), *ARRIVAL)


def explode_messages(parsed: DataFrame) -> DataFrame:
    """One row per node that has a message: payload fields, node id and parent, fallback time."""
    return _nodes(parsed, F.posexplode).where(F.size("fields") > 0)


def _nodes(parsed: DataFrame, explode: Callable, **more: Column) -> DataFrame:
    started = F.coalesce(moment(F.col("c.create_time")), moment(F.col("c.update_time")), F.col("modified"))
    nodes = parsed.select(F.col("c.id").alias("conv_id"), started.alias("fallback_ts"), *ARRIVAL,
                          *[column.alias(name) for name, column in more.items()],
                          explode("c.mapping").alias("position", "node_id", "node"))
    return nodes.select(
        "conv_id", "fallback_ts", *ARRIVAL, *more, "position", "node_id",
        F.try_variant_get("node", "$.parent", "string").alias("node_parent"),
        F.try_variant_get("node", "$.message", "map<string,variant>").alias("fields"))


def normalise_messages(nodes: DataFrame, ingest_ts: Column | None = None, enable_pii: bool = True,
                       hash_on: str = "raw", more: Sequence[str] = ()) -> DataFrame:
    """Message rows plus their arrival order and the columns ``more``; ``ingest_ts`` replaces the archive time as last resort."""
    fallback = F.col("fallback_ts") if ingest_ts is None else F.coalesce("fallback_ts", ingest_ts)
    columns = message_columns(F.col("fields"), F.col("raw"), F.col("node_id"), F.col("node_parent"), fallback,
                              enable_pii, hash_on)
    return nodes.withColumn("raw", content_text(F.col("fields"))).select("conv_id", *[c.alias(name) for name, c in columns.items()], *ARRIVAL, "position", *more)


def unfold_exports(raw: DataFrame, enable_pii: bool = True) -> DataFrame:
    """All that an import keeps of raw conversations, in one pass: a row per node, or per conversation without any.

    ``is_message`` marks nodes with a message, ``is_head`` the row that stands for the
    conversation (modified, title), or, with ``refused``, for a row that is none. ``spot``
    numbers the rows once they are written.
    """
    parsed = raw.withColumn("c", F.from_json("conversation", CONVERSATION))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("c.id").isNull(), F.lit(NO_CONVERSATION))
    parsed = parsed.select("modified", *ARRIVAL, reason.alias("refused"), F.when(reason.isNull(), F.col("c")).alias("c"))
    nodes = _nodes(parsed, F.posexplode_outer, modified=F.col("modified"), title=F.col("c.title"), refused=F.col("refused"))
    marked = nodes.withColumn("is_message", F.coalesce(F.size("fields") > 0, F.lit(False))) \
        .withColumn("is_head", F.coalesce("position", F.lit(0)) == 0)
    return normalise_messages(marked, enable_pii=enable_pii, more=["modified", "title", "refused", "is_message", "is_head"]) \
        .withColumn("spot", F.monotonically_increasing_id())


def conversations_of(unfolded: DataFrame, owner_id: str = "default") -> DataFrame:
    """The conversations of :func:`unfold_exports`, as :func:`project_conversations` gives them."""
    return _conversation_rows(unfolded.where(F.col("is_head") & F.col("refused").isNull()), owner_id)


def messages_of(unfolded: DataFrame) -> DataFrame:
    return unfolded.where("is_message").drop("modified", "title", "refused", "is_message", "is_head")


def refused_of(unfolded: DataFrame) -> DataFrame:
    """archive, ordinal, reason of raw rows that are no conversation."""
    return unfolded.where(F.col("is_head") & F.col("refused").isNotNull()).select(*ARRIVAL, F.col("refused").alias("reason"))


@dataclass
class Import:
    """What an import would change; every field is a lazy DataFrame over written tables."""

    conversations: DataFrame
    new_messages: DataFrame
    quarantine: DataFrame
    rejects: DataFrame
    summary: DataFrame


def ingest_export(raw: DataFrame, conversations: DataFrame, messages: DataFrame, owner_id: str = "default",
                  enable_pii: bool = True, hash_on: str = "raw") -> Import:
    """Import raw conversations into the given tables; a repeated import adds nothing.

    The export is parsed for its conversations and for its messages, and both are written
    once: the parts of the result that are acted on read those tables.
    """
    parsed, rejects = parse_exports(raw)
    headers = write_scratch(project_conversations(parsed, owner_id), "headers")
    attempted = write_scratch(normalise_messages(explode_messages(parsed), enable_pii=enable_pii, hash_on=hash_on),
                              "normalised")
    valid, quarantine = split_valid(attempted)
    new = insert_ignore(messages, valid, order=[*ARRIVAL, "position"]).drop(*ARRIVAL, "position")
    return Import(
        conversations=upsert_title(conversations, headers, ARRIVAL),
        new_messages=new,
        quarantine=quarantine,
        rejects=rejects,
        summary=import_summary(attempted, new, headers),
    )
