"""Columns that turn one export node into one message row.

Exports vary in shape, so message payloads stay variants until a field is read.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.functions.redact import redact
from threadloom.functions.text import safe_text, strip_space

CONVERSATION = ("id string, title string, create_time variant, update_time variant, "
                "mapping map<string, variant>")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_of(value: Column) -> Column:
    """String as is, other values as JSON; empty and false values are no text."""
    rendered = F.to_json(value)
    return F.when(value.isNull() | rendered.isin("null", "{}", "[]", "0", "0.0", "false"), F.lit("")) \
        .when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")) \
        .otherwise(rendered)


def content_text(fields: Column) -> Column:
    """Body of a message: string parts joined by newlines, else content, else text."""
    content = fields["content"]
    parts = F.try_variant_get(content, "$.parts", "array<variant>")
    strings = F.transform(F.filter(parts, lambda p: _kind(p) == "STRING"),
                          lambda p: F.try_variant_get(p, "$", "string"))
    return F.when(parts.isNotNull(), F.array_join(strings, "\n")) \
        .when(F.map_contains_key(fields, "content"), _text_of(content)) \
        .otherwise(_text_of(fields["text"]))


def moment(value: Column) -> Column:
    """Timestamp of an epoch number or ISO string; zero and unreadable values give NULL."""
    seconds = F.nullif(F.try_variant_get(value, "$", "double"), F.lit(0.0))
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string").try_cast("timestamp")) \
        .otherwise(F.timestamp_seconds(seconds))


def _string(fields: Column, name: str) -> Column:
    return F.try_variant_get(fields[name], "$", "string")


def role(fields: Column) -> Column:
    author = F.try_variant_get(fields["author"], "$.role", "string")
    return F.coalesce(F.nullif(_string(fields, "role"), F.lit("")), F.nullif(author, F.lit("")), F.lit("user"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(strip_space(safe_text(text))), 256)


def message_columns(fields: Column, raw: Column, node_id: Column, node_parent: Column, fallback_ts: Column,
                    enable_pii: bool = True, hash_on: str = "raw") -> dict[str, Column]:
    """Message columns of a payload given as map<string, variant> and its body text."""
    text = redact(raw, enable_pii)
    digest = content_hash(raw if hash_on == "raw" else text)
    source = F.when(F.map_contains_key(fields, "source"), _string(fields, "source")) \
        .otherwise(F.lit("chatgpt_export"))
    return {
        "msg_id": F.coalesce(_string(fields, "id"), node_id, F.left(digest, F.lit(8))),
        "role": role(fields),
        "ts": F.coalesce(moment(fields["create_time"]), moment(fields["timestamp"]), fallback_ts),
        "text": text,
        "parent_id": F.coalesce(_string(fields, "parent"), node_parent),
        "hash": digest,
        "meta": F.struct(_string(fields, "model").alias("model"), source.alias("source")),
    }
