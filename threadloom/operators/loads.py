"""Idempotent loads: key collapse, insert-ignore, title upsert, cascading delete, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.schemas import MESSAGE_KEY
from threadloom.session import broadcast_if_small, write_scratch


def dedupe_by_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate, not a ranking window: copies collapse in the map tasks, so a key
    repeated across much of the input is never gathered in one place.
    """
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*key).agg(first).select(*key, "_first.*").select(*rows.columns)


def insert_ignore(target: DataFrame, incoming: DataFrame, key: list[str] = MESSAGE_KEY,
                  order: list[str] | None = None) -> DataFrame:
    """The incoming rows an insert that ignores existing keys would add.

    The collapsed incoming rows are written once. ``target`` is any table with the key
    columns; only its rows of arriving conversations (the first key column) are compared.
    For stored tables pass ``tables.stored_keys``, which opens no other partitions.
    """
    order = order or [c for c in incoming.columns if c not in key]
    fresh = write_scratch(dedupe_by_key(incoming, key, order), "incoming")
    return fresh.join(keys_of(target, fresh, key), key, "left_anti")


def keys_of(target: DataFrame, incoming: DataFrame, key: list[str] = MESSAGE_KEY) -> DataFrame:
    """Keys of ``target`` that share their first column with an incoming row."""
    arriving = broadcast_if_small(incoming.select(key[0]).distinct())
    return target.select(*key).join(arriving, key[0], "left_semi")


def upsert_title(target: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All conversations after an import: new ones added, known ones take the last title.

    Owner and creation time of a known conversation stay as they are.
    """
    turn = F.struct(*(order or [c for c in incoming.columns if c != "conv_id"]))
    kept = [c for c in target.columns if c not in ("conv_id", "title")]
    latest = incoming.groupBy("conv_id").agg(
        F.max_by("title", turn).alias("new_title"),
        *[F.min_by(c, turn).alias(f"new_{c}") for c in kept if c in incoming.columns],
    ).withColumn("arrived", F.lit(True))
    joined = target.withColumn("known", F.lit(True)).join(latest, "conv_id", "full_outer")

    def settled(name: str):
        if name == "conv_id":
            return F.col(name)
        if name == "title":
            return F.when(F.col("arrived"), F.col("new_title")).otherwise(F.col("title")).alias("title")
        fresh = F.col(f"new_{name}") if name in incoming.columns else F.lit(None)
        return F.when(F.col("known"), F.col(name)).otherwise(fresh).alias(name)

    return joined.select(*[settled(c) for c in target.columns])


def cascade_delete(conv_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted conversations."""
    gone = broadcast_if_small(conv_ids.select("conv_id").distinct())
    return {name: rows.join(gone, "conv_id", "left_anti") for name, rows in tables.items()}


def import_summary(attempted: DataFrame, inserted: DataFrame, conversations: DataFrame) -> DataFrame:
    """Attempted and inserted messages and conversations seen, as one row."""
    return conversations.agg(F.count("*").alias("conversations")).select(
        attempted.agg(F.count("*")).scalar().alias("imported"),
        inserted.agg(F.count("*")).scalar().alias("inserted"),
        "conversations")
