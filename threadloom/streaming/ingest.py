"""Continuous import of a drop folder and embedding of new messages.

A batch of a stream is a load of its own: its id names the stream's checkpoint and the
batch, so a batch repeated after a failure replaces whatever its first attempt wrote.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.ingest import conversations_of, messages_of, refused_of, unfold_exports
from threadloom.operators.filters import split_valid
from threadloom.operators.loads import insert_ignore
from threadloom.operators.vectors import embed_messages
from threadloom.operators.vocabulary import new_words
from threadloom.schemas import MESSAGE_KEY
from threadloom.session import dropped_scratch, rows_of_keys, split_repeated, write_scratch
from threadloom.sources.archives import FILES, read_listed
from threadloom.sources.tables import (LOAD, append_conversations, append_table, ensure_schema, key_partitions, location,
                                       read_loads, read_table)


def load_exports(raw: DataFrame, root: str, owner_id: str = "default", enable_pii: bool = True,
                 load_id: str | None = None, words: bool = False) -> None:
    """Write raw conversations into the tables under ``root``; repeating it adds no message.

    Archives are read, parsed and normalised once, and all that is kept of them is written to
    shared storage in one table. Which messages are new is decided by their keys; texts move
    once more, to their place in the stored table. What cannot be stored is kept, with
    its reason, in ``load_rejects``. A load with an id that has been here before is taken
    for a repetition and replaces the earlier attempt. With ``words`` the stored vocabulary
    is extended by the words of the new messages.
    """
    spark, load_id = raw.sparkSession, load_id or uuid.uuid4().hex
    with dropped_scratch(spark):
        unfolded = write_scratch(unfold_exports(raw, enable_pii), "normalised")
        valid, quarantine = split_valid(messages_of(unfolded))
        order = ["archive", "ordinal", "position", "spot"]
        keys = valid.select(*MESSAGE_KEY, *order)
        stored = key_partitions(spark, root, "messages", keys, load_id)
        new = rows_of_keys(valid, insert_ignore(stored, keys, order=order), keys, ["spot"])
        append_conversations(conversations_of(unfolded, owner_id), root, load_id)
        append_table(new, root, "messages", load_id)
        refused = refused_of(unfolded).select("*", *[F.lit(None).cast("string").alias(c) for c in MESSAGE_KEY]).unionByName(
            quarantine.select("archive", "ordinal", F.array_join("reason", ", ").alias("reason"), *MESSAGE_KEY))
        append_new_rejects(refused, root, load_id)
        if words:
            added = read_loads(spark, root, "messages").where(F.col(LOAD) == load_id)
            known = read_loads(spark, root, "vocabulary").where(F.col(LOAD) != load_id)
            append_table(new_words(known, added), root, "vocabulary", load_id)


def append_new_rejects(rejects: DataFrame, root: str, load_id: str) -> None:
    """Keep rejected rows that no other load has kept already, so that an archive imported twice adds none."""
    stored = read_loads(rejects.sparkSession, root, "load_rejects").where(F.col(LOAD) != load_id).drop(LOAD)
    same = [rejects[c].eqNullSafe(stored[c]) for c in stored.columns]
    append_table(rejects.join(stored, same, "left_anti"), root, "load_rejects", load_id)


def _load_of(checkpoint: str, batch: int) -> str:
    return f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}-{batch:012d}"


def stream_ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, owner_id: str = "default",
                  enable_pii: bool = True, max_files: int = 1000, words: bool = False) -> StreamingQuery:
    """Import every archive dropped into ``folder`` once. The stream carries file names only."""
    ensure_schema(spark, root)
    arrivals = (
        spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).load(folder)
        .select("path", F.col("modificationTime").alias("modified"))
    )
    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda files, batch: load_exports(read_listed(files), root, owner_id, enable_pii,
                                                        _load_of(checkpoint, batch), words))
        .start()
    )


def stream_embed(spark: SparkSession, root: str, checkpoint: str, embedder, dim: int, model: str,
                 retries: int = 3, delay: float = 60.0) -> StreamingQuery:
    """Embed messages as they are appended; messages with an embedding are skipped."""
    ensure_schema(spark, root)
    schema = read_loads(spark, root, "messages").schema
    arrivals = spark.readStream.schema(schema).parquet(location(root, "messages")).select("conv_id", "msg_id", "text")

    def embed(batch: DataFrame, number: int) -> None:
        load_id = _load_of(checkpoint, number)
        with dropped_scratch(spark):
            once, again = split_repeated(batch, MESSAGE_KEY)  # texts that came once stay where they are
            arrived = once.unionByName(again.dropDuplicates(MESSAGE_KEY))
            done = key_partitions(spark, root, "message_embeddings", batch, load_id)
            fresh = embed_messages(arrived, done, embedder, dim, model, retries, delay)
            append_table(fresh.withColumn("created_at", F.current_timestamp()), root, "message_embeddings", load_id)

    return arrivals.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .foreachBatch(embed).start()
