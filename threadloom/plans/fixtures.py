"""The given tables seen as the data model."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; on one machine, where a table is one small file, spread over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    context = spark.sparkContext
    return rows.repartition(context.defaultParallelism) if context.master.startswith("local[") else rows


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: an hour per conversation, a minute per turn, replies as a binary tree."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("string").alias("msg_id"),
        "role",
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int), 0)")
        .alias("ts"),
        "text",
        F.expr("CASE WHEN turn > 0 THEN cast((turn - 1) div 2 AS string) END").alias("parent_id"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, and for one in nine another that has no message."""
    ids = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    ids = ids.union(ids.where(F.col("conv_id") % 9 == 0).select(-1 - F.col("conv_id")))
    return ids.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.when(F.abs("conv_id") % 7 != 0, F.concat(F.lit("Chat "), F.col("conv_id").cast("string"))).alias("title"),
        F.concat(F.lit("owner_"), (F.abs("conv_id") % 5).cast("string")).alias("owner_id"),
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as messages: one conversation per source, a minute per document."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("conv_id"),
        F.col("doc_id").cast("string").alias("msg_id"),
        F.lit("user").alias("role"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int), 0)").alias("ts"),
        "text",
        F.lit(None).cast("string").alias("parent_id"),
    )


def write_archives(conversations: DataFrame, folder: str, name: str | None = None) -> None:
    """Write conversation texts as ZIP exports into a folder: one archive per partition, or per value of column ``name``.

    A name of which the only text is null becomes a file that is no archive.
    """
    rows = conversations.select(F.col(name) if name else F.lit(None).cast("string").alias("name"), "conversation")
    if name:
        rows = rows.repartition(name).sortWithinPartitions(name)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        store.create_dir(inner)
        at, texts = None, None
        for batch in batches:
            for title, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts is None or title != at:
                    if texts is not None:
                        texts.close()
                    at, texts = title, _ArchiveFile(store, f"{inner}/{title or uuid.uuid4().hex}.zip")
                texts.add(text)
        if texts is None and not name:
            texts = _ArchiveFile(store, f"{inner}/{uuid.uuid4().hex}.zip")
            texts.start()
        if texts is not None:
            texts.close()
        yield pa.RecordBatch.from_arrays([pa.array([inner])], names=["folder"])

    rows.mapInArrow(pack, "folder string").write.format("noop").mode("overwrite").save()


class _ArchiveFile:
    """A ZIP export being written."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.stream, self.archive = store.open_output_stream(path, compression=None), None

    def start(self) -> None:
        self.archive = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_DEFLATED)
        self.member = self.archive.open("conversations.json", "w", force_zip64=True)
        self.separator = b"["

    def add(self, text: str | None) -> None:
        if text is None:
            self.stream.write(b"not an archive")
            return
        if self.archive is None:
            self.start()
        self.member.write(self.separator + text.encode())
        self.separator = b",\n"

    def close(self) -> None:
        if self.archive is not None:
            self.member.write(b"]" if self.separator != b"[" else b"[]")
            self.member.close()
            self.archive.close()
        self.stream.close()
