"""Parquet tables of the data model under one root folder.

Every table is partitioned by ``load_id``, the import that wrote the rows. Writing a load
again replaces what an earlier attempt of it left, so an import that failed between two
tables is repeated as a whole. Beside the large tables stand narrow tables of their keys,
partitioned by a hash of the conversation: an import opens the partitions of its own
conversations only, whatever the size of the archive.

``conversations`` is kept as changes and collapsed on read, because Parquet has no in-place
update: the first owner and creation time stay, the last title wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from threadloom.schemas import CONVERSATIONS, MESSAGE_KEY, TABLES
from threadloom.session import delete_path, make_path

KEY_BUCKETS = 256
LOAD = "load_id"
_ARRIVAL = ["loaded_at", "archive", "ordinal"]
_CLUSTER = {"messages": ["conv_id", "ts", "msg_id"], "message_embeddings": ["conv_id", "msg_id"]}
_KEYED = ("messages", "message_embeddings")


def location(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _key_schema() -> StructType:
    fields = [f for f in TABLES["messages"].fields if f.name in MESSAGE_KEY]
    return StructType([*fields, StructField("bucket", StringType()), StructField(LOAD, StringType())])


def bucket_of(conv_id: Column) -> Column:
    """The key partition of a conversation."""
    return F.format_string("%04d", F.pmod(F.xxhash64(conv_id), F.lit(KEY_BUCKETS)))


def ensure_schema(spark: SparkSession, root: str) -> None:
    """Create the folders of the missing tables, empty."""
    for name in [*TABLES, *(f"{name}_keys" for name in _KEYED)]:
        make_path(spark, location(root, name))


def read_loads(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with the load of every row; the schema is fixed, so no file is opened to infer it."""
    schema = StructType([*TABLES[name].fields, StructField(LOAD, StringType())])
    return spark.read.schema(schema).parquet(location(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_loads(spark, root, name).select(TABLES[name].names)


def read_conversations(spark: SparkSession, root: str) -> DataFrame:
    """Conversations as they stand after all imports."""
    turn = F.struct(*_ARRIVAL)
    kept = [c for c in CONVERSATIONS.names if c not in ("conv_id", "title")]
    return read_table(spark, root, "conversations").groupBy("conv_id").agg(
        F.max_by("title", turn).alias("title"),
        F.min_by(F.struct(*kept), turn).alias("first"),
    ).select("conv_id", "title", "first.*").select(CONVERSATIONS.names)


def append_table(rows: DataFrame, root: str, name: str, load_id: str | None = None) -> None:
    """Write the rows of a load, in place of what an earlier attempt of the same load wrote.

    The large tables are clustered by conversation and time so that scans can skip files;
    range clustering splits a large conversation over several files. Their keys follow.
    """
    load_id = load_id or uuid.uuid4().hex
    spark = rows.sparkSession
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields if f.name not in rows.columns]
    ready = rows.select("*", *absent).select(TABLES[name].names)
    if name in _CLUSTER:
        ready = ready.repartitionByRange(*_CLUSTER[name]).sortWithinPartitions(*_CLUSTER[name])
    _replace(ready, root, name, load_id)
    if name in _KEYED:
        written = spark.read.schema(TABLES[name]).parquet(f"{location(root, name)}/{LOAD}={load_id}")
        keys = written.select(*MESSAGE_KEY, bucket_of(F.col("conv_id")).alias("bucket"))
        dealt = keys.repartitionByRange("bucket", *MESSAGE_KEY).sortWithinPartitions("bucket", *MESSAGE_KEY)
        _replace(dealt, root, f"{name}_keys", load_id, "bucket")


def _replace(rows: DataFrame, root: str, name: str, load_id: str, *partitions: str) -> None:
    """Write one load's partition of a table; what stood there is gone, also if no row follows."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{location(root, name)}/{LOAD}={load_id}")


def drop_load(spark: SparkSession, root: str, load_id: str) -> None:
    """Take a load out of all tables."""
    for name in [*TABLES, *(f"{name}_keys" for name in _KEYED)]:
        delete_path(spark, f"{location(root, name)}/{LOAD}={load_id}")


def key_partitions(spark: SparkSession, root: str, name: str, arriving: DataFrame, load_id: str | None = None) -> DataFrame:
    """conv_id, msg_id of the key partitions that can hold conversations of ``arriving``, other loads' only.

    The partitions, ``KEY_BUCKETS`` at most, are chosen before the table is opened.
    """
    wanted = [r.bucket for r in arriving.select(bucket_of(F.col("conv_id")).alias("bucket")).distinct().collect()]
    keys = spark.read.schema(_key_schema()).parquet(location(root, f"{name}_keys"))
    return keys.where(F.col("bucket").isin(wanted) & (F.col(LOAD) != F.lit(load_id or ""))).select(*MESSAGE_KEY)


def append_conversations(headers: DataFrame, root: str, load_id: str | None = None) -> None:
    append_table(headers.withColumn("loaded_at", F.current_timestamp()), root, "conversations", load_id)
