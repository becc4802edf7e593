"""Pages at any depth of the conversation list.

A stored listing holds the conversations in the order of the list, cut by ranges into slabs
that are partitions of the table, and beside it the number of rows of every owner in every
slab. The rank of a row is then the sum of the slabs before it plus its place in its own, so
page n opens only the slabs that hold it, however far down it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from threadloom.operators.browse import conversations_with_counts
from threadloom.session import write_measured

SLAB_ROWS = 100_000


def list_order() -> list[Column]:
    """Latest activity first, empty conversations last."""
    return [F.col("last_message_ts").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("conv_id").asc()]


def write_listing(conversations: DataFrame, messages: DataFrame, path: str, slab_rows: int = SLAB_ROWS) -> None:
    """Write the listing of all conversations under ``path``."""
    rows, n, _ = write_measured(conversations_with_counts(conversations, messages), "listing")
    ranged = rows.repartitionByRange(max(1, math.ceil(n / slab_rows)), *list_order()).withColumn("slab", F.spark_partition_id())
    ranged.write.partitionBy("slab").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    counts = _rows(rows.sparkSession, path).groupBy("slab", "owner_id").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/counts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the listing; their columns stand apart, as an empty listing has no rows to tell them."""
    schema = StructType([*spark.read.parquet(f"{path}/columns").schema.fields, StructField("slab", IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def listing_page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0, owner_id: str | None = None) -> DataFrame:
    """``limit`` conversations after the first ``offset`` of all, or of one owner, with their rank from 1."""
    if limit < 1 or offset < 0:
        raise ValueError(f"a page needs limit >= 1 and offset >= 0, got {limit} and {offset}")
    mine = F.lit(True) if owner_id is None else F.col("owner_id") == owner_id
    # One number for each slab.
    sizes = spark.read.schema("slab int, owner_id string, n long").parquet(f"{path}/counts").where(mine).groupBy("slab").agg(F.sum("n").alias("n")).orderBy("slab").collect()
    wanted, before, first = [], 0, None
    for slab in sizes:
        if before < offset + limit and before + slab.n > offset:
            wanted.append(slab.slab)
            first = before if first is None else first
        before += slab.n
    rows = _rows(spark, path).where(F.col("slab").isin(wanted) & mine).drop("slab")
    skipped = offset - (first or 0)
    page = rows.orderBy(*list_order()).offset(skipped).limit(limit)
    # The page is one ordered partition.
    return page.withColumn("rank", F.monotonically_increasing_id() + (offset + 1))
