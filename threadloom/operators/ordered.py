"""Running sums and row numbers over groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned
by (group, order), written once, summed per (group, slab), and each slab then
continues from the total of the slabs before it. A slab is one range partition,
so the largest group is split like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.session import write_scratch


def write_slabs(rows: DataFrame, group: list[str], order: list[str], value: Column) -> DataFrame:
    """Range-partition narrow rows by (group, order) and write them once, with their slab number."""
    return write_scratch(
        rows.withColumn("_value", value.cast("bigint"))
        .repartitionByRange(*group, *order)
        .withColumn("_slab", F.spark_partition_id()),
        "slabs")


def running_sum(slabs: DataFrame, group: list[str], order: list[str], name: str,
                below: int | None = None) -> DataFrame:
    """Add ``name``, the inclusive running sum of the slabs' value in ``order`` within ``group``.

    Values must not be negative. With ``below`` only rows whose running sum stays
    at or under it are returned, and later slabs are dropped before sorting.
    """
    key = [*group, "_slab"]
    before = Window.partitionBy(*group).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    bases = slabs.groupBy(*key).agg(F.sum("_value").alias("_sum")) \
        .withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    if below is not None:
        bases = bases.where(F.col("_base") <= below)
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = slabs.join(bases, key).withColumn(name, F.col("_base") + F.sum("_value").over(inside))
    if below is not None:
        summed = summed.where(F.col(name) <= below)
    return summed.drop("_slab", "_value", "_base")
