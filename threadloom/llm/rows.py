"""Carrying input rows through an operator without clashes of column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLICE_ROWS = 1000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def boxed(table: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct column ``row``, beside new columns."""
    row = F.struct(*[F.col(quoted(c)) for c in table.columns]).alias("row")
    return table.select(row, *[value.alias(name) for name, value in columns.items()])


def unboxed(table: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """Back to the columns of the input and the added ones, which replace others of the same name."""
    mine = {c.lower() for c in added}
    return table.select(*[F.col("row")[c].alias(c) for c in columns if c.lower() not in mine], *added)


def text_of(column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in shorter pieces, so that a task holds the Python form of few texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


def settled(condition: Column) -> Column:
    """The same condition, computed where it stands.

    A filter on a plain column is moved below the projections that compute it, which puts
    their whole expressions into the filter and evaluates them again for every use. A row
    number beside the condition keeps it a column.
    """
    return condition & (F.monotonically_increasing_id() >= 0)
