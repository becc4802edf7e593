"""Rows packed into blocks, which meet other blocks as single rows.

A block is one row: the Arrow stream of up to ``BLOCK_ROWS`` rows. Products of two sets of
vectors are then a join of few wide rows followed by a matrix product for each pair, and no
pair of vectors ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from threadloom.session import BROADCAST_BYTES, write_measured

BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20


def sealed(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        for batch in rows:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all().combine_chunks()


def packed(rows: DataFrame, key: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key (if given), n, block: the other columns of up to ``block_rows`` rows of one key.

    A map over the partitions; with a key they are sorted by it first, so that a task has one
    block open at a time.
    """
    columns = [c for c in rows.columns if c != key]
    ready = rows.sortWithinPartitions(key) if key else rows
    schema = StructType([rows.schema[key]] if key else []).add("n", "long").add("block", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        at = None

        def row() -> pa.RecordBatch:
            keys = [at] if key else []
            return pa.RecordBatch.from_arrays([*keys, pa.array([n], pa.int64()), pa.array([sealed(held)], pa.binary())],
                                              names=[f.name for f in schema.fields])

        for batch in batches:
            first = 0
            keys = batch.column(key) if key else None
            while first < batch.num_rows:
                last = min(batch.num_rows, first + block_rows - n)
                if key:
                    here = keys.slice(first, 1)
                    if at is not None and not at.equals(here):
                        if held:
                            yield row()
                        held, n, size, last = [], 0, 0, min(batch.num_rows, first + block_rows)
                    at = here
                    same = keys.slice(first, last - first)
                    last = first + _leading(same, here[0])
                held.append(batch.slice(first, last - first).select(columns))
                n, size, first = n + last - first, size + held[-1].get_total_buffer_size() * (last - first) // max(1, batch.num_rows), last
                if n >= block_rows or size >= BLOCK_BYTES:
                    yield row()
                    held, n, size = [], 0, 0
        if held:
            yield row()

    return ready.mapInArrow(run, schema)


def _leading(values: pa.Array, wanted: pa.Scalar) -> int:
    """How many values from the first on equal ``wanted``."""
    import pyarrow.compute as pc

    other = pc.index(pc.equal(values, wanted), pa.scalar(False)).as_py()
    return len(values) if other < 0 else other


def met(stored: DataFrame, asked: DataFrame, key: str | None = None) -> DataFrame:
    """stored, asked: every stored block beside every block asked for, those of one key if there is one.

    The blocks asked for are written and measured. Small ones go out to the stored blocks,
    which stay where they are; larger ones are copied to as many lanes as there are shuffle
    partitions, and the stored blocks are dealt over the lanes.
    """
    table, _, size = write_measured(asked, "asked_blocks", F.length("block") + 64)
    small = size <= BROADCAST_BYTES
    by = key or "lane"
    if key is None:
        lanes = 1 if small else int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        stored = stored.withColumn(by, F.pmod(F.crc32("block"), F.lit(lanes)).cast("int"))
        table = table.withColumn(by, F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    table = table.select(by, F.col("block").alias("asked"))
    return stored.select(by, F.col("block").alias("stored")).join(F.broadcast(table) if small else table, by) \
        .select("stored", "asked")
