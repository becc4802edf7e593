"""Approximate nearest vectors: an inverted file of cells on storage.

The cells' centres are fitted by k-means on at most ``SAMPLE`` vectors, those with the least
hashes of their ids; every vector is then assigned to the cell whose centre is nearest, and
the table is written partitioned by cell. A search sends each query to its ``probes`` nearest
cells, opens only those partitions and multiplies blocks of queries and vectors cell by cell,
as the exact search does for all vectors. With all cells probed the result is exact.

How many cells have to be probed depends on the vectors. The index measures it when it is built:
``CALIBRATION`` of its own vectors are searched exactly, and ``probes`` is the least number of
cells that hold the wanted share of their true neighbours.

The number of cells follows the square root of the number of vectors up to one cell for
``ROWS_PER_CELL`` sampled vectors, so the centres, which travel with the tasks, stay bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from threadloom.operators.blocks import met, packed
from threadloom.operators.vectors import best_of_pairs, hit_schema, top_per_query, unit_rows, usable, vector_search
from threadloom.schemas import MESSAGE_KEY
from threadloom.session import write_scratch

SAMPLE = 20_000
ROWS_PER_CELL = 32
ROUNDS = 15
CALIBRATION = 200
RECALL = 0.95


@dataclass(frozen=True)
class CellIndex:
    """A stored index: its folder, the ids of its rows, the centres of its cells, and the cells to probe for its recall."""

    path: str
    ids: tuple[str, ...]
    centres: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def fit_cells(vectors: DataFrame, cells: int, ids: list[str] | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of up to ``cells`` cells, from at most ``sample`` vectors."""
    dense = usable(vectors, *(ids or MESSAGE_KEY)).where(F.exists("embedding", lambda x: x != 0))
    chosen = dense.orderBy(F.xxhash64(*(ids or MESSAGE_KEY))).limit(sample) \
        .select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), distanceMeasure="cosine", maxIter=ROUNDS, seed=7).fit(chosen)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def with_cells(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """Rows with ``cell``, once for each of their ``probes`` nearest cells, and ``nth``, its place among them from 1."""
    probes = min(probes, len(centres))
    schema = StructType([*rows.schema.fields]).add("cell", IntegerType()).add("nth", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = np.argsort(-(unit_rows(batch["embedding"]) @ centres.T), axis=1, kind="stable")[:, :probes]
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), probes)))
            nth = np.tile(np.arange(1, probes + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel().astype(np.int32)), pa.array(nth)], names=schema.names)

    return rows.mapInArrow(run, schema)


def build_index(vectors: DataFrame, path: str, ids: list[str] | None = None, cells: int | None = None,
                sample: int = SAMPLE, recall: float = RECALL) -> CellIndex:
    """Fit cells, assign every vector, write the index under ``path`` and measure how many cells ``recall`` takes."""
    ids = ids or MESSAGE_KEY
    n = usable(vectors, *ids).count()
    cells = cells or max(2, min(math.isqrt(n), sample // ROWS_PER_CELL))
    index = CellIndex(path, tuple(ids), fit_cells(vectors, cells, ids, sample), 0)
    spark = vectors.sparkSession
    extend_index(index, vectors)
    index = replace(index, probes=_calibrated(index, spark, recall))
    rows = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")
    return index


def _calibrated(index: CellIndex, spark: SparkSession, recall: float, k: int = 10) -> int:
    """Cells to probe so that the share ``recall`` of the true neighbours of some stored vectors is found, themselves left out."""
    ids = list(index.ids)
    stored = index.vectors(spark)
    some = stored.orderBy(F.xxhash64(*ids)).limit(CALIBRATION).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
    asked = write_scratch(some, "asked")
    near = vector_search(stored, asked, k + 1, ids).where(F.col("rank") > 1).select("query_id", *ids)
    cells_of = near.join(stored.select(*ids, "cell"), ids).select("query_id", "cell")
    places = cells_of.join(with_cells(asked, index.centres, len(index.centres)), ["query_id", "cell"])
    found = {r.nth: r.n for r in places.groupBy("nth").agg(F.count("*").alias("n")).collect()}
    total, sums = sum(found.values()), 0
    for probes in range(1, len(index.centres) + 1):
        sums += found.get(probes, 0)
        if sums >= recall * total:
            return probes
    return len(index.centres)


def extend_index(index: CellIndex, vectors: DataFrame) -> None:
    """Add vectors to the cells of an index. Large cells are written by several tasks."""
    placed = with_cells(usable(vectors, *index.ids), index.centres).drop("nth")
    placed.repartitionByRange("cell", F.xxhash64(*index.ids)).sortWithinPartitions("cell") \
        .write.mode("append").partitionBy("cell").parquet(f"{index.path}/vectors")


def open_index(spark: SparkSession, path: str, ids: list[str] | None = None) -> CellIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return CellIndex(path, tuple(ids or MESSAGE_KEY), np.array([r.centre for r in rows]), rows[0].probes)


def search_index(index: CellIndex, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """Top ``k`` by cosine similarity among the vectors in each query's ``probes`` nearest cells, by default the index's own number."""
    ids = list(index.ids)
    asked = with_cells(usable(queries, "query_id"), index.centres, probes or index.probes).drop("nth")
    # At most as many as there are cells, which the sample bounds: the partitions to be opened.
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]
    stored = index.vectors(queries.sparkSession).where(F.col("cell").isin(wanted))
    dealt = asked.repartitionByRange("cell", "query_id")
    pairs = met(packed(stored.select("cell", *ids, "embedding"), "cell"), packed(dealt, "cell"), "cell")
    return top_per_query(best_of_pairs(pairs, ids, k, hit_schema(stored, queries, ids)), ids, k)


def search_quality(index: CellIndex, queries: DataFrame, exact: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, found, of, read, stored: how many of the exact best ``k`` a search finds, and how many vectors it reads."""
    ids = list(index.ids)
    hits = search_index(index, queries, k, probes).select("query_id", *ids, F.lit(1).alias("hit"))
    found = exact.select("query_id", *ids).join(hits, ["query_id", *ids], "left") \
        .groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("of"))
    sizes = index.vectors(queries.sparkSession).groupBy("cell").agg(F.count("*").alias("rows"))
    read = with_cells(usable(queries, "query_id"), index.centres, probes or index.probes).join(F.broadcast(sizes), "cell", "left") \
        .groupBy("query_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("read"))
    return found.join(read, "query_id").select("*", sizes.agg(F.sum("rows")).scalar().alias("stored"))
