"""Message embeddings, exact cosine search by blocks, and exact fusion of two rankings."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructType

from threadloom.functions.stem import Stemmer
from threadloom.operators.blocks import met, opened, packed
from threadloom.operators.loads import keys_of
from threadloom.operators.search import ranked_matches, scored_matches
from threadloom.schemas import MESSAGE_KEY
from threadloom.session import broadcast_if_small, rows_of_keys, write_scratch

Embedder = Callable[[Sequence[str]], np.ndarray]
# Fixed value: the published constant of reciprocal-rank fusion.
RANK_OFFSET = 60
OPEN_BLOCKS = 64
# Scores of two blocks that are held at once.
OPEN_SCORES = 1 << 21


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic bag-of-words vectors of unit length; needs no model."""
    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                out[i, code % dim] += 1.0 if code >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def _embed_column(rows: DataFrame, keys: list[str], text: str, embedder: Embedder, dim: int,
                  retries: int = 0, delay: float = 0.0) -> DataFrame:
    def attempt(texts: list[str]) -> np.ndarray:
        for left in range(retries, -1, -1):
            try:
                return embedder(texts)
            except Exception:
                if not left:
                    raise
                time.sleep(delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            vectors = np.asarray(attempt(batch[text].fillna("").tolist()))
            if vectors.shape != (len(batch), dim):
                raise ValueError(f"expected {dim}-dimensional vectors, got {vectors.shape[1:]}")
            yield batch[keys].assign(embedding=list(vectors.astype(np.float32)))

    schema = StructType(rows.select(*keys).schema.fields).add("embedding", ArrayType(FloatType()))
    return rows.select(*keys, text).mapInPandas(run, schema)


def embed_messages(messages: DataFrame, existing: DataFrame, embedder: Embedder, dim: int, model: str,
                   retries: int = 3, delay: float = 60.0) -> DataFrame:
    """Embeddings of the messages that have none yet; a failing provider call is retried.

    Which they are is decided by the keys alone.
    """
    keys = write_scratch(messages.select(*MESSAGE_KEY), "message_keys")
    todo = rows_of_keys(messages.select(*MESSAGE_KEY, "text"), keys.join(keys_of(existing, keys), MESSAGE_KEY, "left_anti"),
                        keys, MESSAGE_KEY)
    return _embed_column(todo, MESSAGE_KEY, "text", embedder, dim, retries, delay) \
        .withColumn("model", F.lit(model))


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows of unit length in double precision; a vector of zeros stays one."""
    lists = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    dense = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    return dense / np.where(norms == 0, 1, norms)


def cosines(stored: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors [asked, stored], to nine places."""
    return np.round(asked @ stored.T, 9)


class _Best:
    """The best ``k`` rows so far of each query of one block, as one table in order of query, score and ids."""

    def __init__(self, queries: int, ids: list[str], k: int) -> None:
        self.ids, self.k = ids, k
        self.least = np.full(queries, -np.inf)
        self.rows: pd.DataFrame | None = None

    def add(self, keys: pd.DataFrame, vectors: np.ndarray, asked: np.ndarray) -> None:
        """Some queries at a time, so that a task holds ``OPEN_SCORES`` scores whatever the blocks' sizes."""
        step = max(1, OPEN_SCORES // max(1, len(vectors)))
        found = []
        for first in range(0, len(asked), step):
            scores = cosines(vectors, asked[first:first + step])
            least = self.least[first:first + step]
            if len(vectors) > self.k:
                least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
            query, row = np.nonzero(scores >= least[:, None])
            if len(row):
                found.append(keys.iloc[row].assign(query=query + first, score=scores[query, row]))
        if not found:
            return
        rows = pd.concat(found if self.rows is None else [self.rows, *found], ignore_index=True)
        rows = rows.sort_values(["query", "score", *self.ids], ascending=[True, False] + [True] * len(self.ids))
        self.rows = rows.groupby("query", sort=False).head(self.k)
        full = self.rows.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.least[full.index] = full["min"]

    def result(self, names: pa.ChunkedArray, schema: pa.Schema) -> pa.RecordBatch:
        if self.rows is None:
            return pa.RecordBatch.from_pylist([], schema)
        names = names.take(pa.array(self.rows["query"].to_numpy())).combine_chunks()
        columns = [pa.array(self.rows[c], schema.field(c).type, from_pandas=True) for c in schema.names[1:]]
        return pa.RecordBatch.from_arrays([names.cast(schema.field("query_id").type), *columns], schema=schema)


def best_of_pairs(pairs: DataFrame, ids: list[str], k: int, schema: StructType) -> DataFrame:
    """query_id, ids, score: the best ``k`` stored rows of each query in every task, from pairs of blocks.

    A pair is opened when its turn comes and no copy of a batch is made; of the queries of a
    block that was met, a task keeps the block as it came and their best rows.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, _Best] = {}

        def closed(block: bytes) -> pa.RecordBatch:
            return states.pop(block).result(opened(block)["query_id"], arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(1)[i].as_py()
                asked, table = opened(block), opened(batch.column(0)[i].as_buffer())
                if block not in states:
                    if len(states) >= OPEN_BLOCKS:
                        yield closed(next(iter(states)))
                    states[block] = _Best(len(asked), ids, k)
                states[block].add(table.select(ids).to_pandas(), unit_rows(table["embedding"]), unit_rows(asked["embedding"]))
        for block in list(states):
            yield closed(block)

    return pairs.mapInArrow(run, schema)


def top_per_query(found: DataFrame, ids: list[str], k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), *ids)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hit_schema(vectors: DataFrame, queries: DataFrame, ids: list[str]) -> StructType:
    return StructType([queries.schema["query_id"], *[vectors.schema[c] for c in ids]]).add("score", DoubleType())


def usable(vectors: DataFrame, *columns: str) -> DataFrame:
    return vectors.select(*columns, "embedding").where(F.col("embedding").isNotNull())


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, ids: list[str] | None = None) -> DataFrame:
    """Exact top ``k`` by cosine similarity for every query (query_id, embedding).

    Both sides are packed into blocks, and every block of vectors meets every block of
    queries. The vectors are read once whatever the number of queries; each task multiplies
    pairs of blocks and passes on ``k`` rows per query, and one small ranking shuffle merges
    them. Rows without a vector take no part.
    """
    ids = ids or MESSAGE_KEY
    pairs = met(packed(usable(vectors, *ids)), packed(usable(queries, "query_id")))
    return top_per_query(best_of_pairs(pairs, ids, k, hit_schema(vectors, queries, ids)), ids, k)


def vectors_ahead(vectors: DataFrame, goals: DataFrame, ids: list[str]) -> DataFrame:
    """query_id, ids, ahead: how many vectors stand before each goal in its query's ranking.

    ``goals``: query_id, embedding (of the query), ids and score of a row of the ranking. The
    goals of a query travel as one row, so it is multiplied once.
    """
    goal = F.struct("score", *ids)
    asked = goals.groupBy("query_id").agg(F.any_value("embedding").alias("embedding"), F.collect_list(goal).alias("goals"))
    pairs = met(packed(usable(vectors, *ids)), packed(asked))
    schema = StructType([goals.schema["query_id"], *[vectors.schema[c] for c in ids]]).add("ahead", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table, wanted = opened(stored), opened(block)
                keys = list(zip(*[table[c].to_pylist() for c in ids]))
                found = cosines(unit_rows(table["embedding"]), unit_rows(wanted["embedding"]))
                out = []
                for query, scores, targets in zip(wanted["query_id"].to_pylist(), found, wanted["goals"].to_pylist()):
                    ordered = np.sort(scores)
                    for target in targets:
                        key = tuple(target[c] for c in ids)
                        ahead = len(ordered) - int(np.searchsorted(ordered, target["score"], side="right"))
                        ahead += sum(keys[i] < key for i in np.flatnonzero(scores == target["score"]))
                        out.append((query, *key, ahead))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return pairs.mapInArrow(run, schema).groupBy("query_id", *ids).agg(F.sum("ahead").alias("ahead"))


def _scored_goals(goals: DataFrame, vectors: DataFrame, asked: DataFrame, ids: list[str]) -> DataFrame:
    """query_id, embedding (of the query), ids, score of the goals that have a vector."""
    pairs = goals.join(usable(vectors, *ids).withColumnRenamed("embedding", "stored"), ids)         .join(asked.select("query_id", "embedding"), "query_id").select("query_id", "embedding", *ids, "stored")
    schema = StructType([*pairs.schema.fields[:-1]]).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.round((unit_rows(batch["embedding"]) * unit_rows(batch["stored"])).sum(axis=1), 9)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=schema.names)

    return pairs.mapInArrow(run, schema)


def matches_ahead(matches: DataFrame, goals: DataFrame) -> DataFrame:
    """query_id, conv_id, msg_id, ahead: how many matches stand before each goal in its query's ranking.

    ``goals`` holds a bounded number of matches per query. They go out as one sorted list per
    query; every match finds its place in the list, and the places are counted.
    """
    place = F.struct((-F.col("score")).alias("a"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"),
                     F.col("conv_id").alias("c"), F.col("msg_id").alias("d"))
    lists = goals.groupBy("query_id").agg(F.sort_array(F.collect_list(place)).alias("goals"))
    counted = matches.join(broadcast_if_small(lists), "query_id")         .select("query_id", F.size(F.filter("goals", lambda g: g <= place)).alias("passed"))         .groupBy("query_id", "passed").agg(F.count("*").alias("n"))
    # A goal has ahead of it the matches that passed fewer goals than its own place.
    placed = lists.select("query_id", F.posexplode("goals").alias("at", "goal"))
    return placed.join(counted, (placed["query_id"] == counted["query_id"]) & (counted["passed"] <= placed["at"]), "left")         .groupBy(placed["query_id"], F.col("goal.c").alias("conv_id"), F.col("goal.d").alias("msg_id"))         .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ahead"))


def _share(rank: str) -> Column:
    return F.coalesce(1 / (F.lit(float(RANK_OFFSET)) + F.col(rank)), F.lit(0.0))


def hybrid_search(messages: DataFrame, embeddings: DataFrame, queries: DataFrame, embedder: Embedder, dim: int,
                  k: int = 10, stemmer: str | Stemmer | None = "english") -> DataFrame:
    """Keyword and vector rankings merged by reciprocal-rank fusion; equal to fusing the whole lists.

    A threshold algorithm. Both lists are read to the depth at which a message not yet seen
    cannot reach the k-th score: k messages of one list score 1 / (60 + k) at least, one unseen
    in both 2 / (61 + depth) at most. Of the messages seen in one list only, those that could
    still enter the result (a bounded number per query) get their exact rank in the other
    list by counting what stands before them.
    """
    depth = 2 * (RANK_OFFSET + k)
    matches = write_scratch(scored_matches(messages, queries, stemmer), "matches")
    asked = write_scratch(_embed_column(queries, ["query_id"], "q", embedder, dim), "asked")
    words = ranked_matches(matches, depth).select("query_id", *MESSAGE_KEY, F.col("rank").alias("word_rank"))
    near = vector_search(embeddings, asked, depth).select("query_id", *MESSAGE_KEY, F.col("rank").alias("vector_rank"))
    key = ["query_id", *MESSAGE_KEY]
    seen = words.join(near, key, "full_outer").withColumn("known", _share("word_rank") + _share("vector_rank"))
    best = Window.partitionBy("query_id").orderBy(F.desc("known"))
    seen = seen.withColumn("nth", F.row_number().over(best))         .withColumn("kth", F.max(F.when(F.col("nth") == k, F.col("known"))).over(Window.partitionBy("query_id")))
    half = F.col("word_rank").isNull() | F.col("vector_rank").isNull()
    possible = F.col("known") + F.when(half, F.lit(1.0 / (RANK_OFFSET + 1 + depth))).otherwise(F.lit(0.0))
    finalists = write_scratch(seen.where(F.col("kth").isNull() | (possible >= F.col("kth") - 1e-9))
                              .select(*key, "word_rank", "vector_rank"), "finalists")

    unplaced = finalists.where("word_rank IS NULL").select(*key).join(matches, key)
    word_ranks = matches_ahead(matches, unplaced).select(*key, (F.col("ahead") + 1).alias("late_word"))
    goals = _scored_goals(finalists.where("vector_rank IS NULL").select(*key), embeddings, asked, MESSAGE_KEY)
    vector_ranks = vectors_ahead(embeddings, write_scratch(goals, "goals"), MESSAGE_KEY).select(
        *key, (F.col("ahead") + 1).alias("late_vector"))
    exact = finalists.join(word_ranks, key, "left").join(vector_ranks, key, "left").select(
        *key, F.coalesce("word_rank", "late_word").alias("word_rank"), F.coalesce("vector_rank", "late_vector").alias("vector_rank"))
    fused = exact.withColumn("score", F.round(_share("word_rank") + _share("vector_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *MESSAGE_KEY)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
