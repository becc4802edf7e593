"""Hard negatives by exact integer inner products in a residue number system.

Every component x becomes floor(256 * x). The scores of anchors against all rows are matrix
products modulo several primes below 1,024: residues lie within half a prime on either side of
zero, so that 64 products of them sum to less than 2^24 and a float32 product is exact. The
Chinese remainder theorem (mixed radix digits) gives the exact signed scores back; the largest
component of the data decides how many primes are needed.

The anchors are the stated query set. Blocks of anchors meet groups of rows, dealt by a hash of
the row, and every cell of that grid sends on the best few rows of each anchor; a window merges
the cells. A first pass finds each anchor's positives, the best rows of its own label, a second
one the best rows of other labels within the score window of each positive.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no
part; a shorter vector counts as padded with zeros; rows repeated in the input are rows of their
own, an anchor only leaves out itself; ties go by smaller vec_id, null ids last; an empty table
or one without anchors gives an empty result; other columns are ignored. Scores beyond 2^54
raise an error, as they would not fit the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from threadloom.session import write_scratch

PRIME_LIMIT = 1024
INNER = 64
ANCHOR_ROWS = 4096
GROUP_ROWS = 1 << 17
LEAST_GROUPS = 16
TILE = (256, 1 << 14)
NONE = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes below PRIME_LIMIT whose product exceeds every signed number up to ``bound``."""
    chosen: list[int] = []
    for p in range(PRIME_LIMIT - 1, 2, -1):
        if math.prod(chosen) > 2 * bound:
            break
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            chosen.append(p)
    return chosen


def residues(numbers: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers nearest to zero, as float32."""
    rest = np.mod(numbers, p)
    return np.where(rest > p // 2, rest - p, rest).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p; every partial sum stays below 2^24."""
    total = np.zeros((len(a), len(b)), dtype=np.int64)
    for first in range(0, a.shape[1], INNER):
        total += (a[:, first:first + INNER] @ b[:, first:first + INNER].T).astype(np.int64)
    return total % p


def exact_scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Signed integer products from residue matrices, one pair for each modulus."""
    score, digits, radix = None, [], 1
    for k, p in enumerate(moduli):
        digit = product_modulo(a[k], b[k], p)
        for j, q in enumerate(moduli[:k]):
            digit = (digit - digits[j]) * pow(q, -1, p) % p
        digits.append(digit)
        score = digit if score is None else score + digit * radix
        radix *= p
    return np.where(score > radix // 2, score - radix, score)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, column) of each row among allowed columns, smaller columns first on ties; column -1: none."""
    bits = (scores.shape[1] - 1).bit_length()
    place = np.int64((1 << bits) - 1) - np.arange(scores.shape[1], dtype=np.int64)
    keys = np.where(allowed, (scores << bits) + place, NONE)
    if keys.shape[1] > k:
        keys = np.partition(keys, -k, axis=1)[:, -k:]
    column = (np.int64((1 << bits) - 1)) - (keys & np.int64((1 << bits) - 1))
    return keys >> bits, np.where(keys == NONE, -1, column)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """floor(256 * x) of list values as whole doubles, shorter rows padded with zeros."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def usable(vectors: DataFrame, anchor: Column) -> tuple[DataFrame, int, int, int]:
    """Rows that take part, written once with a row number; their number, that of anchors, and a bound of scores."""
    value = F.col("embedding")
    fine = F.col("label").isNotNull() & value.isNotNull() & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(fine).select(
        "vec_id", "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.monotonically_increasing_id().alias("row_no"))
    largest = F.aggregate("embedding", F.lit(0.0), lambda most, x: F.greatest(most, F.abs(x.cast("double"))))
    seen = Observation()
    rows = write_scratch(rows.observe(
        seen, F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max(largest).alias("largest"),
        F.max(F.size("embedding")).alias("width")), "vectors")
    found = seen.get
    whole = int(256 * (found["largest"] or 0)) + 1
    return rows, found["rows"], found["anchors"], whole * whole * max(1, found["width"] or 0)


def _cells(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the grid: anchors once for each group of rows, rows once for each block of anchors."""
    groups = max(LEAST_GROUPS, math.ceil(n_rows / GROUP_ROWS))
    blocks = max(1, math.ceil(n_anchors / ANCHOR_ROWS))
    deal = lambda n, seed: F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = anchors.toDF(*anchors.columns).withColumn("block", deal(blocks, 1)).withColumn("cell", every(groups))
    right = rows.drop("is_anchor").withColumn("cell", deal(groups, 2)).withColumn("block", every(blocks))
    return left, right


def _scored(left: pa.Table, right: pa.Table, moduli: list[int], limit: int, k: int, allowed) -> dict[str, np.ndarray]:
    """For every anchor of a cell, and every choice of ``allowed``, its best k rows of the cell."""
    right = right.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])
    a, b = matrix(left["embedding"]), matrix(right["embedding"])
    width = max(a.shape[1], b.shape[1])
    a, b = widened(a, width), widened(b, width)
    parts_a, parts_b = [residues(a, p) for p in moduli], [residues(b, p) for p in moduli]
    step = max(k + 1, min(TILE[1], 1 << max(0, 61 - (2 * limit + 1).bit_length())))
    found: list[tuple] = []
    for top in range(0, len(a), TILE[0]):
        rows = slice(top, min(top + TILE[0], len(a)))
        kept: dict[int, list] = {}
        for start in range(0, len(b), step):
            columns = slice(start, start + step)
            scores = exact_scores([x[rows] for x in parts_a], [x[columns] for x in parts_b], moduli)
            for choice, mask in allowed(scores, rows, columns, right):
                score, column = best_of(scores, mask, k)
                kept.setdefault(choice, []).append((score, np.where(column >= 0, column + start, -1)))
        for choice, pieces in kept.items():
            score, column = (np.concatenate(x, axis=1) for x in zip(*pieces))
            order = np.lexsort((column, -score, column < 0), axis=1)[:, :k]
            score, column = np.take_along_axis(score, order, 1), np.take_along_axis(column, order, 1)
            at, _ = np.nonzero(column >= 0)
            found.append((at + top, np.full(len(at), choice), score[column >= 0], column[column >= 0]))
    at, choice, score, column = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*found) if found else [()] * 4))
    return {"row": at, "choice": choice, "score": score, "column": column}


def _merged(found: DataFrame, key: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*key).orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other_no")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5,
                   least_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``positives`` best rows of the same label, the ``negatives``
    best rows of other labels that score at most as high as the positive and at least
    ``least_percent`` of it. ``vectors``: vec_id, embedding, label.
    """
    rows, n_rows, n_anchors, limit = usable(vectors, anchor)
    if limit >= 1 << 54:
        raise ValueError("components are too large for exact scores in 64 bits")
    moduli = primes(limit)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"anchor_no long, choice long, score long, other_id {kind}, other_no long"

    def result(left: pa.Table, right: pa.Table, found: dict[str, np.ndarray]) -> pa.Table:
        right = right.sort_by([("vec_id", "ascending"), ("row_no", "ascending")])
        column = pa.array(found["column"].astype(np.int64))
        return pa.table([left["row_no"].take(pa.array(found["row"].astype(np.int64))), pa.array(found["choice"].astype(np.int64)),
                         pa.array(found["score"].astype(np.int64)), right["vec_id"].take(column), right["row_no"].take(column)],
                        names=["anchor_no", "choice", "score", "other_id", "other_no"])

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        label, number = left["label"].to_numpy(), left["row_no"].to_numpy()

        def allowed(scores, at, columns, other):
            labels, numbers = other["label"].to_numpy()[columns], other["row_no"].to_numpy()[columns]
            yield 0, (label[at, None] == labels) & (number[at, None] != numbers)

        return result(left, right, _scored(left, right, moduli, limit, positives, allowed))

    def window(left: pa.Table, right: pa.Table) -> pa.Table:
        label = left["label"].to_numpy()
        goals = [np.array(x, dtype=np.int64) for x in left["goals"].to_pylist()]
        goal = np.zeros((len(goals), positives), dtype=np.int64)
        have = np.zeros((len(goals), positives), dtype=bool)
        for i, x in enumerate(goals):
            goal[i, :len(x)], have[i, :len(x)] = x, True

        def allowed(scores, at, columns, other):
            differ = label[at, None] != other["label"].to_numpy()[columns]
            for j in range(positives):
                top = goal[at, j][:, None]
                yield j, differ & have[at, j][:, None] & (scores <= top) & (100 * scores >= least_percent * top)

        return result(left, right, _scored(left, right, moduli, limit, negatives, allowed))

    def grid(anchors: DataFrame, task) -> DataFrame:
        left, right = _cells(anchors, rows, n_rows, n_anchors)
        return left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(task, schema)

    anchors = rows.where("is_anchor").drop("is_anchor")
    best = write_scratch(_merged(grid(anchors, same_label), ["anchor_no"], positives), "positives")
    goals = best.groupBy("anchor_no").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("goals"))
    wanted = anchors.join(goals.select(F.col("anchor_no").alias("row_no"), F.col("goals.score").alias("goals")), "row_no")
    found = _merged(grid(wanted, window), ["anchor_no", "choice"], negatives).select(
        "anchor_no", (F.col("choice") + 1).alias("nth"), "rank", F.col("other_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    named = best.join(anchors.select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id")), "anchor_no")
    return found.join(named.select("anchor_no", "anchor_id", F.col("rank").alias("nth"), F.col("other_id").alias("positive_id"),
                                   F.col("score").alias("positive_score")), ["anchor_no", "nth"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
