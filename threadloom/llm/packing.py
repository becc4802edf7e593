"""Packing documents into as few sequences as possible.

Long documents are cut into full pieces, the first piece being the shorter one. What
remains is bin packing on a multiset of lengths, and a multiset of lengths below the
capacity is a histogram of at most ``capacity`` numbers, however many documents there
are. The driver packs that histogram (``plan_sequences``) into patterns with
multiplicities; Spark ranks the pieces within their length and gives each rank the
place that the patterns reserve for it.

``plan_sequences`` is bin completion: it takes the largest length left, enumerates
undominated fillings of the room beside it, least waste first, applies a filling as
often as the counts allow, or less often, and backtracks where the waste so far already
exceeds what an improvement could afford. Best-fit decreasing gives the first incumbent and
the finish of branches. A search looks at ``width`` fillings of a sequence; one that ends
above the lower bound is repeated twice as wide, until nothing was left out or ``max_nodes``
nodes are spent, which bounds the effort, not the pieces that are placed.

Ranks within a length come from slabs of about ``SLAB_ROWS`` pieces, dealt by row, so a length
shared by a third of all rows, or a row repeated that often, is split like any other data.

Defined cases: null and empty texts are one piece holding the end id; a very long text is cut
like any longer one; an empty table gives no rows; repeated rows and equal or null ids are
packed each on their own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.rows import slices
from threadloom.llm.tokens import JSON_PATH, RANKS_PATH, encoder
from threadloom.session import write_scratch

SLAB_ROWS = 1000
FINISH_EVERY = 250
PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: the first is the remainder, the others are full."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False,
           json_path: str = JSON_PATH, ranks_path: str = RANKS_PATH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    key = kept.schema["doc_id"]
    schema = f"doc_id {key.dataType.simpleString()}, {PIECES}" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in slices(batches):
            rows, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(points := cut_points(len(ids), capacity)):
                    stop = points[piece + 1] if piece + 1 < len(points) else len(ids)
                    part = ids[start:stop]
                    rows.append(row)
                    out.append((piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns[:4 + with_ids], kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=names)

    return kept.mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False,
         max_nodes: int = 4000, **paths: str) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = write_scratch(pieces(docs, capacity, end_id, with_ids, **paths).withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = reserved(plan_sequences(counts, capacity, max_nodes))
    slots = docs.sparkSession.createDataFrame(
        places, "length long, low long, high long, each long, first_id long, first_offset long")
    inside = F.col("rank") - F.col("low")
    # At most 45 lengths in each of some thousand patterns, which ``capacity`` and ``max_nodes`` bound.
    return (
        _ranked(cut, counts, capacity).join(F.broadcast(slots), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first_id") + F.floor(inside / F.col("each")))
        .withColumn("offset", F.col("first_offset") + inside % F.col("each") * F.col("length"))
        .select(*cut.columns, "sequence_id", "offset").drop("row_no")
    )


def _ranked(cut: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """Pieces with ``rank``, numbered from 0 within their length."""
    slabs = F.lit([0] + [-(-counts.get(n, 0) // SLAB_ROWS) or 1 for n in range(1, capacity + 1)])
    rows = cut.withColumn("slab", F.pmod(
        F.xxhash64("row_no"), F.get(slabs, F.col("length").cast("int")).cast("long")))
    before = Window.partitionBy("length").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "slab").agg(F.count("*").alias("n")) \
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "slab").orderBy("doc_id", "piece", "start", "ids_crc32", "row_no")
    return rows.withColumn("nth", F.row_number().over(inside) - 1).join(bases, ["length", "slab"]) \
        .withColumn("rank", F.col("base") + F.col("nth")).drop("slab", "base", "nth")


Pattern = tuple[tuple[int, int], ...]


def reserved(plan: list[tuple[Pattern, int]]) -> list[tuple[int, ...]]:
    """Rank ranges per length: length, low, high, pieces per sequence, first sequence, first offset."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            low = taken.get(length, 0)
            taken[length] = low + each * times
            out.append((length, low, taken[length], each, sequence, offset))
            offset += each * length
        sequence += times
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over whole classes of equal bins."""
    bins: dict[int, dict[Pattern, int]] = {}
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            group = bins.setdefault(room, {})
            group[pattern] = group.get(pattern, 0) + times

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        for room in sorted(r for r in bins if r >= length):
            each = room // length
            for pattern, times in list(bins[room].items()):
                if not left:
                    break
                full = min(times, left // each)
                rest = 1 if full < times and left - full * each else 0
                part = left - full * each if rest else 0
                del bins[room][pattern]
                put(room - each * length, (*pattern, (length, each)), full)
                if rest:
                    put(room - part * length, (*pattern, (length, part)), 1)
                put(room, pattern, times - full - rest)
                left -= full * each + part
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    for group in bins.values():
        done += group.items()
    return done


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces too long to share."""
    items = sorted((n, c) for n, c in counts.items() if c)
    total = sum(n * c for n, c in items)
    best = -(-total // capacity)
    for k in {0, *(n for n, _ in items if 2 * n <= capacity)}:
        alone = sum(c for n, c in items if n > capacity - k)
        half = [(n, c) for n, c in items if capacity - k >= n and 2 * n > capacity]
        small = sum(n * c for n, c in items if k <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(counts: dict[int, int], room: int, waste: int, width: int) -> tuple[list[Pattern], bool]:
    """Up to ``width`` undominated fillings of ``room``, least waste first, wasting at most ``waste``; whether these are all.

    Tries the ``width`` largest sums that can be reached, a few fillings of each.
    """
    lengths = sorted(n for n, c in counts.items() if c and n <= room)
    reach = [1]  # bit s: the lengths so far can sum to s
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        sums, copies = reach[-1], min(counts[n], room // n)
        step = 1
        while copies > 0:
            take = min(step, copies)
            sums |= sums << (take * n) & mask
            copies -= take
            step *= 2
        reach.append(sums)
    found: list[Pattern] = []

    def search(most: int, left: int, chosen: Pattern) -> Iterator[Pattern]:
        if left == 0:
            yield chosen
            return
        for i in range(bisect_right(lengths, left, 0, most), 0, -1):
            if not reach[i] >> left & 1:
                return
            n = lengths[i - 1]
            for k in range(min(counts[n], left // n), 0, -1):
                if reach[i - 1] >> (left - k * n) & 1:
                    yield from search(i - 1, left - k * n, (*chosen, (n, k)))

    sums, whole = 0, True
    for total in range(room, max(-1, room - waste - 1), -1):
        if reach[-1] >> total & 1:
            sums += 1
            for tried, pattern in enumerate(search(len(lengths), total, ())):
                if not any(_dominates(f, pattern) for f in found):
                    found.append(pattern)
                if len(found) >= width or tried >= 4 * width:
                    whole = False
                    break
        if len(found) >= width or sums >= width:
            whole = False
            break
    return found, whole


def _dominates(large: Pattern, small: Pattern) -> bool:
    """Whether the pieces of ``small`` fit into rooms of the sizes of ``large`` (first fit: may miss, never errs)."""
    rooms = [n for n, k in large for _ in range(k)]
    for n in (n for n, k in small for _ in range(k)):
        at = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if at is None:
            return False
        rooms[at] -= n
    return True


def plan_sequences(counts: dict[int, int], capacity: int, max_nodes: int = 4000,
                   width: int = 4) -> list[tuple[Pattern, int]]:
    """Patterns ((length, pieces), ...) with the number of sequences that follow them.

    A search that ends above the lower bound without having tried all fillings and all numbers
    of sequences for each is run again, twice as wide and with fewer sequences at a time.
    """
    best = best_fit(counts, capacity)
    least, nodes, share = lower_bound(counts, capacity), 0, 1
    while nodes < max_nodes and sum(times for _, times in best) > least:
        # The first search gets half of the nodes, the others an eighth each.
        best, used, complete = _completed(counts, capacity, best, least, max_nodes // (8 if nodes else 2), width, share)
        nodes += used
        if complete:
            break
        width, share = 2 * width, 2 * share
    return best


def _completed(counts: dict[int, int], capacity: int, best: list[tuple[Pattern, int]], least: int, max_nodes: int, width: int,
               share: int) -> tuple[list[tuple[Pattern, int]], int, bool]:
    """The best plan of one search, its nodes, and whether nothing was left out. A filling is applied to 1 / ``share`` of what fits first."""
    total = sum(n * c for n, c in counts.items())
    size = sum(times for _, times in best)
    left = {n: c for n, c in counts.items() if c}
    path: list[tuple[Pattern, int]] = []
    stack: list[list[tuple[Pattern, int]]] = []
    used = wasted = nodes = 0
    complete = True

    def afford() -> int:
        return (size - 1) * capacity - total - wasted

    def options() -> list[tuple[Pattern, int]]:
        nonlocal complete
        large = max(left)
        left[large] -= 1
        found, whole = fillings(left, capacity - large, afford(), width)
        left[large] += 1
        out = []
        for pattern in (_with(f, large) for f in found):
            most = min(left[n] // k for n, k in pattern)
            times = {max(1, most // share), max(1, most // (2 * share)), 1}
            whole = whole and len(times) == most
            out += [(pattern, t) for t in sorted(times, reverse=True)]
        complete = complete and whole
        return out[::-1]

    while size > least and nodes < max_nodes:
        nodes += 1
        if left and afford() >= 0:
            if nodes & (nodes - 1) == 0 or nodes % FINISH_EVERY == 0:
                rest = best_fit(left, capacity)
                if used + sum(times for _, times in rest) < size:
                    best, size = path + rest, used + sum(times for _, times in rest)
                    if size <= least:
                        break
            stack.append(options())
        elif not left and used < size:
            best, size = list(path), used
            stack.append([])
        else:
            stack.append([])
        while stack and not stack[-1]:
            stack.pop()
            if path:
                pattern, times = path.pop()
                used -= times
                wasted -= times * (capacity - sum(n * k for n, k in pattern))
                for n, k in pattern:
                    left[n] = left.get(n, 0) + k * times
        if not stack:
            return best, nodes, complete
        pattern, times = stack[-1].pop()
        path.append((pattern, times))
        used += times
        wasted += times * (capacity - sum(n * k for n, k in pattern))
        for n, k in pattern:
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return best, nodes, False


def _with(filling: Pattern, length: int) -> Pattern:
    found = dict(filling)
    found[length] = found.get(length, 0) + 1
    return tuple(sorted(found.items(), reverse=True))
