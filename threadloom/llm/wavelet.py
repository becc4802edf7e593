"""Token ids in files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its file keeps one plane of bits for each bit
of an id, from the highest: each plane lists the bits in the order left by the planes above,
which put zeros before ones. Counts of ones before every block of a plane make rank and select
a matter of one block, so the same compressed file answers the token at a place, the number of
occurrences of a token in a range, and their places, without being read whole.

File: magic, length of the head (u64), head (JSON: places of the parts, number of ids and
planes, zeros of each plane), documents (Arrow IPC: doc_id, n_tokens), directory (compressed;
per plane, ones before and offset of each block), blocks of bits (each compressed).

Documents are dealt by ranges of (id, digest of the text, row), so equal ids and even equal
rows split; every task writes shards of about ``SHARD`` ids, a file per attempt, and returns
their names. Only the returned files are read: what a lost or repeated task left is not.

Defined cases: null texts count as empty and hold just the end id; null ids come first; equal
ids follow each other by the text's digest; repeated rows stay; one document is never split, so
a very long one makes a longer shard; an empty table has no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.rows import slices, text_of
from threadloom.llm.tokens import JSON_PATH, RANKS_PATH, encoder
from threadloom.operators.ordered import running_sum, write_slabs
from threadloom.session import broadcast_if_small, scratch_path, write_scratch

MAGIC = b"idplane1"
SHARD = 1 << 22
BLOCK = 1 << 16
END_ID = 2
RESULT_IDS = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for a path or URI that executors share."""
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), "/" + re.sub("^file:", "", path).lstrip("/")


# ---------------------------------------------------------------- the file

def planes(ids: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """The bits of each plane, as truth values."""
    order = ids
    for level in range(levels - 1, -1, -1):
        bits = (order & order.dtype.type(1 << level)).astype(bool)
        yield bits
        order = np.concatenate([order[np.flatnonzero(~bits)], order[np.flatnonzero(bits)]])


def shard_bytes(documents: pa.Table, ids: np.ndarray) -> bytes:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(ids.max(initial=0)).bit_length())
    n_blocks = -(-len(ids) // BLOCK)
    zeros, blocks, ranks, offsets, at = [], [], [], [], 0
    for bits in planes(ids, levels):
        zeros.append(len(bits) - int(np.count_nonzero(bits)))
        ones = 0
        for first in range(0, len(bits), BLOCK):
            part = bits[first:first + BLOCK]
            blocks.append(squeeze(np.packbits(part).tobytes()))
            ranks.append(ones)
            offsets.append(at)
            ones += int(np.count_nonzero(part))
            at += len(blocks[-1])
    offsets.append(at)
    directory = squeeze(np.array(ranks + offsets, dtype="<i8").tobytes())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    listed = sink.getvalue().to_pybytes()
    head = json.dumps({"n": len(ids), "levels": levels, "blocks": n_blocks, "zeros": zeros, "documents": len(listed),
                       "directory": len(directory)}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, listed, directory, *blocks])


class Shard:
    """Queries on one shard file. Blocks are read as needed and the last ones kept."""

    def __init__(self, handle, cached: int = 512) -> None:
        self.handle, self.cached, self.cache = handle, cached, {}
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        size = struct.unpack("<Q", self._read(len(MAGIC), 8))[0]
        at = len(MAGIC) + 8
        head = json.loads(self._read(at, size))
        self.n, self.levels, self.blocks, self.zeros = (head[k] for k in ("n", "levels", "blocks", "zeros"))
        self.listed = (at + size, head["documents"])
        first = at + size + head["documents"]
        table = np.frombuffer(self._unpacked(first, head["directory"]), dtype="<i8")
        self.ranks = table[:self.levels * self.blocks].reshape(self.levels, self.blocks)
        self.offsets = table[self.levels * self.blocks:]
        self.first = first + head["directory"]

    def _read(self, at: int, size: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(size)

    def _unpacked(self, at: int, size: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(at, size))

    def documents(self) -> pa.Table:
        """doc_id, n_tokens in the order of the shard."""
        return pa.ipc.open_stream(self._read(*self.listed)).read_all()

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = level, block
        if key not in self.cache:
            if len(self.cache) >= self.cached:
                self.cache.pop(next(iter(self.cache)))
            self.cache[key] = self._loaded(level, block)
        return self.cache[key]

    def _loaded(self, level: int, block: int) -> np.ndarray:
        at, end = (int(x) for x in self.offsets[level * self.blocks + block:][:2])
        size = min(BLOCK, self.n - block * BLOCK)
        return np.unpackbits(np.frombuffer(self._unpacked(self.first + at, end - at), dtype=np.uint8), count=size).view(bool)

    def _ones_before(self, level: int, places: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        out = np.empty(len(places), dtype=np.int64)
        block = np.minimum(places // BLOCK, self.blocks - 1)
        for b in np.unique(block):
            here = block == b
            sums = np.concatenate([[0], np.cumsum(self._bits(level, int(b)))])
            out[here] = self.ranks[level, b] + sums[places[here] - b * BLOCK]
        return out

    def tokens(self, places: np.ndarray) -> np.ndarray:
        """The ids at the places."""
        at, found = np.asarray(places, dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for level in range(self.levels):
            bit = np.empty(len(at), dtype=bool)
            for b in np.unique(at // BLOCK):
                here = at // BLOCK == b
                bit[here] = self._bits(level, int(b))[at[here] - b * BLOCK]
            ones = self._ones_before(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            found = found << 1 | bit
        return found

    def _span(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the occurrences of a token within [first, last) stand below the last plane."""
        ends = np.array([first, last], dtype=np.int64)
        if token >> self.levels or not self.n:
            return 0, 0
        for level in range(self.levels):
            ones = self._ones_before(level, ends)
            ends = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of a token among the places from ``first`` to before ``last``."""
        begin, end = self._span(token, first, self.n if last is None else last)
        return end - begin

    def _select(self, level: int, one: bool, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0, ascending) one or zero of a plane."""
        before = self.ranks[level] if one else np.arange(self.blocks) * BLOCK - self.ranks[level]
        block = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), dtype=np.int64)
        for b in np.unique(block):
            here = block == b
            out[here] = b * BLOCK + np.flatnonzero(self._bits(level, int(b)) == one)[nth[here] - before[b]]
        return out

    def places(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ascending places of a token from ``first`` to before ``last``, by select from the last plane upwards."""
        at = np.arange(*self._span(token, first, self.n if last is None else last), dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = bool(token >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def decoded(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        order = np.zeros(self.n, dtype=np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.concatenate([np.empty(0, bool)] + [self._loaded(level, b) for b in range(self.blocks)])
            zeros = self.zeros[level]
            order[zeros:] |= order.dtype.type(1 << (self.levels - 1 - level))
            back = np.empty_like(order)
            back[np.flatnonzero(~bits)], back[np.flatnonzero(bits)] = order[:zeros], order[zeros:]
            order = back
        return order


# ---------------------------------------------------------------- jobs

def encoded(docs: DataFrame, end_id: int, json_path: str, ranks_path: str) -> DataFrame:
    """doc_id, digest, row_no, ids (16 bits each where they fit, else 32) with the end id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = docs.select("doc_id", F.md5(text_of()).alias("digest"), F.monotonically_increasing_id().alias("row_no"),
                       text_of().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in slices(batches):
            ids = [np.append(encode(t), end_id) for t in batch.column(3).to_pylist()]
            wide = [bool(x.max() >> 16) for x in ids]
            packed = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(wide)],
                                             names=["doc_id", "digest", "row_no", "ids", "wide"])

    return kept.mapInArrow(run, f"doc_id {kind}, digest string, row_no long, ids binary, wide boolean")


def write_shards(docs: DataFrame, root: str, end_id: int = END_ID, shard: int = SHARD, json_path: str = JSON_PATH,
                 ranks_path: str = RANKS_PATH) -> DataFrame:
    """Write all documents under ``root`` in ascending id; file, first (ids before it), n_docs, n_tokens, n_bytes of each shard."""
    rows = write_scratch(encoded(docs, end_id, json_path, ranks_path), "token_ids")
    by = ["doc_id", "digest", "row_no"]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "ids", "wide")

    def write(documents: list[pa.RecordBatch], ids: list[np.ndarray], part: int, nth: int) -> pa.RecordBatch:
        path = f"{root.rstrip('/')}/{part:06d}-{nth:06d}-{uuid.uuid4().hex}.ids"
        whole = np.concatenate(ids)
        data = shard_bytes(pa.Table.from_batches(documents), whole)
        store, place = opened(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(data)
        values = (part, nth, path, sum(d.num_rows for d in documents), len(whole), len(data))
        return pa.RecordBatch.from_pylist([dict(zip(("part", "nth", "file", "n_docs", "n_tokens", "n_bytes"), values))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        documents, ids, held, nth = [], [], 0, 0
        for batch in slices(batches):
            arrays = [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            sizes = np.array([len(a) for a in arrays], dtype=np.int64)
            first = 0
            while first < len(sizes):
                # Whole documents up to the one that fills the shard.
                last = min(len(sizes), first + int(np.searchsorted(np.cumsum(sizes[first:]), shard - held)) + 1)
                documents.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(sizes[first:last])], names=["doc_id", "n_tokens"]))
                ids += arrays[first:last]
                held += int(sizes[first:last].sum())
                first = last
                if held >= shard:
                    yield write(documents, ids, part, nth)
                    documents, ids, held, nth = [], [], 0, nth + 1
        if held:
            yield write(documents, ids, part, nth)

    made = write_scratch(ranged.mapInArrow(run, "part long, nth long, file string, n_docs long, n_tokens long, n_bytes long"), "shards")
    slabs = write_slabs(made.withColumn("all", F.lit(0)), ["all"], ["part", "nth"], F.col("n_tokens"))
    summed = running_sum(slabs, ["all"], ["part", "nth"], "through")
    return write_scratch(summed.select("file", (F.col("through") - F.col("n_tokens")).alias("first"), "n_docs", "n_tokens", "n_bytes"),
                         "shard_list")


def _spread(shards: DataFrame) -> DataFrame:
    """One task for a few shards; a list of files is small, but its work is not."""
    return shards.repartitionByRange(max(1, min(shards.count(), 10_000)), "file")


def read_documents(shards: DataFrame, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = opened(file)
                with store.open_input_file(place) as handle:
                    shard = Shard(handle)
                    listed, ids = shard.documents().combine_chunks(), shard.decoded().astype("<u4")
                ends = np.cumsum(listed["n_tokens"].to_numpy())
                at = done = 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, done + RESULT_IDS, side="right")))
                    starts = np.concatenate([[done], ends[at:to - 1]])
                    bodies = [ids[a:b].tobytes() for a, b in zip(starts, ends[at:to])]
                    yield pa.RecordBatch.from_arrays(
                        [listed["doc_id"].slice(at, to - at).combine_chunks(), pa.array(starts + first),
                         pa.array(ends[at:to] - starts), pa.array(bodies, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at, done = to, int(ends[to - 1])

    return _spread(shards).select("file", "first").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """place, token for every row of ``places`` (place: number of ids before it) that lies within the shards."""
    cell = lambda c: F.floor(F.col(c) / SHARD)
    covered = shards.select("file", "first", "n_tokens", F.explode(F.sequence(
        cell("first"), F.floor((F.col("first") + F.col("n_tokens") - 1) / SHARD))).alias("cell"))
    asked = places.select("place").withColumn("cell", cell("place")).join(broadcast_if_small(covered), "cell").where(
        (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_tokens")))
    ranged = asked.select("file", "first", "place").repartitionByRange("file", "place").sortWithinPartitions("file", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for file in dict.fromkeys(files):
                here = np.flatnonzero(files == file)
                store, place = opened(file)
                with store.open_input_file(place) as handle:
                    found = Shard(handle).tokens(wanted[here] - batch.column(1)[int(here[0])].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(wanted[here]), pa.array(found)], names=["place", "token"])

    return ranged.mapInArrow(run, "place long, token long")


def occurrences(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """token, place of every occurrence of the given ids; only the blocks on their way are read."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = opened(file)
                with store.open_input_file(place) as handle:
                    shard = Shard(handle)
                    for token in wanted:
                        found = shard.places(token) + first
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), token)), pa.array(found)],
                                                         names=["token", "place"])

    return _spread(shards).select("file", "first").mapInArrow(run, "token long, place long")


def token_counts(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """token, n: occurrences of each of the given ids, by rank alone."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, place = opened(file)
                with store.open_input_file(place) as handle:
                    shard = Shard(handle)
                    counts = [shard.count(token) for token in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(counts, pa.int64())], names=["token", "n"])

    return _spread(shards).select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def round_trip(docs: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Documents as read back from the shards they were written to, in this run's scratch folder."""
    shards = write_shards(docs, scratch_path(docs.sparkSession, "token-shards"), end_id)
    return read_documents(shards, docs.schema["doc_id"].dataType.simpleString())
