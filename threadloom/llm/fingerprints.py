"""Document fingerprints by Order MinHash, sensitive to edit distance.

A fingerprint is ``functions`` entries of 16 bits, each the hash of the ``order`` least
occurrence-numbered five-word k-mers in the order of the text (``sketches``). The
likeness of two fingerprints is the share of equal entries, from 0 to 1.

``with_edits`` also fingerprints what each document becomes when its last third is
replaced by the start of the next document in descending id. Rows are range-partitioned
by id, so that the next document is the next row; only the first and last row of each
partition are matched across partitions.

Defined cases: null texts count as empty, and all texts without words have the same
fingerprint; the single document of a table is its own next; equal ids follow each other
by the text's digest; null ids come last; repeated rows stay; a very long text is one row like
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm import sketches
from threadloom.llm.rows import text_of
from threadloom.session import write_scratch

FUNCTIONS, ORDER = 64, 2
GROUP_CHARS = 1 << 20
RESULT = ("n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")
BLANK = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.binary(),
         "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}


def entries(texts: list[str], randoms: sketches.Randoms, functions: int, order: int) -> np.ndarray:
    return sketches.signatures(texts, functions, order, randoms)[0].astype(np.uint16)


def as_bytes(signed: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in signed.astype(">u2")]


def as_text(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def fingerprints(docs: DataFrame, functions: int = FUNCTIONS, order: int = ORDER) -> DataFrame:
    """doc_id, fingerprint of every row."""
    kept = docs.select("doc_id", text_of().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in batches:
            signed = entries(batch.column(1).to_pylist(), randoms, functions, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_bytes(signed), pa.binary())],
                                             names=["doc_id", "fingerprint"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint binary") \
        .select("doc_id", as_text("fingerprint"))


def edited(text: str, following: str) -> str:
    """The last third replaced by the start of the next text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compared(texts: list[str], following: list[str], randoms: sketches.Randoms, functions: int,
             order: int) -> dict[str, list]:
    """Result columns of texts, each with its next text."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    own, new, other = (entries(x, randoms, functions, order) for x in (texts, changed, following))
    return {"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": as_bytes(own), "edited_fingerprint": as_bytes(new),
            "near_edited": (own == new).mean(axis=1).tolist(), "near_next": (own == other).mean(axis=1).tolist()}


def with_edits(docs: DataFrame, functions: int = FUNCTIONS, order: int = ORDER) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows of one id, and equal rows, are dealt over several ranges too.
    by = [F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("row_no")]
    rows = docs.select("doc_id", text_of().alias("body"), F.md5(text_of()).alias("digest"),
                       F.monotonically_increasing_id().alias("row_no"))
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "body")
    schema = f"edge string, part int, doc_id {kind}, body string, {RESULT}"
    names = ["edge", "part", "doc_id", "body", *BLANK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms, part = sketches.Randoms(), TaskContext.get().partitionId()
        id_type = None
        ids: list = []
        texts: list[str] = []

        def out(edge: str | None, chosen: list, bodies: list, columns: dict[str, list]) -> pa.RecordBatch:
            n = len(chosen)
            return pa.RecordBatch.from_arrays(
                [pa.array([edge] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(chosen, id_type),
                 pa.array(bodies, pa.string())]
                + [pa.array(columns.get(c, [None] * n), t) for c, t in BLANK.items()], names=names)

        def flush() -> pa.RecordBatch:
            columns = compared(texts[:-1], texts[1:], randoms, functions, order)
            result = out(None, ids[:-1], [None] * (len(ids) - 1), columns)
            del ids[:-1], texts[:-1]
            return result

        for batch in batches:
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if id_type is None:
                    id_type = batch.column(0).type
                    yield out("first", [key], [text], {})
                ids.append(key)
                texts.append(text)
                size += len(text)
                if size > GROUP_CHARS:
                    yield flush()
                    size = 0
            if len(ids) > 1:
                yield flush()
        if ids:
            yield out("last", ids, texts, {})

    done = write_scratch(ranged.mapInArrow(run, schema), "fingerprints")
    edges = done.where(F.col("edge").isNotNull())
    # One number per partition that has rows: which one follows which.
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())
    follows = docs.sparkSession.createDataFrame(
        list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    last = edges.where("edge = 'last'").select("part", "doc_id", "body")
    pairs = last.join(follows, "part").join(first, "next_part").select("doc_id", "body", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        randoms = sketches.Randoms()
        for batch in batches:
            columns = compared(batch.column(1).to_pylist(), batch.column(2).to_pylist(), randoms, functions, order)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns.values())],
                                             names=["doc_id", *columns])

    across = pairs.mapInArrow(finish, f"doc_id {kind}, {RESULT}")
    return done.where(F.col("edge").isNull()).drop("edge", "part", "body").union(across).select(
        "doc_id", "n_chars", "edited_sha256", as_text("fingerprint"), as_text("edited_fingerprint"), "near_edited", "near_next")
