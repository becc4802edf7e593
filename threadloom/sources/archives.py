"""Export archives: a ZIP holding conversations.json, or the JSON itself.

Spark lists the files; each is opened by the task that owns it and streamed, so a
task holds one conversation at a time whatever the size of the archive. A ZIP
member cannot be split, hence the reshuffle of the raw conversations afterwards.
"""

from __future__ import annotations

import codecs
import re
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MEMBER = "conversations.json"
RAW = "archive string, modified timestamp, ordinal bigint, conversation string, error string"
MEMBERS = "archive string, member string, status string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"
_CHUNK = 1 << 20
_BATCH_CHARS = 8 << 20


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    filesystem, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return filesystem.open_input_file(inner)


def _chunks(stream) -> Iterator[str]:
    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    while block := stream.read(_CHUNK):
        yield decode(block)
    yield decode(b"", True)


def json_objects(chunks: Iterator[str]) -> Iterator[str]:
    """Texts of the outermost JSON objects, of an array or of consecutive lines."""
    mark = re.compile(r'"(?:[^"\\]++|\\.)*+(?P<closed>")?|[{}]', re.DOTALL)
    pending, scanned, depth, start = "", 0, 0, 0
    for chunk in chunks:
        pending += chunk
        for found in mark.finditer(pending, scanned):
            token = found.group()
            if token == "{":
                if depth == 0:
                    start = found.start()
                depth += 1
            elif token == "}":
                depth -= 1
                if depth == 0:
                    yield pending[start:found.end()]
                elif depth < 0:
                    raise ValueError("unbalanced braces")
            elif not found["closed"]:
                scanned = found.start()  # the string goes on in the next chunk
                break
            scanned = found.end()
        drop = start if depth else scanned
        pending, scanned, start = pending[drop:], scanned - drop, 0
    if depth or pending.strip().startswith('"'):
        raise ValueError("the file ends inside a conversation")


@contextmanager
def _unzip(handle):
    handle.seek(0)
    if handle.read(2) != b"PK":
        raise zipfile.BadZipFile("no ZIP signature")
    try:
        with zipfile.ZipFile(handle) as archive:
            yield archive
    except (pa.ArrowInvalid, zlib.error, EOFError) as damage:
        raise zipfile.BadZipFile(str(damage)) from damage


def _conversations(path: str) -> Iterator[str]:
    with _open(path) as handle:
        packed = handle.read(2) == b"PK"
        handle.seek(0)
        if packed or path.lower().endswith(".zip"):
            with _unzip(handle) as archive, archive.open(MEMBER) as member:
                yield from json_objects(_chunks(member))
        else:
            yield from json_objects(_chunks(handle))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, modified in zip(batch.column("path").to_pylist(), batch.column("modified")):
            yield from _file_batches(path, modified)


def _file_batches(path: str, modified) -> Iterator[pa.RecordBatch]:
    def rows(first: int, texts: list[str | None], error: str | None = None) -> pa.RecordBatch:
        size = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.array([path] * size, pa.string()), pa.array([modified] * size, modified.type),
            pa.array(range(first, first + size), pa.int64()), pa.array(texts, pa.string()),
            pa.array([error] * size, pa.string())],
            names=["archive", "modified", "ordinal", "conversation", "error"])

    done, texts, held = 0, [], 0
    error = None
    try:
        for text in _conversations(path):
            texts.append(text)
            held += len(text)
            if held >= _BATCH_CHARS:
                yield rows(done, texts)
                done, texts, held = done + len(texts), [], 0
    except zipfile.BadZipFile as failure:
        error = f"not a ZIP archive: {failure}"
    except KeyError:
        error = f"{MEMBER} is missing"
    except ValueError as failure:
        error = str(failure)
    if texts:
        yield rows(done, texts)
    if error:
        yield rows(done + len(texts), [None], error)


def read_listed(files: DataFrame) -> DataFrame:
    """Raw conversations of listed files (path, modified), batch or micro-batch."""
    raw = files.select("path", "modified").mapInArrow(_read_files, RAW)
    return raw.repartition("archive", "ordinal")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation text; unreadable archives give a row with ``error``."""
    return read_listed(_listing(spark, path))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .select("path", F.col("modificationTime").alias("modified"))


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with _open(path) as handle, _unzip(handle) as archive:
                    names, status = archive.namelist() or [None], "ok"
            except zipfile.BadZipFile:
                names, status = [None], "not a ZIP archive"
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(names)), pa.array(names, pa.string()), pa.array([status] * len(names))],
                names=["archive", "member", "status"])


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of every archive of a folder; broken archives are reported, not fatal."""
    return _listing(spark, path).mapInArrow(_list_members, MEMBERS)
