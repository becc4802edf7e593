"""Export archives as the Spark data source ``chat_export``, for batches and for streams.

    register(spark)
    spark.read.format("chat_export").load("/drop")
    spark.readStream.format("chat_export").option("log", "/state/arrivals").load("/drop")

Rows are those of ``archives.read_exports``: one conversation text each, and for an archive
that cannot be read one row whose ``error`` says why. Every archive is a partition of its
own, streamed by one task. A schema given by the caller decides which columns leave the
task; conditions on ``archive`` decide which files are opened at all.

A stream numbers the arrivals: every listing that finds new files adds one entry, a file of
their paths, to the folder named by the option ``log``, and the offset is the number of the
last entry. A batch run again after a failure reads the entries it read before, whatever has
arrived since, and a file that turns up with an old modification time is still new.
``max_files`` limits the files of one entry; what is left over comes with the next ones.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
                                    StringContains, StringEndsWith, StringStartsWith)
from pyspark.sql.types import StructType

from threadloom.sources.archives import RAW, _file_batches

NAME = "chat_export"
MOMENT = pa.timestamp("us", tz="UTC")


@dataclass(frozen=True)
class Archive(InputPartition):
    """One file to be read by one task."""

    path: str
    modified: int

    def batches(self, columns: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in _file_batches(self.path, pa.scalar(self.modified, MOMENT)):
            yield batch.select(columns)


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a path, the path in it, and what turns such paths into full ones."""
    if re.match(r"[a-z0-9+.-]+:", path) and not path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        return store, inner, path.rstrip("/").removesuffix(inner.rstrip("/"))
    return fs.LocalFileSystem(), "/" + re.sub("^file:", "", path).lstrip("/"), "file:"


def listed(path: str) -> list[Archive]:
    """Files of a folder and those below it, in the order of their paths; names with a leading mark are hidden."""
    store, inner, prefix = _store(path)
    found = store.get_file_info([inner])[0]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        files = [found]
    else:
        files = [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File
                 and not any(part[0] in "_." for part in f.path[len(inner):].strip("/").split("/"))]
    return [Archive(prefix + f.path, (f.mtime_ns or 0) // 1000) for f in sorted(files, key=lambda f: f.path)]


# How a condition on the archive's path is tested before the file is opened.
_TESTS: dict[type, Callable] = {
    EqualTo: operator.eq, In: lambda path, values: path in values, StringStartsWith: str.startswith,
    StringEndsWith: str.endswith, StringContains: operator.contains,
}


class ArchiveReader(DataSourceReader):
    """Batch reader: one partition for each archive that meets the conditions on ``archive``."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, schema.fieldNames()
        self.conditions: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if type(condition) in _TESTS and condition.attribute == ("archive",):
                self.conditions.append((type(condition), condition.value))
            else:
                yield condition

    def partitions(self) -> list[Archive]:
        return [a for a in listed(self.path) if all(_TESTS[kind](a.path, value) for kind, value in self.conditions)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return partition.batches(self.columns)


class ArrivalLog:
    """Numbered entries, each the files that one listing found for the first time."""

    def __init__(self, folder: str) -> None:
        self.store, self.folder, _ = _store(folder)
        self.store.create_dir(self.folder, recursive=True)

    def last(self) -> int:
        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self.folder)) if f.base_name.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def entry(self, number: int) -> list[Archive]:
        with self.store.open_input_file(f"{self.folder}/{number:012d}.json") as file:
            return [Archive(*row) for row in json.loads(file.read())]

    def add(self, number: int, files: list[Archive]) -> None:
        # Under another name first, so that an entry is there whole or not at all.
        place = f"{self.folder}/{number:012d}.json"
        with self.store.open_output_stream(f"{place}.part") as file:
            file.write(json.dumps([(a.path, a.modified) for a in files]).encode())
        self.store.move(f"{place}.part", place)


class ArchiveStream(DataSourceStreamReader):
    """Stream reader: offsets are the numbers of entries in the arrival log."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        if "log" not in options:
            raise ValueError("a stream of chat_export needs the option log, a folder of its own beside the checkpoint")
        self.path, self.columns = options["path"], schema.fieldNames()
        self.log = ArrivalLog(options["log"])
        self.most = int(options.get("max_files", 1000))
        self.seen: set[str] = set()
        self.read_to = 0

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        last = self.log.last()
        for number in range(self.read_to + 1, last + 1):
            self.seen.update(a.path for a in self.log.entry(number))
        fresh = [a for a in listed(self.path) if a.path not in self.seen]
        for first in range(0, len(fresh), self.most):
            last += 1
            self.log.add(last, fresh[first:first + self.most])
        self.seen.update(a.path for a in fresh)
        self.read_to = last
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> list[Archive]:
        return [a for number in range(start["entry"] + 1, end["entry"] + 1) for a in self.log.entry(number)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return partition.batches(self.columns)


class ChatExport(DataSource):
    """Chat export archives: ZIP files holding conversations.json, or the JSON itself."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChatExport)
