"""Session settings, scratch tables on shared storage and size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_BYTES = 32 << 20
# Scratch tables written inside the innermost ``dropped_scratch`` of this thread.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
# Temporary folders of local sessions that name none, by application.
_local_roots: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "threadloom", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; master and partitions are the caller's."""
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    builder = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is an error, because executors share no local disk.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _local_roots.get(app)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_roots[app] = tempfile.mkdtemp(prefix="threadloom-")
    return f"{root.rstrip('/')}/threadloom-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts lineage like ``checkpoint()`` but evaluates the plan a single time, keeps
    columns prunable and gives the optimiser exact sizes for the next join.
    """
    path = scratch_path(df.sparkSession, name)
    if (inside := _written.get()) is not None:
        inside.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables this thread writes inside; nothing read from them may be used afterwards.

    Streams run their batches in threads of their own, so none deletes what another wrote.
    """
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for path in mine:
            delete_path(spark, path)


def write_result(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written once; the scratch tables made on the way are deleted."""
    path = scratch_path(spark, name)
    if (outside := _written.get()) is not None:
        outside.append(path)
    with dropped_scratch(spark):
        table = build()
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def make_path(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results still reading them become invalid."""
    delete_path(spark, scratch_root(spark))


def write_measured(rows: DataFrame, name: str, width: Column | None = None) -> tuple[DataFrame, int, int]:
    """Like :func:`write_scratch`, with the row count and bytes observed during the write."""
    if width is None:
        width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns),
                    F.lit(32))
    seen = Observation()
    table = write_scratch(rows.observe(seen, F.count("*").alias("rows"), F.sum(width).alias("bytes")), name)
    return table, seen.get["rows"], seen.get["bytes"] or 0


def hint(table: DataFrame, size: int) -> DataFrame:
    """Broadcast hint for a table of known size, if it is small."""
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _same(rows: DataFrame, keys: DataFrame, key: list[str]) -> Column:
    """Equal keys, a null being equal to a null; ``keys`` has them as ``_k0``, ``_k1`` and so on."""
    condition = F.lit(True)
    for i, name in enumerate(key):
        condition = condition & rows[name].eqNullSafe(keys[f"_k{i}"])
    return condition


def _keyed(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)])


def rows_of_keys(rows: DataFrame, kept: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The wide ``rows`` whose key is in ``kept``; ``keys`` holds the keys of all rows.

    Keys are chosen before texts move: if those kept, or those that are not, measure small,
    they go out to the rows, which stay where they are. Otherwise the rows are joined once.
    """
    wanted, _, size = write_measured(_keyed(kept, key), "kept_keys")
    if size > BROADCAST_BYTES:
        every = _keyed(keys, key)
        lost = every.join(wanted, [every[c].eqNullSafe(wanted[c]) for c in every.columns], "left_anti")
        others, _, lost_size = write_measured(lost, "other_keys")
        if lost_size <= BROADCAST_BYTES:
            return rows.join(F.broadcast(others), _same(rows, others, key), "left_anti")
    return rows.join(hint(wanted, size), _same(rows, wanted, key), "left_semi")


def split_repeated(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key stands once, and rows whose key stands more often; only keys are grouped."""
    often = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    table, _, size = write_measured(_keyed(often, key), "repeated_keys")
    return rows.join(hint(table, size), _same(rows, table, key), "left_anti"), \
        rows.join(hint(table, size), _same(rows, table, key), "left_semi")


def join_texts(texts: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Texts joined to result rows by ``key``, whose first column is the conversation.

    Few rows are broadcast. Many are joined after the texts have been reduced to the
    conversations in question, so that no other text is shuffled.
    """
    table, _, size = write_measured(rows, "keys")
    if size > BROADCAST_BYTES:
        texts = texts.join(broadcast_if_small(table.select(key[0]).distinct()), key[0], "left_semi")
    return texts.join(hint(table, size), key)


def broadcast_if_small(rows: DataFrame) -> DataFrame:
    """Write narrow key rows once, then broadcast them if they measured small enough.

    Beyond the bound the join is left to the optimiser, which knows the size of
    the written table and splits skewed partitions at run time.
    """
    table, _, size = write_measured(rows, "keys")
    return hint(table, size)
