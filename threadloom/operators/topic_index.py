"""Topic maps of any window from a stored aggregate of word counts.

Per hour and word the index keeps the number of messages with the word and the first
``SAMPLES`` of them. Two hours make a block of the next level, two of those one of the level
after it, and so on. Numbers add up and lists of first messages merge, so a window of n hours
is made of about 2 log2(n) blocks per word. Most words stand in few hours, so every level is
nearly as large as the hours: one level in ``STEP`` is stored, and a block of the others is read
as the (at most 8) blocks of the stored level below. Only the hours that a bound cuts are read as
messages, and texts are fetched for the sample messages alone.

Every import adds rows of its own, a load, to all levels; a load written again replaces itself.
Messages without a time take no part.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.functions.text import topic_tokens, trim_text
from threadloom.functions.times import normalise_iso
from threadloom.operators.filters import window
from threadloom.session import join_texts, write_scratch

SAMPLES = 8
LEVELS = 16
STEP = 4
SLOT = 3600
# The row that counts all messages of a block: no topic has an empty label.
ALL = ""
KEY = ["ts", "msg_id", "conv_id"]


def _slot(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / SLOT).cast("long")


def _counted(messages: DataFrame, *block: Column) -> DataFrame:
    """block..., label, n, first: words of messages, and their number under ``ALL``."""
    by = [c.alias(f"b{i}") for i, c in enumerate(block)]
    names = [f"b{i}" for i in range(len(block))] + ["label"]
    words = F.array_append(topic_tokens(F.col("text")), F.lit(ALL))
    places = messages.where(F.col("ts").isNotNull()).select(*by, *KEY, F.explode(words).alias("label"))
    counts = places.groupBy(*names).agg(F.count("*").alias("n"))
    early = Window.partitionBy(*names).orderBy(*KEY)
    firsts = places.where(F.col("label") != ALL).withColumn("_nth", F.row_number().over(early)).where(F.col("_nth") <= SAMPLES) \
        .groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("first"))
    return counts.join(firsts, names, "left")


def _merged() -> list[Column]:
    lists = F.flatten(F.collect_list(F.coalesce("first", F.array())))
    return [F.sum("n").alias("n"), F.slice(F.array_sort(lists), 1, SAMPLES).alias("first")]


def write_topics(messages: DataFrame, path: str, load_id: str) -> None:
    """Add the words of ``messages`` to all levels of the index, in place of an earlier attempt of the load."""
    place, spark = f"{path}/load_id={load_id}", messages.sparkSession
    # Written before it is ranged, which looks at the rows twice.
    rows = write_scratch(_counted(messages, _slot(F.col("ts"))).withColumnRenamed("b0", "block"), "hours")
    for level in range(0, LEVELS, STEP):
        if level:  # from the stored level before
            base = spark.read.schema(rows.schema).parquet(f"{place}/level={level - STEP}")
            rows = base.groupBy(F.shiftright("block", STEP).alias("block"), "label").agg(*_merged())
        rows.repartitionByRange("block", "label").withColumn("level", F.lit(level)).write \
            .mode("append" if level else "overwrite").partitionBy("level").parquet(place)


def cover(first: int, last: int) -> list[tuple[int, int]]:
    """(level, block) that make up the hours from ``first`` to ``last``, few of each level."""
    out = []
    while first <= last:
        level = 0
        while level + 1 < LEVELS and first % (2 << level) == 0 and first + (2 << level) - 1 <= last:
            level += 1
        out.append((level, first >> level))
        first += 1 << level
    return out


def stored_blocks(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same hours as blocks of the stored levels."""
    return [(level - level % STEP, (block << level % STEP) + i) for level, block in blocks for i in range(1 << level % STEP)]


def _bound(spark: SparkSession, value) -> datetime | None:
    if value is None:
        return None
    seconds = spark.range(1).select(F.unix_micros(F.lit(normalise_iso(value)).cast("timestamp"))).first()[0]
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=seconds)


def indexed_topic_map(messages: DataFrame, path: str, date_from=None, date_to=None, limit: int = 10, min_occurrences: int = 2,
                      sample_limit: int = 3) -> DataFrame:
    """The topic map of a window of the indexed messages, equal to ``topics.topic_map``."""
    for name, value in (("limit", limit), ("min_occurrences", min_occurrences), ("sample_limit", sample_limit)):
        if value < 1:
            raise ValueError(f"{name}: expected 1 or more, got {value}")
    if sample_limit > SAMPLES:
        raise ValueError(f"the index keeps {SAMPLES} messages of a word")
    spark = messages.sparkSession
    ts = messages.schema["ts"].dataType
    key = "array<struct<ts:{},msg_id:string,conv_id:string>>".format(ts.simpleString())
    index = spark.read.schema(f"block long, label string, n long, first {key}, level int, load_id string").parquet(path)
    top = (LEVELS - 1) // STEP * STEP
    span = index.where((F.col("level") == top) & (F.col("label") == ALL)).agg(
        F.min(F.shiftleft("block", top)).alias("low"), F.max(F.shiftleft(F.col("block") + 1, top)).alias("high")).first()
    low, high = _bound(spark, date_from), _bound(spark, date_to)
    first = span.low or 0 if low is None else max(span.low or 0, -int(-(low.timestamp()) // SLOT))
    # A bound to the microsecond: the hour that ends with it is whole.
    last = (span.high or 0) - 1 if high is None else min((span.high or 0) - 1, int((high + timedelta(microseconds=1)).timestamp() // SLOT) - 1)
    edge = window(messages, date_from, date_to)
    if first <= last:
        stored = index.where(_any_block(stored_blocks(cover(first, last))))
        edge = edge.where((_slot(F.col("ts")) < first) | (_slot(F.col("ts")) > last))
        parts = stored.select("label", "n", "first").unionByName(_counted(edge))
    else:
        parts = _counted(edge)
    words = write_scratch(parts.groupBy("label").agg(*_merged()), "window_words")
    total = words.where(F.col("label") == ALL).agg(F.max("n")).scalar()
    order = [F.desc("occurrences"), F.asc("first_seen_ts"), F.asc("label")]
    top = write_scratch(words.where((F.col("label") != ALL) & (F.col("n") >= min_occurrences)).select(
        "label", F.col("n").alias("occurrences"), (F.col("n") / total).alias("weight"), F.col("first")[0]["ts"].alias("first_seen_ts"),
        F.slice("first", 1, sample_limit).alias("first")).orderBy(*order).limit(limit), "top_words")
    wanted = top.select("label", F.posexplode("first").alias("nth", "at")).select("label", "nth", "at.conv_id", "at.msg_id")
    texts = messages.select("conv_id", "msg_id", "role", "ts", trim_text(F.col("text")).alias("text"))
    found = join_texts(texts, wanted, ["conv_id", "msg_id"])
    anchors = found.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("nth", "conv_id", "msg_id", "role", "ts", "text"))).alias("anchors"))
    return top.drop("first").join(F.broadcast(anchors), "label", "left") \
        .withColumn("anchors", F.transform("anchors", lambda a: a.dropFields("nth"))).orderBy(*order)


def _any_block(blocks: list[tuple[int, int]]) -> Column:
    """Rows of the given blocks; the levels choose partitions, the blocks row groups."""
    by_level: dict[int, list[int]] = {}
    for level, block in blocks:
        by_level.setdefault(level, []).append(block)
    condition = F.lit(False)
    for level, numbers in by_level.items():
        condition = condition | ((F.col("level") == level) & F.col("block").isin(numbers))
    return condition
