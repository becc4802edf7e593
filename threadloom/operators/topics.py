"""Topic map: document-frequency terms of a window with sample messages.

Two passes over the window. The first counts every word (partial aggregation
keeps the shuffle to one row per word and task); the second looks only for the
few winning words, so sample messages are never ranked for words that lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.functions.text import is_topic, topic_words, trim_text
from threadloom.functions.times import normalise_iso
from threadloom.operators.filters import window


# Samples up to this many rows are sent to the topics' tasks.
SENT_SAMPLES = 10_000


def _at_least_one(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name}: expected 1 or more, got {value}")


def topic_window(messages: DataFrame, date_from=None, date_to=None, conv_id: str | None = None,
                 max_messages: int | None = None) -> DataFrame:
    """The messages a topic map looks at: the whole window, or its first ``max_messages``.

    The cap, if asked for, keeps the earliest messages. Only keys are ranked, in a job of its own
    that yields one key, the last one kept. As a literal bound it reaches the scan,
    which then skips later files, and no text moves through the top-k.
    """
    scope = window(messages, date_from, date_to, conv_id)
    if max_messages is None:
        return scope
    _at_least_one(max_messages=max_messages)
    key = F.struct("ts", "conv_id", "msg_id")
    earliest = scope.select(key.alias("k")).orderBy("k").limit(max_messages)
    last = earliest.agg(F.max("k").alias("k")).select(
        F.col("k.ts").cast("timestamp_ntz").cast("string").alias("ts"), "k.conv_id", "k.msg_id").first()
    if last.ts is None:
        return scope
    ts = F.lit(last.ts).cast("timestamp_ntz").cast(messages.schema["ts"].dataType)
    bound = F.struct(ts.alias("ts"), F.lit(last.conv_id).alias("conv_id"), F.lit(last.msg_id).alias("msg_id"))
    return scope.where((F.col("ts") <= ts) & (key <= bound))


def topic_document_frequency(scope: DataFrame) -> DataFrame:
    """Per word: messages containing it and the time it was first seen."""
    return (
        scope.select("ts", F.explode(F.array_distinct(topic_words(F.col("text")))).alias("label"))
        .where(is_topic("label"))
        .groupBy("label")
        .agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen_ts"))
    )


def top_topics(scope: DataFrame, limit: int = 10, min_occurrences: int = 2) -> DataFrame:
    """The most widespread words with their share of all messages in scope."""
    total = scope.agg(F.count("*")).scalar()
    return (
        topic_document_frequency(scope).where(F.col("occurrences") >= min_occurrences)
        .orderBy(F.desc("occurrences"), "first_seen_ts", "label").limit(limit)
        .select("label", "occurrences", (F.col("occurrences") / total).alias("weight"), "first_seen_ts")
    )


def topic_anchors(scope: DataFrame, topics: DataFrame, sample_limit: int = 3) -> DataFrame:
    """The earliest messages of each given topic, numbered from 1.

    ``topics`` is the short result of :func:`top_topics`: its labels become one scalar
    array, so the second pass is a map with a per-task top-k and no join.
    """
    labels = topics.agg(F.collect_list("label")).scalar()
    found = F.array_intersect(topic_words(F.col("text")), labels)
    hits = (
        scope.select("conv_id", "msg_id", "role", "ts", "text", found.alias("labels"))
        .select("conv_id", "msg_id", "role", "ts", "labels",
                F.when(F.size("labels") > 0, trim_text(F.col("text"))).alias("text"))
        .select(F.explode_outer("labels").alias("label"), "conv_id", "msg_id", "role", "ts", "text")
        .where(F.col("label").isNotNull())
    )
    first = Window.partitionBy("label").orderBy(F.col("ts").asc_nulls_first(), "msg_id", "conv_id")
    return hits.withColumn("anchor_no", F.row_number().over(first)).where(F.col("anchor_no") <= sample_limit)


def extract_topics(scope: DataFrame, limit: int = 10, min_occurrences: int = 2, sample_limit: int = 3) -> DataFrame:
    """Topics of already selected messages, each with its ordered anchors."""
    _at_least_one(limit=limit, min_occurrences=min_occurrences, sample_limit=sample_limit)
    topics = top_topics(scope, limit, min_occurrences)
    fields = ["anchor_no", "conv_id", "msg_id", "role", "ts", "text"]
    samples = topic_anchors(scope, topics, sample_limit).groupBy("label") \
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("anchors"))
    ordered = F.transform("anchors", lambda a: a.dropFields("anchor_no"))
    if limit * sample_limit <= SENT_SAMPLES:
        samples = F.broadcast(samples)
    return (
        topics.join(samples, "label", "left").withColumn("anchors", ordered)
        .orderBy(F.desc("occurrences"), "first_seen_ts", "label")
    )


def topic_map(messages: DataFrame, date_from=None, date_to=None, conv_id: str | None = None, limit: int = 10,
              min_occurrences: int = 2, sample_limit: int = 3, max_messages: int | None = None,
              **aliases) -> DataFrame:
    """Topics of a window; ``from`` and ``to`` are accepted as names of the bounds."""
    date_from, date_to = aliases.pop("from", date_from), aliases.pop("to", date_to)
    if aliases:
        raise TypeError(f"unknown arguments: {sorted(aliases)}")
    scope = topic_window(messages, date_from, date_to, conv_id, max_messages)
    return extract_topics(scope, limit, min_occurrences, sample_limit)


def topic_window_summary(messages: DataFrame, date_from=None, date_to=None, conv_id: str | None = None,
                         max_messages: int | None = None) -> DataFrame:
    """Size and actual bounds of the window; an empty window echoes the requested bounds."""
    scope = topic_window(messages, date_from, date_to, conv_id, max_messages)
    kind = messages.schema["ts"].dataType
    asked = [F.lit(normalise_iso(b)).cast(kind) for b in (date_from, date_to)]
    return scope.agg(
        F.count("*").alias("total_messages"),
        F.count_distinct("conv_id").alias("distinct_conversations"),
        F.coalesce(F.min("ts"), asked[0]).alias("window_start"),
        F.coalesce(F.max("ts"), asked[1]).alias("window_end"),
    )


def timeline_topics(messages: DataFrame, unit: str = "day", limit: int = 10, min_occurrences: int = 2) -> DataFrame:
    """The most widespread words of each calendar unit."""
    counts = (
        messages.select(F.date_trunc(unit, "ts").cast(messages.schema["ts"].dataType).alias("period"),
                        F.explode(F.array_distinct(topic_words(F.col("text")))).alias("label"))
        .where(is_topic("label"))
        .groupBy("period", "label").agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= min_occurrences)
    )
    best = Window.partitionBy("period").orderBy(F.desc("occurrences"), "label")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
