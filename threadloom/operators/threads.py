"""Reply-tree neighbourhoods of many anchor messages at once.

Anchors are rows (conv_id, msg_id). Results are flat rows keyed by
(conv_id, anchor_id). Only narrow link columns take part in the iteration; role,
time and text are joined to the finished result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threadloom.operators.ordered import running_sum, write_slabs
from threadloom.session import hint, join_texts, write_measured, write_scratch

BODY = ["parent_id", "role", "ts", "text"]
Located = tuple[DataFrame, DataFrame]


def _anchor_keys(anchors: DataFrame) -> DataFrame:
    return anchors.select("conv_id", F.col("msg_id").alias("anchor_id")).distinct()


def _located(messages: DataFrame, anchors: DataFrame) -> Located:
    """The messages of the anchors' conversations, and the anchors that exist.

    Keys of messages are unique, so each anchor is found at most once.
    """
    keys, _, size = write_measured(_anchor_keys(anchors), "anchors")
    scope = messages.join(hint(keys.select("conv_id").distinct(), size), "conv_id", "left_semi")
    found = messages.select("conv_id", F.col("msg_id").alias("anchor_id"))
    return scope, found.join(hint(keys, size), ["conv_id", "anchor_id"])


def missing_anchors(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors whose conversation or message does not exist, with the reason."""
    scope, present = _located(messages, anchors)
    absent = _anchor_keys(anchors).join(present, ["conv_id", "anchor_id"], "left_anti")
    known = scope.select("conv_id").distinct().withColumn("known", F.lit(True))
    reason = F.when(F.col("known"), "message not found in conversation").otherwise("conversation not found")
    return absent.join(known, "conv_id", "left").select("conv_id", "anchor_id", reason.alias("reason"))


def _with_body(result: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the message columns; no text moves that is not part of the result's conversations."""
    return join_texts(messages.select("conv_id", "msg_id", *BODY), result, ["conv_id", "msg_id"])


def anchor_messages(messages: DataFrame, anchors: DataFrame, located: Located | None = None) -> DataFrame:
    start = (located or _located(messages, anchors))[1]
    return _with_body(start.withColumn("msg_id", F.col("anchor_id")), messages)


def reply_pairs(messages: DataFrame) -> DataFrame:
    """Every message with each of its direct replies."""
    replies = messages.select("conv_id", F.col("parent_id").alias("msg_id"), F.col("msg_id").alias("reply_id"),
                              F.col("role").alias("reply_role"), F.col("ts").alias("reply_ts"))
    return messages.select("conv_id", "msg_id", "role", "ts").join(replies, ["conv_id", "msg_id"])


def ancestor_links(messages: DataFrame, anchors: DataFrame, located: Located | None = None) -> DataFrame:
    """(conv_id, anchor_id, msg_id, distance) for every ancestor, by pointer doubling.

    ``hop`` maps a message to its 2^k-th ancestor and ``reached`` holds all ancestors
    closer than 2^k, each once and at its shortest distance, so a chain of n messages
    takes log2(n) rounds. A round that reaches nothing new ends the search, which also
    ends reply cycles as soon as they have been walked once. The result has as many rows
    as there are (anchor, ancestor) pairs: for all messages of a linear chat as anchors
    that is the square of its length.
    """
    scope, start = located or _located(messages, anchors)
    child = scope.where(F.col("parent_id") != "").select("conv_id", "msg_id", F.col("parent_id").alias("up"))
    parent = scope.select("conv_id", F.col("msg_id").alias("up"))
    hop = write_scratch(child.join(parent, ["conv_id", "up"], "left_semi"), "hops")
    pair = ["conv_id", "anchor_id", "msg_id"]
    parts = [write_scratch(start.select("conv_id", "anchor_id", F.col("anchor_id").alias("msg_id"),
                                        F.lit(0).cast("bigint").alias("distance")), "reached")]
    span = 1
    while True:
        reached = reduce(DataFrame.unionByName, parts)
        farther, found, _ = write_measured(
            reached.join(hop, ["conv_id", "msg_id"])
            .groupBy("conv_id", "anchor_id", F.col("up").alias("msg_id"))
            .agg((F.min("distance") + span).alias("distance"))
            .join(reached.select(*pair), pair, "left_anti"), "reached")
        if not found:
            return reached.where(F.col("distance") > 0)
        parts.append(farther)
        span *= 2
        further = hop.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("far"))
        hop = write_scratch(hop.join(further, ["conv_id", "up"])
                            .select("conv_id", "msg_id", F.col("far").alias("up")), "hops")


def thread_ancestors(messages: DataFrame, anchors: DataFrame, located: Located | None = None) -> DataFrame:
    """Ancestors from the root (``order_idx`` 1) to the direct parent."""
    links = ancestor_links(messages, anchors, located)
    depth = links.groupBy("conv_id", "anchor_id").agg(F.count("*").alias("depth"))
    ordered = links.join(depth, ["conv_id", "anchor_id"]) \
        .withColumn("order_idx", F.col("depth") - F.col("distance") + 1).drop("depth")
    return _with_body(ordered, messages)


def descendant_links(messages: DataFrame, anchors: DataFrame, depth: int = 3,
                     located: Located | None = None) -> DataFrame:
    """(conv_id, anchor_id, msg_id, distance, path); sorting by path gives depth-first order.

    One round per level; a path holds one step per level, so ``depth`` bounds a row's size.
    """
    if depth < 1:
        raise ValueError(f"depth starts at 1, got {depth}")
    scope, start = located or _located(messages, anchors)
    replies = write_scratch(
        scope.where(F.col("parent_id").isNotNull())
        .select("conv_id", F.col("parent_id").alias("node"), F.col("msg_id").alias("reply"),
                F.struct("ts", "msg_id").alias("step")), "replies")
    none = F.array().cast(replies.select(F.array("step")).schema[0].dataType)
    frontier = start.select(
        "conv_id", "anchor_id", F.col("anchor_id").alias("node"), none.alias("path"))
    levels = []
    for distance in range(1, depth + 1):
        level, found, _ = write_measured(
            frontier.join(replies, ["conv_id", "node"])
            .select("conv_id", "anchor_id", F.col("reply").alias("node"),
                    F.array_append("path", F.col("step")).alias("path"),
                    F.lit(distance).alias("distance")), "level")
        levels.append(level)
        if not found:
            break
        frontier = level.drop("distance")
    return reduce(DataFrame.unionByName, levels).withColumnRenamed("node", "msg_id")


def thread_descendants(messages: DataFrame, anchors: DataFrame, depth: int = 3,
                       located: Located | None = None) -> DataFrame:
    """Descendants in depth-first order, siblings by time, numbered from 1."""
    links = descendant_links(messages, anchors, depth, located)
    group, order = ["conv_id", "anchor_id"], ["path"]
    ordered = running_sum(write_slabs(links, group, order, F.lit(1)), group, order, "order_idx").drop("path")
    return _with_body(ordered, messages)


def thread(messages: DataFrame, anchors: DataFrame, depth: int = 3) -> DataFrame:
    """Anchor, ancestors and descendants as one flat result, told apart by ``relation``."""
    columns = ["conv_id", "anchor_id", "relation", "distance", "order_idx", "msg_id", *BODY]
    scope, start = _located(messages, anchors)
    links = ["conv_id", "msg_id", "parent_id", "ts"]
    located = scope.select(*links), write_scratch(start, "located")
    above = thread_ancestors(messages, anchors, located).withColumn("relation", F.lit("ancestor"))
    below = thread_descendants(messages, anchors, depth, located).withColumn("relation", F.lit("descendant"))
    itself = anchor_messages(messages, anchors, located).withColumn("relation", F.lit("anchor")) \
        .withColumn("distance", F.lit(0)).withColumn("order_idx", F.lit(0))
    return itself.select(columns).unionByName(above.select(columns)).unionByName(below.select(columns))
