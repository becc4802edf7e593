"""Reply threads of a stored archive by interval labels.

Every message gets two numbers, ``low`` and ``high``, such that the replies below it are the
messages of its conversation with ``low <= high(reply) < high``, later ones in depth-first
order having smaller numbers, and its ``depth``. Ancestors and descendants are then interval
joins instead of walks.

The numbers come from the Euler tour of the reply forest, siblings by time: each message is
entered and left, every step points to the next, and pointer doubling over all conversations at
once adds up, in log2(steps) rounds, how many messages are still to be entered. Siblings are
numbered by slabs, so neither a long conversation nor a message with many replies is one task.

Messages in a reply cycle, or below one, have no place in a tour and get no label;
``threads`` walks those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from threadloom.operators.ordered import running_sum, write_slabs
from threadloom.operators.threads import BODY, anchor_messages
from threadloom.session import broadcast_if_small, join_texts, write_measured, write_scratch

BUCKETS = 256
LABELS = ["conv_id", "msg_id", "low", "high", "depth"]


def _steps(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, conv_id, msg_id) and the steps of the tour: step, next, entered (1 or 0), opened (1 or -1)."""
    nodes = write_scratch(messages.select("conv_id", "msg_id", "ts", "parent_id", F.monotonically_increasing_id().alias("id")), "nodes")
    above = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.col("id").alias("up"))
    placed = nodes.join(above, ["conv_id", "parent_id"], "left").select(
        "id", "conv_id", "msg_id", "ts", F.coalesce("up", F.lit(-1)).alias("up"))
    group, order = ["conv_id", "up"], ["ts", "msg_id"]
    numbered = write_scratch(running_sum(write_slabs(placed, group, order, F.lit(1)), group, order, "nth")
                             .select("id", "conv_id", "up", "nth"), "siblings")
    after = numbered.select("conv_id", "up", (F.col("nth") - 1).alias("nth"), F.col("id").alias("sibling"))
    first = numbered.where("nth = 1 AND up >= 0").select(F.col("up").alias("id"), F.col("id").alias("child"))
    joined = numbered.join(after, ["conv_id", "up", "nth"], "left").join(first, "id", "left")
    enter = F.struct((F.col("id") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"),
                     F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("opened"))
    onward = F.when(F.col("sibling").isNotNull(), F.col("sibling") * 2).when(F.col("up") >= 0, F.col("up") * 2 + 1)
    leave = F.struct((F.col("id") * 2 + 1).alias("step"), onward.alias("next"), F.lit(0).cast("long").alias("entered"),
                     F.lit(-1).cast("long").alias("opened"))
    return nodes.select("id", "conv_id", "msg_id"), joined.select(F.explode(F.array(enter, leave)).alias("s")).select("s.*")


def label_forest(messages: DataFrame) -> DataFrame:
    """conv_id, msg_id, low, high, depth of every message whose ancestors end at a root."""
    nodes, steps = _steps(messages)
    tour, n, _ = write_measured(steps, "tour")
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        ahead = tour.select(F.col("step").alias("next"), F.col("next").alias("far"), F.col("entered").alias("more"), F.col("opened").alias("depths"))
        going = tour.where("next IS NOT NULL").join(ahead, "next").select(
            "step", F.col("far").alias("next"), (F.col("entered") + F.col("more")).alias("entered"), (F.col("opened") + F.col("depths")).alias("opened"))
        seen = Observation()
        tour = write_scratch(going.unionByName(tour.where("next IS NULL")).observe(seen, F.count("next").alias("going")), "tour")
        if not seen.get["going"]:
            break
    done = tour.where("next IS NULL")
    entered = done.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("id"), F.col("entered").alias("high"), (-F.col("opened")).alias("depth"))
    left = done.where("step % 2 = 1").select(((F.col("step") - 1) / 2).cast("long").alias("id"), (F.col("entered") + 1).alias("low"))
    return nodes.join(entered, "id").join(left, "id").select(LABELS)


def _bucket(conv_id: Column) -> Column:
    return F.pmod(F.xxhash64(conv_id), F.lit(BUCKETS)).cast("int")


def write_labels(messages: DataFrame, path: str) -> None:
    """Label all messages; the table is partitioned by a hash of the conversation."""
    label_forest(messages).withColumn("bucket", _bucket(F.col("conv_id"))).repartitionByRange("bucket", "conv_id", "high") \
        .write.partitionBy("bucket").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("conv_id string, msg_id string, low long, high long, depth long, bucket int").parquet(path).select(LABELS)


def update_labels(messages: DataFrame, new: DataFrame, path: str) -> None:
    """Label the conversations with ``new`` messages again, of ``messages``, which hold them; other partitions stay untouched."""
    spark = messages.sparkSession
    touched = broadcast_if_small(new.select("conv_id").distinct())
    buckets = [r.bucket for r in touched.select(_bucket(F.col("conv_id")).alias("bucket")).distinct().collect()]
    stored = spark.read.schema("conv_id string, msg_id string, low long, high long, depth long, bucket int").parquet(path) \
        .where(F.col("bucket").isin(buckets))
    fresh = label_forest(messages.join(touched, "conv_id", "left_semi")).withColumn("bucket", _bucket(F.col("conv_id")))
    rows = write_scratch(stored.join(touched, "conv_id", "left_anti").unionByName(fresh), "labels")
    rows.repartitionByRange("bucket", "conv_id", "high").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("bucket").parquet(path)


def _cells_of_interval(low: Column, end: Column, levels: int) -> Column:
    """The dyadic cells (level, cell) that make up [low, end)."""
    start = F.struct(low.alias("low"), end.alias("end"), F.array().cast("array<struct<level:int,cell:bigint>>").alias("cells"))
    cell = lambda level, number: F.array(F.struct(level.alias("level"), number.alias("cell")))

    def step(state: Column, level: Column) -> Column:
        going = state["low"] < state["end"]
        left, right = going & (state["low"] % 2 == 1), going & (state["end"] % 2 == 1)
        cells = F.concat(state["cells"], F.when(left, cell(level, state["low"])).otherwise(F.array()),
                         F.when(right, cell(level, state["end"] - 1)).otherwise(F.array()))
        return F.struct(F.floor((state["low"] + F.when(left, 1).otherwise(0)) / 2).alias("low"), F.floor(state["end"] / 2).alias("end"),
                        cells.alias("cells"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda state: state["cells"])


def _cells_of_point(point: Column, levels: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(levels)),
                       lambda level: F.struct(level.alias("level"), F.floor(point / F.pow(F.lit(2.0), level)).alias("cell")))


def thread_links(labels: DataFrame, anchors: DataFrame, depth: int = 3) -> DataFrame:
    """conv_id, anchor_id, msg_id, relation, distance, order_idx of the ancestors, and of the descendants down to ``depth``."""
    if depth < 1:
        raise ValueError(f"depth starts at 1, got {depth}")
    wanted = broadcast_if_small(anchors.select("conv_id", F.col("msg_id").alias("anchor_id")).distinct())
    scope = write_scratch(labels.join(broadcast_if_small(wanted.select("conv_id").distinct()), "conv_id", "left_semi"), "labels")
    start = scope.withColumnRenamed("msg_id", "anchor_id").join(wanted, ["conv_id", "anchor_id"])
    levels = int(scope.agg(F.max("high")).first()[0] or 1).bit_length()
    own = start.select("conv_id", "anchor_id", F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("depth").alias("a_depth"))

    # Ancestors: whose interval holds the anchor's number.
    around = scope.select("conv_id", "msg_id", "depth", F.explode(_cells_of_interval(F.col("low"), F.col("high"), levels)).alias("c")) \
        .select("conv_id", "msg_id", "depth", "c.level", "c.cell")
    points = own.select("conv_id", "anchor_id", "a_depth", F.explode(_cells_of_point(F.col("a_high"), levels)).alias("c")) \
        .select("conv_id", "anchor_id", "a_depth", "c.level", "c.cell")
    above = points.join(around, ["conv_id", "level", "cell"]).select(
        "conv_id", "anchor_id", "msg_id", F.lit("ancestor").alias("relation"), (F.col("a_depth") - F.col("depth")).alias("distance"),
        (F.col("depth") + 1).alias("order_idx"))

    # Descendants: one depth at a time is part of the key, so deeper ones never meet the anchor.
    inside = own.select("conv_id", "anchor_id", "a_depth", F.explode(_cells_of_interval(F.col("a_low"), F.col("a_high"), levels)).alias("c")) \
        .select("conv_id", "anchor_id", "a_depth", "c.level", "c.cell", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("distance")) \
        .withColumn("depth", F.col("a_depth") + F.col("distance"))
    places = scope.select("conv_id", "msg_id", "depth", (-F.col("high")).alias("turn"), F.explode(_cells_of_point(F.col("high"), levels)).alias("c")) \
        .select("conv_id", "msg_id", "depth", "turn", "c.level", "c.cell")
    below = inside.join(places, ["conv_id", "depth", "level", "cell"]).select("conv_id", "anchor_id", "msg_id", "distance", "turn")
    group = ["conv_id", "anchor_id"]
    below = running_sum(write_slabs(below, group, ["turn"], F.lit(1)), group, ["turn"], "order_idx").select(
        "conv_id", "anchor_id", "msg_id", F.lit("descendant").alias("relation"), F.col("distance").cast("long").alias("distance"), "order_idx")
    return above.unionByName(below)


def labelled_thread(messages: DataFrame, labels: DataFrame, anchors: DataFrame, depth: int = 3) -> DataFrame:
    """Anchor, ancestors and descendants as one flat result, equal to ``threads.thread``."""
    columns = ["conv_id", "anchor_id", "relation", "distance", "order_idx", "msg_id", *BODY]
    links = thread_links(labels, anchors, depth)
    around = join_texts(messages.select("conv_id", "msg_id", *BODY), links, ["conv_id", "msg_id"])
    itself = anchor_messages(messages, anchors).select(
        "*", F.lit("anchor").alias("relation"), F.lit(0).alias("distance"), F.lit(0).alias("order_idx"))
    return itself.select(columns).unionByName(around.select(columns))
