"""Stored listings, topic counts and thread labels give what the operators on messages give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.operators import browse, paging, thread_index, threads, topic_index, topics


def pick_messages(rng, conversations=12, most=40):
    """Messages of random reply trees with repeated words, over some days."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "the", "zeta", "eta", "theta"]
    rows = []
    for c in range(conversations):
        for i in range(rng.randint(1, most)):
            minute = rng.randrange(60 * 24 * 6)
            ts = f"2024-03-{1 + minute // 1440:02} {minute % 1440 // 60:02}:{minute % 60:02}:00"
            parent = str(rng.randrange(i)) if i and rng.random() < 0.85 else rng.choice([None, "missing"])
            rows.append((f"c{c}", str(i), "user", ts, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), parent))
    return rows


# ---------------------------------------------------------------- pages

@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    rng = random.Random(2)
    convs = spark.createDataFrame([(f"c{i:03}", rng.choice([None, "A", "B", f"t{i}"]), f"o{i % 3 if i % 7 else 0}") for i in range(230)],
                                  "conv_id string, title string, owner_id string")
    rows = [(f"c{rng.randrange(200):03}", str(i), f"2024-01-{rng.randint(1, 28):02} 00:00:00") for i in range(600)]
    messages = spark.createDataFrame(rows, "conv_id string, msg_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path_factory.mktemp("listing") / "x")
    paging.write_listing(convs, messages, path, slab_rows=25)
    return convs, messages, path


@pytest.mark.parametrize("owner", [None, "o0", "o2", "nobody"])
@pytest.mark.parametrize("limit, offset", [(10, 0), (7, 24), (60, 33), (5, 228), (5, 5000), (1000, 0)])
def test_pages_of_the_listing(spark, listing, owner, limit, offset):
    convs, messages, path = listing
    want = [tuple(r) for r in browse.list_conversations(convs, messages, owner, limit, offset).collect()]
    got = paging.listing_page(spark, path, limit, offset, owner).collect()
    assert [tuple(r)[:-1] for r in got] == want and [r["rank"] for r in got] == list(range(offset + 1, offset + 1 + len(want)))


def test_a_deep_page_opens_its_slabs_only(spark, listing):
    path = listing[2]
    page = paging.listing_page(spark, path, 10, 120)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = page._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    opened = re.search(r"PartitionFilters: \[.*?slab#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    slabs = spark.read.parquet(f"{path}/rows").select("slab").distinct().count()
    assert slabs >= 9 and opened and (opened[1] or opened[2]).count(",") <= 1


def test_empty_listing(spark, listing, tmp_path):
    convs, messages, _ = listing
    paging.write_listing(convs.limit(0), messages, str(tmp_path / "x"))
    assert paging.listing_page(spark, str(tmp_path / "x")).collect() == []
    with pytest.raises(ValueError):
        paging.listing_page(spark, str(tmp_path / "x"), 0)


# ---------------------------------------------------------------- topics

def shown(rows):
    return [(r.label, r.occurrences, round(r.weight, 12), r.first_seen_ts, [tuple(a) for a in r.anchors]) for r in rows.collect()]


WINDOWS = [(None, None), ("2024-03-02T10:30:00", "2024-03-04T09:15:00"), ("2024-03-02T10:00:00", "2024-03-02T10:59:59.999999"),
           ("2024-03-03T05:10:00", "2024-03-03T05:50:00"), (None, "2024-03-02"), ("2024-03-05T23:00:00Z", None), ("2025-01-01", "2025-02-01"),
           ("2024-03-01", "2024-03-06T23:59:59.999999")]


@pytest.fixture(scope="module")
def topic_rows(spark, tmp_path_factory):
    rows = spark.createDataFrame(pick_messages(random.Random(4)),
                                 "conv_id string, msg_id string, role string, ts string, text string, parent_id string") \
        .withColumn("ts", F.col("ts").cast("timestamp")).drop("parent_id")
    path = str(tmp_path_factory.mktemp("topics") / "x")
    topic_index.write_topics(rows.where("conv_id < 'c3'"), path, "one")
    topic_index.write_topics(rows, path, "two")  # a first attempt that wrote more
    topic_index.write_topics(rows.where("conv_id >= 'c3'"), path, "two")
    return rows, path


@pytest.mark.parametrize("low, high", WINDOWS)
def test_topic_maps_from_stored_counts(topic_rows, low, high):
    rows, path = topic_rows
    got = shown(topic_index.indexed_topic_map(rows, path, low, high, limit=6, sample_limit=4))
    assert got == shown(topics.topic_map(rows, low, high, limit=6, sample_limit=4))
    assert got or low == "2025-01-01" or low == "2024-03-03T05:10:00" or low == "2024-03-02T10:00:00"


def test_the_index_has_few_levels(spark, topic_rows):
    """Every level holds a row for nearly every word of an hour, so there are few of them."""
    rows, path = topic_rows
    index = spark.read.parquet(path)
    assert sorted(r.level for r in index.select("level").distinct().collect()) == [0, 4, 8, 12]
    hours = index.where("level = 0").count()
    assert index.count() <= 4 * hours
    whole = index.where("level = 12").groupBy("label").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(index.where("level = 0").groupBy("label").agg(F.sum("n").alias("n"))).count() == 0


def test_stored_blocks_cover_the_same_hours():
    for first, last in ((0, 0), (5, 40_000), (4096, 8191), (-70_000, 90_001)):
        at = first
        for level, block in topic_index.stored_blocks(topic_index.cover(first, last)):
            assert level % topic_index.STEP == 0 and block << level == at
            at += 1 << level
        assert at == last + 1


def test_blocks_cover_every_hour_once():
    rng = random.Random(1)
    for _ in range(300):
        first = rng.randrange(500_000)
        last = first + rng.randrange(100_000)
        blocks = topic_index.cover(first, last)
        at = first
        for level, block in blocks:
            assert block << level == at
            at += 1 << level
        assert at == last + 1
        assert len(blocks) <= 2 * topic_index.LEVELS + (last - first) // (1 << topic_index.LEVELS - 1)


# ---------------------------------------------------------------- threads

def plain(rows):
    return sorted((r.conv_id, r.anchor_id, r.relation, r.distance, r.order_idx, r.msg_id, r.text) for r in rows.collect())


@pytest.fixture(scope="module")
def trees(spark):
    rows = pick_messages(random.Random(6), 8, 30)
    rows += [("chain", str(i), "user", "2024-01-01 00:00:00", "x", str(i - 1) if i else None) for i in range(70)]
    rows += [("star", str(i), "user", f"2024-01-01 00:{i % 60:02}:00", "x", "0" if i else None) for i in range(50)]
    rows += [("loop", "a", "user", "2024-01-01 00:00:00", "x", "b"), ("loop", "b", "user", "2024-01-01 00:00:00", "x", "a"),
             ("loop", "c", "user", "2024-01-01 00:00:00", "x", "b"), ("loop", "d", "user", "2024-01-01 00:00:00", "x", None)]
    table = spark.createDataFrame(rows, "conv_id string, msg_id string, role string, ts string, text string, parent_id string")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("depth", [1, 3])
def test_threads_by_labels(trees, depth):
    labels = thread_index.write_scratch(thread_index.label_forest(trees), "labels")
    assert labels.where("conv_id = 'loop'").select("msg_id").collect()[0].msg_id == "d"
    apart = trees.where("conv_id != 'loop'")
    anchors = apart.select("conv_id", "msg_id")
    assert plain(thread_index.labelled_thread(apart, labels, anchors, depth)) == plain(threads.thread(apart, anchors, depth))
    few = anchors.where("msg_id = '7'")
    assert plain(thread_index.labelled_thread(apart, labels, few, depth)) == plain(threads.thread(apart, few, depth))


def test_labels_after_new_replies(spark, trees, tmp_path):
    path = str(tmp_path / "labels")
    rows = trees.where("conv_id != 'loop'")
    late = rows.where("msg_id IN ('5', '9', '33') AND conv_id IN ('c1', 'c2', 'chain')")
    thread_index.write_labels(rows.join(late.select("conv_id", "msg_id"), ["conv_id", "msg_id"], "left_anti"), path)
    untouched = {f for r in spark.read.parquet(path).where("conv_id = 'star'").select(F.input_file_name().alias("f")).collect() for f in [r.f]}
    thread_index.update_labels(rows, late, path)
    key = lambda t: sorted(map(tuple, t.select(thread_index.LABELS).collect()))
    assert key(thread_index.read_labels(spark, path)) == key(thread_index.label_forest(rows))
    after = {f for r in spark.read.parquet(path).where("conv_id = 'star'").select(F.input_file_name().alias("f")).collect() for f in [r.f]}
    shared = spark.read.parquet(path).where("conv_id IN ('c1', 'c2', 'chain')").select("bucket").distinct().intersect(
        spark.read.parquet(path).where("conv_id = 'star'").select("bucket").distinct()).count()
    assert shared or untouched == after


def test_intervals_are_cut_into_cells(spark):
    rng = random.Random(9)
    pairs = [(a, a + rng.randrange(60)) for a in (rng.randrange(200) for _ in range(200))]
    rows = spark.createDataFrame(pairs, "low long, high long").select(
        "low", "high", thread_index._cells_of_interval(F.col("low"), F.col("high"), 9).alias("cells")).collect()
    for r in rows:
        covered = sorted(x for c in r.cells for x in range(c.cell << c.level, c.cell + 1 << c.level))
        assert covered == list(range(r.low, r.high)) and len(r.cells) <= 2 * 10
    point, = spark.range(1).select(thread_index._cells_of_point(F.lit(13).cast("long"), 4).alias("c")).collect()
    assert [(c.level, c.cell) for c in point.c] == [(0, 13), (1, 6), (2, 3), (3, 1), (4, 0)]
