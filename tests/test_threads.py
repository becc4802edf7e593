import random

import pytest

from threadloom.operators import ordered, threads
from pyspark.sql import functions as F

BASE = "2024-01-01 {:02}:{:02}:{:02}".format


def stamp(i):
    return BASE(i // 3600, i // 60 % 60, i % 60)


def tree(conv, parents, times=None):
    return [(conv, m, "user", stamp((times or {}).get(m, i)), f"text {m}", p) for i, (m, p) in enumerate(parents.items())]


def anchors(spark, *pairs):
    return spark.createDataFrame(list(pairs), "conv_id string, msg_id string")


def model(parents, times, anchor, depth):
    """Plain reading of the definition: walk up to the root, then depth-first down."""
    up, node = [], parents[anchor]
    while node in parents:
        up.insert(0, node)
        node = parents[node]

    def down(at, level):
        if level == depth:
            return []
        kids = sorted((m for m in parents if parents[m] == at), key=lambda m: (times[m], m))
        return [x for kid in kids for x in [kid, *down(kid, level + 1)]]

    return up, down(anchor, 0)


def ids(rows, conv, anchor):
    return [r.msg_id for r in sorted((r for r in rows if (r.conv_id, r.anchor_id) == (conv, anchor)),
                                     key=lambda r: r.order_idx)]


def test_random_trees_match_the_definition(spark, messages):
    pick = random.Random(7)
    rows, trees = [], {}
    for conv in ("a", "b", "c"):
        names = [str(i) for i in range(25)]
        parents = {n: (None if i == 0 else pick.choice(names[:i] + ["gone", ""])) for i, n in enumerate(names)}
        times = {n: pick.randrange(6) for n in names}
        trees[conv] = (parents, times)
        rows += tree(conv, parents, times)
    table = messages(rows)
    every = table.select("conv_id", "msg_id")
    above = threads.thread_ancestors(table, every).collect()
    below = threads.thread_descendants(table, every, depth=2).collect()
    for conv, (parents, times) in trees.items():
        for anchor in parents:
            up, down = model(parents, times, anchor, 2)
            assert ids(above, conv, anchor) == up
            assert ids(below, conv, anchor) == down


def test_long_chain(spark, messages):
    parents = {str(i): (str(i - 1) if i else None) for i in range(150)}
    out = threads.thread_ancestors(messages(tree("c", parents)), anchors(spark, ("c", "149"))).collect()
    assert ids(out, "c", "149") == [str(i) for i in range(149)]


def test_cycles_end(spark, messages):
    table = messages(tree("c", {"a": "b", "b": "a", "s": "s", "t": "a"}))
    out = threads.thread_ancestors(table, anchors(spark, ("c", "a"), ("c", "s"), ("c", "t"))).collect()
    assert ids(out, "c", "a") == ["b"] and ids(out, "c", "s") == [] and ids(out, "c", "t") == ["b", "a"]


def test_cycles_do_not_multiply_rows(spark, messages, monkeypatch):
    rows = [r for i in range(40) for r in tree(f"c{i}", {"a": "b", "b": "a"})]
    rows += tree("long", {str(i): (str(i - 1) if i else None) for i in range(300)})
    table = messages(rows)
    asked = anchors(spark, *[(f"c{i}", m) for i in range(40) for m in "ab"])
    written = []
    plain = threads.write_measured
    monkeypatch.setattr(threads, "write_measured", lambda *a: written.append(plain(*a)) or written[-1])
    assert threads.thread_ancestors(table, asked).count() == 80
    assert sum(n for _, n, _ in written[1:]) <= 160


def test_depth_and_missing(spark, messages):
    table = messages(tree("c", {"a": None, "b": "a", "c": "b"}))
    asked = anchors(spark, ("c", "a"), ("c", "zz"), ("q", "a"))
    assert [r.msg_id for r in threads.thread_descendants(table, asked, depth=1).collect()] == ["b"]
    missing = {(r.conv_id, r.anchor_id): r.reason for r in threads.missing_anchors(table, asked).collect()}
    assert missing == {("c", "zz"): "message not found in conversation", ("q", "a"): "conversation not found"}
    with pytest.raises(ValueError):
        threads.thread_descendants(table, asked, depth=0)
    whole = threads.thread(table, anchors(spark, ("c", "b"))).collect()
    assert {(r.relation, r.msg_id) for r in whole} == {("anchor", "b"), ("ancestor", "a"), ("descendant", "c")}


def test_a_star_is_numbered_across_partitions(spark, messages):
    parents = {"root": None} | {f"{i:04}": "root" for i in range(2000)}
    out = threads.thread_descendants(messages(tree("c", parents)), anchors(spark, ("c", "root"))).collect()
    assert ids(out, "c", "root") == [f"{i:04}" for i in range(2000)]


def test_running_sum_splits_a_large_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(6000).select(
            F.when(F.col("id") < 5000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
            (F.col("id") * 7919 % 6007).alias("o"), (F.col("id") % 5).alias("v"))
        slabs = ordered.write_slabs(rows, ["g"], ["o"], F.col("v"))
        assert slabs.where("g = 'hot'").select("_slab").distinct().count() > 1
        full = ordered.running_sum(slabs, ["g"], ["o"], "total").collect()
        cut = ordered.running_sum(slabs, ["g"], ["o"], "total", below=40).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.o)):
        sums[r.g] = sums.get(r.g, 0) + r.v
        expected[r.g, r.o] = sums[r.g]
    assert {(r.g, r.o): r.total for r in full} == expected
    assert {(r.g, r.o): r.total for r in cut} == {k: v for k, v in expected.items() if v <= 40}
