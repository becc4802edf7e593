"""Plans and results when nothing is small and one key holds most rows."""

import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from threadloom import session
from threadloom.operators import browse, loads, search, threads, topics
from threadloom.operators.filters import search_filters, window

SF_DIR = "/root/testdata/sf0.001"
JOINS = ["thread_ancestors", "thread_descendants", "thread", "context_pack_truncated", "search_many_simple",
         "search_many_postings", "filter_ids", "cascade_delete", "fk_orphans", "validate_messages", "insert_ignore"]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Shuffled joins only, with run-time skew splitting at toy sizes."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", JOINS)
def test_results_without_any_broadcast(spark, no_broadcast, name):
    result = spark_entry.queries()[name](spark, SF_DIR)
    assert compare.differences(result, compare.connect(SF_DIR), spark_entry.oracle_sql()[name]) is None


@pytest.fixture
def lopsided(spark, tmp_path):
    """A conversation with most of the messages, all replies to its first one."""
    rows = spark.range(30000).select(
        F.when(F.col("id") < 20000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("conv_id"),
        F.col("id").cast("string").alias("msg_id"), F.lit("user").alias("role"),
        F.timestamp_seconds(F.col("id") + 1700000000).alias("ts"),
        F.concat(F.lit("common word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
        F.when((F.col("id") > 0) & (F.col("id") < 20000), "0").alias("parent_id"))
    rows.repartition(8).write.parquet(str(tmp_path / "m"))
    return spark.read.parquet(str(tmp_path / "m"))


def test_one_hot_parent(spark, lopsided, no_broadcast):
    everyone = lopsided.select("conv_id", "msg_id")
    above = threads.thread_ancestors(lopsided, everyone)
    assert above.count() == 19999 and above.select("msg_id").distinct().count() == 1
    root = everyone.where("conv_id = 'hot' AND msg_id = '0'")
    order = threads.thread_descendants(lopsided, root).agg(F.max("order_idx"), F.count_distinct("order_idx")).first()
    assert tuple(order) == (19999, 19999)


def test_skewed_join_is_split(spark, lopsided, no_broadcast):
    replies = threads.reply_pairs(lopsided)
    replies.collect()
    assert "skew=true" in replies._jdf.queryExecution().executedPlan().toString()


def test_copies_collapse_before_the_shuffle(spark, lopsided, capsys):
    copies = lopsided.withColumn("msg_id", F.when(F.col("conv_id") == "hot", "1").otherwise(F.col("msg_id")))
    kept = loads.dedupe_by_key(copies, ["conv_id", "msg_id"], ["ts"])
    assert kept.where("conv_id = 'hot'").first().ts == lopsided.agg(F.min("ts")).first()[0]
    kept.explain()
    plan = capsys.readouterr().out
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_filters_and_columns_reach_the_scan(lopsided, capsys):
    plan = plan_of(search_filters(lopsided, {"role": "user", "date_from": "2023-11-15"}).select("msg_id"), capsys)
    assert "EqualTo(role,user)" in plan and "GreaterThanOrEqual(ts" in plan and "text:string" not in plan
    plan = plan_of(browse.conversation_summary(window(lopsided, conv_id="c1")), capsys)
    assert "EqualTo(conv_id,c1)" in plan and "ReadSchema: struct<conv_id:string,msg_id:string,ts:timestamp>" in plan


def test_top_k_never_sorts_everything(lopsided, capsys):
    chats = lopsided.select("conv_id").distinct().withColumn("title", F.lit("t")).withColumn("owner_id", F.lit("o"))
    for df in (search.top_keys(lopsided, ["word"]), search.top_keys(lopsided, ["word"], stemmer=None),
               topics.top_topics(lopsided), browse.list_conversations(chats, lopsided, offset=10)):
        plan = plan_of(df, capsys)
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_no_query_pairs_everything(spark):
    for name, query in spark_entry.queries().items():
        if name.startswith(("stream", "thread")):
            continue
        plan = query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
