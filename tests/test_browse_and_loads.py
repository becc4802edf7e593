import pytest
from pyspark.sql import functions as F

from threadloom.operators import browse, filters, loads

T = "2024-01-0{} 00:00:00".format


@pytest.fixture
def conversations(spark):
    return spark.createDataFrame(
        [("c1", "Beta", "o1"), ("c2", None, "o1"), ("c3", "Alpha", "o2"), ("c4", "Empty", "o1")],
        "conv_id string, title string, owner_id string")


@pytest.fixture
def talk(messages):
    return messages([
        ("c1", "1", "user", T(1), "héé"), ("c1", "2", None, T(2), "x"), ("c1", "3", "", T(2), None),
        ("c2", "1", "user", T(2), "hi"), ("c3", "1", "assistant", T(2), "yo")])


def test_list_order_and_paging(conversations, talk):
    out = browse.list_conversations(conversations, talk).collect()
    assert [(r.conv_id, r.message_count) for r in out] == [("c3", 1), ("c1", 3), ("c2", 1), ("c4", 0)]
    page = browse.list_conversations(conversations, talk, limit=2, offset=1).collect()
    assert [r.conv_id for r in page] == ["c1", "c2"]
    assert browse.list_conversations(conversations, talk, offset=9).collect() == []
    owned = browse.list_conversations(conversations, talk, owner_id="o1").collect()
    assert [r.conv_id for r in owned] == ["c1", "c2", "c4"]
    assert browse.count_conversations(conversations, "o1").first().total == 3
    assert browse.count_conversations(conversations, "").first().total == 4
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            browse.list_conversations(conversations, talk, **bad)


def test_stats(talk):
    one = browse.conversation_stats(talk, "c1").first()
    assert one.message_count == 3 and one.participant_roles == ["user"]
    assert one.average_message_length == pytest.approx(2.0)
    assert browse.conversation_stats(talk, "nope").collect() == []


def test_timeline_is_range_sorted(talk, capsys):
    assert [r.msg_id for r in browse.timeline(talk, "c1").collect()] == ["1", "2", "3"]
    browse.timeline(talk).explain()
    assert "rangepartitioning(conv_id" in capsys.readouterr().out


def test_checksum_sees_order_and_content(messages):
    base = [("c", "1", "user", T(1), "a"), ("c", "2", "user", T(2), "b")]

    def checksum(rows):
        table = messages(rows).withColumn("hash", F.sha2("text", 256))
        return browse.conversation_checksum(table).first().checksum

    assert checksum(base) == checksum(base[::-1]) and len(checksum(base)) == 62
    assert checksum(base).startswith("2-") and checksum(base) != checksum(base + base[:1] * 2)
    swapped = [("c", "1", "user", T(2), "a"), ("c", "2", "user", T(1), "b")]
    assert len({checksum(base), checksum(swapped), checksum(base[:1])}) == 3


def test_dedupe_and_insert_ignore(spark):
    rows = spark.createDataFrame([("c", "1", 2, "late"), ("c", "1", 1, "early"), ("c", "2", 1, "x")],
                                 "conv_id string, msg_id string, n int, text string")
    assert {(r.msg_id, r.text) for r in loads.dedupe_by_key(rows, ["conv_id", "msg_id"], ["n"]).collect()} == {
        ("1", "early"), ("2", "x")}
    target = rows.where("msg_id = '2'")
    assert [r.text for r in loads.insert_ignore(target, rows, order=["n"]).collect()] == ["early"]
    assert loads.insert_ignore(rows, rows, order=["n"]).collect() == []


def test_upsert_changes_title_only(spark, conversations):
    incoming = spark.createDataFrame(
        [("c1", "one", "zz", 1), ("c1", "two", "yy", 2), ("c9", "nine", "o9", 3), ("c3", None, "zz", 4)],
        "conv_id string, title string, owner_id string, n int")
    out = {r.conv_id: (r.title, r.owner_id) for r in loads.upsert_title(conversations, incoming, ["n"]).collect()}
    assert out == {"c1": ("two", "o1"), "c2": (None, "o1"), "c3": (None, "o2"), "c4": ("Empty", "o1"),
                   "c9": ("nine", "o9")}


def test_cascade_and_orphans(spark, conversations, talk):
    gone = spark.createDataFrame([("c1",)], "conv_id string")
    left = loads.cascade_delete(gone, messages=talk, conversations=conversations)
    assert {r.conv_id for r in left["messages"].collect()} == {"c2", "c3"}
    assert {r.conv_id for r in left["conversations"].collect()} == {"c2", "c3", "c4"}
    assert {r.conv_id for r in filters.fk_orphans(talk, left["conversations"]).collect()} == {"c1"}
    tags = spark.createDataFrame([("c1", "1", "t"), ("c1", "9", "t")], "conv_id string, msg_id string, tag string")
    assert [r.msg_id for r in filters.message_orphans(tags, talk).collect()] == ["9"]


def test_validation_reasons(messages, conversations):
    rows = messages([("c1", "1", "robot", T(1), None), ("c1", "2", "tool", T(1), "ok"), ("c9", "1", "user", T(1), "ok"),
                     (None, "1", "user", None, "x")])
    valid, rejected = filters.split_valid(rows, conversations)
    assert [r.msg_id for r in valid.collect()] == ["2"]
    reasons = {(r.conv_id, tuple(r.reason)) for r in rejected.collect()}
    assert reasons == {("c1", ("role not allowed", "text is null")), ("c9", ("conversation is unknown",)),
                       (None, ("conv_id is null", "ts is null"))}


def test_search_filters(talk):
    def ids(given):
        return {(r.conv_id, r.msg_id) for r in filters.search_filters(talk, given).collect()}

    assert ids({"role": "user", "conv_id": "c2"}) == {("c2", "1")}
    assert ids({"date_to": "2024-01-01"}) == {("c1", "1")}
    assert ids({"role": None}) == set() and len(ids({"colour": "red"})) == 5 and len(ids(None)) == 5


def test_tags_and_ids(spark, talk):
    tags = spark.createDataFrame([("c1", "1", "a"), ("c1", "1", "b"), ("c2", "1", "a")],
                                 "conv_id string, msg_id string, tag string")
    assert {r.conv_id for r in filters.with_tags(talk, tags, ["a", "b"]).collect()} == {"c1", "c2"}
    assert {r.conv_id for r in filters.with_tags(talk, tags, ["a", "b"], "all").collect()} == {"c1"}
    ids = spark.createDataFrame([("c1/1",), ("c2/1",), ("c1/1",), ("c3/9",)], "message_id string")
    assert {(r.conv_id, r.msg_id) for r in filters.by_ids(talk, ids).collect()} == {("c1", "1"), ("c2", "1")}


def test_duplicates(talk):
    hashed = talk.withColumn("hash", F.lit("h"))
    row = browse.duplicate_messages(hashed).first()
    assert (row.copies, row.conversations, row.first_conv_id, row.first_msg_id) == (5, 3, "c1", "1")
