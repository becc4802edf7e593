import pytest

from threadloom.operators import topics as tp

T = "2024-01-0{} 00:00:00".format
SAMPLE = [
    ("c1", "m1", "user", T(1), "Quantum computing uses qubits and entanglement"),
    ("c1", "m2", "assistant", T(2), "Qubits enable quantum algorithms"),
    ("c2", "m3", "user", T(3), "Gardening tips for spring"),
    ("c2", "m4", "assistant", T(4), "Spring gardening needs water"),
]


def test_counts_weight_and_first_anchor(messages):
    found = {r.label: r for r in tp.topic_map(messages(SAMPLE)).collect()}
    assert {"quantum", "qubits", "spring", "gardening"} == set(found)
    assert found["quantum"].occurrences == 2 and found["quantum"].weight == pytest.approx(0.5)
    assert [a.msg_id for a in found["quantum"].anchors] == ["m1", "m2"]


def test_limits(messages):
    rows = [("c", f"m{i}", "user", T(i + 1), "alpha beta" if i < 2 else "alpha") for i in range(3)]
    out = tp.topic_map(messages(rows), limit=1, sample_limit=1).collect()
    assert [(r.label, len(r.anchors)) for r in out] == [("alpha", 1)]


@pytest.mark.parametrize("name", ["limit", "min_occurrences", "sample_limit"])
def test_parameters_are_checked(messages, name):
    with pytest.raises(ValueError):
        tp.topic_map(messages(SAMPLE), **{name: 0})
    with pytest.raises(ValueError):
        tp.extract_topics(messages(SAMPLE), **{name: 0})


def test_stop_words_and_empty_windows(messages):
    rows = messages([("c", "1", "user", T(1), "from the harbour to the"), ("c", "2", "user", T(2), "harbour lights")])
    assert [r.label for r in tp.topic_map(rows).collect()] == ["harbour"]
    assert tp.topic_map(messages([("c", "1", "user", T(1), "the and of")])).collect() == []
    assert tp.topic_map(messages([])).collect() == []
    assert tp.topic_map(rows, min_occurrences=3).collect() == []


def test_ties_are_broken_by_label_and_conversation(messages):
    rows = messages([("b", "1", "user", T(1), "zebra apple"), ("a", "1", "user", T(1), "apple zebra")])
    out = tp.topic_map(rows).collect()
    assert [r.label for r in out] == ["apple", "zebra"]
    assert [a.conv_id for a in out[0].anchors] == ["a", "b"]


def test_cap_keeps_the_earliest_messages(messages):
    rows = [("c", f"{i:03}", "user", f"2024-01-01 00:{i:02}:00", "early word" if i < 10 else "late word") for i in range(20)]
    kept = tp.topic_window(messages(rows), max_messages=10)
    assert {r.msg_id for r in kept.collect()} == {f"{i:03}" for i in range(10)}
    assert {r.label for r in tp.topic_map(messages(rows), max_messages=10).collect()} == {"early", "word"}
    with pytest.raises(ValueError):
        tp.topic_window(messages(rows), max_messages=0)
    assert tp.topic_window(messages(rows)).count() == 20 and tp.topic_window(messages(rows), max_messages=3).count() == 3


def test_window_bounds_and_names(messages):
    rows = messages(SAMPLE)
    inclusive = tp.topic_window_summary(rows, "2024-01-01T00:00:00Z", "2024-01-02").first()
    assert (inclusive.total_messages, inclusive.distinct_conversations) == (2, 1)
    empty = tp.topic_window_summary(rows, "2025-01-01", "2025-02-01").first()
    assert empty.total_messages == 0
    assert (str(empty.window_start), str(empty.window_end)) == ("2025-01-01 00:00:00", "2025-02-01 00:00:00")
    a = tp.topic_map(rows, date_from="2024-01-03").collect()
    assert a == tp.topic_map(rows, **{"from": "2024-01-03"}).collect() and a[0].label == "gardening"


def test_topics_per_period(messages):
    rows = messages(SAMPLE + [("c2", "m5", "user", T(4), "water water spring")])
    out = tp.timeline_topics(rows).collect()
    assert {(str(r.period)[:10], r.label, r.occurrences) for r in out} == {
        ("2024-01-04", "spring", 2), ("2024-01-04", "water", 2)}


def test_anchors_are_cut_before_the_shuffle(messages, capsys):
    scope = messages(SAMPLE)
    tp.topic_anchors(scope, tp.top_topics(scope)).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") >= 2 and "BroadcastNestedLoopJoin" not in plan


def test_cap_reaches_the_scan(spark, messages, tmp_path, capsys):
    messages([("c", str(i), "user", f"2024-01-01 00:{i:02}:00", "x") for i in range(20)]).write.parquet(str(tmp_path / "m"))
    capped = tp.topic_window(spark.read.parquet(str(tmp_path / "m")), max_messages=10)
    capped.explain()
    assert "LessThanOrEqual(ts,2024-01-01" in capsys.readouterr().out and capped.count() == 10
