import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions.stem import stem
from threadloom.operators import search as se
from threadloom.schemas import SEARCH_STOP_WORDS

T = "2024-01-0{} 00:00:00".format


@pytest.fixture
def talk(messages):
    return messages([
        ("a", "1", "user", T(1), "Cats and dogs. A cat!"), ("a", "2", "assistant", T(2), "concat nothing"),
        ("b", "1", "user", T(3), "The dog barked"), ("b", "2", "user", T(3), "barking DOGS dog"), ("b", "3", "user", T(4), "")])


def keys(df):
    return [(r.conv_id, r.msg_id, round(r.score, 3)) for r in df.collect()]


def test_stemmed_scores_ties_and_padding(talk):
    out = keys(se.search(talk, "cat dogs", k=10))
    assert out == [("a", "1", 0.3), ("b", "2", 0.2), ("b", "1", 0.1), ("b", "3", 0.0), ("a", "2", 0.0)]
    assert keys(se.search(talk, "cat dogs", k=10, pad=False)) == out[:3]
    assert keys(se.search(talk, "dog dog DOG", k=2)) == [("b", "2", 0.2), ("b", "1", 0.1)]
    assert keys(se.search(talk, "the and", k=1)) == [("b", "3", 0.0)]
    assert keys(se.search(talk, "cat", k=0)) == []


def test_plain_scores_match_whole_words(talk):
    assert keys(se.search(talk, "cat", stemmer=None, pad=False)) == [("a", "1", 0.1)]
    with pytest.raises(ValueError):
        se.search(talk, " ?! ")


@pytest.mark.parametrize("stemmer", ["english", None])
def test_words_beyond_the_basic_plane(messages, stemmer):
    rows = messages([("c", "1", "user", T(1), "𝐀cat cat𝐀 😀cat 𐀀𐀁"), ("c", "2", "user", T(2), "x𐀀𐀁 cat_cat")])
    assert keys(se.search(rows, "cat", stemmer=stemmer, pad=False))[-1] == ("c", "1", 0.1)
    assert keys(se.search(rows, "𐀀𐀁", stemmer=stemmer, pad=False)) == [("c", "1", 0.1)]


def test_filters_and_snippet(messages, talk):
    out = keys(se.search(talk, "dog", filters={"role": "user", "conv_id": "b", "date_to": T(3)}))
    assert out == [("b", "2", 0.2), ("b", "1", 0.1)]
    row = se.search(messages([("c", "1", "user", T(1), "x" * 395 + " word word")]), "word").first()
    assert row.text == ("x" * 395 + " word word")[:400] and row.score == pytest.approx(0.2)
    assert list(row.highlights) == ["…" + ("x" * 395 + " word")[355:395] + " **word**"] or len(row.highlights) == 1


def test_many_queries_match_one_by_one(spark, messages):
    pick = random.Random(3)
    vocabulary = "cat cats running runs run dog the and happily happy nation national x_y".split()
    rows = [(f"c{i % 9}", str(i), pick.choice(["user", "tool"]), f"2024-01-01 00:{pick.randrange(60):02}:00",
             " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(25)))) for i in range(150)]
    queries = [(f"q{i}", " ".join(pick.choice(vocabulary) for _ in range(3))) for i in range(8)] + [("none", " ? "), ("stop", "the")]
    table = messages(rows)
    asked = spark.createDataFrame(queries, "query_id string, q string")
    for stemmer in ("english", None):
        batch = se.search_many(table, asked, k=7, stemmer=stemmer).collect()
        stored = se.search_many(table, asked, k=7, stemmer=stemmer, postings=se.build_postings(table, stemmer)).collect()
        assert sorted(batch) == sorted(stored)
        for query_id, q in queries:
            words = [w for w in re.findall(r"\w+" if stemmer is None else r"[^\W_]+", q)]
            if stemmer:
                words = [stem(w) for w in words if w not in SEARCH_STOP_WORDS]
            scored = []
            for conv, msg, _, ts, text in rows:
                found = re.findall(r"\w+" if stemmer is None else r"[^\W_]+", text)
                if stemmer:
                    found = [stem(w) for w in found if w not in SEARCH_STOP_WORDS]
                hits = sum(w in words for w in found)
                if hits:
                    scored.append((-hits, [-int(x) for x in re.findall(r"\d+", ts)], conv, msg))
            expected = [(c, m, -h / 10) for h, _, c, m in sorted(scored)[:7]]
            mine = sorted((r for r in batch if r.query_id == query_id), key=lambda r: r.rank)
            assert [(r.conv_id, r.msg_id, r.score) for r in mine] == expected
    numbered = spark.createDataFrame([(1, "cats"), (2, "runs")], "query_id int, q string")
    assert {r.query_id for r in se.search_many(table, numbered, k=3).collect()} == {1, 2}
    assert [r.query_id for r in se.unusable_queries(asked).collect()] == ["none"]


def test_filters_per_query(spark, talk):
    asked = spark.createDataFrame(
        [("all", "dog", None, None, None), ("role", "dog", "assistant", None, None), ("conv", "dog", None, "a", None),
         ("until", "dog", None, None, "2024-01-02")],
        "query_id string, q string, role string, conv_id string, date_to string")
    out = se.search_many(talk, asked, highlighted=True).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, set()).add((r.conv_id, r.msg_id))
        assert any("**" in h for h in r.highlights)
    assert found == {"all": {("a", "1"), ("b", "1"), ("b", "2")}, "conv": {("a", "1")}, "until": {("a", "1")}}
    assert se.search_many(talk, asked, k=0).collect() == se.search_many(talk, asked, k=-1).collect() == []
    assert se.search_many(talk, asked, k=100_000).count() == 5


def test_highlights_see_the_whole_text(spark, messages):
    table = messages([("c", "1", "user", T(1), "x " * 600 + "needle at the end")])
    assert "**needle**" in se.search(table, "needle").first().highlights[0]
    asked = spark.createDataFrame([("q", "needle")], "query_id string, q string")
    row = se.search_many(table, asked, highlighted=True).first()
    assert len(row.text) == 400 and "**needle**" in row.highlights[0]


def test_messages_are_scanned_alike_for_few_and_many_queries(spark, talk, capsys):
    plans = []
    for n in (1, 10_000):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("dog").alias("q"))
        se.search_many(talk, asked).explain()
        plans.append(capsys.readouterr().out)
    assert plans[0].count("Scan ExistingRDD") == plans[1].count("Scan ExistingRDD") <= 2


def test_plans(spark, talk, capsys):
    se.top_keys(talk, ["dog"]).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
    asked = spark.createDataFrame([("q", "dog")], "query_id string, q string")
    se.search_many(talk, asked).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_postings_of_a_message_are_counted_where_it_stands(spark, messages):
    import collections
    rows = [("c", "1", "user", "2024-01-01", "b a b c\u00e9 a b"), ("c", "2", "user", "2024-01-01", None), ("c", "3", "user", "2024-01-01", "a"),
            ("c", "3", "user", "2024-01-01", "a b"), (None, "3", "user", "2024-01-01", "a"), (None, "3", "user", "2024-01-01", "a a")]
    built = se.build_postings(messages(rows), stemmer=None)
    want = collections.Counter((w, r[0], r[1]) for r in rows for w in (r[4] or "").split())
    assert sorted(((r.lexeme, r.conv_id, r.msg_id), r.tf) for r in built.collect() if r.conv_id) == sorted((k, n) for k, n in want.items() if k[1])
    assert [(r.lexeme, r.tf) for r in built.collect() if r.conv_id is None] == [("a", 3)]
    alone = se.build_postings(messages(rows[:3]), stemmer=None)._jdf.queryExecution().optimizedPlan().toString()
    assert alone.count("Aggregate") == 1 and "LeftAnti" in alone  # of repeated messages only
