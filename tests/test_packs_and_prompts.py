import random
import textwrap

import pytest
from pyspark.sql import functions as F

from threadloom.functions.lengths import bpe_tokens
from threadloom.operators import packs, prompts

T = "2024-01-0{} 10:30:59".format


def requests(spark, *pairs):
    return spark.createDataFrame(list(pairs), "pack_id string, message_id string")


def by_pack(df):
    return {r.pack_id: (r.text_block, r.token_count, r.message_count) for r in df.collect()}


def test_pairs_are_exact_and_time_ordered(spark, messages):
    table = messages([("c1", "m1", "user", T(3), "a"), ("c1", "m2", "user", T(1), "b"), ("c2", "m2", "tool", T(2), "c")])
    asked = requests(spark, ("p", "c1/m1"), ("p", "c2/m2"), ("p", "c1/m1"), ("q", "c9/m9"))
    out = by_pack(packs.context_pack(table, asked))
    text = "[tool • 2024-01-02 10:30] c\n\n[user • 2024-01-03 10:30] a"
    assert out["p"] == (text, 2 * 7, 2)
    assert out["q"] == ("", 0, 0)


def test_stops_at_the_first_overflow(spark, messages):
    table = messages([("c", "1", "user", T(1), "x" * 16), ("c", "2", "user", T(2), "y" * 400), ("c", "3", "user", T(3), "z")])
    asked = requests(spark, *[("p", f"c/{i}") for i in (3, 2, 1)])
    text, tokens, count = by_pack(packs.context_pack(table, asked, max_tokens=50))["p"]
    assert count == 1 and tokens == 11 and "z" not in text
    assert text.endswith("x\n\n-- Truncated at 50 tokens --")
    assert by_pack(packs.context_pack(table, asked, max_tokens=5))["p"] == ("\n\n-- Truncated at 5 tokens --", 0, 0)
    own = asked.withColumn("max_tokens", F.lit(50))
    assert by_pack(packs.context_pack(table, own))["p"] == (text, tokens, count)


def test_parameters(spark, messages):
    table = messages([("c", "1", "user", T(1), "x")])
    for bad in (0, 16385):
        with pytest.raises(ValueError):
            packs.context_pack(table, requests(spark, ("p", "c/1")), max_tokens=bad)
    with pytest.raises(Exception, match="conv/msg"):
        packs.context_pack(table, requests(spark, ("p", "nope"))).collect()


def test_bad_budgets_are_reported(spark, messages):
    table = messages([("c", "1", "user", T(1), "x" * 40), ("c", "2", "user", T(2), "y")])
    rows = [("none", "c/1", None), ("none", "c/2", 50), ("two", "c/1", 50), ("two", "c/2", 60), ("low", "c/1", -5),
            ("zero", "c/1", 0), ("high", "c/1", 16385), ("good", "c/1", 16384)]
    asked = spark.createDataFrame(rows, "pack_id string, message_id string, max_tokens int")
    reasons = {r.pack_id: r.reason for r in packs.pack_rejects(asked).collect()}
    assert reasons == {"none": "budget is missing", "two": "budgets of the pack differ",
                       **dict.fromkeys(["low", "zero", "high"], "budget is not between 1 and 16384")}
    assert [r.pack_id for r in packs.context_pack(table, asked).collect()] == ["good"]
    assert "high" in by_pack(packs.context_pack(table, asked, largest=1 << 20))


def test_byte_pair_lengths(spark, messages):
    public = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = messages([("c", "1", "user", T(1), "Hello wörld, hello"), ("c", "2", "user", T(2), "more words here")])
    asked = requests(spark, ("p", "c/1"), ("p", "c/2"))
    text, tokens, count = by_pack(packs.context_pack(table, asked, token_length=bpe_tokens(path, public.PATTERN)))["p"]
    assert count == 2 and tokens == sum(len(encoding.encode_ordinary(x)) for x in text.split("\n\n"))


def test_random_packs_match_the_definition(spark, messages):
    pick = random.Random(11)
    rows = [("c", str(i), "user", f"2024-01-01 00:{pick.randrange(60):02}:00", "w" * pick.randrange(80)) for i in range(120)]
    asked = [(f"p{pick.randrange(4)}", f"c/{pick.randrange(130)}") for _ in range(300)]
    out = by_pack(packs.context_pack(messages(rows), requests(spark, *asked), max_tokens=400))
    for pack in {p for p, _ in asked}:
        wanted = {m.split("/")[1] for p, m in asked if p == pack}
        lines = [f"[user • {r[3][:16]}] {r[4]}" for r in sorted(rows, key=lambda r: (r[3], r[1])) if r[1] in wanted]
        kept, used = [], 0
        for line in lines:
            size = -(-len(line) // 4)
            if used + size > 400:
                break
            kept.append(line)
            used += size
        text = "\n\n".join(kept) + ("\n\n-- Truncated at 400 tokens --" if len(kept) < len(lines) else "")
        assert out[pack] == (text, used, len(kept))


def test_prompts(spark, messages):
    long = "apple " + "pie-crust " * 60
    table = messages([("c", "1", "user", T(1), long), ("c", "2", None, T(2), "apple apple"), ("c", "3", "user", T(3), "pear")])
    queries = spark.createDataFrame([("q1", "apple"), ("q2", "zzz")], "query_id string, q string")
    history = spark.createDataFrame([("q1", 2, "assistant", "hi"), ("q1", 1, "user", "hello")],
                                    "query_id string, turn int, role string, content string")
    rows = prompts.build_prompts(table, queries, "  Be kind. ", history=history).orderBy("query_id", "section", "turn").collect()
    first = [(r.role, r.content) for r in rows if r.query_id == "q1"]
    summary = textwrap.shorten(long[:400], width=220, placeholder="…")
    memory = ("Relevant memory:\n- [2024-01-02 10:30:59 | unknown | score 0.200] apple apple\n"
              f"- [2024-01-01 10:30:59 | user | score 0.100] {summary}")
    assert first == [("system", "Be kind."), ("system", memory), ("user", "hello"), ("assistant", "hi"), ("user", "apple")]
    assert [r.role for r in rows if r.query_id == "q2"] == ["system", "user"]
    none = prompts.build_prompts(table, queries, "x", memory_results=0).collect()
    assert {r.section for r in none} == {1, 4}
