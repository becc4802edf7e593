import random
import re
import string
import textwrap

import pytest
from conftest import column
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.redact import redact, redact_table
from threadloom.functions.times import iso_timestamp, normalise_iso
from threadloom.schemas import TOPIC_STOP_WORDS

ODD = "aZ09_'-.@ \t\n\x0b\x1c\x85\xa0 　éßçİK²½٣́‿漢字«»…:/#~$%[]\\"


def noise(count, alphabet=ODD + string.ascii_letters, size=60, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randrange(size))) for _ in range(count)]


def test_strip_and_trim_match_python(spark):
    texts = noise(400) + ["", " x ", "　a\x1c", "w" * 279 + " " * 50 + "tail", "a " * 300]
    assert column(spark, texts, tx.strip_space) == [t.strip() for t in texts]

    def trimmed(t):
        t = t.strip()
        return t if len(t) <= 280 else t[:280].rstrip() + "…"

    assert column(spark, texts, tx.trim_text) == [trimmed(t) for t in texts]


def test_trim_keeps_at_most_281_characters(spark):
    long = "\u3000" + "ab cd" * 100
    out, blank = column(spark, [long, "y" * 279 + " " * 40 + "z"], tx.trim_text)
    assert out == long.strip()[:280] + "…" and blank == "y" * 279 + "…"


def test_search_terms(spark):
    texts = ["Hello, World!", "", "   ", None] + [t for t in noise(300) if "İ" not in t]
    expected = [[w.lower() for w in re.findall(r"\w+", t or "")] for t in texts]
    assert column(spark, texts, tx.search_terms) == expected
    assert [tx.query_terms(t) for t in texts] == expected


def test_topic_tokens_match_python(spark):
    texts = noise(400, string.ascii_letters + "09' éİK-") + ["émentle the The THE don't x1 22 a1b"]

    def expected(t):
        words = {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9']+", t)}
        return {w for w in words if len(w) > 2 and w not in TOPIC_STOP_WORDS}

    assert [set(x) for x in column(spark, texts, tx.topic_tokens)] == [expected(t) for t in texts]


def test_shorten_matches_textwrap(spark):
    texts = ["word " * 80, "x" * 400, "a well-known " * 30, "short", "", "  spaced \n out  "]
    assert column(spark, texts, tx.shorten) == [textwrap.shorten(t, width=220, placeholder="…") for t in texts]
    assert column(spark, ["x" * 400], tx.shorten) == ["…"]


def test_split_message_id(spark):
    assert column(spark, ["c/m/1"], lambda c: F.concat_ws("|", *tx.split_message_id(c))) == ["c|m/1"]
    with pytest.raises(Exception, match="conv/msg"):
        column(spark, ["no slash"], lambda c: tx.split_message_id(c)[0])


def test_redaction_literals(spark):
    cases = {
        "mail k.moe@post.test, call 040.555.0199; host 10.20.30.40 (http://post.test/a?b=1)":
            "mail «EMAIL» call «PHONE»; host «IP» («URL»",
        "https://192.168.0.1/x": "https://«IP»/x",
        "https://u@h.com/p": "«EMAIL»",
        "http://a.b/c#frag~z": "«URL»#frag~z",
        "é555-123-4567": "é555-123-4567",
        "a\xa0bob@x.com\xa0b": "a\xa0«EMAIL»\xa0b",
        "@@ a@ @b a@b": "@@ a@ @b «EMAIL»",
        "𝐀555-123-4567 😀555-123-4567 𝐀1.2.3.4": "𝐀555-123-4567 😀«PHONE» 𝐀1.2.3.4",
    }
    assert column(spark, list(cases), redact) == list(cases.values())
    assert column(spark, ["bob@example.com", None], lambda c: redact(c, False)) == ["bob@example.com", ""]
    assert column(spark, [None], redact) == [""]


def test_redaction_matches_python(spark):
    texts = noise(600, "a1.@-: /\xa0\x1cé²٣_555http://%#𝐀😀", 80, 3)
    texts += [f"{a}555{b}123{c}4567{d} 10.0.0.{a}1 http://x{b}y{d}" for a in "_ é" for b in "-. " for c in "-." for d in "²x "]

    def expected(t):
        t = re.sub(r"\S+@\S+", "«EMAIL»", t)
        t = re.sub(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "«PHONE»", t)
        t = re.sub(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "«IP»", t)
        return re.sub(r"https?://[a-z!$-_]+", "«URL»", t)

    assert column(spark, texts, redact) == [expected(t) for t in texts]


def test_redaction_of_very_long_runs(spark):
    url = "https://x/" + "a" * 200_000
    out = column(spark, [url, "b" * 300_000, "1" * 300_000 + "@", " " * 300_000], redact)
    assert out[0] == "«URL»" and len(out[1]) == 300_000 and len(out[2]) == 300_001


def test_redact_table_counts_hits(spark):
    table = spark.createDataFrame([("a@b c@d 1.2.3.4",), ("plain",)], "text string")
    rows = {r.text: r for r in redact_table(table).collect()}
    hit = rows["«EMAIL» «EMAIL» «IP»"]
    assert (hit.email_hits, hit.phone_hits, hit.ip_hits, hit.url_hits) == (2, 0, 1, 0)
    assert rows["plain"].email_hits == 0
    assert {r.text for r in redact_table(table, enable_pii=False).collect()} == {"a@b c@d 1.2.3.4", "plain"}


def test_iso_timestamps(spark):
    assert normalise_iso(" 2024-01-01T00:00:00Z ") == "2024-01-01T00:00:00+00:00"
    assert normalise_iso("  ") is None and normalise_iso(None) is None
    with pytest.raises(ValueError):
        normalise_iso("yesterday")
    out = column(spark, ["2024-01-01T00:00:00Z", "", None], iso_timestamp)
    assert str(out[0]) == "2024-01-01 00:00:00" and out[1:] == [None, None]
    with pytest.raises(Exception, match="ISO"):
        column(spark, ["yesterday"], iso_timestamp)
