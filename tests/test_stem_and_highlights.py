import random
import re

import pytest
from conftest import column
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadloom.functions import stem as sm
from threadloom.functions.highlights import highlights

# Published sample pairs of the English stemmer.
PAIRS = dict(p.split(":") for p in """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist
consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist
consists:consist consolation:consol consolations:consol consolatory:consolatori console:consol
consoled:consol consoles:consol consolidate:consolid consolidated:consolid consoling:consol
conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir
constable:constabl constables:constabl constance:constanc constancy:constanc constant:constant
knack:knack knackeries:knackeri knacks:knack knag:knag knave:knave knaves:knave knavish:knavish
kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel
knees:knee knell:knell knelt:knelt knew:knew knick:knick knif:knif knife:knife knight:knight
knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit knives:knive knob:knob
skies:sky dying:die news:news proceed:proceed succeeding:succeed generate:generat
generously:generous cries:cri ties:tie gaps:gap gas:gas hoping:hope hopping:hop
""".split())


def test_published_pairs():
    assert {w: sm.stem(w) for w in PAIRS} == PAIRS


@settings(max_examples=2000, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=8),
       st.sampled_from(["", "s", "ed", "ing", "ational", "biliti", "bilities", "ization", "ousness", "ies",
                        "ied", "ying", "eedly", "ement", "icate", "alize", "fulness", "ator", "ly", "y", "ive"]))
def test_stem_shares_all_but_its_last_two_letters(base, ending):
    word = base + ending
    stem = sm.stem(word)
    assert word.startswith(stem[:max(1, len(stem) - 2)])


def test_lexemes_and_counts_agree(spark):
    pick = random.Random(5)
    words = list(PAIRS) + ["the", "The", "don't", "x_y", "Über", "42"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(40))) for _ in range(200)] + [None, ""]
    found = column(spark, texts, sm.lexemes)
    for text, lexemes in zip(texts, found):
        plain = re.findall(r"[^\W_]+", (text or "").lower())
        assert lexemes == [sm.stem(w) for w in plain if w not in sm.SEARCH_STOP_WORDS]
    wanted = sm.query_lexemes(["consists", "knitting", "the", "dying", "x_y", "42"])
    counts = column(spark, texts, lambda c: sm.count_matches(c, wanted))
    assert counts == [sum(x in wanted for x in lexemes) for lexemes in found]
    assert column(spark, ["the"], lambda c: sm.count_matches(c, [])) == [0]


def excerpts(spark, cases, window=40, limit=3):
    """Highlights of (text, terms) pairs, in order."""
    rows = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(cases)], "i int, text string, terms array<string>")
    return [r.out for r in rows.select("i", highlights(F.col("text"), F.col("terms"), window, limit).alias("out")).orderBy("i").collect()]


def test_highlight_examples(spark):
    text = "Rivers rise in spring; the River Tay rises twice."
    assert excerpts(spark, [(text, ["river"])], window=4) == [["**River**s ri…", "…the **River** Tay…"]]
    assert excerpts(spark, [(text, ["river"])], window=30) == [["**River**s rise in spring; the River Ta…"]]
    assert excerpts(spark, [(text, ["twice", "SPRING"])], window=0) == [["…**spring**…", "…**twice**…"]]
    assert excerpts(spark, [(text, ["r"])], window=0, limit=2) == [["**R**…", "…**r**…"]]
    assert excerpts(spark, [(text, []), (text, [""]), ("", ["river"]), (None, ["river"]), (text, ["absent"])]) == [[]] * 5


def test_highlights_mark_the_hit_itself(spark):
    """Not an equal text that stands before it in the window."""
    assert excerpts(spark, [("cat cat cat", ["cat"])], window=4, limit=1) == [["**cat** cat…"]]
    assert excerpts(spark, [("xcat a cat", ["a cat", "zz"])], window=9) == [["xcat **a cat**"]]
    assert excerpts(spark, [("(a.b)*? - (A.B)*? axb", ["(a.b)*?"]), ("q\\Ez", ["\\E"])], window=1) == [["**(a.b)*?** …", "… **(A.B)*?** …"], ["q**\\E**z"]]


def plain_excerpts(text, terms, window, limit):
    """Every place of a hit, then those that keep clear of the excerpt before."""
    places, at = [], 0
    while at < len(text):
        size = next((len(t) for t in terms if t and text[at:at + len(t)].lower() == t.lower()), 0)
        if size:
            places.append((at, at + size))
        at += size or 1
    out, clear = [], 0
    for first, end in places:
        if max(first - window, 0) >= clear and len(out) < limit:
            clear = min(end + window, len(text))
            out.append("…" * (first > window) + text[max(first - window, 0):first] + "**" + text[first:end] + "**"
                       + text[end:clear] + "…" * (clear < len(text)))
    return out


@pytest.mark.parametrize("window, limit", [(0, 4), (1, 3), (3, 2), (6, 1)])
def test_highlights_by_places(spark, window, limit):
    pick = random.Random(window)
    cases = [("".join(pick.choice("abé AB\U0001f600.") for _ in range(pick.randrange(60))),
              ["".join(pick.choice("abé.") for _ in range(pick.randrange(3))) for _ in range(pick.randrange(4))]) for _ in range(300)]
    assert excerpts(spark, cases, window, limit) == [plain_excerpts(t, q, window, limit) for t, q in cases]


def test_highlights_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([("a cat", ["cat"])], "text string, terms array<string>")
    plan = rows.select(highlights(F.col("text"), F.col("terms")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["a cat concat", None])
def test_highlight_column(spark, text):
    out, = column(spark, [text], lambda c: highlights(c, F.array(F.lit("cat"))))
    assert list(out) == (["a **cat** concat"] if text else [])


def test_own_stemmer(spark):
    halves = lambda w: w[: len(w) // 2]
    out, = column(spark, ["Reading the books"], lambda c: sm.lexemes(c, halves))
    assert out == ["rea", "bo"] and sm.query_lexemes(["reading", "the"], halves) == ["rea"]
    assert column(spark, ["reader books"], lambda c: sm.count_matches(c, ["rea", "x"], halves)) == [1]
    assert sm.chosen_stemmer(None) is None and sm.chosen_stemmer("english") is sm.known_stem
    with pytest.raises(ValueError):
        sm.chosen_stemmer("klingon")
