"""Line-first cleaning with column functions only.

Every line is judged on its own by three rules; failing lines are removed and a
document that loses too much of its text is rejected. A document also fails
before that when it is too short or repeats itself (``base_failed``).

Line rules, in the order in which they are tried:

``navigation``   a menu: at least three separators standing alone and few words
                 between them, or one or two words without closing mark
``punctuation``  too many symbols, runs of marks after many words, or a long line
                 without any sentence mark
``boilerplate``  a stock phrase of web pages in a short line, or a line whose words
                 mostly repeat the word before

Defined cases: a null text counts as empty; a text without words has no lines to
judge and fails for its length; repeated rows are judged each on its own; a very long text
is one row like any other; an empty table gives an empty result; every
input column is carried along, new columns replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.rows import boxed, settled, text_of, unboxed

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines",
         "lost_share", "clean_text", "kept"]

# The stock phrases and marks that the line rules look for.
SEPARATOR = r"(?:^|[\x20\x09])(?:[|>»›•·/]+)"
SENTENCE_MARK = r"[.!?…:;,。！？、،؟।]"
MARK_RUN = r"[!?]{2,}|[.]{4,}|[#*$%&~^=_]{2,}"
CLOSING_MARK = r"""[.!?…:;。！？।]["'”’»)\]]*\z"""
STOCK_PHRASE = (
    r"(?i)cookie policy|uses cookies|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|"
    r"javascript (?:is )?(?:disabled|required)|enable javascript|subscribe (?:to|now)|sign up (?:for|now)|"
    r"log in to|click here|read more|share (?:this|on)|follow us|powered by|back to top|skip to (?:main )?content"
)


def line_reason(line: Column, words: Column, max_symbol_share: float = 0.1, max_mark_runs: float = 0.3,
                long_line: int = 12, max_stutter: float = 0.4) -> Column:
    """Name of the rule that a line fails, else null. Lines without words pass."""
    n = F.size(words)
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    marks = F.regexp_count(line, F.lit(MARK_RUN))
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    stutter = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    tail = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when((separators >= 3) & (n <= 5 * (separators + 1)), F.lit("navigation"))
        .when((n <= 2) & ~tail.rlike(CLOSING_MARK), F.lit("navigation"))
        .when(symbols > max_symbol_share * F.char_length(line), F.lit("punctuation"))
        .when((n >= 4) & (marks > max_mark_runs * n), F.lit("punctuation"))
        .when((n >= long_line) & ~line.rlike(SENTENCE_MARK), F.lit("punctuation"))
        .when((n <= 40) & line.rlike(STOCK_PHRASE), F.lit("boilerplate"))
        .when((n >= 8) & (stutter > max_stutter * n), F.lit("boilerplate"))
    )


def quality_rules(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with the counts, the line verdicts, ``clean_text`` and ``kept``.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lines (array of struct line, n_words, reason), lost_share,
    clean_text, kept. ``lost_share`` is the share of the characters of lines with
    words that were removed. No shuffle: every row is judged where it is read.
    """
    return unboxed(_judged(docs, **limits), docs.columns, ADDED)


def _judged(docs: DataFrame, max_lost: float = 0.3, min_words: int = 10, max_repeat_percent: int = 20,
            **line_limits: float) -> DataFrame:
    """The rows as one column each, beside the added columns."""
    split = F.transform(F.split(text_of(), "\n", -1), lambda l: F.struct(
        l.alias("line"), F.regexp_extract_all(l, F.lit(WORD), F.lit(0)).alias("words")))
    judged = (
        boxed(docs, text=text_of(), split=split)
        .withColumn("words", F.flatten(F.col("split.words")))
        .withColumn("lines", F.transform("split", lambda x: F.struct(
            x.line.alias("line"), F.size(x.words).alias("n_words"),
            line_reason(x.line, x.words, **line_limits).alias("reason"))))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOL)).cast("long"))
        .withColumn("worded", F.filter("split", lambda x: F.size(x.words) > 0)["line"])
        .withColumn("n_dup_lines", (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"))
        .drop("text", "split", "worded")
    )
    judged = _with_repeats(judged)
    kept_lines = F.filter("lines", lambda x: x.reason.isNull())
    chars = lambda lines: F.aggregate(
        lines, F.lit(0), lambda a, x: a + F.when(x.n_words > 0, F.char_length(x.line)).otherwise(0))
    total = chars(F.col("lines"))
    judged = (
        judged.withColumn("base_failed", (F.col("n_words") < min_words)
                          | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
        .withColumn("all_chars", total).withColumn("left_chars", chars(kept_lines))
        .withColumn("lost_share", F.when(F.col("all_chars") > 0, 1 - F.col("left_chars") / F.col("all_chars")).otherwise(0.0))
        .withColumn("clean_text", F.array_join(kept_lines["line"], "\n"))
        .withColumn("kept", settled(~F.col("base_failed") & (F.col("lost_share") <= max_lost)))
    )
    return judged


def _with_repeats(judged: DataFrame) -> DataFrame:
    """n_repeat_words: words that lie in a five-word window standing twice or more in the text.

    Windows are compared by a 64-bit hash of their words. The positions of repeated
    windows come from sorting (hash, position); most texts have none and skip the sort.
    """
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    zero = F.lit(0)
    return (
        judged.withColumn("grams", F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), zero)), lambda w, i: window(i)))
        .withColumn("ordered", F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
        .withColumn("twice", F.sort_array(F.filter(
            F.transform("ordered", lambda s, k: F.when(
                (s.g == F.get("ordered", k - 1).g) | (s.g == F.get("ordered", k + 1).g), s.i)),
            lambda p: p.isNotNull())))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            F.transform("twice", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x), zero).cast("long"))
    )


def kept_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, their failing lines removed, with the columns of ``docs``."""
    judged = _judged(docs, **limits).where("kept")
    changes = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[changes.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
