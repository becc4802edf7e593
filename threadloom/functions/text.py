"""Text columns: whitespace, search terms, topic tokens, previews.

The classes below spell out the Unicode meaning of white space, digits and word
characters, because Java's shorthand classes are ASCII-only by default and its
Unicode mode differs on combining marks and information separators.
"""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from threadloom.schemas import TOPIC_STOP_WORDS

SPACE_SET = r"\s\x0b\x1c-\x1f\x85\p{Z}"
# Every Unicode white-space character and the four information separators.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) \
    + "\u2028\u2029\u202f\u205f\u3000"
# U+10000 is a letter already; naming it makes look-behinds step over whole
# characters beyond the basic plane instead of half of one.
WORD = "[\\p{L}\\p{N}_\U00010000]"
LETTER_OR_DIGIT = "[\\p{L}\\p{N}\U00010000]"


def strip_space(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def whole_words(words: list[str]) -> str:
    """Pattern for any of the given lower-case words standing alone.

    The cheap look at the first letter comes first: it rejects most positions
    before the look-behind runs.
    """
    firsts = "".join(sorted({w[0] for w in words}))
    return f"(?=[{firsts}])(?<!{WORD})(?:{'|'.join(sorted(set(words)))})(?!{WORD})"


def safe_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def query_terms(query: str | None) -> list[str]:
    """Lower-cased words of a query, in order, duplicates kept."""
    return [word.lower() for word in re.findall(r"\w+", query or "")]


def word_counts(words: Column) -> Column:
    """(word, n) of the distinct words of an array, null if it has none: sorted once, then cut where the word changes."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda b, j: F.coalesce(F.get(b, j + 1), F.size(s))
        return F.transform(F.array(starts), lambda b: F.transform(
            b, lambda at, j: F.struct(F.get(s, at).alias("word"), (ends(b, j) - at).cast("bigint").alias("n"))))[0]

    # The one-element arrays bind the sorted words and the starts, so each is computed once. Without a word: null.
    return F.get(F.transform(F.filter(F.array(F.array_sort(words)), lambda s: F.size(s) > 0), runs), F.lit(0))


def search_terms(col: Column) -> Column:
    """Column form of :func:`query_terms`."""
    words = F.regexp_extract_all(safe_text(col), F.lit(f"{WORD}+"), F.lit(0))
    return F.transform(words, F.lower)


def topic_words(col: Column) -> Column:
    """ASCII words of three or more characters, lower-cased, one per position.

    The whole text is lowered before matching. U+0130 and U+212A are the only
    other characters whose lower case holds an ASCII letter; they are blanked
    first so that matching still sees them as separators.
    """
    text = safe_text(col)
    for letter in ("\u0130", "\u212a"):
        text = F.replace(text, F.lit(letter), F.lit(" "))
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9']{2,}"), F.lit(0))


def topic_tokens(col: Column) -> Column:
    """Distinct topic words of one message, stop words removed."""
    return F.array_except(topic_words(col), word_list(TOPIC_STOP_WORDS))


def word_list(words: list[str]) -> Column:
    """Constant array of blank-free words, folded once by the optimiser."""
    return F.split(F.lit(" ".join(words)), " ")


def is_topic(column: str) -> Column:
    stop = ", ".join(f"'{w}'" for w in TOPIC_STOP_WORDS)
    return F.expr(f"{column} NOT IN ({stop})")


def trim_text(col: Column, limit: int = 280) -> Column:
    clean = strip_space(safe_text(col))
    cut = F.rtrim(F.left(clean, F.lit(limit)), F.lit(BLANKS))
    return F.when(F.length(clean) > limit, F.concat(cut, F.lit("…"))).otherwise(clean)


@F.pandas_udf(StringType())
def shorten(texts: pd.Series) -> pd.Series:
    """One-line preview of at most 220 characters; meant for the few hits of a query."""
    return texts.map(lambda t: textwrap.shorten(t or "", width=220, placeholder="…"))


def split_message_id(col: Column) -> tuple[Column, Column]:
    """``conv/msg`` cut at its first slash; an id without one fails the job."""
    checked = F.when(col.contains("/"), col).otherwise(
        F.raise_error(F.concat(F.lit("message id must look like conv/msg: "), F.coalesce(col, F.lit("NULL")))))
    parts = F.split(checked, "/", 2)
    return parts[0], parts[1]
