"""The words of an archive and their stems, as a table.

Words are stemmed once each, not once per place: texts are split in the JVM, equal words
collapse in the map tasks, and only the distinct words reach the stemmer. A search turns its
lexemes into the words that have them and matches words, so no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.stem import Stemmer, chosen_stemmer, english_words, stem_words
from threadloom.session import BROADCAST_BYTES, broadcast_if_small, hint, write_measured

# Words with more places than this are few, and go out to the places instead of being grouped.
FREQUENT = 100_000


def _stemmed(words: DataFrame, stemmer: str | Stemmer) -> DataFrame:
    return words.withColumn("lexeme", stem_words(F.array("word"), chosen_stemmer(stemmer))[0])


def word_places(messages: DataFrame, *columns: str | Column) -> DataFrame:
    """columns, word: one row per place of a word that is no English stop word."""
    return messages.select(*columns, F.explode(english_words(F.col("text"))).alias("word"))


def vocabulary(messages: DataFrame, stemmer: str | Stemmer = "english") -> DataFrame:
    """word, n (places), lexeme for every distinct word."""
    return _stemmed(word_places(messages).groupBy("word").agg(F.count("*").alias("n")), stemmer)


def new_words(stored: DataFrame, messages: DataFrame, stemmer: str | Stemmer = "english") -> DataFrame:
    """word, lexeme of the words of ``messages`` that ``stored`` lacks."""
    found = word_places(messages).distinct()
    return _stemmed(found.join(stored.select("word"), "word", "left_anti"), stemmer)


def words_of(lexemes: DataFrame, words: DataFrame) -> DataFrame:
    """``lexemes`` with the words of the vocabulary that have them in place of ``lexeme``."""
    return words.select("word", "lexeme").join(broadcast_if_small(lexemes), "lexeme").drop("lexeme")


def with_lexemes(places: DataFrame, words: DataFrame) -> DataFrame:
    """``places`` with ``lexeme`` for ``word``.

    A vocabulary that measures small is broadcast. Of a larger one the frequent words, which
    would make skewed groups, are broadcast, and the others joined.
    """
    table, _, size = write_measured(words.select("word", "lexeme", "n"), "vocabulary")
    if size <= BROADCAST_BYTES:
        return places.join(hint(table.drop("n"), size), "word").drop("word")
    often = broadcast_if_small(table.where(F.col("n") > FREQUENT).drop("n"))
    rest = places.join(often.select("word"), "word", "left_anti").join(table.where(F.col("n") <= FREQUENT).drop("n"), "word")
    return places.join(often, "word").unionByName(rest).drop("word")
