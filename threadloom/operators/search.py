"""Ranked full-text search, for one query or for a table of queries.

Terms are alternatives, so every matching word position is its own cover and adds
the default weight: score = 0.1 x matching positions, whatever the text length.
``stemmer`` is ``"english"``, a function from word to stem, or None for whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.highlights import highlights
from threadloom.functions.stem import Stemmer, chosen_stemmer, count_matches, english_words, query_lexemes, stem_words
from threadloom.functions.text import WORD, query_terms, safe_text, search_terms, whole_words, word_counts, word_list
from threadloom.operators.filters import all_of, search_filters
from threadloom.operators.vocabulary import vocabulary, with_lexemes, word_places, words_of
from threadloom.schemas import SEARCH_STOP_WORDS
from threadloom.session import hint, join_texts, split_repeated, write_measured

SNIPPET = 400
HIT = ["conv_id", "msg_id", "role", "ts", "text", "score", "highlights"]
# Fixed value: matching positions per unit of score.
POSITION_WEIGHT = 10.0


def _plain_matches(col: Column, terms: list[str]) -> Column:
    return F.regexp_count(F.lower(safe_text(col)), F.lit(whole_words(terms)))


def score_messages(messages: DataFrame, terms: list[str], stemmer: str | Stemmer | None = "english") -> DataFrame:
    """Add ``score`` to every message; a map over the scan."""
    stem = chosen_stemmer(stemmer)
    matches = _plain_matches(F.col("text"), terms) if stem is None \
        else count_matches(F.col("text"), query_lexemes(terms, stem), stem)
    return messages.withColumn("score", matches / F.lit(POSITION_WEIGHT))


def _best_first() -> list[Column]:
    return [F.desc("score"), F.desc("ts"), F.asc("conv_id"), F.asc("msg_id")]


def top_keys(messages: DataFrame, terms: list[str], k: int = 50, filters: dict | None = None,
             stemmer: str | Stemmer | None = "english", pad: bool = True) -> DataFrame:
    """Keys and scores of the ``k`` best messages: no text leaves the scan."""
    order = _best_first()
    scored = score_messages(search_filters(messages, filters), terms, stemmer)
    if not pad:
        scored = scored.where(F.col("score") > 0)
    return scored.select("conv_id", "msg_id", "ts", "score").orderBy(*order).limit(max(k, 0))


def search(messages: DataFrame, q: str, k: int = 50, filters: dict | None = None,
           stemmer: str | Stemmer | None = "english", pad: bool = True, snippet: int = SNIPPET) -> DataFrame:
    """The ``k`` best messages for one query, with snippet and highlights; none if ``k`` is not positive.

    With ``pad`` unmatched messages (score 0) fill the result up to ``k``. Only keys and
    scores enter the top-k; the texts of the winners are fetched afterwards, highlighted
    in full and then cut to ``snippet`` characters.
    """
    terms = query_terms(q)
    if not terms:
        raise ValueError("the query needs at least one term")
    top = top_keys(messages, terms, k, filters, stemmer, pad)
    found = join_texts(messages.select("conv_id", "msg_id", "role", "text"), top, ["conv_id", "msg_id"])
    ordered = found.select("conv_id", "msg_id", "role", "ts", "text", "score").orderBy(*_best_first())
    marked = highlights(F.col("text"), F.array(*[F.lit(t) for t in terms]))
    return ordered.withColumn("highlights", marked).withColumn("text", F.left("text", F.lit(snippet)))


def word_positions(messages: DataFrame) -> DataFrame:
    """One row per place of a whole word: the postings before they are counted."""
    return messages.select("conv_id", "msg_id", "role", "ts", F.lit(1).cast("bigint").alias("tf"), F.explode(_plain_words()).alias("lexeme"))


def _plain_words() -> Column:
    return F.regexp_extract_all(F.lower(safe_text(F.col("text"))), F.lit(f"{WORD}+"), F.lit(0))


def _counted_words(messages: DataFrame, words: Column, name: str, *columns: str) -> DataFrame:
    """name, columns, tf: the distinct words of every row with their places; a map over the scan."""
    counted = messages.select(*columns, F.explode(word_counts(words)).alias("_word"))
    return counted.select(F.col("_word.word").alias(name), *columns, F.col("_word.n").alias("tf"))


def build_postings(messages: DataFrame, stemmer: str | Stemmer | None = "english", words: DataFrame | None = None) -> DataFrame:
    """Postings (lexeme, conv_id, msg_id, role, ts, tf) to be written once and searched often.

    ``words``: the vocabulary (word, lexeme, n) if there is one already.
    """
    message = ["conv_id", "msg_id", "role", "ts"]
    if chosen_stemmer(stemmer) is None:
        # A message has its postings to itself; only those of messages that stand more than once are added up.
        single, again = (_counted_words(rows, _plain_words(), "lexeme", *message) for rows in split_repeated(messages, message))
        return single.unionByName(again.groupBy("lexeme", *message).agg(F.sum("tf").alias("tf")))
    places = _counted_words(messages, english_words(F.col("text")), "word", *message)
    known = vocabulary(messages, stemmer) if words is None else words
    return with_lexemes(places, known).groupBy("lexeme", *message).agg(F.sum("tf").alias("tf"))


def prepare_queries(queries: DataFrame, stemmer: str | Stemmer | None = "english") -> DataFrame:
    """(query_id, lexeme, filters...), one row per distinct lexeme of a query.

    Optional filter columns role, conv_id, date_from and date_to apply per query;
    a null means no filter. Queries without a usable term disappear.
    """
    terms = search_terms(F.col("q"))
    stem = chosen_stemmer(stemmer)
    if stem is not None:
        parts = F.flatten(F.transform(terms, lambda t: F.split(t, "_")))
        stop = word_list(SEARCH_STOP_WORDS)
        terms = stem_words(F.filter(parts, lambda w: (w != "") & ~F.array_contains(stop, w)), stem)

    def given(name: str, kind: str) -> Column:
        value = F.col(name) if name in queries.columns else F.lit(None)
        return value.cast(kind).alias(f"q_{name}")

    return queries.select(
        "query_id", given("role", "string"), given("conv_id", "string"),
        given("date_from", "timestamp"), given("date_to", "timestamp"),
        F.explode(F.array_distinct(terms)).alias("lexeme"))


def search_many(messages: DataFrame, queries: DataFrame, k: int = 10, stemmer: str | Stemmer | None = "english",
                postings: DataFrame | None = None, highlighted: bool = False, snippet: int = SNIPPET,
                words: DataFrame | None = None) -> DataFrame:
    """The ``k`` best matching messages of every query (query_id, q): matches only, none if ``k`` is not positive.

    Word positions, exploded in one scan or read from a postings table, meet the queries'
    words in a join: a broadcast of the queries if they measure small, else a join in
    which frequent words are split at run time. Stemmed queries are turned into the words
    that have their lexemes, by the vocabulary ``words`` or one made of the messages. Matches are summed in the map tasks and
    cut to ``k`` per query in every task. Texts are fetched for the winners, highlighted
    in full if ``highlighted``, and cut to ``snippet`` characters.
    """
    top = ranked_matches(scored_matches(messages, queries, stemmer, postings, words), k) \
        .select("query_id", "rank", "conv_id", "msg_id", (F.col("score") / F.lit(POSITION_WEIGHT)).alias("score"))
    found = join_texts(messages.select("conv_id", "msg_id", "role", "ts", "text"), top, ["conv_id", "msg_id"])
    columns = ["query_id", "rank", "conv_id", "msg_id", "role", "ts", F.left("text", F.lit(snippet)).alias("text"), "score"]
    if highlighted:
        terms = queries.select("query_id", search_terms(F.col("q")).alias("terms"))
        found = found.join(terms, "query_id").withColumn("highlights", highlights(F.col("text"), F.col("terms")))
        columns.append("highlights")
    return found.select(*columns)


def scored_matches(messages: DataFrame, queries: DataFrame, stemmer: str | Stemmer | None = "english",
                   postings: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """query_id, conv_id, msg_id, ts, score (matching positions) of every message that matches a query."""
    wanted = prepare_queries(queries, stemmer)
    if postings is not None:
        positions = postings
    elif chosen_stemmer(stemmer) is None:
        positions = word_positions(messages)
    else:
        wanted = words_of(wanted, vocabulary(messages, stemmer) if words is None else words).withColumnRenamed("word", "lexeme")
        positions = word_places(messages, "conv_id", "msg_id", "role", "ts", F.lit(1).cast("bigint").alias("tf")) \
            .withColumnRenamed("word", "lexeme")
    table, _, size = write_measured(wanted, "queries")
    return _posting_scores(positions, hint(table, size))


def ranked_matches(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best matches of every query, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("ts"), "conv_id", "msg_id")
    return matches.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _posting_scores(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    kind = postings.schema["ts"].dataType
    applies = all_of([
        F.col("q_role").isNull() | (F.col("q_role") == F.col("role")),
        F.col("q_conv_id").isNull() | (F.col("q_conv_id") == F.col("conv_id")),
        F.col("q_date_from").isNull() | (F.col("ts") >= F.col("q_date_from").cast(kind)),
        F.col("q_date_to").isNull() | (F.col("ts") <= F.col("q_date_to").cast(kind)),
    ])
    return postings.join(wanted, "lexeme").where(applies) \
        .groupBy("query_id", "conv_id", "msg_id", "ts").agg(F.sum("tf").alias("score"))


def unusable_queries(queries: DataFrame) -> DataFrame:
    """Queries without any term, with the reason."""
    return queries.where(F.size(search_terms(F.col("q"))) == 0) \
        .select("query_id", F.lit("the query needs at least one term").alias("reason"))
