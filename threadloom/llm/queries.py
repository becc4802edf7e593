"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import (chats, fingerprints, html_text, lengths, mixing, near_dup, negatives, packing, quality, secrets,
                            suffix_tree, variants, wavelet)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    failing = F.filter("lines", lambda x: x.reason.isNotNull())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", F.size(failing).cast("long").alias("n_failing_lines"), "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.col("tree_score").alias("score"),
        F.col("score").alias("event_score"), "spelled_score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_words", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.totals_by_limit(lengths.length_histogram(table(spark, sf_dir, "documents")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.chat_turns(table(spark, sf_dir, "conversations"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items()
            if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op7_chat_formatting": CHATS_SQL, "op12_hard_negatives": NEGATIVES_SQL}


def quality_sql() -> str:
    """The rules over exploded lines, and repeated windows by grouping their words."""
    def pattern(regex: str) -> str:
        return "'" + regex.replace("'", "''") + "'"

    def count(regex: str, text: str = "line") -> str:
        return f"len(regexp_extract_all({text}, {pattern(regex)}))"

    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
split AS (SELECT doc_id, line, regexp_extract_all(line, {pattern(quality.WORD)}) AS words FROM lines),
judged AS (
  SELECT *, CASE
    WHEN len(words) = 0 THEN NULL
    WHEN {count(quality.SEPARATOR)} >= 3 AND len(words) <= 5 * ({count(quality.SEPARATOR)} + 1) THEN 'navigation'
    WHEN len(words) <= 2 AND NOT regexp_matches(trim(line, {blanks}), {pattern(quality.CLOSING_MARK)}) THEN 'navigation'
    WHEN {count(quality.SYMBOL)} > 0.1::DOUBLE * length(line) THEN 'punctuation'
    WHEN len(words) >= 4 AND {count(quality.MARK_RUN)} > 0.3::DOUBLE * len(words) THEN 'punctuation'
    WHEN len(words) >= 12 AND NOT regexp_matches(line, {pattern(quality.SENTENCE_MARK)}) THEN 'punctuation'
    WHEN len(words) <= 40 AND regexp_matches(line, {pattern(quality.STOCK_PHRASE)}) THEN 'boilerplate'
    WHEN len(words) >= 8 AND len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))
         > 0.4::DOUBLE * len(words) THEN 'boilerplate' END AS reason
  FROM split),
by_doc AS (
  SELECT doc_id, count(reason) AS n_failing_lines,
         count(*) FILTER (len(words) > 0) - count(DISTINCT line) FILTER (len(words) > 0) AS n_dup_lines,
         coalesce(sum(length(line)) FILTER (len(words) > 0), 0) AS all_chars,
         coalesce(sum(length(line)) FILTER (len(words) > 0 AND reason IS NULL), 0) AS left_chars
  FROM judged GROUP BY doc_id),
tokens AS (SELECT doc_id, text, regexp_extract_all(text, {pattern(quality.WORD)}) AS words FROM docs),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM tokens),
grams AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos:pos + 4], ' ')) AS times FROM places),
covered AS (
  SELECT doc_id, least(5, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 5)) AS fresh
  FROM grams WHERE times > 1),
repeats AS (SELECT doc_id, sum(fresh)::BIGINT AS n FROM covered GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         {count(quality.SYMBOL, 'text')} AS n_symbols, n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_failing_lines,
         CASE WHEN all_chars > 0 THEN 1 - left_chars / all_chars::DOUBLE ELSE 0 END AS lost
  FROM tokens t JOIN by_doc USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_failing_lines,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.3::DOUBLE AS kept
FROM counted"""


# Prefixes as whole lists of (role, text) instead of hashes.
CHATS_SQL = """
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth
  FROM conversations),
prefixes AS (
  SELECT conv_id, nth, role, text, count(*) OVER (PARTITION BY conv_id) AS n_turns,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY nth) AS so_far
  FROM numbered),
whole AS (
  SELECT so_far, min(conv_id) AS conv_id, count(*) AS n_logged FROM prefixes WHERE nth = n_turns GROUP BY so_far),
kept AS (
  SELECT * FROM whole WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p WHERE p.nth < p.n_turns AND p.so_far = whole.so_far))
SELECT conv_id, nth, n_turns, n_logged,
       '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM prefixes JOIN kept USING (conv_id)
"""


# All scores of every anchor, ranked within its label and below each positive.
NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS whole
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.whole, b.whole)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND score <= positive_score AND 100 * score >= 80 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 5
"""
