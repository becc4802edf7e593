"""Batch prompt assembly: retrieval, memory block and message list, without a model call."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.functions.stem import Stemmer
from threadloom.functions.text import shorten, strip_space
from threadloom.operators.search import search_many


def memory_block(hits: DataFrame) -> DataFrame:
    """One text block per query from its search hits; hits without text are skipped."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.format_string("- [%s | %s | score %.3f] %s", stamp, F.coalesce("role", F.lit("unknown")),
                           F.col("score"), F.col("summary"))
    return (
        hits.where(F.length("text") > 0).withColumn("summary", shorten("text"))
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
        .select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("memory"))
    )


def build_prompts(messages: DataFrame, queries: DataFrame, system_prompt: str, memory_results: int = 5,
                  history: DataFrame | None = None, stemmer: str | Stemmer | None = "english",
                  heading: str = "Relevant memory:", postings: DataFrame | None = None) -> DataFrame:
    """Prompt messages as rows (query_id, section, turn, role, content).

    Sorting by (section, turn) gives the prompt: system, memory if any, history,
    user. Rows rather than an array per query, so a long history stays spread
    over the cluster. ``history`` has (query_id, turn, role, content).
    """
    columns = ["query_id", "section", "turn", "role", "content"]

    def section(rows: DataFrame, number: int, role: str, content) -> DataFrame:
        return rows.select("query_id", F.lit(number).alias("section"), F.lit(0).cast("bigint").alias("turn"),
                           F.lit(role).alias("role"), content.alias("content"))

    parts = [section(queries, 1, "system", strip_space(F.lit(system_prompt))),
             section(queries, 4, "user", F.col("q"))]
    if memory_results > 0:
        hits = search_many(messages, queries, memory_results, stemmer, postings)
        block = F.concat(F.lit(f"{heading}\n"), strip_space(F.col("memory")))
        parts.append(section(memory_block(hits), 2, "system", block))
    if history is not None:
        parts.append(history.select("query_id", F.lit(3).alias("section"), F.col("turn").cast("bigint").alias("turn"),
                                    "role", "content"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(columns)
