"""Exact length histogram: token totals for every context limit at once.

Documents are reduced to one row per encoded length before anything is ordered, so
all later work is on at most as many rows as there are distinct lengths. Sums over
longer lengths (suffix sums) then answer, for every limit, how many documents fit, how
many are cut and how many tokens remain.

Defined cases: null and empty texts have length ``end_tokens``; an empty table gives
an empty histogram; repeated rows count each; a very long text is one row like any other;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.tokens import token_lengths
from threadloom.session import write_scratch

SLAB = 64


def length_histogram(docs: DataFrame, end_tokens: int = 0, **paths: str) -> DataFrame:
    """length, n_docs: one row per encoded length."""
    return token_lengths(docs, end_tokens=end_tokens, **paths).groupBy(F.col("n_tokens").alias("length")).agg(
        F.count("*").alias("n_docs"))


def totals_by_limit(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, as a context limit:

    n_docs, n_tokens at this length; docs_within (length <= L); docs_cut (length > L);
    tokens_within and tokens_truncated (sum of min(length, L)); tokens_lost; all_docs,
    all_tokens; share_within, the quantile at which L stands.
    """
    # Written once: it is read for the slabs and for the lengths, and texts must not be encoded twice.
    sums = write_scratch(histogram, "lengths").withColumn("n_tokens", F.col("length") * F.col("n_docs")) \
        .withColumn("slab", F.floor(F.col("length") / SLAB))
    slabs = sums.groupBy("slab").agg(F.sum("n_docs").alias("slab_docs"), F.sum("n_tokens").alias("slab_tokens"))
    # One row per 64 lengths: ordered in one task, however many documents there are.
    above = Window.orderBy(F.col("slab").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("slab").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slabs = slabs.select(
        "slab", F.coalesce(F.sum("slab_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("slab_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("slab_docs").over(whole).alias("all_docs"), F.sum("slab_tokens").over(whole).alias("all_tokens"))
    longer = Window.partitionBy("slab").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.col("docs_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    cut_tokens = F.col("tokens_above") + F.coalesce(F.sum("n_tokens").over(longer), F.lit(0))
    return (
        sums.join(slabs, "slab").withColumn("docs_cut", cut).withColumn("cut_tokens", cut_tokens)
        .select("length", "n_docs", "n_tokens", (F.col("all_docs") - F.col("docs_cut")).alias("docs_within"), "docs_cut",
                (F.col("all_tokens") - F.col("cut_tokens")).alias("tokens_within"),
                (F.col("all_tokens") - F.col("cut_tokens") + F.col("length") * F.col("docs_cut")).alias("tokens_truncated"),
                (F.col("cut_tokens") - F.col("length") * F.col("docs_cut")).alias("tokens_lost"),
                "all_docs", "all_tokens",
                ((F.col("all_docs") - F.col("docs_cut")) / F.col("all_docs")).alias("share_within"))
    )


def quantile_lengths(totals: DataFrame, quantiles: list[float]) -> DataFrame:
    """quantile, length: the least length within which that share of the documents lies."""
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    return totals.select(wanted, "length", "share_within").where(F.col("share_within") >= F.col("quantile")) \
        .groupBy("quantile").agg(F.min("length").alias("length"))
