"""The corpus pipeline: stages from raw documents to packed training sequences.

Defined cases, for every stage: a null text counts as empty (and is too short for the quality
rules); very long texts are rows like others; of rows equal in id and text near dedup keeps one,
the other stages treat repeated rows and equal or null ids each on their own; ties follow the
operators' docstrings; an empty table gives an empty one; other columns are carried along to the
last stage under their names, whatever an operator calls its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import mixing, near_dup, packing, quality, secrets
from threadloom.session import dropped_scratch, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without their failing lines."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_dup.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate for the target weights says."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scans", secret_scans),
          ("source mixing", source_mixing), ("best-fit packing", best_fit_packing)]

#: Some stages (sketches, tokenizer, fitted classifier) have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with dropped_scratch(spark):  # what a stage wrote on its way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
