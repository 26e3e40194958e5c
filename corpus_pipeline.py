"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next.

All stages but the last return the columns of their input, whatever else these are called. Rows that
repeat an id and a text are one document of several rows and get one verdict; a null doc_id is a
document too and comes before all others. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from touchline.llm.queries import tokenizer_path
from touchline.llm.util import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are frequent in their host. Null, empty and short texts are rejected."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; documents without anything left go too.

    Of a near copy that keeps most lines only the changed lines are left, so few near copies reach
    the next stage as such; those whose lines all differ do.
    """
    kept = line_dedup.dedup_lines(docs)
    return kept.where("n_lines = 0 or n_removed < n_lines").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id: n-grams of five words, similarity 0.8. Documents without words stay."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, or its question; documents without words stay."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents that stay lies in the training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Line alignment, similarity joins, BM25 and tokenisation have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/touchline/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
