"""A corpus cleaned in stages, each over all that its predecessor kept.

quality (rejected documents go), exact duplicates (the largest doc_id of equal texts stays), near-duplicates (the
smallest doc_id of a component stays), mixture to target weights, then byte-level BPE of what is left.
Rows of one doc_id are one document: a decision holds for all of them; rows without a doc_id are decided by their text.
No stage is expressible in DuckDB's SQL as a
whole (a learned classifier, seeded water-filling, XXH64), so ORACLE_SQL is None and tests/llm has brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import bpe_digests
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.mixing import mixed_documents
from textloom.llm.quality import quality_scores
from textloom.llm.shared import kept_rows, written
from textloom.llm.simhash import simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kept_rows(docs, lambda rows: quality_scores(rows, labels).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, lambda rows: exact_dedup(rows).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, lambda rows: simhash_dedup(rows).where("doc_id = component_id"), above=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
