"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, benchmark
decontamination, BPE encoding. Each stage takes all rows its predecessor kept; all but the
last return the columns of ``documents``.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe_prefix, circulant, importance, line_chunks, queries, templates
from parley.llm.common import release, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps (operator 5)."""
    return importance.select(docs, queries.table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that stand in an earlier place; a document that has
    nothing left goes (operator 3)."""
    return line_chunks.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 6, at a similarity of 0.8)."""
    return circulant.keep_one(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 9)."""
    return templates.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of what they decode to (operator 10)."""
    return bpe_prefix.encode_decode(docs, f"{queries.TOKENIZERS}/word_bpe_49k.json", digest=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", decontaminate), ("bpe", encode)]

#: Models, rolling names and BPE cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        release(spark)
    return docs
