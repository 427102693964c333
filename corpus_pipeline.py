"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Stages with Python workers set the session's Arrow batches small (see ``small_batches``), as they follow stages that leave the executors' heaps full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontam, langid, line_dedup, ngram_join
from cairn.llm.common import dropped, saved, small_batches, table
from cairn.llm.queries import WORD_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go."""
    small_batches(spark)
    return langid.identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).selectExpr("doc_id", "text", "lang", "source", "CASE WHEN n_removed > 0 THEN cast(length(text) AS bigint) ELSE n_chars END AS n_chars")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return ngram_join.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts, as digests."""
    small_batches(spark)
    return bpe.encode_decode(docs, WORD_BPE, 32 << 20, keep=False)


STAGES = [("language ID", language_id), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", ngram_join_stage), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", bpe_stage)]

#: Language models and shingle joins are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        if before:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
