"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import alignment, bpe, conversations, decontam, html, langid, line_dedup, media, ngram_join, packing, quality, sequence_packing, sharding
from cairn.llm.common import table
from cairn.llm.conversations_sql import REPAIR

#: The vocabulary files.
WORD_BPE, BYTE_BPE, PIECE_BPE = (str(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text_crc32 of the text that is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_lines", "n_removed", "crc32(cast(coalesce(text, '') AS binary)) AS text_crc32")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op5_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.with_media(table(spark, sf_dir, "documents")))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op11_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_packing.packing_digest(sequence_packing.pack_sequences(table(spark, sf_dir, "documents"), WORD_BPE))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_digest(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_sharding, op4_ngram_join, op5_token_pack, op6_media, op7_decontam, op8_html, op9_bpe, op10_langid, op11_sequences, op12_conversations, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op12_conversations": REPAIR}
