"""Stages of the pipeline with Python workers hand them texts in small batches."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

import corpus_pipeline
from cairn.llm.common import _BATCHES, BATCH_BYTES
from cairn.llm.queries import WORD_BPE

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no vocabulary")


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])


@pytest.mark.parametrize("at", [0, 2, 3, 4])
def test_batches_are_small(spark, sf, at):
    spark.conf.unset(_BATCHES)
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('some words of a text ', 12000) AS text", "'en' AS lang", "'s' AS source", "cast(252000 AS bigint) AS n_chars").coalesce(1)
    corpus_pipeline.STAGES[at][1](spark, docs, sf)
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 60 and max(r.bytes for r in got) <= BATCH_BYTES + 300_000


def test_a_smaller_setting_stays(spark, sf):
    try:
        spark.conf.set(_BATCHES, "1m")
        corpus_pipeline.bpe_stage(spark, spark.createDataFrame([(1, "a text")], "doc_id long, text string"), sf)
        assert spark.conf.get(_BATCHES) in ("1m", "1048576b")
    finally:
        spark.conf.unset(_BATCHES)
