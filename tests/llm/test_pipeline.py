"""The corpus pipeline against its stages done by brute force, and the registered queries over the smallest tables."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import langid, queries
from cairn.llm.queries import WORD_BPE
from tests.llm.test_kernels import plain_set
from tests.llm.test_operators import brute_components, brute_lines, corpus

pytestmark = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no vocabulary")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t, la, s, n) for i, t, la, s, n, *_ in corpus() if i != 66]
    items = [(1, " ".join((rows[40][1] or "").split()[:20])), (2, "never seen words in any of these")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))

    kept = {r.doc_id for r in langid.identified(docs).collect()}
    assert kept == {i for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    left = [r for r in rows if r[0] in kept]
    gone = brute_lines(left)
    left = [(i, "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t, *_ in left]
    names = {i for i, _, c in brute_components(left) if i == c}
    left = list({i: t for i, t in left if i in names}.items())
    sets = [plain_set(t) for _, t in items]
    left = [(i, t) for i, t in left if not any(len(s & plain_set(t)) >= 0.75 * len(s) for s in sets)]
    tok = Tokenizer.from_file(WORD_BPE)
    want = []
    for i, t in left:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and len(got) < len(rows)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_whole_tables(spark, sf, name):
    table = "pages" if name == "op8_html" else "documents"
    out = queries.queries()[name](spark, sf)
    if name == "op7_decontam":
        assert out.count() > 0
    elif name == "op11_sequences":
        assert out.agg({"length": "sum"}).first()[0] == out.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
    elif name == "op12_conversations":
        assert out.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_registered(spark):
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in e.queries()} and "pipeline" in e.queries()
