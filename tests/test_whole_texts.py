"""Queries over texts reach every word of them."""

from __future__ import annotations

from cairn.plans import core, titles  # noqa: F401
from cairn.sources import tables


def test_pieces_hold_every_word(spark, sf):
    want = sorted(w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in (r.text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w)
    got = tables.pieces(spark, sf, "documents", ("doc_id",)).collect()
    assert sorted(w for r in got for w in r.title.split(" ")) == want and max(len(r.title.split(" ")) for r in got) == 14


def test_late_words_are_judged_and_denied(spark, tmp_path):
    tail = "officials deny explosion reports downtown harbour inoran"
    filler = " ".join(f"word{i}" for i in range(28))
    spark.createDataFrame([(31, f"{filler} {tail}\n\nsecond line")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"plain line\n{filler} {tail}"), (9, tail)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    judged = {(r.doc_id, r.line_no): r.category for r in core.QUERIES["judged_titles"](spark, str(tmp_path)).collect()}
    assert judged == {(31, 0): "earthquake", (31, 1): None, (31, 2): None}
    d = {(r.doc_id, r.line_no, r.piece): (r.item_id, r.said_line, r.said_piece) for r in core.QUERIES["denials"](spark, str(tmp_path)).collect()}
    assert d == {(31, 0, 2): (1, 1, 2)} | {k: v for k, v in d.items() if k != (31, 0, 2)} and d[31, 0, 2] == (1, 1, 2)
