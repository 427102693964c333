"""Line dedup: what is shuffled and written for join keys."""

from __future__ import annotations

from cairn.llm import line_dedup


def test_keys_are_written_before_they_meet_the_first_lines(spark, monkeypatch):
    steps, saved = [], line_dedup.saved

    def noted(df, name="step", *rest):
        steps.append((name, df.columns))
        return saved(df, name, *rest)

    monkeypatch.setattr(line_dedup, "saved", noted)
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, line), (2, line + " end"), (3, "another line")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.removed_lines(docs).select("doc_id", "line_no").collect()] == [(2, 0)]
    assert [c for name, c in steps if name == "keys"] == [["key", "name", "pos"], ["key", "id", "at", "n", "pos"]]


def test_places_are_sorted_as_plain_longs(spark):
    ranks = list(range(line_dedup.BUCKETS))[::-1]
    frame = spark.createDataFrame([([5, 1 << 16 | 7, 5 << 16 | 7],), ([],)], "toks array<bigint>").crossJoin(spark.createDataFrame([(ranks,)], "rarity array<int>"))
    out = frame.select(line_dedup._places().alias("places"))
    assert not out.schema["places"].dataType.containsNull
    assert [r.places for r in out.collect()] == [[ranks[5] << 28, ranks[7] << 28 | 1, ranks[7] << 28 | 5], []]
