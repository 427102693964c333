"""Stores that a stream keeps: upserts by bucket, counters, newest rows per key, stories; monthly families; archives; small lists."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from cairn.operators import country, early_warning, indices
from cairn.sources import sinks
from cairn.streaming import jobs, stores
from tests.test_stories import by_text, components, titles, tokens

T = dt.datetime(2026, 10, 1)
ITEM = "id long, title string, date timestamp, first_seen timestamp"


def versions(store):
    return {b: v for b, v in store.versions().items()}


def test_upsert_rewrites_touched_buckets(spark, tmp_path):
    store = stores.BucketStore(spark, str(tmp_path / "s"), ITEM, ("id",), 64)
    write = stores.upserting(store, "2026-10-20 00:00:00")
    rows = [(i, f"t{i}", T + dt.timedelta(hours=i)) for i in range(300)]
    frame = lambda r: spark.createDataFrame(r, "id long, title string, date timestamp")
    write(frame(rows), 0)
    before = versions(store)
    assert store.read().count() == 300 and len(before) > 50
    write(frame([(7, "new", T + dt.timedelta(days=9))]), 1)
    after = versions(store)
    assert sum(before[b] != after[b] for b in before) == 1
    write(frame([(7, "new", T + dt.timedelta(days=9))]), 1)  # the same epoch again
    (r,) = store.read().where("id = 7").collect()
    assert (r.title, r.first_seen) == ("new", T + dt.timedelta(hours=7)) and store.read().count() == 300
    write(frame([(7, "newer", T + dt.timedelta(days=10))]), 2)
    write(frame([]), 3)
    kept = {s for b in os.listdir(tmp_path / "s/rows") for s in os.listdir(tmp_path / "s/rows" / b)}
    assert store.epochs() == [2, 3] and kept == {"version=0", "version=2"}
    write(frame([(9, "later", T + dt.timedelta(days=120))]), 4)
    assert store.read().where("id = 9").first().title == "later"


def square(spark):
    ring = lambda x: [[{"x": x, "y": 45.0}, {"x": x + 1, "y": 45.0}, {"x": x + 1, "y": 46.0}, {"x": x, "y": 46.0}]]
    return spark.createDataFrame([("a", "FR", ring(0.0)), ("b", "FR", ring(2.0))], "unit string, country string, rings array<array<struct<x:double,y:double>>>")


def events(spark):
    at = dt.datetime(2026, 9, 27)
    rows = [(1, "unrest", 0.5, 2, "x"), (2, "terrorism", 0.5, 2, "x"), (3, "crime", 0.5, 2, "vol de bétail : des éleveurs attaqués"), (4, "earthquake", 0.5, 1, "x"), (5, "flood", 2.5, 2, "x"), (6, "cyber", 2.5, 2, "x"), (7, "political", 2.5, 2, "x"), (8, "unrest", 9.0, 2, "x"), (9, "unrest", None, 2, "x"), (10, None, 0.5, 2, None)]
    return spark.createDataFrame([(i, c, "FR", 45.5, x, s, at, t) for i, c, x, s, t in rows], "id long, category string, country string, lat double, lon double, severity int, date timestamp, title string")


def test_families_of_incidents(spark):
    got = {r.unit: tuple(r)[2:] for r in early_warning.monthly_counts(early_warning.family_rows(events(spark), square(spark))).collect()}
    assert got == {"a": (2, 1, 1, 0, 0, 0, 0), "b": (0, 0, 0, 1, 1, 1, 0)}
    texts = {"Herders clash": True, "swell of protest": False, "a well": True, "WATER!": True, "landing": False, None: False}
    x = spark.createDataFrame([(t,) for t in texts], "t string").select("t", early_warning.is_resource("t").alias("r"))
    assert {r.t: r.r for r in x.collect()} == texts


def test_counters_count_each_id_once(spark, tmp_path):
    seen = stores.BucketStore(spark, str(tmp_path / "seen"), "id long", ("id",), 8)
    counters = stores.BucketStore(spark, str(tmp_path / "n"), "unit string, month date, family string, n long", ("unit", "month"), 8)
    units = square(spark)
    write = stores.counting(seen, counters, lambda batch: early_warning.family_rows(batch, units))
    x = events(spark)
    for epoch, batch in enumerate([x.where("id < 4"), x.where("id BETWEEN 2 AND 6"), x.where("id BETWEEN 2 AND 6"), x]):
        write(batch, epoch)
        write(batch, epoch)  # replayed
    got = {r.unit: tuple(r)[2:] for r in early_warning.monthly_counts(counters.read()).collect()}
    assert got == {r.unit: tuple(r)[2:] for r in early_warning.monthly_counts(early_warning.family_rows(x, units)).collect()}


def test_stories_in_any_order_of_batches(spark, tmp_path):
    texts = titles(90, 4)
    rnd = random.Random(5)
    rows = [(i, t, T + dt.timedelta(hours=rnd.randrange(0, 400))) for i, t in enumerate(texts)] + [(500, None, T), (501, "", T)]
    toks = {i: tokens(t or "") for i, t, _ in rows}
    at = {i: d for i, _, d in rows}
    want = components(sorted(toks), lambda a, b: abs(at[a] - at[b]) <= dt.timedelta(hours=120) and by_text(toks[a], toks[b]))
    assert len(set(want.values())) < len(want) - 10
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        keys = stores.BucketStore(spark, str(tmp_path / f"k{seed}"), stores.STORY_KEYS, ("key",), 16)
        labels = stores.BucketStore(spark, str(tmp_path / f"l{seed}"), stores.STORY_LABELS, ("story",), 16)
        write = stores.storytelling(keys, labels)
        for epoch, i in enumerate(range(0, len(rows), 31)):
            batch = spark.createDataFrame(rows[i : i + 31], "id long, title string, date timestamp")
            write(batch, epoch)
            if epoch == 1:
                write(batch, epoch)  # replayed
        assert {r.id: r.story for r in labels.read().collect()} == want


def test_newest_kept(spark, tmp_path):
    schema = "key string, id long, date timestamp"
    batches = [[("a", i, T + dt.timedelta(hours=i)) for i in range(5)] + [("b", 9, T)], [("a", 5, T + dt.timedelta(hours=5)), ("a", 2, T + dt.timedelta(hours=2))], [("c", 1, T + dt.timedelta(days=30))], [("c", 2, T + dt.timedelta(days=30, hours=1))]]
    seen = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stores.newest_kept(jobs.pickup(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), most=3)
        jobs.run_available(out, str(tmp_path / "c"), lambda b, e: seen.extend((r.key, r.n, r.oldest, r.newest) for r in b.collect()), "update")
    assert ("a", 3, T + dt.timedelta(hours=2), T + dt.timedelta(hours=4)) in seen and ("a", 3, T + dt.timedelta(hours=3), T + dt.timedelta(hours=5)) in seen
    assert ("a", 0, None, None) in seen and ("b", 0, None, None) in seen and seen[-1][0] != "a"


def test_archive_months_that_are_gone(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 5, 3)), (2, dt.datetime(2026, 6, 3)), (3, dt.datetime(2026, 9, 29))]
    x = spark.createDataFrame(rows, "id long, date timestamp")
    path = str(tmp_path / "a")
    assert {r.month: r.n for r in sinks.write_archive(x, path, "2026-09-30 00:00:00").collect()} == {"2026-05": 1, "2026-06": 1}
    assert {r.month: r.n for r in sinks.write_archive(x.where("id > 1"), path, "2026-09-30 00:00:00").collect()} == {"2026-06": 1}
    assert sinks.write_archive(x.where("id = 3"), path, "2026-09-30 00:00:00").count() == 0


def test_names_history_and_overrides(spark):
    names = spark.createDataFrame([(1, "Côte d'Ivoire"), (2, "IVORY COAST"), (3, "Nowhere"), (4, None), (5, "")], "id long, name string")
    c = spark.createDataFrame([("Cote d'Ivoire", "CI"), ("Mali", "ML")], "name string, country string")
    a = spark.createDataFrame([("Ivory Coast", "CI")], "alias string, country string")
    assert {r.id: r.country for r in country.by_country_name(names, c, a).collect()} == {1: "CI", 2: "CI", 3: None, 4: None, 5: None}
    h = spark.createDataFrame([("t", dt.date(2026, m, 1), m) for m in range(1, 10)], "trend_id string, month date, score int")
    s = early_warning.with_snapshot(h, spark.createDataFrame([("t", 99), ("u", 1)], "trend_id string, score int"), "2026-09-30 00:00:00", months=3)
    assert sorted(tuple(r) for r in s.collect()) == [("t", dt.date(2026, 7, 1), 7), ("t", dt.date(2026, 8, 1), 8), ("t", dt.date(2026, 9, 1), 99), ("u", dt.date(2026, 9, 1), 1)]
    assert [r.score for r in early_warning.score_history(s, months=2).where("trend_id = 't'").orderBy("rank").collect()] == [99, 8]
    e = spark.createDataFrame([("ML", T, "security", 4, "high", False)], "country string, date timestamp, grp string, severity int, confidence string, is_auto boolean")
    adv = spark.createDataFrame([("ML", 4, 4)], "country string, level int, scale int")
    o = spark.createDataFrame([("ML", 2)], "country string, level int")
    assert [(r.level, r.data_quality) for r in indices.country_risk(e, adv, "2026-10-02 00:00:00", overrides=o).collect()] == [(2, "analyst")]
    assert [(r.level, r.data_quality) for r in indices.country_risk(e, adv, "2026-10-02 00:00:00").collect()] == [(5, "advisories+events")]
    assert country.not_yet_loaded(e.select(F.lit(1).alias("id")), e.select(F.lit(2).alias("id"))).collect() == [(1, True)]
