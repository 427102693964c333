"""Joins whose cost follows different values, not rows: results against plain Python, and no more rows in between than the result needs."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from cairn.functions.exprs import segment_km
from cairn.operators import country, geo, merging


def exchanged(df):
    """Rows that each exchange of an executed frame has written."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        n = nodes.pop()
        kind = n.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(n.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(n.plan())
            continue
        if kind == "ShuffleExchangeExec":
            out.append(n.metrics().apply("shuffleRecordsWritten").value())
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    return rows, out


def test_denials_in_blocks_and_without_a_shuffle_of_events(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
    told = lambda n, days: [(i, " ".join(r.sample(words, r.randint(2, 12))), r.randrange(days)) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, d long").withColumn("date", F.timestamp_seconds(F.lit(1704067200) + F.col("d") * 86400)).drop("d")
    events, context = told(300, 20), told(40, 20)
    expected = {}
    for i, t, d in events:
        best = [(cd, c) for c, u, cd in context if abs(d - cd) <= 3 and len(k := set(t.split()) & set(u.split())) >= 3 and len(k) * 4 >= len(set(t.split()) | set(u.split())) and min(len(t.split()), len(u.split())) >= 3]
        if best:
            expected[i] = min(best)[1]
    x = merging.denials(frame(events), frame(context), block=100)
    got, written = exchanged(x)
    assert expected and {r.event: r.denial for r in got} == expected
    assert max(written) <= 3 * len(events)  # not an event for each of its pairs of words


def joined(df):
    """Rows that come out of the joins of an executed frame, largest first."""
    rows = df.collect()
    nodes, out = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        n = nodes.pop()
        kind = n.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(n.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            nodes.append(n.plan())
            continue
        if "Join" in kind:
            out.append(n.metrics().apply("numOutputRows").value())
        nodes += [n.children().apply(i) for i in range(n.children().size())]
    return rows, sorted(out, reverse=True)


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


#: 400 incidents at four positions, 120 sites at six.
SPOTS = [(10.0, 20.0), (10.2, 20.1), (10.5, 20.6), (40.0, 20.0)]
EVENTS = [(i, *SPOTS[i % 4], 1 + i % 4, "low" if i % 5 == 0 else "high", f"2024-01-{1 + i % 30:02d} 00:00:00") for i in range(400)]
SITES = [(j, f"s{j % 50:02d}", "A" if j % 2 else "B", 10.0 + j % 6 / 5, 20.0 + j % 3 / 5, 30.0 + 10 * (j % 6 // 3), 1 + j % 3) for j in range(120)]


def geo_frames(spark):
    e = spark.createDataFrame(EVENTS, "id long, lat double, lon double, severity int, confidence string, date string").withColumn("date", F.col("date").cast("timestamp")).withColumn("country", F.lit("X"))
    return e, spark.createDataFrame(SITES, "site_id long, site string, country string, site_lat double, site_lon double, radius_km double, min_severity int")


def near():
    return [(e, s, km(e[1], e[2], s[3], s[4])) for e in EVENTS for s in SITES if km(e[1], e[2], s[3], s[4]) <= s[5]]


def test_corridors_shuffle_no_result(spark):
    e, s = geo_frames(spark)
    lines = s.selectExpr("concat('r', site_id % 40) AS name", "site_lat AS a_lat", "site_lon AS a_lon", "site_lat + 1 AS b_lat", "site_lon + 1 AS b_lon", "radius_km AS buffer_km")
    twice = e.unionByName(e.where("id % 7 = 0").withColumn("lat", F.col("lat") + 0.1))  # an id at two positions
    flat = twice.crossJoin(lines).withColumn("km", segment_km("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")).where("km <= buffer_km").groupBy("id", "name").agg(F.round(F.min("km"), 3).alias("km"))
    rows, written = exchanged(geo.corridor_alerts(twice, lines))
    assert rows and sorted(rows) == sorted(flat.collect())
    assert max(written) <= 2 * len(EVENTS) < len(rows)


def test_nearest_site_joins_positions_only(spark):
    e, s = geo_frames(spark)
    best = {}
    for a, b, d in near():
        best[a[0]] = min(best.get(a[0], (1e9, "")), (round(d, 6), b[1]))
    rows, made = joined(geo.nearest_site(e, s))
    assert {r.id: (r.site, r.km) for r in rows} == {i: (n, round(d, 3)) for i, (d, n) in best.items()}
    assert made[0] <= len(EVENTS)


def test_nearest_airports_join_positions_only(spark):
    _, s = geo_frames(spark)
    cities, ports = s.where("site_id < 60").withColumnRenamed("site", "city"), s.where("site_id >= 60").selectExpr("country", "site AS airport", "site_lat AS lat", "site_lon AS lon")
    best = {}
    for a in SITES[:60]:
        for b in SITES[60:]:
            if a[2] == b[2] and (d := km(a[3], a[4], b[3], b[4])) <= 80:
                best[a[2], a[1]] = min(best.get((a[2], a[1]), (1e9, "")), (round(d, 6), b[1]))
    rows, made = joined(geo.nearest_in_country(cities, ports))
    assert {(r.country, r.city): (r.airport, r.km) for r in rows} == {k: (n, round(d, 3)) for k, (d, n) in best.items()}
    assert made[0] <= 60


def test_calendar_overlaps_count_days(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [(i, "A" if i % 2 else "B", day(i % 9), day(i % 9 + 1) if i % 3 == 0 else None) for i in range(300)]
    stays = [(i, "A" if i % 2 else "B", day(i % 4 + 3), day(i % 4 + 4)) for i in range(80)]
    c = spark.createDataFrame(entries, "id long, country string, d date, end date")
    s = spark.createDataFrame(stays, "stay long, country string, `from` date, `to` date")
    expected = {}
    two = datetime.timedelta(2)
    for i, land, a, b in stays:
        hit = [d for _, l, d, e in entries if l == land and (e or d) >= a - two and d <= b + two]
        if hit:
            expected[i] = (len(hit), min(hit))
    rows, made = joined(country.calendar_overlaps(c, s))
    assert {r.stay: (r.entries, r.first) for r in rows} == expected
    assert made[0] <= 300


def test_site_alerts_take_distances_between_positions(spark):
    e, s = geo_frames(spark)
    got = geo.site_alerts(e, s).collect()
    assert Counter((r.id, r.site, r.severity, r.km) for r in got) == Counter((e[0], s[1], e[3], round(d, 3)) for e, s, d in near() if e[4] != "low" and e[3] >= s[6])
    assert geo.place_pairs(e, s).count() <= 24


def test_city_rows_keep_the_best_of_a_position(spark):
    e, s = geo_frames(spark)
    cities = s.select(F.col("site").alias("city"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"), F.lit(6_000_000).alias("population"))
    rows, made = joined(country.city_rows(e, cities))
    at = {}
    for a in EVENTS:
        for b in SITES:
            if km(a[1], a[2], b[3], b[4]) <= 40:
                at.setdefault(b[1], []).append(a)
    expected = []
    for c, found in at.items():
        some = sorted(found, key=lambda a: (-a[3], a[5], a[0]))[:12]
        expected += [(c, n, a[0]) for n, a in enumerate(sorted(sorted(some, key=lambda a: a[0]), key=lambda a: (a[3], a[5]), reverse=True)[:4], 1)]
    tied = lambda xs: sorted((c, n) for c, n, _ in xs)
    assert tied((r.city, r["rank"], r.id) for r in rows) == tied(expected)
    days = {a[0]: (a[3], a[5]) for a in EVENTS}
    assert sorted((r.city, r["rank"], *days[r.id]) for r in rows) == sorted((c, n, *days[i]) for c, n, i in expected)
    assert made[0] <= 12 * len(SITES)


def test_city_activity_counts_positions(spark):
    e, s = geo_frames(spark)
    expected = Counter((b[2], b[1]) for _, b, _ in near())
    rows, made = joined(geo.city_activity(e, s.withColumnRenamed("site", "city"), "2024-01-31 00:00:00"))
    assert {(r.country, r.city): r.n90 for r in rows} == dict(expected)
    assert made[0] <= len(SITES)


def test_jaccard_links_meet_in_four_tokens(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "abcde" for b in "fgh" for c in "ij"]
    # pairs of frequent words in every list, so that two words in common say little
    lists = sorted({tuple(sorted({"oft", "viel", *r.sample(words, r.randint(3, 10))})) for _ in range(400)})
    lists += [tuple(sorted({*t, "neu"})) for t in lists[:30] if len(t) >= 8]
    x = spark.createDataFrame([(i, list(t)) for i, t in enumerate(lists)], "id long, toks array<string>")
    expected = {(i, j) for i, a in enumerate(lists) for j, b in enumerate(lists) if i < j and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})}
    rows, made = joined(merging.jaccard_links(x))
    assert expected and sorted((r.a, r.b) for r in rows) == sorted(expected)
    assert made[0] <= 30 * len(expected)


def test_story_pairs_shuffle_no_pair(spark):
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "abcdefg" for b in "hkm" for c in "ij"]
    told = [(f"t{i:03d}", r.sample(words, r.randint(1, 9))) for i in range(300)] + [("t007", [words[0], words[1]])]
    x = spark.createDataFrame([(i, " ".join(w)) for i, w in told], "id string, title string")
    df = Counter(w for _, ws in told for w in ws)
    cold = [(i, {w for w in ws if 1 < df[w] <= 35}) for i, ws in told]
    n = Counter()
    for i, a in cold:
        for j, b in cold:
            if i < j:
                n[i, j] += len(a & b)
    rows, written = exchanged(merging.story_pairs(x, 35))
    expected = {k: v for k, v in n.items() if v >= 2}
    assert len(expected) > 300 and {(r.a, r.b): r.shared for r in rows} == expected
    assert max(written, default=0) <= sum(map(len, (w for _, w in told)))


def test_sensor_matches_look_a_place_and_time_up_once(spark):
    e = spark.createDataFrame([(i, "earthquake", "USGS" if i % 2 else "Press", 10.0 + i % 3 / 2, 20.0, 1704067200 + i % 4 * 40000) for i in range(300)], "id long, category string, source string, lat double, lon double, s long").withColumn("date", F.timestamp_seconds("s"))
    rows = [(r.id, r.source, r.lat, r.s) for r in e.collect()]
    expected = {}
    for i, source, lat, s in rows:
        hit = [(round(km(lat, 20.0, b, 20.0), 6), j) for j, other, b, t in rows if other == "USGS" and -6 * 3600 <= s - t <= 72 * 3600 and km(lat, 20.0, b, 20.0) <= 300]
        if source == "Press" and hit:
            expected[i] = (min(hit)[1], round(min(hit)[0], 3))
    got, made = joined(merging.sensor_matches(e))
    assert expected and {r.report: (r.official, r.km) for r in got} == expected
    assert made[0] <= 300


def test_attached_reports_of_many_copies(spark):
    e = spark.createDataFrame([(i, "earthquake", "GDACS" if i < 100 else "Press", 10.0 + i % 2, 20.0, 1 + i % 4) for i in range(300)], "id long, category string, source string, lat double, lon double, severity int").withColumn("date", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got, made = joined(merging.attach_reports(merging.sensor_matches(e), e))
    assert sorted((r.official, r.reports, r.severity) for r in got) == [(0, 100, 2), (1, 100, 3)]
    assert made[0] <= 300


def test_sensor_matches_send_no_side_whole(spark):
    """Every row has its own time; some reports have a record at their place, some only further off, some none."""
    kinds = [("USGS", 10.0), ("Press", 10.0), ("GDACS", 11.0), ("Press", 12.0), ("GDELT", 12.5), ("Press", 40.0), ("EMSC", 13.9)]
    rows = [(i, "earthquake", *kinds[i % 7], 20.0 + i % 3 / 10, 1704067200 + i * 3001 % 1_000_000) for i in range(700)]
    e = spark.createDataFrame(rows, "id long, category string, source string, lat double, lon double, s long").withColumn("date", F.timestamp_seconds("s"))
    expected = {}
    for i, _, source, lat, lon, s in rows:
        hit = [(round(km(lat, lon, b, c), 6), j) for j, _, other, b, c, t in rows if other in ("USGS", "GDACS", "EMSC") and -6 * 3600 <= s - t <= 72 * 3600 and km(lat, lon, b, c) <= 300]
        if source in ("Press", "GDELT") and hit:
            expected[i] = (min(hit)[1], round(min(hit)[0], 3))
    out = merging.sensor_matches(e)
    assert len(expected) > 200 and {r.report: (r.official, r.km) for r in out.collect()} == expected
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_corridors_unfold_their_rows(spark):
    e, s = geo_frames(spark)
    lines = s.selectExpr("concat('r', site_id) AS name", "site_lat AS a_lat", "site_lon AS a_lon", "site_lat + 1 AS b_lat", "site_lon + 1 AS b_lon", "radius_km AS buffer_km")
    flat = e.crossJoin(lines).withColumn("km", segment_km("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon")).where("km <= buffer_km").select("id", "name", F.round("km", 3).alias("km"))
    rows, made = joined(geo.corridor_alerts(e, lines))
    assert len(rows) > 5000 and sorted(rows) == sorted(flat.collect())
    assert made[0] <= 2 * len(EVENTS)  # incidents meet bunches of names
