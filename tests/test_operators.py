"""Operators on small frames: the cases of the rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.operators import analytics, country, early_warning, geo, graph, indices, merging, quality, text

NOW = "2026-09-30 12:00:00"
T = dt.datetime(2026, 9, 30, 12)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_distances(spark):
    r = one(spark, X.haversine_km(F.lit(48.85), F.lit(2.35), F.lit(51.5), F.lit(-0.12)).alias("a"), X.segment_km(F.lit(0.0), F.lit(5.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(10.0)).alias("b"), X.segment_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("c"))
    assert 340 < r.a < 346 and abs(r.b - 111.19) < 0.5 and abs(r.c - 111.19) < 0.5


def test_ladders_and_levels(spark):
    r = one(spark, X.level_of(F.lit(0.55)).alias("a"), X.activity(F.lit(150.0)).alias("b"), X.activity(F.lit(None).cast("double")).alias("c"), *(X.severity_of_deaths(F.lit(n)).alias(f"d{n}") for n in (0, 1, 5, 25)))
    assert (r.a, r.b, r.c, r.d0, r.d1, r.d5, r.d25) == (4, 1.0, 0.0, 1, 2, 3, 4)


def test_hijri(spark):
    r = one(spark, X.hijri_to_date(F.lit(1446), F.lit(9), F.lit(1)).alias("d"))
    assert abs((r.d - dt.date(2025, 3, 1)).days) <= 1


def test_text_rules(spark):
    r = one(spark, X.fold(F.lit("Éléphant ÇÀ")).alias("f"), X.domain(F.lit("https://www.News.example.com/a?b")).alias("d"), text.toll(F.lit("In 2024, 12 killed and 40 injured")).alias("t"), text.classify(F.lit("Gunmen attack village")).alias("c"), text.classify(F.lit("Bomb scene in new movie")).alias("n"), text.guess_language(F.lit("le chat est dans la maison et il dort")).alias("l"), text.guess_language(F.lit("Привет мир")).alias("s"), X.story_tokens(F.lit("The bomb and the Bomb in Zürich market")).alias("k"))
    assert (r.f, r.d, r.t, r.c, r.n, r.l, r.s) == ("elephant ca", "news.example.com", 40, "attack", None, "fr", "ru")
    assert r.k == ["bomb", "zurich", "market"]


def test_snippet(spark):
    assert one(spark, text.snippet(F.lit("<p>Title here</p> and &amp; more  text"), F.lit("Title here")).alias("s")).s == "and & more text"


def incident(spark, data):
    return spark.createDataFrame(data, "id long, source string, category string, grp string, severity int, confidence string, is_auto boolean, date timestamp, country string, lat double, lon double, place string, value double")


def ev(i, hours=1, country="ML", category="attack", grp="security", severity=3, source="Press", confidence="high", auto=False, lat=12.65, lon=-8.0, place="Bamako"):
    return (i, source, category, grp, severity, confidence, auto, T - dt.timedelta(hours=hours), country, lat, lon, place, 10.0)


def test_country_risk_floor_and_outer_join(spark):
    adv = spark.createDataFrame([("ML", "a", 4, 4), ("FR", "a", 1, 4)], "country string, source string, level int, scale int")
    got = {r.country: r for r in indices.country_risk(incident(spark, [ev(1), ev(2, category="diplomatic", grp="diplomatic"), ev(3, country="TD", severity=4)]), adv, NOW).collect()}
    assert got["ML"].level >= 4 and got["ML"].n_security == 1
    assert got["FR"].level == 1 and got["FR"].data_quality == "advisories+events"
    assert got["TD"].data_quality == "events-only" and got["TD"].advisories is None


def test_empty_inputs(spark):
    none = incident(spark, [])
    adv = spark.createDataFrame([], "country string, source string, level int, scale int")
    assert indices.country_risk(none, adv, NOW).count() == 0
    assert analytics.country_stats(none, NOW).count() == 0
    assert merging.crises(none, NOW).count() == 0


def test_recent_level_changes(spark):
    day = lambda n: dt.date(2026, 9, 30) - dt.timedelta(days=n)
    seen = [("A", "x", day(60 - i), i % 2 + 1) for i in range(0, 31)]  # the last of these changes is just in time
    seen += [("A", "y", day(n), lv) for n, lv in ((9, 1), (8, 2), (7, None), (6, 2), (5, 3), (4, 3), (3, 1), (2, 2))]
    seen += [("A", "z", day(3), 1), ("A", "z", day(2), 4), ("B", "x", day(1), 3), ("C", "x", day(40), 1), ("C", "x", day(31), 2)]
    levels = spark.createDataFrame(seen, "country string, source string, day date, level int")
    got = indices.recent_level_changes(levels, NOW)
    assert [tuple(r) for r in got.orderBy("country", "rank").collect()] == [
        ("A", "z", day(2), 1, 4, 1), ("A", "y", day(2), 1, 2, 2), ("A", "y", day(3), 3, 1, 3), ("A", "y", day(5), 2, 3, 4),
    ]
    assert [r["day"] for r in indices.recent_level_changes(levels.where("source = 'x'"), NOW).collect()] == [day(30)]
    assert indices.recent_level_changes(levels.limit(0), NOW).count() == 0


def test_streaks(spark):
    r = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([True, False, False, True, False])], "source string, run int, ok boolean")
    assert rows(indices.failure_streaks(r)) == [("a", 2, 1)]


def test_crisis(spark):
    got = merging.crises(incident(spark, [ev(1, 60), ev(2, 30), ev(3, 1), ev(4, 1, country="FR"), ev(5, 1, lat=40.0)]), NOW).collect()
    assert len(got) == 1 and (got[0].n, got[0].days, got[0].status) == (3, 3, "active")


def test_sessions(spark):
    got = indices.sessions(incident(spark, [ev(1, 200), ev(2, 100), ev(3, 90)]), ["country"]).collect()
    assert sorted(r.n for r in got) == [1, 2]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(graph.connected(e).collect())
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_locate_holes_and_nudges(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    poly = spark.createDataFrame([("u", [p((0, 0), (4, 0), (4, 4), (0, 4)), p((1, 1), (2, 1), (2, 2), (1, 2))])], "unit string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 9.0, 9.0), (4, 2.0, 4.1)], "id long, lat double, lon double")
    assert rows(geo.locate(pts, poly)) == [(1, "u")]
    assert {r.id for r in geo.locate_nudged(pts, poly).collect()} == {1, 4}


def test_radius_over_the_date_line(spark):
    s = spark.createDataFrame([("s", 0.0, 179.9, 50.0, 1)], "site string, site_lat double, site_lon double, radius_km double, min_severity int")
    got = geo.site_alerts(incident(spark, [ev(1, lat=0.0, lon=-179.9), ev(2, lat=0.0, lon=-178.0), ev(3, lat=0.0, lon=179.8, confidence="low")]), s)
    assert [r.id for r in got.collect()] == [1]


def test_unit_region(spark):
    u = spark.createDataFrame([("a", "FR", 46.0, 2.0), ("b", "FR", 4.0, -53.0)], "unit string, country string, lat double, lon double")
    r = spark.createDataFrame([("eu", ["FR"], 1, -10.0, 35.0, 20.0, 60.0), ("sa", ["BR"], 2, -80.0, -50.0, -30.0, 12.0)], "region_id string, countries array<string>, rank int, x0 double, y0 double, x1 double, y1 double")
    assert rows(geo.unit_region(u, r)) == [("a", "eu"), ("b", "sa")]


def test_stories(spark):
    t = spark.createDataFrame([(1, "Seven killed as gunmen open fire at church"), (2, "Seven killed as gunmen open fire at church today"), (3, "Nothing in common here")], "id long, title string")
    assert sorted((r.a, r.b, r.rule) for r in merging.similar_titles(t).collect()) == [(1, 2, "jaccard")]
    assert merging.exact_titles(spark.createDataFrame([(1, "A  story!"), (2, "a story"), (3, "")], "id long, title string")).collect()[0][1:] == (1, 2)


def test_story_links_and_merge(spark):
    x = incident(spark, [ev(1), ev(2, 30), ev(3, 200)]).withColumn("title", F.element_at(F.create_map(F.lit(1), F.lit("blast hits central market kills nine"), F.lit(2), F.lit("blast hits central market kills ten"), F.lit(3), F.lit("blast hits central market kills nine")), F.col("id").cast("int")))
    links = merging.story_links(x)
    assert rows(links) == [(1, 2)]
    m = merging.merge_groups(x, graph.connected(links))
    assert sorted((r.base, r.n) for r in m.collect()) == [(1, 2), (3, 1)]


def test_independence(spark):
    d = [(1, f"https://{h}/x", t) for h, t in (("a.com", "one"), ("www.a.com", "two"), ("b.com", "A long headline of an agency story"), ("c.com", "A long headline of an agency story"))]
    assert rows(merging.independence(spark.createDataFrame(d, "id long, url string, title string"))) == [(1, 3, 2, 1)]


def test_sensor(spark):
    quake = dict(category="earthquake", grp="natural")
    x = incident(spark, [ev(1, 10, source="GDACS", severity=2, **quake), ev(2, 5, severity=4, **quake), ev(3, 5, lat=40.0, **quake)])
    m = merging.sensor_matches(x)
    assert [(r.report, r.official) for r in m.collect()] == [(2, 1)]
    assert merging.attach_reports(m, x).collect()[0][:] == (1, 1, 3)


def test_sensor_window(spark):
    from datetime import datetime, timedelta

    at = datetime(2026, 3, 1, 12)
    cases = [("earthquake", "earthquake", 72, 6, 2.6, 2.8), ("cyclone", "storm", 120, 48, 8.0, 8.2), ("volcano", "volcano", 336, 48, 1.3, 1.4)]
    for report, official, after, before, near, far in cases:
        told = [(1, after, 0.0), (2, after + 1, 0.0), (3, -before, 0.0), (4, -before - 1, 0.0), (5, 24, near), (6, 24, far)]
        rows_ = [(0, official, "NASA EONET", at, 10.0, 179.9, "t", 2)] + [(i, report, "Press", at + timedelta(hours=h), 10.0 + up, -179.9, "a quake of M 6.1", 2) for i, h, up in told] + [(9, report, "WHO", at, 10.0, 179.9, "t", 2), (10, report, "Press", at, None, None, "t", 2)]
        x = spark.createDataFrame(rows_, "id long, category string, source string, date timestamp, lat double, lon double, title string, severity int")
        m = merging.sensor_matches(x)
        assert sorted((r.report, r.official) for r in m.collect()) == [(1, 0), (3, 0), (5, 0)], report
        if report == "earthquake":
            assert sorted(r.id for r in merging.unconfirmed_quakes(x, m).collect()) == [2, 4, 6]


def test_denials(spark):
    e = spark.createDataFrame([(1, "army base stormed near capital", T)], "id long, title string, date timestamp")
    c = spark.createDataFrame([(7, "army denies base stormed near capital", T), (8, "weather stays fine", T)], "id long, title string, date timestamp")
    assert rows(merging.denials(e, c)) == [(1, 7)]


def test_canonical_and_sanity(spark):
    raw = spark.createDataFrame([(1, 9, "nope", 1.23456, 2.0, " t ", None)], "id long, severity int, category string, lat double, lon double, title string, confidence string")
    r = quality.canonical(raw).first()
    assert (r.severity, r.category, r.lat, r.title, r.confidence) == (4, "other", 1.2346, "t", "high")
    x = spark.createDataFrame([(None, 1.0, "t", "attack", T), (95.0, 1.0, "t", "attack", T), (0.0, 0.0, "t", "attack", T), (1.0, 1.0, " ", "attack", T), (1.0, 1.0, "t", "attack", T + dt.timedelta(hours=5)), (1.0, 1.0, "t", "flood", T + dt.timedelta(hours=5))], "lat double, lon double, title string, category string, date timestamp")
    assert [r[0] for r in x.select(quality.insane(NOW)).collect()] == ["no position", "out of range", "null island", "no title", "future", None]


def test_overlay(spark):
    e = spark.createDataFrame([(1, 2, "attack", "low", [5]), (2, 2, "attack", "low", None)], "id long, severity int, category string, confidence string, merged array<bigint>")
    d = spark.createDataFrame([(5, "verified", 4, None), (2, "false", None, None)], "event_id long, decision string, new_severity int, new_category string")
    assert rows(quality.overlay(e, d)) == [(1, 4, "attack", "high")]


def test_changed_only(spark):
    x = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    first = quality.changed_only(x, spark.createDataFrame([], "id long, sig string"), "v1", ["title"])
    assert first.count() == 2 and quality.changed_only(x, first, "v1", ["title"]).count() == 0 and quality.changed_only(x, first, "v2", ["title"]).count() == 2


def test_coded_events(spark):
    d = dt.date(2026, 9, 1)
    raw = [("P", "ML", "190", "19", d, d, 3, f"http://s{i}.com/a", f"A{i}") for i in range(2)] + [("P", "FR", "190", "19", d, d, 3, f"http://s{i}.com/a", "A") for i in range(2)] + [("P", "ML", "192", "19", d, d, 99, "http://x.com", "A"), ("P", "ML", "190", "19", d, d + dt.timedelta(days=9), 99, "http://x.com", "A")]
    x = spark.createDataFrame(raw, "place string, country string, code string, root string, day date, added date, articles int, url string, actor string")
    adv = spark.createDataFrame([("ML", 4)], "country string, level int")
    got = quality.coded_events(x, adv).collect()
    assert [(r.country, r.articles, r.domains, r.category) for r in got] == [("ML", 6, 2, "armed_conflict")]


def test_robots(spark):
    u = spark.createDataFrame([(1, "https://a.com/private/x"), (2, "https://a.com/private/ok"), (3, "https://b.com/z.pdf"), (4, "https://c.com/")], "id long, url string")
    r = spark.createDataFrame([("a.com", "*", "disallow", "/"), ("a.com", "bot", "disallow", "/private"), ("a.com", "bot", "allow", "/private/ok"), ("b.com", "*", "disallow", "/*.pdf$")], "host string, agent string, kind string, pattern string")
    assert rows(quality.url_permission(u, r, "bot")) == [(1, False), (2, True), (3, False), (4, True)]


def test_mentions(spark):
    t = spark.createDataFrame([(1, "South Sudan and Sudan talk to Chad")], "id long, title string")
    a = spark.createDataFrame([("south sudan", "SS"), ("sudan", "SD"), ("chad", "TD")], "alias string, country string")
    assert rows(text.mentions(t, a)) == [(1, "SD", 3), (1, "SS", 0), (1, "TD", 6)]


def test_match_admin(spark):
    n = spark.createDataFrame([(1, "ML", "Tombouctou"), (2, "ML", "Tombuktou"), (3, "ML", "Zzz")], "id long, country string, name string")
    u = spark.createDataFrame([("ML", "Tombouctou"), ("ML", "Gao")], "country string, unit string")
    assert rows(text.match_admin(n, u)) == [(1, "Tombouctou", 1), (2, "Tombouctou", 4)]


def test_pressure_and_scores(spark):
    s = spark.createDataFrame([("a", 10), ("a", 5)], "scope string, score int")
    assert rows(early_warning.pressure(s)) == [("a", 30)]
    assert one(spark, X.score_grid(F.lit(4), [F.lit(4), F.lit(2)]).alias("s")).s == 16


def test_trend_validation(spark):
    t = spark.createDataFrame([("t", 4, 4, "short", ["s1", "s2"], dt.date(2026, 1, 1)), ("u", 9, 4, "x", ["s1", "zz"], dt.date(2027, 1, 1))], "trend_id string, likelihood int, impact int, horizon string, sources array<string>, reviewed date")
    s = spark.createDataFrame([("s1", "p1", "B"), ("s2", "p2", "A")], "source_id string, publisher string, grade string")
    got = rows(early_warning.validate_trends(t, s, NOW))
    assert {e for i, e in got if i == "u"} == {"likelihood", "horizon", "publishers", "unknown source", "review in the future"} and not [e for i, e in got if i == "t"]


def test_flags_and_providers(spark):
    i = spark.createDataFrame([("DE", "yield", 2025, 2.0), ("IT", "yield", 2025, 4.0), ("IT", "growth", 2024, -1.0), ("IT", "growth", 2025, 1.0)], "country string, key string, year int, value double")
    assert dict(country.structural_flags(i).collect())["IT"] == ["spread"]
    crit = [c for c in country.PROVIDER_WEIGHTS if c not in ("licence", "insurance")]
    p = spark.createDataFrame([(1, *([True] * len(crit)))], "provider_id long, " + ", ".join(f"{c} boolean" for c in crit))
    d = spark.createDataFrame([(1, "licence", "accepted", None), (1, "insurance", "accepted", None)], "provider_id long, kind string, status string, expires_on date")
    assert rows(country.provider_scores(p, d, NOW)) == [(1, 88, 1)]


def test_safety_checks(spark):
    c = spark.createDataFrame([(1, "o", "country", "ML", None)], "check_id long, org string, scope string, country string, circle string")
    p = spark.createDataFrame([(1, "o", "ML", None, None, None), (2, "o", "FR", "FR", ["ML"], None), (3, "x", "ML", None, None, None), (4, "o", "FR", None, None, None)], "profile_id long, org string, country string, base string, travel array<string>, circles array<string>")
    t = country.audience(c, p)
    assert rows(t) == [(1, 1), (1, 2)]
    r = spark.createDataFrame([(1, 1, "help", T), (1, 1, "safe", T + dt.timedelta(hours=1))], "check_id long, profile_id long, status string, at timestamp")
    assert rows(country.check_tally(t, r)) == [(1, 0, 1, 1)] and rows(country.unanswered(t, r)) == [(1, 2)]


def test_cities(spark):
    p = spark.createDataFrame([("FR", "Paris", 48.85, 2.35, 2000000, True, False), ("FR", "Near", 48.9, 2.4, 900000, False, False), ("FR", "Lyon", 45.76, 4.84, 500000, False, False)], "country string, place string, lat double, lon double, population long, capital boolean, tracked boolean")
    assert [r.place for r in country.select_cities(p).orderBy("rank").collect()] == ["Paris", "Lyon"]


def test_go_no_go(spark):
    a = ", ".join(f"a{i} boolean" for i in range(1, 10))
    m = spark.createDataFrame([(1, 5, 4, 1, *([False] * 9)), (2, 1, 0, 0, *([True] * 9))], f"mission long, level int, severe_near int, entries int, {a}")
    assert [(r.mission, r.code) for r in country.go_no_go(m).orderBy("mission").collect()] == [(1, "no-go"), (2, "go")]


@pytest.mark.parametrize("dead,level", [(5, 2), (10, 3), (50, 4)])
def test_title_severity(spark, dead, level):
    assert one(spark, text.title_severity(F.lit(f"{dead} killed in raid")).alias("s")).s == level


def test_ngrams_of_some_lengths(spark):
    from cairn.operators import text

    x = spark.createDataFrame([(1, " Ça va, bien? "), (2, "one"), (3, ""), (4, None), (5, "..."), (6, "a-b")], "id long, title string")
    got = sorted(tuple(r) for r in text.ngrams(x, 2, 2).collect())
    assert got == [(1, 0, 2, "ca va"), (1, 1, 2, "va bien"), (6, 0, 2, "a b")]
    both = sorted(tuple(r) for r in text.ngrams(x, 2).collect())
    assert both == sorted([*got, (1, 0, 1, "ca"), (1, 1, 1, "va"), (1, 2, 1, "bien"), (2, 0, 1, "one"), (6, 0, 1, "a"), (6, 1, 1, "b")])
