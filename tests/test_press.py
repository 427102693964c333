"""Headline reasons, location, alerts, assembled rows and the remaining readers."""

from __future__ import annotations

import datetime as dt
import json


from cairn.operators import press
from cairn.sources import readers

NOW = "2026-09-30 12:00:00"


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(p)


def test_reasons(spark):
    titles = ["Gunmen attack village, 12 killed", "Heart attack kills singer", "Ten years after the bomb attack", "Police arrest man over bomb", "Nothing", None]
    x = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {r.id: r for r in press.judged_titles(x).collect()}
    assert [got[i].event for i in range(6)] == [True, False, False, False, False, False]
    assert got[0].severity == 3 and got[2].reason is not None and got[3].context == "arrest"


def gaz(spark):
    return spark.createDataFrame([("ML", "gao", "Gao", 16.2, 0.0, 86000), ("ML", "bamako", "Bamako", 12.6, -8.0, 2400000), ("JP", "tokyo", "Tokyo", 35.7, 139.7, 13000000)], "country string, name string, place string, lat double, lon double, population long")


def test_location(spark):
    t = spark.createDataFrame([(1, "Blast in Gao, Mali", "FR"), (2, "Fire in Tokyo", None), (3, "Riot in Gao", "ML"), (4, "No place", None)], "id long, title string, hint string")
    a = spark.createDataFrame([("mali", "ML")], "alias string, country string")
    got = {r.id: r for r in press.locate_titles(t, a, gaz(spark)).collect()}
    assert [(got[i].country, got[i].place) for i in (1, 2, 3, 4)] == [("ML", "Gao"), ("JP", "Tokyo"), ("ML", "Gao"), (None, None)]
    loc = spark.createDataFrame([(1, "ML", None, 16.0, 0.1), (2, "ML", None, 12.0, -8.0)], "id long, country string, place string, lat double, lon double")
    s = spark.createDataFrame([(1, "seen near Gao"), (2, "seen near Gao")], "id long, snippet string")
    assert {r.id: r.place for r in press.refined(loc, s, gaz(spark)).collect()} == {1: "Gao", 2: None}


def test_spread_labels_and_lists(spark):
    r = spark.createDataFrame([(1, "M 6.1 quake"), (1, "magnitude 5.4 hits"), (2, "M 5.0"), (2, "no number")], "id long, title string")
    assert [tuple(x) for x in press.magnitude_spread(r).collect()] == [(1, 5.4, 6.1)]
    assert spark.createDataFrame([(["a", "b", "a", "c", "d"],)], "s array<string>").select(press.source_label("s").alias("l")).first().l == "a, b, c +1"
    assert press.health_lists(spark.createDataFrame([("malaria", "ML"), ("cholera", "ML")], "list string, country string")).first().risks == ["cholera", "malaria"]
    h, live = (spark.createDataFrame([(d, n)], "month date, n int") for d, n in ((dt.date(2026, 1, 1), 1), (dt.date(2026, 5, 1), 2)))
    assert press.backfilled(h.unionByName(live), live.unionByName(h), "2026-03-01").count() == 2


def test_cities_and_providers(spark):
    c = spark.createDataFrame([("ML", "Gao")], "country string, city string")
    s = spark.createDataFrame([("ML", 0, "Visit Gao."), ("ML", 1, "Kidnap and attack risk in Gao."), ("ML", 2, "Elsewhere")], "country string, pos int, sentence string")
    assert [r.sentence for r in press.city_sentences(c, s).orderBy("rank").collect()] == ["Kidnap and attack risk in Gao.", "Visit Gao."]
    p = spark.createDataFrame([(1, ["ML"], None, ["afr"]), (2, None, "ML", []), (3, None, "FR", ["afr"]), (4, ["TD"], "FR", ["afr"])], "provider_id long, countries array<string>, base string, regions array<string>")
    assert sorted(r.provider_id for r in press.covering_providers(p, "ML", "afr").collect()) == [1, 2, 3]


def test_more_readers(spark, tmp_path):
    w = {"country": "FR", "type": "rain", "level": "orange", "status": "Actual", "sent": "2026-09-30T00:00:00", "onset": "2026-09-30T10:00:00", "expires": "2026-10-01T00:00:00", "areas": ["A"]}
    p = put(tmp_path, "m.json", {"warnings": [w, w | {"areas": ["B"], "expires": "2026-10-02T00:00:00"}, w | {"status": "Cancel"}, w | {"type": "fog"}, w | {"areas": ["West coast"]}, w | {"expires": "2026-09-01T00:00:00"}]})
    (r,) = readers.european_warnings(spark, p, NOW).collect()
    assert (r.areas, r.category, r.severity, r.expires) == (["A", "B"], "flood", 3, dt.datetime(2026, 10, 2))
    p = put(tmp_path, "a.json", {"data": [{"event_id_cnty": "X1", "event_date": "2026-01-01", "event_type": "Riots", "fatalities": "12", "latitude": "1", "longitude": "2", "country": "Mali"}]})
    assert [(x.category, x.severity) for x in readers.conflict_api(spark, p).collect()] == [("unrest", 4)]
    p = put(tmp_path, "c.json", {"data": {"ML": {"country-iso": "ML", "advisory-state": 3}}})
    assert readers.ca_advisories(spark, p).first()[:] == ("ML", 4, 4)
    pages = spark.createDataFrame([("ML", "<h2>Safety</h2><p>Call +223 20 22 30 13 now</p><h3>Cookies</h3>x<h2>Entry</h2><ul><li>visa</li></ul>")], "country string, html string")
    got = readers.advisory_sections(pages).orderBy("pos").collect()
    assert [(r.heading, r.depth) for r in got] == [("Safety", 2), ("Entry", 2)] and got[0].phones == ["+223 20 22 30 13"]
    items = spark.createDataFrame([("Tropical Storm Ana advisory 2 - Madagascar", "near 12.5S 45.0E warning", "l2", dt.datetime(2026, 1, 2)), ("Tropical Storm Ana advisory 1 - Madagascar", "near 11.0S 46.0E", "l1", dt.datetime(2026, 1, 1)), ("Summary", "none", "l0", dt.datetime(2026, 1, 1))], "title string, snippet string, link string, date timestamp")
    (r,) = readers.official_bulletins(items, "storm", "summary", {"storm": "cyclone"}, r"storm (\w+)").collect()
    assert (r.category, r.severity, r.lat, r.lon, r.tail) == ("cyclone", 3, -12.5, 45.0, "Madagascar")
    p = put(tmp_path, "p.json", {"projects": {"P1": {"countryshortname": "Mali", "project_name": "Road", "totalamt": "1,000"}}})
    assert readers.projects(spark, p).first().amount == 1000.0
    h = spark.createDataFrame([("ML", dt.date(2026, 1, 1), "New Year")], "country string, d date, title string")
    assert [r.type for r in readers.calendar_entries(h, h.limit(0), h).collect()] == ["own"]


def test_alerts_sent_once(spark):
    e = spark.createDataFrame([(1, "ML", "attack", 4, "high", False, dt.datetime(2026, 9, 30, 11)), (2, "ML", "attack", 4, "low", False, dt.datetime(2026, 9, 30, 11)), (3, "ML", "attack", 4, "high", False, dt.datetime(2026, 9, 30, 1)), (4, "ML", "attack", 4, "high", True, dt.datetime(2026, 9, 30, 11))], "id long, country string, category string, severity int, confidence string, is_auto boolean, date timestamp")
    assert [r.id for r in press.alert_rows(e, e.limit(0), NOW, include_auto=False).collect()] == [1]
    assert [r.id for r in press.alert_rows(e, e.where("id = 1"), NOW).collect()] == [4]


def test_hidden(spark):
    x = spark.createDataFrame([("GDELT", "D", 1), ("GDELT", "D", 2), ("Press", "E", 1)], "source string, letter string, outlets int")
    assert [r[0] for r in x.select(press.hidden_when_reliable("source", "letter", "outlets")).collect()] == [True, False, False]
