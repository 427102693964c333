"""Readers on landed files, sinks, and streams against batch answers."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from cairn.operators import analytics
from cairn.sources import readers, sinks
from cairn.streaming import jobs

NOW = "2026-09-30 12:00:00"


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(p)


def feature(props, coords=(10.0, 20.0, 5.0), kind="Point", fid="x1"):
    return {"type": "Feature", "id": fid, "properties": props, "geometry": {"type": kind, "coordinates": coords}}


def test_quakes(spark, tmp_path):
    p = put(tmp_path, "u.json", {"features": [feature({"mag": 6.2, "alert": None, "tsunami": 1, "time": 0, "title": "M 6.2"}), feature({"mag": 5.0, "alert": "red", "tsunami": 1, "time": 0}, fid="y")]})
    assert [(r.id, r.severity, r.lat, r.lon) for r in readers.usgs(spark, p).collect()] == [("usgs-x1", 4, 20.0, 10.0), ("usgs-y", 4, 20.0, 10.0)]
    p = put(tmp_path, "e.json", {"features": [feature({"unid": "a", "mag": 5.1, "evtype": "ke", "time": "2026-01-01T00:00:00Z", "lat": 1.0, "lon": 2.0}), feature({"unid": "b", "evtype": "sm", "mag": 3.0})]})
    assert [r.id for r in readers.emsc(spark, p).collect()] == ["emsc-a"]


def test_disasters(spark, tmp_path):
    p = put(tmp_path, "g.json", {"features": [feature({"eventid": "1", "eventtype": "TC", "alertlevel": "Red", "name": "c", "iso3": "MDG", "fromdate": "2026-01-01T00:00:00"}), feature({"eventid": "2", "eventtype": "DR", "alertlevel": "Green"})]})
    assert [(r.id, r.category, r.severity) for r in readers.gdacs(spark, p).collect()] == [("gdacs-TC1", "cyclone", 4)]
    ev = {"id": "E", "title": "Fire", "link": "l", "categories": [{"id": "wildfires"}], "geometry": [{"date": "2026-01-01T00:00:00Z", "type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}]}
    assert [(r.category, r.lat, r.lon) for r in readers.eonet(spark, put(tmp_path, "eo.json", {"events": [ev]})).collect()] == [("wildfire", 1.0, 1.0)]


def test_coded_news_in_both_widths(spark, tmp_path):
    wide, narrow = [str(i) for i in range(61)], [str(i) for i in range(58)]
    for r, added in ((wide, 59), (narrow, 56)):
        r[1], r[added], r[32], r[33] = "20260101", "20260102", "3", "7"
    wide[56], wide[57], narrow[53], narrow[54] = "1.5", "2.5", "1.5", "2.5"
    got = readers.coded_news(spark, put(tmp_path, "c.tsv", "\n".join("\t".join(x) for x in (wide, narrow, ["short"])))).collect()
    assert [(r.articles, r.lat, r.lon, r.added) for r in got] == [(7, 1.5, 2.5, dt.date(2026, 1, 2))] * 2


def test_conflict_editions(spark, tmp_path):
    head = "id,date_start,latitude,longitude,country,best,type_of_violence,where_description\n"
    a, b = put(tmp_path, "a.csv", head + "1,2025-01-01,1,2,Mali,0,1,x\n2,2025-01-01,1,2,Mali,5,3,y\n"), put(tmp_path, "b.csv", head + "1,2025-01-01,1,2,Mali,25,1,x\n")
    assert sorted((r.id, r.severity, r.category) for r in readers.conflict_csv(spark, [a, b]).collect()) == [("ucdp-1", 4, "armed_conflict"), ("ucdp-2", 3, "attack")]


def test_bulletins_and_alerts(spark, tmp_path):
    p = put(tmp_path, "w.json", {"value": [{"UrlName": "u", "Title": "Ebola virus disease - Democratic Republic of the Congo", "PublicationDate": "2026-01-01T00:00:00Z"}]})
    r = readers.outbreaks(spark, p).first()
    assert (r.country, r.severity) == ("Democratic Republic of the Congo", 3)
    square = [[[0, 0], [2, 0], [2, 2], [0, 2]]]
    p = put(tmp_path, "n.json", {"features": [feature({"event": "Flash Flood Warning", "severity": "Severe", "areaDesc": "A"}, square, "Polygon"), feature({"event": "Flood Watch", "severity": "Severe", "areaDesc": "A"}, square, "Polygon"), feature({"event": "Gale", "severity": "Minor", "areaDesc": "A"}, square, "Polygon")]})
    assert [(r.category, r.severity, r.lat) for r in readers.weather_alerts(spark, p).collect()] == [("flood", 3, 1.0)]
    p = put(tmp_path, "k.json", {"vulnerabilities": [{"cveID": "C1", "vulnerabilityName": "v", "dateAdded": "2026-05-01", "knownRansomwareCampaignUse": "Known"}, {"cveID": "C0", "dateAdded": "2020-01-01"}]})
    assert [(r.id, r.severity) for r in readers.exploited_vulnerabilities(spark, p, "2026-01-01").collect()] == [("kev-C1", 3)]


def test_generic_json(spark, tmp_path):
    p = put(tmp_path, "j.json", {"data": {"rows": [{"k": 1, "t": "x", "pos": {"la": 1.5, "lo": 2}, "sev": "high", "c": "A"}]}})
    r = readers.generic_json(spark, p, "$.data.rows", {"id": "$.k", "title": "$.t", "lat": "$.pos.la", "lon": "$.pos.lo", "severity": "$.sev", "category": "$.c"}, "api", {"A": "attack"}, {"high": 3}).first()
    assert (r.id, r.title, r.lat, r.lon, r.severity, r.category) == ("1", "x", 1.5, 2.0, 3, "attack")


def test_feeds(spark, tmp_path):
    rss = "<rss><channel><item><title>A & B hit town - The Post</title><link>http://x/1</link><pubDate>Wed, 30 Sep 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;A long enough description of what happened in town today&lt;/p&gt;</description></item></channel></rss>"
    r = readers.search_items(readers.feed_items(spark, put(tmp_path, "f.xml", rss))).first()
    assert (r.title, r.outlet, r.link, r.date) == ("A & B hit town", "The Post", "http://x/1", dt.datetime(2026, 9, 30, 10))
    assert r.snippet.startswith("A long enough")
    atom = '<feed><entry><title>T</title><link href="http://x/2"/><updated>2026-09-30T10:00:00Z</updated><summary>short</summary></entry></feed>'
    r = readers.feed_items(spark, put(tmp_path, "a.xml", atom), "entry").first()
    assert (r.title, r.link, r.snippet) == ("T", "http://x/2", None)


def test_advisories(spark, tmp_path):
    p = put(tmp_path, "us.json", [{"Title": "Mali - Level 4: Do Not Travel", "Summary": "<p>Do not travel due to crime, terrorism and kidnapping. More.</p>", "Link": "l", "Updated": "2026-01-01"}, {"Title": "Worldwide caution"}])
    r = readers.us_advisories(spark, p).collect()
    assert [(x.country, x.level, x.reasons) for x in r] == [("Mali", 4, ["crime", "terrorism", "kidnapping"])]
    s = spark.createDataFrame([(["avoid_all_travel_to_parts"],), ([],)], "s array<string>").select(readers.uk_level(F.col("s")).alias("l")).collect()
    assert [tuple(x.l) for x in s] == [(2, True, 4), (1, False, 1)]
    pages = spark.createDataFrame([("a", "formellement x"), ("b", "formellement formellement"), ("c", "formellement raison")], "country string, html string")
    assert sorted(map(tuple, readers.phrase_levels(pages, {"formellement": 4, "raison": 3}).collect())) == [("a", 1), ("b", 4), ("c", 3)]


def test_reference_tables(spark, tmp_path):
    row = lambda i, n, alt, pop, code: "\t".join([i, n, n, alt, "48.8", "2.3", "P", code, "FR", "", "", "", "", "", pop])
    g = readers.gazetteer(spark, put(tmp_path, "g.tsv", "\n".join([row("1", "Paris", "Lutèce,Pariz", "2000000", "PPLC"), row("2", "Paris", "", "20000", "PPL"), row("3", "Hamlet", "", "10", "PPL")])))
    assert {(r["name"], r.population) for r in g.collect()} == {("paris", 2000000), ("lutece", 2000000), ("pariz", 2000000)}
    p = put(tmp_path, "imf.json", {"values": {"g": {"FRA": {"2024": 1.0, "2025": 2.0}}}})
    assert readers.latest_observations(readers.imf(spark, p, "g")).first()[:] == ("FRA", "g", 2025, 2.0)
    p = put(tmp_path, "cl.json", {"unit": "u", "properties": {"parameter": {"PRECTOTCORR": {"202601": 2.0, "202602": -999.0, "202613": 9.0}}}})
    assert readers.gridded_climate(spark, p).first()[:] == ("u", dt.date(2026, 1, 1), "PRECTOTCORR", 62.0)
    p = put(tmp_path, "b.json", {"features": [feature({"shapeName": "Île", "shapeGroup": "FRA"}, [[[0, 0], [1, 0], [1, 1]]], "Polygon"), feature({"shapeName": "Ile", "shapeGroup": "FRA"}, [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]], "MultiPolygon")]})
    got = readers.boundaries(spark, p).collect()
    assert {r.unit for r in got} == {"fra-ile", "fra-ile-2"} and sorted(len(r.rings) for r in got) == [1, 2]
    p = put(tmp_path, "ac.json", {"ac": [{"hex": "a", "lat": 1.0, "lon": 2.0, "alt_baro": "ground", "dbFlags": 1, "squawk": "7700"}, {"hex": "b"}]})
    assert [(r.hex, r.alt, r.mil) for r in readers.aircraft(spark, p).collect()] == [("a", 0, True)]


def events(spark, n=200):
    return spark.range(n).select("id", (F.lit("2026-08-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("date"), F.concat(F.lit("c"), F.col("id") % 3).alias("country"), F.lit("attack").alias("category"), (F.col("id") % 4 + 1).cast("int").alias("severity"), F.lit("high").alias("confidence"), F.lit(False).alias("is_auto"))


def test_store_and_archive(spark, tmp_path):
    a = events(spark, 10).withColumn("first_seen", F.col("date"))
    b = events(spark, 20).withColumn("severity", F.lit(4)).withColumn("first_seen", F.lit(NOW).cast("timestamp"))
    m = sinks.merge_store(a, b, NOW)
    assert m.count() == 20 and m.where("severity < 4").count() == 0 and m.where(f"first_seen < TIMESTAMP '{NOW}'").count() == 10
    assert sinks.merge_store(a, b, NOW, 1).count() == 0
    n = sinks.write_archive(events(spark), str(tmp_path / "ar"), NOW)
    assert sum(r.n for r in n.collect()) == 200
    one = sinks.changed_keys(a, spark.createDataFrame([], "country string, hash long"), "country")
    assert one.count() == 3 and sinks.changed_keys(a, one, "country").count() == 0 and sinks.changed_keys(a.where("id <> 0"), one, "country").count() == 1
    assert json.loads(sinks.geojson(events(spark, 1).withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(2.0))).first().value)["geometry"]["coordinates"] == [2.0, 1.0]
    assert not sinks.save_part(a.limit(0), str(tmp_path / "p")) and sinks.save_part(a, str(tmp_path / "p"))
    assert sinks.live_and_history(a, a, "2026-08-01 05:00:00").count() == 10


def test_stream_equals_batch(spark, tmp_path):
    e = events(spark)
    for i in range(4):
        e.where(F.floor(F.col("id") / 50) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    stream = jobs.daily_counts(jobs.pickup(spark, str(tmp_path / "in"), e.schema, 1))
    jobs.run_available(stream, str(tmp_path / "ck"), lambda b, i: got.extend(map(tuple, b.collect())))
    want = {(r.day, r.country): (r.n, r.severe) for r in e.groupBy(F.col("date").cast("date").alias("day"), "country").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 3).alias("severe")).collect()}
    assert got and all(want[d, c] == (n, s) for d, c, n, s in got) and len(set(got)) == len(got)


def test_upsert_and_notify_once(spark, tmp_path):
    e = events(spark, 30)
    for _ in range(2):
        e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = lambda: jobs.pickup(spark, str(tmp_path / "in"), e.schema, 1)
    jobs.run_available(src(), str(tmp_path / "c1"), jobs.upsert_into(str(tmp_path / "store"), NOW))
    assert spark.read.parquet(str(tmp_path / "store/epoch=1")).count() == 30
    seen = []
    jobs.run_available(jobs.notify_once(src()), str(tmp_path / "c2"), lambda b, i: seen.extend(r.id for r in b.collect()))
    assert len(seen) == len(set(seen))


def test_cool_down_and_breaker(spark, tmp_path):
    e = spark.range(20).select(F.lit("ML").alias("country"), (F.lit("2026-08-01 00:00:00").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("date"))
    e.coalesce(1).write.parquet(str(tmp_path / "a"))
    got = []
    jobs.run_available(jobs.cooled_down(jobs.pickup(spark, str(tmp_path / "a"), e.schema)), str(tmp_path / "c"), lambda b, i: got.extend(r.date.day for r in b.collect()))
    assert sorted(got) == [1, 6, 11, 16]
    r = spark.range(10).select(F.lit("s").alias("source"), (F.lit("2026-08-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int") * 6)).alias("at"), F.lit(False).alias("ok"))
    r.coalesce(1).write.parquet(str(tmp_path / "r"))
    skipped = []
    jobs.run_available(jobs.circuit_breaker(jobs.pickup(spark, str(tmp_path / "r"), r.schema)), str(tmp_path / "d"), lambda b, i: skipped.extend(x.skipped for x in b.orderBy("at").collect()))
    assert skipped == [False, False, False, True, True, True, False, False, False, True]


def test_late_facts_and_retention(spark):
    x = spark.createDataFrame([(dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 3)), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 9))], "date timestamp, added timestamp")
    assert jobs.timely(x).count() == 1
    k = spark.createDataFrame([("log", dt.datetime(2026, 9, 1)), ("log", dt.datetime(2026, 1, 1)), ("other", dt.datetime(2020, 1, 1))], "kind string, date timestamp")
    assert jobs.retained(k, {"log": 90}, NOW).count() == 2


def test_filters(spark):
    assert events(spark).where(analytics.conjunction(countries=["c1"], min_severity=4)).count() == len([i for i in range(200) if i % 3 == 1 and i % 4 == 3])


def test_kept_reports(spark):
    kind = "id string, date timestamp, title string"
    day = lambda n: dt.datetime(2026, 9, 30, 12) - dt.timedelta(days=n)
    stored = spark.createDataFrame([("a", day(3), "old"), ("b", day(3), "b"), ("c", day(400), "c"), ("d", day(365), "d")], kind)
    new = spark.createDataFrame([("a", day(1), "new"), ("a", day(2), "x"), ("e", day(3), "e"), ("f", day(366), "f")], kind)
    got = readers.kept_reports(stored, new, "2026-09-30 12:00:00")
    assert [(r["id"], r["title"]) for r in got.collect()] == [("a", "new"), ("b", "b"), ("e", "e"), ("d", "d")]
    assert [r["id"] for r in readers.kept_reports(stored, new, "2026-09-30 12:00:00", most=2).collect()] == ["a", "b"]
    assert readers.kept_reports(stored.limit(0), new.limit(0), "2026-09-30 12:00:00").count() == 0
