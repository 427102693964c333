"""Landed raw files to canonical rows. Each reader takes a path that Spark can read; nothing is fetched.

Incident readers give id, source, category, severity, title, date, lat, lon, country (name or code as delivered, may be null), url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.exprs import ladder, lookup
from cairn.operators.text import snippet, unescape

INCIDENT = ("id", "source", "category", "severity", "title", "date", "lat", "lon", "country", "url")


def incident(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The canonical columns; those not given are null."""
    kinds = {"severity": "int", "date": "timestamp", "lat": "double", "lon": "double"}
    return df.select(*((columns.get(c, F.lit(source) if c == "source" else F.lit(None)).cast(kinds.get(c, "string"))).alias(c) for c in INCIDENT))


def millis(c: str) -> Column:
    return F.timestamp_millis(F.col(c).cast("long"))


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files with the given property fields; geometry as coordinates text."""
    schema = f"features array<struct<id:string, properties:struct<{properties}>, geometry:struct<type:string, coordinates:string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"))


def point(i: int) -> Column:
    """Longitude (0), latitude (1) or depth (2) of a point's coordinates text."""
    return F.get(F.from_json("coordinates", "array<double>"), F.lit(i))


def usgs(spark: SparkSession, path: str) -> DataFrame:
    """Earthquakes; severity from the alert colour, else magnitude 5, 6, 7; one more with a tsunami, 4 at most."""
    x = features(spark, path, "mag:double, place:string, time:long, alert:string, tsunami:int, url:string, title:string")
    base = F.coalesce(lookup("alert", {"green": 1, "yellow": 2, "orange": 3, "red": 4}, None), ladder("mag", [(7, 4), (6, 3), (5, 2)], 1))
    return incident(x, "USGS", id=F.concat(F.lit("usgs-"), "id"), category=F.lit("earthquake"), severity=F.least(F.lit(4), base + F.when(F.col("tsunami") == 1, 1).otherwise(0)), title=F.col("title"), date=millis("time"), lat=point(1), lon=point(0), url=F.col("url"))


def emsc(spark: SparkSession, path: str) -> DataFrame:
    """A second network; only natural quakes (event type ke or se)."""
    x = features(spark, path, "unid:string, time:string, lat:double, lon:double, mag:double, magtype:string, evtype:string, flynn_region:string").where(F.col("evtype").isin("ke", "se"))
    return incident(x, "EMSC", id=F.concat(F.lit("emsc-"), "unid"), category=F.lit("earthquake"), severity=ladder("mag", [(7, 4), (6, 3), (5, 2)], 1), title=F.concat_ws(" ", F.lit("M"), F.col("mag").cast("string"), "flynn_region"), date=F.try_to_timestamp("time"), lat=F.col("lat"), lon=F.col("lon"))


#: Event types of the disaster feed.
DISASTERS = {"EQ": "earthquake", "TC": "cyclone", "FL": "flood", "VO": "volcano", "DR": "drought", "WF": "wildfire"}


def gdacs(spark: SparkSession, path: str, least: dict[str, int] | None = None) -> DataFrame:
    """Disaster alerts; severity from the colour; categories may have a least severity."""
    x = features(spark, path, "eventid:string, eventtype:string, alertlevel:string, name:string, iso3:string, fromdate:string, url:struct<report:string>")
    x = x.withColumn("category", lookup("eventtype", DISASTERS, "other")).withColumn("severity", lookup(F.lower("alertlevel"), {"green": 2, "orange": 3, "red": 4}, 1))
    x = x.where(F.col("severity") >= lookup("category", least or {"drought": 3}, 1))
    return incident(x, "GDACS", id=F.concat(F.lit("gdacs-"), "eventtype", "eventid"), category=F.col("category"), severity=F.col("severity"), title=F.col("name"), date=F.try_to_timestamp("fromdate"), lat=point(1), lon=point(0), country=F.col("iso3"), url=F.col("url.report"))


def eonet(spark: SparkSession, path: str) -> DataFrame:
    """Natural events with a track: the last geometry is the position (a polygon's vertices are averaged), knots give the severity."""
    schema = "events array<struct<id:string, title:string, link:string, categories:array<struct<id:string>>, geometry:array<struct<date:string, type:string, magnitudeValue:double, magnitudeUnit:string, coordinates:string>>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("events").alias("e")).select("e.*").withColumn("g", F.element_at("geometry", -1))
    ring = F.get(F.from_json("g.coordinates", "array<array<array<double>>>"), F.lit(0))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / F.size(ring)
    spot = lambda i: F.when(F.col("g.type") == "Point", F.get(F.from_json("g.coordinates", "array<double>"), F.lit(i))).otherwise(mean(i))
    kind = lookup(F.get("categories", F.lit(0))["id"], {"wildfires": "wildfire", "severeStorms": "storm", "volcanoes": "volcano", "floods": "flood"}, "other")
    return incident(x, "EONET", id=F.concat(F.lit("eonet-"), "id"), category=kind, severity=F.when(F.col("g.magnitudeUnit") == "kts", ladder("g.magnitudeValue", [(96, 4), (64, 3), (34, 2)], 1)).otherwise(2), title=F.col("title"), date=F.try_to_timestamp(F.col("g.date")), lat=spot(1), lon=spot(0), url=F.col("link"))


#: Fixed positions of the machine-coded table (61 columns; 58 without the second id of each place).
CODED = {"id": 0, "day": 1, "actor1": 6, "actor1_country": 7, "actor2": 16, "actor2_country": 17, "is_root": 25, "code": 26, "root": 28, "sources": 32, "articles": 33}


def coded_news(spark: SparkSession, path: str) -> DataFrame:
    """Machine-coded news in both widths, read as text: the trailing fields are counted from the end of the line."""
    x = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c").isin(58, 61))
    wide = F.size("c") == 61
    at = lambda i: F.get("c", F.lit(i))
    tail = lambda w, n: F.get("c", F.when(wide, w).otherwise(n))
    return x.select(
        *(at(i).alias(k) for k, i in CODED.items() if k not in ("day", "sources", "articles")), F.try_to_timestamp(at(1), F.lit("yyyyMMdd")).cast("date").alias("day"), at(32).try_cast("int").alias("sources"), at(33).try_cast("int").alias("articles"),
        tail(52, 50).alias("place"), tail(53, 51).alias("country"), tail(56, 53).try_cast("double").alias("lat"), tail(57, 54).try_cast("double").alias("lon"),
        F.try_to_timestamp(F.substring(tail(59, 56), 1, 8), F.lit("yyyyMMdd")).cast("date").alias("added"), tail(60, 57).alias("url"),
    )


def conflict_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Conflict events in editions; a later edition's row takes the place of an earlier one with its id."""
    out = None
    for rank, path in enumerate(paths):
        part = spark.read.option("header", True).csv(path).withColumn("edition", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    fields = [c for c in out.columns if c not in ("id", "edition")]
    x = out.groupBy("id").agg(F.max_by(F.struct(*fields), "edition").alias("r")).select("id", "r.*")
    deaths = F.col("best").try_cast("int")
    return incident(x, "UCDP", id=F.concat(F.lit("ucdp-"), "id"), category=lookup("type_of_violence", {"1": "armed_conflict", "2": "armed_conflict", "3": "attack"}, "other"), severity=ladder(deaths, [(25, 4), (5, 3), (1, 2)], 1), title=F.col("where_description"), date=F.try_to_timestamp("date_start"), lat=F.col("latitude").try_cast("double"), lon=F.col("longitude").try_cast("double"), country=F.col("country"))


def outbreaks(spark: SparkSession, path: str) -> DataFrame:
    """Outbreak bulletins: the country follows the last dash of the title."""
    x = spark.read.schema("value array<struct<UrlName:string, Title:string, PublicationDate:string>>").option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")
    return incident(x, "WHO", id=F.concat(F.lit("who-"), "UrlName"), category=F.lit("health"), severity=F.when(F.lower("Title").rlike("ebola|marburg|cholera|plague|nipah"), 3).otherwise(2), title=F.col("Title"), date=F.try_to_timestamp("PublicationDate"), country=F.trim(F.element_at(F.split(F.regexp_replace("Title", "–", "-"), " - "), -1)))


def weather_alerts(spark: SparkSession, path: str) -> DataFrame:
    """National weather alerts: severe ones, without marine areas, watches and statements; one per event and area."""
    x = features(spark, path, "event:string, severity:string, areaDesc:string, headline:string, sent:string, id:string").where(F.col("severity").isin("Extreme", "Severe") & ~F.lower("event").rlike("marine|watch|statement|rip current|small craft"))
    e = F.lower("event")
    kind = F.when(e.rlike("flood"), "flood").when(e.rlike("hurricane|tropical"), "cyclone").when(e.rlike("fire|red flag"), "wildfire").when(e.rlike("heat|cold|freeze|chill"), "extreme_temp").otherwise("storm")
    x = x.withColumn("area", F.substring("areaDesc", 1, 120)).dropDuplicates(["event", "area"])
    ring = F.get(F.from_json("coordinates", "array<array<array<double>>>"), F.lit(0))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[i]) / F.size(ring)
    return incident(x, "NWS", id=F.concat(F.lit("nws-"), F.substring(F.sha1(F.concat_ws("|", "event", "area")), 1, 12)), category=kind, severity=F.when(F.col("severity") == "Extreme", 4).otherwise(3), title=F.concat_ws(" – ", "event", "area"), date=F.try_to_timestamp("sent"), lat=mean(1), lon=mean(0), country=F.lit("US"))


def exploited_vulnerabilities(spark: SparkSession, path: str, since: str) -> DataFrame:
    x = spark.read.schema("vulnerabilities array<struct<cveID:string, vulnerabilityName:string, dateAdded:string, knownRansomwareCampaignUse:string>>").option("multiLine", True).json(path).select(F.explode("vulnerabilities").alias("v")).select("v.*").where(F.col("dateAdded") >= since)
    return incident(x, "KEV", id=F.concat(F.lit("kev-"), "cveID"), category=F.lit("cyber"), severity=F.when(F.col("knownRansomwareCampaignUse") == "Known", 3).otherwise(2), title=F.col("vulnerabilityName"), date=F.try_to_timestamp("dateAdded"))


def generic_json(spark: SparkSession, path: str, items: str, fields: dict[str, str], source: str, categories: dict[str, str] | None = None, severities: dict[str, int] | None = None) -> DataFrame:
    """Any JSON: ``items`` is the variant path of the list, ``fields`` the path of each canonical column in an item."""
    x = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v")).select(F.explode(F.try_variant_get("v", items, "array<variant>")).alias("i"))
    got = {k: F.try_variant_get("i", p, "string") for k, p in fields.items()}
    if categories:
        got["category"] = lookup(got["category"], categories, "other")
    if "severity" in got:
        got["severity"] = lookup(got["severity"], severities, 1) if severities else got["severity"].try_cast("int")
    for c in ("lat", "lon"):
        if c in got:
            got[c] = got[c].try_cast("double")
    if "date" in got:
        got["date"] = F.try_to_timestamp(got["date"])
    return incident(x, source, **got)


def feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """title, link, date, snippet of RSS items (``tag`` entry: Atom); bare ampersands are repaired first. Snippets under 40 characters are null."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"&(?!#?\w+;)", "&amp;").alias("x"))
    item = raw.select(F.explode(F.regexp_extract_all("x", F.lit(rf"(?s)<{tag}[\s>].*?</{tag}>"), 0)).alias("i"))
    inner = lambda t: F.trim(unescape(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")))
    link = F.when(inner("link") != "", inner("link")).otherwise(F.regexp_extract("i", r"<link[^>]*href=[\"']([^\"']+)", 1))
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace(F.regexp_extract("i", r"<pubDate>\w{3}, ([^<]+?)(?: GMT| \+0000)?</pubDate>", 1), r"\s+", " "), F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.regexp_extract("i", r"<(?:updated|published|dc:date)>([^<]+)<", 1)))
    x = item.select(inner("title").alias("title"), link.alias("link"), when.alias("date"), F.when(inner("description") != "", inner("description")).otherwise(inner("summary")).alias("body"))
    s = snippet("body", "title")
    return x.select("title", "link", "date", F.when(F.length(s) >= 40, s).alias("snippet"))


def search_items(items: DataFrame) -> DataFrame:
    """Titles of a search feed, cut into title and outlet at the last dash."""
    p = r"^(.*)\s+-\s+([^-]{2,60})$"
    cut = F.col("title").rlike(p)
    return items.withColumn("outlet", F.when(cut, F.regexp_extract("title", p, 2))).withColumn("title", F.when(cut, F.regexp_extract("title", p, 1)).otherwise(F.col("title")))


def channel_messages(spark: SparkSession, path: str) -> DataFrame:
    """post, text, date, title of a public channel's page; texts under 25 characters go, titles are cut at 180."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"tgme_widget_message_wrap")).alias("b"))
    x = blocks.select(F.regexp_extract("b", r"data-post=\"([^\"]+)", 1).alias("post"), snippet(F.regexp_extract("b", r"(?s)tgme_widget_message_text[^>]*>(.*?)</div>", 1), most=4000).alias("text"), F.try_to_timestamp(F.regexp_extract("b", r"<time[^>]*datetime=\"([^\"]+)", 1)).alias("date"))
    return x.where((F.col("post") != "") & (F.length("text") >= 25)).withColumn("title", F.substring("text", 1, 180))


def us_advisories(spark: SparkSession, path: str) -> DataFrame:
    """country, level, reasons from titles like "Name - Level n: label" and the summary's first sentence."""
    x = spark.read.schema("Title string, Link string, Updated string, Summary string").option("multiLine", True).json(path)
    first = F.lower(F.substring_index(snippet("Summary", most=2000), ".", 1))
    reasons = F.array_compact(F.array(*(F.when(first.rlike(r"\b" + r), r) for r in ("crime", "terrorism", "unrest", "health", "kidnapping", "armed conflict", "wrongful detention", "natural disaster"))))
    level = F.regexp_extract("Title", r"Level (\d)", 1).try_cast("int")
    return x.select(F.trim(F.regexp_extract("Title", r"^(.*?)\s*-\s*Level", 1)).alias("country"), level.alias("level"), F.lit(4).alias("scale"), reasons.alias("reasons"), F.col("Link").alias("url"), F.try_to_timestamp("Updated").alias("updated")).where("level IS NOT NULL")


def uk_level(status: Column) -> Column:
    """(level, parts, max) from alert status flags."""
    has = lambda s: F.array_contains(status, s)
    top = F.when(has("avoid_all_travel_to_whole_country"), 4).when(has("avoid_all_but_essential_travel_to_whole_country"), 3)
    part = F.when(has("avoid_all_travel_to_parts"), 4).when(has("avoid_all_but_essential_travel_to_parts"), 3)
    return F.struct(F.coalesce(top, F.when(part.isNotNull(), 2), F.lit(1)).alias("level"), part.isNotNull().alias("parts"), F.coalesce(F.greatest(top, part), F.lit(1)).alias("max"))


def de_level(warning: Column, part: Column, situation: Column) -> Column:
    return F.when(warning, 4).when(part, 3).when(situation, 2).otherwise(1)


def phrase_levels(pages: DataFrame, phrases: dict[str, int]) -> DataFrame:
    """country, level: how often each phrase occurs beyond the least count on any page, which is the template's own."""
    counts = pages.select("country", *(F.regexp_count("html", F.lit(p)).alias(f"n{v}") for p, v in phrases.items()))
    least = counts.agg(*(F.min(f"n{v}").alias(f"m{v}") for v in phrases.values())).first()
    over = lambda v: F.col(f"n{v}") > (least[f"m{v}"] or 0)
    order = sorted(phrases.values(), reverse=True)
    level = F.coalesce(*(F.when(over(v), v) for v in order), F.lit(1))
    return counts.select("country", level.alias("level"))


def rare_sentences(sentences: DataFrame, share: float = 0.2) -> DataFrame:
    """Sentences(page, sentence) that are on at most a share of the pages."""
    n = sentences.select("page").distinct().count()
    common = sentences.dropDuplicates(["page", "sentence"]).groupBy("sentence").count().where(F.col("count") > share * n)
    return sentences.join(common, "sentence", "left_anti")


def gazetteer(spark: SparkSession, path: str, least: int = 15000) -> DataFrame:
    """country, name (folded), place, lat, lon, population from a city table; alternate names too, the most populous city per name."""
    from cairn.functions.exprs import fold

    names = ["geonameid", "name", "asciiname", "alternatenames", "lat", "lon", "fclass", "fcode", "country", "cc2", "admin1", "admin2", "admin3", "admin4", "population"]
    x = spark.read.option("sep", "\t").csv(path).toDF(*names[: len(spark.read.option("sep", "\t").csv(path).columns)])
    x = x.withColumn("population", F.col("population").try_cast("long")).where(F.col("population") >= least)
    x = x.select("country", F.col("name").alias("place"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "population", (F.col("fcode") == "PPLC").alias("capital"), F.explode(F.array_union(F.array("name", "asciiname"), F.split(F.coalesce("alternatenames", F.lit("")), ","))).alias("n"))
    x = x.withColumn("name", fold("n")).where("name <> ''")
    return x.groupBy("country", "name").agg(F.max_by(F.struct("place", "lat", "lon", "population", "capital"), F.struct("population", "place")).alias("p")).select("country", "name", "p.*")


def latest_observations(rows: DataFrame) -> DataFrame:
    """country, key, year, value: the latest of rows(country, key, year, value) that has a value."""
    return rows.where("value IS NOT NULL").groupBy("country", "key").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))


def imf(spark: SparkSession, path: str, key: str) -> DataFrame:
    x = spark.read.schema("values map<string, map<string, map<string, double>>>").option("multiLine", True).json(path).select(F.explode("values").alias("k", "c")).where(F.col("k") == key).select(F.explode("c").alias("country", "y")).select("country", F.explode("y").alias("year", "value"))
    return x.select("country", F.lit(key).alias("key"), F.col("year").cast("int").alias("year"), "value")


def world_bank(spark: SparkSession, path: str, key: str) -> DataFrame:
    x = spark.read.schema("countryiso3code string, date string, value double").option("multiLine", True).json(path)
    return x.select(F.col("countryiso3code").alias("country"), F.lit(key).alias("key"), F.col("date").try_cast("int").alias("year"), "value")


def ecb(spark: SparkSession, path: str, key: str = "yield") -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    return x.select(F.col("REF_AREA").alias("country"), F.lit(key).alias("key"), F.substring("TIME_PERIOD", 1, 4).try_cast("int").alias("year"), F.col("OBS_VALUE").try_cast("double").alias("value"))


def gridded_climate(spark: SparkSession, path: str) -> DataFrame:
    """unit, month, metric, value; fill values and month 13 go, rain in mm a day becomes mm a month."""
    x = spark.read.schema("unit string, properties struct<parameter:map<string, map<string, double>>>").json(path).select("unit", F.explode("properties.parameter").alias("metric", "m")).select("unit", "metric", F.explode("m").alias("ym", "value"))
    x = x.where("value > -900 AND right(ym, 2) BETWEEN '01' AND '12'").withColumn("month", F.try_to_timestamp(F.concat("ym", F.lit("01")), F.lit("yyyyMMdd")).cast("date"))
    return x.select("unit", "month", "metric", F.when(F.col("metric") == "PRECTOTCORR", F.col("value") * F.dayofmonth(F.last_day("month"))).otherwise(F.col("value")).alias("value"))


def latest_humanitarian(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country", "admin", "metric").agg(F.max_by("value", "period_end").alias("value"), F.max("period_end").alias("period_end"))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """unit (slug, numbered where a country repeats one), country, name, rings of boundary GeoJSON polygons and multipolygons."""
    from pyspark.sql import Window

    from cairn.functions.exprs import fold

    x = features(spark, path, "shapeName:string, shapeGroup:string")
    rings = F.when(F.col("shape") == "Polygon", F.from_json("coordinates", "array<array<array<double>>>")).otherwise(F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>")))
    slug = F.regexp_replace(F.concat_ws("-", F.lower("shapeGroup"), fold("shapeName")), "[^a-z0-9]+", "-")
    x = x.withColumn("slug", slug).withColumn("n", F.row_number().over(Window.partitionBy("slug").orderBy("coordinates")))
    return x.select(F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")).alias("unit"), F.col("shapeGroup").alias("country"), F.col("shapeName").alias("name"), F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def aircraft(spark: SparkSession, path: str) -> DataFrame:
    """Positions of a snapshot; rows without one go, ground is altitude 0, the military flag is the lowest bit."""
    x = spark.read.schema("ac array<struct<hex:string, flight:string, r:string, t:string, lat:double, lon:double, alt_baro:string, gs:double, track:double, squawk:string, dbFlags:int>>").option("multiLine", True).json(path).select(F.explode("ac").alias("a")).select("a.*")
    return x.where("lat IS NOT NULL AND lon IS NOT NULL").select("hex", F.trim("flight").alias("callsign"), F.col("r").alias("reg"), F.col("t").alias("type"), "lat", "lon", F.when(F.col("alt_baro") == "ground", 0).otherwise(F.col("alt_baro").try_cast("int")).alias("alt"), "gs", "track", "squawk", (F.coalesce("dbFlags", F.lit(0)).bitwiseAND(1) == 1).alias("mil"))


def reports(items: DataFrame, keep_link: str, drop_title: str, now: str, days: int = 365, per_feed: int = 40) -> DataFrame:
    """Report items(feed, title, link, date): link kept and title not dropped by pattern, young enough, capped per feed (the feature); id from the link without its query."""
    from pyspark.sql import Window

    x = items.where(F.col("link").rlike(keep_link) & ~F.lower("title").rlike(drop_title) & (F.col("date") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")))
    x = x.withColumn("id", F.substring(F.sha1(F.regexp_replace("link", r"\?.*$", "")), 1, 12))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("date"), "id"))).where(F.col("n") <= per_feed).drop("n")


def kept_reports(stored: DataFrame, new: DataFrame, now: str, days: int = 365, most: int = 1500) -> DataFrame:
    """The store of reports after an update: one row per id, that of ``new`` (its latest) where both have it, then the ``most`` newest of the last ``days`` (the feature); ties by id."""
    young = F.col("date") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")
    held = stored.join(new.select("id"), "id", "left_anti").select(stored.columns)
    latest = new.groupBy("id").agg(F.max(F.struct("date", *[c for c in new.columns if c not in ("id", "date")])).alias("r")).select("id", "r.*")
    return held.unionByName(latest).where(young).orderBy(F.desc("date"), "id").limit(most)


def european_warnings(spark: SparkSession, path: str, now: str) -> DataFrame:
    """One row per country, type and level of unexpired warnings: areas united, latest sent and expires, first onset; cancelled, marine-only and orange fog go."""
    schema = "warnings array<struct<country:string, type:string, level:string, status:string, sent:string, onset:string, expires:string, areas:array<string>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("warnings").alias("w")).select("w.*")
    marine = F.forall("areas", lambda a: F.lower(a).rlike("sea|coast|marine|strait"))
    x = x.where((F.col("status") != "Cancel") & (F.try_to_timestamp("expires") > F.lit(now).cast("timestamp")) & F.col("level").isin("orange", "red") & ~marine & ~((F.col("level") == "orange") & (F.col("type") == "fog")))
    g = x.groupBy("country", "type", "level").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("areas")))).alias("areas"), F.max(F.try_to_timestamp("sent")).alias("sent"), F.max(F.try_to_timestamp("expires")).alias("expires"), F.min(F.try_to_timestamp("onset")).alias("onset"))
    kind = lookup("type", {"rain": "flood", "flood": "flood", "wind": "storm", "thunderstorm": "storm", "snow": "storm", "forestfire": "wildfire", "heat": "extreme_temp", "cold": "extreme_temp"}, "other")
    return g.withColumn("category", kind).withColumn("severity", lookup("level", {"orange": 3, "red": 4}, 1))


def conflict_api(spark: SparkSession, path: str) -> DataFrame:
    """Licensed conflict rows; ten deaths make them critical."""
    x = spark.read.schema("data array<struct<event_id_cnty:string, event_date:string, event_type:string, country:string, location:string, latitude:string, longitude:string, fatalities:string, notes:string>>").option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*")
    kind = lookup("event_type", {"Battles": "armed_conflict", "Explosions/Remote violence": "attack", "Violence against civilians": "attack", "Riots": "unrest", "Protests": "unrest"}, "political")
    return incident(x, "ACLED", id=F.concat(F.lit("acled-"), "event_id_cnty"), category=kind, severity=F.when(F.col("fatalities").try_cast("int") >= 10, 4).when(F.col("fatalities").try_cast("int") >= 1, 3).otherwise(2), title=F.col("notes"), date=F.try_to_timestamp("event_date"), lat=F.col("latitude").try_cast("double"), lon=F.col("longitude").try_cast("double"), country=F.col("country"))


def humanitarian_reports(spark: SparkSession, path: str) -> DataFrame:
    """title, link, date, country of humanitarian reports, as press items."""
    x = spark.read.schema("data array<struct<fields:struct<title:string, url:string, date:struct<created:string>, primary_country:struct<iso3:string>>>>").option("multiLine", True).json(path).select(F.explode("data.fields").alias("f"))
    return x.select("f.title", F.col("f.url").alias("link"), F.try_to_timestamp("f.date.created").alias("date"), F.col("f.primary_country.iso3").alias("country"))


def official_bulletins(items: DataFrame, keep: str, drop: str, categories: dict[str, str], group: str | None = None) -> DataFrame:
    """Bulletins kept by pattern, with category, severity by warning words, position from the text in two spellings (12.5N 45.0W or -12.5, 45.0); the latest per group."""
    from functools import reduce

    from pyspark.sql import Window

    t = F.lower(F.concat_ws(" ", "title", "snippet"))
    x = items.where(t.rlike(keep) & ~t.rlike(drop))
    pairs = list(categories.items())
    kind = reduce(lambda w, kv: w.when(t.rlike(kv[0]), kv[1]), pairs[1:], F.when(t.rlike(pairs[0][0]), pairs[0][1])).otherwise("other")
    letters = r"(\d{1,2}(?:\.\d+)?)\s*°?\s*([ns])[, ]+(\d{1,3}(?:\.\d+)?)\s*°?\s*([ew])"
    plain = r"(-?\d{1,2}\.\d+)\s*,\s*(-?\d{1,3}\.\d+)"
    number = lambda p, i: F.regexp_extract(t, p, i).try_cast("double")
    lat = F.coalesce(number(letters, 1) * F.when(F.regexp_extract(t, letters, 2) == "s", -1).otherwise(1), number(plain, 1))
    lon = F.coalesce(number(letters, 3) * F.when(F.regexp_extract(t, letters, 4) == "w", -1).otherwise(1), number(plain, 2))
    severity = F.when(t.rlike("major|extreme|red|catastroph"), 4).when(t.rlike("warning|orange|severe"), 3).otherwise(2)
    x = x.select("*", kind.alias("category"), severity.alias("severity"), lat.alias("lat"), lon.alias("lon"), F.trim(F.element_at(F.split("title", " - "), -1)).alias("tail"))
    if group:
        x = x.withColumn("storm", F.regexp_extract(F.lower("title"), group, 1)).withColumn("n", F.row_number().over(Window.partitionBy(F.when(F.col("storm") != "", F.col("storm")).otherwise(F.col("link"))).orderBy(F.desc("date"), "link"))).where("n = 1").drop("n")
    return x


def ca_advisories(spark: SparkSession, path: str) -> DataFrame:
    """country, level: the advisory state plus one."""
    x = spark.read.schema("data map<string, struct<`country-iso`:string, `advisory-state`:int>>").option("multiLine", True).json(path).select(F.explode("data").alias("k", "v"))
    return x.select(F.col("v.country-iso").alias("country"), (F.col("v.advisory-state") + 1).cast("int").alias("level"), F.lit(4).alias("scale"))


def advisory_sections(pages: DataFrame) -> DataFrame:
    """country, pos, heading, depth, body, phones of pages(country, html) cut at headings; skipped headings are boilerplate."""
    parts = pages.select("country", F.posexplode(F.split(F.regexp_replace("html", r"(?i)<h([23])[^>]*>", "\x1e$1\x1f"), "\x1e")).alias("pos", "p")).where("pos > 0")
    depth = F.substring("p", 1, 1).try_cast("int")
    head = F.regexp_extract("p", r"(?s)\x1f(.*?)</h", 1)
    body = F.regexp_extract("p", r"(?s)</h[23]>(.*)$", 1)
    x = parts.select("country", "pos", snippet(head, most=200).alias("heading"), depth.alias("depth"), snippet(body, most=100_000).alias("body"))
    phones = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\+?\d[\d ()-]{5,}\d)"), 1))
    return x.where(~F.lower("heading").rlike("cookies|related content|print|sign up")).withColumn("phones", phones)


def populated_places(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    return x.select("name", F.col("iso").alias("country"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), F.col("population").try_cast("long").alias("population"), (F.col("capital") == "1").alias("capital")).where("lat IS NOT NULL AND population IS NOT NULL")


def airports(spark: SparkSession, path: str) -> DataFrame:
    """Large and medium airports with a code."""
    x = spark.read.option("header", True).csv(path).where(F.col("type").isin("large_airport", "medium_airport") & (F.coalesce("iata_code", F.lit("")) != ""))
    return x.select(F.col("iso_country").alias("country"), F.col("iata_code").alias("airport"), F.col("latitude_deg").try_cast("double").alias("lat"), F.col("longitude_deg").try_cast("double").alias("lon"))


def projects(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema("projects map<string, struct<countryshortname:string, project_name:string, totalamt:string, boardapprovaldate:string>>").option("multiLine", True).json(path).select(F.explode("projects").alias("id", "p"))
    return x.select("id", F.col("p.countryshortname").alias("country"), F.col("p.project_name").alias("title"), F.regexp_replace("p.totalamt", ",", "").try_cast("double").alias("amount"))


def calendar_entries(holidays: DataFrame, elections: DataFrame, own: DataFrame) -> DataFrame:
    """country, d, title, type: public holidays, elections and own entries; one per country, day and title, own ones first."""
    from pyspark.sql import Window

    x = own.select("country", "d", "title", F.lit("own").alias("type"), F.lit(0).alias("r")).unionByName(elections.select("country", "d", "title", F.lit("election").alias("type"), F.lit(1).alias("r"))).unionByName(holidays.select("country", "d", "title", F.lit("holiday").alias("type"), F.lit(2).alias("r")))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("country", "d", F.lower("title")).orderBy("r"))).where("n = 1").drop("n", "r")


def country_facts(rows: DataFrame, most: int = 12) -> DataFrame:
    """country, fact, values: distinct values of knowledge-base rows(country, fact, value), sorted, the first ``most``."""
    return rows.groupBy("country", "fact").agg(F.slice(F.array_sort(F.collect_set("value")), 1, most).alias("values"))
