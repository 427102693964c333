"""Headlines to incidents: reasons to refuse, location, grouping; alert selection; sentences and assembled country rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import col, fold, haversine_km, magnitude
from cairn.operators import headlines
from cairn.operators.indices import _since
from cairn.operators.text import find_city, mentions, ngrams


def judged_titles(titles: DataFrame) -> DataFrame:
    """id, category, reason, context, toll, severity, event by the small lexicon; ``headlines.judged`` takes the caller's."""
    return headlines.judged(titles.select("id", "title"), *headlines.seed_rules()).select("id", "category", "reason", "context", "toll", "severity", "event")


def press_groups(items: DataFrame) -> DataFrame:
    """One row per (country, place, category, day): outlets give the confidence (4 high, 2 medium), worst severity, first and last item."""
    g = items.groupBy("country", "place", "category", F.col("date").cast("date").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("outlet").alias("outlets"), F.max("severity").alias("severity"), F.min_by("id", F.struct("date", "id")).alias("first_id"), F.max_by("id", F.struct("date", "id")).alias("last_id"))
    return g.withColumn("confidence", F.when(F.col("outlets") >= 4, "high").when(F.col("outlets") >= 2, "medium").otherwise("low"))


def locate_titles(titles: DataFrame, aliases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id, country, place, lat, lon: a cited country beats the feed's hint; a city of that country is the place; without a country, a city of over half a million decides."""
    cited = mentions(titles, aliases).groupBy("id").agg(F.min_by("country", "pos").alias("cited"))
    x = titles.drop("country").join(cited, "id", "left").withColumn("country", F.coalesce("cited", "hint"))
    city = find_city(x.where("country IS NOT NULL").select("id", "title", "country"), gazetteer)
    big = ngrams(x.where("country IS NULL")).join(gazetteer.where("population >= 500000").withColumnRenamed("name", "gram"), "gram").groupBy("id").agg(F.max_by(F.struct("country", "place", "lat", "lon"), F.struct("population", "place")).alias("b")).select("id", F.col("b.country").alias("b_country"), F.col("b.place").alias("b_place"), F.col("b.lat").alias("b_lat"), F.col("b.lon").alias("b_lon"))
    y = x.join(city, "id", "left").join(big, "id", "left")
    return y.select("id", F.coalesce("country", "b_country").alias("country"), F.coalesce("place", "b_place").alias("place"), F.coalesce("lat", "b_lat").alias("lat"), F.coalesce("lon", "b_lon").alias("lon"))


def refined(located: DataFrame, snippets: DataFrame, gazetteer: DataFrame, most_km: float = 400) -> DataFrame:
    """Rows without a place take a city of their snippet; one further than ``most_km`` from a known point isn't taken."""
    s = find_city(snippets.join(located.select("id", "country"), "id").select("id", F.col("snippet").alias("title"), "country"), gazetteer).select("id", F.col("place").alias("s_place"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    x = located.join(s, "id", "left")
    ok = F.col("place").isNull() & F.col("s_place").isNotNull() & (F.col("lat").isNull() | (haversine_km("lat", "lon", "s_lat", "s_lon") < most_km))
    return x.select("id", "country", F.when(ok, F.col("s_place")).otherwise(F.col("place")).alias("place"), F.when(ok, F.col("s_lat")).otherwise(F.col("lat")).alias("lat"), F.when(ok, F.col("s_lon")).otherwise(F.col("lon")).alias("lon"))


def alert_rows(incidents: DataFrame, sent: DataFrame, now: str, min_severity: int = 3, hours: int = 6, include_auto: bool = True) -> DataFrame:
    """Fresh rows of enough severity and confidence that weren't sent yet; machine-coded ones only if wanted; the most severe first."""
    x = incidents.where((F.col("severity") >= min_severity) & (F.col("confidence") != "low") & (F.col("date") >= _since(now, hours / 24)))
    x = x if include_auto else x.where(~F.col("is_auto"))
    return x.join(sent.select("id"), "id", "left_anti").select("id", "country", "category", "severity", "date")


def hidden_when_reliable(source: Column | str, letter: Column | str, outlets: Column | str) -> Column:
    """Machine-coded rows of grade D, E or F that a single outlet has."""
    return (col(source) == "GDELT") & col(letter).isin("D", "E", "F") & (col(outlets) < 2)


def magnitude_spread(reports: DataFrame, least: float = 0.5) -> DataFrame:
    """id, low, high where the magnitudes of a record's reports(id, title) differ by ``least`` or more."""
    x = reports.withColumn("m", magnitude("title"))
    return x.where("m IS NOT NULL").groupBy("id").agg(F.min("m").alias("low"), F.max("m").alias("high")).where(F.round(F.col("high") - F.col("low"), 6) >= least)


def triage_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("source", "status").agg(F.count("*").alias("n"))


def backfilled(history: DataFrame, live: DataFrame, live_start: str) -> DataFrame:
    """Monthly counters: history before the first live month, live ones from it on."""
    at = F.lit(live_start).cast("date")
    return history.where(F.col("month") < at).unionByName(live.where(F.col("month") >= at))


def crisis_sentence(crises: DataFrame) -> DataFrame:
    """component, text: a one-line summary from the aggregates."""
    trend = F.create_map(*(F.lit(x) for kv in {"new": "New in the last three days.", "escalating": "Escalating over three days.", "declining": "Declining.", "stable": "Stable."}.items() for x in kv))
    return crises.select("component", F.concat_ws(" ", F.format_string("%d incidents of %s in %s from %s to %s, peak on %s.", "n", "family", "country", F.date_format("start", "yyyy-MM-dd"), F.date_format("last", "yyyy-MM-dd"), F.col("peak").cast("string")), trend[F.col("trend")]).alias("text"))


def source_label(sources: Column | str, most: int = 3) -> Column:
    """Distinct source names, the first few, with the number of the others."""
    d = F.array_distinct(col(sources))
    return F.when(F.size(d) <= most, F.array_join(d, ", ")).otherwise(F.concat(F.array_join(F.slice(d, 1, most), ", "), F.lit(" +"), (F.size(d) - most).cast("string")))


def why_shown() -> Column:
    """The first of seven reasons."""
    return F.coalesce(
        F.when(F.col("decision") == "verified", "verified by an analyst"), F.when(F.col("near_site"), "near a site"), F.when(F.col("severity") == 4, "critical"), F.when(F.col("outlets") >= 2, "several sources"),
        F.when(F.col("source").isin("USGS", "GDACS", "WHO"), "official source"), F.when(F.col("severity") == 3, "high severity"), F.lit("recent"),
    )


def country_brief(risk: DataFrame, stability: DataFrame, incidents: DataFrame, advisories: DataFrame, now: str) -> DataFrame:
    """One row per country of ``risk`` from pre-aggregated sides: level, stability, counts of the month, worst of three days, top advisory."""
    e = incidents.where(F.col("date") >= _since(now, 30)).groupBy("country").agg(F.count("*").alias("month"), F.count_if(F.col("severity") >= 3).alias("severe"), F.max(F.when(F.col("date") >= _since(now, 3), F.col("severity"))).alias("worst_72h"))
    a = advisories.groupBy("country").agg(F.max("level").alias("advice"))
    return risk.select("country", "level", "score").join(stability.select("country", F.col("value").alias("stability")), "country", "left").join(e, "country", "left").join(a, "country", "left")


def covering_providers(providers: DataFrame, country: str, region: str) -> DataFrame:
    """Providers that declare the country, are based in it, or cover its region without naming countries."""
    none = F.size(F.coalesce("countries", F.array().cast("array<string>"))) == 0
    return providers.where(F.array_contains(F.coalesce("countries", F.array().cast("array<string>")), country) | (F.col("base") == country) | (none & F.array_contains("regions", region)))


def city_sentences(cities: DataFrame, sentences: DataFrame, most: int = 4) -> DataFrame:
    """city, rank, sentence: advisory sentences of the country that name the city, those with more threat words first."""
    threat = F.regexp_count(fold("sentence"), F.lit(r"\b(crime|terror|kidnap|attack|protest|robbery|conflict)"))
    x = cities.join(sentences, "country").where(F.contains(fold("sentence"), fold("city"))).withColumn("t", threat)
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("country", "city").orderBy(F.desc("t"), "pos"))).where(F.col("rank") <= most).select("country", "city", "rank", "sentence")


def health_lists(members: DataFrame) -> DataFrame:
    """country, risks: the lists of members(list, country) that a country is on."""
    return members.groupBy("country").agg(F.array_sort(F.collect_set("list")).alias("risks"))
