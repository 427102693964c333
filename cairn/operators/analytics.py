"""Counts by window, category, severity, source and time bucket; coverage; feed health; filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import domain
from cairn.operators.indices import _since

WINDOWS = {"24h": 1, "72h": 3, "7d": 7, "30d": 30, "90d": 90}


def country_stats(incidents: DataFrame, now: str) -> DataFrame:
    """country, win, category, severity, n: totals (both null), per category and per severity, for five windows in one pass."""
    age = F.array_compact(F.array(*(F.when(F.col("date") >= _since(now, d), F.lit(k)) for k, d in WINDOWS.items())))
    rows = incidents.select("country", "category", "severity", F.explode(age).alias("win"))
    return rows.groupingSets([["country", "win"], ["country", "win", "category"], ["country", "win", "severity"]], "country", "win", "category", "severity").agg(F.count("*").alias("n"))


def global_series(incidents: DataFrame, now: str, days: int = 90) -> DataFrame:
    """One row per day, zero-filled: rows by group and by severity."""
    last = F.lit(now).cast("date")
    axis = incidents.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    per = incidents.where(F.col("date").cast("date") > F.date_sub(last, days)).groupBy(F.col("date").cast("date").alias("day")).agg(
        F.count("*").alias("n"), *(F.count_if(F.col("grp") == g).alias(g) for g in ("security", "political", "natural", "infrastructure")), *(F.count_if(F.col("severity") == s).alias(f"sev{s}") for s in (1, 2, 3, 4))
    )
    return axis.join(per, "day", "left").na.fill(0)


def by_source(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("source").agg(F.count("*").alias("n"), F.max("date").alias("last"))


def top_places(incidents: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent places of each country, ties by name."""
    n = incidents.groupBy("country", "place").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "place"))).where(F.col("rank") <= most)


def kpis(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 3).alias("severe"), F.countDistinct("country").alias("countries"), F.countDistinct("source").alias("sources"), F.count_if("is_auto").alias("machine_coded"), F.round(F.avg("severity"), 3).alias("mean_severity"))


def bucket_days(span_days: float) -> float:
    """Step of a time axis: a day up to 62 days, a week up to 400, else a month of 30.44 days."""
    return 1 if span_days <= 62 else 7 if span_days <= 400 else 30.44


def time_buckets(incidents: DataFrame, start: str, end: str, key: str = "grp") -> DataFrame:
    """Rows per bucket and key between two times; buckets count from the start."""
    span = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / 86_400_000_000
    days = incidents.sparkSession.range(1).select(span).first()[0]
    step = int(bucket_days(days) * 86_400)
    inside = incidents.where((F.col("date") >= F.lit(start).cast("timestamp")) & (F.col("date") < F.lit(end).cast("timestamp")))
    at = F.floor((F.unix_seconds("date") - F.unix_seconds(F.lit(start).cast("timestamp"))) / step)
    return inside.groupBy(at.alias("bucket"), F.col(key)).agg(F.count("*").alias("n"))


def conjunction(**wanted) -> Column:
    """Interactive filter: each given option adds a condition (start, end, countries, categories, groups, sources, min_severity, include_auto)."""
    parts = [F.lit(True)]
    for name, column in (("countries", "country"), ("categories", "category"), ("groups", "grp"), ("sources", "source")):
        if wanted.get(name):
            parts.append(F.col(column).isin(list(wanted[name])))
    if wanted.get("min_severity"):
        parts.append(F.col("severity") >= wanted["min_severity"])
    if wanted.get("include_auto") is False:
        parts.append(~F.col("is_auto"))
    if wanted.get("start"):
        parts.append(F.col("date") >= F.lit(wanted["start"]).cast("timestamp"))
    if wanted.get("end"):
        parts.append(F.col("date") < F.lit(wanted["end"]).cast("timestamp"))
    return reduce(and_, parts)


def coverage(live: DataFrame, history: DataFrame, now: str, least: int = 15) -> DataFrame:
    """Live security rows of 30 days over the monthly baseline: low under a fifth, partial under a half, good above."""
    a = live.where((F.col("grp") == "security") & (F.col("date") >= _since(now, 30))).groupBy("country").agg(F.count("*").alias("live"))
    x = history.where(F.col("monthly") >= least).join(a, "country", "left").na.fill(0, ["live"]).withColumn("ratio", F.round(F.col("live") / F.col("monthly"), 3))
    return x.select("country", "live", "monthly", "ratio", F.when(F.col("ratio") < 0.2, "low").when(F.col("ratio") < 0.5, "partial").otherwise("good").alias("coverage"))


def baseline(incidents: DataFrame, periods: float) -> DataFrame:
    """Security rows per country and period."""
    return incidents.where("grp = 'security'").groupBy("country").agg(F.round(F.count("*") / periods, 3).alias("monthly"))


def source_alarm(verdicts: DataFrame, least: int = 20, share: float = 0.85) -> DataFrame:
    """Sources with enough new rows of which more than the share is refused."""
    x = verdicts.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("status").isin("ok", "pending")).alias("refused"))
    return x.where((F.col("n") >= least) & (F.col("refused") > share * F.col("n")))


def feed_coverage(status: DataFrame) -> DataFrame:
    """Totals over (source, ok, count): sources, working ones, rows."""
    return status.agg(F.count("*").alias("feeds"), F.count_if("ok").alias("working"), F.sum("count").alias("rows"), F.countDistinct("source").alias("sources"))


def muted_outlets(hits: DataFrame, queries: int = 30, most: int = 60) -> DataFrame:
    """Outlets without a hit after so many queries, the most asked first."""
    x = hits.groupBy("outlet").agg(F.count("*").alias("asked"), F.count_if("hit").alias("hits")).where((F.col("asked") >= queries) & (F.col("hits") == 0))
    return x.orderBy(F.desc("asked"), "outlet").limit(most)


def ongoing(incidents: DataFrame, now: str) -> DataFrame:
    """Rows of 72 hours that are critical; high and not of low confidence; an active disaster (GDACS high, NASA EONET moderate); or moderate and either of several
    sources (tag ``multi-source``), or reliable and still going on after six hours (``start``), or reliable and near a site (``near_site``), where there are such columns."""
    has = set(incidents.columns)
    reliable, moderate = F.coalesce(F.col("confidence"), F.lit("")) != "low", F.col("severity") >= 2
    test = (F.col("severity") >= 4) | ((F.col("severity") >= 3) & (reliable | (F.col("source") == "GDACS"))) | ((F.col("source") == "NASA EONET") & moderate)
    if "tags" in has:
        test |= moderate & F.coalesce(F.array_contains("tags", "multi-source"), F.lit(False))
    if "start" in has:
        test |= moderate & reliable & F.coalesce(F.unix_micros("date") - F.unix_micros("start") > 6 * 3_600_000_000, F.lit(False))
    if "near_site" in has:
        test |= moderate & reliable & F.coalesce("near_site", F.lit(False))
    return incidents.where((F.col("date") >= _since(now, 3)) & test)


def ongoing_by_country(incidents: DataFrame, now: str, risk: DataFrame | None = None) -> DataFrame:
    """Countries with ongoing rows: major (a critical row, or five rows), crisis (two rows), else alert; ranked by that, worst severity, risk(country, level), rows and name."""
    x = ongoing(incidents, now).groupBy("country").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"), F.max("date").alias("last"))
    x = x.withColumn("level", F.when((F.col("max_severity") >= 4) | (F.col("n") >= 5), "major").when(F.col("n") >= 2, "crisis").otherwise("alert"))
    x = x.join(risk.select("country", F.col("level").alias("_risk")), "country", "left") if risk is not None else x.withColumn("_risk", F.lit(0))
    step = F.when(F.col("level") == "major", 2).when(F.col("level") == "crisis", 1).otherwise(0)
    order = Window.orderBy(step.desc(), F.desc("max_severity"), F.coalesce("_risk", F.lit(0)).desc(), F.desc("n"), "country")  # one row per country
    return x.withColumn("rank", F.row_number().over(order)).drop("_risk")


def guest_view(incidents: DataFrame, now: str, most: int = 1500) -> DataFrame:
    """The public projection: seven days, few columns, the most severe and newest first."""
    return incidents.where(F.col("date") >= _since(now, 7)).orderBy(F.desc("severity"), F.desc("date"), "id").limit(most).select("id", "date", "country", "category", "severity", "lat", "lon", "place")


def notable_by_month(incidents: DataFrame, most: int = 600) -> DataFrame:
    """The most severe rows of each month."""
    w = Window.partitionBy("month").orderBy(F.desc("severity"), F.desc("value"), "id")
    return incidents.withColumn("month", F.trunc("date", "month")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("month", "rank", "id", "severity")


def top_per_day(incidents: DataFrame, most: int = 15) -> DataFrame:
    w = Window.partitionBy("country", "day").orderBy(F.desc("value"), "id")
    return incidents.withColumn("day", F.col("date").cast("date")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("country", "day", "rank", "id")


def page_domains(pages: DataFrame) -> DataFrame:
    return pages.groupBy(domain("url").alias("domain")).agg(F.count("*").alias("n"))
