"""Sanity, triage, analyst decisions, source grades, and the rules for machine-coded news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import haversine_km, ladder, lookup

FORECAST = ("flood", "cyclone", "storm", "drought", "extreme_temp")


def canonical(raw: DataFrame) -> DataFrame:
    """Severity clamped to 1 .. 4, unknown categories as other, coordinates to four places, titles trimmed, defaults filled."""
    known = ["armed_conflict", "attack", "terrorism", "crime", "unrest", "political", "earthquake", "cyclone", "storm", "flood", "wildfire", "volcano", "drought", "landslide", "extreme_temp", "health", "cyber", "infrastructure", "diplomatic"]
    return raw.withColumns({"severity": F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce("severity", F.lit(1)))), "category": F.when(F.col("category").isin(known), F.col("category")).otherwise("other"), "lat": F.round("lat", 4), "lon": F.round("lon", 4), "title": F.trim("title"), "confidence": F.coalesce("confidence", F.lit("high"))})


def insane(now: str) -> Column:
    """The first reason why a row can't be right, else null."""
    ahead = F.when(F.col("category").isin(*FORECAST), F.expr("INTERVAL 240 HOUR")).otherwise(F.expr("INTERVAL 2 HOUR"))
    return (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no position").when((F.abs("lat") > 90) | (F.abs("lon") > 180), "out of range").when((F.col("lat") == 0) & (F.col("lon") == 0), "null island")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title").when(F.col("date").isNull(), "no date").when(F.col("date") > F.lit(now).cast("timestamp") + ahead, "future")
    )


def triage(incidents: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """id, status, reason: an analyst's decision first, then sanity, then the headline of machine-coded rows, else ok.

    Where rows have ``noise`` or ``context`` (why a headline speaks against an incident, or tells no physical fact: see ``headlines``), these are the
    statuses of rows that nothing before decides, noise first."""
    x = incidents.join(decisions.select(F.col("event_id").alias("id"), "decision"), "id", "left").withColumn("why", insane(now))
    waiting = F.col("is_auto") & (F.coalesce("headline", F.lit("")) == "")
    told = {c: F.col(c) if c in incidents.columns else F.lit(None).cast("string") for c in ("noise", "context")}
    status = F.when(F.col("decision") == "verified", "ok").when(F.col("decision") == "false", "noise").when(F.col("why").isNotNull(), "invalid").when(waiting & F.col("headline_failed"), "unverifiable").when(waiting, "pending").when(told["noise"].isNotNull(), "noise").when(told["context"].isNotNull(), "context").otherwise("ok")
    read = F.when(~F.coalesce(waiting, F.lit(False)), F.coalesce(told["noise"], told["context"]))
    return x.select("id", "source", status.alias("status"), F.when(F.col("decision").isNotNull(), "analyst").otherwise(F.coalesce("why", read)).alias("reason"))


def changed_only(current: DataFrame, previous: DataFrame, version: str, columns: list[str]) -> DataFrame:
    """Rows whose signature under this rule version isn't in ``previous(id, sig)``."""
    sig = F.sha2(F.concat_ws("\x1f", F.lit(version), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return current.withColumn("sig", sig).join(previous.select("id", "sig"), ["id", "sig"], "left_anti")


def overlay(incidents: DataFrame, decisions: DataFrame) -> DataFrame:
    """Analyst decisions on an id or any id merged into it: false rows go; severity, category and place are taken over; verified rows get full confidence."""
    ids = incidents.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("merged", F.array().cast("array<bigint>")))).alias("event_id"))
    d = ids.join(decisions, "event_id").groupBy("id").agg(F.max_by(F.struct("decision", "new_severity", "new_category"), "event_id").alias("d"), F.bool_or(F.col("decision") == "false").alias("gone"))
    x = incidents.join(d, "id", "left").where("NOT coalesce(gone, false)")
    return x.withColumns({"severity": F.coalesce("d.new_severity", "severity"), "category": F.coalesce("d.new_category", "category"), "confidence": F.when(F.col("d.decision") == "verified", "high").otherwise(F.col("confidence"))}).drop("d", "gone", "merged")


def source_quality(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """outlet, ok, wrong, rate, shift: how an analyst judged an outlet's rows; the shift moves its letter by +2, +1 or -1 from five decisions on."""
    x = reports.join(decisions, "id").groupBy("outlet").agg(F.count_if(F.col("decision") == "verified").alias("ok"), F.count_if(F.col("decision") == "false").alias("wrong"))
    x = x.withColumn("n", F.col("ok") + F.col("wrong")).withColumn("rate", F.round(F.try_divide("wrong", "n"), 3))
    return x.withColumn("shift", F.when(F.col("n") < 5, 0).when(F.col("rate") >= 0.5, 2).when(F.col("rate") >= 0.25, 1).when((F.col("rate") <= 0.05) & (F.col("n") >= 10), -1).otherwise(0)).drop("n")


def reliability(source: Column | str, letter: Column | str | None = None) -> Column:
    """Admiralty letter: sensors and authorities A, machine-coded D, press by its best catalogue letter or C, others E."""
    s = F.col(source) if isinstance(source, str) else source
    best = F.lit("C") if letter is None else F.coalesce(letter, F.lit("C"))
    return F.when(s.isin("USGS", "GDACS", "WHO", "EMSC"), "A").when(s == "GDELT", "D").when(s == "Press", best).otherwise("E")


def credibility(x: DataFrame) -> DataFrame:
    """Admiralty digit 1 .. 6 from decision, disputed, sensor, independent, confidence."""
    digit = F.when(F.col("decision") == "verified", 1).when(F.col("disputed"), 5).when(F.col("sensor"), F.when(F.col("independent") >= 2, 1).otherwise(2)).when(F.col("independent") >= 3, 2).when(F.col("independent") == 2, 3)
    return x.withColumn("digit", digit.otherwise(lookup("confidence", {"high": 3, "medium": 4}, 6)))


def evaluate(rows: DataFrame) -> DataFrame:
    """Confusion counts and precision, recall, accuracy of rows(expected, predicted) booleans."""
    c = rows.agg(*(F.count_if((F.col("predicted") if p else ~F.col("predicted")) & (F.col("expected") if e else ~F.col("expected"))).alias(n) for n, p, e in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))))
    return c.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("recall"), F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4).alias("accuracy"))


#: Least articles and domains per root code in calm and tense countries.
CODED_THRESHOLDS = {"calm": {"14": (3, 2), "18": (6, 2), "19": (20, 3), "20": (20, 3)}, "tense": {"14": (3, 1), "18": (3, 2), "19": (3, 2), "20": (3, 2)}}
#: Codes with a category of their own.
CODE_CATEGORIES = {"14": "unrest", "18": "attack", "19": "armed_conflict", "20": "armed_conflict"}


def coded_events(rows: DataFrame, advisories: DataFrame, drop_codes: tuple[str, ...] = ("192",)) -> DataFrame:
    """Machine-coded rows(place, country, code, root, day, added, articles, url, actor) as one event per place, code and day that passes its country's thresholds.

    Reports added over three days after the event go; tense countries have an advisory of 3 or more; in calm ones war codes become attacks of
    severity 3 at most; the severity and confidence rise with articles and domains."""
    x = rows.where(~F.col("code").isin(*drop_codes) & (F.datediff("added", "day") <= 3) & F.col("root").isin(list(CODE_CATEGORIES)))
    host = F.regexp_extract("url", r"://(?:www\.)?([^/]+)", 1)
    g = x.groupBy("country", "place", "code", "root", "day").agg(F.sum("articles").alias("articles"), F.countDistinct(host).alias("domains"), F.max("added").alias("last"), F.countDistinct("actor").alias("actors"))
    tense = advisories.groupBy("country").agg((F.max("level") >= 3).alias("tense"))
    g = g.join(tense, "country", "left").withColumn("tense", F.coalesce("tense", F.lit(False)))
    need = lambda i: F.when(F.col("tense"), lookup("root", {k: v[i] for k, v in CODED_THRESHOLDS["tense"].items()}, 99)).otherwise(lookup("root", {k: v[i] for k, v in CODED_THRESHOLDS["calm"].items()}, 99))
    g = g.where((F.col("articles") >= need(0)) & (F.col("domains") >= need(1)))
    war = F.col("root").isin("19", "20")
    severity = F.least(F.when(war, 3).otherwise(2) + ladder("articles", [(50, 1)], 0), F.when(F.col("tense"), 4).otherwise(3))
    return g.withColumn("category", F.when(~F.col("tense") & war, "attack").otherwise(lookup("root", CODE_CATEGORIES, "other"))).withColumn("severity", severity).withColumn("confidence", F.when(F.col("domains") >= 10, "high").when(F.col("domains") >= 5, "medium").otherwise("low"))


def dateline_noise(rows: DataFrame, capitals: DataFrame, km: float = 30) -> DataFrame:
    """Rows without violent ones that only sit where a foreign report was filed: the place is an actor, the country is none, or a foreign actor near the capital."""
    actor = F.array_contains("actors", F.upper("place")) | ((F.size("actor_countries") > 0) & ~F.array_contains("actor_countries", F.col("country")))
    x = rows.join(capitals, "country", "left")
    near = (F.size("actor_countries") > 0) & ~F.array_contains("actor_countries", F.col("country")) & (haversine_km("lat", "lon", "cap_lat", "cap_lon") < km)
    return x.where(~(F.col("violent") & actor) & ~F.coalesce(near, F.lit(False))).drop("cap_lat", "cap_lon")


def url_permission(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """id, allowed: per host the agent's own rule group, else ``*``; the longest matching pattern wins, allow wins ties; no match allows."""
    u = urls.select("id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1).alias("path"))
    own = rules.groupBy("host").agg(F.bool_or(F.col("agent") == agent).alias("own"))
    r = rules.join(own, "host").where(F.col("agent") == F.when(F.col("own"), agent).otherwise("*"))
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    r = r.withColumn("re", F.concat(F.lit("^"), F.when(F.col("pattern").endswith("$"), quoted).otherwise(F.concat(quoted, F.lit(".*"))))).where("pattern <> ''")
    m = u.join(r.select("host", "kind", "pattern", "re"), "host").where("path rlike re").groupBy("id").agg(F.max_by("kind", F.struct(F.length("pattern"), (F.col("kind") == "allow").cast("int"))).alias("kind"))
    return u.join(m, "id", "left").select("id", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))
