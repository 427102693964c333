"""Country products: risk matrix, mission decisions, digest, calendar, providers, safety checks, structural flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import fold, ladder
from cairn.operators.geo import CIRCLE, within_radius
from cairn.operators.indices import _since

#: Rows of the risk matrix and their categories; levels by incidents of 90 days, by political stability and by homicides.
MATRIX = {
    "terrorism": ("terrorism",), "conflict": ("armed_conflict",), "attack": ("attack",), "unrest": ("unrest",), "political": ("political",), "crime": ("crime",), "cyber": ("cyber", "infrastructure"),
    "natural": ("earthquake", "cyclone", "storm", "flood", "wildfire", "volcano", "drought", "landslide", "extreme_temp"), "health": ("health",),
}
INCIDENT_LEVELS, HOMICIDE_LEVELS = [(60, 5), (20, 4), (5, 3), (1, 2)], [(20, 5), (10, 4), (5, 3), (2, 2)]
STABILITY_LEVELS = [(70, 1), (50, 2), (30, 3), (15, 4)]


def risk_matrix(incidents: DataFrame, advisories: DataFrame, now: str, indicators: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """country, row, level 1 .. 5, h24, h72, d7, d90, trend (-1, 0, 1), basis: nine rows for each country of any side.

    The level comes from the incidents of 90 days. It rises by what is known of the country: advisories(country, level, and maybe reasons, an array),
    indicators(country, stability, homicide), facts(country, terrorist_groups, natural_hazards). ``basis`` names what spoke for the level. A week
    of over half more than usual, or under half, is a trend from three incidents on.
    """
    rows = F.create_map(*(x for k, v in MATRIX.items() for c in v for x in (F.lit(c), F.lit(k))))[F.col("category")]
    within = lambda days: F.count_if(F.col("date") >= _since(now, days))
    counted = incidents.where(F.col("country").isNotNull() & (F.col("date") >= _since(now, 90))).withColumn("row", rows).where("row IS NOT NULL")
    counted = counted.groupBy("country", "row").agg(within(1).alias("h24"), within(3).alias("h72"), within(7).alias("d7"), F.count("*").alias("d90"))
    reasons = F.flatten(F.collect_list("reasons")) if "reasons" in advisories.columns else F.array().cast("array<string>")
    adv = advisories.groupBy("country").agg(F.max("level").alias("adv"), F.array_distinct(reasons).alias("said"))
    countries = incidents.select("country").unionByName(adv.select("country"))
    sides = [adv]
    for side, columns in ((indicators, ("stability", "homicide")), (facts, ("terrorist_groups", "natural_hazards"))):
        if side is not None:
            one = side.groupBy("country").agg(*(F.max(c).alias(c) for c in columns))
            countries = countries.unionByName(one.select("country"))
            sides.append(one)
    x = countries.where("country IS NOT NULL").distinct().withColumn("row", F.explode(F.array(*map(F.lit, MATRIX)))).join(counted, ["country", "row"], "left").na.fill(0, ["h24", "h72", "d7", "d90"])
    for side in sides:
        x = x.join(side, "country", "left")
    has = lambda c: F.col(c) if c in x.columns else F.lit(None)
    row, top = F.col("row"), F.coalesce(F.col("adv"), F.lit(0)) >= 4
    cited = lambda r: F.coalesce(F.array_contains("said", r), F.lit(False))
    raised = [
        ((row == "terrorism") & F.coalesce(has("terrorist_groups").cast("boolean"), F.lit(False)), F.when(top, 4).otherwise(3), "terrorist groups"), ((row == "terrorism") & cited("terrorism"), F.lit(3), "terrorism cited"), ((row == "conflict") & top, F.lit(4), "do not travel"), ((row == "attack") & cited("kidnapping"), F.when(top, 5).otherwise(4), "kidnapping cited"),
        ((row == "unrest") & cited("unrest"), F.lit(3), "unrest cited"), ((row == "political") & has("stability").isNotNull(), ladder(has("stability").cast("double"), STABILITY_LEVELS, 5), "political stability"), ((row == "crime") & has("homicide").isNotNull(), ladder(has("homicide").cast("double"), HOMICIDE_LEVELS, 1), "homicides"),
        ((row == "crime") & cited("crime"), F.lit(3), "crime cited"), ((row == "natural") & F.coalesce(has("natural_hazards").cast("boolean"), F.lit(False)), F.lit(2), "known hazards"), ((row == "natural") & cited("natural"), F.lit(3), "natural hazards cited"), (row == "cyber", F.lit(2), "global threat"), ((row == "health") & cited("health"), F.lit(3), "health care cited"), (F.col("d90") > 0, F.lit(1), "incidents"),
    ]
    level = F.least(F.lit(5), F.greatest(ladder("d90", INCIDENT_LEVELS, 1), *(F.when(test, to).otherwise(1) for test, to, _ in raised)))
    basis = F.array_join(F.array_compact(F.array(*(F.when(test, name) for test, _, name in raised))), ", ")
    usual = F.col("d90") / 13
    trend = F.when(F.col("d90") < 3, 0).when(F.col("d7") > usual * 1.5, 1).when(F.col("d7") < usual * 0.5, -1).otherwise(0)
    return x.select("country", "row", level.cast("int").alias("level"), "h24", "h72", "d7", "d90", trend.alias("trend"), basis.alias("basis"))


def by_country_name(names: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` with country: aliases(alias, country) first, then countries(name, country), both folded to letters and digits. A name that stands for several
    countries takes the least; unknown and missing names have none."""
    key = lambda c: F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))
    known = aliases.select(key("alias").alias("_key"), F.lit(0).alias("_rank"), "country").unionByName(countries.select(key("name").alias("_key"), F.lit(1).alias("_rank"), "country"))
    known = known.where("_key <> ''").groupBy("_key").agg(F.min(F.struct("_rank", "country"))["country"].alias("country"))
    return names.drop("country").withColumn("_key", key("name")).join(known, "_key", "left").drop("_key")


def city_rows(incidents: DataFrame, cities: DataFrame, best: int = 12, most: int = 4) -> DataFrame:
    """city, rank, id, severity, date: of the ``best`` most severe (then earliest) incidents near a city, the ``most`` most severe (then latest).

    Near is 40 km from five million people on, 30 km from a million on, else 20 km; cities(city, lat, lon, population)."""
    radius = ladder("population", [(5_000_000, 40.0), (1_000_000, 30.0)], 20.0)
    severity = F.coalesce("severity", F.lit(1))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(severity.desc(), "date", "id"))
    # the best of a position, of the positions in a circle, of the circles of a city
    spots = incidents.select("id", "lat", "lon", "severity", "date").withColumn("_r", first("lat", "lon")).where(F.col("_r") <= best).drop("_r")
    circles = cities.select("city", F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"), radius.alias("radius_km"))
    x = within_radius(spots, circles.select(*CIRCLE).distinct()).withColumn("_r", first(*CIRCLE)).where(F.col("_r") <= best)
    x = circles.join(x.select(*CIRCLE, "id", "severity", "date"), CIRCLE).withColumn("_r", first("city")).where(F.col("_r") <= best)
    then = Window.partitionBy("city").orderBy(severity.desc(), F.desc("date"), "id")
    return x.withColumn("rank", F.row_number().over(then)).where(F.col("rank") <= most).select("city", "rank", "id", "severity", "date")


def capped_news(news: DataFrame, economy: DataFrame, now: str, news_days: int = 3, news_most: int = 800, economy_days: int = 30, per_country: int = 25) -> DataFrame:
    """kind, id, country, date: the newest ``news_most`` news of the last days, and the newest ``per_country`` economy items of each country; ties by id."""
    n = news.where(F.col("date") >= _since(now, news_days)).orderBy(F.desc("date"), "id").limit(news_most).select(F.lit("news").alias("kind"), "id", "country", "date")
    w = Window.partitionBy("country").orderBy(F.desc("date"), "id")
    e = economy.where(F.col("date") >= _since(now, economy_days)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_country)
    return n.unionByName(e.select(F.lit("economy").alias("kind"), "id", "country", "date"))


def missing_documents(required: DataFrame, accepted: DataFrame, users: DataFrame) -> DataFrame:
    """user, doc, version of required(kind, doc, version) that users(user, kind) haven't accepted in that version."""
    return users.join(required, "kind").join(accepted.select("user", "doc", "version"), ["user", "doc", "version"], "left_anti").select("user", "doc", "version")


def not_yet_loaded(archive: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of an archive whose ids aren't present, each id once, marked as history."""
    return archive.dropDuplicates(["id"]).join(present.select("id"), "id", "left_anti").withColumn("hist", F.lit(True))


def calendar_overlaps(calendar: DataFrame, stays: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """stay, entries of calendar(country, d, end) that touch a stay(country, from, to) give or take some days."""
    # different entries meet different stays; how many there are of each is counted
    c = calendar.withColumn("end", F.coalesce(F.col("end"), F.col("d"))).groupBy("country", "d", "end").agg(F.count("*").alias("n"))
    s = stays.select("country", "from", "to").distinct()
    x = s.join(c, "country").where((F.col("end") >= F.date_sub("from", before)) & (F.col("d") <= F.date_add("to", after)))
    met = x.groupBy("country", "from", "to").agg(F.sum("n").alias("entries"), F.min("d").alias("first"))
    return stays.join(met, ["country", "from", "to"]).groupBy("stay").agg(F.sum("entries").alias("entries"), F.min("first").alias("first"))


def mission_decision(level, advice, severe_near):
    """go, conditions, approval or no-go by country level, highest advisory and severe incidents nearby."""
    return F.when((advice >= 4) | (level >= 5), "no-go").when((level >= 4) | (severe_near >= 5), "approval").when((level >= 3) | (severe_near >= 1), "conditions").otherwise("go")


def go_no_go(missions: DataFrame) -> DataFrame:
    """Threat 1 .. 5 from level, nearby severe incidents and calendar entries; vulnerability 1 .. 5 from nine answers; the product gives the code."""
    threat = F.least(F.lit(5), F.col("level") + (F.col("severe_near") >= 3).cast("int") + (F.col("entries") > 0).cast("int"))
    answers = [f"a{i}" for i in range(1, 10)]
    weak = sum(F.when(F.coalesce(F.col(a), F.lit(False)), 0).otherwise(1) for a in answers)
    v = F.lit(1) + F.floor(weak / F.lit(2)).cast("int")
    x = missions.withColumn("threat", threat).withColumn("vulnerability", v).withColumn("product", F.col("threat") * F.col("vulnerability"))
    conditions = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(a), F.lit(False)), F.lit(a)) for a in answers)))
    return x.select("mission", "threat", "vulnerability", "product", F.when(F.col("product") >= 16, "no-go").when(F.col("product") >= 9, "approval").when(F.col("product") >= 5, "conditions").otherwise("go").alias("code"), F.array_join(conditions, ",").alias("missing"))


def digest(incidents: DataFrame, now: str) -> DataFrame:
    """section, key, n: a day's rows by severity, the five hottest countries of 72 hours, categories of the week."""
    day = incidents.where(F.col("date") >= _since(now, 1)).groupBy(F.col("severity").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("severity_24h").alias("section"), "key", "n")
    hot = incidents.where((F.col("date") >= _since(now, 3)) & (F.col("severity") >= 3)).groupBy(F.col("country").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(5).select(F.lit("hot_72h").alias("section"), "key", "n")
    week = incidents.where(F.col("date") >= _since(now, 7)).groupBy(F.col("category").alias("key")).agg(F.count("*").alias("n")).select(F.lit("week").alias("section"), "key", "n")
    return day.unionByName(hot).unionByName(week)


def daily_digest(incidents: DataFrame, now: str, values: DataFrame | None = None, crises: DataFrame | None = None, calendar: DataFrame | None = None, min_severity: int = 3, most: int = 8, follow: tuple[str, ...] = ()) -> DataFrame:
    """section, rank, key, n: what a daily message tells.

    ``severity``: reliable rows of 24 hours by severity (4, 3, 2, and all of them as 0). ``top``: the ``most`` most severe of them, those with more sources first (``sources``, where there is such
    a column), then the earliest; n is the severity. ``hot``: the five countries with most severe reliable rows of 72 hours. ``movers``: the five countries whose
    value of values(country, day, value, d7) of the last day fell by 5 or more in seven days. ``escalating``: four active crises(component, status, trend, n) that escalate or are new.
    ``soon``: ten entries of calendar(id, country, d, type) in the coming week that are elections, religious days, or of a country in ``follow``. Ties go by key.
    """
    def ranked(x: DataFrame, section: str, key: Column, n: Column, order: list[Column], limit: int) -> DataFrame:
        first = x.orderBy(*order).limit(limit)
        return first.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("rank"), key.cast("string").alias("key"), n.cast("long").alias("n"))  # at most ``limit`` rows

    reliable = incidents.where(F.coalesce(F.col("confidence"), F.lit("")) != "low")
    day = reliable.where(F.col("date") >= _since(now, 1))
    counts = day.agg(F.count("*").alias("0"), *(F.count_if(F.col("severity") == s).alias(str(s)) for s in (4, 3, 2)))
    levels = counts.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("key"), F.col(c).alias("n")) for i, c in enumerate(("0", "4", "3", "2"))))).alias("s")).select(F.lit("severity").alias("section"), "s.rank", "s.key", "s.n")
    sources = F.coalesce(F.size("sources"), F.lit(0)) if "sources" in incidents.columns else F.lit(0)
    out = levels.unionByName(ranked(day.where(F.col("severity") >= min_severity).withColumn("_s", sources), "top", F.col("id"), F.col("severity"), [F.desc("severity"), F.desc("_s"), F.asc("date"), F.asc("id")], most))
    hot = reliable.where((F.col("date") >= _since(now, 3)) & (F.col("severity") >= 3) & F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("n"))
    out = out.unionByName(ranked(hot, "hot", F.col("country"), F.col("n"), [F.desc("n"), F.asc("country")], 5))
    if values is not None:
        last = values.groupBy("country").agg(F.max_by("d7", "day").alias("d7")).where("d7 <= -5")
        out = out.unionByName(ranked(last, "movers", F.col("country"), F.round("d7"), [F.asc("d7"), F.asc("country")], 5))
    if crises is not None:
        out = out.unionByName(ranked(crises.where((F.col("status") == "active") & F.col("trend").isin("escalating", "new")), "escalating", F.col("component"), F.col("n"), [F.desc("n"), F.asc("component")], 4))
    if calendar is not None:
        today = F.lit(now).cast("date")
        soon = calendar.where(F.col("d").between(today, F.date_add(today, 7)) & (F.col("type").isin("election", "religious") | F.col("country").isin(list(follow))))
        out = out.unionByName(ranked(soon, "soon", F.col("id"), F.datediff("d", today), [F.asc("d"), F.asc("id")], 10))
    return out


#: Weights of the thirteen criteria of a provider.
PROVIDER_WEIGHTS = {"licence": 15, "insurance": 12, "references": 10, "local_team": 8, "training": 8, "vehicles": 7, "medical": 7, "comms": 7, "reporting": 6, "languages": 5, "coverage_24h": 5, "ethics_code": 5, "audit": 5}


def provider_scores(providers: DataFrame, documents: DataFrame, now: str) -> DataFrame:
    """Score 0 .. 100 and tier; licence and insurance count only with an active document (not rejected, not expired; insurance needs an expiry)."""
    ok = (F.col("status") != "rejected") & (F.col("expires_on").isNull() | (F.col("expires_on") >= F.lit(now).cast("date"))) & ((F.col("kind") != "insurance") | F.col("expires_on").isNotNull())
    d = documents.groupBy("provider_id").agg(*(F.bool_or(ok & (F.col("kind") == k)).alias(f"has_{k}") for k in ("licence", "insurance")))
    x = providers.join(d, "provider_id", "left")
    score = sum(F.when(F.coalesce(F.col(f"has_{c}") if c in ("licence", "insurance") else F.col(c), F.lit(False)), w).otherwise(0) for c, w in PROVIDER_WEIGHTS.items())
    return x.select("provider_id", score.alias("score")).withColumn("tier", F.when(F.col("score") >= 80, 1).when(F.col("score") >= 60, 2).when(F.col("score") >= 40, 3).otherwise(4))


def provider_scope(providers: DataFrame, tiers: DataFrame) -> DataFrame:
    """category, scope: providers by the number of regions they cover (local 1, regional up to 3, global), with the best tier."""
    x = providers.select("provider_id", "category", F.explode("regions").alias("region")).groupBy("provider_id", "category").agg(F.countDistinct("region").alias("k"))
    x = x.withColumn("scope", F.when(F.col("k") > 3, "global").when(F.col("k") > 1, "regional").otherwise("local")).join(tiers, "provider_id")
    return x.groupBy("category", "scope").agg(F.count("*").alias("n"), F.min("tier").alias("best_tier"))


def merged_directory(registered: DataFrame, listed: DataFrame) -> DataFrame:
    """Registered providers, and listed ones whose web domain isn't registered."""
    return registered.unionByName(listed.join(registered.select("domain").distinct(), "domain", "left_anti"), allowMissingColumns=True)


def audience(checks: DataFrame, profiles: DataFrame) -> DataFrame:
    """check_id, profile_id: same organisation, and everybody, or the country (place, base or travel list), or the circle."""
    c = checks.select("check_id", "org", "scope", F.col("country").alias("c_country"), F.col("circle").alias("c_circle"))
    x = c.join(profiles, "org")
    here = (F.col("country") == F.col("c_country")) | (F.col("base") == F.col("c_country")) | F.array_contains("travel", F.col("c_country"))
    return x.where((F.col("scope") == "all") | ((F.col("scope") == "country") & F.coalesce(here, F.lit(False))) | ((F.col("scope") == "circle") & F.array_contains("circles", F.col("c_circle")))).select("check_id", "profile_id")


def check_tally(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """check_id and counts of the latest answers: help, safe, none."""
    last = responses.groupBy("check_id", "profile_id").agg(F.max_by("status", "at").alias("status"))
    x = targets.join(last, ["check_id", "profile_id"], "left").withColumn("status", F.coalesce("status", F.lit("none")))
    return x.groupBy("check_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("help", "none", "safe")))


def unanswered(targets: DataFrame, responses: DataFrame) -> DataFrame:
    return targets.join(responses, ["check_id", "profile_id"], "left_anti")


def structural_flags(indicators: DataFrame) -> DataFrame:
    """country, flags from the latest value per (country, key): recession, inflation, debt, unemployment, stability, spread against DE."""
    w = indicators.groupBy("country", "key").agg(F.max_by("value", "year").alias("v"))
    x = w.groupBy("country").pivot("key", ["growth", "inflation", "debt", "unemployment", "stability", "yield"]).agg(F.first("v"))
    de = x.where("country = 'DE'").select(F.col("yield").alias("de"))
    x = x.join(F.broadcast(de.limit(1)), F.lit(True), "left")
    flags = F.array(
        F.when(F.col("growth") < 0, "recession"), F.when(F.col("inflation") >= 10, "inflation"), F.when(F.col("debt") >= 100, "debt"), F.when(F.col("unemployment") >= 15, "unemployment"),
        F.when(F.col("stability") < 20, "instability"), F.when((F.col("yield") - F.col("de")) * 100 >= 150, "spread"),
    )
    return x.select("country", F.array_compact(flags).alias("flags"))


def project_totals(projects: DataFrame, most: int = 6) -> DataFrame:
    """country, sector, amount, rank: development projects by keyword sector, and each country's totals."""
    t = fold("title")
    sector = F.when(t.rlike("health|hospital"), "health").when(t.rlike("school|education"), "education").when(t.rlike("road|transport|rail"), "transport").when(t.rlike("water|sanitation"), "water").when(t.rlike("energy|power|solar"), "energy").otherwise("other")
    g = projects.groupBy("country", sector.alias("sector")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("amount"), "sector"))).where(F.col("rank") <= most)


def select_cities(places: DataFrame, km: float = 25, most: int = 9) -> DataFrame:
    """Per country the capital, then tracked and populous cities that no chosen one is near; a suppressed city suppresses none, so a country's small table is walked in order."""

    def pick(pdf):
        import numpy as np

        pdf = pdf.sort_values(["capital", "tracked", "population", "place"], ascending=[False, False, False, True])
        kept: list = []
        for r in pdf.itertuples():
            near = False
            for k in kept:
                a, b = np.radians([r.lat, k.lat]), np.radians([r.lon, k.lon])
                h = np.sin((a[1] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(a[1]) * np.sin((b[1] - b[0]) / 2) ** 2
                near |= 2 * 6371 * np.arcsin(min(1, h**0.5)) < km
            if not near and len(kept) < most:
                kept.append(r)
        import pandas as pd

        return pd.DataFrame([(r.country, r.place, i + 1) for i, r in enumerate(kept)], columns=["country", "place", "rank"])

    return places.select("country", "place", "lat", "lon", "population", "capital", "tracked").groupBy("country").applyInPandas(pick, "country string, place string, rank int")
