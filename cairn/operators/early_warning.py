"""Monthly counters per subdivision, climate normals, convergence index and its back-test."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import fold, ladder, month_index
from cairn.operators.geo import locate

FAMILIES = ("sec", "res", "unrest", "pol", "haz", "infra", "health")


#: Family of each category; least severity of a family; words for land, water and herds.
CATEGORY_FAMILY = {
    "terrorism": "sec", "armed_conflict": "sec", "attack": "sec", "crime": "sec", "unrest": "unrest", "political": "pol", "earthquake": "haz", "cyclone": "haz", "storm": "haz", "flood": "haz", "wildfire": "haz", "volcano": "haz", "drought": "haz", "landslide": "haz", "extreme_temp": "haz",
    "infrastructure": "infra", "cyber": "infra", "health": "health",
}
LEAST_SEVERITY = {"haz": 2, "infra": 2, "health": 2}
RESOURCE_WORDS = (
    "pastoral", "herder", "herders", "farmer", "farmers", "cattle", "livestock", "grazing", "pasture", "water", "well", "wells", "land dispute", "land", "fishing", "fishermen", "transhumance", "camel", "cow", "cows", "goats", "rustling", "rustlers", "charcoal", "gold mine", "artisanal mining",
    "eleveur", "eleveurs", "agriculteur", "agriculteurs", "cultivateur", "betail", "troupeau", "paturage", "point d'eau", "puits", "foncier", "terres", "pecheur", "pecheurs", "orpaillage", "orpailleur", "ganado", "agua", "tierra", "vol de betail", "cattle raid", "abigeato",
)


def is_resource(title: Column | str, words: tuple[str, ...] = RESOURCE_WORDS) -> Column:
    """Whether a title has one of the words whole; a missing title has none."""
    return F.coalesce(fold(title).rlike(r"(?<![a-z0-9_])(" + "|".join(re.escape(w) for w in words) + r")(?![a-z0-9_])"), F.lit(False))


def family_rows(incidents: DataFrame, units: DataFrame, families: dict[str, str] = CATEGORY_FAMILY, least: dict[str, int] = LEAST_SEVERITY, words: tuple[str, ...] = RESOURCE_WORDS, subset: str = "sec") -> DataFrame:
    """id, unit, month, family, n of incidents(id, category, severity, date, country, lat, lon, title) in units(unit, country, rings).

    An incident counts once in its category's family, and in ``res`` too if it is of ``subset`` and its title names a resource. Incidents below the
    family's least severity, without position or date, or outside all units of their country don't count; of rows with one id one counts.
    """
    family = F.create_map(*(F.lit(v) for kv in families.items() for v in kv))[F.col("category")]
    floor = F.coalesce(F.create_map(*(F.lit(v) for kv in least.items() for v in kv))[F.col("family")], F.lit(0)) if least else F.lit(0)
    title = F.col("title") if "title" in incidents.columns else F.lit(None).cast("string")
    x = incidents.select("id", "country", "lat", "lon", "severity", family.alias("family"), F.trunc(F.col("date").cast("date"), "month").alias("month"), is_resource(title, words).alias("res"))
    x = x.where("family IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND month IS NOT NULL").where(F.coalesce("severity", F.lit(0)) >= floor).dropDuplicates(["id"])
    x = x.join(locate(x, units, "country"), "id")
    both = F.when(F.col("res") & (F.col("family") == subset), F.array("family", F.lit("res"))).otherwise(F.array("family"))
    return x.select("id", "unit", "month", F.explode(both).alias("family"), F.lit(1).alias("n"))


def monthly_counts(rows: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """unit, month and a counter per family of rows(unit, month, family), or of their sums where they have n."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    return rows.groupBy("unit", "month").agg(*(F.sum(F.when(F.col("family") == f, n).otherwise(0)).cast("long").alias(f) for f in families))


def filled_months(counts: DataFrame) -> DataFrame:
    """Months without rows between a unit's first and last month, as zeros."""
    axis = counts.groupBy("unit").agg(F.min("month").alias("a"), F.max("month").alias("b")).select("unit", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return axis.join(counts, ["unit", "month"], "left").na.fill(0)


def climate_months(rows: DataFrame) -> DataFrame:
    """unit, month and mean rain, temperature and soil wetness."""
    return rows.groupBy("unit", "month").agg(*(F.avg(c).alias(c) for c in ("rain", "temp", "wet")))


def climate_normals(climate: DataFrame, metrics: tuple[str, ...] = ("rain", "temp", "wet"), years: int = 15) -> DataFrame:
    """Each value with mean, least and greatest of the same month in the years before; null without one."""
    w = Window.partitionBy("unit", F.month("month")).orderBy(F.year("month")).rangeBetween(-years, -1)
    out = climate
    for m in metrics:
        out = out.withColumn(f"{m}_avg", F.avg(m).over(w)).withColumn(f"{m}_min", F.min(m).over(w)).withColumn(f"{m}_max", F.max(m).over(w))
    return out


def _unit():
    return Window.partitionBy("unit").orderBy(month_index("month"))


def trends(filled: DataFrame, columns: tuple[str, ...] = ("sec",)) -> DataFrame:
    """Sums of three months and the pace of the twelve months before them, brought to three."""
    out = filled
    for c in columns:
        out = out.withColumn(f"{c}3", F.sum(c).over(_unit().rowsBetween(-2, 0))).withColumn(f"{c}_base", F.round(F.coalesce(F.avg(c).over(_unit().rowsBetween(-14, -3)) * 3, F.lit(0.0)), 6))
    return out


def convergence(counts: DataFrame, climate: DataFrame, humanitarian: DataFrame | None = None, least_rain: float = 30.0) -> DataFrame:
    """Index 0 .. 100 per unit and month: climate 30, conflict 30, society 15, hazards 10, humanitarian 15; without the last, scaled by 100 / 85.

    Values are taken as known in that month. Climate needs three complete months whose usual rain is above ``least_rain``."""
    f = filled_months(counts).withColumn("hz", F.col("haz") + F.col("infra") + F.col("health"))
    t = trends(f, ("sec", "res", "unrest", "pol", "hz"))
    n = climate_normals(climate)
    three = _unit().rowsBetween(-2, 0)
    whole = F.count(F.col("rain") + F.col("rain_avg")).over(three)
    n = n.withColumn("rain_ratio", F.when((whole == 3) & (F.sum("rain_avg").over(three) > least_rain), F.round(F.sum("rain").over(three) / F.sum("rain_avg").over(three), 4))).withColumn("heat", F.round(F.avg(F.col("temp") - F.col("temp_avg")).over(three), 6))
    x = t.join(n, ["unit", "month"], "left")
    r = F.col("rain_ratio")
    rain = F.when(r < 0.5, 18).when(r < 0.7, 11).when(r < 0.85, 5).when(r > 1.8, 11).when(r > 1.4, 6).otherwise(0)
    heat = F.when(F.col("heat") > 1.5, 8).when(F.col("heat") > 0.8, 4).otherwise(0)
    soil = F.when(F.col("wet") < F.col("wet_min"), 4).when(F.col("wet") < F.col("wet_avg") - 0.1, 2).otherwise(0)
    rise = F.try_divide("sec3", "sec_base")
    conflict = ladder("sec3", [(30, 17), (10, 12), (3, 7), (1, 3)], 0) + F.when(F.col("sec3") < 3, 0).when(F.col("sec_base") == 0, 7).when(rise >= 1.5, 9).when(rise >= 1.2, 4).otherwise(0) + F.when(F.col("res3") > 0, 4).otherwise(0)
    up = lambda c, k: (F.col(f"{c}3") >= k) & ((F.col(f"{c}_base") == 0) | (F.try_divide(f"{c}3", f"{c}_base") >= 1.5))
    society = ladder("unrest3", [(10, 6), (3, 4), (1, 2)], 0) + F.when(up("unrest", 3), 6).otherwise(0) + F.when(F.col("pol3") >= 1, 3).otherwise(0)
    hazard = ladder("hz3", [(5, 5), (2, 3), (1, 1)], 0) + F.when(up("hz", 2), 5).otherwise(0)
    x = x.select("unit", "month", "sec", F.least(F.lit(30), rain + heat + soil).alias("cl"), F.least(F.lit(30), conflict).alias("co"), F.least(F.lit(15), society).alias("so"), F.least(F.lit(10), hazard).alias("hz"))
    if humanitarian is None:
        x = x.withColumn("hu", F.lit(0)).withColumn("score", F.round((F.col("cl") + F.col("co") + F.col("so") + F.col("hz")) * 100 / 85).cast("int"))
    else:
        ipc, share = F.col("ipc3"), F.try_divide("idp", "pop")
        hu = F.when(ipc >= 0.4, 9).when(ipc >= 0.25, 6).when(ipc >= 0.15, 3).otherwise(0) + F.when(F.coalesce(F.col("idp"), F.lit(0)) == 0, 0).when(share >= 0.1, 6).when(share >= 0.03, 4).when(share.isNotNull(), 1).when(F.col("idp") >= 100000, 4).otherwise(1)
        x = x.join(humanitarian, "unit", "left").withColumn("hu", F.least(F.lit(15), hu)).drop("ipc3", "idp", "pop").withColumn("score", F.col("cl") + F.col("co") + F.col("so") + F.col("hz") + F.col("hu"))
    return x.withColumn("score", F.least(F.lit(100), "score")).withColumn("level", F.when(F.col("score") >= 60, 4).when(F.col("score") >= 40, 3).when(F.col("score") >= 20, 2).otherwise(1))


def backtest_cases(index: DataFrame, horizon: int = 3, history: int = 15) -> DataFrame:
    """unit, month, level, before, after, escalated for months with enough history and a full horizon ahead."""
    x = index.withColumn("nth", F.row_number().over(_unit())).withColumn("left", F.count("*").over(_unit().rowsBetween(1, horizon)))
    x = x.withColumn("before", F.sum("sec").over(_unit().rowsBetween(-11, 0)) / 12 * horizon).withColumn("after", F.sum("sec").over(_unit().rowsBetween(1, horizon)))
    x = x.where((F.col("nth") > history) & (F.col("left") == horizon))
    return x.withColumn("escalated", (F.col("after") >= 3) & (F.col("after") >= 1.5 * F.greatest("before", F.lit(1.0)))).select("unit", "month", "level", F.round("before", 3).alias("before"), "after", "escalated")


def backtest(index: DataFrame, horizon: int = 3) -> DataFrame:
    """level, n, escalated, rate; the row with a null level is the base rate."""
    c = backtest_cases(index, horizon)
    return c.rollup("level").agg(F.count("*").alias("n"), F.count_if("escalated").alias("escalated"), F.round(F.avg(F.col("escalated").cast("int")), 3).alias("rate"))


def region_summary(index: DataFrame, units: DataFrame, most: int = 10) -> DataFrame:
    """region, level, units with that level in the last month."""
    last = index.groupBy("unit").agg(F.max_by("level", "month").alias("level"), F.max_by("score", "month").alias("score")).join(units.select("unit", "region").distinct(), "unit")
    return last.groupBy("region", "level").agg(F.count("*").alias("units"), F.max("score").alias("max_score"))


def top_exposed(index: DataFrame, component: str = "co", most: int = 5) -> DataFrame:
    """The units of the last month with the highest component, then score, then name."""
    last = index.groupBy("unit").agg(F.max_by(F.struct(component, "score"), "month").alias("s")).select("unit", f"s.{component}", "s.score").where(F.col(component) > 0)
    return last.orderBy(F.desc(component), F.desc("score"), "unit").limit(most)


def live_signals(incidents: DataFrame, trends_: DataFrame, now: str, window: int = 30, base_days: int = 90, least: int = 3, up: float = 1.5, down: float = 0.6) -> DataFrame:
    """Per trend(trend_id, categories, countries): rows of the window, the base scaled to it, the smoothed ratio and a direction."""
    at = F.lit(now).cast("timestamp")
    scope = trends_.select("trend_id", F.explode("categories").alias("category"), "countries").select("trend_id", "category", F.explode("countries").alias("country"))
    x = incidents.where(F.col("date") <= at).join(scope, ["category", "country"])
    start = at - F.expr(f"INTERVAL {window} DAY")
    g = x.groupBy("trend_id").agg(F.count_if(F.col("date") >= start).alias("n"), F.count_if((F.col("date") < start) & (F.col("date") >= start - F.expr(f"INTERVAL {base_days} DAY"))).alias("b"))
    g = trends_.select("trend_id").join(g, "trend_id", "left").na.fill(0).withColumn("base", F.col("b") * window / base_days)
    g = g.withColumn("ratio", F.round((F.col("n") + 1) / (F.col("base") + 1), 4))
    return g.select("trend_id", "n", F.round("base", 1).alias("base"), F.round("ratio", 2).alias("ratio"), F.when((F.col("n") >= least) & (F.col("ratio") >= up), 1).when((F.col("base") >= least) & (F.col("ratio") <= down), -1).otherwise(0).alias("dir"))


def pressure(scores: DataFrame, most: int = 5) -> DataFrame:
    """scope, pressure: the mean of a scope's highest scores (of 25), times four."""
    x = scores.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score")))).where(F.col("r") <= most)
    return x.groupBy("scope").agg(F.round(F.avg("score") * 4).cast("int").alias("pressure"))


def scope_summary(trend_scores: DataFrame, members: DataFrame) -> DataFrame:
    """region and its countries: a region takes in its members' trends, a country its region's; highest score per family and a count per level."""
    own = trend_scores.select("scope", "trend_id", "family", "score")
    down = own.join(members.select(F.col("region").alias("scope"), "country"), "scope").select(F.col("country").alias("scope"), "trend_id", "family", "score")
    up = own.join(members.select(F.col("country").alias("scope"), "region"), "scope").select(F.col("region").alias("scope"), "trend_id", "family", "score")
    every = own.unionByName(down).unionByName(up).dropDuplicates(["scope", "trend_id"])
    return every.groupBy("scope", "family").agg(F.count("*").alias("n"), F.max("score").alias("max_score"), F.count_if(F.col("score") >= 15).alias("high"))


def validate_trends(trends_: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """trend_id, error: one row per broken rule - scales, references, publishers, share of low grades, dates."""
    refs = trends_.select("trend_id", F.explode("sources").alias("source_id")).join(sources, "source_id", "left")
    per = refs.groupBy("trend_id").agg(F.count("*").alias("n"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("publisher").isNull()).alias("unknown"), F.avg(F.col("grade").isin("D", "E", "F").cast("int")).alias("low"))
    x = trends_.join(per, "trend_id", "left")
    checks = F.array(
        F.when(~F.col("likelihood").between(1, 5) | F.col("likelihood").isNull(), "likelihood"), F.when(~F.col("impact").between(1, 5) | F.col("impact").isNull(), "impact"),
        F.when(~F.coalesce(F.col("horizon").isin("short", "medium", "long"), F.lit(False)), "horizon"), F.when(F.coalesce("n", F.lit(0)) < 2, "sources"), F.when(F.coalesce("publishers", F.lit(0)) < 2, "publishers"),
        F.when(F.col("unknown") > 0, "unknown source"), F.when(F.col("low") > 0.5, "low grades"), F.when(F.col("reviewed") > F.lit(now).cast("date"), "review in the future"),
    )
    return x.select("trend_id", F.explode(F.array_compact(checks)).alias("error"))


def score_history(scores: DataFrame, key: str = "trend_id", months: int = 12) -> DataFrame:
    """The last ``months`` monthly scores of each ``key`` in scores(key, month, score), one per month: its last. Ranks are taken per key."""
    w = Window.partitionBy(key).orderBy(F.desc("month"))
    return scores.where("score IS NOT NULL AND month IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= months).select(key, "month", "score", "rank")


def with_snapshot(history: DataFrame, scores: DataFrame, now: str, key: str = "trend_id", months: int = 36) -> DataFrame:
    """history(key, month, score) with the scores of this month in place of what it had, and without what is older than its last ``months`` months."""
    month = F.trunc(F.lit(now).cast("date"), "month")
    kept = history.where(F.col("month") < month).select(key, "month", "score")
    both = kept.unionByName(scores.select(key, month.alias("month"), "score"))
    last = both.select("month").distinct().orderBy(F.desc("month")).limit(months).agg(F.min("month").alias("_first"))  # one row per month
    return both.join(F.broadcast(last), F.col("month") >= F.col("_first")).drop("_first")
