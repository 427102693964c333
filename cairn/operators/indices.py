"""Country risk, stability index and the windows over daily values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import RISK_WEIGHTS, SECURITY_GROUPS, activity, event_weight, level_of


def _since(now: str, days: float):
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{int(days * 24)}' HOUR")


def country_risk(incidents: DataFrame, advisories: DataFrame, now: str, window_days: int = 7, overrides: DataFrame | None = None) -> DataFrame:
    """Risk level 1 .. 5 per country from advisories and the last days' incidents.

    Diplomatic rows don't count; rows dated after ``now`` do (warnings may start later). Countries come from either side. Without
    advisories the score is divided by the remaining weights; a do-not-travel advisory makes the level 4 at least.
    ``overrides(country, level)``: an analyst's level stands instead, for countries that have a row.
    """
    w = RISK_WEIGHTS
    recent = incidents.where(F.col("country").isNotNull() & (F.col("date") >= _since(now, window_days)) & (F.col("grp") != "diplomatic")).withColumn("w", event_weight()).withColumn("sec", F.col("grp").isin(*SECURITY_GROUPS))
    events = recent.groupBy("country").agg(
        F.sum(F.when(F.col("sec"), F.col("w"))).alias("sec_points"), F.sum(F.when(~F.col("sec"), F.col("w"))).alias("haz_points"),
        F.count_if("sec").alias("n_security"), F.count_if(~F.col("sec")).alias("n_hazards"),
    )
    norm = (F.col("level") - 1) / (F.col("scale") - 1)
    adv = advisories.groupBy("country").agg(F.avg(norm).alias("adv"), F.max(norm).alias("adv_max"))
    both = events.join(adv, "country", "full").withColumn("s", activity("sec_points")).withColumn("h", activity("haz_points"))
    score = F.when(F.col("adv").isNull(), (w["security"] * F.col("s") + w["hazards"] * F.col("h")) / (w["security"] + w["hazards"])).otherwise(w["advisories"] * F.col("adv") + w["security"] * F.col("s") + w["hazards"] * F.col("h"))
    both = both.withColumn("raw", score)
    level = F.when(F.col("adv_max") >= 1, F.greatest(level_of("raw"), F.lit(4))).otherwise(level_of("raw"))
    zero = F.lit(0).cast("long")
    set_by = F.lit(None).cast("int")
    if overrides is not None:
        both = both.join(overrides.groupBy("country").agg(F.max("level").cast("int").alias("_set")), "country", "left")
        set_by = F.col("_set")
    level = F.coalesce(set_by, level)
    return both.select(
        "country", level.cast("int").alias("level"), F.round("raw", 3).alias("score"), F.round("adv", 3).alias("advisories"), F.round("s", 3).alias("security"), F.round("h", 3).alias("hazards"),
        F.coalesce("n_security", zero).alias("n_security"), F.coalesce("n_hazards", zero).alias("n_hazards"), F.when(set_by.isNotNull(), "analyst").when(F.col("adv").isNull(), "events-only").otherwise("advisories+events").alias("data_quality"),
    )


def anomaly(recent, prior):
    """How far seven days stand out from the 23 before: 0 below 3 points, full at three times the usual."""
    base = prior / 23 * 7
    return F.when(recent < 3, 0.0).when(base <= 0.5, F.least(F.lit(1.0), recent / 20)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.try_divide(recent, base) - 1) / 2)))


def stability_index(incidents: DataFrame, risk: DataFrame, now: str) -> DataFrame:
    """0 (very unstable) .. 100 per country of ``risk``, from one scan of 30 days."""
    rows = incidents.where((F.col("date") >= _since(now, 30)) & (F.col("grp") != "diplomatic") & F.col("grp").isin(*SECURITY_GROUPS)).withColumn("w", event_weight())
    late = F.col("date") >= _since(now, 7)
    sums = rows.groupBy("country").agg(F.sum(F.when(late, F.col("w")).otherwise(0.0)).alias("recent"), F.sum(F.when(~late, F.col("w")).otherwise(0.0)).alias("prior"))
    x = risk.join(sums, "country", "left").na.fill(0.0, ["recent", "prior", "advisories"]).withColumn("an", anomaly(F.round("recent", 6), F.round("prior", 6)))
    inst = 0.45 * F.col("advisories") + 0.30 * F.col("security") + 0.15 * F.col("an") + 0.10 * F.col("hazards")
    return x.select("country", F.round(100 * (1 - F.least(F.lit(1.0), inst)), 2).alias("value"), F.round("an", 3).alias("anomaly"), F.round("recent", 3).alias("recent"), F.round("prior", 3).alias("prior"))


def stability_drivers(incidents: DataFrame, now: str, most: int = 3) -> DataFrame:
    """Categories whose weight rose by 2 or more against the usual, the strongest first."""
    late = F.col("date") >= _since(now, 7)
    rows = incidents.where((F.col("date") >= _since(now, 30)) & (F.col("grp") != "diplomatic")).withColumn("w", event_weight())
    d = rows.groupBy("country", "category").agg(F.sum(F.when(late, F.col("w")).otherwise(0.0)).alias("a"), F.sum(F.when(~late, F.col("w")).otherwise(0.0)).alias("b"))
    d = d.withColumn("delta", F.round(F.col("a") - F.col("b") / 23 * 7, 6)).where("a > 0 AND delta >= 2")
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("delta"), "category"))
    return d.withColumn("rank", rank).where(F.col("rank") <= most).select("country", "category", "rank", F.round("delta", 1).alias("delta"))


def daily_values(incidents: DataFrame) -> DataFrame:
    """country, day, value: 100 less the day's log-saturated activity; one row per country and day with incidents."""
    w = incidents.withColumn("w", event_weight()).groupBy("country", F.col("date").cast("date").alias("day")).agg(F.sum("w").alias("w"))
    return w.select("country", "day", F.round(100 * (1 - activity("w")), 2).alias("value"))


def _by_day(country: str = "country"):
    return Window.partitionBy(country).orderBy(F.datediff("day", F.lit("1970-01-01")))


def value_deltas(series: DataFrame, back: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Each value against the last one on or before n days earlier."""
    out = series
    for n in back:
        old = F.last("value", ignorenulls=True).over(_by_day().rangeBetween(Window.unboundedPreceding, -n))
        out = out.withColumn(f"d{n}", F.round(F.col("value") - old, 2))
    return out


def sparkline(series: DataFrame, points: int = 30) -> DataFrame:
    """The last values per country in order of day, joined by commas."""
    last = series.withColumn("r", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("day")))).where(F.col("r") <= points)
    values = F.array_sort(F.collect_list(F.struct("day", "value")))
    return last.groupBy("country").agg(F.count("*").alias("points"), F.array_join(F.transform(values, lambda v: v["value"].cast("decimal(10,2)").cast("string")), ",").alias("spark"))


def threshold_alerts(series: DataFrame, threshold: float = 40, drop: float = 12, margin: float = 3) -> DataFrame:
    """Days that fall under the threshold by a margin after a week at or above it, or that drop within seven days."""
    week = F.max("value").over(Window.partitionBy("country").orderBy("day").rowsBetween(-7, -1))
    n = F.row_number().over(Window.partitionBy("country").orderBy("day"))
    x = value_deltas(series, (7,)).withColumn("week", week).withColumn("n", n).where("n >= 3")
    crossed = (F.col("value") <= threshold - margin) & (F.col("week") >= threshold)
    fell = F.coalesce(F.col("d7") <= -drop, F.lit(False))
    return x.where(crossed | fell).select("country", "day", "value", F.when(crossed, "threshold").otherwise("drop").alias("reason"))


def level_changes(levels: DataFrame) -> DataFrame:
    """Rows of (country, source, day, level) whose level differs from the day before in the table."""
    prev = F.lag("level").over(Window.partitionBy("country", "source").orderBy("day"))
    return levels.withColumn("previous", prev).where("previous IS NOT NULL AND level <> previous").select("country", "source", "day", F.col("previous").alias("from_level"), F.col("level").alias("to_level"))


def recent_level_changes(levels: DataFrame, now: str, days: int = 30, last: int = 4) -> DataFrame:
    """The newest ``last`` changes of each country in the ``days`` before ``now``, by ``rank`` from 1; of one day, the alphabetically last source is the newest.

    A day without a level is no change: the next level is held against the last one known. Countries without a change have no row."""
    newest = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("day"), F.desc("source")))
    kept = level_changes(levels.where("level IS NOT NULL")).where(F.col("day") >= F.date_sub(F.lit(now).cast("date"), days))
    return kept.withColumn("rank", newest).where(F.col("rank") <= last)


def failure_streaks(runs: DataFrame) -> DataFrame:
    """Longest and current run of failures per source, by gaps and islands over (source, run, ok)."""
    w = Window.partitionBy("source").orderBy("run")
    isl = runs.withColumn("island", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = isl.groupBy("source", "island").agg(F.count_if(~F.col("ok")).alias("n"))
    return per.groupBy("source").agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("current_streak"))


def sessions(incidents: DataFrame, keys: list[str], gap_hours: int = 72) -> DataFrame:
    """Chains in time: rows of one key no further apart than the gap."""
    w = Window.partitionBy(*keys).orderBy("date", "id")
    far = F.coalesce(F.unix_micros("date") - F.lag(F.unix_micros("date")).over(w) > gap_hours * 3_600_000_000, F.lit(True))
    chain = F.sum(far.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return incidents.withColumn("_far", far).withColumn("chain", F.sum(F.col("_far").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "chain").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("last"), F.max("severity").alias("max_severity"))
