"""Violations of a set of trends, sources, drivers and scopes: a catalogue of checks as data, compiled into one scan per table.

A check on a row is a name and a predicate; all of a table's checks are evaluated together and the names that hold are exploded. A check on a
reference is a name and where the references of a row come from; all references of all tables meet what is known in one anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that a trend must have in both languages, scales, and least numbers.
TEXTS = ("title", "summary")
SCALE, MOMENTUM, HORIZONS, CONFIDENCE, LOW_GRADES = (1, 2, 3, 4, 5), (-1, 0, 1), ("3m", "12m", "36m"), ("low", "medium", "high"), ("D", "E", "F")
LEAST_SOURCES, LEAST_PUBLISHERS, MOST_LOW_SHARE = 2, 2, 0.5
DATE = r"^\d{4}(-\d{2}){0,2}$"
SKEW_DAYS = 1


def _empty(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) == ""


def _day(c: Column) -> Column:
    """The first day that a date of year, month or day names."""
    return F.concat(c, F.when(F.length(c) == 4, "-01-01").when(F.length(c) == 7, "-01").otherwise("")).try_cast("date")


def _future(c: Column, now: str) -> Column:
    return F.coalesce(_day(c) > F.date_add(F.lit(now).cast("date"), SKEW_DAYS), F.lit(False))


def _signals(test) -> Column:
    return F.coalesce(F.exists("signals", test), F.lit(False))


def row_checks(now: str) -> dict[str, dict[str, Column]]:
    """For each table, checks on its rows: name and predicate."""
    readable = lambda d: F.coalesce(d.rlike(DATE), F.lit(False))
    off = lambda c, scale: ~F.coalesce(F.col(c).isin(*scale), F.lit(False))
    text = lambda k: F.coalesce(F.exists("texts", lambda t: (t["key"] == k) & ~_blank(t["fr"]) & ~_blank(t["en"])), F.lit(False))
    reviewed = F.coalesce("reviewed", "scope_reviewed")
    return {
        "source": {
            **{f"source without {c}": _blank(c) for c in ("t", "pub", "url", "kind", "rel")},
            "link isn't secure": ~_blank("url") & ~(F.col("url").startswith("https://") | F.col("url").endswith(".html")),
        },
        "scope": {
            "unknown type": off("type", ("region", "country")), "region without box": (F.col("type") == "region") & (F.coalesce(F.size("bbox"), F.lit(0)) != 4), "country not in its region": F.coalesce((F.col("type") == "country") & ~F.array_contains(F.coalesce("parent_countries", F.array().cast("array<string>")), F.col("scope")) & F.col("parent_known"), F.lit(False)),
        },
        "trend": {
            **{f"text {k} not in both languages": ~text(k) for k in TEXTS},
            "no driver": _empty("drivers"), "likelihood off the scale": off("likelihood", SCALE), "impact on business off the scale": off("impact_business", SCALE), "impact on travel off the scale": off("impact_travel", SCALE), "unknown horizon": off("horizon", HORIZONS), "momentum off the scale": off("momentum", MOMENTUM), "unknown confidence": off("confidence", CONFIDENCE),
            "no signal": _empty("signals"), "signal not in both languages": _signals(lambda s: _blank(s["fr"]) | _blank(s["en"])), "signal without source": _signals(lambda s: F.coalesce(F.size(s["src"]), F.lit(0)) <= 0), "signal with unreadable date": _signals(lambda s: s["d"].isNotNull() & ~readable(s["d"])), "signal in the future": _signals(lambda s: readable(s["d"]) & _future(s["d"], now)),
            "no warning indicator": _empty("watch"), "no review date": ~readable(reviewed), "review in the future": readable(reviewed) & _future(reviewed, now),
            "too few sources": F.col("n_cited") < LEAST_SOURCES, "too few publishers": F.col("n_publishers") < LEAST_PUBLISHERS, "too many sources of low grade": (F.col("n_cited") > 0) & (F.col("n_low") / F.greatest(F.col("n_cited"), F.lit(1)) > MOST_LOW_SHARE), "trend id twice": F.col("n_same_id") > 1,
        },
    }


#: For each table, checks on references: name, kind of what is referred to, and the array of references.
REFERENCES = {
    "driver": {"driver of unknown family": ("family", "array(family)"), "driver with unknown source": ("source", "flatten(indicators)")},
    "source": {"unknown grade": ("grade", "CASE WHEN trim(rel) <> '' THEN array(rel) END")},
    "scope": {"unknown parent region": ("scope", "CASE WHEN type = 'country' THEN array(coalesce(parent, '')) END")},
    "trend": {
        "unknown family": ("family", "array(coalesce(family, ''))"), "unknown second family": ("family", "also"), "unknown driver": ("driver", "drivers"), "unknown sector": ("sector", "sectors"), "signal with unknown source": ("source", "flatten(transform(signals, s -> coalesce(s.src, array())))"), "unknown incident category": ("category", "live"), "link to unknown trend": ("trend", "links"),
    },
}
_NAMES = {"driver": "id", "source": "id", "scope": "scope", "trend": "concat_ws('/', scope, trend_id)"}


def _referred(check: str, of: str, where: str) -> Column:
    """Structs (check, of, ref) of the references that an expression gives."""
    return F.transform(F.coalesce(F.expr(where), F.array().cast("array<string>")), lambda r: F.struct(F.lit(check).alias("check"), F.lit(of).alias("of"), r.alias("ref")))


def violations(trends: DataFrame, sources: DataFrame, drivers: DataFrame, scopes: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """kind, name, check, detail: every violation once; none means that the set may be published.

    trends(scope, trend_id, family, also, texts array of (key, fr, en), drivers, likelihood, impact_business, impact_travel, horizon, momentum, confidence, sectors, signals array of
    (fr, en, src, d), watch, reviewed, live, links); sources(id, t, pub, url, kind, rel); drivers(id, family, indicators array of arrays of
    source ids); scopes(scope, type, bbox, countries, parent, reviewed); known(kind, id) for families, sectors, grades and categories.
    """
    ids = known.select("kind", "id").unionByName(sources.select(F.lit("source").alias("kind"), "id")).unionByName(drivers.select(F.lit("driver").alias("kind"), "id"))
    ids = ids.unionByName(scopes.select(F.lit("scope").alias("kind"), F.col("scope").alias("id"))).unionByName(trends.select(F.lit("trend").alias("kind"), F.col("trend_id").alias("id"))).where("id IS NOT NULL").distinct()
    cited = trends.select("scope", "trend_id", F.explode(F.array_distinct(F.flatten(F.transform("signals", lambda s: F.coalesce(s["src"], F.array().cast("array<string>")))))).alias("id")).join(sources.select("id", "pub", "rel"), "id")
    cited = cited.groupBy("scope", "trend_id").agg(F.countDistinct("id").alias("n_cited"), F.countDistinct("pub").alias("n_publishers"), F.count_if(F.col("rel").isin(*LOW_GRADES)).alias("n_low"))
    t = trends.join(cited, ["scope", "trend_id"], "left").na.fill(0, ["n_cited", "n_publishers", "n_low"]).join(scopes.select("scope", F.col("reviewed").alias("scope_reviewed")), "scope", "left")
    t = t.join(trends.groupBy("trend_id").agg(F.count("*").alias("n_same_id")), "trend_id", "left").withColumn("n_same_id", F.coalesce("n_same_id", F.lit(0)))
    parents = scopes.select(F.col("scope").alias("parent"), F.col("countries").alias("parent_countries"), F.lit(True).alias("parent_known"))
    tables = {"trend": t, "source": sources, "driver": drivers, "scope": scopes.join(parents, "parent", "left").withColumn("parent_known", F.coalesce("parent_known", F.lit(False)))}
    out = []
    for kind, checks in row_checks(now).items():
        names = F.array_compact(F.array(*(F.when(test, name) for name, test in checks.items())))
        out.append(tables[kind].select(F.lit(kind).alias("kind"), F.expr(_NAMES[kind]).alias("name"), F.explode(names).alias("check"), F.lit(None).cast("string").alias("detail")))
    refs = []
    for kind, checks in REFERENCES.items():
        each = F.flatten(F.array(*(_referred(check, of, where) for check, (of, where) in checks.items())))
        refs.append(tables[kind].select(F.lit(kind).alias("kind"), F.expr(_NAMES[kind]).alias("name"), F.explode(each).alias("r")).select("kind", "name", "r.*"))
    lost = reduce(DataFrame.unionByName, refs).join(ids.select(F.col("kind").alias("of"), F.col("id").alias("ref")), ["of", "ref"], "left_anti")
    out.append(lost.select("kind", "name", "check", F.col("ref").alias("detail")))
    owners = scopes.where("type = 'region'").select("scope", F.explode("countries").alias("country")).withColumn("n", F.count("*").over(Window.partitionBy("country"))).where("n > 1")
    out.append(owners.select(F.lit("scope").alias("kind"), F.col("scope").alias("name"), F.lit("country in two regions").alias("check"), F.col("country").alias("detail")))
    return reduce(DataFrame.unionByName, out).distinct()
