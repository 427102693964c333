"""Queries on counters, the risk matrix, capped lists and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import analytics, country, early_warning, geo, indices, merging
from cairn.operators.early_warning import CATEGORY_FAMILY, LEAST_SEVERITY
from cairn.plans.core import AT, DAILY, INDEX, KM, RISK, WITH, _index, query, squares
from cairn.sources import tables
from cairn.sources.tables import NOW

TOLD = f"WITH incident AS ({tables.TOLD})"
RESOURCES = ("market", "bridge", "église")


@query(TOLD + f""", s AS (SELECT n_name || '-' || k unit, n_name, -60 + 5 * n_nationkey + k // 4 y, -150 + 12 * n_nationkey + k % 4 x FROM nation, generate_series(0, 15) t(k)),
f AS (SELECT *, CASE category {' '.join(f"WHEN '{c}' THEN '{v}'" for c, v in CATEGORY_FAMILY.items())} END fam, regexp_matches(lower(strip_accents(title)), '(^|[^a-z0-9_])(market|bridge|eglise)($|[^a-z0-9_])') res FROM incident),
g AS (SELECT id, min(unit) unit, min(CAST(date_trunc('month', date) AS DATE)) "month", min(fam) fam, bool_or(res) res FROM f JOIN s ON s.n_name = f.country AND lat >= y AND lat < y + 1 AND lon >= x AND lon < x + 1 WHERE severity >= CASE WHEN fam IN ({', '.join(f"'{k}'" for k in LEAST_SEVERITY)}) THEN 2 ELSE 0 END AND fam IS NOT NULL GROUP BY id)
SELECT unit, "month", count(*) FILTER (fam = 'sec') sec, count(*) FILTER (fam = 'sec' AND res) res, count(*) FILTER (fam = 'unrest') unrest, count(*) FILTER (fam = 'pol') pol, count(*) FILTER (fam = 'haz') haz, count(*) FILTER (fam = 'infra') infra, count(*) FILTER (fam = 'health') health FROM g GROUP BY 1, 2""")
def incident_months(spark, d):
    return early_warning.monthly_counts(early_warning.family_rows(tables.told_incidents(spark, d), squares(spark, d), words=("market", "bridge", "eglise")))


_ROWS = "CASE category " + " ".join(f"WHEN '{c}' THEN '{k}'" for k, v in country.MATRIX.items() for c in v) + " END"
ADVICE = """SELECT n.n_name AS country, CAST(1 + s.s_suppkey % 4 AS INT) AS level, CASE s.s_suppkey % 7 WHEN 0 THEN 'terrorism' WHEN 1 THEN 'kidnapping' WHEN 2 THEN 'unrest' WHEN 3 THEN 'crime' WHEN 4 THEN 'natural' WHEN 5 THEN 'health' END AS reason FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE s.s_suppkey % 5 < 2"""
KNOWN = "SELECT n.n_name AS country, CASE WHEN n.n_nationkey % 6 > 0 THEN (n.n_nationkey * 17) % 100 END AS stability, CASE WHEN n.n_nationkey % 5 > 0 THEN (n.n_nationkey * 3) % 26 END AS homicide, n.n_nationkey % 3 = 0 AS terrorist_groups, n.n_nationkey % 2 = 0 AS natural_hazards FROM nation n "


@query(TOLD + f""", advice AS ({ADVICE}), known AS ({KNOWN}), c AS (SELECT country, {_ROWS} k, count(*) FILTER (date >= {AT} - INTERVAL 1 DAY) h24, count(*) FILTER (date >= {AT} - INTERVAL 3 DAY) h72, count(*) FILTER (date >= {AT} - INTERVAL 7 DAY) d7, count(*) d90 FROM incident WHERE date >= {AT} - INTERVAL 90 DAY GROUP BY 1, 2),
a AS (SELECT country, max(level) adv, list(reason) FILTER (reason IS NOT NULL) said FROM advice GROUP BY 1), r AS (SELECT unnest([{', '.join(f"'{k}'" for k in country.MATRIX)}]) k),
x AS (SELECT n.country, r.k, coalesce(h24, 0) h24, coalesce(h72, 0) h72, coalesce(d7, 0) d7, coalesce(d90, 0) d90, coalesce(adv, 0) adv, coalesce(said, []) said, stability, homicide, terrorist_groups tg, natural_hazards nh FROM known n CROSS JOIN r LEFT JOIN c ON c.country = n.country AND c.k = r.k LEFT JOIN a ON a.country = n.country),
y AS (SELECT *, CASE WHEN d90 >= 60 THEN 5 WHEN d90 >= 20 THEN 4 WHEN d90 >= 5 THEN 3 WHEN d90 >= 1 THEN 2 ELSE 1 END base,
 CASE k WHEN 'terrorism' THEN greatest(CASE WHEN tg THEN CASE WHEN adv >= 4 THEN 4 ELSE 3 END ELSE 1 END, CASE WHEN list_contains(said, 'terrorism') THEN 3 ELSE 1 END) WHEN 'conflict' THEN CASE WHEN adv >= 4 THEN 4 ELSE 1 END WHEN 'attack' THEN CASE WHEN list_contains(said, 'kidnapping') THEN CASE WHEN adv >= 4 THEN 5 ELSE 4 END ELSE 1 END
  WHEN 'unrest' THEN CASE WHEN list_contains(said, 'unrest') THEN 3 ELSE 1 END WHEN 'political' THEN CASE WHEN stability < 15 THEN 5 WHEN stability < 30 THEN 4 WHEN stability < 50 THEN 3 WHEN stability < 70 THEN 2 ELSE 1 END WHEN 'crime' THEN greatest(CASE WHEN homicide >= 20 THEN 5 WHEN homicide >= 10 THEN 4 WHEN homicide >= 5 THEN 3 WHEN homicide >= 2 THEN 2 ELSE 1 END, CASE WHEN list_contains(said, 'crime') THEN 3 ELSE 1 END)
  WHEN 'natural' THEN CASE WHEN list_contains(said, 'natural') THEN 3 WHEN nh THEN 2 ELSE 1 END WHEN 'cyber' THEN 2 ELSE CASE WHEN list_contains(said, 'health') THEN 3 ELSE 1 END END bump FROM x)
SELECT country, k "row", CAST(least(5, greatest(base, bump)) AS INT) "level", h24, h72, d7, d90, CAST(CASE WHEN d90 < 3 THEN 0 WHEN d7 > d90 / 13.0::DOUBLE * 1.5::DOUBLE THEN 1 WHEN d7 < d90 / 13.0::DOUBLE * 0.5::DOUBLE THEN -1 ELSE 0 END AS INT) trend,
 concat_ws(', ', CASE WHEN k = 'terrorism' AND tg THEN 'terrorist groups' END, CASE WHEN k = 'terrorism' AND list_contains(said, 'terrorism') THEN 'terrorism cited' END, CASE WHEN k = 'conflict' AND adv >= 4 THEN 'do not travel' END, CASE WHEN k = 'attack' AND list_contains(said, 'kidnapping') THEN 'kidnapping cited' END, CASE WHEN k = 'unrest' AND list_contains(said, 'unrest') THEN 'unrest cited' END,
 CASE WHEN k = 'political' AND stability IS NOT NULL THEN 'political stability' END, CASE WHEN k = 'crime' AND homicide IS NOT NULL THEN 'homicides' END, CASE WHEN k = 'crime' AND list_contains(said, 'crime') THEN 'crime cited' END, CASE WHEN k = 'natural' AND nh THEN 'known hazards' END, CASE WHEN k = 'natural' AND list_contains(said, 'natural') THEN 'natural hazards cited' END, CASE WHEN k = 'cyber' THEN 'global threat' END, CASE WHEN k = 'health' AND list_contains(said, 'health') THEN 'health care cited' END, CASE WHEN d90 > 0 THEN 'incidents' END) basis FROM y""")
def risk_matrix(spark, d):
    advice = tables.sql(spark, d, ADVICE).select("country", "level", F.array_compact(F.array("reason")).alias("reasons"))
    known = tables.sql(spark, d, KNOWN)
    return country.risk_matrix(tables.told_incidents(spark, d), advice, NOW, known, known)


@query(WITH + RISK + """, o AS (SELECT n_name country, CAST(1 + n_nationkey % 5 AS INT) lv FROM nation WHERE n_nationkey % 7 = 0)
SELECT risk.* REPLACE (coalesce(lv, "level") AS "level", CASE WHEN lv IS NOT NULL THEN 'analyst' ELSE data_quality END AS data_quality) FROM risk LEFT JOIN o USING (country)""")
def overridden_risk(spark, d):
    overrides = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 7 = 0").selectExpr("n_name AS country", "CAST(1 + n_nationkey % 5 AS INT) AS level")
    return indices.country_risk(tables.incidents(spark, d), tables.advisories(spark, d), NOW, overrides=overrides)


@query(INDEX + ', r AS (SELECT unit, "month", score, row_number() OVER (PARTITION BY unit ORDER BY "month" DESC) n FROM lv) SELECT unit, "month", score, CAST(n AS INT) "rank" FROM r WHERE n <= 12')
def score_history(spark, d):
    return early_warning.score_history(_index(spark, d), "unit")


@query(WITH + f""", n AS (SELECT 'news' kind, id, country, date FROM incident WHERE grp <> 'infrastructure' AND date >= {AT} - INTERVAL 3 DAY ORDER BY date DESC, id LIMIT 800), e AS (SELECT id, country, date, row_number() OVER (PARTITION BY country ORDER BY date DESC, id) r FROM incident WHERE grp = 'infrastructure' AND date >= {AT} - INTERVAL 30 DAY)
SELECT * FROM n UNION ALL SELECT 'economy' kind, id, country, date FROM e WHERE r <= 25""")
def capped_news(spark, d):
    """The newest rows are the feature."""
    x = tables.incidents(spark, d)
    return country.capped_news(x.where("grp <> 'infrastructure'"), x.where("grp = 'infrastructure'"), NOW)


@query(WITH + f""", c AS (SELECT site city, site_lat lat, site_lon lon, CASE site_id % 3 WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 20 END km FROM site),
a AS (SELECT c.city, i.id, i.severity, i.date, row_number() OVER (PARTITION BY c.city ORDER BY i.severity DESC, i.date, i.id) r FROM incident i JOIN c ON abs(i.lat - c.lat) <= 0.4 WHERE {KM('i.lat', 'i.lon', 'c.lat', 'c.lon')} <= c.km),
b AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY severity DESC, date DESC, id) n FROM a WHERE r <= 12) SELECT city, CAST(n AS INT) "rank", id, severity, date FROM b WHERE n <= 4""")
def city_rows(spark, d):
    cities = tables.sites(spark, d).select(F.col("site").alias("city"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"), F.when(F.col("site_id") % 3 == 0, 6_000_000).when(F.col("site_id") % 3 == 1, 2_000_000).otherwise(50_000).alias("population"))
    return country.city_rows(tables.incidents(spark, d), cities)


@query("SELECT c_custkey \"user\", p.doc, p.version FROM customer JOIN (SELECT * FROM (VALUES (0, 'terms', 2), (0, 'privacy', 1), (1, 'terms', 2)) t(kind, doc, version)) p ON p.kind = c_custkey % 2 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CASE o_orderkey % 3 WHEN 0 THEN 'terms' ELSE 'privacy' END = p.doc AND 1 + o_orderkey % 2 = p.version)")
def missing_documents(spark, d):
    required = spark.createDataFrame([(0, "terms", 2), (0, "privacy", 1), (1, "terms", 2)], "kind long, doc string, version long")
    accepted = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_custkey AS user", "CASE o_orderkey % 3 WHEN 0 THEN 'terms' ELSE 'privacy' END AS doc", "1 + o_orderkey % 2 AS version")
    users = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS user", "c_custkey % 2 AS kind")
    return country.missing_documents(required, accepted, users)


@query(WITH + ' SELECT id, country, category, true AS "hist" FROM incident WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)')
def archive_rows(spark, d):
    present = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"))
    return country.not_yet_loaded(tables.incidents(spark, d), present).select("id", "country", "category", "hist")


@query(WITH + DAILY + f""", v AS (SELECT country, arg_max(d7, "day") d7 FROM (SELECT country, "day", round(value - (SELECT arg_max(p.value, p."day") FROM daily p WHERE p.country = t.country AND p."day" <= t."day" - 7), 2) d7 FROM daily t) WHERE d7 IS NOT NULL GROUP BY 1),
d AS (SELECT * FROM incident WHERE confidence <> 'low' AND date >= {AT} - INTERVAL 1 DAY), c AS (SELECT o_orderkey id, n_name country, DATE '2024-01-20' + CAST(o_orderkey % 40 AS INT) d, CASE o_orderkey % 5 WHEN 0 THEN 'election' WHEN 1 THEN 'religious' ELSE 'other' END "type" FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 'severity' "section", 1 "rank", '0' "key", count(*) n FROM d UNION ALL SELECT 'severity', 2, '4', count(*) FILTER (severity = 4) FROM d UNION ALL SELECT 'severity', 3, '3', count(*) FILTER (severity = 3) FROM d UNION ALL SELECT 'severity', 4, '2', count(*) FILTER (severity = 2) FROM d
UNION ALL SELECT 'top', CAST(r AS INT), CAST(id AS VARCHAR), severity FROM (SELECT *, row_number() OVER (ORDER BY severity DESC, date, id) r FROM d WHERE severity >= 3) WHERE r <= 8
UNION ALL SELECT 'hot', CAST(r AS INT), country, n FROM (SELECT country, count(*) n, row_number() OVER (ORDER BY count(*) DESC, country) r FROM incident WHERE confidence <> 'low' AND severity >= 3 AND date >= {AT} - INTERVAL 3 DAY GROUP BY 1) WHERE r <= 5
UNION ALL SELECT 'movers', CAST(r AS INT), country, CAST(round(d7) AS BIGINT) FROM (SELECT *, row_number() OVER (ORDER BY d7, country) r FROM v WHERE d7 <= -5) WHERE r <= 5
UNION ALL SELECT 'soon', CAST(r AS INT), CAST(id AS VARCHAR), d - DATE '2024-01-31' FROM (SELECT *, row_number() OVER (ORDER BY d, id) r FROM c WHERE d BETWEEN DATE '2024-01-31' AND DATE '2024-02-07' AND ("type" IN ('election', 'religious') OR country = 'NATION_3')) WHERE r <= 10""")
def daily_digest(spark, d):
    e = tables.incidents(spark, d)
    calendar = tables.sql(spark, d, "SELECT o.o_orderkey AS id, n.n_name AS country, date_add(DATE'2024-01-20', CAST(o.o_orderkey % 40 AS INT)) AS d, CASE o.o_orderkey % 5 WHEN 0 THEN 'election' WHEN 1 THEN 'religious' ELSE 'other' END AS type FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
    values = indices.value_deltas(indices.daily_values(e)).where("d7 IS NOT NULL")
    return country.daily_digest(e, NOW, values, None, calendar, follow=("NATION_3",))


@query('SELECT n_name || \'-\' || k unit, CAST(-150 + 12 * n_nationkey + k % 4 + 0.5 AS DOUBLE) lon, CAST(-60 + 5 * n_nationkey + k // 4 + 0.5 AS DOUBLE) lat FROM nation, generate_series(0, 15) t(k)')
def inner_points(spark, d):
    return geo.inner_points(squares(spark, d))


@query()
def crisis_chains(spark, d):
    """No SQL: components over all pairs within reach; held against all pairs in tests."""
    x = tables.told_incidents(spark, d).withColumn("precision", F.when(F.col("id") % 97 == 0, "country").otherwise("city"))
    return merging.crisis_chains(x).select("id", "fam", "component")


@query(f"WITH incident AS ({tables.TOLD.replace('SELECT i.id, i.date,', 'SELECT i.id, i.grp, i.is_auto, i.date,')})" + f""", advisory AS ({tables.ADVISORY})""" + RISK + f""", o AS (SELECT country, severity, date FROM incident WHERE date >= {AT} - INTERVAL 3 DAY AND (severity >= 4 OR (severity >= 3 AND (confidence <> 'low' OR source = 'GDACS')) OR (severity >= 2 AND id % 7 = 0) OR (severity >= 2 AND confidence <> 'low' AND (id % 3 = 0 OR id % 10 = 0)))),
x AS (SELECT country, count(*) n, max(severity) max_severity, max(date) "last" FROM o GROUP BY 1), y AS (SELECT *, CASE WHEN max_severity >= 4 OR n >= 5 THEN 'major' WHEN n >= 2 THEN 'crisis' ELSE 'alert' END "level" FROM x)
SELECT y.country, n, max_severity, "last", y."level", CAST(row_number() OVER (ORDER BY CASE y."level" WHEN 'major' THEN 2 WHEN 'crisis' THEN 1 ELSE 0 END DESC, max_severity DESC, coalesce(risk."level", 0) DESC, n DESC, y.country) AS INT) "rank" FROM y LEFT JOIN risk ON risk.country = y.country""")
def ongoing_by_country(spark, d):
    e = tables.told_incidents(spark, d)
    grouped = tables.incidents(spark, d).select("id", "grp", "is_auto")
    e = e.join(grouped, "id").withColumns({"tags": F.when(F.col("id") % 7 == 0, F.array(F.lit("multi-source"))), "start": F.when(F.col("id") % 3 == 0, F.col("date") - F.expr("INTERVAL 8 HOUR")), "near_site": F.col("id") % 10 == 0})
    return analytics.ongoing_by_country(e, NOW, indices.country_risk(e, tables.advisories(spark, d), NOW))
