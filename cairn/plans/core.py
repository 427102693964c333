"""Queries over the incident adapter, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.exprs import STORY_STOP
from cairn.operators import analytics, country, early_warning, geo, indices, merging, press, quality, text
from cairn.sources import tables
from cairn.sources.tables import ADVISORY, CALENDAR, HEADLINE, INCIDENT, LINE, MIXED, NOW, SITE, UNIT_MONTH

QUERIES: dict = {}
SQL: dict[str, str] = {}

AT = f"TIMESTAMP '{NOW}'"
W = "(CASE severity WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 8 ELSE 20 END * CASE confidence WHEN 'low' THEN 3e-1 WHEN 'medium' THEN 6e-1 ELSE 1e0 END * CASE WHEN is_auto THEN 5e-1 ELSE 1e0 END)"
ACT = lambda p: f"least(1e0, ln(1 + coalesce({p}, 0)) / ln(151))"
KM = lambda a, b, c, d: f"2 * 6371 * asin(sqrt(least(1e0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
WITH = f"WITH incident AS ({INCIDENT}), advisory AS ({ADVISORY}), site AS ({SITE})"


WITH_MIXED = f"WITH incident AS ({MIXED})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RISK = f""", ev AS (SELECT country, sum(CASE WHEN grp IN ('security', 'political') THEN {W} END) sp, sum(CASE WHEN grp NOT IN ('security', 'political') THEN {W} END) hp,
  count(*) FILTER (grp IN ('security', 'political')) n_security, count(*) FILTER (grp NOT IN ('security', 'political')) n_hazards FROM incident WHERE date >= {AT} - INTERVAL 7 DAY GROUP BY 1),
adv AS (SELECT country, avg((level - 1) / 3.0::DOUBLE) adv, max((level - 1) / 3.0::DOUBLE) top FROM advisory GROUP BY 1),
j AS (SELECT coalesce(ev.country, adv.country) country, adv, top, {ACT('sp')} s, {ACT('hp')} h, coalesce(n_security, 0) n_security, coalesce(n_hazards, 0) n_hazards FROM ev FULL JOIN adv ON ev.country = adv.country),
r AS (SELECT *, CASE WHEN adv IS NULL THEN (0.3::DOUBLE * s + 0.1::DOUBLE * h) / 0.4::DOUBLE ELSE 0.6::DOUBLE * adv + 0.3::DOUBLE * s + 0.1::DOUBLE * h END raw FROM j),
risk AS (SELECT country, CAST(greatest(1 + (raw >= 0.15)::INT + (raw >= 0.35)::INT + (raw >= 0.55)::INT + (raw >= 0.75)::INT, CASE WHEN top >= 1 THEN 4 ELSE 1 END) AS INT) "level", round(raw, 3) score, round(adv, 3) advisories, round(s, 3) "security", round(h, 3) hazards, n_security, n_hazards,
  CASE WHEN adv IS NULL THEN 'events-only' ELSE 'advisories+events' END data_quality FROM r)"""


@query(WITH + RISK + " SELECT * FROM risk")
def country_risk(spark, d):
    return indices.country_risk(tables.incidents(spark, d), tables.advisories(spark, d), NOW)


@query(WITH + RISK + f""", p AS (SELECT country, round(sum(CASE WHEN date >= {AT} - INTERVAL 7 DAY THEN {W} ELSE 0 END), 6) re, round(sum(CASE WHEN date < {AT} - INTERVAL 7 DAY THEN {W} ELSE 0 END), 6) pr FROM incident WHERE date >= {AT} - INTERVAL 30 DAY AND grp IN ('security', 'political') GROUP BY 1),
x AS (SELECT risk.*, coalesce(re, 0) re, coalesce(pr, 0) pr FROM risk LEFT JOIN p USING (country)), y AS (SELECT *, CASE WHEN re < 3 THEN 0 WHEN pr / 23 * 7 <= 0.5 THEN least(1, re / 20) ELSE greatest(0, least(1, (re / (pr / 23 * 7) - 1) / 2)) END an FROM x)
SELECT country, round(100 * (1 - least(1e0, 0.45::DOUBLE * coalesce(advisories, 0) + 0.3::DOUBLE * "security" + 0.15::DOUBLE * an + 0.1::DOUBLE * hazards)), 2) "value", round(an, 3) anomaly, round(re, 3) recent, round(pr, 3) prior FROM y""")
def stability_index(spark, d):
    e = tables.incidents(spark, d)
    return indices.stability_index(e, indices.country_risk(e, tables.advisories(spark, d), NOW), NOW)


@query(WITH + f""", g AS (SELECT country, category, sum(CASE WHEN date >= {AT} - INTERVAL 7 DAY THEN {W} ELSE 0 END) a, sum(CASE WHEN date < {AT} - INTERVAL 7 DAY THEN {W} ELSE 0 END) b FROM incident WHERE date >= {AT} - INTERVAL 30 DAY GROUP BY 1, 2),
h AS (SELECT country, category, round(a - b / 23 * 7, 6) dl FROM g WHERE a > 0), r AS (SELECT country, category, CAST(row_number() OVER (PARTITION BY country ORDER BY dl DESC, category) AS INT) "rank", dl FROM h WHERE dl >= 2) SELECT country, category, "rank", round(dl, 1) delta FROM r WHERE "rank" <= 3""")
def stability_drivers(spark, d):
    return indices.stability_drivers(tables.incidents(spark, d), NOW)


DAILY = f", daily AS (SELECT country, CAST(date AS DATE) AS \"day\", round(100 * (1 - {ACT(f'sum({W})')}), 2) AS value FROM incident GROUP BY 1, 2)"


@query(WITH + DAILY + " SELECT country, \"day\", value, round(value - (SELECT arg_max(p.value, p.\"day\") FROM daily p WHERE p.country = t.country AND p.\"day\" <= t.\"day\" - 7), 2) d7, round(value - (SELECT arg_max(p.value, p.\"day\") FROM daily p WHERE p.country = t.country AND p.\"day\" <= t.\"day\" - 30), 2) d30 FROM daily t")
def value_deltas(spark, d):
    return indices.value_deltas(indices.daily_values(tables.incidents(spark, d)))


@query(WITH + DAILY + ", r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY \"day\" DESC) n FROM daily) SELECT country, count(*) points, string_agg(CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR), ',' ORDER BY \"day\") spark FROM r WHERE n <= 30 GROUP BY 1")
def sparkline(spark, d):
    return indices.sparkline(indices.daily_values(tables.incidents(spark, d)))


@query(WITH + DAILY + """, w AS (SELECT *, row_number() OVER o n, max(value) OVER (PARTITION BY country ORDER BY "day" ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) wk, round(value - (SELECT arg_max(p.value, p."day") FROM daily p WHERE p.country = t.country AND p."day" <= t."day" - 7), 2) d7 FROM daily t WINDOW o AS (PARTITION BY country ORDER BY "day"))
SELECT country, "day", value, CASE WHEN value <= 37 AND wk >= 40 THEN 'threshold' ELSE 'drop' END reason FROM w WHERE n >= 3 AND ((value <= 37 AND wk >= 40) OR coalesce(d7 <= -12, false))""")
def threshold_alerts(spark, d):
    return indices.threshold_alerts(indices.daily_values(tables.incidents(spark, d)))


@query(WITH + """, l AS (SELECT country, source, CAST(date AS DATE) AS "day", max(severity) AS level FROM incident GROUP BY 1, 2, 3), p AS (SELECT *, lag(level) OVER (PARTITION BY country, source ORDER BY "day") prev FROM l)
SELECT country, source, "day", prev from_level, level to_level FROM p WHERE prev IS NOT NULL AND prev <> level""")
def level_changes(spark, d):
    return indices.level_changes(tables.incidents(spark, d).groupBy("country", "source", F.col("date").cast("date").alias("day")).agg(F.max("severity").alias("level")))


@query(WITH + f""", l AS (SELECT country, source, CAST(date AS DATE) AS "day", max(severity) AS level FROM incident GROUP BY 1, 2, 3), p AS (SELECT *, lag(level) OVER (PARTITION BY country, source ORDER BY "day") prev FROM l),
c AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY "day" DESC, source DESC) "rank" FROM p WHERE prev <> level AND "day" >= CAST({AT} AS DATE) - 30)
SELECT country, source, "day", prev from_level, level to_level, CAST("rank" AS INT) "rank" FROM c WHERE "rank" <= 4""")
def recent_level_changes(spark, d):
    levels = tables.incidents(spark, d).groupBy("country", "source", F.col("date").cast("date").alias("day")).agg(F.max("severity").alias("level"))
    return indices.recent_level_changes(levels, NOW)


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) source, event_id run, event_type <> 'error' ok FROM events), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source ORDER BY run) island FROM r),
p AS (SELECT source, island, count(*) FILTER (NOT ok) n FROM i GROUP BY 1, 2) SELECT source, max(n) longest, arg_max(n, island) current_streak FROM p GROUP BY 1""")
def failure_streaks(spark, d):
    return indices.failure_streaks(tables.sql(spark, d, "SELECT CAST(user_id AS STRING) AS source, event_id AS run, event_type <> 'error' AS ok FROM events "))


@query(WITH + """, x AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY country, category ORDER BY date, id) <= INTERVAL 72 HOUR THEN 0 ELSE 1 END far FROM incident), y AS (SELECT *, sum(far) OVER (PARTITION BY country, category ORDER BY date, id) chain FROM x)
SELECT country, category, CAST(chain AS BIGINT) chain, count(*) n, min(date) "start", max(date) "last", max(severity) max_severity FROM y GROUP BY 1, 2, 3""")
def crisis_sessions(spark, d):
    return indices.sessions(tables.incidents(spark, d), ["country", "category"])


@query(WITH + f""", w AS (SELECT * FROM (VALUES ('24h', 1), ('72h', 3), ('7d', 7), ('30d', 30), ('90d', 90)) t(win, n)), x AS (SELECT country, category, severity, win FROM incident JOIN w ON date >= {AT} - to_days(n))
SELECT country, win, category, severity, count(*) n FROM x GROUP BY GROUPING SETS ((country, win), (country, win, category), (country, win, severity))""")
def country_stats(spark, d):
    return analytics.country_stats(tables.incidents(spark, d), NOW)


@query(WITH + f""", a AS (SELECT CAST(unnest(generate_series(DATE '2024-01-31' - 89, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS "day"), p AS (SELECT CAST(date AS DATE) AS "day", count(*) n, {', '.join(f"count(*) FILTER (grp = '{g}') {g}" for g in ('security', 'political', 'natural', 'infrastructure'))}, {', '.join(f"count(*) FILTER (severity = {s}) sev{s}" for s in (1, 2, 3, 4))} FROM incident GROUP BY 1)
SELECT a."day", coalesce(n, 0) n, coalesce(security, 0) security, coalesce(political, 0) political, coalesce("natural", 0) "natural", coalesce(infrastructure, 0) infrastructure, coalesce(sev1, 0) sev1, coalesce(sev2, 0) sev2, coalesce(sev3, 0) sev3, coalesce(sev4, 0) sev4 FROM a LEFT JOIN p ON a."day" = p."day\"""".replace(') natural,', ') "natural",'))
def global_series(spark, d):
    return analytics.global_series(tables.incidents(spark, d), NOW)


@query(WITH + ' SELECT source, count(*) n, max(date) "last" FROM incident GROUP BY 1')
def by_source(spark, d):
    return analytics.by_source(tables.incidents(spark, d))


@query(WITH + """, n AS (SELECT country, place, count(*) n FROM incident GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY n DESC, place) AS INT) "rank" FROM n) SELECT * FROM r WHERE "rank" <= 5""")
def top_places(spark, d):
    return analytics.top_places(tables.incidents(spark, d))


@query(WITH + " SELECT count(*) n, count(*) FILTER (severity >= 3) severe, count(DISTINCT country) countries, count(DISTINCT source) sources, count(*) FILTER (is_auto) machine_coded, round(avg(severity), 3) mean_severity FROM incident")
def kpis(spark, d):
    return analytics.kpis(tables.incidents(spark, d))


@query(WITH + " SELECT CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', date)) / 86400) AS BIGINT) bucket, grp, count(*) n FROM incident WHERE date >= TIMESTAMP '2024-01-01' AND date < TIMESTAMP '2024-01-31' GROUP BY 1, 2")
def time_buckets(spark, d):
    return analytics.time_buckets(tables.incidents(spark, d), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query(WITH + " SELECT id, country, category, severity FROM incident WHERE category IN ('attack', 'unrest') AND severity >= 3 AND NOT is_auto AND date >= TIMESTAMP '2024-01-10'")
def filtered_incidents(spark, d):
    return tables.incidents(spark, d).where(analytics.conjunction(categories=["attack", "unrest"], min_severity=3, include_auto=False, start="2024-01-10 00:00:00")).select("id", "country", "category", "severity")


@query(WITH + f""", b AS (SELECT country, round(count(*) / 1.0::DOUBLE, 3) monthly FROM incident WHERE grp = 'security' AND date < TIMESTAMP '2024-01-16' GROUP BY 1), a AS (SELECT country, count(*) live FROM incident WHERE grp = 'security' AND date >= {AT} - INTERVAL 30 DAY AND date >= TIMESTAMP '2024-01-20' GROUP BY 1),
x AS (SELECT country, coalesce(live, 0) live, monthly, round(coalesce(live, 0) / monthly, 3) ratio FROM b LEFT JOIN a USING (country) WHERE monthly >= 15) SELECT *, CASE WHEN ratio < 0.2 THEN 'low' WHEN ratio < 0.5 THEN 'partial' ELSE 'good' END coverage FROM x""")
def coverage(spark, d):
    e = tables.incidents(spark, d)
    return analytics.coverage(e.where("date >= TIMESTAMP '2024-01-20'"), analytics.baseline(e.where("date < TIMESTAMP '2024-01-16'"), 1.0), NOW)


@query("SELECT count(*) feeds, count(*) FILTER (value >= 20) working, CAST(sum(user_id) AS BIGINT) \"rows\", count(DISTINCT event_type) sources FROM events")
def feed_coverage(spark, d):
    return analytics.feed_coverage(tables.sql(spark, d, "SELECT event_type AS source, value >= 20 AS ok, user_id AS count FROM events "))


@query("WITH h AS (SELECT user_id outlet, value >= 400 hit FROM events) SELECT outlet, count(*) asked, count(*) FILTER (hit) hits FROM h GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (hit) = 0 ORDER BY asked DESC, outlet LIMIT 60")
def muted_outlets(spark, d):
    return analytics.muted_outlets(tables.sql(spark, d, "SELECT user_id AS outlet, value >= 400 AS hit FROM events "))


@query(WITH + f" SELECT id, date, country, category, severity, lat, lon, place FROM incident WHERE date >= {AT} - INTERVAL 7 DAY ORDER BY severity DESC, date DESC, id LIMIT 1500")
def guest_view(spark, d):
    return analytics.guest_view(tables.incidents(spark, d), NOW)


@query(WITH + """, r AS (SELECT CAST(date_trunc('month', date) AS DATE) "month", CAST(row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY severity DESC, value DESC, id) AS INT) "rank", id, severity FROM incident) SELECT * FROM r WHERE "rank" <= 600""")
def notable_by_month(spark, d):
    return analytics.notable_by_month(tables.incidents(spark, d))


@query(WITH + """, r AS (SELECT country, CAST(date AS DATE) "day", CAST(row_number() OVER (PARTITION BY country, CAST(date AS DATE) ORDER BY value DESC, id) AS INT) "rank", id FROM incident) SELECT * FROM r WHERE "rank" <= 15""")
def top_per_day(spark, d):
    return analytics.top_per_day(tables.incidents(spark, d))


NEAR = f", near AS (SELECT i.*, s.site, s.site_id, s.radius_km, s.min_severity, {KM('i.lat', 'i.lon', 's.site_lat', 's.site_lon')} km FROM incident i JOIN site s ON {KM('i.lat', 'i.lon', 's.site_lat', 's.site_lon')} <= s.radius_km)"


@query(WITH + NEAR + " SELECT id, site, severity, round(km, 3) km FROM near WHERE confidence <> 'low' AND severity >= min_severity")
def site_alerts(spark, d):
    return geo.site_alerts(tables.incidents(spark, d), tables.sites(spark, d))


@query(WITH + NEAR + ", r AS (SELECT id, site, km, row_number() OVER (PARTITION BY id ORDER BY round(km, 6), site) n FROM near) SELECT id, site, round(km, 3) km FROM r WHERE n = 1")
def nearest_site(spark, d):
    return geo.nearest_site(tables.incidents(spark, d), tables.sites(spark, d))


SEGMENT = """(SELECT a.site_id % 10 AS k, concat('route-', CAST(a.site_id AS VARCHAR(10))) AS name, a.site_lat AS a_lat, a.site_lon AS a_lon, a.site_lat + 2.0 AS b_lat, a.site_lon + 1.5 AS b_lon, CAST(30 AS DOUBLE) AS buffer_km FROM site a)"""
K = "cos(radians(i.lat))"


@query(WITH + f""", s AS {SEGMENT}, g AS (SELECT i.id, s.name, s.buffer_km, (a_lon - i.lon) * {K} ax, a_lat - i.lat ay, (b_lon - a_lon) * {K} dx, b_lat - a_lat dy FROM incident i, s WHERE abs(i.lat - a_lat) < 4 AND abs(i.lon - a_lon) < 12),
t AS (SELECT *, greatest(0e0, least(1e0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) t FROM g), k AS (SELECT id, name, buffer_km, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) * radians(1e0) * 6371 km FROM t) SELECT id, name, round(min(km), 3) km FROM k WHERE km <= buffer_km GROUP BY 1, 2""")
def corridor_alerts(spark, d):
    s = tables.sites(spark, d).selectExpr("concat('route-', site_id) AS name", "site_lat AS a_lat", "site_lon AS a_lon", "site_lat + 2.0D AS b_lat", "site_lon + 1.5D AS b_lon", "30.0D AS buffer_km")
    return geo.corridor_alerts(tables.incidents(spark, d), s)


def squares(spark, d):
    """Four by four squares of one degree per nation, as polygons."""
    k = F.explode(F.sequence(F.lit(0), F.lit(15)))
    s = spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_nationkey", k.alias("k")).withColumn("y", -60.0 + 5 * F.col("n_nationkey") + F.floor(F.col("k") / 4)).withColumn("x", -150.0 + 12 * F.col("n_nationkey") + F.col("k") % 4)
    p = lambda i, j: F.struct((F.col("x") + i).cast("double").alias("x"), (F.col("y") + j).cast("double").alias("y"))
    return s.select(F.concat_ws("-", "n_name", "k").alias("unit"), F.col("n_name").alias("country"), F.array(F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))).alias("rings"))


@query(WITH + """, s AS (SELECT n_name || '-' || k unit, n_name, -60 + 5 * n_nationkey + k // 4 y, -150 + 12 * n_nationkey + k % 4 x FROM nation, generate_series(0, 15) t(k)) SELECT id, min(unit) unit FROM incident i JOIN s ON s.n_name = i.country AND lat >= y AND lat < y + 1 AND lon >= x AND lon < x + 1 GROUP BY 1""")
def locate_units(spark, d):
    return geo.locate(tables.incidents(spark, d), squares(spark, d), "country")


@query("SELECT n_name || '-' || k unit, 1e0 area, CAST(-150 + 12 * n_nationkey + k % 4 + 0.5 AS DOUBLE) lon, CAST(-60 + 5 * n_nationkey + k // 4 + 0.5 AS DOUBLE) lat, CAST(-150 + 12 * n_nationkey + k % 4 AS DOUBLE) x0, CAST(-60 + 5 * n_nationkey + k // 4 AS DOUBLE) y0, CAST(-149 + 12 * n_nationkey + k % 4 AS DOUBLE) x1, CAST(-59 + 5 * n_nationkey + k // 4 AS DOUBLE) y1 FROM nation, generate_series(0, 15) t(k)")
def ring_measures(spark, d):
    return geo.ring_measures(squares(spark, d)).select("unit", *(F.round(c, 6).alias(c) for c in ("area", "lon", "lat", "x0", "y0", "x1", "y1")))


@query(WITH + f""", c AS (SELECT i.*, s.country sc, s.site city FROM incident i JOIN site s ON {KM('i.lat', 'i.lon', 's.site_lat', 's.site_lon')} <= s.radius_km),
g AS (SELECT sc country, city, count(*) n90, count(*) FILTER (date >= {AT} - INTERVAL 30 DAY) n30, count(*) FILTER (severity >= 3) severe, CAST(sum(severity) AS BIGINT) points FROM c GROUP BY 1, 2)
SELECT *, round(n90 / sum(n90) OVER (PARTITION BY country), 3) share, CASE WHEN points >= 200 THEN 4 WHEN points >= 80 THEN 3 WHEN points >= 20 THEN 2 ELSE 1 END "level" FROM g""")
def city_activity(spark, d):
    return geo.city_activity(tables.incidents(spark, d), tables.sites(spark, d).withColumnRenamed("site", "city"), NOW)


@query(WITH + f""", x AS (SELECT c.country, c.site city, a.site airport, {KM('c.site_lat', 'c.site_lon', 'a.site_lat', 'a.site_lon')} km FROM site c JOIN site a ON c.country = a.country AND a.site_id % 3 = 0 WHERE c.site_id % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY country, city ORDER BY round(km, 6), airport) n FROM x WHERE km <= 400) SELECT country, city, airport, round(km, 3) km FROM r WHERE n = 1""")
def nearest_airports(spark, d):
    s = tables.sites(spark, d)
    return geo.nearest_in_country(s.where("site_id % 3 <> 0").withColumnRenamed("site", "city"), s.where("site_id % 3 = 0").selectExpr("country", "site AS airport", "site_lat AS lat", "site_lon AS lon"), 400)


@query(WITH + f""", f AS (SELECT *, CASE category WHEN 'attack' THEN 'violence' WHEN 'unrest' THEN 'unrest' WHEN 'flood' THEN 'weather' WHEN 'earthquake' THEN 'earthquake' ELSE 'cyber' END fam, CASE category WHEN 'attack' THEN 60 WHEN 'unrest' THEN 40 WHEN 'flood' THEN 300 WHEN 'earthquake' THEN 150 ELSE 400 END r FROM incident)
SELECT a.id a, b.id b FROM f a JOIN f b ON a.country = b.country AND a.fam = b.fam AND a.id < b.id AND abs(epoch_us(a.date) - epoch_us(b.date)) <= 72 * 3600000000 AND {KM('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= a.r""")
def crisis_links(spark, d):
    return merging.crisis_links(tables.incidents(spark, d))


@query()
def crises(spark, d):
    return merging.crises(tables.incidents(spark, d), NOW)


SENSOR = f""", r AS (SELECT * FROM incident WHERE category = 'earthquake' AND source NOT IN ('USGS', 'EMSC', 'GDACS', 'WHO')),
o AS (SELECT * FROM incident WHERE category = 'earthquake' AND source IN ('USGS', 'EMSC', 'GDACS')),
x AS (SELECT r.id report, o.id official, round({KM('r.lat', 'r.lon', 'o.lat', 'o.lon')}, 6) km FROM r JOIN o ON (epoch_us(r.date) - epoch_us(o.date)) / 3600000000.0 BETWEEN -6 AND 72 WHERE {KM('r.lat', 'r.lon', 'o.lat', 'o.lon')} <= 300),
m AS (SELECT report, official, km FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY km, official) n FROM x) WHERE n = 1)"""


@query(WITH_MIXED + SENSOR + " SELECT report, official, round(km, 3) km FROM m")
def sensor_matches(spark, d):
    return merging.sensor_matches(tables.mixed_incidents(spark, d))


@query(WITH_MIXED + SENSOR + " SELECT official, count(*) reports, greatest(any_value(o.severity), least(max(r.severity), any_value(o.severity) + 1)) severity FROM m JOIN incident r ON r.id = report JOIN incident o ON o.id = official GROUP BY 1")
def attached_reports(spark, d):
    e = tables.mixed_incidents(spark, d)
    return merging.attach_reports(merging.sensor_matches(e), e)


MONTHS = f"""WITH um AS ({UNIT_MONTH}), mc AS (SELECT unit, "month", count(*) FILTER (flag = 'R') sec, count(*) FILTER (flag = 'R' AND status = 'O') res, count(*) FILTER (flag = 'A') unrest, count(*) FILTER (flag = 'A' AND status = 'O') pol, count(*) FILTER (flag = 'N') haz, count(*) FILTER (flag = 'N' AND status = 'O') infra, count(*) FILTER (flag = 'N' AND status = 'F') health FROM um GROUP BY 1, 2),
ax AS (SELECT unit, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) "month" FROM (SELECT unit, min("month") a, max("month") b FROM mc GROUP BY 1)),
fm AS (SELECT unit, "month", coalesce(sec, 0) sec, coalesce(res, 0) res, coalesce(unrest, 0) unrest, coalesce(pol, 0) pol, coalesce(haz, 0) haz, coalesce(infra, 0) infra, coalesce(health, 0) health, coalesce(haz, 0) + coalesce(infra, 0) + coalesce(health, 0) hz FROM ax LEFT JOIN mc USING (unit, "month")),
cm AS (SELECT unit, "month", avg(rain) rain, avg("temp") "temp", avg(wet) wet FROM um GROUP BY 1, 2),
cn AS (SELECT *, {', '.join(f'avg("{m}") OVER p {m}_avg, min("{m}") OVER p {m}_min, max("{m}") OVER p {m}_max' for m in ('rain', 'temp', 'wet'))} FROM cm WINDOW p AS (PARTITION BY unit, month("month") ORDER BY year("month") RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING))"""
TREND = ", ".join(f'CAST(sum({c}) OVER (PARTITION BY unit ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) {c}3, round(coalesce(avg({c}) OVER (PARTITION BY unit ORDER BY "month" ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) * 3, 0), 6) {c}_base' for c in ("sec", "res", "unrest", "pol", "hz"))
W3 = '(PARTITION BY unit ORDER BY "month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)'
INDEX = MONTHS + f""", tr AS (SELECT *, {TREND} FROM fm),
c3 AS (SELECT *, CASE WHEN count(rain + rain_avg) OVER {W3} = 3 AND sum(rain_avg) OVER {W3} > 0 THEN round(sum(rain) OVER {W3} / sum(rain_avg) OVER {W3}, 4) END rr, round(avg("temp" - temp_avg) OVER {W3}, 6) heat FROM cn),
pt AS (SELECT t.unit, t."month", t.sec,
 least(30, CASE WHEN rr < 0.5 THEN 18 WHEN rr < 0.7 THEN 11 WHEN rr < 0.85 THEN 5 WHEN rr > 1.8 THEN 11 WHEN rr > 1.4 THEN 6 ELSE 0 END + CASE WHEN heat > 1.5 THEN 8 WHEN heat > 0.8 THEN 4 ELSE 0 END + CASE WHEN wet < wet_min THEN 4 WHEN wet < wet_avg - 0.1 THEN 2 ELSE 0 END) cl,
 least(30, CASE WHEN sec3 >= 30 THEN 17 WHEN sec3 >= 10 THEN 12 WHEN sec3 >= 3 THEN 7 WHEN sec3 >= 1 THEN 3 ELSE 0 END + CASE WHEN sec3 < 3 THEN 0 WHEN sec_base = 0 THEN 7 WHEN sec3 / sec_base >= 1.5 THEN 9 WHEN sec3 / sec_base >= 1.2 THEN 4 ELSE 0 END + CASE WHEN res3 > 0 THEN 4 ELSE 0 END) co,
 least(15, CASE WHEN unrest3 >= 10 THEN 6 WHEN unrest3 >= 3 THEN 4 WHEN unrest3 >= 1 THEN 2 ELSE 0 END + CASE WHEN unrest3 >= 3 AND (unrest_base = 0 OR unrest3 / nullif(unrest_base, 0) >= 1.5) THEN 6 ELSE 0 END + CASE WHEN pol3 >= 1 THEN 3 ELSE 0 END) so,
 least(10, CASE WHEN hz3 >= 5 THEN 5 WHEN hz3 >= 2 THEN 3 WHEN hz3 >= 1 THEN 1 ELSE 0 END + CASE WHEN hz3 >= 2 AND (hz_base = 0 OR hz3 / nullif(hz_base, 0) >= 1.5) THEN 5 ELSE 0 END) hz FROM tr t LEFT JOIN c3 USING (unit, "month")),
ix AS (SELECT *, 0 hu, CAST(least(100, round((cl + co + so + hz) * 100 / 85.0::DOUBLE)) AS INT) score FROM pt), lv AS (SELECT *, CASE WHEN score >= 60 THEN 4 WHEN score >= 40 THEN 3 WHEN score >= 20 THEN 2 ELSE 1 END "level" FROM ix)"""


@query(MONTHS + " SELECT unit, \"month\", sec, res, unrest, pol, haz, infra, health FROM mc")
def monthly_counts(spark, d):
    return early_warning.monthly_counts(tables.family_months(spark, d))


NORMALS = [f"{m}{e}" for m in ("rain", "temp", "wet") for e in ("", "_avg", "_min", "_max")]


@query(MONTHS + ' SELECT unit, "month", ' + ", ".join(f'round("{c}", 9) "{c}"' for c in NORMALS) + " FROM cn")
def climate_normals(spark, d):
    n = early_warning.climate_normals(early_warning.climate_months(tables.unit_months(spark, d)))
    return n.select("unit", "month", *(F.round(c, 9).alias(c) for c in NORMALS))


def _index(spark, d):
    counts, climate = early_warning.monthly_counts(tables.family_months(spark, d)), early_warning.climate_months(tables.unit_months(spark, d))
    return early_warning.convergence(counts, climate, least_rain=0.0)  # rain of these tables is a share, not millimetres


@query(INDEX + " SELECT * FROM lv")
def convergence_index(spark, d):
    return _index(spark, d)


CASES = INDEX + """, bt AS (SELECT unit, "month", "level", row_number() OVER o nth, count(*) OVER f lft, sum(sec) OVER (PARTITION BY unit ORDER BY "month" ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / 12.0::DOUBLE * 3 bf, sum(sec) OVER f af FROM lv WINDOW o AS (PARTITION BY unit ORDER BY "month"), f AS (PARTITION BY unit ORDER BY "month" ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
cs AS (SELECT unit, "month", "level", round(bf, 3) "before", CAST(af AS BIGINT) "after", af >= 3 AND af >= 1.5 * greatest(bf, 1) escalated FROM bt WHERE nth > 15 AND lft = 3)"""


@query(CASES + " SELECT * FROM cs")
def backtest_cases(spark, d):
    return early_warning.backtest_cases(_index(spark, d))


@query(CASES + ' SELECT "level", count(*) n, count(*) FILTER (escalated) escalated, round(avg(escalated::INT), 3) rate FROM cs GROUP BY ROLLUP ("level")')
def backtest(spark, d):
    return early_warning.backtest(_index(spark, d))


@query(INDEX + """, la AS (SELECT unit, arg_max("level", "month") "level", arg_max(score, "month") score FROM lv GROUP BY 1), rg AS (SELECT DISTINCT unit, region FROM um) SELECT region, "level", count(*) units, max(score) max_score FROM la JOIN rg USING (unit) GROUP BY 1, 2""")
def region_summary(spark, d):
    return early_warning.region_summary(_index(spark, d), tables.unit_months(spark, d))


@query(INDEX + """, la AS (SELECT unit, arg_max(co, "month") co, arg_max(score, "month") score FROM lv GROUP BY 1) SELECT * FROM la WHERE co > 0 ORDER BY co DESC, score DESC, unit LIMIT 5""")
def top_exposed(spark, d):
    return early_warning.top_exposed(_index(spark, d))


def _trends(spark, d):
    """A trend per region and group: categories of the group over the region's countries."""
    groups = {"security": ["attack"], "political": ["unrest"], "natural": ["flood", "earthquake"]}
    n = tables.sql(spark, d, "SELECT n.n_name AS country, r.r_name AS region FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
    r = n.groupBy("region").agg(F.collect_list("country").alias("countries"))
    return r.crossJoin(spark.createDataFrame(list(groups.items()), "family string, categories array<string>")).select(F.concat_ws("/", "region", "family").alias("trend_id"), "region", "family", "categories", "countries")


LIVE = WITH + f""", fa AS (SELECT *, CASE grp WHEN 'security' THEN 'security' WHEN 'political' THEN 'political' WHEN 'natural' THEN 'natural' END fam FROM incident WHERE date <= {AT}),
tl AS (SELECT r_name || '/' || f trend_id, r_name, f FROM region, (VALUES ('security'), ('political'), ('natural')) v(f)),
ct AS (SELECT trend_id, count(id) FILTER (date >= {AT} - INTERVAL 10 DAY) n, count(id) FILTER (date < {AT} - INTERVAL 10 DAY AND date >= {AT} - INTERVAL 30 DAY) b FROM tl LEFT JOIN fa ON fa.region = r_name AND fam = f GROUP BY 1),
ra AS (SELECT *, b * 10 / 20.0::DOUBLE base, round((n + 1) / (b * 10 / 20.0::DOUBLE + 1), 4) q FROM ct)"""


@query(LIVE + " SELECT trend_id, n, round(base, 1) base, round(q, 2) ratio, CASE WHEN n >= 3 AND q >= 1.02 THEN 1 WHEN base >= 3 AND q <= 0.98 THEN -1 ELSE 0 END dir FROM ra")
def live_signals(spark, d):
    return early_warning.live_signals(tables.incidents(spark, d), _trends(spark, d), NOW, window=10, base_days=20, up=1.02, down=0.98)


@query("""WITH s AS (SELECT n.n_name scope, (1 + p.s_suppkey % 5) * (1 + p.s_suppkey % 4) score FROM supplier p JOIN nation n ON n.n_nationkey = p.s_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC) k FROM s) SELECT scope, CAST(round(avg(score) * 4) AS INT) pressure FROM r WHERE k <= 5 GROUP BY 1""")
def trend_pressure(spark, d):
    return early_warning.pressure(tables.sql(spark, d, "SELECT n.n_name AS scope, (1 + p.s_suppkey % 5) * (1 + p.s_suppkey % 4) AS score FROM supplier p JOIN nation n ON n.n_nationkey = p.s_nationkey"))


@query("""WITH o AS (SELECT n.n_name c, r.r_name g, p.s_suppkey t, CASE p.s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END f, (1 + p.s_suppkey % 5) * (1 + p.s_suppkey % 4) s, p.s_suppkey % 7 = 0 top FROM supplier p JOIN nation n ON n.n_nationkey = p.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey),
x AS (SELECT c scope, t, f, s FROM o WHERE NOT top UNION SELECT g, t, f, s FROM o UNION SELECT n.n_name, t, f, s FROM o JOIN region r ON r.r_name = o.g JOIN nation n ON n.n_regionkey = r.r_regionkey WHERE top)
SELECT scope, f family, count(*) n, max(s) max_score, count(*) FILTER (s >= 15) high FROM x GROUP BY 1, 2""")
def scope_summary(spark, d):
    t = tables.sql(spark, d, "SELECT CASE WHEN p.s_suppkey % 7 = 0 THEN r.r_name ELSE n.n_name END AS scope, p.s_suppkey AS trend_id, CASE p.s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS family, (1 + p.s_suppkey % 5) * (1 + p.s_suppkey % 4) AS score FROM supplier p JOIN nation n ON n.n_nationkey = p.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey")
    m = tables.sql(spark, d, "SELECT n.n_name AS country, r.r_name AS region FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
    return early_warning.scope_summary(t, m)


DECISION = "SELECT doc_id AS event_id, CASE quality WHEN 1 THEN 'verified' ELSE 'false' END AS decision FROM labels "
TRIAGE = WITH + f""", tg AS (SELECT i.id, i.source, l.doc_id IS NOT NULL has, CASE WHEN l.quality = 1 THEN 'ok' WHEN l.quality = 0 THEN 'noise' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'invalid' WHEN is_auto AND id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'unverifiable' ELSE 'pending' END ELSE 'ok' END status,
 CASE WHEN l.doc_id IS NOT NULL THEN 'analyst' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'out of range' END reason FROM incident i LEFT JOIN labels l ON l.doc_id = i.id)"""


def _triage(spark, d):
    e = tables.incidents(spark, d).withColumn("title", F.col("place")).withColumn("headline", F.when(F.col("id") % 4 != 0, "read")).withColumn("headline_failed", F.col("id") % 8 == 0)
    return quality.triage(e, tables.sql(spark, d, DECISION), NOW)


@query(TRIAGE + " SELECT id, source, status, reason FROM tg")
def triage(spark, d):
    return _triage(spark, d)


@query(TRIAGE + " SELECT source, count(*) n, count(*) FILTER (status NOT IN ('ok', 'pending')) refused FROM tg GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (status NOT IN ('ok', 'pending')) > 0.05 * count(*)")
def source_alarm(spark, d):
    return analytics.source_alarm(_triage(spark, d), share=0.05)


@query("""WITH x AS (SELECT d.source outlet, count(*) FILTER (quality = 1) ok, count(*) FILTER (quality = 0) wrong FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1), y AS (SELECT *, round(wrong / nullif(ok + wrong, 0), 3) rate FROM x)
SELECT *, CASE WHEN ok + wrong < 5 THEN 0 WHEN rate >= 0.5 THEN 2 WHEN rate >= 0.25 THEN 1 WHEN rate <= 0.05 AND ok + wrong >= 10 THEN -1 ELSE 0 END shift FROM y""")
def source_quality(spark, d):
    return quality.source_quality(tables.sql(spark, d, "SELECT doc_id AS id, source AS outlet FROM documents "), tables.sql(spark, d, DECISION).withColumnRenamed("event_id", "id"))


@query("""WITH c AS (SELECT count(*) FILTER (p AND e) tp, count(*) FILTER (p AND NOT e) fp, count(*) FILTER (NOT p AND e) fn, count(*) FILTER (NOT p AND NOT e) tn FROM (SELECT l.quality = 1 e, d.n_chars >= 200 p FROM documents d JOIN labels l ON l.doc_id = d.doc_id))
SELECT *, round(tp / (tp + fp), 4) "precision", round(tp / (tp + fn), 4) recall, round((tp + tn) / (tp + tn + fp + fn), 4) accuracy FROM c""")
def evaluation(spark, d):
    return quality.evaluate(tables.sql(spark, d, "SELECT l.quality = 1 AS expected, d.n_chars >= 200 AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id"))


@query(WITH + f""" SELECT 'severity_24h' "section", CAST(severity AS VARCHAR) "key", count(*) n FROM incident WHERE date >= {AT} - INTERVAL 1 DAY GROUP BY 2 UNION ALL
(SELECT 'hot_72h', country, count(*) n FROM incident WHERE date >= {AT} - INTERVAL 3 DAY AND severity >= 3 GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5) UNION ALL SELECT 'week', category, count(*) FROM incident WHERE date >= {AT} - INTERVAL 7 DAY GROUP BY 2""")
def digest(spark, d):
    return country.digest(tables.incidents(spark, d), NOW)


@query(f"""WITH c AS ({CALENDAR}), s AS (SELECT c_custkey stay, n_name country, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INT) f, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INT) + 5 t FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT stay, count(*) entries, min(d) "first" FROM s JOIN c USING (country) WHERE d >= f - 2 AND d <= t + 2 GROUP BY 1""")
def calendar_overlaps(spark, d):
    c = tables.calendar(spark, d).withColumn("end", F.lit(None).cast("date"))
    s = tables.sql(spark, d, "SELECT c.c_custkey AS stay, n.n_name AS country, date_add(DATE'1996-01-01', CAST(c.c_custkey % 1500 AS INT)) AS `from`, date_add(DATE'1996-01-06', CAST(c.c_custkey % 1500 AS INT)) AS `to` FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
    return country.calendar_overlaps(c, s)


STOPS = ", ".join(f"'{w}'" for w in sorted(set(STORY_STOP)))
#: Whole texts as titles: tokens as in ``story_tokens``.
TOKENS = f"""WITH headline AS ({HEADLINE}), tk AS (SELECT id, title, list_distinct_ordered FROM (SELECT id, title, list_filter(regexp_split_to_array(lower(strip_accents(title)), '[^a-z]+'), lambda x: length(x) >= 3 AND x NOT IN ({STOPS}))[1:14] ws,
 list_filter(ws, lambda x, i: list_position(ws, x) = i) list_distinct_ordered FROM headline)), tt AS (SELECT id, unnest(list_distinct_ordered) "token" FROM tk), dfq AS (SELECT "token", count(*) df FROM tt GROUP BY 1)"""


@query(TOKENS + ' SELECT "token", df, round(ln(((SELECT count(*) FROM headline) + 1) / (df + 0.5)), 6) idf, df <= 5 rare FROM dfq')
def document_frequency(spark, d):
    return merging.document_frequency(tables.headlines(spark, d)).withColumn("idf", F.round("idf", 6))


PAIRS = TOKENS + ', co AS (SELECT tt.* FROM tt JOIN dfq USING ("token") WHERE df <= 300 AND df > 1), pr AS (SELECT x.id a, y.id b, count(*) shared FROM co x JOIN co y ON x."token" = y."token" AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2)'


@query(PAIRS + " SELECT * FROM pr")
def story_pairs(spark, d):
    return merging.story_pairs(tables.headlines(spark, d))


#: The rarest tokens of two lists with Jaccard .8 share one; every list here is of four tokens or more.
ALIKE = TOKENS + """, ls AS (SELECT list_distinct_ordered toks, min(id) id FROM tk WHERE len(list_distinct_ordered) >= 4 GROUP BY 1),
ex AS (SELECT id, len(toks) n, unnest(toks) "token" FROM ls), fq AS (SELECT "token", count(*) f FROM ex GROUP BY 1), rk AS (SELECT ex.*, row_number() OVER (PARTITION BY id ORDER BY f, "token") r FROM ex JOIN fq USING ("token")),
pf AS (SELECT * FROM rk WHERE r <= n - (4 * n + 4) // 5 + 1), cd AS (SELECT DISTINCT x.id a, y.id b FROM pf x JOIN pf y ON x."token" = y."token" AND x.id < y.id), hd AS (SELECT id, toks, arg_min(id, id) OVER w first_id, arg_min(toks, id) OVER w first_toks FROM ls WHERE len(toks) >= 8 WINDOW w AS (PARTITION BY toks[1:8])),
lk AS (SELECT a, b, 'jaccard' "rule", x.toks ta, y.toks tb FROM cd JOIN ls x ON x.id = a JOIN ls y ON y.id = b UNION ALL SELECT first_id, id, 'start', first_toks, toks FROM hd WHERE id <> first_id),
jc AS (SELECT a, b, "rule", len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) jac FROM lk)"""


@query(ALIKE + """ SELECT a, b, "rule", round(jac, 6) jac FROM jc WHERE "rule" = 'start' OR jac >= 0.8 UNION ALL SELECT ls.id, tk.id, 'equal', 1e0 FROM tk JOIN ls ON tk.list_distinct_ordered = ls.toks AND tk.id <> ls.id""")
def similar_titles(spark, d):
    return merging.similar_titles(tables.headlines(spark, d))


@query(f"""WITH headline AS ({HEADLINE}), k AS (SELECT id, substr(trim(regexp_replace(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), 1, 120) "key" FROM headline) SELECT "key", min(id) id, count(*) n FROM k WHERE "key" <> '' GROUP BY 1""")
def exact_titles(spark, d):
    return merging.exact_titles(tables.headlines(spark, d))


@query("""WITH h AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) t FROM pages), s AS (SELECT page_id, regexp_replace(t, '\\s[|–—]\\s.*$', '') t FROM h) SELECT page_id, CASE WHEN length(t) BETWEEN 15 AND 300 THEN t END title FROM s""")
def page_titles(spark, d):
    return text.page_titles(spark.read.parquet(f"{d}/pages.parquet"))


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) base, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)', 1) l FROM pages), y AS (SELECT page_id, base, unnest(l) href, CAST(unnest(range(len(l))) AS INT) pos FROM x)
SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN href LIKE '/%' THEN base || href ELSE base || '/' || href END link FROM y""")
def page_links(spark, d):
    return text.links(spark.read.parquet(f"{d}/pages.parquet"))


@query("""SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^(www|m|amp|edition)\\.', '') "domain", count(*) n FROM pages GROUP BY 1""")
def page_domains(spark, d):
    return analytics.page_domains(spark.read.parquet(f"{d}/pages.parquet"))


GROUPS = WITH + """, pg AS (SELECT country, place, category, CAST(date AS DATE) "day", count(*) n, count(DISTINCT source) outlets, max(severity) severity, arg_min(id, (date, id)) first_id, arg_max(id, (date, id)) last_id FROM incident GROUP BY 1, 2, 3, 4)"""


@query(GROUPS + " SELECT *, CASE WHEN outlets >= 4 THEN 'high' WHEN outlets >= 2 THEN 'medium' ELSE 'low' END confidence FROM pg")
def press_groups(spark, d):
    return press.press_groups(tables.incidents(spark, d).withColumn("outlet", F.col("source")))


@query(WITH + f" SELECT id, country, category, severity, date FROM incident WHERE severity >= 3 AND confidence <> 'low' AND date >= {AT} - INTERVAL 48 HOUR AND NOT is_auto AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def alert_rows(spark, d):
    sent = tables.sql(spark, d, "SELECT doc_id AS id FROM labels WHERE quality = 0")
    return press.alert_rows(tables.incidents(spark, d), sent, NOW, hours=48, include_auto=False)


@query(TRIAGE + " SELECT source, status, count(*) n FROM tg GROUP BY 1, 2")
def triage_counts(spark, d):
    return press.triage_counts(_triage(spark, d))


@query(WITH + RISK + f""", e AS (SELECT country, count(*) "month", count(*) FILTER (severity >= 3) severe, max(CASE WHEN date >= {AT} - INTERVAL 3 DAY THEN severity END) worst_72h FROM incident WHERE date >= {AT} - INTERVAL 30 DAY GROUP BY 1), a AS (SELECT country, max(level) advice FROM advisory GROUP BY 1)
SELECT country, "level", score, "month", severe, worst_72h, advice FROM risk LEFT JOIN e USING (country) LEFT JOIN a USING (country)""")
def country_brief(spark, d):
    e, a = tables.incidents(spark, d), tables.advisories(spark, d)
    r = indices.country_risk(e, a, NOW)
    return press.country_brief(r, indices.stability_index(e, r, NOW), e, a, NOW).drop("stability")


@query(f"""WITH headline AS (SELECT array_to_string(ws, ' ') title FROM ({LINE})), f AS (SELECT list_filter(regexp_split_to_array(lower(strip_accents(title)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM headline),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) gram FROM f) SELECT gram, count(*) n FROM g GROUP BY 1 HAVING count(*) >= 3""")
def title_bigrams(spark, d):
    return text.ngrams(tables.document_lines(spark, d), 2, 2).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 3")


@query("""WITH s AS (SELECT n.n_name country, CASE p.p_partkey % 4 WHEN 0 THEN 'Road to school' WHEN 1 THEN 'Rural water supply' WHEN 2 THEN 'Solar power plant' ELSE 'District hospital' END title, CAST(p.p_partkey AS DOUBLE) amount FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25),
g AS (SELECT country, CASE WHEN title LIKE '%hospital' THEN 'health' WHEN title LIKE '%school' THEN 'education' WHEN title LIKE '%water%' THEN 'water' ELSE 'energy' END sector, count(*) n, sum(amount) amount FROM s GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY amount DESC, sector) AS INT) "rank" FROM g) SELECT * FROM r WHERE "rank" <= 6""")
def project_totals(spark, d):
    return country.project_totals(tables.sql(spark, d, "SELECT n.n_name AS country, CASE p.p_partkey % 4 WHEN 0 THEN 'Road to school' WHEN 1 THEN 'Rural water supply' WHEN 2 THEN 'Solar power plant' ELSE 'District hospital' END AS title, CAST(p.p_partkey AS DOUBLE) AS amount FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25"))


@query("""WITH m AS (SELECT c.c_custkey mission, CAST(1 + c.c_custkey % 5 AS INT) lv, CAST(c.c_custkey % 7 AS INT) sn, CAST(c.c_custkey % 2 AS INT) en, list_filter(range(1, 10), lambda i: (c.c_custkey // CAST(pow(2, i - 1) AS BIGINT)) % 2 = 0) miss FROM customer c),
x AS (SELECT mission, least(5, lv + (sn >= 3)::INT + (en > 0)::INT) threat, 1 + CAST(floor(len(miss) / 2) AS INT) vulnerability, array_to_string(list_transform(miss, lambda i: 'a' || i), ',') missing FROM m)
SELECT mission, threat, vulnerability, threat * vulnerability product, CASE WHEN threat * vulnerability >= 16 THEN 'no-go' WHEN threat * vulnerability >= 9 THEN 'approval' WHEN threat * vulnerability >= 5 THEN 'conditions' ELSE 'go' END code, missing FROM x""")
def go_no_go(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("mission"), (1 + F.col("c_custkey") % 5).cast("int").alias("level"), (F.col("c_custkey") % 7).cast("int").alias("severe_near"), (F.col("c_custkey") % 2).cast("int").alias("entries"), *((F.floor(F.col("c_custkey") / 2 ** (i - 1)) % 2 == 1).alias(f"a{i}") for i in range(1, 10)))
    return country.go_no_go(c)


@query("""WITH r AS (SELECT n.n_name country, CASE s.s_suppkey % 6 WHEN 0 THEN 'growth' WHEN 1 THEN 'inflation' WHEN 2 THEN 'debt' WHEN 3 THEN 'unemployment' WHEN 4 THEN 'stability' ELSE 'yield' END k, s.s_suppkey y, s.s_acctbal / 50 v FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),
l AS (SELECT country, k, arg_max(v, y) v FROM r GROUP BY 1, 2), p AS (SELECT country, max(v) FILTER (k = 'growth') g, max(v) FILTER (k = 'inflation') i, max(v) FILTER (k = 'debt') d, max(v) FILTER (k = 'unemployment') u, max(v) FILTER (k = 'stability') s FROM l GROUP BY 1)
SELECT country, concat_ws(',', CASE WHEN g < 0 THEN 'recession' END, CASE WHEN i >= 10 THEN 'inflation' END, CASE WHEN d >= 100 THEN 'debt' END, CASE WHEN u >= 15 THEN 'unemployment' END, CASE WHEN s < 20 THEN 'instability' END) flags FROM p""")
def structural_flags(spark, d):
    r = tables.sql(spark, d, "SELECT n.n_name AS country, CASE s.s_suppkey % 6 WHEN 0 THEN 'growth' WHEN 1 THEN 'inflation' WHEN 2 THEN 'debt' WHEN 3 THEN 'unemployment' WHEN 4 THEN 'stability' ELSE 'yield' END AS key, s.s_suppkey AS year, s.s_acctbal / 50 AS value FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey")
    return country.structural_flags(r).select("country", F.array_join("flags", ",").alias("flags"))


@query(WITH + f", x AS (SELECT country, date_trunc('day', date) \"day\", {W} w FROM incident) SELECT country, CAST(\"day\" AS DATE) \"day\", count(*) n, round(sum(w), 3) weight FROM x GROUP BY 1, 2")
def daily_weights(spark, d):
    from cairn.functions.exprs import event_weight

    return tables.incidents(spark, d).withColumn("w", event_weight()).groupBy("country", F.col("date").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 3).alias("weight"))


@query("SELECT conv_id id, turn pos, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) n FROM conversations WHERE role = 'assistant'")
def context_items(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").where("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("n"))


_RUNS = "SELECT {0}, line_no, piece, array_to_string(ws[piece * 14 + 1:piece * 14 + 14], ' ') title FROM (SELECT {0}, line_no, ws, unnest(range((len(ws) + 13) // 14)) piece FROM ({1}) WHERE len(ws) > 0)"
_TOKENS = f"SELECT *, list_filter(w0, lambda x, i: list_position(w0, x) = i) w FROM (SELECT *, list_filter(regexp_split_to_array(lower(strip_accents(title)), '[^a-z]+'), lambda x: length(x) >= 3 AND x NOT IN ({STOPS})) w0 FROM ({{}}))"


@query(f"""WITH e AS ({_TOKENS.format(_RUNS.format("doc_id", LINE))}), c AS ({_TOKENS.format(_RUNS.format("item_id", LINE.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")))}),
x AS (SELECT e.doc_id, e.line_no, e.piece, c.item_id, c.line_no said_line, c.piece said_piece, len(list_intersect(e.w, c.w)) k, len(e.w) + len(c.w) n, c.item_id % 30 cd FROM e JOIN c ON abs(e.doc_id % 30 - c.item_id % 30) <= 3 WHERE len(e.w) >= 3 AND len(c.w) >= 3),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, piece ORDER BY cd, item_id, said_line, said_piece) r FROM x WHERE k >= 3 AND k >= 0.25 * (n - k)) SELECT doc_id, CAST(line_no AS INT) line_no, CAST(piece AS INT) piece, item_id, CAST(said_line AS INT) said_line, CAST(said_piece AS INT) said_piece FROM y WHERE r = 1""")
def denials(spark, d):
    """Benchmark items stand for what is denied. Ids name document or item, line and piece, so that all words of both sides take part; days are dealt by id."""
    def told(name, key):
        return tables.pieces(spark, d, name, (key,)).select(F.struct(key, "line_no", "piece").alias("id"), "title", F.timestamp_seconds(F.lit(1704067200) + F.col(key) % 30 * 86400).alias("date"))

    x = merging.denials(told("documents", "doc_id"), told("benchmark", "item_id"))
    return x.select("event.*", "denial.item_id", F.col("denial.line_no").alias("said_line"), F.col("denial.piece").alias("said_piece"))


@query()
def value_alert_sentences(spark, d):
    return press.crisis_sentence(merging.crises(tables.incidents(spark, d), NOW))
