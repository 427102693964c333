"""The star-schema tables as engine tables: one deterministic adapter per engine table, in both engines' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed clock of indices over these tables.
NOW = "2024-01-31 00:00:00"

INCIDENT = """
SELECT e.event_id AS id, CAST(e.ts AS TIMESTAMP) AS date, n.n_name AS country, r.r_name AS region, n.n_nationkey AS nation_key,
       CASE e.user_id % 5 WHEN 0 THEN 'USGS' WHEN 1 THEN 'GDELT' WHEN 2 THEN 'Press' WHEN 3 THEN 'GDACS' ELSE 'WHO' END AS source,
       CASE e.event_type WHEN 'view' THEN 'attack' WHEN 'click' THEN 'unrest' WHEN 'purchase' THEN 'flood' WHEN 'signup' THEN 'earthquake' ELSE 'cyber' END AS category,
       CASE e.event_type WHEN 'view' THEN 'security' WHEN 'click' THEN 'political' WHEN 'error' THEN 'infrastructure' ELSE 'natural' END AS grp,
       CASE WHEN e.value >= 100 THEN 4 WHEN e.value >= 50 THEN 3 WHEN e.value >= 20 THEN 2 ELSE 1 END AS severity,
       CASE e.event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
       e.user_id % 5 IN (1, 2) AS is_auto,
       CAST(-60 + 5 * (e.user_id % 25) + ((e.event_id * 37) % 400) / 100.0 AS DOUBLE) AS lat,
       CAST(-150 + 12 * (e.user_id % 25) + ((e.event_id * 91) % 400) / 100.0 AS DOUBLE) AS lon,
       concat('place-', CAST(e.event_id % 8 AS VARCHAR(10))) AS place, e.value AS value, e.user_id AS user_id
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 JOIN region r ON r.r_regionkey = n.n_regionkey"""

#: The same with sources dealt by event, so that all sources report on each country.
MIXED = INCIDENT.replace("CASE e.user_id % 5 WHEN 0", "CASE e.event_id % 5 WHEN 0").replace("e.user_id % 5 IN (1, 2)", "e.event_id % 5 IN (1, 2)")

#: With every family of duplicates, titles of a few words, headlines that machine-coded rows mostly have, and what a merged record needs.
TOLD = f"""
SELECT i.id, i.date, i.country AS country_name, i.country, i.severity, i.lat, i.lon, i.confidence,
       CASE i.id % 5 WHEN 0 THEN 'USGS' WHEN 1 THEN 'GDELT' WHEN 2 THEN 'Press' WHEN 3 THEN 'GDACS' ELSE 'NWS' END AS source,
       CASE i.category WHEN 'attack' THEN CASE (i.id * 7) % 4 WHEN 0 THEN 'attack' WHEN 1 THEN 'terrorism' WHEN 2 THEN 'armed_conflict' ELSE 'crime' END WHEN 'unrest' THEN 'unrest'
            WHEN 'flood' THEN CASE (i.id * 7) % 4 WHEN 0 THEN 'flood' WHEN 1 THEN 'storm' WHEN 2 THEN 'cyclone' ELSE 'landslide' END
            WHEN 'earthquake' THEN CASE (i.id * 7) % 4 WHEN 0 THEN 'earthquake' WHEN 1 THEN 'volcano' WHEN 2 THEN 'wildfire' ELSE 'health' END ELSE CASE (i.id * 7) % 4 WHEN 0 THEN 'drought' ELSE 'cyber' END END AS category,
       concat('Place ', CASE i.id % 3 WHEN 0 THEN 'Alba' WHEN 1 THEN 'Bor' ELSE 'Céleste' END) AS place,
       concat(CASE (i.id * 3) % 4 WHEN 0 THEN 'Gunmen' WHEN 1 THEN 'Police' WHEN 2 THEN 'Crowd' ELSE 'Alba' END, CASE WHEN i.id % 5 = 4 THEN ' – ' ELSE ' ' END, CASE (i.id * 11) % 6 WHEN 0 THEN 'near church' WHEN 1 THEN 'at market' WHEN 2 THEN 'in école' WHEN 3 THEN 'on bridge' WHEN 4 THEN 'by station' ELSE 'close to airport' END, CASE (i.id * 13) % 3 WHEN 0 THEN ' wounded' WHEN 1 THEN ' evacuated' ELSE ' blocked' END) AS title,
       CASE WHEN i.id % 5 = 1 AND i.id % 4 > 0 THEN concat(CASE (i.id * 3) % 4 WHEN 0 THEN 'Police' WHEN 1 THEN 'Gunmen' WHEN 2 THEN 'Crowd' ELSE 'Eastern Alba' END, ' ', CASE (i.id * 11) % 5 WHEN 0 THEN 'church' WHEN 1 THEN 'market' WHEN 2 THEN 'école' WHEN 3 THEN 'bridge' ELSE 'airport' END, CASE (i.id * 17) % 2 WHEN 0 THEN ' wounded' ELSE ' evacuated' END) END AS headline
FROM ({INCIDENT}) i"""

ADVISORY = """
SELECT n.n_name AS country, CASE s.s_suppkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS source, CAST(max(1 + s.s_suppkey % 4) AS INT) AS level, 4 AS scale
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1, 2"""

SITE = """
SELECT s.s_suppkey AS site_id, s.s_name AS site, n.n_name AS country,
       CAST(-60 + 5 * s.s_nationkey + ((s.s_suppkey * 37) % 400) / 100.0 AS DOUBLE) AS site_lat,
       CAST(-150 + 12 * s.s_nationkey + ((s.s_suppkey * 91) % 400) / 100.0 AS DOUBLE) AS site_lon,
       CAST(50 + 10 * (s.s_suppkey % 5) AS DOUBLE) AS radius_km, CAST(1 + s.s_suppkey % 3 AS INT) AS min_severity
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey"""

UNIT_MONTH = """
SELECT n.n_name AS unit, r.r_name AS region, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month, l.l_returnflag AS flag, l.l_linestatus AS status,
       l.l_discount AS rain, l.l_tax AS temp, l.l_quantity AS wet
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""

#: Whole texts as titles: each line cut into runs of 14 words, as ``pieces`` does; and whole lines.
LINE = "SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\r]+'), lambda v: v <> '') ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no FROM documents WHERE text IS NOT NULL)"
HEADLINE = f"SELECT doc_id || ':' || line_no || ':' || piece AS id, array_to_string(ws[piece * 14 + 1:piece * 14 + 14], ' ') AS title FROM (SELECT doc_id, line_no, ws, unnest(range((len(ws) + 13) // 14)) piece FROM ({LINE}) WHERE len(ws) > 0)"

CALENDAR = """
SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS d, n.n_name AS country
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderpriority = '1-URGENT'"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the tables that it names."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in f" {text} ".replace("\n", " ").replace(",", " ")}
    for t, df in frames.items():
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        if text.rstrip().endswith(f"FROM {t}"):
            text = text.rstrip()[: -len(t)] + f"{{{t}}}"
    return spark.sql(text, **frames)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INCIDENT)


def mixed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, MIXED)


def told_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, TOLD)


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ADVISORY)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SITE)


def unit_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, UNIT_MONTH)


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title: every run of words of the documents; id is document, line and run."""
    return pieces(spark, sf_dir, "documents", ("doc_id",)).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), F.col("piece").cast("string")).alias("id"), "title")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line_no, title: every line of the documents, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "title"))


def pieces(spark: SparkSession, sf_dir: str, name: str, keys: tuple[str, ...], where: str = "true", words: int = 14) -> DataFrame:
    """keys, line_no, piece, title: the whole text of a table as titles, a line cut into runs of ``words`` words, so that rules on a title's first words reach all."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(where).select(*keys, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = F.filter(F.split("line", r"[ \t\r]+"), lambda x: x != "")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int")), lambda i: F.array_join(F.slice("w", i * words + 1, words), " "))
    return t.withColumn("w", w).where("size(w) > 0").select(*keys, "line_no", F.posexplode(runs).alias("piece", "title"))


def family_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, month, family: what the flags of ``unit_months`` stand for as factor families, a row per family that a row counts in."""
    flag, status = F.col("flag"), F.col("status")
    told = (("sec", flag == "R"), ("res", (flag == "R") & (status == "O")), ("unrest", flag == "A"), ("pol", (flag == "A") & (status == "O")), ("haz", flag == "N"), ("infra", (flag == "N") & (status == "O")), ("health", (flag == "N") & (status == "F")))
    return unit_months(spark, sf_dir).select("unit", "month", F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in told)))).alias("family"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CALENDAR)
