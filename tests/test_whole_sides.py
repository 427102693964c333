"""Small sides of joins are whole, however many rows they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import merging, quality


def test_all_media_groups_count(spark):
    n = 100_500
    groups = spark.range(n).select(F.concat(F.lit("d"), "id", F.lit(".com")).alias("dom"), F.lit("one").alias("grp"))
    reports = spark.range(n).select(F.lit(1).alias("id"), F.concat(F.lit("https://d"), F.col("id"), F.lit(".com/a")).alias("url"), F.lit("short").alias("title"))
    r = merging.independence(reports, groups).first()
    assert (r.outlets, r.independent) == (n, 1)


def test_all_capitals_count(spark):
    name = F.concat(F.lit("c"), "id")
    capitals = spark.range(450).select(name.alias("country"), F.lit(1.0).alias("cap_lat"), F.lit(2.0).alias("cap_lon"))
    rows = spark.range(450).select(name.alias("country"), F.lit("p").alias("place"), F.array(F.lit("X")).alias("actors"), F.array(F.lit("other")).alias("actor_countries"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(False).alias("violent"))
    assert quality.dateline_noise(rows, capitals).count() == 0
