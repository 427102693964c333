"""Writers: upsert, month-partitioned archive, GeoJSON, change-only publishing, guarded overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_store(store: DataFrame, new: DataFrame, now: str, days: int = 95) -> DataFrame:
    """The newest row per id with the earliest first_seen; rows older than the retention go. Ties go to the new side."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("id", "first_seen", "_new")]
    x = both.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("_new", "date")).alias("r"), F.min("first_seen").alias("first_seen")).select("id", "r.*", "first_seen")
    return x.where(F.col("date") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY"))


def write_archive(incidents: DataFrame, path: str, now: str, days: int = 30) -> DataFrame:
    """Rows older than ``days`` by month; months present are replaced, months no longer present are removed; returns month, n."""
    spark = incidents.sparkSession
    old = incidents.where(F.col("date") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY")).withColumn("month", F.date_format("date", "yyyy-MM"))
    old.repartition("month", F.pmod(F.xxhash64("id"), F.lit(32))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    present = {r.month for r in old.select("month").distinct().collect()}  # a row per month
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("month=") and name[6:] not in present:
            fs.delete(status.getPath(), True)
    schema = old.drop("month").schema.add("month", "string")
    return spark.read.schema(schema).parquet(path).groupBy("month").count().withColumnRenamed("count", "n")


def geojson(incidents: DataFrame) -> DataFrame:
    """value: one GeoJSON feature per row, for ``write.text``."""
    props = F.struct(*(c for c in incidents.columns if c not in ("lat", "lon")))
    return incidents.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value"))


def changed_keys(current: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """key, hash of keys whose rows changed since ``manifest(key, hash)``; a key's hash doesn't depend on row order."""
    cols = sorted(c for c in current.columns if c != key)
    now = current.groupBy(key).agg(F.bit_xor(F.xxhash64(*cols)).alias("x"), F.count("*").alias("n"), F.sum(F.xxhash64(*cols, F.lit(1)).cast("decimal(38,0)")).alias("s")).select(key, F.xxhash64("x", "n", F.col("s").cast("string")).alias("hash"))
    return now.join(manifest.select(key, "hash"), [key, "hash"], "left_anti")


def save_part(df: DataFrame, path: str) -> bool:
    """Overwrites a part unless the new one is empty; tells whether it did."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_history(incidents: DataFrame, path: str) -> None:
    """Compact history by year and month."""
    x = incidents.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    x.repartition("year", "month", F.pmod(F.xxhash64("id"), F.lit(32))).sortWithinPartitions("date").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_regions(df: DataFrame, path: str) -> None:
    df.repartition("region").write.mode("overwrite").partitionBy("region").parquet(path)


def without_sources(store: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of sources whose configuration changed are purged."""
    return store.join(changed.select("source").distinct(), "source", "left_anti")


def live_and_history(history: DataFrame, live: DataFrame, cut: str) -> DataFrame:
    """History before the cut and live rows from it on, without overlap."""
    at = F.lit(cut).cast("timestamp")
    return history.where(F.col("date") < at).unionByName(live.where(F.col("date") >= at), allowMissingColumns=True)
