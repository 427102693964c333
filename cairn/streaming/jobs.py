"""Structured Streaming forms of the stateful habits: pickup, late facts, upsert, notify once, cool-down, windows, sessions, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions.exprs import event_weight


def pickup(spark: SparkSession, path: str, schema, files: int = 8, source: str = "parquet") -> DataFrame:
    """New files of a landing folder, so many per trigger; the checkpoint is the cursor."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files).load(path)


def run_available(stream, checkpoint: str, write, mode: str = "append") -> None:
    """Processes what has landed and stops; ``write(batch, epoch)`` must be idempotent per epoch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def timely(reports: DataFrame, days: int = 3) -> DataFrame:
    """Reports added more than ``days`` after their event day go: each row compares its own dates; the watermark only bounds state."""
    return reports.withWatermark("added", f"{days} days").where(F.col("added") <= F.col("date") + F.expr(f"INTERVAL {days} DAY"))


def notify_once(alerts: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Each id once while it can still be an alert."""
    return alerts.withWatermark("date", delay).dropDuplicatesWithinWatermark(["id"])


def counted_once(events: DataFrame, delay: str = "31 days") -> DataFrame:
    """unit-month counts in which an id counts once however often it arrives."""
    once = events.withWatermark("date", delay).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("date", "1 day"), "country").agg(F.count("*").alias("n"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """country, day, n, severe as days close."""
    return events.withWatermark("date", delay).groupBy(F.window("date", "1 day").alias("w"), "country").agg(F.count("*").alias("n"), F.count_if(F.col("severity") >= 3).alias("severe")).select(F.col("w.start").cast("date").alias("day"), "country", "n", "severe")


def sliding_weights(events: DataFrame, size: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Weight per country over sliding windows."""
    return events.withWatermark("date", delay).groupBy(F.window("date", size, slide).alias("w"), "country").agg(F.round(F.sum(event_weight()), 3).alias("weight")).select(F.col("w.end").alias("until"), "country", "weight")


def chained(events: DataFrame, gap: str = "72 hours", delay: str = "1 day") -> DataFrame:
    """Chains of one country and category as they close."""
    return events.withWatermark("date", delay).groupBy(F.session_window("date", gap).alias("w"), "country", "category").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity")).select("country", "category", F.col("w.start").alias("start"), "n", "max_severity")


def cooled_down(alerts: DataFrame, days: int = 5) -> DataFrame:
    """country, date of alerts(country, date): after one, none of the same country for ``days``. State is one time per country, given up when it has no effect."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for date in sorted(d for pdf in batches for d in pdf["date"]):
            at = int(date.timestamp())
            if last is None or at - last >= days * 86400:
                out.append(date)
                last = at
        state.update((last,))
        due = (last + days * 86400) * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"country": [key[0]] * len(out), "date": out})

    return alerts.withWatermark("date", "1 day").groupBy("country").applyInPandasWithState(one, "country string, date timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def circuit_breaker(runs: DataFrame, failures: int = 3, pause_hours: int = 24) -> DataFrame:
    """source, at, skipped for runs(source, at, ok): after so many failures in a row a source rests for a while; runs in the rest are skipped and don't count."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, 0)
        rows = []
        for at, ok in sorted(x for pdf in batches for x in zip(pdf["at"], pdf["ok"], strict=True)):
            now = int(at.timestamp())
            skipped = now < until
            if not skipped:
                streak = 0 if ok else streak + 1
                if streak >= failures:
                    streak, until = 0, now + pause_hours * 3600
            rows.append((key[0], at, skipped))
        state.update((streak, until))
        yield pd.DataFrame(rows, columns=["source", "at", "skipped"])

    return runs.groupBy("source").applyInPandasWithState(one, "source string, at timestamp, skipped boolean", "streak int, until long", "append", GroupStateTimeout.NoTimeout)


def headlines_arrived(pending: DataFrame, titles: DataFrame, wait: str = "1 day") -> DataFrame:
    """id, url, headline: pending rows with the title that arrives for their URL in time, else null once the wait is over."""
    p, t = pending.withWatermark("date", "1 hour"), titles.withWatermark("seen", "1 hour").withColumnRenamed("url", "title_url")
    return p.join(t, F.expr(f"url = title_url AND seen BETWEEN date AND date + INTERVAL {wait}"), "leftOuter").select("id", "url", "headline", F.when(F.col("headline").isNull(), "unverifiable").otherwise("ok").alias("status"))


def upsert_into(path: str, now: str, days: int = 95):
    """A ``foreachBatch`` function that merges a batch into a Parquet store: earliest first_seen, last write wins, retention. Versions are folders named by epoch, so a repeated epoch gives the same store."""
    from cairn.sources.sinks import merge_store

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("first_seen", F.col("date"))
        if epoch:
            new = merge_store(spark.read.parquet(f"{path}/epoch={epoch - 1}"), new, now, days)
        else:
            new = merge_store(new.limit(0), new, now, days)
        new.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def retained(rows: DataFrame, rules: dict[str, int], now: str) -> DataFrame:
    """Rows(kind, date) no older than the days that their kind may be kept; kinds without a rule stay."""
    keep = F.coalesce(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv))[F.col("kind")], F.lit(36500))
    return rows.where(F.col("date") >= F.lit(now).cast("timestamp") - F.make_interval(days=keep))
