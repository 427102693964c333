"""Reading headlines with a scorer that the caller supplies: cached titles are skipped, a cheap filter comes first, a monthly budget bounds the calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import fold
from cairn.operators.text import classify


def daily_budget(monthly: int, used: int, day: int, days: int = 30) -> int:
    """What is left of the month, spread over its remaining days."""
    return max(0, (monthly - used) // max(1, days - day + 1))


def scored(titles: DataFrame, cache: DataFrame, scorer: Callable[[list[str]], list[float]], budget: int, batch: int = 25) -> DataFrame:
    """id, key, score: cached scores, and new ones for titles with a category, the newest ``budget`` of them (the feature); the rest is null.

    The filter is a predicate of its own before the Python step, so it runs in the engine. Equal titles are scored once."""
    key = F.xxhash64(fold("title"))
    x = titles.withColumn("key", key).withColumn("likely", classify("title").isNotNull())
    known = x.join(cache.select("key", F.col("score").alias("cached")), "key", "left")
    fresh = known.where("cached IS NULL AND likely").groupBy("key").agg(F.max_by("title", "date").alias("title"), F.max("date").alias("date")).orderBy(F.desc("date"), "key").limit(budget)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "fresh": scorer(part["title"].tolist())})

    new = fresh.select("key", "title").mapInPandas(run, "key long, fresh double")
    return known.join(new, "key", "left").select("id", "key", F.coalesce("cached", "fresh").alias("score"))


def ranked_feeds(outlets: DataFrame, cursor: int, size: int) -> DataFrame:
    """The batch of ``size`` outlets from a cursor on, around the end of the list; order by name."""
    n = outlets.count()
    place = F.row_number().over(Window.orderBy("outlet")) - 1  # one row per outlet
    return outlets.withColumn("place", place).where(F.pmod(F.col("place") - cursor, F.lit(max(1, n))) < size).drop("place")
