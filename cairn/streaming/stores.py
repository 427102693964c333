"""Stores that a stream keeps up to date: keyed rows in buckets with versions, counters, newest rows per key, stories.

A store is a folder of buckets. A batch reads and rewrites the buckets that its keys fall into, and a manifest per epoch names the version of
each bucket. A repeated epoch starts from the manifest before it and gives the same store; readers see whole epochs only. Versions
that neither the current nor the previous manifest names are deleted. The manifest has one row per bucket, so it is all that the driver reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.functions.exprs import story_tokens
from cairn.operators.graph import connected, cut, dropped


class BucketStore:
    """Rows in ``buckets`` buckets by a hash of ``keys`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def _folder(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def bucket(self, *keys):
        """The bucket of key columns."""
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def epochs(self) -> list[int]:
        fs, path = self._folder(f"{self.path}/manifest")
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName()) if fs.exists(path) else []

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket that has one, in the newest manifest before an epoch (or of all)."""
        known = [e for e in self.epochs() if before is None or e < before]
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.path}/manifest/epoch={known[-1]}").collect()} if known else {}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some buckets, or of all."""
        versions = self.versions(before)
        paths = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in versions.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the key columns of a frame; one row per bucket at most."""
        return [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def write(self, epoch: int, touched: list[int], rows: DataFrame) -> None:
        """Makes ``rows`` the whole content of the buckets ``touched`` from this epoch on."""
        versions = self.versions(before=epoch)
        if touched:
            dealt = rows.withColumn("bucket", self.bucket()).where(F.col("bucket").isin(touched))
            staged = f"{self.path}/staged/epoch={epoch}"
            dealt.repartition("bucket", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(staged)
            fs, _ = self._folder(self.path)
            for b in touched:
                _, source = self._folder(f"{staged}/bucket={b}")
                _, target = self._folder(f"{self.path}/rows/bucket={b}/version={epoch}")
                fs.delete(target, True)
                if fs.exists(source):
                    fs.mkdirs(target.getParent())
                    fs.rename(source, target)
                    versions[b] = epoch
                else:
                    versions.pop(b, None)
            fs.delete(self._folder(staged)[1], True)
        made = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version int")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")
        self._clean()

    def _clean(self) -> None:
        epochs = self.epochs()
        kept = {e: self.versions(before=e + 1) for e in epochs[-2:]}
        fs, _ = self._folder(self.path)
        for e in epochs[:-2]:
            fs.delete(self._folder(f"{self.path}/manifest/epoch={e}")[1], True)
        for b in range(self.buckets):
            _, folder = self._folder(f"{self.path}/rows/bucket={b}")
            if fs.exists(folder):
                for s in fs.listStatus(folder):
                    if int(s.getPath().getName().split("=")[1]) not in {v.get(b) for v in kept.values()}:
                        fs.delete(s.getPath(), True)


def upserting(store: BucketStore, now: str, days: int = 95) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the newest row per id with the earliest first_seen; rows beyond the retention go when their bucket is touched."""
    from cairn.sources.sinks import merge_store

    def write(batch: DataFrame, epoch: int) -> None:
        new = cut(batch.withColumn("first_seen", F.col("date")))
        touched = store.touched(new)
        merged = merge_store(store.read(touched, before=epoch), new, now, days).select(*store.read([]).columns)
        store.write(epoch, touched, merged)
        dropped(new)

    return write


def counting(seen: BucketStore, counters: BucketStore, counted: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``counted`` turns rows into (id, unit, month, family, n); each id counts once over all batches.

    ``seen`` keeps ids by bucket; ``counters`` keeps (unit, month, family, n). Both are versioned by epoch, so a repeated epoch counts once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = counted(batch)
        ids = rows.select("id").distinct()
        touched = seen.touched(ids)
        old = seen.read(touched, before=epoch)
        fresh = cut(rows.join(old, "id", "left_anti").dropDuplicates(["id", "family"]))
        seen.write(epoch, touched, old.unionByName(fresh.select("id").distinct()))
        units = counters.touched(fresh)
        total = counters.read(units, before=epoch).unionByName(fresh.select("unit", "month", "family", F.col("n").cast("long").alias("n")))
        counters.write(epoch, units, total.groupBy("unit", "month", "family").agg(F.sum("n").alias("n")))
        dropped(fresh)

    return write


def newest_kept(events: DataFrame, most: int = 50, days: int = 7, delay: str = "1 day") -> DataFrame:
    """key, n, oldest, newest after each batch of events(key, id, date): the state of a key is its newest ``most`` ids of the last ``days``.

    A key whose ids are all too old gives its state up by a timer, so state is bounded by the keys alive and ``most``. Ties of date go to the greater id.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "n": [0], "oldest": [pd.NaT], "newest": [pd.NaT]})
            return
        rows = set(zip(*state.get, strict=True)) if state.exists else set()
        for pdf in batches:
            rows.update((int(d.timestamp()), int(i)) for i, d in zip(pdf["id"], pdf["date"], strict=True))
        last = max(rows)[0]
        held = sorted((r for r in rows if r[0] > last - days * 86400), reverse=True)[:most]
        state.update(([d for d, _ in held], [i for _, i in held]))
        due = (last + days * 86400) * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"key": [key[0]], "n": [len(held)], "oldest": [pd.Timestamp(held[-1][0], unit="s")], "newest": [pd.Timestamp(held[0][0], unit="s")]})

    return events.withWatermark("date", delay).groupBy("key").applyInPandasWithState(one, "key string, n long, oldest timestamp, newest timestamp", "dates array<long>, ids array<long>", "update", GroupStateTimeout.EventTimeTimeout)


#: What the story stores keep: keys of titles, and components.
STORY_KEYS = "key long, id long, toks array<string>, date timestamp"
STORY_LABELS = "id long, story long"


def _keyed(titles: DataFrame) -> DataFrame:
    """key, id, toks, date: titles that tell the same share a key, whatever comes later.

    Tokens are ordered by hash instead of rarity, which changes as titles arrive: a list of n tokens shares at least ceil(.8 n) with a partner, so
    one of the first n - ceil(.8 n) + 1 of both is common; the first eight tokens are one more key."""
    t = titles.select("id", "date", story_tokens("title").alias("toks")).where(F.size("toks") >= 4)
    order = F.transform(F.array_sort(F.transform("toks", lambda w: F.xxhash64(w))), lambda h: h)
    first = F.slice(order, F.lit(1), F.size("toks") - F.ceil(F.size("toks") * 4 / 5).cast("int") + 1)
    start = F.when(F.size("toks") >= 8, F.array(F.xxhash64(F.lit("start"), F.array_join(F.slice("toks", 1, 8), " "))))
    return t.withColumn("key", F.explode(F.array_distinct(F.concat(first, F.coalesce(start, F.array().cast("array<long>")))))).select("key", "id", "toks", "date")


def _told(left: DataFrame, right: DataFrame, hours: int) -> DataFrame:
    """Pairs a (of left), b (of right) with a common key that tell one story within ``hours``."""
    x = left.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "toks", "date"))).join(right.select("key", *(F.col(c).alias(f"{c}_b") for c in ("id", "toks", "date"))), "key").where("id_a <> id_b")
    both = F.size(F.array_intersect("toks_a", "toks_b"))
    alike = both * 5 >= (F.size("toks_a") + F.size("toks_b") - both) * 4
    start = (F.least(F.size("toks_a"), F.size("toks_b")) >= 8) & (F.slice("toks_a", 1, 8) == F.slice("toks_b", 1, 8))
    near = F.abs(F.unix_micros("date_a") - F.unix_micros("date_b")) <= hours * 3_600_000_000
    return x.where(near & (alike | start)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def storytelling(keys: BucketStore, labels: BucketStore, hours: int = 120) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the stories of titles(id, title, date): components of the rules on text within ``hours``.

    A batch meets the kept keys of the buckets that its own keys fall into. New links join the old stories of their ends; only buckets of
    stories that change or grow are rewritten (``labels`` is bucketed by story). In whatever order and batches titles arrive, stories are those of
    all titles at once: components only grow, and their name is the least id. An id that comes again is taken as it came first.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        old_labels = labels.read(before=epoch)
        fresh = batch.where("id IS NOT NULL AND date IS NOT NULL").dropDuplicates(["id"]).join(old_labels.select("id"), "id", "left_anti")
        fresh = cut(fresh.select("id", "title", "date"))
        new = cut(_keyed(fresh))
        touched = keys.touched(new)
        kept = keys.read(touched, before=epoch)
        links = cut(_told(new, kept.unionByName(new), hours))
        # old ends stand for their story
        at = links.join(old_labels.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("story", "b").alias("b"))
        grown = cut(connected(at))
        names = grown.select(F.col("node").alias("story"), F.col("component").alias("now"))
        moved = names.where("story <> now")
        added = fresh.select("id").join(names.withColumnRenamed("story", "id"), "id", "left").select("id", F.coalesce("now", "id").alias("story"))
        changed = labels.touched(moved.select("story").unionByName(moved.select(F.col("now").alias("story"))).unionByName(added.select("story")))
        renamed = labels.read(changed, before=epoch).join(names, "story", "left").select("id", F.coalesce("now", "story").alias("story"))
        labels.write(epoch, changed, renamed.unionByName(added))
        keys.write(epoch, touched, kept.unionByName(new))
        dropped(fresh, new, links, grown)

    return write
