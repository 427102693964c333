"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has ``2**CELL_BITS`` cells. Every shard owns ``vnodes`` cells placed by hash; a row starts in the cell of its key's hash and
belongs to the first virtual node clockwise. Each shard takes its own rows up to its capacity, in ring order; rows that find it full
continue clockwise to the next virtual node whose shard has room, in ring order too. Capacities add up to the number of rows and
differ by one at most, so the counts do.

Only per-cell counts reach the driver (``2**CELL_BITS`` numbers whatever the input); it walks the ring once and sends back ranges of
ranks per cell. Rows are ranked inside a cell, never inside a shard, so a task holds about 1 / 65,536 of the input.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import fresh

CELL_BITS = 16


def place_vnodes(hashes: list[tuple[int, int]], cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; a taken cell passes a node on to the next free one."""
    taken: dict[int, int] = {}
    for shard, h in hashes:
        cell = h % cells
        while cell in taken:
            cell = (cell + 1) % cells
        taken[cell] = shard
    return sorted(taken.items())


def allot(counts: dict[int, int], ring: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, slot of the first rank): who gets which rows of each cell."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at = [c for c, _ in ring]
    out, over = [], []

    def give(cell: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            out.append((cell, first, first + n - 1, shard, used[shard]))
            used[shard] += n
        return n

    for cell in sorted(counts):
        node = bisect_left(at, cell) % len(ring)
        kept = give(cell, 0, counts[cell], ring[node][1])
        if kept < counts[cell]:
            over.append((cell, kept, counts[cell] - kept, node))
    for cell, first, n, node in over:
        while n:
            kept = give(cell, first, n, ring[node][1])
            first, n, node = first + kept, n - kept, (node + 1) % len(ring)
    return out


def shard_rows(df: DataFrame, key: str, shards: int, vnodes: int = 100, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``key`` places a row on the ring; ``order`` breaks ties between rows of one key so that slots repeat from run to run. Null keys
    share one place. Repeated rows are rows: each gets its own slot. An empty table gives an empty result. All columns pass through; where
    the input has a ``shard`` or ``slot`` of its own, the new one has underscores in front.
    """
    if vnodes * shards > 1 << CELL_BITS:
        raise ValueError("more virtual nodes than cells")
    spark, cells = df.sparkSession, 1 << CELL_BITS
    nodes = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.pmod(F.shiftright(F.xxhash64(F.lit("node"), "id"), 20), F.lit(cells)).alias("h")).orderBy("id").collect()
    ring = place_vnodes([(r.shard, r.h) for r in nodes], cells)
    shard, slot, pos, cell, rank, at, low, high, base = (fresh(df, n) for n in ("shard", "slot", "_pos", "_cell", "_rank", "_c", "_from", "_to", "_slot"))
    placed = df.withColumn(pos, F.xxhash64(F.lit("row"), F.col(key))).withColumn(cell, F.shiftrightunsigned(pos, 64 - CELL_BITS).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}
    table = spark.createDataFrame(allot(counts, ring, shards), f"{at} int, {low} long, {high} long, {shard} int, {base} long")
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy(cell).orderBy(pos, key, *order)) - F.lit(1).cast("long"))
    # cells + shards rows at most: each cell gives one range, and one more each time a shard fills up
    return (
        ranked.join(F.broadcast(table), (F.col(cell) == F.col(at)) & F.col(rank).between(F.col(low), F.col(high)))
        .withColumn(slot, F.col(base) + F.col(rank) - F.col(low))
        .drop(at, low, high, base, cell, pos, rank)
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``documents``; the law is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, "doc_id", shards, order=("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
