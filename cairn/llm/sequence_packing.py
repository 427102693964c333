"""Documents packed into training sequences: shortest-pack-first over the histogram of token lengths.

A document's ids (with its end id) are cut into chunks of a whole sequence and one tail. The counts of tails and chunks by length, at most
one row per length, are all that the driver sees. ``place`` goes through the lengths from the longest to the shortest and puts each into
the packs that are filled least so far. Packs that are filled alike stand side by side and are one entry with a count, so a placement is a
range of ranks against a range of packs, and its cost depends on the number of lengths alone. There are as many packs as the ids need; a
length that fits into none of them is cut at the room of the roomiest one. What is left over is placed again as a shorter length, so
that only less than one sequence of padding remains.

Documents learn their place by rank: the n-th document of a length takes the n-th place of that length. Ranks are counted inside the
partitions that encode, and the ranks where partitions begin come from the table of counts per partition and length, so no length, however
common, passes one task. Encoded rows are written to the shared folder once; a lost executor repeats tasks, not ranks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import saved
from cairn.llm.packing import library_encoder

#: Ids of a sequence, and the id that ends a document.
SEQUENCE, END_ID = 4096, 2
ENCODED = "doc_id long, part int, doc_tokens long, chunk_rank long, tail int, tail_rank long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Columns of a placement: ranks low .. high - 1 of what was cut ``level`` times from lengths ``of``; ``start`` is where the piece begins
#: in its tail, ``length`` its ids. ``per`` of them in a row go into each pack from ``pack`` on, at ``offset``.
PLACE = ("of", "level", "low", "high", "start", "length", "pack", "per", "offset")


def place(histogram: dict[int, int], size: int) -> list[tuple[int, ...]]:
    """Rows of ``PLACE`` for a histogram {length: count} of lengths 1 .. size, the longest first, each into the shortest packs."""
    packs = -(-sum(n * k for n, k in histogram.items()) // size)
    out: list[tuple[int, ...]] = []
    waiting: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)  # by length: of, level, low, high, start
    for length, n in histogram.items():
        waiting[length].append((length, 0, 0, n, 0))
    room = [(-size, 0, packs)] if packs else []  # packs with equal room side by side: room, the first, how many
    for length in range(size, 0, -1):
        runs = waiting.pop(length, [])
        for of, level, low, high, start in runs:
            while low < high:
                space, first, count = heapq.heappop(room)
                space, n = -space, high - low
                fits = space >= length
                if n < count:
                    heapq.heappush(room, (-space, first + n, count - n))
                    count = n
                takes = min(space, length)
                # rounds until another entry has more room, the packs are full, or too few are left for a whole round
                per = max(1, min(space // length, (space + (room[0][0] if room else 0)) // length + 1, n // count)) if fits else 1
                out.append((of, level, low, low + per * count, start, takes, first, per, size - space))
                if not fits:
                    waiting[length - takes].append((of, level + 1, low, low + count, start + takes))
                low += per * count
                if space > per * takes:
                    heapq.heappush(room, (per * takes - space, first, count))
    return out


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    part, chunks = TaskContext.get().partitionId(), 0
    tails: dict[int, int] = defaultdict(int)
    enc, names = library_encoder(tokenizer), [f.split()[0] for f in ENCODED.split(", ")]
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        rows, held = [], 0
        for doc_id, (ids, _) in zip(batch.column(0).to_pylist(), enc.texts(batch.column(1)), strict=True):
            n = len(ids) + 1
            tail = n % size
            rows.append((doc_id, part, n, chunks, tail, tails[tail], ids.astype("<u4").tobytes() + end))
            chunks += n // size
            tails[tail] += 1
            held += 4 * n
            if held > 1 << 24:
                yield _batch(rows, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Places:
    """The table of ``place``, looked up by length, level and rank."""

    def __init__(self, rows: list[tuple[int, ...]]) -> None:
        rows = sorted(rows)
        self.columns = dict(zip(PLACE, np.array(rows, np.int64).reshape(-1, len(PLACE)).T, strict=True))
        at: dict[tuple[int, int], int] = {}
        for i, (of, level, *_) in enumerate(rows):
            at.setdefault((of, level), i)
        starts = list(at.values())
        self.at = {key: (i, j) for (key, i), j in zip(at.items(), [*starts[1:], len(rows)], strict=False)}

    def pieces(self, of: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, pack, offset) of the pieces of one tail or chunk."""
        c, level, done = self.columns, 0, 0
        while done < of:
            i, j = self.at[of, level]
            # pieces cut at one level come from several entries: their ranks are still disjoint
            k = i + int(np.searchsorted(c["low"][i:j], rank, side="right")) - 1
            nth, length = rank - int(c["low"][k]), int(c["length"][k])
            per = int(c["per"][k])
            yield int(c["start"][k]), length, int(c["pack"][k]) + nth // per, int(c["offset"][k]) + nth % per * length
            done += length
            level += 1


def _cut(batches: Iterator[pa.RecordBatch], places: Places, size: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    for batch in batches:
        rows, held = [], 0
        for doc_id, n, chunk, tail, rank, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(n // size):
                for start, length, pack, offset in places.pieces(size, chunk + i):
                    at = i * size + start
                    rows.append((doc_id, at, length, n, pack, offset, ids[4 * at : 4 * (at + length)]))
            if tail:
                for start, length, pack, offset in places.pieces(tail, rank):
                    at = n - tail + start
                    rows.append((doc_id, at, length, n, pack, offset, ids[4 * at : 4 * (at + length)]))
            held += len(ids)
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack_sequences(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    Null and empty texts have their end id alone. Rows of one doc_id, or of none, are documents of their own; equal lengths are told apart
    by where they stand. A document longer than a sequence is cut at whole sequences; other cuts are made only where nothing fits whole.
    An empty table gives no piece; other columns are not read.
    """
    spark = docs.sparkSession
    encoded = saved(docs.select("doc_id", "text").mapInArrow(lambda batches: _encode(batches, tokenizer, size, end_id), ENCODED), "encoded", {"compression": "zstd"})
    whole = F.floor((F.col("doc_tokens") - F.col("tail")) / size)
    counts = encoded.where("tail > 0").groupBy("part", F.col("tail").alias("of")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(encoded.groupBy("part").agg(F.sum(whole).alias("n")).where("n > 0").select("part", F.lit(size).alias("of"), "n"))
    counts = saved(counts, "counts")
    histogram = {r["of"]: r["n"] for r in counts.groupBy("of").agg(F.sum("n").alias("n")).collect()}  # a row per length
    places = spark.sparkContext.broadcast(Places(place(histogram, size)))  # a few rows per length, whatever the size of the corpus
    before = F.sum("n").over(Window.partitionBy("of").orderBy("part")) - F.col("n")
    firsts = counts.withColumn("rank", before).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("of", "rank"))).alias("_firsts"))
    ranked = encoded.join(firsts.hint("shuffle_hash"), "part").select(
        "doc_id", "doc_tokens", (F.col("chunk_rank") + F.coalesce(F.element_at("_firsts", F.lit(size)), F.lit(0))).alias("chunk_rank"), "tail", (F.col("tail_rank") + F.coalesce(F.element_at("_firsts", F.col("tail")), F.lit(0))).alias("tail_rank"), "ids"
    )
    return ranked.mapInArrow(lambda batches: _cut(batches, places.value, size), PIECES)


def sequences(pieces: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """What a trainer reads: sequence_id, n_tokens, lengths of its pieces and its ids, padded to ``size``. A group has at most ``size`` pieces."""
    of = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    pad = "rpad(array_join(transform(p, x -> hex(x.ids)), ''), {0}, '{1}')".format(8 * size, np.array([pad_id], "<u4").tobytes().hex().upper())
    return of.select("sequence_id", "n_tokens", F.expr("transform(p, x -> x.length)").alias("lengths"), F.unhex(F.expr(pad)).alias("ids"))


def packing_digest(pieces: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
