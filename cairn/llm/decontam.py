"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

An item's set holds its distinct 5-word shingles (see ``shingles``); an item of n < 5 words has one element, its n-gram, which is looked up
among the n-grams of the documents. An item is contained in a document if the document holds at least ``threshold`` of its set.

Items are partitioned by the size of their sets (powers of two) and by shingle length. Each partition keeps a bottom-k MinHash sketch of
its items: the k elements with the smallest hashes. A document of any length is looked up shingle by shingle in the sketches, so a short
item is found inside a long text (its Jaccard similarity to the whole would be next to nothing). Of an item of n elements, at most
n - ceil(t n) are missing, so with k = n - ceil(t n) + HITS at least HITS of the sketch are hit (all k, if n is smaller): the search loses
nothing. Candidates are verified by exact containment.

The sketches are broadcast in blocks of bounded size; a benchmark of any length takes more passes over the documents, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import flat, rested, saved
from cairn.llm.shingles import shingle_sets, word_hashes

THRESHOLD = 0.75
K = 5
#: Shingles of one broadcast block (16 bytes each); an item is never split over blocks.
BLOCK_SHINGLES = 2_000_000
#: Elements of the sketch that a contained item hits at least.
HITS = 4
_LOW = (1 << 22) - 1


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """k for an item of n elements: HITS more than can be missing, or all."""
    return min(n, n - int(np.ceil(threshold * n - 1e-9)) + HITS)


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, k (words per shingle), shingles (sorted, as signed longs) of items that have any; null and blank items have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            words = np.minimum(word_hashes(*flat(texts))[1], K).astype(int).tolist() if batch.num_rows else []
            sets = [next(shingle_sets(texts.slice(i, 1), max(1, k))).view(np.int64).tolist() for i, k in enumerate(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "k", "shingles"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, k int, shingles array<long>").where("size(shingles) > 0")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of items, up to BLOCK_SHINGLES shingles at a time, read one partition after another."""
    held, n = [], 0
    for row in items.toLocalIterator():
        if held and n + len(row.shingles) > BLOCK_SHINGLES:
            yield held
            held, n = [], 0
        held.append((row.item_id, row.k, np.array(row.shingles, np.int64).view(np.uint64)))
        n += len(row.shingles)
    if held:
        yield held


class Sketches:
    """The items of one partition: whole sets, and the bottom-k sketches as one sorted table."""

    def __init__(self, rows: list, threshold: float) -> None:
        self.threshold, self.ids = threshold, [i for i, *_ in rows]
        self.sizes = np.array([len(s) for *_, s in rows], np.int64)
        self.whole = np.concatenate([s for *_, s in rows])
        self.start = np.cumsum(self.sizes) - self.sizes
        k = np.array([sketch_size(n, threshold) for n in self.sizes], np.int64)
        self.need = k - (self.sizes - np.ceil(threshold * self.sizes - 1e-9).astype(np.int64))
        sketch = np.concatenate([s[:n] for (*_, s), n in zip(rows, k, strict=True)])  # sets are sorted by hash: the bottom k
        order = np.argsort(sketch, kind="stable")
        self.owner = np.repeat(np.arange(len(rows)), k)[order]
        self.keys, self.first, self.times = np.unique(sketch[order], return_index=True, return_counts=True)

    def contained(self, x: np.ndarray, maybe: np.ndarray) -> Iterator[tuple]:
        """(item id, shared, size) of the items that the sorted set ``x`` contains; ``maybe`` are the elements of it that can be in a sketch."""
        at = np.searchsorted(self.keys, maybe)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == maybe)]
        if not len(at):
            return
        n = self.times[at]
        hit = self.owner[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        items, hits = np.unique(hit, return_counts=True)
        for i in items[hits >= self.need[items]]:
            mine = self.whole[self.start[i] : self.start[i] + self.sizes[i]]
            both = int((x[np.minimum(np.searchsorted(x, mine), len(x) - 1)] == mine).sum())
            if both >= self.threshold * self.sizes[i] - 1e-9:
                yield self.ids[i], both, int(self.sizes[i])


class Search:
    """All partitions of one block of items, by shingle length."""

    def __init__(self, rows: list, threshold: float) -> None:
        parts: dict[tuple[int, int], list] = {}
        for row in rows:
            parts.setdefault((row[1], len(row[2]).bit_length()), []).append(row)
        self.of_k: dict[int, list[Sketches]] = {}
        for (k, _), part in sorted(parts.items()):
            self.of_k.setdefault(k, []).append(Sketches(part, threshold))

    def seen(self) -> dict[int, np.ndarray]:
        """Most shingles of a text are in no sketch: one bit by the low bits of the hash tells."""
        out = {}
        for k, sketches in self.of_k.items():
            bits = out[k] = np.zeros(_LOW + 1, bool)
            for s in sketches:
                bits[(s.keys & np.uint64(_LOW)).astype(np.int64)] = True
        return out

    def texts(self, texts: pa.Array, seen: dict[int, np.ndarray]) -> Iterator[list[tuple]]:
        """What each row contains."""
        found: list[list[tuple]] = [[] for _ in range(len(texts))]
        for k, sketches in self.of_k.items():
            for row, x in zip(found, shingle_sets(texts, k), strict=True):
                maybe = x[seen[k][(x & np.uint64(_LOW)).astype(np.int64)]]
                if len(maybe):
                    for s in sketches:
                        row.extend(s.contained(x, maybe))
        return iter(found)


def _searches(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator:
    for rows in _blocks(saved(item_sets(benchmark), "items")):
        yield docs.sparkSession.sparkContext.broadcast(Search(rows, threshold))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, n_item, containment: all pairs at or above ``threshold``.

    Null, empty and blank texts and items pair with nothing. An item of fewer than five words pairs with every text that holds these words
    in a row. Repeated document rows and repeated items pair each on their own; an empty table on either side gives no rows. Other columns
    are not read.
    """
    found = None
    for shared in _searches(docs, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value
            seen = search.seen()
            for batch in batches:
                rows = [(d, *hit) for d, hits in zip(batch.column(0).to_pylist(), search.texts(batch.column(1), seen), strict=True) for hit in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "item_id", "shared", "n_item"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, shared long, n_item long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, n_item long")
    return found.withColumn("containment", F.col("shared") / F.col("n_item"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document, item) pair."""
    return contained_items(docs, benchmark).select("doc_id", "item_id", "shared", "n_item", "containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text contains no item, with all their columns; each row is judged by its own text, and nothing is shuffled."""
    at = docs.columns.index("text")
    for shared in _searches(docs, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = shared.value
            seen = search.seen()
            for batch in batches:
                yield batch.filter(pa.array([not hits for hits in search.texts(batch.column(at), seen)], pa.bool_()))

        docs = docs.mapInArrow(rested(run), docs.schema)
    return docs
