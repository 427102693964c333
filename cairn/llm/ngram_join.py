"""Exact Jaccard join of documents on word shingles by parity sketches.

A parity sketch has P parts of 64 bits. Each element of a set is XORed, as 64 random bits, into the part that its hash names, so what two
sets have in common cancels out, and the number of parts in which two sketches differ - their Hamming distance over parts - is at
most the size D of the symmetric difference. At least P - D parts are equal. Ordering the parts of every set by one rule (most elements
first, then by hash), two such sets share one of their first D + 1 parts; these are the join keys. At Jaccard t, D is at most (1 - t) / t of the smaller set. P depends on the size band of the smaller set;
a set joins as the smaller one in its own band and as the larger one in the band below if it can reach it.

Equal sets are one class. Inside a bucket of equal keys, each class is first compared with the bucket's smallest class only, if coarse sketches leave room; the pairs that
are left are those of one bucket whose classes are still in different components, so large groups of near copies cost a pair per
member, and no link between components is lost. All candidates are verified on the exact shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import dropped, fresh, saved
from cairn.llm.components import components
from cairn.llm.shingles import mix, shingle_sets

#: Jaccard of at least 75 / 100.
NUM, DEN = 75, 100
#: 64-bit words of the parity sketch that candidates are held against before their texts are read.
WORDS = 16
#: The same for sets of LARGE elements and more.
WIDE_WORDS, LARGE = 128, 900
#: Documents whose ids a join broadcasts (16 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Smallest keys of a class that tell at which shared key a pair comes out.
HEADS = 8


def parts_of(band: int) -> int:
    """P for pairs whose smaller set has 2**band to 2**(band + 1) - 1 elements; a tenth more than the largest D + 1."""
    return int(np.ceil(1.1 * (((1 << (band + 1)) - 1) * (DEN - NUM) // NUM + 1)))


def sketch(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of elements, XOR of their 64-bit hashes) of each part of a sorted set; an element is in the part that the top of its hash names."""
    part = ((x >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    count = np.bincount(part.astype(np.int64), minlength=parts)
    bits = np.zeros(parts, np.uint64)
    full = np.flatnonzero(count)
    bits[full] = np.bitwise_xor.reduceat(mix(x), (np.cumsum(count) - count)[full])
    return count, bits


def keys_of(x: np.ndarray) -> np.ndarray:
    """The join keys of a set; a set that only an equal one can match has none."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    band, out = n.bit_length() - 1, []
    # as the smaller set: D <= n (1 - t) / t; as the larger one: D <= 2 n (1 - t) / (1 + t)
    roles = [(band, n * (DEN - NUM) // NUM)]
    if band and NUM * n <= DEN * ((1 << band) - 1):
        roles.append((band - 1, 2 * n * (DEN - NUM) // (DEN + NUM)))
    for of, most in roles:
        if most:
            parts = parts_of(of)
            count, bits = sketch(x, parts)
            h = mix(bits ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(of << 40)))
            key = (np.uint64(255) - np.minimum(count, 255).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            out.append(np.partition(key, most)[: most + 1] if most + 1 < parts else key)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def text_key() -> Column:
    """Tells rows of one doc_id, or of none, with different texts apart."""
    return F.xxhash64("text")


def class_of(x: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have one name."""
    return int(mix(mix(x).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(x)))[0].astype(np.int64)) if len(x) else 0


def parities(x: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A sketch of words * 64 bits in which each element flips the bit that its hash names: the Hamming distance of two is at most their symmetric difference."""
    bits = np.bincount((mix(x + np.uint64(1)) % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def may_link(a: str, b: str) -> Column:
    """Whether sizes and parity sketches of two classes (columns n_shingles, bits, wide with these suffixes) leave room for the threshold: D <= (1 - t) / (1 + t) * (n + m)."""
    n, m = F.col(f"n_shingles_{a}"), F.col(f"n_shingles_{b}")
    apart = sum(F.bit_count(F.get(f"bits_{a}", F.lit(i)).bitwiseXOR(F.get(f"bits_{b}", F.lit(i)))) for i in range(WORDS))
    wide = F.aggregate(F.zip_with(f"wide_{a}", f"wide_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    room = (DEN - NUM) * (n + m)
    return (NUM * F.greatest(n, m) <= DEN * F.least(n, m)) & ((DEN + NUM) * apart <= room) & F.coalesce((DEN + NUM) * wide <= room, F.lit(True))


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, cls, bits of every whole text; wide for large sets only, whose bits would be full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(x), class_of(x), parities(x), parities(x, WIDE_WORDS) if len(x) >= LARGE else None) for x in shingle_sets(batch.column(2))]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in sets], k) for i, k in enumerate(kinds))], ["doc_id", "text_key", "n_shingles", "cls", "bits", "wide"])

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls long, bits array<long>, wide array<long>")


def class_keys(docs: DataFrame) -> DataFrame:
    """key, cls: the join keys of the texts' classes. A task gives the keys of a class once among its last 100,000 classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, names = [np.zeros(0, np.int64)], []
            for x in shingle_sets(batch.column(0)):
                c = class_of(x)
                if len(x) and c not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(c)
                    keys.append(keys_of(x))
                    names.append((c, len(keys[-1])))
            names = np.array(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(names[:, 0], names[:, 1]))], ["key", "cls"])

    return docs.select("text").mapInArrow(run, "key long, cls long")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, by exact intersection; one text per class is read."""
    wanted = pairs.select(F.explode_outer(F.array("a", "b")).alias("cls")).distinct()
    one = classes.join(wanted, "cls").groupBy("cls").agg(F.min(F.struct(_id("doc_id").alias("row_id"), "text_key")).alias("of")).select("cls", "of.*")
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        one = F.broadcast(one)
    found = docs.select(_id("doc_id").alias("row_id"), text_key().alias("text_key"), "text").join(one, ["row_id", "text_key"])
    # rows that repeat id and text are one
    texts = found.groupBy("cls").agg(F.first("text").alias("text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            text_b = batch.column(3)
            for i, x in enumerate(shingle_sets(batch.column(2))):
                if b[i] != last:
                    last, held = b[i], next(shingle_sets(text_b.slice(i, 1)))
                both = len(np.intersect1d(x, held, assume_unique=True))
                ok.append(DEN * both >= NUM * (len(x) + len(held) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("b").mapInArrow(check, "a long, b long, ok boolean").where("ok").select("a", "b").distinct()


def _id(column: str) -> Column:
    """doc_id as a join key: rows without one have the smallest long."""
    return F.coalesce(F.col(column), F.lit(-(1 << 63)).cast("long"))


def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose classes are in different components, with comp_a < comp_b."""
    x, y = (comp.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}")) for s in "ab")
    z = pairs.join(x, "a", "left").join(y, "b", "left").withColumn("c_a", F.coalesce("c_a", "a")).withColumn("c_b", F.coalesce("c_b", "b")).where("c_a <> c_b")
    return z.select("a", "b", "keys", F.least("c_a", "c_b").alias("comp_a"), F.greatest("c_a", "c_b").alias("comp_b"))


def pairs_between(mixed: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, keys): pairs of classes of different components that share a key and may link, from ``mixed(key, cls, comp)``.

    Near copies share most of their keys, so a pair comes out once, at the smallest key that both classes have among their HEADS smallest
    ones; only pairs without such a key come out at each key that they share. Members of one component are never put together.
    """
    heads = mixed.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEADS).alias("head"))
    known = mixed.join(facts.join(heads, "cls"), "cls")
    a, b = (known.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "comp", "n_shingles", "bits", "wide", "head"))) for k in "ab")
    common = F.array_intersect("head_a", "head_b")
    once = (F.size(common) == 0) | (F.array_min(common) == F.col("key"))
    more = a.join(b, "key").where((F.col("comp_a") < F.col("comp_b")) & (NUM * F.greatest("n_shingles_a", "n_shingles_b") <= DEN * F.least("n_shingles_a", "n_shingles_b")) & once & may_link("a", "b"))
    return more.groupBy(F.greatest("cls_a", "cls_b").alias("a"), F.least("cls_a", "cls_b").alias("b")).agg(F.count("*").alias("keys"))


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; see ``components_of_rows``."""
    return components_of_rows(docs).select("doc_id", "n_shingles", "component_id")


def components_of_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, comp, component_id for every row of ``docs``.

    Null, empty and blank texts have no shingles and are their own component. Rows with equal texts are one class whatever their number;
    rows of one doc_id, or of none, may differ in text. component_id is null where no row of the component has an id.
    Other columns are not read; an empty table gives no rows.
    """
    classes = saved(document_classes(docs), "classes")
    in_key = Window.partitionBy("key")
    # a key that one class has alone links nothing
    buckets = saved(
        class_keys(docs).withColumn("low", F.min("cls").over(in_key)).withColumn("high", F.max("cls").over(in_key)).where("low < high").groupBy("key", "cls").agg(F.min("low").alias("low")), "buckets"
    )
    # each class against the smallest class of each of its buckets, if their sketches leave room: pairs in proportion to bucket rows
    first = buckets.where("cls <> low").select("cls", "low").distinct()
    facts = classes.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n_shingles", "bits", "wide")))
    fact = {k: facts.select(*(F.col(c).alias(f"{c}_{k}") for c in facts.columns)) for k in "ab"}
    tried = first.select(F.col("cls").alias("a"), F.col("low").alias("b")).join(fact["a"], F.col("a") == F.col("cls_a")).join(fact["b"], F.col("b") == F.col("cls_b")).where(may_link("a", "b"))
    tried = saved(tried.select("a", "b"), "pairs")
    links = saved(verified(tried, docs, classes), "links")
    comp = saved(components(links), "components")
    # pairs of one bucket whose classes are in different components
    named = buckets.join(comp, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    mixed = saved(named.withColumn("lo", F.min("comp").over(in_key)).withColumn("hi", F.max("comp").over(in_key)).where("lo < hi").select("key", "cls", "comp"), "mixed")
    more = pairs_between(mixed, facts).join(tried, ["a", "b"], "left_anti")
    more = saved(more, "pairs")
    # one pair for each two components first, then what still lies between components
    between = Window.partitionBy("comp_a", "comp_b").orderBy(F.desc("keys"), "a", "b")
    best = saved(apart(more, comp).withColumn("r", F.row_number().over(between)).where("r = 1").select("a", "b"), "pairs")
    linked = saved(verified(best, docs, classes), "links")
    comp = saved(components(links.unionByName(linked)), "components")
    rest = saved(apart(more.join(best, ["a", "b"], "left_anti"), comp).select("a", "b"), "pairs")
    last = saved(verified(rest, docs, classes), "links")
    comp = saved(components(links.unionByName(linked).unionByName(last)), "components")
    # a name per class, then per document; both tables have a row per class at most
    lows = classes.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    lows = lows.join(comp, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    names = lows.select("cls", "comp").join(lows.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "comp", "component_id")
    dropped(buckets, tried, mixed, more, best, rest, links, linked, last)
    return classes.join(names, "cls", "left").select("doc_id", "text_key", "n_shingles", "comp", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id (rows with one come first), then by text.

    Rows without shingles all stay. Rows that repeat id and text are copies of each other, so one of them stays. Columns pass through.
    """
    id_, text = (fresh(docs, c) for c in ("first_id", "first_text"))
    rows = components_of_rows(docs).where("n_shingles > 0")
    kept = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("f")).select(_id("f.doc_id").alias(id_), F.col("f.text_key").alias(text))
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.where(~blank).withColumn(id_, _id("doc_id")).withColumn(text, text_key())
    return named.join(kept, [id_, text], "left_semi").dropDuplicates([id_, text]).select(*docs.columns).unionByName(docs.where(blank))
