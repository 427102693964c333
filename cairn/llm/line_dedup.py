"""Exact set-similarity join of text lines, in DataFrame functions only.

A line's tokens are its distinct 5-word shingles (lower case; with fewer words, the whole word sequence). Tokens are put in one order, rare
ones first: the count of their bucket among 65,536, over the whole corpus, gives the rank. Two sets of n and m tokens with Jaccard t or
more share one of the first n - ceil(t n) + 1 tokens of each (prefix filter), their sizes differ by a factor of at most 1 / t (length
filter), and the tokens that can still follow a shared one bound the overlap (positional filter). Pairs left over are verified on the
whole sets: first each set against the earliest set of its buckets and the one before it, then only those without a match against the
rest, so many variants of one line cost two pairs each. A line goes if an earlier line - lower doc_id, then lower line number - reaches the threshold; blank lines
stay.

Tokens are made once, per line, as TOKEN_BITS-bit hashes, and written. Names that more than one line in HOT has are few (less than HOT); only
their first line makes join keys, so no bucket holds a large share of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import HASHES, dropped, fresh, saved

K = 5
T_NUM, T_DEN = 3, 4
BUCKETS = 1 << 16
#: Bits of a token: two lines of 50 tokens have a false common one once in 7 billion pairs.
TOKEN_BITS = 44
#: Bits of a line's name among the keys: of two different lines that share a key, one in 17 trillion has the other's name and is not compared with it.
NAME_BITS = 44
#: A line is hot if more than one in so many lines are copies of it; less than so many names are broadcast (24 bytes each).
HOT = 500_000
#: Line ids that a join broadcasts (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda variable is never computed again inside inner lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(h: Column) -> Column:
    """Hashes of K neighbouring word hashes, or of the whole sequence if it is shorter."""
    n = F.size(h)
    return F.when(n < K, F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - TOKEN_BITS))).otherwise(F.transform(F.slice(h, F.lit(1), F.greatest(n - K + 1, F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, K))), 64 - TOKEN_BITS)))


def _plain(line: Column) -> Column:
    """One space between words; most lines have nothing to replace, which a search for other white space tells faster."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x09-\x0D ]+", " ")).otherwise(line))


def _tokens(plain: Column) -> Column:
    return F.array_distinct(_bound(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)), _shingles))


def _places() -> Column:
    """Of each of ``toks`` the rank of its bucket in ``rarity``, then its other bits; none is null, and Spark sorts longs that can't be null as they are, others as objects."""
    place = lambda t: F.shiftleft(F.get("rarity", t.bitwiseAND(BUCKETS - 1).cast("int")).cast("long"), TOKEN_BITS - 16).bitwiseOR(F.shiftrightunsigned(t, 16))
    return F.transform("toks", lambda t: F.coalesce(place(t), F.lit(0).cast("long")))


def token_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, plain, name, toks of every line; name and check are a 128-bit name of a line's words.

    Outer explodes: of the others Spark infers filters that compute the exploded arrays again.
    """
    x = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    x = x.select("doc_id", "text_key", "line_no", _plain(F.col("line")).alias("plain"))
    return x.select("doc_id", "text_key", "line_no", (F.length("plain") > 0).alias("full"), F.xxhash64("plain").alias("name"), F.xxhash64(F.lit(K), "plain").alias("check"), _tokens(F.col("plain")).alias("toks"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no of the lines that go. Rows of one doc_id are told apart by their text."""
    spark = docs.sparkSession
    sets = saved(token_sets(docs).withColumn("n", F.size("toks")).withColumn("id", F.monotonically_increasing_id()), "tokens", HASHES)
    lines = sets.where("full")
    # the first line of each name; all others of the name match it
    at = F.struct("doc_id", "text_key", "line_no")
    firsts = saved(lines.groupBy("name", "check").agg(F.min(F.struct(at.alias("at"), "id", "n")).alias("f"), F.count("*").alias("copies")).select("name", "check", "f.at", "f.id", "f.n", "copies"), "firsts")
    total = firsts.agg(F.sum("copies")).first()[0] or 0
    # less than HOT names
    hot = firsts.where(F.col("copies") * HOT > total).where("copies > 1").select(F.col("name").alias("hot"), F.col("check").alias("hot_check"), F.col("id").alias("first_id"))
    # tokens by rarity: the rank of the count of a token's bucket
    bucket = F.col("t").bitwiseAND(BUCKETS - 1).cast("int")
    counts = dict(lines.select(F.explode_outer("toks").alias("t")).groupBy(bucket.alias("b")).count().collect())
    rank = {b: i for i, b in enumerate(sorted(range(BUCKETS), key=lambda b: (counts.get(b, 0), b)))}
    rarity = spark.createDataFrame([([rank[b] for b in range(BUCKETS)],)], "c array<int>").scalar()
    cool = lines.join(F.broadcast(hot), (F.col("name") == F.col("hot")) & (F.col("check") == F.col("hot_check")), "left").where("first_id IS NULL OR first_id = id")
    placed = cool.withColumn("rarity", rarity).select("name", "n", _places().alias("places"))
    prefix = F.slice(F.sort_array("places"), F.lit(1), F.col("n") - F.ceil(F.col("n") * T_NUM / T_DEN).cast("int") + 1)
    # names of NAME_BITS and no sizes: fewer bytes to shuffle; a set joins every first line of its short name, which verification tells apart
    short = F.shiftrightunsigned("name", 64 - NAME_BITS).alias("name")
    keys = placed.select(short, F.posexplode_outer(prefix).alias("pos", "key"))
    in_key = Window.partitionBy("key")
    # a key that one set has alone links nothing; of the others one row per set stays
    linking = keys.withColumn("low", F.min("name").over(in_key)).withColumn("high", F.max("name").over(in_key)).where("low < high").select("key", "name", "pos").distinct()
    # written before the join, so that the first lines are not shuffled while the keys stand
    linking = saved(linking, "keys")
    shared = saved(linking.join(firsts.select(short, "id", "at", "n"), "name").select("key", "id", "at", "n", "pos"), "keys")
    dropped(linking)
    named = saved(lines.select("doc_id", "text_key", "line_no", "name", "check"), "lines")
    tokens = saved(_of(lines, shared.select("id").distinct()), "tokens", HASHES)
    dropped(sets)

    # each set against the earliest set of its buckets and the one just before it; those that match one are decided
    row = F.struct("at", "id", "n", "pos")
    tries = F.array(F.min(row).over(in_key), F.lag(row).over(in_key.orderBy("at", "id")))
    first = shared.withColumn("tries", tries).withColumn("b", F.explode("tries")).where("b.id <> id").select(*_side("a"), *(F.col(f"b.{c}").alias(f"{c}_b") for c in ("id", "at", "n", "pos")))
    tried = saved(first.where(_possible()).select("id_a", "id_b").distinct(), "pairs")
    near = saved(_matching(tried, tokens), "near")
    # the others against all earlier sets of their buckets, the one of most shared keys first
    sketched = shared.join(tokens.select("id", *(_flips(w).alias(f"bits{w}") for w in (0, 1))), "id")
    bits = lambda s: [F.col(f"bits{w}").alias(f"bits{w}_{s}") for w in (0, 1)]
    left = sketched.join(near, "id", "left_anti").select("key", *_side("a"), *bits("a"))
    apart = sum(F.bit_count(F.col(f"bits{w}_a").bitwiseXOR(F.col(f"bits{w}_b"))) for w in (0, 1))
    room = (T_DEN + T_NUM) * apart <= (T_DEN - T_NUM) * (F.col("n_a") + F.col("n_b"))
    more = left.join(sketched.select("key", *_side("b"), *bits("b")), "key").where(_possible() & room).groupBy("id_a", "id_b").agg(F.count("*").alias("keys")).join(tried, ["id_a", "id_b"], "left_anti")
    more = saved(more, "pairs")
    best = more.groupBy("id_a").agg(F.max_by("id_b", F.struct("keys", "id_b")).alias("id_b"))
    likely = saved(_matching(best, tokens), "near")
    rest = more.join(likely.select(F.col("id").alias("id_a")), "id_a", "left_anti").select("id_a", "id_b")
    near = near.unionByName(likely).unionByName(saved(_matching(rest, tokens), "near"))
    dropped(shared, tried, more, tokens)

    gone = firsts.join(near.distinct().withColumn("near", F.lit(True)), "id", "left").where("copies > 1 OR near").select("name", "check", "at", "near")
    return named.join(gone, ["name", "check"]).where(F.col("near") | (at != F.col("at"))).select("doc_id", "text_key", "line_no").distinct()


def _flips(word: int) -> Column:
    """One of two words in which each token of a set flips the bit that its hash names: sets differ in as many tokens as bits, at least."""
    mine = F.filter("toks", lambda t: t.bitwiseAND(64) == 64 * word)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))


def _side(s: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{s}") for c in ("id", "at", "n", "pos")]


def _possible() -> Column:
    """b is earlier, and sizes and positions leave room for the threshold: overlap >= t / (1 + t) * (n + m)."""
    need = F.ceil((F.col("n_a") + F.col("n_b")) * T_NUM / (T_NUM + T_DEN))
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) + F.least("pos_a", "pos_b")
    return (F.col("at_b") < F.col("at_a")) & (F.greatest("n_a", "n_b") * T_NUM <= F.least("n_a", "n_b") * T_DEN) & (rest >= need)


def _of(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The tokens of these ids; the others are not shuffled while the ids fit a broadcast."""
    ids = saved(ids, "ids")
    return sets.select("id", "toks").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _matching(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Ids of sets a of the pairs whose whole sets reach the threshold."""
    left, right = (tokens.select(F.col("id").alias(f"id_{s}"), F.col("toks").alias(f"toks_{s}")) for s in "ab")
    both = F.size(F.array_intersect("toks_a", "toks_b"))
    return pairs.join(left, "id_a").join(right, "id_b").where(both * (T_DEN + T_NUM) >= (F.size("toks_a") + F.size("toks_b")) * T_NUM).select(F.col("id_a").alias("id")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; n_lines and n_removed are added (columns of these names are replaced).

    Null texts stay null and have no lines; blank lines stay; a text all of whose lines go is empty. Rows equal in doc_id and text lose
    the same lines; rows of one doc_id, or of none, with different texts are different documents, ordered by a hash of the text. Other
    columns pass through under any name; an empty table gives no rows.
    """
    id_, key, found = (fresh(docs, c) for c in ("gone_id", "gone_key", "gone_lines"))
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.collect_set("line_no").alias(found))
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains(found, i), x)), lambda x: x.isNotNull())
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    counts = [F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.coalesce(F.size(found), F.lit(0)).alias("n_removed")]
    return out.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in others), *counts)
