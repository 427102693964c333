"""Repair of conversation structure by the cheapest edits: bidirectional Dijkstra over the edit lattice.

A conversation should read: maybe a system turn, then user and assistant by turns, ending with the assistant, or nothing. A node of the
lattice is (turns read, what came last: nothing, system, user, assistant). Edges keep a turn, give it the other role, delete it, or insert
an empty one. Searches run from both ends; each settles nodes by cost and gives them their least audit (the edits' initials). Once the two
fronts cost more than the best crossing, all crossings of least cost have been met, and the least concatenated audit is taken. Two audits
that lead to one node at one cost are never prefixes of each other, as no edge goes back for nothing, so the least halves make the least whole.

Conversations of ordinary length are solved whole in the task that has them; equal structures are solved once. Longer ones (``LONG_ROWS``,
``LONG_BYTES``) never stand in one task: their rows are dealt by range, faults come from aggregates, blocks of ``BLOCK`` rows are solved
for each pair of states at their ends, and a pass over the block summaries chains them. Their text meets in one task for the digest alone, which has
to be taken in order, and streams through it.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import saved

#: Rows and bytes of text up to which a conversation is solved by one task whole; rows of a block of longer ones.
LONG_ROWS, LONG_BYTES, BLOCK = 4096, 32 << 20, 1024
#: Long conversations whose ids a join broadcasts; more are joined by shuffling.
BROADCAST_LONG = 100_000
SPACES = "\t\n\x0b\x0c\r "
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads from each state, as it is (by initial) and as an inserted or changed turn.
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LEGAL = {"su", "ua", "au"}
CHANGE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def code_of(role: str, must_go: bool, truncated: bool) -> str:
    """One letter per turn: x must go; s, u, a, o by the role's initial, in upper case if truncated."""
    if must_go:
        return "x"
    letter = role[:1] if role[:1] in KEEP else "o"
    return letter.upper() if truncated else letter


def _edges(codes: str, runs: tuple[int, ...] | None, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """(row, state, cost, edit) of the edges that leave a node. ``runs``: how many rows an x stands for (they go together: D is least)."""
    if q in TURN:
        yield i, TURN[q], INSERT, "I"
    if i < len(codes):
        code = codes[i]
        if code == "x":
            n = runs[i] if runs else 1
            yield i + 1, q, DELETE * n, "D" * n
            return
        yield i + 1, q, DELETE, "D"
        low = code.lower()
        worse = TRUNCATED if low != code else 0
        yield i + 1, TURN[q], CHANGE + worse, "R"
        to = KEEP.get(low, {}).get(q)
        if to is not None:
            yield i + 1, to, worse, "K"


#: For each state, the states that an edge may come from.
_BEFORE = {NOTHING: (NOTHING,), SYSTEM: (SYSTEM, NOTHING), USER: (USER, NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (ASSISTANT, USER)}


def cheapest(codes: str, entry: int = NOTHING, exits: tuple[int, ...] = (NOTHING, ASSISTANT), runs: tuple[int, ...] | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``exits``, the least audit among equals; None if there is no way."""
    n = len(codes)
    ahead, behind = [(0, 0, "", entry)], [(0, -n, "", q) for q in exits]  # cost, row, audit, state; at one cost, rows in walking order
    heapq.heapify(behind)
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None
    while ahead or behind:
        front, back = ahead[0][0] if ahead else 0, behind[0][0] if behind else 0
        if best and front + back > best[0]:
            break
        if ahead and (front <= back or not behind):
            cost, i, audit, q = heapq.heappop(ahead)
            if (i, q) in done[0]:
                continue
            done[0][i, q] = cost, audit
            met = [(0, "", done[1].get((i, q)))]
            for j, p, step, edit in _edges(codes, runs, i, q):
                if (j, p) not in done[0]:
                    heapq.heappush(ahead, (cost + step, j, audit + edit, p))
                met.append((step, edit, done[1].get((j, p))))
            found = [(cost + step + other[0], audit + edit + other[1]) for step, edit, other in met if other]
        else:
            cost, i, audit, q = heapq.heappop(behind)
            i = -i
            if (i, q) in done[1]:
                continue
            done[1][i, q] = cost, audit
            met = [(0, "", done[0].get((i, q)))]
            for j in (i, i - 1) if i else (i,):
                for p in _BEFORE[q]:
                    for at, to, step, edit in _edges(codes, runs, j, p):
                        if (at, to) == (i, q):
                            if (j, p) not in done[1]:
                                heapq.heappush(behind, (cost + step, -j, edit + audit, p))
                            met.append((step, edit, done[0].get((j, p))))
            found = [(other[0] + step + cost, other[1] + edit + audit) for step, edit, other in met if other]
        best = min([best, *found] if best else found, default=None)
    return best


#: Structures of conversations repeat; one process keeps so many solved.
solved = functools.lru_cache(50_000)(cheapest)


def applied(audit: str, rows: Iterator[tuple[str, str]], state: int = NOTHING) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns."""
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            state = TURN[state]
            role = names[state]
        else:
            state = KEEP[role[0]][state]
        yield role, text


# damage of the registered query


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` (0: dropped, 2: repeated) after the damage that crc32 of ``conv_id:turn`` modulo 20 deals; nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    deal = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(deal.isin(0, 1), "").when(deal == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(deal == 0, "").when(deal == 4, "user").otherwise(word("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(deal == 0, 0).when(deal == 3, 2).otherwise(1).alias("copies"))


def _last(text: Column) -> Column:
    """The last character that is no white space; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def _turn_key(turn: Column | str) -> Column:
    """Missing turns come first."""
    return F.struct(F.col(turn).isNotNull(), F.col(turn)) if isinstance(turn, str) else turn


# conversations of ordinary length


class _Stats:
    """Figures of rows in order, and what is needed to go on with the next rows."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = self.turn = None
        self.first_turn = None

    def add(self, initial: str, turn: int | None, kind: str, copies: int = 1) -> None:
        if self.first is None:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.rows += copies
        self.blank += copies * (kind == "blank")
        self.truncated += kind == "truncated"
        self.duplicate += copies * (kind == "duplicate") + (copies - 1) * (kind in ("truncated", "whole"))
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.last = initial

    def figures(self) -> tuple[int, ...]:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _short(rows: list[tuple]) -> tuple:
    """Result of one conversation from its (turn, role, text, last, copies), in order."""
    stats, seen, codes, kept = _Stats(), set(), [], []
    for turn, role, text, last, copies in rows:
        for _ in range(copies):
            kind = "blank" if not last else "duplicate" if (role, text) in seen else "whole" if last in ".!?" else "truncated"
            seen.add((role, text))
            stats.add(role[:1], turn, kind)
            codes.append(code_of(role, kind in ("blank", "duplicate"), kind == "truncated"))
            kept.append((role, text))
    cost, audit = solved("".join(codes))
    return *stats.figures(), cost, audit, kept


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, its rows) of sorted batches whose first column is conv_id."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, [r[1:] for r in group]


def _results(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for conv, rows in _stream(batches):
        *figures, cost, audit, kept = _short(rows)
        text = "\n".join(f"{role}:{text}" for role, text in applied(audit, iter(kept)))
        out.append((conv, *figures, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        if len(out) == 4096:
            yield _results(out)
            out = []
    if out:
        yield _results(out)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "role", "text"]
    for conv, rows in _stream(batches):
        *_, audit, kept = _short(rows)
        done = list(applied(audit, iter(kept)))
        if done:
            roles, texts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names)


def _ordered(rows: DataFrame) -> DataFrame:
    """Whole conversations in a partition each, in order; turns that are equal go by role and text."""
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "last", "copies")


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary conversations, and of long ones."""
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long").alias("copies"))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("m"))
    over = saved(sizes.where((F.greatest("n", "m") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("_long")), "long")
    few = over.limit(BROADCAST_LONG + 1).count() <= BROADCAST_LONG
    side = F.broadcast(over) if few else over
    rows = rows.withColumn("last", _last(F.col("text")))
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(side, same, "left_anti"), rows.join(side, same, "left_semi")


# long conversations


def _block_summary(keys: tuple, table: pa.Table) -> pa.Table:
    """One row for a block: figures, and cost and audit from each state to each state."""
    rows = table.sort_by("at").to_pylist()
    stats, codes, runs = _Stats(), [], []
    for r in rows:
        kind = "blank" if not r["last"] else "duplicate" if r["seen"] else "whole" if r["last"] in ".!?" else "truncated"
        if r["copies"]:
            stats.add(r["role"][:1], r["turn"], kind, r["copies"])
        whole = kind in ("whole", "truncated") and r["copies"] > 0
        if whole:
            codes.append(code_of(r["role"], False, kind == "truncated"))
            runs.append(1)
        if r["copies"] > whole:
            codes.append("x")
            runs.append(r["copies"] - whole)
    text, counts = "".join(codes), tuple(runs)
    ways = [(i, o, *way) for i in range(4) for o in range(4) if (way := cheapest(text, i, (o,), counts))]
    fields = [stats.rows, stats.blank, stats.duplicate, stats.truncated, stats.illegal, stats.turns, stats.low, stats.high, stats.first, stats.last, stats.first_turn, stats.turn]
    return pa.Table.from_arrays([table.column("conv_id")[:1].combine_chunks(), pa.array([rows[0]["block"]], pa.int64()), *(pa.array([v], pa.string() if k in (8, 9) else pa.int64()) for k, v in enumerate(fields)), pa.array([[{"i": i, "o": o, "cost": c, "audit": a} for i, o, c, a in ways]], pa.list_(pa.struct([("i", pa.int32()), ("o", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))], [f.split()[0] for f in SUMMARY.split(", ", 14)])


SUMMARY = "conv_id long, block long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, first_turn long, last_turn long, ways array<struct<i:int,o:int,cost:bigint,audit:string>>"


def _tail(label: tuple | None, depth: int) -> list[str]:
    out = []
    while label and label[0] > depth:
        out.append(label[1])
        label = label[2]
    return out[::-1]


def _less(a: tuple, b: tuple) -> bool:
    """Whether chain a spells less than b. A chain is (length in blocks, audit of the last block, chain before, state before)."""
    x, y = a, b
    while x is not y and x and y:
        x, y = x[2], y[2]
    depth = x[0] if x is y and x else 0
    return "".join(_tail(a, depth)) < "".join(_tail(b, depth))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From block summaries in order: a row with the figures of each conversation, and a row with state and edits of each block."""
    names = ["conv_id", "block", "state", "audit", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()] + [pa.int64()] * 6
    rows = (r for batch in batches for r in batch.to_pylist())
    for conv, group in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        best: dict[int, tuple[int, tuple | None]] = {NOTHING: (0, None)}
        blocks, sums, illegal, turns = [], [0, 0, 0], 0, 0
        low = high = last = last_turn = None
        for r in group:
            blocks.append(r["block"])
            after: dict[int, tuple[int, tuple]] = {}
            for way in r["ways"]:
                if way["i"] in best:
                    cost, chain = best[way["i"]]
                    new = (cost + way["cost"], (len(blocks), way["audit"], chain, way["i"]))
                    old = after.get(way["o"])
                    if not old or new[0] < old[0] or new[0] == old[0] and _less(new[1], old[1]):
                        after[way["o"]] = new
            best = after
            if not r["n"]:
                continue
            sums = [s + r[k] for s, k in zip(sums, ("blank", "duplicate", "truncated"), strict=True)]
            illegal += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
            turns += r["turns"] - (r["low"] is not None and r["first_turn"] is not None and r["first_turn"] == last_turn)
            low = r["low"] if low is None else low
            high = high if r["high"] is None else r["high"]
            last, last_turn = r["last"], r["last_turn"]
        ends = [best[q] for q in (NOTHING, ASSISTANT) if q in best]
        least = ends[0]
        for end in ends[1:]:
            if end[0] < least[0] or end[0] == least[0] and _less(end[1], least[1]):
                least = end
        out, chain = [], least[1]
        while chain:
            out.append((conv, blocks[chain[0] - 1], chain[3], chain[1], None, None, None, None, None, None))
            chain = chain[2]
        out.append((conv, None, None, None, high - low + 1 - turns if low is not None else 0, *sums, illegal, least[0]))
        for i in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[i : i + 1024]], t) for k, t in enumerate(kinds)], names)


CHAINED = "conv_id long, block long, state int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str | None, str | None]]]]:
    """(conv_id, (audit of a block, its role and text) ...) of blocks' edits and rows in order; repaired turns stream."""

    def repaired(rows: Iterator[tuple]) -> Iterator[tuple[str, str | None, str | None]]:
        for _, block in itertools.groupby(rows, key=lambda r: r[1]):
            _, _, _, _, state, audit, _, _ = next(block)
            yield audit, None, None
            for role, text in applied(audit, ((r[6], r[7]) for r in block for _ in range(r[3])), state):
                yield "", role, text

    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, repaired(group)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, turns in _edited(batches):
        sha, audits, between = hashlib.sha256(), [], ""
        for audit, role, text in turns:
            if role is None:
                audits.append(audit)
            else:
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audits)], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["conv_id", "audit", "repaired_sha256"])


def _long(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Figures of each long conversation, and the edits and rows of its blocks, to be streamed in order."""
    rows = rows.groupBy("conv_id", "turn", "role", "text", "last").agg(F.sum("copies").alias("copies")).withColumn("name", F.md5(F.concat_ws("\0", "role", "text").cast("binary")))
    heard = rows.where("copies > 0 AND last <> ''")
    firsts = heard.groupBy(F.col("conv_id").alias("_conv"), F.col("name").alias("_name")).agg(F.min(_turn_key("turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("name") == F.col("_name")), "left").withColumn("seen", F.coalesce(_turn_key("turn") > F.col("_first"), F.lit(False)))
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    ordered = saved(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "last", "copies", "seen", F.monotonically_increasing_id().alias("at")), "ordered").withColumn("block", F.floor(F.col("at") / block))
    summaries = ordered.select("conv_id", "block", "at", "turn", F.left("role", F.lit(1)).alias("role"), "last", "copies", "seen").groupBy("conv_id", "block").applyInArrow(_block_summary, SUMMARY)
    chained = saved(summaries.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block").mapInArrow(_chain, CHAINED), "chained")
    edits = chained.where("block IS NOT NULL").select("conv_id", "block", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("copies"), "state", "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    # of copies, what is behind the first is in the audit too
    texts = ordered.select("conv_id", "block", "at", "copies", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"), "role", "text")
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block", "at")
    return chained.where("block IS NULL"), both


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of the repaired turns.

    Rows are (conv_id, turn, role, text) and maybe ``copies`` (a row stands for so many; 0 keeps the conversation in the result without a
    row). Missing turns come first; rows of one turn go by role and text. Missing roles and texts are one space, which is blank. Rows without
    a conv_id are one conversation. A conversation without rows has zeros, no audit and the digest of nothing. Other columns are not read.
    """
    short, long = _split(conversations, long_rows, long_bytes)
    out = _ordered(short).mapInArrow(_solve, RESULT)
    figures, texts = _long(long, block)
    digests = texts.mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "_conv")
    whole = figures.drop("audit").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.unionByName(whole.select(*(f.split()[0] for f in RESULT.split(", "))))


def repaired_turns(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, block: int = BLOCK) -> DataFrame:
    """conv_id, position, role, text of the repaired turns of every conversation; those without turns have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _edited(batches):
            for i, (_, role, text) in enumerate(t for t in turns if t[1] is not None):
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([i], pa.int64()), pa.array([role], pa.string()), pa.array([text], pa.string())], ["conv_id", "position", "role", "text"])

    short, long = _split(conversations, long_rows, long_bytes)
    schema = "conv_id long, position long, role string, text string"
    return _ordered(short).mapInArrow(_turns, schema).unionByName(_long(long, block)[1].mapInArrow(run, schema))
