"""Sequence packing, conversation repair and alignment against brute force."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import alignment, conversations, sequence_packing
from cairn.llm.queries import BYTE_BPE, PIECE_BPE, WORD_BPE
from tests.llm.test_operators import SCHEMA, corpus

needs_tokenizer = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no vocabulary")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(), (None, "no id", "en", "s", 5, "k", "c", "n"), (None, None, "en", "s", 0, "k", "c", "n")], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# packing


def placed(histogram: dict[int, int], size: int) -> int:
    """Checks a placement piece by piece; gives the number of pieces."""
    places = sequence_packing.Places(sequence_packing.place(histogram, size))
    packs: dict[int, list] = defaultdict(list)
    for of, n in histogram.items():
        for rank in range(n):
            at = 0
            for start, length, pack, offset in places.pieces(of, rank):
                assert start == at and length > 0
                at += length
                packs[pack].append((offset, length))
            assert at == of
    for pieces in packs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(packs) == list(range(-(-sum(k * n for k, n in histogram.items()) // size)))
    return sum(map(len, packs.values()))


@pytest.mark.parametrize("histogram", [{}, {8: 3}, {1: 5}, {3: 7}, {5: 100}, {1: 1000, 7: 3}, {8: 2, 4: 5, 2: 1}])
def test_placement(histogram):
    placed(histogram, 8)


def test_placement_of_random_lengths():
    rng = random.Random(1)
    for _ in range(300):
        placed(Counter(rng.randrange(1, 17) for _ in range(rng.randrange(60))), 16)
    lengths = Counter(min(4096, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(5000))
    assert placed(lengths, 4096) < 1.1 * 5000
    # the cost follows the lengths, not the documents
    assert len(sequence_packing.place({k: n * 10**9 for k, n in lengths.items()}, 4096)) < 20 * len(lengths)


def test_placement_is_shortest_first():
    """Against one document at a time into the emptiest pack, where nothing is cut."""
    lengths = {7: 3, 5: 4, 3: 6, 1: 9}
    packs = [0] * -(-sum(k * n for k, n in lengths.items()) // 20)
    for length in sorted(lengths, reverse=True):
        for _ in range(lengths[length]):
            packs[packs.index(min(packs))] += length
    got = Counter()
    for of, level, low, high, _, length, pack, per, _ in sequence_packing.place(lengths, 20):
        assert level == 0 and length == of
        for rank in range(low, high):
            got[pack + (rank - low) // per] += length
    assert sorted(got.values()) == sorted(packs)


@needs_tokenizer
@pytest.mark.parametrize("size", [64, 4096])
def test_pack_sequences(docs, none, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    out = sequence_packing.pack_sequences(docs, WORD_BPE, size)
    pieces = [r.asDict() for r in out.collect()]
    want = Counter((r.doc_id, tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        p["list"] = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(p["list"]) == p["length"] > 0
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(by_sequence) == -(-total // size)
    for doc_id, rows in by_doc.items():
        tokens = Counter()
        for p in rows:
            tokens.update((p["doc_tokens"], p["start"] + i, t) for i, t in enumerate(p["list"]))
        assert tokens == sum((Counter({(len(ids), i, t): n for i, t in enumerate(ids)}) for (d, ids), n in want.items() if d == doc_id), Counter())
    digest = {(r.doc_id, r.start, r.sequence_id, r.offset): r.ids_crc32 for r in sequence_packing.packing_digest(out).collect()}
    assert len(digest) == len(pieces)
    if size == 64:
        whole = sequence_packing.sequences(out, size, 7).collect()
        assert len(whole) == len(by_sequence)
        for r in whole:
            ids = [t for p in sorted(by_sequence[r.sequence_id], key=lambda p: p["offset"]) for t in p["list"]]
            assert np.frombuffer(r.ids, "<u4").tolist() == ids + [7] * (size - len(ids)) and r.n_tokens == len(ids) == sum(r.lengths)
        assert sequence_packing.pack_sequences(none, WORD_BPE, size).count() == 0


@needs_tokenizer
def test_packing_digest(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    few = docs.where("doc_id BETWEEN 30 AND 40")
    ids = {r.doc_id: np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in few.collect()}
    for r in sequence_packing.packing_digest(sequence_packing.pack_sequences(few, WORD_BPE)).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])


# conversations


def by_walk(codes, entry=0, exits=(0, 3), runs=None):
    """Least (cost, audit) by going through the rows, all states at once."""
    best = {entry: (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(4):
            for q, (c, a) in list(best.items()):
                to = conversations.TURN[q]
                best[to] = min(best.get(to, (10**9, "")), (c + 2, a + "I"))
        if i == len(codes):
            break
        after: dict = {}
        for q, (c, a) in best.items():
            for j, p, step, edit in conversations._edges(codes, runs, i, q):
                if j == i + 1:
                    after[p] = min(after.get(p, (10**9, "")), (c + step, a + edit))
        best = after
    return min((best[q] for q in exits if q in best), default=None)


def by_all_audits(codes):
    """Least (cost, audit) of every way to edit, up to a cost."""
    best = []

    def go(i, out, cost, audit, inserted):
        if cost > 12:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", out):
            best.append((cost, audit))
        if inserted < 3:
            for r in "ua":
                go(i, out + r, cost + 2, audit + "I", inserted + 1)
        if i < len(codes):
            go(i + 1, out, cost + 3, audit + "D", 0)
            if codes[i] != "x":
                worse = codes[i].isupper()
                go(i + 1, out + codes[i].lower(), cost + worse, audit + "K", 0)
                for r in "ua":
                    go(i + 1, out + r, cost + 2 + worse, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(best)


def test_search():
    rng = random.Random(3)
    for _ in range(3000):
        codes = "".join(rng.choice(rng.choice(["xsuaoSUAO", "uauaUAxs"])) for _ in range(rng.randrange(10)))
        entry, exits = rng.randrange(4), rng.choice([(0, 3), (0,), (1,), (2,), (3,)])
        runs = tuple(rng.randrange(1, 4) if c == "x" else 1 for c in codes)
        assert conversations.cheapest(codes, entry, exits, runs) == by_walk(codes, entry, exits, runs)
    for n in range(3):
        for codes in itertools.product("xsuaoUA", repeat=n):
            assert conversations.cheapest("".join(codes)) == by_all_audits(codes)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 0:
            continue
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (1 + (deal == 3))
    return out


def plain_repair(rows, convs):
    out = {}
    for conv in convs:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in mine if r[1] is not None]
        codes, blank, dup, trunc, seen = "", 0, 0, 0, []
        for _, _, role, text in mine:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            if not stripped:
                blank, code = blank + 1, "x"
            elif (role, text) in seen:
                dup, code = dup + 1, "x"
            else:
                code = role[0] if role[0] in "sua" else "o"
                if stripped[-1] not in ".!?":
                    trunc, code = trunc + 1, code.upper()
            seen.append((role, text))
            codes += code
        cost, audit = by_walk(codes)
        left, state, texts = iter(mine), 0, []
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[2:]
            if edit == "D":
                continue
            state = {"s": 1, "u": 2, "a": 3}[role[0]] if edit == "K" else conversations.TURN[state]
            texts.append(f"{role if edit == 'K' else {2: 'user', 3: 'assistant'}[state]}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, dup, trunc, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(), texts)
    return out


def talks(seed=2, n=120):
    rng, rows = random.Random(seed), []
    words = ["Yes.", "no", "why?", "  ", "", "so it goes.", "ok!\n", " ", "a\nb.", None]
    for conv in range(n):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, rng.choice(words) if rng.random() < 0.6 else f"t{rng.randrange(10**6)}."))
    rows += [(None, 1, "user", "hi."), (None, None, None, None), (None, 1, "user", "hi."), (n + 1, 0, "user", "x" * 200_000 + ".")]
    return rows


@pytest.mark.parametrize(("limit", "block"), [(4096, 1024), (3, 2), (0, 4)])
def test_repair(spark, limit, block):
    rows = talks()
    rows += [rows[5]] * 7
    df = spark.createDataFrame([(r[3], *r[:3], "x", 1) for r in rows], "text string, conv_id long, turn int, role string, last string, seen int")
    got = conversations.repair(conversations.damaged(df), long_rows=limit, block=block)
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == {c: v[:-1] for c, v in want.items()} and got.count() == len(want)
    if limit < 4096:
        turns = defaultdict(list)
        for r in conversations.repaired_turns(conversations.damaged(df), long_rows=limit, block=block).collect():
            turns[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
        assert {c: [t for _, t in sorted(v)] for c, v in turns.items()} == {c: v[-1] for c, v in want.items() if v[-1]}


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", f"{i}.", f"{i}."])) for i in range(600)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(df, long_rows=50, block=16).collect()}
    assert got == {c: v[:-1] for c, v in plain_repair(rows, {1, 2}).items()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(empty)).count() == 0 and conversations.repaired_turns(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "hi.")], empty.schema)
    assert [tuple(r) for r in conversations.repair(conversations.damaged(one)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql_of_repair(spark, sf):
    import duckdb

    from cairn.llm import queries

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks(7))
    result = con.execute(queries.oracle_sql()["op12_conversations"])
    assert [d[0] for d in result.description] == [f.split()[0] for f in conversations.RESULT.split(", ")]
    assert {r[0]: r[1:] for r in result.fetchall()} == {c: v[:-1] for c, v in plain_repair(plain_damage(talks(7)), {r[0] for r in talks(7)}).items()}
    con.execute(f"CREATE OR REPLACE TABLE conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.oracle_sql()["op12_conversations"]).fetchall()}
    assert {r[0]: tuple(r)[1:] for r in queries.op12_conversations(spark, sf).collect()} == want


# alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_BPE)


def plain_align(libraries, text):
    """Ids, links (indices) and the text of the groups, token by token."""
    a, b = libraries
    if not text:
        return [], [], [], ""
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = {c: i for i, c in enumerate(alignment.byte_letters())}
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, b_ids)]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], ""
    a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
    at = {e: j for j, e in enumerate(b_ends)}
    links = [(i, at[e]) for i, e in enumerate(a_ends) if e in at]
    groups, i, j = [], 0, 0
    for x, y in links:
        groups.append(",".join(map(str, a_ids[i : x + 1])) + "|" + ",".join(map(str, b_ids[j : y + 1])))
        i, j = x + 1, y + 1
    return a_ids, b_ids, links, ";".join(groups)


ODD = ["a ", "a  ", "a \n b", "a\n\n b\n", "\n", " ", "\ta\t b", "a b 　 c", "▁x", "<s>hi</s>", "<|endoftext|> hi", "日本語テキスト", "é ﬁ́", "\x00a", "it's we'll", "x" * 3000, "1234 5678"]


@needs_tokenizer
def test_tokens_equal_the_libraries(libraries):
    pair, rng = alignment.Pair(BYTE_BPE, PIECE_BPE), random.Random(6)
    links = alignment.Links(len(pair.a_bytes), len(pair.b_bytes), pair.linkable())
    texts = ODD + ["".join(rng.choice([" ", "\n", "a", "b1", "é", "\t", "▁", "'s", " ", ".", "日", "ing"]) for _ in range(40)) for _ in range(400)]
    for text, (a, b, a_cuts, b_cuts) in zip(texts, alignment.align_batch(pair, texts), strict=True):
        want = plain_align(libraries, text)
        assert (a.tolist(), b.tolist(), list(zip((a_cuts - 1).tolist(), (b_cuts - 1).tolist(), strict=True)), links.groups_text(a, b, a_cuts, b_cuts)) == want, text
        assert np.array_equal(links.keys[links.pair_numbers(a[a_cuts - 1], b[b_cuts - 1])], a[a_cuts - 1].astype(np.int64) << 32 | b[b_cuts - 1])


def test_lanes_change_nothing():
    rng = np.random.default_rng(2)
    sizes = [(0, 0), (900, 1100), (1, 1), (0, 0), (5, 9)]
    a_ends, b_ends, base = [], [], 0
    for n, m in sizes:
        total = 4 * max(n, m)
        if n:
            a_ends.append(base + np.append(np.sort(rng.choice(np.arange(1, total), n - 1, replace=False)), total))
            b_ends.append(base + np.append(np.sort(rng.choice(np.arange(1, total), m - 1, replace=False)), total))
        base += total
    a_ends, b_ends = np.concatenate(a_ends), np.concatenate(b_ends)
    firsts = [np.cumsum([0, *(s[k] for s in sizes)]) for k in (0, 1)]
    want = sorted(set(a_ends) & set(b_ends))
    for lane in (70, 256, 10**6):
        a, b = alignment.lockstep(a_ends, b_ends, *alignment.lanes(a_ends, b_ends, *firsts, lane))
        assert a_ends[a].tolist() == b_ends[b].tolist() == want


@needs_tokenizer
def test_link_digest(spark, docs, none, libraries):
    more = spark.createDataFrame([(900 + i, t, "en", "s", 1, "k", "c", "n") for i, t in enumerate(ODD)], SCHEMA)
    table = docs.unionByName(more)
    rows = [(r.doc_id, *plain_align(libraries, r.text)) for r in table.collect()]
    counts = Counter((a[i], b[j]) for _, a, b, links, _ in rows for i, j in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for doc_id, a, b, links, groups in rows:
        linked = [counts[a[i], b[j]] for i, j in links]
        best = sum(n == most[b[j]] for n, (_, j) in zip(linked, links, strict=True))
        want[doc_id, len(a), len(b), len(links), len(links), best, sum(linked), hashlib.sha256(groups.encode()).hexdigest() if groups else ""] += 1
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    digest = lambda df: alignment.link_digest(df, BYTE_BPE, PIECE_BPE)
    aligned = {r.doc_id: r for r in alignment.align(more, BYTE_BPE, PIECE_BPE).collect()}
    for doc_id, a, b, links, _ in rows:
        if doc_id in aligned:
            r = aligned[doc_id]
            assert (r.a_ids, r.b_ids, list(zip(r.a_cuts, r.b_cuts, strict=True))) == (a, b, [(i + 1, j + 1) for i, j in links])
    assert Counter(map(tuple, digest(table).select(*columns).collect())) == want
    assert digest(none).count() == 0


# columns of the same names, and missing ids and labels


def test_names_that_the_operators_use(spark):
    from cairn.llm import media, sharding

    rows = [(i, f"t{i}", i, i, i, i, i, i, i, i, i) for i in range(30)] + [(None, None, *[0] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long, _from long, _to long, _slot long, _cell long, _pos long, _rank long, _c long")
    got = sharding.shard_rows(df, "doc_id", 4).collect()
    assert len(got) == 31 and all(r.shard == (r.doc_id or 0) for r in got) and sorted(Counter(r._shard for r in got).values()) == [7, 8, 8, 8]
    m = media.with_media(df).selectExpr("doc_id", "media", "'x' AS codec", "1 AS _t", "2 AS samples")
    out = media.media_columns(m).collect()
    assert {r.codec for r in out} == {"x"} and {r._codec for r in out} == {"raw "} | {r._codec for r in out} and all(r._samples > 0 and r.samples == 2 for r in out)


def test_missing_ids_and_labels(spark):
    from cairn.llm import langid, quality

    docs = spark.createDataFrame([(None, "some words here", None), (1, "more words there", None), (2, None, None)], "doc_id long, text string, lang string")
    assert langid.identified(docs).count() == 3
    assert {r.doc_id: r.held_out for r in langid.predict(docs.withColumn("lang", docs.lang)).collect()}[None] is False
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.held_out for r in quality.score_documents(docs, labels).collect()}[None] is False
