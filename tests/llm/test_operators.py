"""Operators on Spark against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import binascii
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, components, decontam, html, langid, line_dedup, media, ngram_join, packing, quality, sharding
from cairn.llm.queries import WORD_BPE
from tests.llm.test_kernels import PAGE, plain_set, words

needs_tokenizer = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no vocabulary")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cls string, name string"


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, base = [], make(120)
    for i in range(60):
        w = base[:] if i < 20 else make(rng.randrange(1, 200))
        for _ in range(i % 4 if i < 20 else 0):
            w[rng.randrange(len(w))] = f"new{i}"
        text = "\n".join(" ".join(w[j : j + 17]) for j in range(0, len(w), 17))
        rows.append((i, text, rng.choice(["en", "fr", None])))
    rows += [(60, None, "en"), (61, "", "en"), (62, "  \n ", None), (63, "one two", "fr"), (64, "One TWO", "fr"), (65, rows[3][1], "en"), (66, " ".join(make(30_000)), "en"), (67, "a\n\na\nb", "en"), (3, rows[3][1], "en")]
    return [(i, t, la, "src", len(t or ""), "k", "c", "n") for i, t, la in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows):
    sets = {i: plain_set(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i, *_ in rows)


def test_ngram_join(docs, none):
    assert sorted(map(tuple, ngram_join.near_components(docs).collect())) == brute_components(corpus())
    assert ngram_join.near_components(none).count() == 0
    kept = ngram_join.one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(corpus())})
    assert ngram_join.one_per_component(none).count() == 0


def test_ngram_join_of_repeated_and_missing_ids(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(80)]
    near, junk = " ".join([*base[:-1], "else"]), " ".join(f"j{i}" for i in range(70))
    rows = [(1, " ".join(base)), (1, junk), (2, near), (None, junk), (None, "lone words of no other text at all"), (None, None), (7, ""), (7, "")]
    for _ in range(3):
        rng.shuffle(rows)
        frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, first_id int, comp string").repartition(3)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(frame).collect()}
        assert got == {(1, 76, 1), (1, 66, 1), (2, 76, 1), (None, 66, 1), (None, 4, None), (None, 0, None), (7, 0, 7)}
        kept = ngram_join.one_per_component(frame)
        assert kept.columns == frame.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, " ".join(base)), (1, junk), (0, "lone words of no other text at all"), (0, ""), (7, ""), (7, "")])


def test_line_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    words_ = [f"w{rng.randrange(900)}" for _ in range(60)]
    line, near = " ".join(words_), " ".join([*words_[:-1], "else"])
    license_ = "the same license line stands in a third of all the documents here"
    rows = [(1, line), (1, "other\n" + license_), (2, near + "\nlast"), (None, license_), (None, near), (3, None)] + [(10 + i, f"own line {i} of its text\n{license_}") for i in range(40)]
    want = None
    for _ in range(2):
        rng.shuffle(rows)
        frame = spark.createDataFrame([(i, t, 9, "x", 1) for i, t in rows], "doc_id long, text string, n_lines int, gone_lines string, toks int").repartition(3)
        got = sorted(((r.doc_id or 0), r.text or "", r.n_lines, r.n_removed, r.gone_lines) for r in line_dedup.dedup_lines(frame).collect())
        assert want is None or got == want
        want = got
    removed = {(i, t): n for i, t, _, n, _ in want}
    assert len(want) == len(rows) and sum(removed.values()) == 43 and removed[0, license_] + removed[0, near] == 0 and removed[2, "last"] == 1


def brute_lines(rows):
    seen, gone = [], set()
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}):
        for no, line in enumerate(t.split("\n")):
            s = plain_set(line)
            if s:
                if any(4 * len(s & o) >= 3 * len(s | o) for o in seen):
                    gone.add((i, no))
                seen.append(s)
    return gone


def test_line_dedup(docs, none):
    gone = brute_lines(corpus())
    assert {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(docs).collect()} == gone
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    want = set()
    for i, t, *_ in corpus():
        lines = t.split("\n") if t is not None else []
        out = "\n".join(x for no, x in enumerate(lines) if (i, no) not in gone) if t is not None else None
        want.add((i, out, len(lines), sum((i, no) in gone for no in range(len(lines)))))
    assert got == want and line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(none).columns == [*none.columns, "n_lines", "n_removed"] and line_dedup.dedup_lines(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 7).collect()
    n = Counter(r.shard for r in got)
    assert len(got) == docs.count() and set(n) <= set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    texts = dict((i, t) for i, t, *_ in corpus())
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_documents(docs.repartition(5), 7).collect()))
    assert sharding.shard_documents(none).count() == 0 and len(sharding.shard_documents(docs.limit(3), 40).collect()) == 3


@needs_tokenizer
def test_bpe(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    texts = dict((i, t) for i, t, *_ in corpus())
    got = bpe.encode_decode(docs, WORD_BPE).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.encode_decode(none, WORD_BPE).count() == 0 and bpe.encode_texts(docs.limit(2), WORD_BPE).count() == 2


@needs_tokenizer
def test_packing(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    out = str(tmp_path / "packed")
    packing.write_packed(docs, out, WORD_BPE, 49_408, shards=4)
    got = sorted(map(tuple, packing.token_digest(spark, out).collect()), key=lambda r: r[1])
    at = 0
    assert [r[0] for r in got] == sorted(r[0] for r in corpus())
    texts = dict((i, t) for i, t, *_ in corpus())
    for doc_id, start, n, crc in got:
        ids = [*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        assert (start, n, crc) == (at, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert packing.read_document(spark, out, 63) == [[*tok.encode("one two").ids, 1]] and len(packing.read_document(spark, out, 3)) == 2
    assert packing.pack_documents(none, WORD_BPE, 49_408).count() == 0


def test_hostile_media(spark):
    import struct

    good = media.write_container(bytes(range(192)) * 30)
    at, chunks = good.index(b"stsz") + 8, good.index(b"stsc") + 12
    many = good[: at + 4] + struct.pack(">I", 2**32 - 1) + good[at + 8 :]
    runs = good[: chunks + 4] + struct.pack(">I", 2**32 - 1) + good[chunks + 8 :]
    for data in (many, runs, many[: chunks + 4] + struct.pack(">I", 2**32 - 1) + many[chunks + 8 :]):
        (track,) = media.probe(data)
        assert track["samples"] <= len(data) // 192 and media.read_payload(data, track)[:192] == bytes(range(192))
    rows = [(1, 5, None), (2, 5, b"not a container"), (3, 5, b""), (4, 5760, good)]
    got = {r.doc_id: r for r in media.media_digest(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(got[i].payload_bytes == 0 and got[i].payload_sha256 is None and got[i].feature == "null" for i in (1, 2, 3)) and got[4].payload_bytes == 5760


def test_media(docs, none):
    got = media.media_digest(media.with_media(docs)).collect()
    texts = dict((i, t) for i, t, *_ in corpus())
    for r in got:
        n, payload = media.text_payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len(got) == docs.count() and media.media_digest(media.with_media(none)).count() == 0
    assert media.media_columns(media.with_media(docs.limit(2))).where("codec = 'raw '").count() == 2


def test_decontamination(spark, docs, none):
    texts = dict((i, t) for i, t, *_ in corpus())
    items = [(1, " ".join(texts[30].split()[10:40]) if len(texts[30].split()) > 40 else "q"), (2, " ".join(texts[66].split()[25_000:25_060])), (3, "not anywhere in these texts at all"), (4, None), (5, ""), (6, "one two"), (7, texts[0][:200].upper()), (7, texts[0][:200]), (8, " ".join(texts[40].split()[3:6])), (9, " ".join(texts[66].split()[900:904])), (10, "w1"), (11, "w1 nowhere")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, *_ in corpus():
        for j, x in items:
            n = min(5, len((x or "").split()))
            a, b = plain_set(x, n), plain_set(t, n)
            if a and len(a & b) >= 0.75 * len(a):
                want[i, j, len(a & b), len(a)] += 1
    got = decontam.contained_items(docs, bench)
    assert Counter((r.doc_id, r.item_id, r.shared, r.n_item) for r in got.collect()) == want and want
    assert decontam.contained_items(none, bench).count() == 0 and decontam.contained_items(docs, bench.limit(0)).count() == 0
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(texts) - {i for i, *_ in want}
    # one id on two texts, and no id: each row by its own text
    rows = [(None, "a b c d e f"), (1, "x y"), (1, "z a b c d e f"), (None, None)]
    clean = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "B c d e F")], "item_id long, text string"))
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in spark.createDataFrame([rows[1], rows[3]], "doc_id long, text string").collect())


def test_long_items_are_found(spark, docs):
    texts = dict((i, t) for i, t, *_ in corpus())
    w = texts[66].split()[1000:6000]
    for i in range(0, 5000, 200):
        w[i] = "changed"
    got = decontam.contained_items(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == [66] and got[0].shared == len(plain_set(" ".join(w)) & plain_set(texts[66]))


def letters(lang, rng, n):
    parts = {"en": ["th", "ing", "er", "on"], "fr": ["eau", "que", "é", "oi"], "de": ["sch", "ung", "ß", "ei"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark, none):
    rng = random.Random(1)
    rows = [(i, letters(la := ("en", "fr", "de")[i % 3], rng, rng.randrange(3, 60)), la) for i in range(240)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34!", "fr"), (903, letters("en", rng, 5), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    known = {i: la for i, t, la in rows if la and t and any(map(str.isalpha, t))}
    assert np.mean([got[i].lang_pred == la for i, la in known.items()]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902)) and got[903].lang_pred == "en"
    assert langid.predict(none.select("doc_id", "text", "lang")).count() == 0
    assert {r.doc_id for r in langid.identified(d).collect()} >= set(known) - {i for i in known if got[i].rejected}
    unlabelled = langid.predict(d.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]


def test_quality(spark, none):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        rows.append((i, letters("en", rng, 80).capitalize() + "." if good else " ".join([rng.choice(["BUY!!", "WIN$$$", "zz"])] * 60)))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, rows[0][1])]
    labels += [(901, None, 0), (900, 7, 0)]
    d, la = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_documents(d, la).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(got[i].held_out for i in held) and np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) > 0.97
    assert got[902].score == got[0].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert {r.score for r in quality.score_documents(d, la.limit(0)).collect()} == {0.5}
    assert quality.score_documents(none, la).count() == 0


def test_pages(spark):
    rows = [(i, "http://x", PAGE.replace("First", f"First {i}" + " word" * i)) for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", "<html></html>"), (1, "http://x", PAGE)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if 1 < r.page_id < 40:
            assert r.text == f"Head & line\nFirst {r.page_id}{' word' * r.page_id} para with tags.\nSecond <one>."
        assert r.n_chars == len(r.text) and (r.page_id < 50 or r.text == "")
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words():
    assert words("A\x1cb C") == ["a\x1cb", "c"]


def test_html_of_odd_pages(spark):
    words_ = "One two three four five six seven eight nine ten, eleven words of running text."
    page = lambda body: f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<footer>Contact us</footer></body></html>"
    named = [page(f'<article><p>{words_} {i}</p><p>More of it, {words_} {i}</p></article><aside class="ad">Buy {i} now</aside>') for i in range(60)]
    odd = [
        (page(f"""<article><p class="a"">{words_}</p><p id="x" title=don't>Next, {words_}</p></article>"""), f"{words_}\nNext, {words_}"),
        (page("<article>" + "<div>" * 500 + f"<script>var secret=1;</script><p>{words_}</p><p>Next, {words_}</p>" + "</div>" * 500 + f"<p>Last, {words_}</p></article>"), f"{words_}\nNext, {words_}\nLast, {words_}"),
        (page(f"<!-- <p>hidden</p> --><div><div><p>{words_}</p><p>Next, {words_}</p></div></div>"), f"{words_}\nNext, {words_}"),
        (None, ""), ("", ""), ("   ", ""), ("<p", ""),
    ]
    rows = [(i, "u", h) for i, h in enumerate([h for h, _ in odd] + named + [None] * 3000)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows) and [got[i].text for i in range(len(odd))] == [t for _, t in odd]
    assert all(got[len(odd) + i].text == f"{words_} {i}\nMore of it, {words_} {i}" for i in range(60)) and all(r.n_chars == len(r.text) for r in got.values())


def test_html_without_named_parts(spark):
    words_ = "One two three four five six seven eight nine ten, eleven words of running text."
    rows = [(i, "u", f"<div><ul><li><a href='/{j}'>Go</a></li></ul></div><div><p>{words_} {i}</p><p>More of it, {words_}</p></div>") for i in range(50) for j in (0,)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"{words_} {r.page_id}" in r.text and "More of it" in r.text and "Go" not in r.text.split() for r in got)


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(4)
    root = html.parse("<div><p>aa bb</p><div><p>cc</p><ul><li>dd ee</li><li>f</li></ul></div></div>")
    nodes = html.elements(root)
    parents = [next((j for j, y in enumerate(nodes) if y is x.parent), -1) for x in nodes]
    weight = [html.own_text(x) + 0.05 * (sum(isinstance(y, html.Node) for y in x.items) != 1) for x in nodes]
    for _ in range(200):
        odds = rng.normal(size=len(nodes))
        gain = [(odds[i] + html.AGREE * (odds[parents[i]] if parents[i] >= 0 else 0)) * weight[i] for i in range(len(nodes))]
        best = max(sum(g for i, g in enumerate(gain) if m >> i & 1) for m in range(1 << len(nodes)) if all(parents[i] < 0 or m >> parents[i] & 1 for i in range(len(nodes)) if m >> i & 1))
        kept = html.decode(nodes, odds)
        assert abs(sum(g for x, g in zip(nodes, gain, strict=True) if id(x) in kept) - best) < 1e-9
        assert all(parents[i] < 0 or id(nodes[parents[i]]) in kept for i, x in enumerate(nodes) if id(x) in kept)
