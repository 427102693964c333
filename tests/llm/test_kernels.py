"""Kernels against plain definitions: shingles, sketches, BPE, packing, containers, models, HTML."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import bpe, common, decontam, html, langid, media, ngram_join, packing, quality, sharding, shingles
from cairn.llm.queries import WORD_BPE

TEXTS = ["", None, " \n\t", "one", "a b c d", "A b C d E", "a b c d e f a b c d e f", "é" * 50, "x " * 3000, "tab\tand\x0bvt\x0cff\rcr", "no break space", "İ ẞ ﬁ", "\x1c odd \x1f controls"]
needs_tokenizer = pytest.mark.skipif(not os.path.exists(WORD_BPE), reason="no vocabulary")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingle_sets():
    got = list(shingles.shingle_sets(pa.array(TEXTS)))
    assert [len(x) for x in got] == [len(plain_set(t)) for t in TEXTS]
    two = list(shingles.shingle_sets(pa.array(["A b c d e", "zz", "a B c d E", "zz yy"])))
    assert two[0].tolist() == two[2].tolist() and two[1].tolist() != two[3].tolist()
    sliced = pa.array(["skip this row now please ok", *TEXTS]).slice(1)
    assert [x.tolist() for x in shingles.shingle_sets(sliced)] == [x.tolist() for x in got]


def test_sketch_keys_lose_no_link():
    rng = np.random.default_rng(1)
    for n in [3, 4, 5, 7, 8, 15, 16, 17, 31, 33, 60, 64, 100, 127, 128, 200, 300, 1000]:
        for _ in range(40):
            base = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            b = np.unique(base)
            gone, new = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 3 + 1))
            a = np.unique(np.concatenate([b[gone:], rng.integers(0, 2**63, new, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            if a.tolist() != b.tolist() and 100 * both >= 75 * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join.keys_of(a), ngram_join.keys_of(b)).size, (n, gone, new)


def test_different_sets_share_no_key():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(60)]
    keys = [set(ngram_join.keys_of(s).tolist()) for s in sets]
    assert sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i]) == 0


@needs_tokenizer
def test_bpe_is_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    tok.no_truncation(), tok.no_padding()
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdeéß' .,0½日Σς<|>́") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    texts = [*TEXTS, "don't WE'LL 12,000 😀👍🏽", "x<|endoftext|>y <|startoftext|>", "Σίσυφος ΣΑΣ", "antidisestablishmentarianism", "a" * 300, *made]
    model = bpe.WordBpe(WORD_BPE)
    for i in range(2):
        got = list(bpe.ChunkEncoder(model.encode_chunks, model.text).texts(pa.array(texts)))
        for t, (ids, decoded) in zip(texts, got, strict=True):
            want = tok.encode(t or "", add_special_tokens=False).ids
            assert ids.tolist() == want, t
            assert decoded.decode() == tok.decode(want, skip_special_tokens=False)


@needs_tokenizer
def test_small_memo_encodes_alike():
    """A memo that starts afresh after every block, with few words and pairs kept, changes nothing."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    tok.no_truncation(), tok.no_padding()
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé.,0") for _ in range(rng.randrange(1, 12))) for _ in range(400)) for _ in range(30)] * 2
    small = bpe.encoder(WORD_BPE, 1 << 12)
    model = small.encode_chunks.__self__
    assert model.known_words == model.known_pairs == 10
    for batch in (texts[:20], texts[20:], texts[:5]):
        for t, (ids, _) in zip(batch, small.texts(pa.array(batch)), strict=True):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert not model.known and not small.memo and not small.held
    whole = bpe.WordBpe(WORD_BPE)
    assert whole.known_words == bpe.KNOWN_WORDS
    bpe.encoder.cache_clear()


def test_rested_passes_all_batches():
    ended = []

    def run(batches):
        for b in batches:
            yield b.slice(0, 1)
        ended.append(True)

    batches = [pa.RecordBatch.from_pydict({"x": [i, i + 1]}) for i in range(3)]
    assert [b.column(0).to_pylist() for b in common.rested(run)(iter(batches))] == [[0], [1], [2]] and ended == [True]
    assert list(common.rested(run)(iter([]))) == []


@needs_tokenizer
def test_trie_walk_is_plain_merging():
    model = bpe.WordBpe(WORD_BPE)
    for word, ids in model.encode_words([b"lower", b"lowest", b"low", b"unbelievable", "naïve".encode(), b"zzzzzzzz"]).items():
        assert ids == model.plain(tuple([model.first[b] for b in word[:-1]] + [model.last[word[-1]]]))


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 20, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001)
    data = packing.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert packing.unpack(data, bits, 0, 1001).tolist() == ids.tolist()
    assert packing.unpack(data, bits, 500, 77).tolist() == ids[500:577].tolist() and len(packing.unpack(data, bits, 5, 0)) == 0


def test_bits():
    assert [packing.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        packing.pack(np.array([4]), 2)


@pytest.mark.parametrize("text", [None, "", "a" * 191, "a" * 192, "a" * 193, "é" * 5000])
def test_container_round_trip(text):
    n, payload = media.text_payload(text)
    data = media.write_container(payload)
    (track,) = media.probe(data)
    assert n == len((text or "").encode()) and len(payload) % 192 == 0 and payload.rstrip(b" ") == (text or "").encode()
    assert media.read_payload(data, track) == payload
    assert (track["codec"], track["handler"], track["samples"]) == ("raw ", "soun", len(payload) // 192)
    assert track["duration"] == track["ticks"] == len(payload)
    assert all(payload[192 * 10 * i :][:192] == data[a:b] for i, (a, b) in enumerate(track["keyframes"]))


def test_foreign_and_broken_containers():
    good = media.write_container(b"x" * 384)
    assert media.probe(None) == media.probe(b"") == media.probe(b"not a container") == []
    for cut in range(0, len(good), 7):
        media.probe(good[:cut])
    large = good.replace(b"mdat", b"free", 1)
    assert media.probe(large)[0]["samples"] == 2
    wide = media.box(b"stbl", media.full(b"stsz", (0).to_bytes(4, "big"), (2).to_bytes(4, "big"), (5).to_bytes(4, "big"), (7).to_bytes(4, "big")), media.full(b"co64", (1).to_bytes(4, "big"), (9).to_bytes(8, "big")), media.full(b"stsc", b"".join(v.to_bytes(4, "big") for v in (1, 1, 2, 1))))
    t = media.probe(media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", wide)))))[0]
    assert t["starts"].tolist() == [9, 14] and t["sizes"].tolist() == [5, 7]


def test_ring_walk_is_row_by_row():
    ring = sharding.place_vnodes([(i % 5, i * 7919) for i in range(40)], 1000)
    counts = {c: (c * 31) % 7 for c in range(0, 1000, 3)}
    got = {}
    for cell, a, b, shard, slot in sharding.allot(counts, ring, 5):
        for r in range(a, b + 1):
            got[cell, r] = (shard, slot + r - a)
    keys = [(c, r) for c in sorted(counts) for r in range(counts[c])]
    room, used, want, over = [len(keys) // 5 + (s < len(keys) % 5) for s in range(5)], [0] * 5, {}, []
    node = {c: next((i for i, (x, _) in enumerate(ring) if x >= c), 0) for c in counts}
    for k in keys:
        s = ring[node[k[0]]][1]
        if used[s] < room[s]:
            want[k] = (s, used[s])
            used[s] += 1
        else:
            over.append(k)
    for k in over:
        i = node[k[0]]
        while used[ring[i][1]] >= room[ring[i][1]]:
            i = (i + 1) % len(ring)
        want[k] = (ring[i][1], used[ring[i][1]])
        used[ring[i][1]] += 1
    assert got == want


def test_ring_moves_little():
    def owner(shards):
        ring = sharding.place_vnodes([(i // 100, hash((i, 17)) & 0xFFFFFF) for i in range(shards * 100)], 1 << 16)
        return {(c, r): s for c, a, b, s, _ in sharding.allot({c: 1 for c in range(1 << 16)}, ring, shards) for r in range(a, b + 1)}

    a, b = owner(20), owner(21)
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35  # a modulo would move 20 of 21


def test_features_of_odd_texts():
    for t in TEXTS:
        (x,) = quality.features(pa.array([t], pa.string()))
        assert x.shape == (1, len(quality.FEATURES)) and np.isfinite(x).all()
    a = np.concatenate(list(quality.features(pa.array(TEXTS))))
    b = np.concatenate([next(quality.features(pa.array([t], pa.string()))) for t in TEXTS])
    assert np.allclose(a, b)


def test_kneser_ney_sums_to_one():
    import pandas as pd

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 3), pa.array(["abab abc", "bca aab", "cab"])], ["lang", "text"])
    rows = pd.concat([b.to_pandas() for b in langid._count(iter([batch]))]).groupby(["lang", "n", "gram", "context", "suffix"], as_index=False)["times"].sum()
    model = langid.Model(["a"], *langid._smooth(rows, ["a"]), np.array([np.inf]))
    for prefix in ("", "a", "ab", "bc", "caa"):
        bits = lambda w: model.score_words([w])[0][0, 0]
        # the next letter or the end, after any prefix
        total = 0.0
        whole = model.score_words([prefix + "x"])[0]
        assert np.isfinite(whole).all()
        for c in "abc":
            full_word = bits(prefix + c)
            total += 2 ** -(full_word - _end_bits(model, prefix + c) - _body_bits(model, prefix))
        total += 2 ** -_end_bits(model, prefix) if prefix else 0.0
        assert (0.9 if prefix else 0.75) < total < 1.01, (prefix, total)


def _per_position(model, word):
    _, gram, _ = langid.grams([word])
    context = langid.contexts([word])
    p = np.full(len(word) + 2, langid.FLOOR)
    for n in range(langid.ORDER):
        if n:
            at, ok = langid._find(model.context_keys[n], context[n])
            p *= np.where(ok, model.weights[n][at, 0], 1.0)
        at, ok = langid._find(model.keys[n], gram[n])
        p += np.where(ok, model.probs[n][at, 0], 0.0)
    return -np.log2(np.clip(p, langid.FLOOR, 1))[1:]


def _end_bits(model, word):
    return _per_position(model, word)[-1]


def _body_bits(model, word):
    return _per_position(model, word)[:-1].sum()


def test_words_of():
    assert langid.words_of(b"Hello") == ["hello"] and langid.words_of("l'Été42x".encode()) == ["l", "été", "x"] and langid.words_of(b"123") == [] and langid.words_of("́".encode()) == []


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More of it</a></li></ul></nav><div class="ad">Buy it now</div><article><h1>Head &amp; line</h1><p><b>First  para\n with <i>tags</i>.<br><p>Second &lt;one&gt;.</p><form><input><p>Join us</p></form></article><footer>&copy; site</footer>'


@pytest.fixture(scope="module")
def trees():
    xs, ys = [], []
    for i in range(30):
        for page in html.variants(PAGE.replace("First", f"First {i} " + "word " * (i * 5)).replace("Buy", "Buy " * (i % 4 + 1))):
            nodes = html.elements(html.parse(page))
            xs.append(html.describe(nodes)), ys.append(html.weak_labels(nodes))
    return html.Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def test_html(trees):
    assert html.extract(PAGE, trees) == "Head & line\nFirst para with tags.\nSecond <one>."
    for page in (None, "", "   ", "<", "<p", "plain", "<div>" * 3000, "<!-- open", '<a href="x', "</p></div>"):
        assert isinstance(html.extract(page, trees), str)


def test_decoding_keeps_parents(trees):
    nodes = html.elements(html.parse(PAGE))
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html.decode(nodes, rng.normal(size=len(nodes)))
        for x in nodes:
            if id(x) in kept and x.parent:
                up = x.parent
                while id(up) not in {id(n) for n in nodes}:
                    up = up.parent
                assert id(up) in kept


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = html.Boosted(60, 3, 0.3).fit(x[:1000], y[:1000])
    assert (((m.log_odds(x[1000:]) > 0) == y[1000:]).mean()) > 0.95


def test_sketch_size_is_safe():
    for n in range(1, 3000, 7):
        k, missing = decontam.sketch_size(n), n - int(np.ceil(0.75 * n))
        assert k <= n and (k == n or k - missing >= decontam.HITS) and k > missing
