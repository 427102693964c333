"""Alignment of two tokenizers' tokens over the same bytes, by lockstep merging.

Both tokenizers cut the bytes of " " + text. Where a token of A and a token of B end at the same byte they are linked, and the text is cut
there into groups. A batch of documents is merged by one numpy state: for each document the next token of A and of B, all moved one step at
a time; whichever ends first moves on, and both move, with a link and a cut, where they end together. Finished documents leave the state.
A long document enters as several lanes, parted at tokens that end together, so that no document keeps the others waiting.

How often a pair of ids is linked over the whole corpus decides which links are the best of their B id. As the shorter of two linked tokens
is a suffix of the longer, the vocabularies bound the pairs that can ever be linked (some 200,000 for 50,000 and 32,000 ids): counts are a
vector of that length, whatever the size of the corpus, and go back to the tasks as a broadcast.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bpe import byte_letters
from cairn.llm.common import Memo, byte_blocks, gather, saved

#: Tokens of A after which a lane may end, and how many tokens are searched for a place to do so.
LANE, SEARCH = 256, 64
#: What a text is encoded by: neither tokenizer has a token that goes on from another character into a space or a line end, so texts are
#: parted there; white space of other kinds stays inside a part.
CHUNK = re.compile(r"\s*\S*(?:[^\S \n]\s*\S*)*")
#: Bytes that a worker's memo of parts may take, about, and what a part takes besides its text and ids.
MEMO_BYTES, CHUNK_BYTES = 128 << 20, 250
#: Characters of a short part, and how byte-level tokenizers cut words.
SHORT, PATTERN = 1000, r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


class Pair:
    """The two tokenizers, the bytes of their ids, and the pairs of ids that can be linked."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task a core
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        spec = json.load(open(a_path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        special = {t["content"] for t in spec["added_tokens"]}
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        # short parts go through a leaner library with this file's merges; long ones may have runs that it takes squared time for
        self.short = Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_lens, self.b_lens = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.clear()

    @staticmethod
    def _piece(piece: str) -> bytes:
        found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes.fromhex(found[1]) if found else piece.replace("▁", " ").encode()

    def linkable(self) -> np.ndarray:
        """Sorted keys (a, b) of which one's bytes end with the other's."""
        by_bytes: tuple[dict[bytes, list[int]], ...] = ({}, {})
        for side, tokens in zip(by_bytes, (self.a_bytes, self.b_bytes), strict=True):
            for i, t in enumerate(tokens):
                if t:
                    side.setdefault(t, []).append(i)
        a_side, b_side = by_bytes
        keys = {a << 32 | b for t, ids in a_side.items() for k in range(len(t)) for b in b_side.get(t[k:], ()) for a in ids}
        keys |= {a << 32 | b for t, ids in b_side.items() for k in range(len(t)) for a in a_side.get(t[k:], ()) for b in ids}
        return np.array(sorted(keys), np.int64)

    def clear(self) -> None:
        self.memo, self.whole, self.held = Memo(), np.zeros(0, bool), 0
        self.flat = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def encode_chunks(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of parts of " " + text. B's tokenizer puts a space before all it gets: that of the part, or one that goes again."""
        a = [self.short.encode_ordinary(c) if len(c) <= SHORT else self.a.encode(c, add_special_tokens=False).ids for c in chunks]
        b = self.b.encode([c.removeprefix(" ") for c in chunks], num_threads=1)
        space = self.b.piece_to_id("▁")
        for i, c in enumerate(chunks):
            if c == " ":
                b[i] = [space]
            elif c and c[0] != " ":
                if b[i][0] != space:
                    raise ValueError("a token joins a space and a line end")
                b[i] = b[i][1:]
        return a, b

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where a side's bytes differ from the text's. Parts that a worker has met are known."""
        if self.held > MEMO_BYTES:
            self.clear()
        rows = [list(map(self.memo.__getitem__, CHUNK.findall(" " + t))) if t else [] for t in texts]
        if new := self.memo.new:
            sides = self.encode_chunks(new)
            want = [c.encode() for c in new]
            same = np.ones(len(new), bool)
            for side, table in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
                same &= [b"".join(map(table.__getitem__, ids)) == w for ids, w in zip(side, want, strict=True)]
            self.whole = np.concatenate([self.whole, same])
            for k, side in enumerate(sides):
                flat, _, lens = self.flat[k]
                lens = np.concatenate([lens, np.fromiter(map(len, side), np.int64, len(side))])
                self.flat[k] = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(side), np.int32)]), np.cumsum(lens) - lens, lens
                self.held += 4 * sum(map(len, side))
            self.held += sum(map(len, want)) + CHUNK_BYTES * len(want)
            new.clear()
        out, none = [], np.zeros(0, np.int32)
        for row in rows:
            idx = np.fromiter(row, np.int64, len(row))
            out.append(tuple(gather(*side, idx) for side in self.flat) if self.whole[idx].all() else (none, none))
        return out


class Links:
    """What reads aligned tokens without the tokenizers: the pairs of ids that can be linked, and ids as text."""

    def __init__(self, n_a: int, n_b: int, keys: np.ndarray) -> None:
        self.n_a, self.n_b, self.keys = n_a, n_b, keys
        # decimal ids with what follows them in the text of the groups
        self.a_texts, self.b_texts = ([f"{i}{end}" for end in ends for i in range(n)] for ends, n in ((",|", n_a), (",;", n_b)))

    def pair_numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b).astype(np.int32)

    def groups_text(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        if not len(a_cuts):
            return ""
        keys = [a.copy(), b.copy()]
        for k, cuts, n in ((keys[0], a_cuts, self.n_a), (keys[1], b_cuts, self.n_b)):
            k[cuts - 1] += n
        texts = np.empty(len(a) + len(b), object)
        # a token stands after all tokens of its side before it and the other side's in earlier groups (B: in its own, too)
        a_group, b_group = np.repeat(np.arange(len(a_cuts)), np.diff(a_cuts, prepend=0)), np.repeat(np.arange(len(b_cuts)), np.diff(b_cuts, prepend=0))
        texts[np.arange(len(a)) + np.concatenate([[0], b_cuts])[a_group]] = list(map(self.a_texts.__getitem__, keys[0].tolist()))
        texts[np.arange(len(b)) + a_cuts[b_group]] = list(map(self.b_texts.__getitem__, keys[1].tolist()))
        return "".join(texts.tolist())[:-1]


@functools.lru_cache(2)
def pair_of(a_path: str, b_path: str) -> Pair:
    """One per worker process."""
    return Pair(a_path, b_path)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Token ranges (A from, A to, B from, B to) of each lane; documents are parted about every ``lane`` tokens of A where both sides end a token.

    Ends count bytes over the whole batch, so they ascend; ``a_first`` and ``b_first`` are where documents begin, and the number of tokens last.
    """
    spots = np.concatenate([np.arange(i + lane, j - SEARCH, lane) for i, j in zip(a_first[:-1], a_first[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    window = spots[:, None] + np.arange(SEARCH)
    at = np.searchsorted(b_ends, a_ends[window]) if len(spots) else window
    meets = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[window] if len(spots) else window.astype(bool)
    found = meets.argmax(axis=1) if len(spots) else spots
    ok = meets[np.arange(len(spots)), found] if len(spots) else meets
    rows = np.flatnonzero(ok)
    a_cut, b_cut = window[rows, found[rows]] + 1, at[rows, found[rows]] + 1
    a_at, b_at = np.unique(np.concatenate([a_first, a_cut])), np.unique(np.concatenate([b_first, b_cut]))
    return a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A and B that end together, in order; all lanes move at once."""
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    live = (a < a_to) & (b < b_to)
    a, a_to, b, b_to = a[live], a_to[live], b[live], b_to[live]
    while len(a):
        x, y = a_ends[a], b_ends[b]
        met = x == y
        a_cut[a[met]] = True
        b_cut[b[met]] = True
        a, b = a + (x <= y), b + (y <= x)
        live = (a < a_to) & (b < b_to)
        if not live.all():
            a, a_to, b, b_to = a[live], a_to[live], b[live], b_to[live]
    return np.flatnonzero(a_cut), np.flatnonzero(b_cut)


def align_batch(pair: Pair, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of A and of B of each text, and the number of tokens of A and of B up to each cut."""
    tokens = pair.tokens(texts)
    a_first, b_first = (np.cumsum([0, *(len(t[side]) for t in tokens)]) for side in (0, 1))
    a_ids, b_ids = (np.concatenate([t[side] for t in tokens] or [np.zeros(0, np.int32)]) for side in (0, 1))
    a_ends, b_ends = np.cumsum(pair.a_lens[a_ids]), np.cumsum(pair.b_lens[b_ids])
    a_at, b_at = lockstep(a_ends, b_ends, *lanes(a_ends, b_ends, a_first, b_first))
    # both sides of a document end together, so cuts of a document lie between its first and last token on each side
    bounds = np.searchsorted(a_at, a_first)
    for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        yield tokens[k][0], tokens[k][1], a_at[i:j] - a_first[k] + 1, b_at[i:j] - b_first[k] + 1


def aligned_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``ALIGNED``, each of about a block of text, from batches of (doc_id, text)."""
    pair = pair_of(a_path, b_path)
    for batch in batches:
        texts = batch.column(1)
        for i, j in byte_blocks(texts):
            columns = zip(*align_batch(pair, [t or "" for t in texts.slice(i, j - i).to_pylist()]), strict=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c).astype(np.int32))) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, ids of A and B, and the number of tokens of A and B up to each cut (so link k ends token ``a_cuts[k]`` and ``b_cuts[k]``).

    Null and empty texts, and texts that a tokenizer changes, have no tokens. Repeated rows are kept; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: aligned_batches(batches, a_path, b_path), ALIGNED)


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def _arrays(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
    return [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


@functools.lru_cache(2)
def _links_of(n_a: int, n_b: int, keys: bytes) -> Links:
    return Links(n_a, n_b, np.frombuffer(keys, "<i8"))


def _links(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, bytes]) -> Iterator[pa.RecordBatch]:
    pair = _links_of(*sizes)
    for batch in batches:
        n_a, n_b, n, groups, pairs = [], [], [], [], []
        for a, b, a_cuts, b_cuts in zip(*(_arrays(batch.column(i)) for i in range(1, 5)), strict=True):
            n_a.append(len(a))
            n_b.append(len(b))
            n.append(len(a_cuts))
            groups.append(hashlib.sha256(pair.groups_text(a, b, a_cuts, b_cuts).encode()).hexdigest() if len(a_cuts) else "")
            pairs.append(pair.pair_numbers(a[a_cuts - 1], b[b_cuts - 1]).astype("<i4").tobytes())
        counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)]  # each cut is one link, as no token is empty
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(groups, pa.string()), pa.array(pairs, pa.binary())], [f.split()[0] for f in LINKED.split(", ")])


def _pair_counts(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(n_keys, np.int64)
    for batch in batches:
        for pairs in batch.column(0).to_pylist():
            np.add.at(total, np.frombuffer(pairs, "<i4"), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])


def link_digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of documents, from what ``align`` gives for them.

    Both read the same batches; here they stay in the worker that made them, as tokens take several times the room of their text.
    """
    spark = docs.sparkSession
    pair = Pair(a_path, b_path)
    keys = pair.linkable()
    sizes = spark.sparkContext.broadcast((len(pair.a_bytes), len(pair.b_bytes), keys.astype("<i8").tobytes()))
    links = saved(docs.select("doc_id", "text").mapInArrow(lambda batches: _links(aligned_batches(batches, a_path, b_path), sizes.value), LINKED), "links", {"compression": "zstd"})
    counts = links.select("pairs").mapInArrow(lambda batches, n=len(keys): _pair_counts(batches, n), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    total = np.zeros(len(keys), np.int64)
    for batch in counts.toArrow().to_batches():  # a row per pair that the vocabularies allow, at most
        total[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    b = keys & 0xFFFFFFFF
    most = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(most, b, total)
    known = spark.sparkContext.broadcast((total, total == most[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = known.value
        for batch in batches:
            pairs = [np.frombuffer(x, "<i4") for x in batch.column(5).to_pylist()]
            columns = [pa.array([int(best[p].sum()) for p in pairs], pa.int64()), pa.array([int(n[p].sum()) for p in pairs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *columns, batch.column(6)], [f.split()[0] for f in out.split(", ")])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return links.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "groups_sha256").mapInArrow(run, out)
