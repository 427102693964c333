"""Byte-pair encoding by a depth-first walk of a word trie, and decoding.

For merges learned in rank order, an encoding t1 .. tn is the right one exactly if each neighbouring pair encodes to itself. So the
last token of a prefix is the one suffix of it that is a token and is compatible with the last token of the prefix before that suffix.
That state depends on the prefix alone: words go into a trie, and a depth-first walk computes the state of each node once for all words
that share it. Sorted words are the trie in preorder; the stack of states is cut back to the common prefix between neighbours.

Texts are split at ASCII white space, at special tokens and by the tokenizer's own pattern; each distinct chunk is encoded once per
worker. Any text encodes as the tokenizers library does without special tokens added.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairn.llm.common import Memo, byte_blocks, claim, gather, give_back, rested

#: Bytes that a worker's memo of chunks may take, about; beyond, it starts afresh (encodings stay the same).
MEMO_BYTES = 128 << 20
#: What a chunk of the memo takes besides its bytes and ids; the words, and the pairs of tokens, that an encoder keeps beside the memo.
CHUNK_BYTES, KNOWN_WORDS, KNOWN_PAIRS = 250, 300_000, 300_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next free one from U+0100 on."""
    out, free = [], itertools.count(256)
    for b in range(256):
        out.append(chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(free)))
    return out


class WordBpe:
    """A ``tokenizers`` file of BPE with word ends: NFC, lower case, pattern split, byte letters."""

    known_words, known_pairs = KNOWN_WORDS, KNOWN_PAIRS

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split_re = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.line_re = regex.compile(self.split_re.pattern + r"|\n")
        letters = byte_letters()
        vocab = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.first = [vocab[x] for x in letters]  # the id of a byte inside a word, and at its end
        self.last = [vocab[x + self.end] for x in letters]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        parts: dict[int, tuple[int, ...]] = {i: (i,) for i in self.first + self.last}
        for (a, b), (_, whole) in self.merges.items():
            parts.setdefault(whole, parts[a] + parts[b])
        self.parts = parts
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, whole) in self.merges.items():
            self.halves.setdefault(whole, (a, b, rank))
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, list[int]] = {}
        # tokens by their symbols read backwards
        self.back: dict = {}
        for token, symbols in parts.items():
            if self.plain(symbols) != [token]:
                continue  # merges never make it
            node = self.back
            for s in reversed(symbols):
                node = node.setdefault(s, {})
            node[-1] = token

    def plain(self, symbols: tuple[int, ...]) -> list[int]:
        """Merging by rank, as BPE is defined; to see which tokens merges make, and for tests."""
        ids = list(symbols)
        while len(ids) > 1:
            found = min(((self.merges[p], i) for i, p in enumerate(itertools.pairwise(ids)) if p in self.merges), default=None)
            if not found:
                break
            (_, whole), i = found
            ids[i : i + 2] = [whole]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge joins pieces at their border while both stand there."""
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            merges = self.merges
            ok = self.pairs[key] = not any(m and m[0] < p_end and m[0] <= q_end for p, p_end in self.edge(a, 1) for q, q_end in self.edge(b, 0) if (m := merges.get((p, q))))
        return ok

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the token's left (0) or right (1) edge while it is built, with the rank of the merge that ends each piece."""
        out = self.edges[side].get(token)
        if out is None:
            out, end, at = [], float("inf"), token
            while True:
                out.append((at, end))
                if at not in self.halves:
                    break
                a, b, end = self.halves[at]
                at = b if side else a
            self.edges[side][token] = out
        return out

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct non-empty words (UTF-8), each trie node visited once."""
        first, last, back, pairs, fits = self.first, self.last, self.back, self.pairs, self.fits
        out: dict[bytes, list[int]] = {}
        symbols: list[int] = []  # of the path to the current node
        token: list[int] = [-1]  # last token at each depth, and where it starts
        start: list[int] = [0]
        before = b""

        def step(symbol: int) -> None:
            symbols.append(symbol)
            i, node, found = len(symbols), back, []
            for i in range(i - 1, -1, -1):
                node = node.get(symbols[i])
                if node is None:
                    break
                if -1 in node:
                    found.append((i, node[-1]))
            for i, t in reversed(found):
                if i:
                    key = token[i] << 20 | t
                    ok = pairs.get(key)
                    if ok is None:
                        ok = fits(token[i], t)
                    if not ok:
                        continue
                token.append(t)
                start.append(i)
                return
            raise ValueError("no token fits")

        for word in sorted(words):
            n, same = len(word) - 1, 0  # the inner symbols; the last one carries the word end
            limit = min(n, len(before) - 1)
            while same < limit and word[same] == before[same]:
                same += 1
            del symbols[same:], token[same + 1 :], start[same + 1 :]
            for b in word[same:n]:
                step(first[b])
            step(last[word[n]])
            ids, at = [], n + 1
            while at:
                ids.append(token[at])
                at = start[at]
            ids.reverse()
            out[word] = ids
            symbols.pop(), token.pop(), start.pop()
            before = word
        return out

    def _plain(self, text: str) -> str:
        """Normalised text: NFC and lower case, letter by letter."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk without ASCII white space; special tokens as ids."""
        out: list[str | int] = []
        for part in self.special_re.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.split_re.findall(self._plain(part))
        return out

    def split_chunks(self, chunks: list[bytes]) -> list[list[str | int]]:
        """``words`` of many chunks in one pass: line ends, which no chunk has, part them."""
        out: list[list[str | int]] = [[]]
        for found in self.line_re.findall(self._plain(b"\n".join(chunks).decode())):
            if found == "\n":
                out.append([])
            else:
                out[-1].append(found)
        if len(out) != len(chunks):
            raise ValueError("a chunk holds a line end")
        for i, c in enumerate(chunks):
            if b"<|" in c:
                out[i] = self.words(c.decode())
        return out

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk; words that are new are encoded together."""
        split = self.split_chunks(chunks)
        known = self.known
        new = {w for ws in split for w in ws if w not in known and isinstance(w, str)}
        known.update(self.encode_new(new))
        out = [known[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [i for w in ws for i in (known[w] if isinstance(w, str) else (w,))] for ws in split]
        if len(known) > self.known_words:
            known.clear()
        if len(self.pairs) > self.known_pairs:
            self.pairs.clear()
            self.edges = ({}, {})
        return out

    def encode_new(self, words: set[str]) -> dict[str, list[int]]:
        return {word.decode(): ids for word, ids in self.encode_words([w.encode() for w in words]).items()}

    def decode_ids(self, ids) -> str:
        """Token strings joined by spaces: what a tokenizer file without a decoder gives."""
        return " ".join([self.text[i] for i in ids])


class ChunkEncoder:
    """Encodes batches of texts through a memo of chunks with bounded size."""

    def __init__(self, encode_chunks, text_of=None, memo_bytes: int = MEMO_BYTES) -> None:
        self.encode_chunks, self.text_of, self.memo_bytes = encode_chunks, text_of, memo_bytes
        # the memo is large, lives long and has no cycles: walking it for cycles again and again costs a fifth of the time
        gc.set_threshold(200_000, 50, 1000)
        self.clear()

    def clear(self) -> None:
        self.memo, self.strings, self.held = Memo(), [], 0
        self.ids, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """(ids, decoded UTF-8) of each row; null is empty."""
        for a, b in byte_blocks(texts):
            rows = [list(map(self.memo.__getitem__, (t or b"").split())) for t in texts.slice(a, b - a).cast(pa.binary()).to_pylist()]
            if self.memo.new:
                lists = self.encode_chunks(self.memo.new)
                self.held += sum(map(len, self.memo.new)) + 8 * sum(map(len, lists)) + CHUNK_BYTES * len(lists)
                self.memo.new.clear()
                self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), np.int32)])
                self.lens = np.concatenate([self.lens, np.fromiter(map(len, lists), np.int64, len(lists))])
                self.starts = np.cumsum(self.lens) - self.lens
                if self.text_of:
                    self.strings += [" ".join(map(self.text_of.__getitem__, x)).encode() for x in lists]
            for row in rows:
                idx = np.fromiter(row, np.int64, len(row))
                decoded = b""
                if self.text_of:
                    decoded = b" ".join([s for s in map(self.strings.__getitem__, row) if s])
                yield gather(self.ids, self.starts, self.lens, idx), decoded
            if self.held > self.memo_bytes:
                self.clear()


@functools.lru_cache(2)
def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> ChunkEncoder:
    """One per worker process and vocabulary."""
    bpe = WordBpe(path)
    # words and pairs take about as much as the memo does: a small memo has few of them
    bpe.known_words, bpe.known_pairs = min(KNOWN_WORDS, memo_bytes // 400), min(KNOWN_PAIRS, memo_bytes // 400)
    give_back()
    return ChunkEncoder(bpe.encode_chunks, bpe.text, memo_bytes)


def encode_decode(docs: DataFrame, path: str, memo_bytes: int = MEMO_BYTES, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids; equal texts get equal rows, repeated rows are kept; other columns are not read. ``keep`` says whether a worker's vocabulary and
    memo (of about ``memo_bytes``) outlive a task: where workers serve other operators too, those that stand idle would hold them for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, memo_bytes)
        claim(f"bpe {path}", encoder.cache_clear if keep else None)  # tasks of this stage share the memo; the worker's next operator drops it
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for ids, text in enc.texts(batch.column(1)):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            if not keep:
                give_back()
        if not keep:
            encoder.cache_clear()

    return docs.select("doc_id", "text").mapInArrow(run if keep else rested(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the operator's real output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = zip(*((x.tolist(), t.decode()) for x, t in enc.texts(batch.column(1))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
