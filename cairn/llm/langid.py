"""Language identification by interpolated Kneser-Ney character models.

A model of order 4 per language scores the letters of lower-cased words, each word between boundary marks. All languages share one
sorted array of 64-bit n-gram hashes with a column of probabilities each, and one of context hashes with a column of interpolation
weights each; a lookup is a binary search. The language with the lowest cross-entropy per letter wins; ``rejected`` marks texts whose
cross-entropy is above that language's calibrated limit, and texts without letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Memo, bucket_of, byte_blocks, claim, dropped, rested, saved
from cairn.llm.shingles import mix

ORDER = 4
#: Documents per language that a model is fitted on, at most about: a bounded sample of the labelled rows, drawn by hash of the id.
FIT_DOCS = 3000
DISCOUNT = 0.75
#: Letters outside all models: their probability, under that of any rare letter.
FLOOR = 1e-6
#: A text is rejected above this quantile of the fitted documents' cross-entropies, times the slack.
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.25
MEMO_CHUNKS = 100_000
#: Words whose letters are scored at once.
WORDS_AT_ONCE = 5_000
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_EDGE = 32


def words_of(chunk: bytes) -> list[str]:
    """Lower-cased runs of letters; marks count only beside letters."""
    text = chunk.decode()
    if text.isascii() and text.isalpha():
        return [text.lower()]
    return [w for w in _LETTERS.findall(text.lower()) if any(map(str.isalpha, w))]


def grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word number, hash of the n-gram that ends at each position for n = 1 .. order (0: none), letters per word)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens + 2)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lens + 2) - (lens + 2), lens + 2)
    out, h = [], mix(codes + np.uint64(1))
    single = h
    for n in range(1, order + 1):
        if n > 1:
            h = h.copy()
            # the n-gram hash takes the letter n - 1 places back into account
            h[n - 1 :] = mix(h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + single[: len(single) - n + 1] + np.uint64(n))
        ok = at >= n - 1 if n > 1 else at >= 1
        out.append(np.where(ok & (at >= 1), h, 0))
    return owner, out, lens


def contexts(words: list[str], order: int = ORDER) -> list[np.ndarray]:
    """Hash of the n - 1 letters before each position, aligned with ``grams``; the n-gram that ends one place earlier."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lens + 2) - (lens + 2), lens + 2)
    out = [np.zeros(len(codes), np.uint64)]
    h = single = mix(codes + np.uint64(1))
    for n in range(1, order):
        if n > 1:
            h = h.copy()
            h[n - 1 :] = mix(h[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + single[: len(single) - n + 1] + np.uint64(n))
        c = np.zeros(len(codes), np.uint64)
        c[1:] = h[:-1]
        out.append(np.where(at >= n, c, 0))
    return out


@dataclass
class Model:
    """Sorted hashes and, per language, log-free probabilities and weights; limits are per language."""

    langs: list[str]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    context_keys: list[np.ndarray]
    weights: list[np.ndarray]
    limits: np.ndarray

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of -log2 p per word and language, letters and closing mark per word)."""
        parts = [self._score(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)] or [(np.zeros((0, len(self.langs))), np.zeros(0, np.int64))]
        return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        owner, gram, lens = grams(words)
        context = contexts(words)
        p = np.full((len(owner), len(self.langs)), FLOOR)
        for n in range(ORDER):
            if n:
                at, ok = _find(self.context_keys[n], context[n])
                p *= np.where(ok[:, None], self.weights[n][at], 1.0)
            at, ok = _find(self.keys[n], gram[n])
            p += np.where(ok[:, None], self.probs[n][at], 0.0)
        bits = np.where(gram[0][:, None] > 0, -np.log2(np.clip(p, FLOOR, 1.0)), 0.0)
        out = np.zeros((len(words), len(self.langs)))
        first = np.cumsum(lens + 2) - (lens + 2)
        if len(words):
            out = np.add.reduceat(bits, first, axis=0)
        return out, lens + 1


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, (keys[at] == x) & (x > 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language, order, n-gram and its context, over the words of a task's rows."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(text.encode().split())
    for lang, chunks in words.items():
        counted: Counter = Counter()
        for chunk, n in chunks.items():
            for w in words_of(chunk):
                counted[w] += n
        if not counted:
            continue
        names, times = list(counted), np.fromiter(counted.values(), np.int64, len(counted))
        owner, gram, _ = grams(names)
        context = contexts(names)
        # the n-gram less its first letter, which Kneser-Ney counts go to
        for n in range(ORDER):
            ok = gram[n] > 0
            # an n-gram names its context and suffix
            _, first, inverse = np.unique(gram[n][ok], return_index=True, return_inverse=True)
            found = np.stack([gram[n][ok][first], context[n][ok][first], gram[n - 1][ok][first] if n else np.zeros(len(first), np.uint64)], 1)
            total = np.bincount(inverse, weights=times[owner[ok]], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([n + 1] * len(found), pa.int32()), *(pa.array(found[:, j].view(np.int64)) for j in range(3)), pa.array(total)], ["lang", "n", "gram", "context", "suffix", "times"])


def _smooth(rows, langs: list[str]) -> tuple[list, list, list, list]:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours below."""
    keys, probs, context_keys, weights = [], [], [], []
    for n in range(1, ORDER + 1):
        part = rows[rows.n == n]
        k = np.unique(part.gram.to_numpy().view(np.uint64)) if len(part) else np.zeros(1, np.uint64)
        c = np.unique(part.context.to_numpy().view(np.uint64)) if len(part) else np.zeros(1, np.uint64)
        p, w = np.zeros((len(k), len(langs))), np.ones((len(c), len(langs)))
        for j, lang in enumerate(langs):
            mine = part[part.lang == lang]
            if not len(mine):
                continue
            gram, context = mine.gram.to_numpy().view(np.uint64), mine.context.to_numpy().view(np.uint64)
            count = mine.times.to_numpy().astype(float)
            if n < ORDER:
                above = rows[(rows.n == n + 1) & (rows.lang == lang)]
                left = above.groupby("suffix").size()
                # n-grams at the start of a word have no left neighbour: their own count stands in
                count = left.reindex(mine.gram).to_numpy()
                count = np.where(np.isnan(count), mine.times.to_numpy(), count)
            at = np.searchsorted(c, context)
            total = np.bincount(at, weights=count, minlength=len(c))
            kinds = np.bincount(at, minlength=len(c))
            p[np.searchsorted(k, gram), j] = np.maximum(count - DISCOUNT * (n > 1), 0) / total[at]
            has = total > 0
            w[has, j] = DISCOUNT * kinds[has] / total[has]
        keys.append(k), probs.append(p), context_keys.append(c), weights.append(w)
    return keys, probs, context_keys, weights


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model per non-null ``lang``; None without a labelled text. Rows with null text are left out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(per)
    if not langs:
        return None
    share = F.create_map(*(x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, fit_docs / n)))))
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    sample = saved(labelled.where(drawn).select("doc_id", "lang", "text"), "langid")
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, n int, gram long, context long, suffix long, times long")
    rows = counts.groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("times").alias("times")).toPandas()
    if rows.empty:
        return None
    model = Model(langs, *_smooth(rows, langs), np.full(len(langs), np.inf))
    got = score(sample, model).where("lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile_approx("bits", REJECT_QUANTILE, 10000).alias("q")).collect()
    for r in got:
        model.limits[langs.index(r.lang_pred)] = r.q * REJECT_SLACK
    dropped(sample)
    return model


class Judge:
    """Scores batches of texts, with a memo of chunks of bounded size."""

    def __init__(self, model: Model | None) -> None:
        self.model, self.langs = model, model.langs if model else []
        self.clear()

    def clear(self) -> None:
        self.memo, self.bits, self.letters = Memo(), np.zeros((0, len(self.langs))), np.zeros(0, np.int64)

    def learn(self, chunks: list[bytes]) -> None:
        lists = [words_of(c) for c in chunks]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        more, count = np.zeros((len(lists), len(self.langs))), np.zeros(len(lists), np.int64)
        flat = [w for ws in lists for w in ws]
        if flat and self.model:
            of, of_n = self.model.score_words(flat)
            owner = np.repeat(np.arange(len(lists)), n)
            np.add.at(more, owner, of)
            np.add.at(count, owner, of_n)
        self.bits, self.letters = np.concatenate([self.bits, more]), np.concatenate([self.letters, count])
        chunks.clear()

    def texts(self, texts: pa.Array) -> Iterator[tuple[str, float, float | None, bool]]:
        """(lang_pred, score, bits, rejected) of each row."""
        for a, b in byte_blocks(texts):
            rows = [list(map(self.memo.__getitem__, (t or b"").split())) for t in texts.slice(a, b - a).cast(pa.binary()).to_pylist()]
            if self.memo.new:
                self.learn(self.memo.new)
            for row in rows:
                idx = np.fromiter(row, np.int64, len(row))
                n = int(self.letters[idx].sum())
                if not n:
                    yield "und", 0.0, None, True
                    continue
                per = np.round(self.bits[idx].sum(0) / n, 9)
                j = int(per.argmin())
                gap = float(np.partition(per, 1)[1] - per[j]) if len(per) > 1 else 1.0
                yield self.langs[j], gap / (gap + 0.1), float(per[j]), bool(per[j] > self.model.limits[j])
            if len(self.memo) > MEMO_CHUNKS:
                self.clear()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits, rejected for every whole text.

    ``bits`` is the winner's cross-entropy per letter; ``score`` grows from 0 with the runner-up's lead per letter towards 1. Null texts and texts
    without a letter are ``und`` with score 0 and rejected; ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        judge = Judge(shared.value)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = list(judge.texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected; fitted on the rows that are not held out. Rows without an id are neither."""
    model = fit(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """The rows that the model, fitted on all labelled ones, doesn't reject; each row is judged by its own text, and nothing is shuffled.

    Without a labelled text no language is learnt and nothing can be rejected: all rows stay."""
    model = fit(docs)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        judge = Judge(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([not rejected for *_, rejected in judge.texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(rested(run), docs.schema)
