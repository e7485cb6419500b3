"""Language of words and documents by a linear-chain conditional random field.

Words are maximal runs of letters, in lower case.  A word's score for each
language is the sum of learned weights of its hashed letter bigrams and
trigrams (word edges included), its affixes of three letters, and an entry of
a learned lexicon.  A learned transition matrix links neighbouring words;
forward-backward gives each word's distribution over the languages, so that
code-switched text is labelled word by word.  A document's language has the
largest mean probability over its words; ``score`` is that mean.

The field is trained on the driver by maximum likelihood (full-batch Adam) on
a bounded sample: about ``per_language`` whole texts of each language, chosen
by a hash of the id, none over ``max_train_bytes``.  Pieces of texts in
different languages are strung together in training, so that the transitions
see switches whose words have known labels.

Defined results: null text, or text without letters, is ``und`` with score 0;
ties go to the language that sorts first; with nothing to learn from, every
text is ``und``; repeated rows keep their row; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MB, mix64, text_slices, tidy

SLOTS = 1 << 15
SPACE = 32
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
ODD = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8).view(bool)


@dataclass
class Words:
    """Words of some texts laid end to end, with the hashed features of each."""

    per_text: np.ndarray  # words per text
    first: np.ndarray  # first feature place of each word
    slots: np.ndarray  # (3, places) bigram, trigram, affix; SLOTS: none
    keys: np.ndarray  # hash of each whole word


def _slot(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(odd)
    return (x ^ (x >> np.uint32(13))) * ODD[0] >> np.uint32(32 - 15)


def words_of(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer(("   " + " ".join(low) + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(SPACE))
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1  # the place after the last letter
    ends = np.cumsum([len(t) + 1 for t in low]) + 3
    per_text = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    used = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]]))
    one, two, three, four = code[used], code[used - 1], code[used - 2], code[used - 3]
    bi = one * ODD[0] + two * ODD[1]
    tri = bi + three * ODD[2]
    affix = tri + four * ODD[3]
    slots = np.stack([
        _slot(bi, 0x2545F491),
        np.where(two != SPACE, _slot(tri, 0x9E6C63D1), SLOTS),
        np.where((two != SPACE) & (three != SPACE) & ((one == SPACE) | (four == SPACE)), _slot(affix, 0xC5A308D3), SLOTS),
    ])
    first = np.searchsorted(used, start)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * MIX[1] * _powers(len(code)), dtype=np.uint64)])
    keys = mix64((sums[end] - sums[start]) * _inverse(len(code))[start])
    return Words(per_text, first, slots, keys)


def _series(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _table(1 << max(12, int(n).bit_length()), int(MIX[0]))[:n]


def _inverse(n: int) -> np.ndarray:
    return _table(1 << max(12, int(n).bit_length()), pow(int(MIX[0]), -1, 1 << 64))[:n]


@lru_cache(maxsize=4)
def _table(n: int, base: int) -> np.ndarray:
    return _series(n, base)


def marginals(score: np.ndarray, per_text: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all texts at once, longest first: (word x language probabilities, summed pair probabilities)."""
    n, k = score.shape
    e = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-12 if n else score
    step = np.exp(move)
    by = np.argsort(-per_text, kind="stable")
    size = per_text[by]
    start = (np.cumsum(per_text) - per_text)[by]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(most), side="left")  # texts longer than t
    fore, back = np.empty_like(e), np.empty_like(e)
    a = None
    for t in range(most):
        at = start[: live[t]] + t
        a = e[at] if t == 0 else (a[: live[t]] @ step) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        fore[at] = a
    b = np.ones((0, k), e.dtype)
    for t in range(most - 1, -1, -1):
        at = start[: live[t]] + t
        if len(b):
            follow = (b * e[at[: len(b)] + 1]) @ step.T
            follow /= follow.sum(axis=1, keepdims=True)
            b = np.concatenate([follow, np.ones((live[t] - len(b), k), e.dtype)])
        else:
            b = np.ones((live[t], k), e.dtype)
        back[at] = b
    out = fore * back
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-30)
    if not pairs:
        return out, None
    inside = np.ones(n, bool)
    inside[start[size > 0]] = False
    p = np.flatnonzero(inside)
    both = fore[p - 1][:, :, None] * step[None] * (e[p] * back[p])[:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return out, both.sum(axis=0)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # (SLOTS + 1, k); the last row stays zero
    lexicon: np.ndarray  # sorted word hashes
    words: np.ndarray  # (lexicon + 1, k); the last row stays zero
    move: np.ndarray  # (k, k)

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.languages)), np.float32)
        place = self.weights[w.slots[0]]
        place += self.weights[w.slots[1]]
        place += self.weights[w.slots[2]]
        out = np.add.reduceat(place, w.first, axis=0)
        out += self.words[self.entries(w)]
        return out

    def entries(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(w.keys), np.int64)
        at = np.searchsorted(self.lexicon, w.keys)
        at[at == len(self.lexicon)] = 0
        return np.where(self.lexicon[at] == w.keys, at, len(self.lexicon))


def train(sample: list[tuple[str, str]], rounds: int = 18, lexicon_size: int = 4000, piece: int = 40) -> Field:
    """Fit a field to (language, text) pairs; the result depends on the pairs only."""
    languages = sorted({lang for lang, _ in sample})
    k = len(languages)
    order = sorted(sample, key=lambda x: (hash64(x[1]), x[0]))
    texts, labels = [t for _, t in order], np.array([languages.index(lang) for lang, _ in order], dtype=np.int64)
    w = words_of(texts)
    gold = np.repeat(labels, w.per_text)
    # every other text is strung with its successor, so that labels switch inside a sequence
    size, i, seq = w.per_text.tolist(), 0, []
    while i < len(size):
        n = 2 if i % 3 == 0 and i + 1 < len(size) else 1
        seq.append(sum(size[i : i + n]))
        i += n
    seq = np.array(seq, dtype=np.int64)
    # pieces keep the steps of a round few
    cut = np.concatenate([np.diff(np.append(np.arange(0, s, piece * 8), s)) for s in seq if s] or [np.zeros(0, np.int64)]).astype(np.int64)
    keys, counts = np.unique(w.keys, return_counts=True)
    lexicon = np.sort(keys[np.argsort(-counts, kind="stable")[:lexicon_size]])
    f = Field(languages, np.zeros((SLOTS + 1, k), np.float32), lexicon, np.zeros((len(lexicon) + 1, k), np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not len(gold):
        return f
    entry = f.entries(w)
    word_of = np.repeat(np.arange(len(w.first)), np.diff(np.append(w.first, w.slots.shape[1])))
    flat = w.slots
    start = np.zeros(len(gold), bool)
    start[(np.cumsum(cut) - cut)[cut > 0]] = True
    p = np.flatnonzero(~start)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[p - 1], gold[p]), 1)
    params = [f.weights, f.words, f.move]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for r in range(1, rounds + 1):
        prob, both = marginals(f.scores(w).astype(np.float64), cut, f.move.astype(np.float64), pairs=True)
        miss = -prob
        miss[np.arange(len(gold)), gold] += 1
        grads = [np.zeros_like(x) for x in params]
        for j in range(k):
            per_place = miss[word_of, j]
            for s in flat:
                grads[0][:, j] += np.bincount(s, per_place, SLOTS + 1)
            grads[1][:, j] = np.bincount(entry, miss[:, j], len(lexicon) + 1)
        grads[2][:] = seen - both
        for x, g, a, b in zip(params, grads, m, v):
            g /= len(gold)
            g -= 1e-6 * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.25 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
        f.weights[SLOTS] = f.words[len(lexicon)] = 0
    return f


def hash64(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def sample_texts(docs: DataFrame, allowed: Column, per_language: int = 150, max_train_bytes: int = 32_768) -> list[tuple[str, str]]:
    """About ``per_language`` (language, text) pairs of each language, by a hash of id and text."""
    rows = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_train_bytes))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    return [(r["lang"], r["text"]) for r in rows.where(place < share[F.col("lang")]).select("lang", "text").collect()]


def learn(docs: DataFrame, allowed: Column | None = None, per_language: int = 150) -> Field:
    """Train on rows of ``docs`` (doc_id, text, lang) that ``allowed`` admits."""
    return train(sample_texts(docs, F.lit(True) if allowed is None else allowed, per_language))


def predict(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score``, and ``word_share`` (map of language to mean probability)."""
    names = ("lang_pred", "score", "word_share")
    own = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*own, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("word_share", T.MapType(T.StringType(), T.DoubleType()), False)])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f: Field = shared.value
            k = len(f.languages)
            for part in text_slices(batch, text_col, 4 * MB):
                scores, per_text = [], []
                for small in text_slices(part, text_col, MB // 4):
                    w = words_of(small.column(small.schema.get_field_index(text_col)).to_pylist())
                    scores.append(f.scores(w))
                    per_text.append(w.per_text)
                per_text = np.concatenate(per_text)
                share = np.zeros((len(part), k))
                some = np.flatnonzero(per_text > 0)
                if len(some) and k:
                    prob, _ = marginals(np.concatenate(scores), per_text, f.move)
                    share[some] = np.add.reduceat(prob.astype(np.float64), (np.cumsum(per_text) - per_text)[some], axis=0) / per_text[some, None]
                best = share.argmax(axis=1) if k else np.zeros(len(part), np.int64)
                known = (per_text > 0) & (k > 0)
                pred = pa.array([f.languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())], pa.string())
                score = np.where(known, np.minimum(share[np.arange(len(part)), best], 1.0) if k else 0.0, 0.0)
                offsets = pa.array(np.arange(len(part) + 1) * k, pa.int32())
                maps = pa.MapArray.from_arrays(offsets, pa.array(f.languages * len(part), pa.string()), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pred, pa.array(score), maps], names=schema.names)

    return docs.select(*[docs[f.name] for f in own]).mapInArrow(work, schema)


def label_words(text: str, field: Field) -> list[str]:
    """The language of every word (run of letters) of one text."""
    w = words_of([text])
    prob, _ = marginals(field.scores(w), w.per_text, field.move)
    return [field.languages[i] for i in prob.argmax(axis=1)]
