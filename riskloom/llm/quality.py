"""Quality scores by histogram gradient-boosted trees over document statistics.

``statistics`` turns whole texts into a fixed row of numbers (sizes, shares of
character classes, repetition of words and lines, entropy, compressibility).
``fit`` bins every feature by its quantiles and grows regression trees on the
logistic loss from gradient and hessian histograms, level by level.  Trees are
flattened into arrays; ``Forest.score`` walks all rows through one tree at a
time with numpy indexing.

The forest is fitted on the driver on a bounded sample of labelled rows
(``sample_rows`` at most on average, by a hash of the id); labels, language,
source and id are never features.

Defined results: null text counts as empty, and empty texts get a score like
any other; equal texts get equal scores; labels other than 0 and 1 or null are
not learned from; without rows to learn from every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_std", "upper", "letters", "digits", "space", "punctuation", "non_ascii", "exclaim", "bar", "symbols", "stops", "commas",
    "distinct_words", "same_neighbours", "top_word", "distinct_pairs", "log_lines", "distinct_lines", "line_mean", "title_words", "entropy", "deflated", "end_marks", "long_words", "markup",
)
_CLASS = np.zeros((256, 10), np.float64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = [
        65 <= _i <= 90, 65 <= _i <= 90 or 97 <= _i <= 122 or _i >= 128, 48 <= _i <= 57, _i == 32 or 9 <= _i <= 13, _i < 128 and _i > 32 and not _c.isalnum(), _i >= 128,
        _c == "!", _c == "|", _c in "#$%&*@^~=+", _c in "<>{}\\",
    ]
STOP, COMMA = ord("."), ord(",")


def statistics(text: bytes) -> list[float]:
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    share = counts @ _CLASS / max(n, 1)
    words = text.split()
    m = len(words)
    size = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    kinds = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    pairs = len(set(zip(words, words[1:])))
    lines = text.split(b"\n")
    p = counts[counts > 0] / max(n, 1)
    title = sum(w[:1].isupper() for w in words)
    ends = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    return [
        np.log1p(n), np.log1p(m), size.mean(), size.std(), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], counts[STOP] / max(m, 1), counts[COMMA] / max(m, 1),
        len(kinds) / max(m, 1), same / max(m - 1, 1), max(kinds.values(), default=0) / max(m, 1), pairs / max(m - 1, 1), np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines),
        title / max(m, 1), -(p * np.log2(p)).sum() if n else 0.0, len(zlib.compress(text, 1)) / (n + 16), ends / len(lines), (size > 20).mean(), share[9],
    ]


@dataclass
class Forest:
    """Flat trees: node i of all trees sends rows with x[feature] <= threshold to left, others to left + 1; leaves have feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 12, ridge: float = 1.0) -> Forest:
    """Boosted trees; the result depends on the set of rows only."""
    feature, threshold, left, value, roots = [], [], [], [], []
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.mean() < 1:
        order = np.lexsort((y, *x.T))
        x, y = x[order], y[order]
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        n_features = x.shape[1]
        place = code + np.arange(n_features) * bins
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
            nodes, at = [roots[-1]], np.zeros(len(y), np.int64)  # open nodes; index of each row's among them, -1: settled
            home = np.full(len(y), roots[-1])
            for level in range(depth + 1):
                k = len(nodes)
                live = np.flatnonzero(at >= 0)
                key = (at[live, None] * (n_features * bins) + place[live]).ravel()
                size = k * n_features * bins
                hist = [np.bincount(key, np.repeat(v[live], n_features), size).reshape(k, n_features, bins) for v in (g, h, np.ones(len(y)))]
                sums = [np.cumsum(a, axis=2) for a in hist]
                all_g, all_h, all_n = (a[:, :1, -1:] for a in sums)
                for j, node in enumerate(nodes):
                    value[node] = -rate * float(all_g[j, 0, 0] / (all_h[j, 0, 0] + ridge))
                if level == depth:
                    break
                gain = sums[0] ** 2 / (sums[1] + ridge) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + ridge) - all_g**2 / (all_h + ridge)
                gain[(sums[2] < least) | (all_n - sums[2] < least)] = 0
                best = gain.reshape(k, -1).argmax(axis=1)
                follow, slot_of = [], np.full((k, 2), -1)
                for j, node in enumerate(nodes):
                    f, b = divmod(int(best[j]), bins)
                    if gain[j, f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], threshold[node], left[node] = f, float(cuts[f][b]), len(feature)
                        slot_of[j] = len(follow), len(follow) + 1
                        for _side in range(2):
                            follow.append(len(feature))
                            feature.append(-1), threshold.append(0.0), left.append(-1), value.append(0.0)
                if not follow:
                    break
                f_of, t_of = np.array([feature[n] for n in nodes]), np.array([threshold[n] for n in nodes])
                row_node = at[live]
                side = (x[live, np.maximum(f_of[row_node], 0)] > t_of[row_node]).astype(np.int64)
                at[live] = slot_of[row_node, side]
                nodes = follow
                moved = live[at[live] >= 0]
                home[moved] = np.array(nodes)[at[moved]]
            margin += np.array(value)[home]
    return Forest(base, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value))


def with_statistics(docs: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    own = [f for f in docs.schema.fields if f.name != out_col]
    schema = T.StructType([*own, T.StructField(out_col, T.ArrayType(T.DoubleType(), False), False)])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            rows = np.array([statistics(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(FEATURES), pa.int32()), pa.array(rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return docs.select(*[docs[f.name] for f in own]).mapInArrow(work, schema)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label_col: str = "quality", sample_rows: int = 12_000, **options) -> Forest:
    """Fit on labelled documents (joined on ``doc_id``) that ``allowed`` admits."""
    rows = labels.where(F.col(label_col).isin(0, 1) & (F.lit(True) if allowed is None else allowed)).select("doc_id", F.col(label_col).alias("y"))
    n = rows.count()
    place = F.pmod(F.xxhash64(F.concat(F.lit("quality"), F.col("doc_id").cast("string"))), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(place < min(1.0, sample_rows / max(n, 1)))  # about sample_rows ids: a bounded side
    data = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("y", "text")).select("y", "statistics").collect()
    x = np.array([r["statistics"] for r in data], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in data], dtype=np.float64), **options)


def predict(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier)."""
    own = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*own, T.StructField("score", T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            x = np.array([statistics(t.as_py() or b"") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], names=schema.names)

    return docs.select(*[docs[f.name] for f in own]).mapInArrow(work, schema)
