"""Quality of documents by gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the trees are fitted on, at most; chosen by a hash of the key.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.15, 10, 1.0

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32),
    "line_end": (10,), "mark": b"!?*#%&$@~^|<>{}[]\\=+_", "stop": b".,;:'\"()-/", "beyond_ascii": range(128, 256),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _chars in enumerate(_CLASSES.values()):
    _MEMBER[list(_chars), _i] = 1.0

FEATURES = (
    *_CLASSES, "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "repeats",
    "top_word", "capital_words", "marked_words", "single_letters", "log_lines", "distinct_lines", "line_length",
    "byte_entropy",
)


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, as shares where a length would matter; all zero for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = (counts @ _MEMBER) / n
    used = counts[counts > 0] / n
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    often = Counter(words)
    pairs = set(zip(words, words[1:]))
    return [
        *shares.tolist(), math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, math.log1p(max(map(len, words), default=0)),
        len(often) / w, len(pairs) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        max(often.values(), default=0) / w, sum(map(bytes.isupper, words)) / w,
        sum(not x[-1:].isalnum() and x[-1] < 128 for x in words) / w, sum(len(x) == 1 for x in words) / w,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        float(-(used * np.log2(used)).sum()),
    ]


def _matrix(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


@dataclass
class Forest:
    """Trees of one depth as flat arrays: node i has the children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row; all rows walk down all trees together, one level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2 ** DEPTH - 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosting on the logistic loss; splits are searched in histograms of binned statistics.

    With one class, or no rows, the start value (smoothed log odds) stands alone.
    """
    start = math.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feature, cut = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if len(y) == 0 or y.min() == y.max():
        return Forest(start, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = BINS + 1
    flat = binned + np.arange(x.shape[1]) * width
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        gradient, hessian = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, many = 2 ** depth - 1, 2 ** depth
            slots = ((node - first) * (x.shape[1] * width))[:, None] + flat
            shape = (many, x.shape[1], width)
            g, h, n = (np.bincount(slots.ravel(), np.repeat(v, x.shape[1]), many * x.shape[1] * width).reshape(shape).cumsum(axis=2)
                       for v in (gradient, hessian, np.ones(len(y))))
            gain = (g ** 2 / (h + RIDGE) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + RIDGE) - g[..., -1:] ** 2 / (h[..., -1:] + RIDGE))
            gain[(n < LEAST_ROWS) | (n[..., -1:] - n < LEAST_ROWS)] = -1.0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, place = divmod(int(b), width)
                if gain[k, j, place] > 1e-9 and place < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][place]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + RIDGE)
        total += value[t, leaf]
    return Forest(start, feature, cut, value)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text",
          label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows that ``allowed`` (a condition on the key) admits.

    The sampled labels go to the documents, so texts are not shuffled; statistics are taken in the tasks and only
    they reach the driver. NULL labels are left out; a key with several labels counts with each. Rows that repeat key
    and text count once; if keys repeat so that more than twice ``sample`` rows are left, a hash of both chooses.
    """
    chosen = (labels.filter(allowed & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"))
              .orderBy(F.xxhash64("k"), "k", "y").limit(sample))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = rows.join(F.broadcast(chosen), "k").select("y", F.xxhash64("k", "t").alias("h"), "t")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "h", "x"])

    measured = joined.mapInArrow(measure, "y double, h long, x array<double>").groupBy("y", "h").agg(F.first("x").alias("x"))
    found = measured.orderBy("h", "y").limit(2 * sample).collect()
    found.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], dtype=float))


def score(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, score, statistics). NULL text counts as empty and is scored too."""
    model = docs.sparkSession.sparkContext.broadcast((forest.start, forest.feature, forest.cut, forest.value))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType()), T.StructField("statistics", T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(*model.value)
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(forest.score(x)), pa.array(list(x), pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(apply, schema)
