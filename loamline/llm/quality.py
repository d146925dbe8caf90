"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted in numpy on a bounded sample of labelled rows (``max_rows``, those with the smallest hashes of their ids),
flattened into arrays of complete binary trees, and sent with the tasks (some tens of kB, whatever the corpus). Scoring
computes the statistics of each whole text and walks all rows of a batch down each tree level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import hashed_words, shingled, text_blocks

#: Byte classes whose share of a text is a statistic.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:", "shout": b"!?", "bar": b"|", "mark": b"*#$%&@~^_=+", "bracket": b"()[]{}<>", "quote": b"\"'`", "slash": b"/\\-", "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
STATISTICS = (*CLASSES, "words", "bytes", "word_length", "word_length_spread", "long_words", "lines", "line_words", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "capital_words", "marked_words", "short_lines")
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES.values()):
    _CLASS_OF[list(_members)] = _k


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float64)
    n_classes = len(CLASSES)
    words, starts = hashed_words(texts)
    pairs = shingled(words, 2)
    for k, t in enumerate(texts):
        if not t:
            continue
        codes = np.frombuffer(t, np.uint8)
        share = np.bincount(_CLASS_OF[codes], minlength=n_classes + 1)[:n_classes] / len(t)
        own = words[starts[k] : starts[k + 1]]
        n = len(own)
        row = [*share, np.log1p(n), np.log1p(len(t))]
        if n:
            blank = np.concatenate([[True], (codes == 32) | ((codes >= 9) & (codes <= 13)), [True]])
            edges = np.flatnonzero(blank)
            sizes = np.diff(edges) - 1
            first = edges[:-1][sizes > 0]
            sizes = sizes[sizes > 0]
            heads, tails = codes[first], codes[first + sizes - 1]
            lines = [x for x in t.split(b"\n") if x.strip()]
            lengths = np.array([x.count(b" ") + 1 for x in lines])
            _, counts = np.unique(own, return_counts=True)
            row += [
                sizes.mean(), sizes.std(), (sizes > 12).mean(), np.log1p(len(lines)), np.log1p(lengths.mean()), len(counts) / n, counts.max() / n,
                len(np.unique(pairs[starts[k] : starts[k + 1] - 1])) / (n - 1) if n > 1 else 1.0, len(set(lines)) / len(lines),
                ((heads >= 65) & (heads <= 90)).mean(), ((tails < 48) & (tails != 44) & (tails != 46)).mean(), (lengths < 4).mean(),
            ]
        else:
            row += [0.0] * (len(STATISTICS) - len(row))
        out[k] = row
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth. Node i has children 2i+1 (not above the threshold) and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, smooth: float = 1.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains, all features, no row sampling. Without rows of both labels the score is their share (0.5 without rows)."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    n_features, rows = len(cuts), np.arange(len(y))
    total = np.full(len(y), base)
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for k in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = (node - first) * bins
            gs = np.stack([np.bincount(at + c, g, width * bins) for c in coded]).reshape(n_features, width, bins).cumsum(2)
            hs = np.stack([np.bincount(at + c, h, width * bins) for c in coded]).reshape(n_features, width, bins).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + smooth) + (g_all - gs) ** 2 / (h_all - hs + smooth) - g_all**2 / (h_all + smooth)
            gain[(hs < least) | (h_all - hs < least)] = 0
            gain = gain.transpose(1, 0, 2).reshape(width, -1)
            best = gain.argmax(1)
            for i, b in enumerate(best):
                f, c = divmod(int(b), bins)
                if gain[i, b] > 1e-9 and c < len(cuts[f]):
                    features[k, first + i], thresholds[k, first + i] = f, cuts[f][c]
            node = 2 * node + 1 + (x[rows, features[k, node]] > thresholds[k, node])
        leaf = node - inner
        values[k] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        total += values[k][leaf]
    return Trees(base, features, thresholds, values)


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Trees:
    """Trees fitted on at most ``max_rows`` rows of ``labels`` for which ``use`` holds, those with the smallest hashes of ``key``.

    Null keys and labels are left out; labels above 0 count as 1. Repeated rows of either table count each time, up to ``max_rows`` in all
    (those of the smallest hashes of key and text).
    """
    own = labels.where(use if use is not None else F.lit(True)).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    own = own.select(F.col(key).alias("label_key"), (F.col(label) > 0).cast("double").alias("label"))
    own = own.orderBy(F.xxhash64(F.lit(1), "label_key"), "label").limit(max_rows)  # so it is small enough to broadcast
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(own), F.col("k") == F.col("label_key")).select("t", "label", F.xxhash64("k", "t").alias("o"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(statistics(texts)), pa.list_(pa.float64())), *[b.column(i)[part.start : part.stop] for i in (1, 2)]], names=["x", "y", "o"])

    rows = joined.mapInArrow(measured, "x array<double>, y double, o bigint").orderBy("o", "y").limit(max_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    y = rows["y"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same trees in whatever order rows arrive
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """``docs``, all columns, with ``score``, the chance of label 1.

    Null texts score as empty ones, and rows of equal texts alike. A column that already has the name of ``score`` is replaced. Repeated rows stay; an
    empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == score.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [model.scores(statistics(texts)) for _, texts in text_blocks(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *values]))], names=[*b.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
