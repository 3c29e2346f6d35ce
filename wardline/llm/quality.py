"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every statistic is taken from the whole text by numpy over Arrow batches. Trees are
complete and flattened: node ``k`` of a level goes to ``2k`` or ``2k + 1`` of the next,
so one row of arrays per level scores all documents of a batch at once.

Cases: a null text counts as empty and is scored; a null id is held out of training;
labels other than 0 and 1 are ignored, repeated labels and rows count each time; without
labels every score is 0.5; columns beyond id and text are never read by the model."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import mix, text_bytes, words

#: Classes of bytes whose shares are statistics: letters, digits, blanks, marks, the rest.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,;:", "!?", "|",
           "#$%&*", "@/\\_=+~^<>", "'\"()[]{}-"]
_CLASS = np.full(256, len(_GROUPS) + 1, np.int64)  # what is left: control characters
_CLASS[128:] = len(_GROUPS)
for _i, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _i
_K = len(_GROUPS) + 2
FEATURES = _K + 14


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys per row."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(float)


def statistics(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` statistics per text."""
    raw, off = text_bytes(text)
    n, size = len(off) - 1, np.diff(off).astype(float)
    counts = np.bincount(np.repeat(np.arange(n) * _K, np.diff(off)) + _CLASS[raw], minlength=n * _K).reshape(n, _K)
    h, first, end, row = words(raw, off)
    n_words = np.bincount(row, minlength=n).astype(float)
    length = (end - first).astype(float)
    mean = _ratio(np.bincount(row, length, n), n_words)
    square = _ratio(np.bincount(row, length ** 2, n), n_words)
    start, last = _CLASS[raw[first]], _CLASS[raw[end - 1]]
    same = np.flatnonzero(row[1:] == row[:-1])
    pair, pair_row = mix(h[same]) + h[same + 1], row[same]
    again = np.bincount(pair_row, h[same] == h[same + 1], n)

    def share(mask: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(row, mask, n), n_words)

    lines = counts[:, 4] + 1.0
    out = [np.log1p(size), np.log1p(n_words), mean, np.sqrt(np.maximum(square - mean ** 2, 0)),
           _ratio(_distinct(h, row, n), n_words), _ratio(again, n_words),
           _ratio(_distinct(pair, pair_row, n), n_words), share(start == 1), share(start > 1), share(last == 5),
           share(last == 6), share((last == 8) | (last == 9)), share(length == 1), np.log1p(size / lines)]
    return np.column_stack([_ratio(counts, size[:, None]), *out]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Flattened complete trees: per level (tree, node) arrays, and leaf values."""

    base: float
    feature: list[np.ndarray]
    cut: list[np.ndarray]
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(self.feature, self.cut):
                node = 2 * node + (x[rows, feature[t][node]] > cut[t][node])
            margin += self.leaf[t][node]
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15,
              bins: int = 64, l2: float = 1.0, min_weight: float = 1.0) -> Trees:
    """Boost logistic loss on binned columns; each level adds up gradients per (node, column, bin)."""
    n, f = x.shape
    rate_1 = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_1 / (1 - rate_1)))
    feature = [np.zeros((trees, 1 << d), np.int64) for d in range(depth)]
    cut = [np.full((trees, 1 << d), np.inf, np.float32) for d in range(depth)]
    leaf = np.zeros((trees, 1 << depth))
    if not n or len(np.unique(y)) < 2:
        return Trees(base if n else 0.0, [v[:0] for v in feature], [v[:0] for v in cut], leaf[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1]).astype(np.float32)) for j in range(f)]
    code = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)])
    cuts = np.full((f, bins), np.inf, np.float32)
    for j, e in enumerate(edges):
        cuts[j, :len(e)] = e
    cell = np.arange(f) * bins + code
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.repeat(p - y, f), np.repeat(p * (1 - p), f)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width = 1 << d
            at = (node[:, None] * (f * bins) + cell).ravel()
            sums = [np.bincount(at, w, width * f * bins).reshape(width, f, bins) for w in (g, h)]
            gl, hl = np.cumsum(sums[0], 2), np.cumsum(sums[1], 2)
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl ** 2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga ** 2 / (ha + l2)
            gain = np.where((hl >= min_weight) & (ha - hl >= min_weight) & np.isfinite(cuts), gain, 0)
            best = gain.reshape(width, -1).argmax(1)
            found = gain.reshape(width, -1).max(1) > 1e-9
            j, b = best // bins, best % bins
            feature[d][t], cut[d][t] = j, np.where(found, cuts[j, b], np.inf)
            node = 2 * node + (x[np.arange(n), j[node]] > cut[d][t][node])
        p_sum, h_sum = np.bincount(node, p - y, 1 << depth), np.bincount(node, p * (1 - p), 1 << depth)
        leaf[t] = -rate * p_sum / (h_sum + l2)
        margin += leaf[t][node]
    return Trees(base, feature, cut, leaf)


def held_out(folds: int = 5) -> Column:
    """The fold that never trains: ids whose CRC-32 as text leaves remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on labelled rows outside the held-out fold. ``max_rows`` bounds the training
    sample (the rows of smallest id hash), and with it what the driver holds."""
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(
                pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "x"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(stats, f"doc_id {ids}, x array<float>")
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").alias("y"))
    sample = rows.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_rows).toArrow()
    n = sample.num_rows
    x = np.array(sample["x"].combine_chunks().flatten(), np.float32).reshape(n, FEATURES) if n else np.zeros((0, FEATURES), np.float32)
    return fit_trees(x, np.array(sample["y"], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(statistics(b.column(1))))], ["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, score double")


def keep(docs: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """The rows whose text scores at least ``least``, with all their columns, in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(model.score(statistics(b.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))
