"""Quality scores: histogram gradient-boosted trees over statistics of a document.

One pass turns every text into ``FEATURES``. The trees are fitted on the labelled rows, or on a sample of them by the
hash of their id when there are more than ``max_rows``; that bound is the only thing that keeps the fit on one machine,
and ``max_rows`` x features x 8 bytes is what the driver holds. Values are cut into at most ``BINS`` bins at their
quantiles; each level of a tree sums gradients by node and bin. The finished forest is four flat arrays, and scoring
walks all rows of a batch down all trees at once.

Defined results: no text is an empty one; its statistics are zeros and it gets a score like any other. Labels without a
value, or for unknown documents, teach nothing; several labels of a document each count. Without any label, or with
labels of one kind, every score is the share of ones (0.5 without any). Columns beside the named ones pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.common import slices
from glosswork.llm.shingles import WordHasher, mixed, raw_texts

FEATURES = (
    "log_bytes log_words word_bytes symbols bars marks digits capitals stops lines_per_word short_lines repeated_lines "
    "distinct_words repeated_pairs top_word blank_share wide_bytes stopped_lines"
).split()
BINS = 64
TREES, DEPTH, RATE, LEAST_WEIGHT, L2 = 60, 4, 0.15, 2.0, 1.0
MAX_ROWS = 50_000  # labelled rows the trees are fitted on

_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 bar, 3 exclamation or question mark, 4 digit, 5 capital, 6 stop or comma, 7 blank, 8 wide
for _i, _set in enumerate((b"#*$%&<>{}~^=_\\@", b"|", b"!?", b"0123456789", bytes(range(65, 91)), b".,;:", b" \t\n\x0b\x0c\r", bytes(range(128, 256))), 1):
    _KIND[list(_set)] = _i


def statistics(raw: np.ndarray, hasher: WordHasher) -> list[float]:
    """The features of one text."""
    if len(raw) == 0:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[raw], minlength=9)
    words = hasher.words(raw)
    n, size = max(len(words), 1), len(raw)
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.append(0, breaks + 1), np.append(breaks, size)
    full = ends > starts
    starts, ends = starts[full], ends[full]
    lines = max(len(starts), 1)
    widths = ends - starts
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw, dtype=np.uint64)])
    prints = mixed((sums[ends] - sums[starts]) * np.uint64(1 << 32) + widths.astype(np.uint64) * np.uint64(65537) + raw[starts].astype(np.uint64) * np.uint64(257) + raw[ends - 1])
    _, times = np.unique(words, return_counts=True)
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words
    letters = size - kinds[7]
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), letters / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n,
        kinds[5] / n, kinds[6] / n, lines / n, float((widths < 20).mean()) if len(widths) else 0.0, 1 - len(np.unique(prints)) / lines,
        len(times) / n, 1 - len(np.unique(pairs)) / max(len(pairs), 1), float(times.max()) / n if len(times) else 0.0, kinds[7] / size,
        kinds[8] / size, float((_KIND[raw[ends - 1]] == 6).mean()) if len(ends) else 0.0,
    ]


def with_features(documents: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """Replace the text by its statistics, an array of doubles."""
    kept = [f for f in documents.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start, stop in slices(batch.column(text)):
                part = batch.slice(start, stop - start)
                rows = [statistics(raw, hasher) for raw in raw_texts(part.column(text))]
                columns = [*[part.column(f.name) for f in kept], pa.array(rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], name])

    return documents.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(run, schema)


@dataclass
class Forest:
    """All nodes of all trees: an inner node sends values up to its cut to ``left``, others to the node after it."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of a matrix."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        total = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost ``TREES`` trees on the logistic loss."""
    ones = y.mean() if len(y) else 0.5
    base = float(np.log(max(ones, 1e-3) / max(1 - ones, 1e-3))) if len(y) else 0.0
    feature, cut, left, value, roots = [], [], [], [], []
    if 0 < ones < 1 and len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            nodes = [(len(feature), np.arange(len(y)))]
            roots.append(len(feature))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
            for depth in range(DEPTH + 1):
                below = []
                for node, rows in nodes:
                    g, h = grad[rows].sum(), hess[rows].sum()
                    best = (1e-6, -1, 0)
                    if depth < DEPTH:
                        for f in range(x.shape[1]):
                            b = binned[rows, f]
                            gl = np.cumsum(np.bincount(b, grad[rows], BINS))[:-1]
                            hl = np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
                            gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                            gain[(hl < LEAST_WEIGHT) | (h - hl < LEAST_WEIGHT)] = 0
                            gain[len(edges[f]) :] = 0
                            k = int(np.argmax(gain))
                            if gain[k] > best[0]:
                                best = (gain[k], f, k)
                    if best[1] < 0:
                        value[node] = float(-RATE * g / (h + L2))
                        total[rows] += value[node]
                        continue
                    _, f, k = best
                    feature[node], cut[node], left[node] = f, float(edges[f][k]), len(feature)
                    goes = binned[rows, f] > k
                    for side in (rows[~goes], rows[goes]):
                        below.append((len(feature), side))
                        feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
                nodes = below
    whole = lambda v, k: np.array(v, k)
    return Forest(whole(feature, np.int64), whole(cut, float), whole(left, np.int64), whole(value, float), whole(roots, np.int64), base)


def learn(features: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Fit a forest on the labelled rows of ``key, features``, on at most ``max_rows`` of them."""
    named = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")).where(F.col("_label").isNotNull())
    rows = features.join(named, F.col(key) == F.col("_key")).select("_key", "features", "_label")
    count = rows.count()
    if count > max_rows:
        share = max_rows / count
        rows = rows.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * max_rows)
    found = rows.orderBy("_key", "_label").toArrow()
    x = np.array(found["features"].to_pylist(), float).reshape(found.num_rows, len(FEATURES))
    return fit(x, found["_label"].to_numpy().astype(float))


def scored(features: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """Replace ``features`` by the score."""
    kept = [f for f in features.schema.fields if f.name not in ("features", name)]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            x = lists.flatten().to_numpy().reshape(-1, len(FEATURES))
            columns = [*[batch.column(f.name) for f in kept], pa.array(forest.score(x))]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], name])

    return features.select(*[F.col(f"`{f.name}`") for f in kept], "features").mapInArrow(run, schema)
