"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every text becomes a row of STATISTICS. Trees are grown level by level on histograms of binned
statistics (logistic loss, at most BINS bins per statistic) from a bounded hash sample of labelled
documents, then flattened into perfect binary trees held in three arrays, which are walked for a
whole batch of rows and all trees at once.

Defined results: null and empty texts have statistics 0 and are scored like others; rows with a
null label or null id are not learned from; several labels of one id count as their majority (a tie: 0),
several documents of one id as one of them; where only one kind of label is known every score is
that label, where none is known 0.5; repeated rows and null ids are scored row by row; an empty
table gives an empty one; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import counts_in, map_text, rows_of, text_slices, widened

#: Labelled documents that trees are fitted on, about: the bound of the sample.
SAMPLE = 20_000
BINS = 64
TREES, DEPTH, RATE = 60, 4, 0.2
#: Weight that keeps leaves of few rows near 0, and the fewest (summed) weight of a side of a split.
RIDGE, LEAST_WEIGHT = 5.0, 2.0
#: Score from which a document counts as good.
GOOD = 0.7
#: Words of the windows over which the worst shares are taken.
WINDOW = 32

_CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:'\"()-", "shout": "!?", "symbol": "#*$%&|<>@^~_=+\\/[]{}"}
_CLASS = np.zeros((len(_CLASSES), 256), bool)
for _i, _letters in enumerate(_CLASSES.values()):
    _CLASS[_i, [ord(c) for c in _letters]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: What is known of a text, in the order of the columns.
STATISTICS = ("bytes", "words", "word_bytes", "beyond_ascii", *_CLASSES, "distinct_words", "same_as_last", "top_word",
              "line_words", "distinct_lines", "worst_shout", "worst_symbol", "worst_upper", "worst_same")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _worst(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: the largest share of `marks` (one number per word) in a window of WINDOW words, or in all of a shorter text."""
    n = np.diff(starts)
    total = np.concatenate(([0.0], np.cumsum(marks)))
    out = _share(total[starts[1:]] - total[starts[:-1]], n)
    end = np.repeat(starts[1:], n)
    first = np.flatnonzero(np.arange(len(marks)) + WINDOW <= end)
    if len(first):
        held = total[first + WINDOW] - total[first]
        row = np.searchsorted(starts, first, "right") - 1
        most = np.zeros(len(n))
        cut = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
        most[row[cut]] = np.maximum.reduceat(held, cut) / WINDOW
        long = n >= WINDOW
        out[long] = most[long]
    return out


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """STATISTICS of consecutive texts (UTF-8 end to end, n + 1 offsets): n rows."""
    texts = rows_of(data, ends)
    split = [t.split() for t in texts]
    held = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate(([0], np.cumsum(held)))
    coded = pa.array([w for row in split for w in row], pa.binary()).dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.array([len(w) for w in coded.dictionary.to_pylist()], np.int64)
    own = np.array([[sum(map(w.count, _BYTES[c])) for c in ("upper", "shout", "symbol")] for w in coded.dictionary.to_pylist()], np.float64).reshape(-1, 3)
    row = np.repeat(np.arange(len(texts)), held)

    # A word of a text and how often it stands there.
    key, times = np.unique(row * max(len(size), 1) + word, return_counts=True)
    of = key // max(len(size), 1)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, of, times)
    same = np.zeros(len(word))
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    letters = np.maximum(size[word], 1) if len(word) else np.zeros(0)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    n_bytes = np.diff(ends)
    inked = n_bytes - counts_in(_WHITE[data], ends)
    columns = [np.log1p(n_bytes), np.log1p(held), _share(inked, held), _share(counts_in(data > 0x7F, ends), inked),
               *(_share(counts_in(c[data], ends), inked) for c in _CLASS),
               _share(np.bincount(of, minlength=len(texts)), held), _share(counts_in(same, starts), held), _share(top, held),
               _share(held, n_lines), _share(np.array([len(set(x)) for x in lines]), n_lines),
               *(_worst(own[word, i] / letters if len(word) else letters, starts) for i in (1, 2, 0)), _worst(same, starts)]
    return np.stack(columns, 1).astype(np.float64)


_BYTES = {name: [c.encode() for c in letters] for name, letters in _CLASSES.items()}


@dataclass
class Forest:
    """Perfect trees: `feature` and `above` per inner node, `value` per bottom leaf; score is the logistic of `base` and all leaves."""

    base: float
    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        n, trees = len(rows), np.arange(len(self.feature))
        node = np.zeros((n, len(trees)), np.int64)
        at = np.arange(n)[:, None]
        depth = self.value.shape[1].bit_length() - 1 if len(trees) else 0
        for _ in range(depth):
            node = 2 * node + 1 + (rows[at, self.feature[trees, node]] > self.above[trees, node])
        return self.base + (self.value[trees, node - (self.value.shape[1] - 1)].sum(1) if len(trees) else np.zeros(n))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(rows)))


def edges_of(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per statistic the upper edges of its bins: quantiles between different values, at most bins - 1."""
    edges = []
    for column in rows.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= bins:
            middle = np.unique(middle[np.searchsorted(values[1:], np.quantile(column, np.arange(1, bins) / bins)).clip(0, len(middle) - 1)])
        edges.append(middle)
    return edges


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def grow(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, n_bins: int, depth: int = DEPTH):
    """One tree on binned statistics: feature and bin per inner node (bin n_bins - 1: all go left), value per bottom leaf."""
    n, k = binned.shape
    feature, cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, n_bins - 1)
    node = np.zeros(n, np.int64)
    cell = np.arange(k) * n_bins + binned
    for level in range(depth):
        width = 2 ** level
        at = (node[:, None] * (k * n_bins) + cell).ravel()
        g, h = (np.bincount(at, np.repeat(x, k), width * k * n_bins).reshape(width, k, n_bins).cumsum(2) for x in (gradient, weight))
        whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
        gain = _gain(g, h) + _gain(whole_g - g, whole_h - h) - _gain(whole_g, whole_h)
        gain[(h < LEAST_WEIGHT) | (whole_h - h < LEAST_WEIGHT)] = 0.0
        flat = gain.reshape(width, -1)
        best = flat.argmax(1)
        split = flat[np.arange(width), best] > 1e-9
        first = width - 1
        feature[first:first + width] = np.where(split, best // n_bins, 0)
        cut[first:first + width] = np.where(split, best % n_bins, n_bins - 1)
        node = 2 * node + (binned[np.arange(n), feature[first + node]] > cut[first + node])
    leaves = 2 ** depth
    value = -np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + RIDGE)
    return feature, cut, value, node


def fit(rows: np.ndarray, good: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Forest of statistics `rows` and labels `good` (0 or 1)."""
    n = len(good)
    none = Forest(0.0, np.zeros((0, 2 ** depth - 1), np.int64), np.zeros((0, 2 ** depth - 1)), np.zeros((0, 2 ** depth)))
    if not n or good.min() == good.max():
        none.base = 0.0 if not n else np.inf if good.min() else -np.inf
        return none
    edges = edges_of(rows)
    n_bins = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, rows.T)], 1)
    # A bin beyond a statistic's last edge holds nothing: all go left.
    upper = np.array([np.concatenate((e, np.full(n_bins - len(e), np.inf))) for e in edges])
    share = good.mean()
    none.base = float(np.log(share / (1 - share)))
    raw, grown = np.full(n, none.base), []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        feature, cut, value, node = grow(binned, p - good, p * (1 - p), n_bins, depth)
        raw = raw + rate * value[node]
        grown.append((feature, upper[feature, cut], rate * value))
    return Forest(none.base, *(np.stack(x) for x in zip(*grown)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, ends in text_slices(batches):
        yield widened(part, {"x": pa.array(list(statistics(data, ends)), pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Forest of the documents (doc_id, text) that `labels` (doc_id, label 0 or 1) names; about `sample` of them are read."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("good"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(min(1.0, sample / max(n, 1)) * 1_000_003))
    texts = docs.select("doc_id", F.col(text).alias("text")).join(drawn, "doc_id")
    measured = map_text(texts, _measured, {"doc_id": texts["doc_id"], "good": texts["good"]}, "text", "x array<double>")
    # One row per label whatever the copies of its document: at most about `sample` rows reach the driver.
    found = measured.groupBy("doc_id").agg(F.min(F.struct("good", "x")).alias("m")).select("doc_id", "m.*").orderBy("doc_id").toArrow()
    rows = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(rows, found.column("good").to_numpy().astype(np.float64))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_slices(batches):
            yield widened(part, {"score": pa.array(shared.value.score(statistics(data, ends)), pa.float64())})
    return run


def classify(df: DataFrame, forest: Forest, text: str = "text", good: float = GOOD) -> DataFrame:
    """doc_id, score, predicted: one row per input row."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scored = map_text(df, _scored(shared), {"doc_id": df["doc_id"]}, text, "score double")
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))
