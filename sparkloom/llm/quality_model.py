"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned by quantiles. Cyclic boosting visits one feature after another and fits a
shallow tree on the residuals of that feature alone, adding its leaves to the feature's lookup table; afterwards the
pairs of features that explain most of what is left get two-dimensional tables by trees over both features. A score is a sum of
table entries: vectorised additions over bins.

Defined cases: null and empty texts have features of an empty text and a score; a null label is no label; rows
without a label are scored only; without labels of both classes every score is the base rate (0.5 without any);
repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import byte_view, prefix_sums, small_batches, span_hash, steps, text_or_empty
from sparkloom.llm.toxicity import Sample, crc_mod, labelled_sample

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "marks", "bars", "other_punct", "high_bytes", "lines_per_word",
    "distinct_words", "repeat_next", "log_longest_word", "upper_start",
)

_LOWER, _UPPER, _DIGIT, _SYMBOL, _MARK, _BAR, _PUNCT, _HIGH, _SPACE, _LINE = range(10)
CLASSES = np.full(256, _PUNCT, np.uint8)
CLASSES[97:123] = _LOWER
CLASSES[65:91] = _UPPER
CLASSES[48:58] = _DIGIT
CLASSES[[ord(c) for c in "#*$%&<>{}\\^~=_@+"]] = _SYMBOL
CLASSES[[ord(c) for c in "!?"]] = _MARK
CLASSES[ord("|")] = _BAR
CLASSES[128:] = _HIGH
CLASSES[[9, 11, 12, 13, 32]] = _SPACE
CLASSES[10] = _LINE
BASE = 0x9E3779B97F4A7C15 | 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each string of ``data`` that ``offsets`` marks out."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    for first, last in steps(offsets):
        out[first:last] = _some_features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
    return out


def _some_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    kinds = CLASSES[data]
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * 10 + kinds, minlength=10 * n).reshape(n, 10).astype(float)
    space = kinds >= _SPACE
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][sizes > 0]
    begins[heads] = ~space[heads]
    ends = ~space
    ends[:-1] &= space[1:]
    tails = offsets[1:][sizes > 0] - 1
    ends[tails] = ~space[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = doc[starts]
    words = np.bincount(owner, minlength=n).astype(float)
    hashes = span_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1), BASE), starts, stops, BASE)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n).astype(float)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, owner, (stops - starts).astype(float))
    chars = np.maximum(sizes.astype(float), 1)
    some = np.maximum(words, 1)
    return np.column_stack([
        np.log1p(words), counts[:, :_SPACE].sum(1) / some, counts[:, _UPPER] / chars, counts[:, _DIGIT] / chars, counts[:, _SYMBOL] / some,
        counts[:, _MARK] / some, counts[:, _BAR] / some, counts[:, _PUNCT] / some, counts[:, _HIGH] / chars, counts[:, _LINE] / some,
        distinct / np.sqrt(some), np.bincount(owner[again], minlength=n) / some, np.log1p(longest),
        np.bincount(owner[kinds[starts] == _UPPER], minlength=n) / some,
    ])


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``pairs`` holds two-dimensional tables over coarser bins."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, j], side="right")]
        for (i, j), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


BINS, COARSE, ROUNDS, RATE, LEAVES, N_PAIRS, PAIR_ROUNDS, LEAST_LEAF = 64, 8, 60, 0.1, 4, 6, 30, 20


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """Leaf values over ordered bins: the best splits first, until there are ``leaves`` leaves."""
    g, w, c = (np.concatenate([[0.0], np.cumsum(v)]) for v in (gradient, weight, rows))
    gain_of = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)

    def best(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        at = at[(c[at] - c[a] >= least) & (c[b] - c[at] >= least)]
        if not len(at):
            return 0.0, -1
        gains = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
        k = int(np.argmax(gains))
        return float(gains[k]), int(at[k])

    cuts = [0, len(gradient)]
    while len(cuts) <= leaves:
        found = max((best(a, b) for a, b in zip(cuts, cuts[1:], strict=False)), default=(0.0, -1))
        if found[0] <= 1e-9:
            break
        cuts = sorted([*cuts, found[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Leaf values over a table of cells: one cut of each feature, the best two together, make four leaves.

    Both cuts are chosen at once, since each alone may tell nothing. A leaf of fewer rows than ``least`` stays at nothing.
    """
    a, b = gradient.shape
    sums = np.zeros((3, a + 1, b + 1))
    sums[:, 1:, 1:] = np.stack([gradient, weight, rows]).cumsum(axis=1).cumsum(axis=2)
    cut = sums[:, 1:a, 1:b]
    if not cut.size:
        return np.zeros((a, b))
    right, below, every = sums[:, 1:a, b:] - cut, sums[:, a:, 1:b] - cut, sums[:, a:, b:]
    leaves = np.stack([cut, right, below, every - cut - right - below])
    values = np.where(leaves[:, 2] >= least, leaves[:, 0] / (leaves[:, 1] + 1.0), 0.0)
    i, j = np.unravel_index((values * leaves[:, 0]).sum(axis=0).argmax(), cut.shape[1:])
    out = np.empty((a, b))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values[:, i, j]
    return out


def fit(x: np.ndarray, y: np.ndarray, totals: tuple[int, int] | None = None) -> AdditiveModel:
    """Cyclic boosting of single features, then of the strongest pairs. Classes weigh equally; then ``totals``, the true sizes of both classes, set the rate."""
    n, n_features = x.shape
    ones = y.sum()
    zeros_all, ones_all = totals or (n - ones, ones)
    if n == 0 or ones == 0 or ones == n:
        rate = (ones_all + 0.5) / (zeros_all + ones_all + 1)
        none = [np.zeros(0)] * n_features
        return AdditiveModel(float(np.log(rate / (1 - rate))), none, [np.zeros(1)] * n_features, none)
    scale = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    model = AdditiveModel(0.0, [_edges(x[:, j], BINS) for j in range(n_features)], coarse=[_edges(x[:, j], COARSE) for j in range(n_features)])
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    margin = np.zeros(n)

    def parts() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return scale * (y - p), scale * p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            gradient, weight = parts()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, gradient, size), np.bincount(b, weight, size), rows[j], LEAVES, LEAST_LEAF)
            model.tables[j] += step
            margin += step[b]

    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def cells(i: int, j: int, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rough[i] * sizes[j] + rough[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    gradient, weight = parts()
    gains = {(i, j): float((cells(i, j, gradient) ** 2 / (cells(i, j, weight) + 5.0)).sum()) for i in range(n_features) for j in range(i)}
    for pair in sorted(gains, key=lambda k: (-gains[k], k))[:N_PAIRS]:
        model.pairs[pair] = np.zeros((sizes[pair[0]], sizes[pair[1]]))
    for _ in range(PAIR_ROUNDS):
        for (i, j), values in model.pairs.items():
            gradient, weight = parts()
            step = RATE * _pair_tree(cells(i, j, gradient), cells(i, j, weight), cells(i, j), LEAST_LEAF)
            values += step
            margin += step[rough[i], rough[j]]
    model.bias += float(np.log(max(ones_all, 1) / max(zeros_all, 1)))  # back from equal classes to the true rate
    return model


#: Bound of the labelled rows that training reads.
SAMPLE_ROWS = 12_000


def features_of(texts: list[str]) -> np.ndarray:
    return features(*byte_view(pa.array(texts, pa.string()))) if texts else np.zeros((0, len(FEATURES)))


def train(sample: Sample) -> AdditiveModel:
    return fit(features_of([t for t, _ in sample.rows]), np.array([y for _, y in sample.rows], dtype=float), sample.totals)


def scored(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and the score of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(features(*byte_view(batch.column("_t"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("_t")).mapInArrow(run, f"doc_id {kind}, score double")


HELD_OUT_MOD, HELD_OUT_REST, CUT = 3, 1, 0.5


def op8_quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT_REST
    model = train(labelled_sample(docs, labels, "quality", held_out, SAMPLE_ROWS))
    return scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
