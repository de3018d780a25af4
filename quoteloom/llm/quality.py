"""Operator 2, quality classifier: histogram gradient-boosted trees over document statistics.

``STATISTICS`` are computed from the whole text, vectorised over all documents of a batch. Trees are grown on
quantile bins with logistic loss and flattened into arrays (feature, threshold, left, right, value), so a batch is
scored by numpy steps from level to level, all documents and trees at once.

The model is fitted on at most ``max_rows`` labelled rows (default 20,000), those with the smallest hash of their id,
so it is the same in every run; every document is scored. Only statistics of the text are inputs.

Defined results: null and empty texts are scored by their (zero) statistics; rows with equal ids are scored one by
one; labels that are null, or whose document is missing, are left out; without usable labels every score is 0.5,
with one class it is near that class. Other columns are ignored (``score``) or kept (``keep``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*+=@^~", "bracket": b"()<>[]{}", "slash": b"/\\_-:;", "quote": b"\"'`", "newline": b"\n", "blank": b" \t"}
STATISTICS = [
    "log_bytes", "log_words", "log_lines", *CLASSES, "high", "word_mean", "word_spread", "word_longest", "short_words", "long_words", "capital_words",
    "shouted_words", "marked_words", "distinct_words", "distinct_pairs", "distinct_fives", "line_mean", "line_spread", "line_stopped", "short_lines", "distinct_lines", "bar_lines",
]

_CLASS = np.full(256, len(CLASSES) + 1, np.uint8)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(CLASSES)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*+=@^~|<>{}[]\\")] = True


def statistics(column: pa.Array) -> np.ndarray:
    """rows x STATISTICS of a batch of texts."""
    rows = len(column)
    words, lines = textscan.scan(column), textscan.scan(column, _NEWLINE)
    data, offsets = textscan.raw(column)
    n_bytes, n_words, n_lines = np.diff(offsets), np.bincount(words.row, minlength=rows), np.bincount(lines.row, minlength=rows)
    of_byte = np.repeat(np.arange(rows), n_bytes)
    classes = np.bincount(of_byte * 16 + _CLASS[data], minlength=rows * 16).reshape(rows, 16)[:, : len(CLASSES) + 1]
    share = lambda flags, row, n: np.bincount(row, flags, rows) / np.maximum(n, 1)

    def moments(size, row, n):
        mean = share(size, row, n)
        return mean, np.sqrt(np.maximum(share(size * size, row, n) - mean * mean, 0))

    def distinct(h, row):
        """Share of different values among a row's values."""
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return share(new, row, np.bincount(row, minlength=rows))

    def runs(n):
        h = textscan.roll(words.hash, n)
        whole = words.row[: len(h)] == words.row[n - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
        return distinct(h[whole], words.row[: len(h)][whole])

    def counts(flags, spans):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[spans.end] - total[spans.start]

    size, line_size = (words.end - words.start).astype(float), (lines.end - lines.start).astype(float)
    upper, lower = counts(_UPPER[data], words), counts(_LOWER[data], words)
    longest = np.zeros(rows)
    np.maximum.at(longest, words.row, size)
    word_mean, word_spread = moments(size, words.row, n_words)
    line_mean, line_spread = moments(np.log1p(line_size), lines.row, n_lines)
    ends = np.isin(data[lines.end - 1], list(b".!?")) if len(lines.end) else np.zeros(0, bool)
    out = [
        np.log1p(n_bytes), np.log1p(n_words), np.log1p(n_lines), *(classes / np.maximum(n_bytes, 1)[:, None]).T, word_mean, word_spread, np.log1p(longest),
        share(size <= 3, words.row, n_words), share(size >= 12, words.row, n_words), share(_UPPER[data[words.start]] if len(data) else [], words.row, n_words),
        share((upper > 1) & (lower == 0), words.row, n_words), share(counts(_MARK[data], words) > 0, words.row, n_words), distinct(words.hash, words.row), runs(2), runs(5),
        line_mean, line_spread, share(ends, lines.row, n_lines), share(line_size < 30, lines.row, n_lines), distinct(lines.hash, lines.row), share(counts(data == 0x7C, lines) > 2, lines.row, n_lines),
    ]
    return np.stack(out, axis=1).astype(np.float64)


class Trees(NamedTuple):
    """All trees in flat arrays; a leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1; all trees go down one level a step."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosted trees; each level of a tree is chosen from one histogram over (node, feature, bin)."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, width), np.int64)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    raw = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        roots.append(len(feature))

        def node(rows):
            feature.append(0)
            threshold.append(np.inf)
            left.append(len(left))
            right.append(len(right))
            value.append(rate * gradient[rows].sum() / (weight[rows].sum() + ridge))
            raw_of.append(rows)
            return len(feature) - 1

        raw_of: list[np.ndarray] = []
        level = [node(np.arange(n))]
        for _ in range(depth):
            following = []
            for at in level:
                rows = raw_of[at - roots[-1]]
                if len(rows) < 2 * least:
                    continue
                slot = (binned[rows] + np.arange(width) * bins).ravel()
                table = lambda w: np.bincount(slot, np.repeat(w, width), width * bins).reshape(width, bins).cumsum(axis=1)  # noqa: B023, E731
                g, h, c = table(gradient[rows]), table(weight[rows]), table(np.ones(len(rows)))
                g_all, h_all = g[0, -1], h[0, -1]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain[(c < least) | (len(rows) - c < least)] = -1
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                low = binned[rows, j] <= b
                feature[at], threshold[at] = int(j), float(cuts[j][b])
                left[at], right[at] = node(rows[low]), node(rows[~low])
                following += [left[at], right[at]]
            level = following
        for k, rows in enumerate(raw_of):
            if left[roots[-1] + k] == roots[-1] + k:
                raw[rows] += value[roots[-1] + k]
    return Trees(np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), base if n else 0.0, depth)


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fits on at most ``max_rows`` labels of documents that aren't held out; of documents of one id, on the least statistics."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for piece in textscan.pieces(batch, "text", textscan.PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["quality"], pa.array(list(statistics(piece["text"])), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = texts.mapInArrow(run, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # a row a label
    x = np.array(found["x"].to_list(), np.float64).reshape(len(found), len(STATISTICS))
    y = found["quality"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y, found["doc_id"].to_numpy(np.int64)))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for batch in batches:
            for piece in textscan.pieces(batch, "text", textscan.PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([piece["doc_id"], pa.array(model.score(statistics(piece["text"])))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""

    def run(batches):
        for batch in batches:
            for piece in textscan.pieces(batch, "text", textscan.PIECE_BYTES):
                good = model.score(statistics(piece["text"])) >= threshold
                yield piece.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
