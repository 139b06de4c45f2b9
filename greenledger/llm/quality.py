"""Document quality by histogram gradient-boosted trees over text statistics.

The statistics of each whole text are a row of numbers. Trees are grown on the binned statistics of a bounded sample
of labelled documents, level by level from gradient histograms, and kept as arrays: complete binary trees in heap
order, so that all rows go down all trees together by indexing.

Defined cases: a null text is an empty one and gets a score like any other; without labels every score is 0.5, with
one class it is near that class; repeated rows each get a row; an empty table gives an empty result; labels, language,
source and id are never features; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .labelled import fit_sample, held_out

#: Labelled documents the trees are grown on, at most.
FIT_ROWS = 20_000
ROUNDS = 80
DEPTH = 4
BINS = 64
RATE = 0.15
LEAF_ROWS = 20
L2 = 1.0
FOLDS, HELD_OUT = 3, 1

FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "lower", "digits", "spaces", "newlines",
    "symbols", "marks", "stops", "pipes", "exclamations", "others", "distinct_words", "top_word", "same_as_previous",
    "repeated_lines", "line_words", "symbol_words", "upper_words", "window_repeats",
)

# Classes of the characters up to 255; every later character is a letter here.
_CLASS = np.full(256, 5, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v",
                             "\n")):
    _CLASS[[ord(c) for c in _chars]] = _k
for _k, _chars in ((6, "#*$%&<>@^~=+\\{}[]_"), (7, ",;:'\"()-/?"), (8, "."), (9, "|"), (10, "!")):
    _CLASS[[ord(c) for c in _chars]] = _k
_SYMBOL_END = re.compile(rb"[#*$%&|<>!]$")


def statistics_of(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    chars = max(len(codes), 1)
    kinds = np.bincount(_CLASS[np.minimum(codes, 255)], minlength=11) / chars
    words = text.encode("utf-8", "replace").split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in text.split("\n") if line]
    pairs = list(zip(words, words[4:], strict=False))
    return [
        np.log1p(len(codes)), np.log1p(len(words)), lengths.mean(), lengths.std(), *kinds[:5].tolist(),
        kinds[6], kinds[7], kinds[8], kinds[9], kinds[10], kinds[5],
        len(counts) / n, max(counts.values(), default=0) / n, same / n,
        1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
        sum(m for w, m in counts.items() if _SYMBOL_END.search(w)) / n,
        sum(m for w, m in counts.items() if w.isupper() and len(w) > 1) / n,
        1 - len(set(pairs)) / max(len(pairs), 1),
    ]


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` have a row per tree and a column per inner node in heap order; a row goes right
    when its value is above the threshold. ``leaf`` has a column per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(rows), self.start)
        if len(self.feature):
            trees = np.arange(len(self.feature))
            inner = self.feature.shape[1]
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                node = np.zeros((len(part), len(trees)), np.int64)
                line = np.arange(len(part))[:, None]
                for _ in range((inner + 1).bit_length() - 1):
                    right = part[line, self.feature[trees, node]] > self.threshold[trees, node]
                    node = 2 * node + 1 + right
                total[at : at + 4096] += self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Boosted trees for the log-loss of ``labels`` (0 or 1)."""
    inner = 2**DEPTH - 1
    none = np.zeros((0, inner))
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (n + 1)
        return Trees(none.astype(np.int64), none, np.zeros((0, inner + 1)), float(np.log(share / (1 - share))))
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    offsets = np.arange(width) * BINS
    share = labels.mean()
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        gradient, curvature = p - labels, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + offsets + binned).ravel()
            shape = (many, width, BINS)

            def histogram(weights: np.ndarray | None, cell=cell, shape=shape) -> np.ndarray:
                spread = None if weights is None else np.repeat(weights, width)
                return np.bincount(cell, spread, minlength=np.prod(shape)).reshape(shape).cumsum(axis=2)

            g, h, c = histogram(gradient), histogram(curvature), histogram(None)
            gain = (
                g**2 / (h + L2)
                + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + L2)
                - g[:, :, -1:] ** 2 / (h[:, :, -1:] + L2)
            )
            gain[(c < LEAF_ROWS) | (c[:, :, -1:] - c < LEAF_ROWS)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for i, cut in enumerate(best):
                f, b = divmod(int(cut), BINS)
                if gain[i, f, b] > 0 and b < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][b]
            right = rows[np.arange(n), feature[node]] > threshold[node]
            node = 2 * node + 1 + right
        g = np.bincount(node - inner, gradient, inner + 1)
        h = np.bincount(node - inner, curvature, inner + 1)
        leaf = -RATE * g / (h + L2)
        score += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Trees from a sample of the labelled documents that are not held out; at most ``rows`` feature rows are gathered."""
    sample = fit_sample(docs, labels, label, ~held_out(id_col, FOLDS, HELD_OUT), rows, id_col, text)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [statistics_of(t) for t in batch[text]], "y": batch[label].to_numpy()})

    got = sample.mapInPandas(measure, "x array<double>, y int").toPandas()
    # Another order of the rows would change sums in their last digits.
    found = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["y"].to_numpy(float)
    order = np.lexsort((y, *found.T))
    return fit_trees(found[order], y[order])


def score_quality(docs: DataFrame, trees: Trees, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  name: str = "score") -> DataFrame:
    """``keep`` and the score, called ``name``, of every row; only these columns and the text go to Python."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([statistics_of(t) for t in batch[text]], float).reshape(len(batch), len(FEATURES))
            yield batch[list(keep)].assign(**{name: trees.scores(found)})

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{name}` double"
    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*columns).mapInPandas(score, schema)
