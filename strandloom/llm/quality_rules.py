"""Quality rules: thresholds on document statistics, then boosted trees over them.

Trees are grown on a bounded sample of labelled rows with logistic loss on binned
features.  On features listed in ``MONOTONE`` the score may only fall as the
feature rises: a split there must order its children's values, and both subtrees
are held on their side of the midpoint.  All trees are flattened into numpy node
arrays, and a batch walks all of them level by level.

Defined cases: a null text has no words and fails the base rules; a very long text counts
whole, in one task's memory; without labels of both kinds the trees keep everything that
the base rules keep; repeated rows and ties in all features get equal results, and a
probability at ``KEEP_AT`` is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import slices
from strandloom.llm.features import PASS_BYTES, RATIOS, ratios, statistics, training_sample

#: Bound of the labelled rows that training reads.
MAX_LABELLED = 20_000
#: Features on which a higher value never helps a document.
MONOTONE = ("symbols_per_word", "symbol_symbol", "mark_mark", "upper_share", "repeat_share", "dup_line_share")
#: Base rules: least words, and the largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents at or above this probability of label 1 are kept.
KEEP_AT = 0.3


@dataclass
class Forest:
    """Trees as rows of node arrays; a leaf points to itself.  The score is the sum of leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(nodes + 1)) - 1):
            low = x[row, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(low, self.left[tree, at], self.right[tree, at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[tree, at].sum(axis=1), -40, 40)))


def fit(x: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, monotone: tuple[str, ...] = MONOTONE) -> Forest:
    """Grow ``trees`` trees of full ``depth`` with Newton leaf values."""
    nodes = 2 ** (depth + 1) - 1
    own = np.arange(nodes)
    forest = Forest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.tile(own, (trees, 1)), np.tile(own, (trees, 1)), np.zeros((trees, nodes)), 40.0)
    if not ((label == 0).any() and (label == 1).any()):
        return forest
    falls = np.array([name in monotone for name in RATIOS])[: x.shape[1]]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    share = label.mean()
    forest.base = float(np.log(share / (1 - share)))
    total = np.full(len(x), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = label - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for k in range(nodes):
            rows = np.flatnonzero(node == k)
            g, h = gradient[rows].sum(), hessian[rows].sum()
            forest.value[t, k] = rate * np.clip(g / (h + ridge), low[k], high[k])
            if k >= nodes // 2 or len(rows) < 2:
                continue
            best = (1e-6, -1, -1, 0.0, 0.0)
            for f in range(x.shape[1]):
                n = len(edges[f])
                if not n:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], n + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], hessian[rows], n + 1))[:-1]
                vl, vr = (np.clip(a / (b + ridge), low[k], high[k]) for a, b in ((gl, hl), (g - gl, h - hl)))
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                ok = (hl > 1e-3) & (h - hl > 1e-3) & (~falls[f] | (vl >= vr))
                gain = np.where(ok, gain, -np.inf)
                b = int(gain.argmax())
                if gain[b] > best[0]:
                    best = (float(gain[b]), f, b, float(vl[b]), float(vr[b]))
            _, f, b, vl, vr = best
            if f < 0:
                continue
            forest.feature[t, k], forest.threshold[t, k] = f, edges[f][b]
            forest.left[t, k], forest.right[t, k] = 2 * k + 1, 2 * k + 2
            for child in (2 * k + 1, 2 * k + 2):
                low[child], high[child] = low[k], high[k]
            if falls[f]:
                low[2 * k + 1] = high[2 * k + 2] = (vl + vr) / 2
            node[rows] = np.where(x[rows, f] <= edges[f][b], 2 * k + 1, 2 * k + 2)
        total = total + forest.value[t, node]
    return forest


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Forest:
    return fit(*training_sample(docs, labels, "quality", max_labelled))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the base statistics, base_failed, probability and kept for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PASS_BYTES):
                s = statistics(piece.column(1))
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                p = forest.probability(ratios(s))
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(s[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_AT))],
                    names=["doc_id", *names, "base_failed", "probability", "kept"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")
