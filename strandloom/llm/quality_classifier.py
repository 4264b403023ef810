"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A pair says that a document labelled 1 beats one labelled 0.  Logistic loss on the
difference of their features gives a weight vector, and so a score for every
document.  The cut lies at the score quantile that the share of label 0 in the
training rows names; a logistic curve through that cut maps scores to 0..1.

All labelled rows outside the held-out fold and all of their pairs count.  Pairs are not
listed: a pair's loss is a smooth function of the difference of two scores, so each row is
spread over the Chebyshev nodes of its score's cell, and nodes meet nodes.  With
``NODES`` a cell that is exact to about the rounding of doubles, and takes time in
proportion to the rows.  Rows stay in a table; tasks add sums of fixed size.

Defined cases: a null or empty text has all-zero statistics and is scored like any
other; a very long text counts whole, in one task's memory; without labels of both kinds
every score is one half; repeated rows and ties in all features get equal scores, and a score
at the cut is predicted 1; an empty table gives an empty result; other columns, whatever their names,
are never read (``keep`` returns them unchanged).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import carried, releasing, saved, slices, with_text
from strandloom.llm.features import PASS_BYTES, RATIOS, held_out, ratios, statistics, training_rows, training_sample  # noqa: F401 (a bounded sample, for rows in memory)

#: Bound of the pairs that ``preference_pairs`` lists (none).
MAX_PAIRS = None
#: Listed pairs of one pass, and cells of scores that meet all others at a time.
BLOCK, CELLS = 20_000, 8
#: Chebyshev nodes of a cell, which is one wide: the loss has its poles pi away, so its interpolation errs by about 12.6 ** -NODES.
NODES = 15
#: Bits of an order statistic that one pass finds.
BITS = 11
#: A score of at least this is predicted as label 1.
CUT = 0.3


@dataclass
class Ranking:
    """Scores are ``basis(x) @ weights``; ``at`` is the score at the cut."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -4, 4)
        return np.hstack([z, np.tanh(2 * z)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.at + np.log(CUT / (1 - CUT)), -40, 40)))


def preference_pairs(label: np.ndarray, max_pairs: int | None = MAX_PAIRS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of winners and losers, to check the fit by: all pairs, or a seeded choice of at most ``max_pairs``."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    winner, loser = np.repeat(good, len(bad)), np.tile(bad, len(good))
    if max_pairs is None or max_pairs >= len(winner):
        return winner, loser
    chosen = np.random.default_rng(seed).permutation(len(winner))[:max_pairs]
    return winner[chosen], loser[chosen]


def pair_loss(weights: np.ndarray, basis: np.ndarray, winner: np.ndarray, loser: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss of the listed pairs' feature differences with its ridge, its gradient and its Hessian, in blocks of pairs: what ``all_pairs`` is checked by."""
    loss, gradient, hessian = 0.0, np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    for begin in range(0, len(winner), BLOCK):
        diff = basis[winner[begin : begin + BLOCK]] - basis[loser[begin : begin + BLOCK]]
        margin = diff @ weights
        loss += np.logaddexp(0, -margin).sum()
        p = np.exp(-np.logaddexp(0, margin))  # probability that the pair is ranked wrongly
        gradient -= diff.T @ p
        hessian += (diff * (p * (1 - p))[:, None]).T @ diff
    n = max(1, len(winner))
    return loss / n + ridge * weights @ weights / 2, gradient / n + ridge * weights, hessian / n + ridge * np.eye(len(weights))


#: Sums by key; those of one key are added, whatever task they come from.
Sums = dict[tuple[int, int], np.ndarray]
#: A function of (x, label) of some rows to their sums.
Kernel = Callable[[np.ndarray, np.ndarray], Sums]
_AT = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_TO_NODES = np.polynomial.chebyshev.chebvander(_AT, NODES - 1).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def shares(score: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Each score's weights at the nodes of its cell."""
    return np.polynomial.chebyshev.chebvander(2 * (score - cell) - 1, NODES - 1) @ _TO_NODES


def moments(score: np.ndarray, basis: np.ndarray, label: np.ndarray) -> Sums:
    """By (label, cell): each node's weight and weighted basis."""
    cell = np.floor(score).astype(np.int64)
    share, values, out = shares(score, cell), np.hstack([np.ones((len(basis), 1)), basis]), {}
    order = np.lexsort((cell, label))
    for rows in np.split(order, 1 + np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(label[order]) != 0))):
        out[int(label[rows[0]]), int(cell[rows[0]])] = share[rows].T @ values[rows]
    return out


def _nodes(found: Sums, label: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Cells of one label, the scores of their nodes, and what lies there."""
    cells = sorted(c for k, c in found if k == label)
    return cells, np.concatenate([c + (_AT + 1) / 2 for c in cells]), np.concatenate([found[label, c] for c in cells])


def all_pairs(weights: np.ndarray, sums: Callable[[Kernel], Sums], basis: Callable[[np.ndarray], np.ndarray], ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """``pair_loss`` of all pairs of a row labelled 1 and one labelled 0, in two passes over the rows."""
    met = sums(lambda x, label: moments((b := basis(x)) @ weights, b, label))
    (cells, at, won), (others, low, lost) = _nodes(met, 1), _nodes(met, 0)
    loss, gradient, cross = 0.0, np.zeros(len(weights)), np.zeros((len(weights), len(weights)))
    bend = {1: np.empty(len(at)), 0: np.zeros(len(low))}  # each node's sum of second derivatives with the other side
    for begin in range(0, len(at), CELLS * NODES):
        own = slice(begin, begin + CELLS * NODES)
        far = at[own, None] - low
        e = np.exp(-np.abs(far))
        wrong, curved = np.where(far > 0, e, 1) / (1 + e), e / (1 + e) ** 2
        loss += won[own, 0] @ (np.log1p(e) + np.maximum(-far, 0)) @ lost[:, 0]
        gradient -= (wrong @ lost[:, 0]) @ won[own, 1:] - (won[own, 0] @ wrong) @ lost[:, 1:]
        cross += won[own, 1:].T @ (curved @ lost[:, 1:])
        bend[1][own] = curved @ lost[:, 0]
        bend[0] += won[own, 0] @ curved
    place = {1: np.array(cells), 0: np.array(others)}

    def bent(x: np.ndarray, label: np.ndarray) -> Sums:
        b = basis(x)
        score, weight = b @ weights, np.zeros(len(b))
        for k in (0, 1):
            rows = np.flatnonzero(label == k)
            # The nearest cell in use, as rounding may lay a score at a border into another cell than it had before.
            i = np.searchsorted((place[k][1:] + place[k][:-1] + 1) / 2, score[rows], side="right")
            weight[rows] = (shares(score[rows], place[k][i]) * bend[k].reshape(-1, NODES)[i]).sum(axis=1)
        return {(0, 0): (b * weight[:, None]).T @ b}

    squares = sums(bent)[0, 0]
    n = won[:, 0].sum() * lost[:, 0].sum()
    return float(loss / n + ridge * weights @ weights / 2), gradient / n + ridge * weights, (squares - cross - cross.T) / n + ridge * np.eye(len(weights))


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (np.asarray(values, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _unordered(key: int) -> float:
    return float(np.array(key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1), np.uint64).view(np.float64))


def order_statistics(sums: Callable[[Kernel], Sums], columns: Callable[[np.ndarray], np.ndarray], wanted: list[tuple[int, int]]) -> list[float]:
    """For each (column, rank from 0) the value of that rank among all rows, found by ``BITS`` a pass."""
    found = [(column, 0, rank) for column, rank in wanted]  # column, leading bits, rank among values that begin with them
    left = 64
    while left:
        step = min(BITS, left)
        left -= step
        targets = {t: i for i, t in enumerate(sorted({f[:2] for f in found}))}

        def counted(x: np.ndarray, label: np.ndarray, left=left, step=step, targets=targets) -> Sums:
            keys, out = _ordered(columns(x)), {}
            for (column, lead), i in targets.items():
                key = keys[:, column] >> np.uint64(left)
                key = key if left + step == 64 else key[key >> np.uint64(step) == np.uint64(lead)]
                out[i, 0] = np.bincount((key & np.uint64((1 << step) - 1)).astype(np.int64), minlength=1 << step).astype(float)
            return out

        upto = {t: np.cumsum(total) for (t, _), total in sums(counted).items()}
        for k, (column, lead, rank) in enumerate(found):
            ahead = upto[targets[column, lead]]
            bin_ = int(np.searchsorted(ahead, rank, side="right"))
            found[k] = (column, lead << step | bin_, rank - int(ahead[bin_ - 1] if bin_ else 0))
    return [_unordered(lead) for _, lead, _ in found]


def fit(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> Ranking:
    """``fitted`` to rows in memory."""
    return fitted(lambda kernel: kernel(x, label), ridge, steps)


def fitted(sums: Callable[[Kernel], Sums], ridge: float = 1e-3, steps: int = 25) -> Ranking:
    """Newton steps on the mean logistic loss of the feature differences of all pairs; ``sums`` adds what a kernel gives over all rows."""
    size = sums(lambda x, label: {(0, 0): np.array([len(x), (label == 0).sum(), (label == 1).sum()], float), (1, 0): x.sum(axis=0)} if len(x) else {})
    rows, bad, good = (int(v) for v in size[0, 0]) if size else (0, 0, 0)
    if not bad or not good:
        return Ranking(np.zeros(len(RATIOS)), np.ones(len(RATIOS)), np.zeros(2 * len(RATIOS)), float(np.log(CUT / (1 - CUT))))
    mean = size[1, 0] / rows
    width = len(mean)
    squares = sums(lambda x, label: {(0, 0): ((x - mean) ** 2).sum(axis=0)})[0, 0]
    middle = order_statistics(sums, lambda x: x, [(f, r) for f in range(width) for r in ((rows - 1) // 2, rows // 2)])
    model = Ranking(np.array(middle).reshape(-1, 2).mean(axis=1), np.maximum(np.sqrt(squares / rows), 1e-6), np.zeros(2 * width), 0.0)
    for _ in range(steps):
        _, gradient, hessian = all_pairs(model.weights, sums, model.basis, ridge)
        step = np.linalg.solve(hessian, gradient)
        model = replace(model, weights=model.weights - step)
        if np.abs(step).max() < 1e-6:
            break
    model.at = float(np.mean(order_statistics(sums, lambda x: model.raw(x)[:, None], [(0, bad - 1), (0, bad)])))
    return model


def added(rows: DataFrame, kernel: Kernel) -> Sums:
    """Sums of a kernel over all of ``rows`` (label, x): tasks add their own, then those of a key meet in one task."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for key, values in kernel(x, batch.column(0).to_numpy(zero_copy_only=False)).items():
                    total[key] = total[key] + values if key in total else values
        yield from _sent(total)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(_received(batches))

    schema = "kind int, cell long, shape array<long>, total array<double>"
    table = rows.select("label", "x").mapInArrow(own, schema).repartition("kind", "cell").mapInArrow(together, schema).toArrow()
    return _received(table.to_batches())


def _sent(total: Sums) -> Iterator[pa.RecordBatch]:
    if total:
        kind, cell = zip(*total, strict=True)
        values = list(total.values())
        columns = [pa.array(kind, pa.int32()), pa.array(cell, pa.int64()), pa.array([v.shape for v in values], pa.list_(pa.int64())), pa.array([v.ravel() for v in values], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "cell", "shape", "total"])


def _received(batches: Iterable[pa.RecordBatch]) -> Sums:
    total: Sums = {}
    for batch in batches:
        for kind, cell, shape, values in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            value = values.values.to_numpy().reshape(shape)
            total[kind, cell] = total[kind, cell] + value if (kind, cell) in total else value
    return total


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled rows outside the held-out fold, and on all of their pairs."""
    rows = saved(training_rows(docs, labels, "quality").select("label", "x"))
    return fitted(lambda kernel: added(rows, kernel))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, size=PASS_BYTES):
                s = model.score(ratios(statistics(piece.column(1))))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Ranking) -> DataFrame:
    """Rows of ``docs`` that are predicted 1, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(with_text, batches):
            for piece in slices(batch, size=PASS_BYTES):
                good = pa.array(model.score(ratios(statistics(piece.column(0)))) >= CUT)
                yield pa.RecordBatch.from_arrays([piece.column(1).filter(good)], names=["row"])

    rows = docs.select(carried(docs))
    return rows.mapInArrow(releasing(run), rows.schema).select("row.*")
