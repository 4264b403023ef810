"""Expectation-maximisation of motif models, distributed over windows.

One job computes the expected counts of all models over all sequences: tasks score
their windows and send one small row for each model.  Batch EM takes a job an
iteration, or fits models of few columns to counts of words.  Online EM takes seeded mini-batches of sequences with a falling step, so
no task ever holds the whole set; a batch stands for as many single steps as it has
windows.

A model says how sites are spread: any number of them (``ANY``; the rate is a share of
windows), none or one in a sequence (``NONE_OR_ONE``; the rate is a share of sequences),
or exactly one (``ONE``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.packing import PIECE, letters, stretches
from strandloom.operators.scan import TIE, window_scores
from strandloom.operators.tuples import DENSE, packed_counts
from strandloom.storage import saved

#: Weight of the background prior that each step adds to a letter, and where a pass counts as converged.
PRIOR, CONVERGED = 1e-4, 1e-6
#: How sites are spread over sequences.
ANY, NONE_OR_ONE, ONE = "any", "none or one", "one"
#: Steps that are summed one by one; those after them are integrated.
SUMMED = 100_000


@dataclass(frozen=True)
class Model:
    """Motif rows and background over A, C, G, T, the share of windows (or sequences) that are sites, and how they are spread."""

    name: str
    theta: np.ndarray
    background: np.ndarray
    rate: float
    bias: float = 1.0
    rested: bool = False
    spread: str = ANY
    density: float = 0.0

    @property
    def window_rate(self) -> float:
        """Share of windows that are sites, however they are spread (known once the model was fitted)."""
        return self.rate if self.spread == ANY else self.density

    @property
    def width(self) -> int:
        return len(self.theta)


@dataclass(frozen=True)
class Expected:
    """Sums over windows: responsibilities, motif and background letter counts, log likelihood, windows; sequences that have windows; and windows that are rather sites than not."""

    z: float
    motif: np.ndarray
    other: np.ndarray
    log_likelihood: float
    windows: int
    sequences: int = 0
    sites: int = 0


def responsibilities(code: np.ndarray, model: Model, both_strands: bool = True, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z of each window by its better strand, whether that is the reverse one, and the log of its likelihood ratio.

    ``prior`` is a log weight of each window, which scales its chance to be a site."""
    table = np.hstack([np.log(model.theta / model.background), np.full((model.width, 1), -np.inf)])
    forward = window_scores(code, table)
    backward = window_scores(code, np.hstack([table[::-1, 3::-1], table[:, 4:]])) if both_strands else np.full(len(forward), -np.inf)
    return _posteriors(forward, backward, model, prior)


def _posteriors(forward: np.ndarray, backward: np.ndarray, model: Model, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``responsibilities`` from the scores of both strands."""
    score = np.maximum(forward, backward) + np.log(model.bias)
    if prior is not None:
        score = score + prior
    with np.errstate(over="ignore"):
        z = 1 / (1 + np.exp(-(score + np.log(model.rate / (1 - model.rate)))))
    return z, backward > forward + TIE, score


def one_a_sequence(score: np.ndarray, owner: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """z of each window, and the log likelihood ratio of each sequence, where a sequence has at most one site.

    ``score`` are log likelihood ratios of windows, those of one sequence (``owner``) side by side."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    windows = np.diff(np.append(first, len(owner)))
    share = np.log(model.rate / windows) if model.spread == NONE_OR_ONE else -np.log(windows)
    none = np.log1p(-model.rate) if model.spread == NONE_OR_ONE else -np.inf
    terms = score + np.repeat(share, windows)
    top = np.maximum(np.maximum.reduceat(terms, first), none)
    with np.errstate(under="ignore"):
        total = top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, windows)), first) + np.exp(none - top))
        return np.exp(terms - np.repeat(total, windows)), total


#: The least weight of a place, so that its logarithm stays finite.
LEAST_WEIGHT = 1e-300


def place_weights(weights: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Weights of all letters in a row; those of a row whose list is null or not as long as its sequence are one."""
    out = np.ones(offsets[-1])
    held, lengths = weights.flatten().to_numpy(zero_copy_only=False), np.where(weights.is_valid().to_numpy(zero_copy_only=False), np.diff(weights.offsets.to_numpy()), 0)
    fits = lengths == np.diff(offsets)
    inside = np.repeat(fits, lengths)
    out[np.repeat(fits, np.diff(offsets))] = held[inside]
    return out


def stretch_weights(weights: pa.Array, shift: int, size: int) -> np.ndarray:
    """Weights of ``size`` letters of a single long sequence."""
    held = weights.flatten().to_numpy(zero_copy_only=False)[shift : shift + size]
    return held if len(held) == size else np.ones(size)


def least_weight(weights: np.ndarray, width: int) -> np.ndarray:
    """The least weight of each window's places."""
    n = len(weights) - width + 1
    out = weights[:n].copy()
    for j in range(1, width):
        np.minimum(out, weights[j : j + n], out=out)
    return out


def _expected(models: list[Model], both_strands: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0.0, np.zeros((m.width, 4)), np.zeros((m.width, 4)), 0.0, 0, 0, 0] for m in models]
        # Where a sequence has one site at most, its windows depend on one another and it is taken whole.
        long = PIECE if all(m.spread == ANY for m in models) else sys.maxsize
        for batch in batches:
            for part in stretches(batch, 0, max(m.width for m in models) - 1, size=long):
                piece = part.piece
                code, offsets = letters(piece.column(0))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                bad = np.concatenate([[0], np.cumsum(code == 4)])
                weights = None
                if piece.num_columns > 1:
                    held = piece.column(1)
                    weights = place_weights(held, offsets) if part.last is None else stretch_weights(held, part.shift, len(code))
                for model, total in zip(models, sums, strict=True):
                    w = model.width
                    n = len(code) - w + 1
                    if n <= 0:
                        continue
                    known = (owner[:n] == owner[w - 1 :]) & (bad[w:] == bad[:n])
                    prior = None if weights is None else np.log(np.maximum(least_weight(weights, w), LEAST_WEIGHT))
                    z, reverse, score = responsibilities(code, model, both_strands, prior)
                    at = part.own(np.flatnonzero(known))
                    z, reverse, score = z[at], reverse[at], score[at]
                    if not len(at):
                        continue
                    if model.spread == ANY:
                        likelihood = np.logaddexp(np.log(model.rate) + score, np.log(1 - model.rate))
                    else:
                        z, likelihood = one_a_sequence(score, owner[at], model)
                    for j in range(w):
                        own = np.where(reverse, 3 - code[at + w - 1 - j], code[at + j])
                        total[1][j] += np.bincount(own, z, 4)
                        total[2][j] += np.bincount(own, 1 - z, 4)
                    total[0] += z.sum()
                    total[3] += likelihood.sum()
                    total[4] += len(at)
                    total[5] += np.count_nonzero(np.diff(owner[at], prepend=-1))
                    total[6] += np.count_nonzero(z > 0.5)
        rows = [(i, s[0], s[1].ravel().tolist(), s[2].ravel().tolist(), *s[3:]) for i, s in enumerate(sums) if s[4]]
        kinds = [pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["model", "z", "motif", "other", "log_likelihood", "windows", "sequences", "sites"])

    return run


def expected_counts(seqs: DataFrame, models: list[Model], both_strands: bool = True, seq: str = "seq", weights: str | None = None) -> DataFrame:
    """model (its place in ``models``), z, motif, other, log_likelihood, windows, sequences, sites: sums over all windows of known letters.

    ``weights`` names a column with a number from 0 to 1 for each letter; the least of a window's
    scales its chance to be a site."""
    used = seqs.select(F.col(seq)) if weights is None else seqs.select(F.col(seq), F.col(weights).cast("array<double>"))
    rows = used.mapInArrow(_expected(models, both_strands), "model int, z double, motif array<double>, other array<double>, log_likelihood double, windows long, sequences long, sites long")

    def added(column: str, cells: int) -> F.Column:
        return F.array(*(F.sum(F.try_element_at(column, F.lit(k + 1))) for k in range(cells))).alias(column)

    cells = max(4 * m.width for m in models)
    return rows.groupBy("model").agg(F.sum("z").alias("z"), added("motif", cells), added("other", cells), F.sum("log_likelihood").alias("log_likelihood"), *(F.sum(c).alias(c) for c in ("windows", "sequences", "sites")))


def collected(expected: DataFrame, models: list[Model]) -> dict[int, Expected]:
    """One small row for each model, on the driver."""
    out = {}
    for r in expected.collect():
        cells = 4 * models[r["model"]].width
        out[r["model"]] = Expected(r["z"], *(np.array(r[k][:cells], float).reshape(-1, 4) for k in ("motif", "other")), r["log_likelihood"], r["windows"], r["sequences"], r["sites"])
    return out


def maximised(model: Model, sums: Expected) -> Model:
    """The model that fits the expected counts."""
    prior = PRIOR * model.background
    theta = sums.motif + sums.z * prior
    other = (sums.other + (sums.windows - sums.z) * prior).sum(axis=0)
    rate = min(max(sums.z / max(sums.windows if model.spread == ANY else sums.sequences, 1), 1e-12), 1 - 1e-12)
    theta = np.where(theta.sum(axis=1, keepdims=True) > 0, theta, model.theta)
    return replace(model, theta=theta / theta.sum(axis=1, keepdims=True), background=other / other.sum() if other.sum() > 0 else model.background, rate=rate, density=sums.z / max(sums.windows, 1))


def divergence(a: np.ndarray, b: np.ndarray) -> float:
    """Symmetrised Kullback-Leibler divergence of two matrices."""
    return float(0.5 * (np.sum(a * np.log(a / b)) + np.sum(b * np.log(b / a))))


def words_expected(letters_of: np.ndarray, count: np.ndarray, model: Model, both_strands: bool = True) -> Expected:
    """What ``expected_counts`` sums, from each word of known letters (columns of ``letters_of``) and how many windows it fills.

    With any number of sites a window's posterior depends on its word alone."""
    table, w = np.log(model.theta / model.background), model.width
    forward = sum(table[j][letters_of[j]] for j in range(w))
    backward = sum(table[w - 1 - j][3 - letters_of[j]] for j in range(w)) if both_strands else np.full(len(count), -np.inf)
    z, reverse, score = _posteriors(forward, backward, model)
    likelihood = np.logaddexp(np.log(model.rate) + score, np.log(1 - model.rate))
    motif, other = np.zeros((w, 4)), np.zeros((w, 4))
    for j in range(w):
        own = np.where(reverse, 3 - letters_of[w - 1 - j], letters_of[j])
        motif[j], other[j] = np.bincount(own, z * count, 4), np.bincount(own, (1 - z) * count, 4)
    return Expected(float((z * count).sum()), motif, other, float((likelihood * count).sum()), int(count.sum()), sites=int(count[z > 0.5].sum()))


def _fitted_to_words(models: list[Model], words: dict[int, tuple[np.ndarray, np.ndarray]], iterations: int, distance: float, both_strands: bool):
    """EM of the models that a task gets by number, each until it rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                now, moves = models[i], iterations > 0
                packed, count = words[now.width]
                letters_of = np.stack([(packed >> 2 * (now.width - 1 - j) & 3).astype(np.uint8) for j in range(now.width)])
                for _ in range(iterations if len(count) else 0):
                    after = maximised(now, words_expected(letters_of, count, now, both_strands))
                    moves, now = np.linalg.norm(after.theta - now.theta) >= distance, after
                    if not moves:
                        break
                rested = iterations > 0 and not (moves and len(count))
                values = [[i], [now.theta.ravel().tolist()], [now.background.tolist()], [now.rate], [now.density], [bool(rested)]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["model", "theta", "background", "rate", "density", "rested"])

    return run


def _em_of_words(seqs: DataFrame, models: list[Model], iterations: int, distance: float, both_strands: bool) -> list[Model]:
    """``batch_em`` of models of at most ``DENSE`` columns with any number of sites.

    The sequences are read once, to count their words, of which there are at most 4 ** DENSE whatever the data; the
    counts go to the tasks, each of which fits models."""
    spark, widths = seqs.sparkSession, sorted({m.width for m in models})
    counts = packed_counts(seqs, widths).toArrow().sort_by("packed")
    width, packed, count = (counts.column(c).to_numpy() for c in ("width", "packed", "cnt"))
    words = {w: (packed[width == w], count[width == w]) for w in widths}
    rows = spark.range(0, len(models), numPartitions=min(len(models), 4 * spark.sparkContext.defaultParallelism))
    fitted = rows.mapInArrow(_fitted_to_words(models, words, iterations, distance, both_strands), "model long, theta array<double>, background array<double>, rate double, density double, rested boolean")
    out = list(models)
    for r in fitted.collect():
        theta, background = np.array(r["theta"]).reshape(-1, 4), np.array(r["background"])
        out[r["model"]] = replace(models[r["model"]], theta=theta, background=background, rate=r["rate"], density=r["density"], rested=r["rested"])
    return out


def batch_em(seqs: DataFrame, models: list[Model], iterations: int = 50, distance: float = 1e-3, both_strands: bool = True, weights: str | None = None) -> list[Model]:
    """EM of all models together; each stops when its matrix moves less than ``distance``.  ``weights`` as in ``expected_counts``.

    Models of few columns with any number of sites are fitted to counts of words, which takes one pass over the sequences; others take a
    pass an iteration."""
    short = [i for i, m in enumerate(models) if weights is None and m.spread == ANY and m.width <= DENSE]
    now, active = list(models), [i for i in range(len(models)) if i not in set(short)]
    if short:
        for i, m in zip(short, _em_of_words(seqs, [models[i] for i in short], iterations, distance, both_strands), strict=True):
            now[i] = m
    if not active:
        return now
    seqs = saved(seqs.select("seq", *([weights] if weights else [])))
    for _ in range(iterations):
        found = collected(expected_counts(seqs, [now[i] for i in active], both_strands, weights=weights), [now[i] for i in active])
        moving = []
        for place, i in enumerate(active):
            if place in found:
                after = maximised(now[i], found[place])
                if np.linalg.norm(after.theta - now[i].theta) >= distance:
                    moving.append(i)
                now[i] = after
        active = moving
        if not active:
            break
    return [m if i in short else replace(m, rested=i not in active) for i, m in enumerate(now)]


def log_left(step: float, slope: float, begin: int, count: int) -> float:
    """Log of what ``count`` steps from the ``begin``-th leave of the old value: the sum of ln(1 - step * n ** slope) over n.

    The first terms are summed, the others integrated (with the ends' correction), so that
    the cost doesn't grow with the number of steps."""

    def term(n: np.ndarray) -> np.ndarray:
        return np.log1p(-np.minimum(step * n**slope, 0.999))

    first, last = begin + 1, begin + count
    summed = max(0, min(last, SUMMED) - first + 1)
    total = float(term(np.arange(first, first + summed, dtype=float)).sum())
    low = first + summed
    if low > last:
        return total
    nodes, weights = np.polynomial.legendre.leggauss(20)
    for a in np.arange(np.log(low), np.log(last), 1.0):
        b = min(a + 1.0, np.log(last))
        n = np.exp((a + b) / 2 + nodes * (b - a) / 2)
        total += float((weights * term(n) * n).sum() * (b - a) / 2)
    return total + float(term(np.array([low, last], float)).sum() / 2)


@dataclass(frozen=True)
class Averages:
    """What online EM carries along: running means of rate and letter counts, and the windows seen."""

    rate: float
    motif: np.ndarray
    other: np.ndarray
    seen: int = 0

    @classmethod
    def of(cls, model: Model) -> Averages:
        return cls(model.rate, model.theta.copy(), np.tile(model.background, (model.width, 1)))


def online_step(start: Model, now: Model, state: Averages, sums: Expected, step: float, slope: float) -> tuple[Model, Averages]:
    """The model and its averages after a batch: the steps of its windows, compounded towards their mean.  ``start`` is the model at first."""
    weight = -float(np.expm1(log_left(step, slope, state.seen, sums.windows)))
    mean, prior = sums.windows, PRIOR * start.background
    rate = state.rate + weight * (sums.z / (mean if start.spread == ANY else sums.sequences) - state.rate)
    motif = state.motif + weight * ((sums.motif + sums.z * prior) / mean - state.motif)
    other = state.other + weight * ((sums.other + (mean - sums.z) * prior) / mean - state.other)
    background = other.sum(axis=0)
    after = replace(now, theta=motif / motif.sum(axis=1, keepdims=True), background=background / background.sum(), rate=min(max(rate, 1e-12), 1 - 1e-12), density=sums.z / mean)
    return after, Averages(rate, motif, other, state.seen + sums.windows)


def online_em(seqs: DataFrame, models: list[Model], first_step: float = 0.05, decay: float = -0.6, passes: int = 5, batches: int = 8, seed: int = 0, both_strands: bool = True, key: str = "seq_id") -> list[Model]:
    """Online EM by seeded mini-batches.

    The step of the n-th window is step * (n + 1) ** decay; the steps of a batch's
    windows are compounded into one step towards the batch's mean statistics.  The
    decay steepens from pass to pass until the matrix rests.  Sequences are written once, in
    a folder for each batch, and a batch reads only its own."""
    bucketed = saved(seqs.select("seq", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(batches)).alias("__batch")), by="__batch")
    now, active = list(models), set(range(len(models)))
    state = [Averages.of(m) for m in models]
    steps, slopes = [max(first_step, 10 * m.rate) for m in models], [decay] * len(models)
    for _ in range(passes):
        before = [m.theta for m in now]
        for b in range(batches):
            order = sorted(active)
            if not order:
                break
            part = bucketed.where(F.col("__batch") == b)
            found = collected(expected_counts(part, [now[i] for i in order], both_strands), [now[i] for i in order])
            for place, i in enumerate(order):
                if place not in found:
                    continue
                now[i], state[i] = online_step(models[i], now[i], state[i], found[place], steps[i], slopes[i])
        for i in sorted(active):
            if divergence(before[i], now[i].theta) < CONVERGED:
                active.discard(i)
            slopes[i] = (slopes[i] - 1) / 2
    return [replace(m, rested=i not in active) for i, m in enumerate(now)]
