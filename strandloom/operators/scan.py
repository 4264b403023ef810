"""Motif scans: scores of windows, sites, erasing, and classification by scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.ordered import running_totals
from strandloom.operators.packing import letters, pieces, raw_letters, stretches

Matrix = Sequence[Sequence[float]]
#: Scores of both strands this close are a tie, which the plus strand wins.
TIE = 1e-9
#: Complements of IUPAC letters by byte; other bytes stay.
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGTURYKMBVDHSWN")] = list(b"TGCAAYRMKVBHDSWN")


def window_scores(code: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum of ``matrix[j, letter]`` over each window's letters; its fifth column stands for unknown letters."""
    width = len(matrix)
    n = len(code) - width + 1
    total = np.zeros(max(n, 0))
    for j in range(width):
        total += matrix[j][code[j : j + n]]
    return total


def _matrices(log_odds: Matrix) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and its reverse complement, with minus infinity for unknown letters."""
    own = np.asarray(log_odds, float)
    unknown = np.full((len(own), 1), -np.inf)
    return np.hstack([own, unknown]), np.hstack([own[::-1, ::-1], unknown])


@dataclass(frozen=True)
class _Scored:
    """Scores of all windows of some sequences in a row; ``known`` are the places of windows of known letters in one sequence."""

    code: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray
    best: np.ndarray
    reverse: np.ndarray
    known: np.ndarray


def _scored(texts: pa.Array, forward: np.ndarray, backward: np.ndarray, both_strands: bool) -> _Scored:
    code, offsets = letters(texts)
    owner, width = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), len(forward)
    if len(code) < width:
        none = np.zeros(0)
        return _Scored(code, offsets, owner, none, none.astype(bool), none.astype(int))
    one = window_scores(code, forward)
    two = window_scores(code, backward) if both_strands else np.full(len(one), -np.inf)
    best = np.maximum(one, two)
    known = np.flatnonzero((owner[: len(one)] == owner[width - 1 :]) & (best > -np.inf))
    return _Scored(code, offsets, owner, best, two > one + TIE, known)


def owners_of_hits(texts: pa.Array, log_odds: Matrix, threshold: float) -> np.ndarray:
    """The number of the string that holds each window above ``threshold``."""
    found = _scored(texts, *_matrices(log_odds), True)
    return found.owner[found.known[found.best[found.known] > threshold]]


def greedy(at: np.ndarray, width: int) -> np.ndarray:
    """Of rising places those that a pass from the left keeps: each at least ``width`` after the last kept one."""
    following = np.searchsorted(at, at + width).tolist()
    kept, k = [], 0
    while k < len(following):
        kept.append(k)
        k = following[k]
    return at[kept]


def local_maxima(score: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Of rising places ``at`` those whose score no place of the same owner within ``width`` - 1 beats; the first of equal ones.

    ``score`` and ``owner`` are by place; places not in ``at`` don't compete."""
    own = np.full(len(score), -np.inf)
    own[at] = score[at]
    stands = np.zeros(len(score), bool)
    stands[at] = True
    for d in range(1, width):
        if d >= len(own):
            break
        same = owner[d : len(own)] == owner[: len(own) - d]
        stands[d:] &= ~(same & (own[:-d] >= own[d:]))
        stands[:-d] &= ~(same & (own[d:] > own[:-d]))
    return np.flatnonzero(stands)


def _texts(raw: np.ndarray, places: np.ndarray, inside: np.ndarray, turned: np.ndarray) -> pa.Array:
    """Strings of the letters at each row's ``places`` that are ``inside``, complemented where ``turned``."""
    taken = raw[np.where(inside, places, 0)]
    taken = np.where(turned[:, None], _COMPLEMENT[taken], taken)[inside]
    ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(taken)))


def _scan(log_odds: Matrix, threshold: float | None, both_strands: bool, apart: bool, words: bool, flank: int, peaks: bool = False):
    forward, backward = _matrices(log_odds)
    width = len(forward)
    behind = max(flank, width - 1 if peaks else 0)
    names = ["seq_id", "start", "strand", "score", *(["word"] if words else []), *(["left", "right"] if flank else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = 0  # where the next hit of a long sequence may start, if hits are to lie apart
        for batch in batches:
            for part in stretches(batch, 1, width - 1 + behind, behind):
                piece, free = part.piece, 0 if part.begins else free
                found = _scored(piece.column(1), forward, backward, both_strands)
                at = local_maxima(found.best, found.known, found.owner, width) if peaks else found.known
                at = part.own(at if threshold is None else at[found.best[at] > threshold])
                if apart:
                    at = greedy(at[at + part.shift >= free], width)
                    free = int(at[-1]) + part.shift + width if len(at) else free
                owner, reverse = found.owner[at], found.reverse[at]
                begin, end = found.offsets[owner], found.offsets[owner + 1]
                strand = pa.array(np.where(reverse, "-", "+").astype(object), pa.string())
                columns = [piece.column(0).take(pa.array(owner)), pa.array((at - begin + part.shift).astype(np.int64)), strand, pa.array(found.best[at])]
                if words or flank:
                    raw, j = raw_letters(piece.column(1))[0], np.arange(width)
                if words:
                    columns.append(_texts(raw, at[:, None] + np.where(reverse[:, None], j[::-1], j), np.ones((len(at), width), bool), reverse))
                if flank:
                    k = np.arange(flank)
                    before, after = at[:, None] - flank + k, at[:, None] + width + k
                    for one, other in ((before, after), (after, before)):
                        places = np.where(reverse[:, None], other[:, ::-1], one)
                        columns.append(_texts(raw, places, (places >= begin[:, None]) & (places < end[:, None]), reverse))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def hits(
    seqs: DataFrame, log_odds: Matrix, threshold: float | None, both_strands: bool = True, apart: bool = False, words: bool = False, flank: int = 0, key: str = "seq_id", seq: str = "seq", peaks: bool = False
) -> DataFrame:
    """seq_id, start, strand, score of every window of known letters with a score above ``threshold``.

    A window counts once, by its better strand.  ``apart`` keeps the hits of a greedy pass
    from the left that don't overlap; ``peaks`` those that no window within a width beats (the first of equal ones).  ``words`` adds a hit's letters in motif orientation, and
    ``flank`` the letters ``left`` and ``right`` of it.  All of it is found where the sequence is;
    rows that fail never leave the task."""
    kind = seqs.schema[key].dataType.simpleString()
    schema = f"seq_id {kind}, start long, strand string, score double" + ", word string" * words + ", left string, right string" * (flank > 0)
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(_scan(log_odds, threshold, both_strands, apart, words, flank, peaks), schema)


def bayes_threshold(rate: float) -> float:
    """ln((1 - rate) / rate); infinite for a rate below 1e-9."""
    return float(np.log((1 - rate) / rate)) if rate >= 1e-9 else np.inf


def sites(seqs: DataFrame, log_odds: Matrix, rate: float, **options) -> DataFrame:
    """Windows above the Bayes threshold; none for a rate below 1e-9."""
    return hits(seqs, log_odds, bayes_threshold(rate), **options)


def best_scores(seqs: DataFrame, log_odds: Matrix, both_strands: bool = True, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """Each row's best window score; rows without a window of known letters have none."""
    forward, backward = _matrices(log_odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                found = _scored(piece.column(1), forward, backward, both_strands)
                owner = found.owner[found.known]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                best = np.maximum.reduceat(found.best[found.known], first) if len(first) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner[first])), pa.array(best)], names=["seq_id", "score"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, score double")


def goodness(pfm: Matrix, background: Sequence[float]) -> list[list[float]]:
    """Log-odds divided by their best sum, so that a perfect window scores one."""
    table = np.log(np.asarray(pfm, float) / np.asarray(background, float))
    return (table / table.max(axis=1).sum()).tolist()


def erased(seqs: DataFrame, log_odds: Matrix, rate: float, both_strands: bool = True, seq: str = "seq") -> DataFrame:
    """``seqs`` with the sites of a greedy pass from the left written as N, and ``erased`` as their number.

    The scan masks a sequence where it is; nothing is shuffled."""
    forward, backward = _matrices(log_odds)
    width, threshold = len(forward), bayes_threshold(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(seq)
            for piece in pieces(batch, place):
                texts = piece.column(place)
                raw, offsets = raw_letters(texts)
                raw, owners, free = raw.copy(), [], 0
                for part in stretches(piece, place, width - 1):
                    found = _scored(part.piece.column(place), forward, backward, both_strands)
                    at = part.own(found.known[found.best[found.known] > threshold])
                    at = greedy(at[at + part.shift >= free], width)
                    free = int(at[-1]) + part.shift + width if len(at) and part.last is not None else free
                    raw[(at[:, None] + part.shift + np.arange(width)).ravel()] = ord("N")
                    owners.append(found.owner[at])
                masked = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
                masked = pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), masked)
                counts = np.bincount(np.concatenate(owners), minlength=len(texts)).astype(np.int32)
                yield piece.set_column(place, seq, masked).append_column("erased", pa.array(counts))

    return seqs.mapInArrow(run, T.StructType([*seqs.schema.fields, T.StructField("erased", T.IntegerType())]))


def soft_weights(seqs: DataFrame, log_odds: Matrix, rate: float, both_strands: bool = True, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id and ``weights``: for each place of a sequence, one minus the largest posterior of the windows that cover it.

    All windows of known letters count; a place that none covers weighs one."""
    forward, backward = _matrices(log_odds)
    width, prior = len(forward), float(np.log(rate / (1 - rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                found = _scored(piece.column(1), forward, backward, both_strands)
                largest = np.zeros(len(found.code))
                with np.errstate(over="ignore"):
                    z = 1 / (1 + np.exp(-(found.best[found.known] + prior)))
                for j in range(width):
                    own = found.known + j
                    largest[own] = np.maximum(largest[own], z)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(1 - largest))], names=["seq_id", "weights"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, weights array<double>")


def softly_erased(seqs: DataFrame, model, both_strands: bool = True, seq: str = "seq", weights: str = "weights") -> DataFrame:
    """``seqs`` with ``weights``: what a letter had (one, without such a column) times one minus the largest posterior of the windows that cover it.

    Posteriors of a model (as in ``em``) take the weights so far into account."""
    # em builds on this module.
    from strandloom.operators.em import LEAST_WEIGHT, least_weight, place_weights, responsibilities

    base = seqs if weights in seqs.columns else seqs.withColumn(weights, F.lit(None).cast("array<double>"))
    base = base.withColumn(weights, F.col(weights).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, held = batch.schema.get_field_index(seq), batch.schema.get_field_index(weights)
            for piece in pieces(batch, place):
                code, offsets = letters(piece.column(place))
                owner, w = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), model.width
                before, largest = place_weights(piece.column(held), offsets), np.zeros(len(code))
                n = len(code) - w + 1
                if n > 0:
                    z = responsibilities(code, model, both_strands, np.log(np.maximum(least_weight(before, w), LEAST_WEIGHT)))[0]
                    bad = np.concatenate([[0], np.cumsum(code == 4)])
                    z = np.where((owner[:n] == owner[w - 1 :]) & (bad[w:] == bad[:n]), z, 0.0)
                    for j in range(w):
                        np.maximum(largest[j : j + n], z, out=largest[j : j + n])
                after = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(before * (1 - largest)))
                yield piece.set_column(held, weights, after)

    return base.mapInArrow(run, base.schema)


def roc(scores: DataFrame) -> DataFrame:
    """Threshold of least error, that error and the normalised area under the curve.

    ``scores`` has score and positive (boolean).  Rows of one score are first
    aggregated; running totals then go over distinct scores."""
    by_score = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    ranked = running_totals(by_score, "score", ["p", "n"], descending=True)
    err = F.col("all_p") - F.col("upto_p") + F.col("upto_n")
    rows = ranked.select("score", "p", "n", F.col("upto_p").alias("tp"), F.col("all_p").alias("np"), F.col("all_n").alias("nneg"), err.alias("err"))
    # Within one score negatives come first, so its area is that of a step.
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p"))) / (F.first("np") * F.first("nneg"))
    best = rows.groupBy("err").agg(F.max("score").alias("high"), F.min("score").alias("last"))
    margin = F.min(F.when(F.col("p") > 0, F.col("score"))) - F.max(F.when(F.col("n") > 0, F.col("score")))
    summary = rows.agg(area.alias("area"), margin.alias("margin"), F.min("err").alias("err"), F.first("np").alias("positives"), F.first("nneg").alias("negatives"))
    chosen = summary.join(best, "err")
    # The threshold lies midway between the best range and the next score below it.
    below = by_score.join(F.broadcast(chosen.select("last")), F.col("score") < F.col("last")).agg(F.max("score").alias("below"))
    auc = F.when(F.col("area") == 1, F.col("area") + F.col("margin")).otherwise(F.col("area"))
    return chosen.join(F.broadcast(below)).select("positives", "negatives", "err", ((F.col("high") + F.coalesce("below", "last")) / 2).alias("threshold"), auc.alias("auc"))


def mixing_grid(scores: DataFrame, steps: int = 100, window: int = 2) -> DataFrame:
    """q and smoothed error for thresholds at each of ``steps`` shares of the score range.

    ``steps`` is a stated grid; scores are counted by bin first, so the grid meets
    bins and not rows."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = F.col("high") - F.col("low")
    binned = scores.join(F.broadcast(ends)).withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("score") - F.col("low")) / width * steps), F.lit(steps - 1))).otherwise(0))
    counts = binned.groupBy("bin").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    grid = scores.sparkSession.range(steps).select(F.col("id").alias("bin"))
    full = grid.join(counts, "bin", "left").fillna(0, ["p", "n"])
    below, above = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    errors = full.select("bin", (F.col("bin") / steps).alias("q"), (F.coalesce(F.sum("p").over(below), F.lit(0)) + F.sum("n").over(above)).alias("err"))
    near = Window.orderBy("bin").rowsBetween(-window, window)
    return errors.select("q", "err", F.avg("err").over(near).alias("smoothed"))
