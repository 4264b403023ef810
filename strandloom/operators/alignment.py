"""Global alignment of sequences to a scoring matrix, with affine gaps; star alignments of many.

An alignment is where each column of the matrix stands: a place in the sequence, or nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.packing import letters
from strandloom.operators.scan import Matrix


def alignment_score(code: np.ndarray, matrix: np.ndarray, opening: float, extending: float, free_ends: bool) -> float:
    """Best score of ``code`` against the rows of ``matrix`` (five columns, the last for unknown letters).

    One row of the matrix is a numpy pass over the sequence: gaps in the sequence
    come from the row above, gaps in the motif from a running maximum along the row."""
    n = len(code)
    place = np.arange(n + 1)
    best = np.zeros(n + 1) if free_ends else np.where(place > 0, -(opening + extending * place), 0.0)
    skipped = np.full(n + 1, -np.inf)  # the motif's column stands against a gap
    for row in matrix:
        skipped = np.maximum(best - opening, skipped) - extending
        both = np.concatenate([[-np.inf], best[:-1] + row[code]])
        here = np.maximum(both, skipped)
        # A gap of k letters in the motif costs opening + k * extending.
        reach = np.maximum.accumulate(here + extending * place)
        gap = np.concatenate([[-np.inf], reach[:-1]]) - opening - extending * place[: n + 1]
        best = np.maximum(here, gap)
    return float(best.max() if free_ends else best[-1])


def alignment_scores(seqs: DataFrame, matrix: Matrix, opening: float = 2.0, extending: float = 0.5, free_ends: bool = True, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id and score of each sequence's best global alignment; ``free_ends`` leaves its own ends unaligned at no cost."""
    own = np.asarray(matrix, float)
    own = np.hstack([own, np.zeros((len(own), 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, offsets = letters(batch.column(1))
            scores = [alignment_score(code[a:b], own, opening, extending, free_ends) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["seq_id", "score"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.where(F.col(seq).isNotNull()).select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, score double")


def alignment_places(code: np.ndarray, matrix: np.ndarray, opening: float, extending: float, free_ends: bool) -> tuple[float, np.ndarray]:
    """The best score, and for each row of ``matrix`` the place in ``code`` that it is aligned to (-1 for a gap).

    Of equal ways a match goes before a column without a place, and that before skipped letters."""
    n, w = len(code), len(matrix)
    place = np.arange(n + 1)
    best = np.zeros(n + 1) if free_ends else np.where(place > 0, -(opening + extending * place), 0.0)
    skipped = np.full(n + 1, -np.inf)
    matched, opened, gapped, reached = (np.zeros((w, n + 1), kind) for kind in (bool, bool, bool, np.int32))
    for i, row in enumerate(matrix):
        opened[i] = best - opening >= skipped
        skipped = np.maximum(best - opening, skipped) - extending
        both = np.concatenate([[-np.inf], best[:-1] + row[code]])
        here = np.maximum(both, skipped)
        value = here + extending * place
        reach = np.maximum.accumulate(value)
        # Where the running maximum was last raised.
        since = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] > reach[:-1]]), place, 0))
        gap = np.concatenate([[-np.inf], reach[:-1]]) - opening - extending * place
        reached[i, 1:] = since[:-1]
        gapped[i], matched[i] = gap > here, both >= skipped
        best = np.maximum(here, gap)
    j = int(best.argmax()) if free_ends else n
    score, out, skipping = float(best[j]), np.full(w, -1), False
    for i in range(w - 1, -1, -1):
        if not skipping and gapped[i, j]:
            j = int(reached[i, j])
        if not skipping and matched[i, j]:
            j -= 1
            out[i] = j
        else:
            skipping = not opened[i, j]
    return score, out


def alignments(seqs: DataFrame, matrix: Matrix, opening: float = 2.0, extending: float = 0.5, free_ends: bool = True, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id, score and places: for each row of ``matrix`` the 0-based place in the sequence (-1 for a gap)."""
    own = np.asarray(matrix, float)
    own = np.hstack([own, np.zeros((len(own), 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, offsets = letters(batch.column(1))
            found = [alignment_places(code[a:b], own, opening, extending, free_ends) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.int32()))], names=["seq_id", "score", "places"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.where(F.col(seq).isNotNull()).select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, score double, places array<int>")


def _inserted(width: int):
    """Letters between neighbouring columns: element c counts those after column c - 1 and before the next placed one."""
    after = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.array_max(F.filter(F.slice("places", 1, c), lambda p: p >= 0)), F.lit(-1)))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.when((F.get("places", c) >= 0) & (F.get(after, c) >= 0), F.get("places", c) - F.get(after, c) - 1).otherwise(0))


def star_alignment(seqs: DataFrame, matrix: Matrix, key: str = "seq_id", seq: str = "seq", **options) -> DataFrame:
    """seq_id and row: sequences aligned to the matrix and to each other, from its first column to its last.

    Ahead of each column every row gets as many places as the longest insertion there; the
    maxima (a number for each column) are an aggregate over all sequences and are broadcast."""
    width = len(matrix)
    found = alignments(seqs, matrix, key=key, seq=seq, **options).withColumn("inserted", _inserted(width))
    most = found.agg(F.array(*(F.coalesce(F.max(F.col("inserted")[c]), F.lit(0)) for c in range(width))).alias("most"))
    rows = found.join(seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("__seq")), "seq_id").join(F.broadcast(most))

    def cell(c: Column) -> Column:
        at, extra, room = F.get("places", c), F.get("inserted", c), F.get("most", c)
        before = F.when(extra > 0, F.substring(F.col("__seq"), at - extra + 1, extra)).otherwise("")
        letter = F.when(at >= 0, F.substring(F.col("__seq"), at + 1, F.lit(1))).otherwise(" ")
        return F.concat(F.repeat(F.lit(" "), room - extra), before, letter)

    return rows.select("seq_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), cell), "").alias("row"))


def longest_alignment(seqs: DataFrame, matrix: Matrix, least_width: int, key: str = "seq_id", seq: str = "seq", **options) -> tuple[int, int, int]:
    """gaps, offset, width: the longest run of columns with at most ``gaps`` gapped sequences each, for the least ``gaps`` that allows ``least_width``.

    A sequence is gapped at a column that has no place in it, or that follows letters of no
    column.  Counts are an aggregate, a number for each column."""
    width = len(matrix)
    found = alignments(seqs, matrix, key=key, seq=seq, **options).withColumn("inserted", _inserted(width))
    row = found.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("places")[c] < 0).alias(f"g{c}") for c in range(width)), *(F.count_if(F.col("inserted")[c] > 0).alias(f"i{c}") for c in range(width))).first()
    if row["n"] < 1:
        return 0, 0, width
    for allowed in range(row["n"] + 1):
        best, run = (0, 0), 0
        for c in range(width):
            run = 0 if row[f"i{c}"] > allowed else run
            run = run + 1 if row[f"g{c}"] <= allowed else 0
            best = max(best, (run, -(c - run + 1)))
        if best[0] >= least_width:
            return allowed, -best[1], best[0]
    return row["n"], 0, least_width
