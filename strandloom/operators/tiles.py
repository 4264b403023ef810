"""Tiles: a choice among the hits of several motifs that don't overlap, and a combined p-value of each sequence.

Hits are taken by rising p-value wherever they don't touch one that was taken before.  Sequences are
scored for all motifs in one scan, where they are; a hit leaves the task only if it is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.stats import log_product_p
from strandloom.operators.packing import letters, pieces
from strandloom.operators.scan import window_scores
from strandloom.operators.transforms import score_tail


@dataclass(frozen=True)
class Scored:
    """A motif's scores as whole steps (columns of A, C, G, T), and the p-value of each sum."""

    name: str
    steps: np.ndarray
    tail: np.ndarray


def scored_motif(name: str, log_odds: Sequence[Sequence[float]], background: Sequence[float], steps: int = 100) -> Scored:
    """Scores between the least and the largest of the matrix in ``steps`` whole steps."""
    odds = np.asarray(log_odds, float)
    whole = np.rint((odds - odds.min()) * (steps / max(odds.max() - odds.min(), 1e-9))).astype(int)
    return Scored(name, whole, score_tail(whole.tolist(), list(background)))


def chosen(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Of intervals in order of preference those that touch none taken before."""
    taken: list[tuple[int, int]] = []
    kept = []
    for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        at = bisect_left(taken, (b, -1))
        if at == 0 or taken[at - 1][1] <= a:
            insort(taken, (a, b))
            kept.append(k)
    return kept


_TILE = "start long, end long, motif string, strand string, p double"


def _tile(motifs: list[Scored], most_p: float, both_strands: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                code, offsets = letters(piece.column(1))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                best, found = np.full((len(motifs), len(offsets) - 1), -1, np.int64), []
                for m, motif in enumerate(motifs):
                    w = len(motif.steps)
                    if len(code) < w:
                        continue
                    off = -float(motif.steps.max() * w + 1)
                    unknown = np.full((w, 1), off)
                    one = window_scores(code, np.hstack([motif.steps, unknown]))
                    two = window_scores(code, np.hstack([motif.steps[::-1, ::-1], unknown])) if both_strands else np.full(len(one), off)
                    top = np.maximum(one, two).astype(np.int64)
                    known = np.flatnonzero((owner[: len(one)] == owner[w - 1 :]) & (top >= 0))
                    np.maximum.at(best[m], owner[known], top[known])
                    p = motif.tail[top[known]]
                    few = p < most_p
                    found.append((known[few], np.full(few.sum(), w), np.full(few.sum(), m), (two > one)[known[few]], p[few]))
                at, width, which, reverse, p = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, int)] * 5
                order = np.lexsort((which, at, p))
                kept = order[chosen(at[order], (at + width)[order])]
                kept = kept[np.argsort(at[kept])]
                begin, rows = offsets[owner[at[kept]]] if len(kept) else np.zeros(0, int), owner[at[kept]] if len(kept) else np.zeros(0, int)
                cuts = np.searchsorted(rows, np.arange(len(offsets)))
                names = [m.name for m in motifs]
                columns = [at[kept] - begin, at[kept] + width[kept] - begin, [names[m] for m in which[kept].tolist()], ["-" if r else "+" for r in reverse[kept].tolist()], p[kept]]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
                tiles = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _TILE.split(", ")])
                steps = pa.ListArray.from_arrays(pa.array(np.arange(len(offsets)) * len(motifs), pa.int32()), pa.array(best.T.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), tiles), steps], names=["seq_id", "letters", "tiles", "best"])

    return run


def tiled(seqs: DataFrame, motifs: list[Scored], most_p: float = 1e-4, both_strands: bool = True, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id, tiles (start, end, motif, strand, p; from the left), and log_p: the combined p-value of the sequence.

    A window's p-value is that of a random word to score as high; with both strands its better one
    counts.  Hits are taken by p-value, then start, then the order of ``motifs``.  The best p of each motif is
    corrected for the places and strands that it was chosen from, 1 - (1 - p)^places; log_p is the log p-value of the product of
    these over the motifs that fit into the sequence, 0 without any."""
    kind = seqs.schema[key].dataType.simpleString()
    rows = seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(_tile(motifs, most_p, both_strands), f"seq_id {kind}, letters long, tiles array<struct<{_TILE.replace(' ', ':').replace(',:', ', ')}>>, best array<long>")
    logs = []
    for m, motif in enumerate(motifs):
        places = (F.col("letters") - (len(motif.steps) - 1)) * (2 if both_strands else 1)
        p = F.element_at(F.array(*map(F.lit, map(float, motif.tail))), (F.element_at("best", m + 1) + 1).cast("int"))
        corrected = F.log(-F.expm1(places * F.log1p(-F.least(p, F.lit(1 - 1e-16)))))
        logs.append(F.when(F.element_at("best", m + 1) >= 0, corrected))
    held = F.array_compact(F.array(*logs))
    product = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return rows.select("seq_id", "tiles", log_product_p(F.size(held), product).alias("log_p"))
