"""Gapped word counts and their enrichment of one sequence set over another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.packing import letters, stretches
from strandloom.storage import saved

#: Half-words up to which counts are kept in a dense table (4 ** (2 * half) counters a gap).
DENSE_HALF = 4


def _counter(half: int, gaps: range):
    """Counts of packed words by set (column 1: whether a sequence is in the first of two sets) and gap."""
    words = 4 ** (2 * half)

    def mirrored(packed: np.ndarray) -> np.ndarray:
        """The reverse complement of packed words."""
        out, rest = np.zeros_like(packed), packed.copy()
        for _ in range(2 * half):
            out = out * 4 + (3 - rest % 4)
            rest //= 4
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {(i, g): np.zeros(words, np.int64) for i in (False, True) for g in gaps} if half <= DENSE_HALF else None
        for batch in batches:
            for part_of in stretches(batch, 0, ahead=2 * half + max(gaps, default=0) - 1):
                piece = part_of.piece
                code, offsets = letters(piece.column(0))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                own = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                both = own.any() and not own.all()
                n = len(code) - half + 1
                if n <= 0:
                    continue
                part, known = np.zeros(n, np.int64), np.ones(n, bool)
                for j in range(half):
                    part = part * 4 + code[j : j + n]
                    known &= code[j : j + n] < 4
                for g in gaps:
                    m = n - half - g
                    if m <= 0:
                        continue
                    shift = half + g
                    at = part_of.own(np.flatnonzero(known[:m] & known[shift : shift + m] & (owner[:m] == owner[shift + half - 1 : shift + half - 1 + m])))
                    packed = part[at] * 4**half + part[at + shift]
                    mine = own[owner[at]] if both else None
                    for i in (False, True):
                        some = packed[mine == i] if both else packed if own.any() == i else packed[:0]
                        if dense is not None:
                            dense[i, g] += np.bincount(some, minlength=words)
                        else:
                            yield _counts(i, g, *np.unique(np.minimum(some, mirrored(some)), return_counts=True))
        for (i, g), count in (dense or {}).items():
            found = np.flatnonzero(count)
            yield _counts(i, g, np.minimum(found, mirrored(found)), count[found])

    return run


def _counts(own: bool, gap: int, packed: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, own)), pa.array(np.full(n, gap, np.int32)), pa.array(packed.astype(np.int64)), pa.array(count.astype(np.int64))], names=["own", "gap", "packed", "cnt"])


def _per_task(seqs: DataFrame, own, half: int, min_gap: int, max_gap: int, seq: str) -> DataFrame:
    return seqs.select(F.col(seq).alias("seq"), own.alias("own")).mapInArrow(_counter(half, range(min_gap, max_gap + 1)), "own boolean, gap int, packed long, cnt long")


def _spelled(half: int):
    base4 = F.lpad(F.conv(F.col("packed").cast("string"), 10, 4), 2 * half, "0")
    letters = F.translate(base4, "0123", "ACGT")
    return F.concat(F.substring(letters, 1, half), F.repeat(F.lit("N"), F.col("gap")), F.substring(letters, half + 1, half))


def gapped_counts(seqs: DataFrame, half: int = 4, min_gap: int = 0, max_gap: int = 10, seq: str = "seq") -> DataFrame:
    """gap, word, cnt: places of each gapped word, both strands folded into the lesser word.

    A word is two halves of known letters around ``gap`` letters of any kind, written
    as N.  Each task packs letters into numbers and counts ahead of the shuffle, so
    at most one row for each gap, word and task is sent (for ``half`` up to ``DENSE_HALF``; one
    for each piece of a few million letters beyond)."""
    totals = _per_task(seqs, F.lit(True), half, min_gap, max_gap, seq).groupBy("gap", "packed").agg(F.sum("cnt").alias("cnt"))
    return totals.select("gap", _spelled(half).alias("word"), "cnt")


def gapped_counts_of_two(seqs: DataFrame, positive: Column, half: int = 4, min_gap: int = 0, max_gap: int = 10, seq: str = "seq") -> DataFrame:
    """gap, word, pos_sites and neg_sites (null where a set lacks a word), in one scan of both sets.

    ``positive`` tells which sequences are in the positive set; a null counts as not."""
    rows = _per_task(seqs, F.coalesce(positive, F.lit(False)), half, min_gap, max_gap, seq)
    totals = rows.groupBy("gap", "packed").agg(F.sum(F.when(F.col("own"), F.col("cnt"))).alias("pos_sites"), F.sum(F.when(~F.col("own"), F.col("cnt"))).alias("neg_sites"))
    return totals.select("gap", _spelled(half).alias("word"), "pos_sites", "neg_sites")


def zscores(counts: DataFrame) -> DataFrame:
    """gap, word, pos_sites, neg_sites, z, z_corrected for every positive word of ``gapped_counts_of_two``.

    An unseen negative counts as one in z but is reported as none.  The correction
    divides by the population deviation of all words of that gap."""
    expected = F.coalesce("neg_sites", F.lit(1))
    scored = counts.where(F.col("pos_sites").isNotNull()).withColumn("z", (F.col("pos_sites") - expected) / F.sqrt(expected))
    scored = scored.withColumn("neg_sites", F.coalesce("neg_sites", F.lit(0).cast("long")))
    spread = scored.groupBy("gap").agg(F.stddev_pop("z").alias("spread"))
    out = scored.join(F.broadcast(spread), "gap")  # one row for each gap
    return out.select("gap", "word", "pos_sites", "neg_sites", "z", F.when(F.col("spread") > 0, F.col("z") / F.col("spread")).alias("z_corrected"))


def prefix_cut(scored: DataFrame, min_sites: int = 5, z_threshold: float = 5.0) -> DataFrame:
    """Words of each gap before the first, by falling z (ties by word), that fails a threshold.

    The first failing row is an aggregate for each gap, so no task orders a whole gap."""
    fails = ~((F.col("z_corrected") >= z_threshold) & (F.col("pos_sites") >= min_sites))
    key = F.struct((-F.col("z")).alias("z"), F.col("word").alias("word"))
    first = scored.groupBy("gap").agg(F.min(F.when(fails, key)).alias("stop"))
    return scored.join(F.broadcast(first), "gap").where(F.col("stop").isNull() | (key < F.col("stop"))).drop("stop")


def enrichment(seqs: DataFrame, positive: Column, half: int = 4, min_gap: int = 0, max_gap: int = 10, min_sites: int = 5, z_threshold: float = 5.0) -> DataFrame:
    """Enriched gapped words of the ``positive`` sequences over the others.

    Word counts are stored: scores, spreads and cuts all read them."""
    return prefix_cut(zscores(saved(gapped_counts_of_two(seqs, positive, half, min_gap, max_gap))), min_sites, z_threshold)


def top_words(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best words over all gaps, one row a word."""
    best = scored.groupBy("word").agg(F.max_by(F.struct("gap", "pos_sites", "neg_sites", "z_corrected"), "z").alias("r"), F.max("z").alias("z"))
    return best.select("word", "r.*", "z").orderBy(F.desc("z"), "word").limit(k)


def ranked(scored: DataFrame) -> DataFrame:
    """Rank of each word within its gap."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("gap").orderBy(F.desc("z"), "word")))
