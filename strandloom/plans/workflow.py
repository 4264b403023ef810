"""From two folders of FASTA to seeds, a motif file, logos and masked sets, in one call."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import composition, em, enrichment, scan
from strandloom.plans import refinement, seeds
from strandloom.sources import fasta, motifs
from strandloom.storage import saved, scope

#: Seeds that are compared with the sequences in one scan.
AT_ONCE = 16
#: Goodness of fit above which a window counts as a likely site of a seed.
LIKELY = 0.7


@dataclass(frozen=True)
class Words:
    """How seeds are made where none are given: halves and gaps of words, the cut of enriched ones, the threshold of clusters."""

    half: int = 4
    min_gap: int = 0
    max_gap: int = 10
    min_sites: int = 5
    z_threshold: float = 5.0
    threshold: float = 0.3


def made_seeds(positive: DataFrame, negative: DataFrame, words: Words) -> DataFrame:
    """block, motif, consensus, pos, A, C, G, T: weighted matrices of the clusters of words enriched in ``positive``, the largest cluster first."""
    both = positive.select("seq", F.lit(True).alias("own")).unionByName(negative.select("seq", F.lit(False).alias("own")))
    found = enrichment.enrichment(both, F.col("own"), words.half, words.min_gap, words.max_gap, words.min_sites, words.z_threshold)
    pfm = saved(seeds.seed_matrices(seeds.numbered(found), words.threshold))
    named = pfm.join(composition.consensus_string(pfm, ["cluster"]), "cluster")
    return named.select(F.col("cluster").cast("long").alias("block"), F.concat(F.lit("cluster"), "cluster").alias("motif"), "consensus", "pos", *motifs.LETTERS)


def raised(pfm: DataFrame, pseudo: float) -> DataFrame:
    """Rows of probabilities raised by ``pseudo`` and normalised."""
    total = sum((F.col(x) for x in motifs.LETTERS), F.lit(4 * pseudo))
    return pfm.withColumns({x: (F.col(x) + pseudo) / total for x in motifs.LETTERS})


def with_rates(seqs: DataFrame, models: Iterator[em.Model]) -> Iterator[em.Model]:
    """Models whose rate is the share of windows that fit them well (at least one window), a few of them in each scan."""
    while group := list(islice(models, AT_ONCE)):
        tables = [(scan.goodness(m.theta, m.background), LIKELY, False) for m in group] + [(np.zeros((m.width, 4)).tolist(), -1.0, False) for m in group]
        counts = refinement.hit_counts(seqs, tables)
        for model, fits, windows in zip(group, counts, counts[len(group) :], strict=False):
            yield replace(model, rate=min(max(fits, 1) / max(windows, 2), 0.5))


def find_motifs(
    spark: SparkSession, positive: str, negative: str, out: str, seed_file: str | None = None, index: int | None = None, pseudo: float = 0.0,
    words: Words | None = None, given_background: bool = False, save_masked: bool = False, **options,
) -> list[refinement.Motif]:
    """Motifs of the FASTA files ``positive`` (a file, folder or pattern) over ``negative``, written under ``out``.

    Seeds are the matrices of ``seed_file`` in its order, or only the one of number ``index`` (from 1); without a file they are
    made from enriched words (``words``) and written to ``seeds``.  ``pseudo`` is added to each of their probabilities.  ``motifs`` gets
    the motif file (with the positive set's letter frequencies if ``given_background``, else even ones), ``logos`` the letter
    heights as Parquet and, with ``save_masked``, ``masked`` both sets with sites as N.  ``options`` go to ``refinement.discover``.
    Letters other than ACGT count as N.  An index without a seed, and masked sets of soft erasing, are errors; no enriched word, no
    sequence or no accepted motif gives a motif file of its header alone.  Tables stored on the way are deleted at the end."""
    if save_masked and options.get("fit") == "batch" and options.get("erasing") != "hard":
        raise ValueError("soft erasing masks no letters: set erasing='hard' to save masked sets")
    with scope(spark):
        own, other = (saved(fasta.unambiguous(fasta.read_numbered(spark, path)).select("seq_id", "seq")) for path in (positive, negative))
        if seed_file is None:
            matrices = saved(made_seeds(own, other, words or Words()))
            text = motifs.seed_matrix_text(matrices).join(matrices.select("block", "motif").distinct(), "motif")
            text.orderBy("block").select("value").write.mode("overwrite").text(f"{out}/seeds")
        else:
            matrices = saved(motifs.read_seed_matrices(spark, seed_file))
        if index is not None:
            chosen = matrices.select("block").distinct().orderBy("block").offset(index - 1).limit(1).collect() if index > 0 else []
            if not chosen:
                raise ValueError(f"there is no seed of number {index}")
            matrices = matrices.where(F.col("block") == chosen[0]["block"])
        letters = refinement.background(own)
        models = with_rates(own, refinement.seed_stream(raised(matrices, pseudo), letters, 0.5, ("block", "motif")))
        found = refinement.discover(own, models, other, **options)
        table = refinement.motif_table(spark, found.motifs)
        motifs.write_motif_file(table, f"{out}/motifs", dict(zip(motifs.LETTERS, map(float, letters), strict=True)) if given_background else None)
        motifs.logo_heights(table, ["motif"]).coalesce(1).write.mode("overwrite").parquet(f"{out}/logos")
        if save_masked:
            fasta.write_masked(found.positive, found.negative, f"{out}/masked")
    return found.motifs
