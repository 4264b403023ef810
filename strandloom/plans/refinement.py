"""Refine seed matrices: EM tries, sites, significance, erasing, and motif after motif."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import em, scan, significance
from strandloom.operators.composition import letter_frequencies
from strandloom.operators.packing import pieces
from strandloom.storage import saved

LETTERS = "ACGT"


@dataclass(frozen=True)
class Motif:
    """A fitted model, its sites (overlapping ones counted), whether their number is acceptable, and the log of its E-value."""

    model: em.Model
    sites: int
    accepted: bool
    log_evalue: float = math.inf
    try_number: int = 0
    erased: tuple[int, ...] = ()


def background(seqs: DataFrame) -> np.ndarray:
    """Letter frequencies, four numbers on the driver."""
    found = {r["letter"]: r["freq"] for r in letter_frequencies(seqs).collect()}
    return np.array([found[x] for x in LETTERS])


def seed_stream(matrices: DataFrame, other: np.ndarray, rate: float, keys: tuple[str, ...] = ("cluster",)) -> Iterator[em.Model]:
    """Models from matrices (keys, pos, A, C, G, T) in the order of their keys, the last of which names them.

    Rows come to the driver a partition at a time, so that however many seeds there are, only those of one are held."""
    ordered = matrices.select(*keys, "pos", *LETTERS).orderBy(*keys, "pos")
    for key, rows in groupby(ordered.toLocalIterator(), key=lambda r: tuple(r[k] for k in keys)):
        yield em.Model(str(key[-1]), np.array([[r[x] for x in LETTERS] for r in rows]), other, rate)


def seed_models(matrices: DataFrame, other: np.ndarray, rate: float) -> list[em.Model]:
    """The same as a list, for few seeds (cluster, pos, A, C, G, T)."""
    return list(seed_stream(matrices, other, rate))


def log_odds(model: em.Model) -> list[list[float]]:
    return np.log(model.theta / model.background).tolist()


def _counter(tables: list[tuple[list[list[float]], float, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * len(tables)
        for batch in batches:
            for piece in pieces(batch):
                for k, (table, threshold, one_each) in enumerate(tables):
                    owner = scan.owners_of_hits(piece.column(0), table, threshold)
                    totals[k] += len(np.unique(owner)) if one_each else len(owner)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tables)), pa.int32()), pa.array(totals, pa.int64())], names=["model", "sites"])

    return run


def hit_counts(seqs: DataFrame, tables: list[tuple[list[list[float]], float, bool]]) -> list[int]:
    """Windows above the threshold of each (log-odds, threshold, False), or sequences with such a window (True), all in one scan."""
    if not tables:
        return []
    found = seqs.select("seq").mapInArrow(_counter(tables), "model int, sites long").groupBy("model").agg(F.sum("sites").alias("sites")).collect()
    counts = {r["model"]: r["sites"] for r in found}
    return [counts.get(k, 0) for k in range(len(tables))]


def site_counts(seqs: DataFrame, models: list[em.Model]) -> list[int]:
    """Sites of each model: windows, or sequences where one has a site at most."""
    return hit_counts(seqs, [(log_odds(m), scan.bayes_threshold(m.window_rate), m.spread != em.ANY) for m in models])


def weighted_sites(seqs: DataFrame, model: em.Model) -> int:
    """Windows (or sequences, where one has a site at most) that are rather sites than not, given the weights of their letters."""
    found = em.collected(em.expected_counts(seqs, [model], weights="weights" if "weights" in seqs.columns else None), [model])
    return found[0].sites if found else 0


def log_evalues(seqs: DataFrame, models: list[em.Model], sites: list[int]) -> list[float]:
    """Log E-values of models with so many sites, by their columns and the ways to place the sites.

    Columns are a few rows for each motif; lengths of sequences are aggregated on Spark."""
    spark, out = seqs.sparkSession, []
    for model, n in zip(models, sites, strict=True):
        if n < 1:
            out.append(math.inf)
            continue
        rows = [(k, *map(float, row), n) for k, row in enumerate(model.theta)]
        columns = spark.createDataFrame(rows, "pos int, A double, C double, G double, T double, nsites long").withColumn("motif", F.lit(model.name))
        ways = significance.log_ways(seqs, model.width, n, model.spread)
        found = significance.motif_significance(columns, ["motif"], dict(zip(LETTERS, map(float, model.background), strict=True)), None).first()
        out.append(found["log_p"] + ways)
    return out


def refine(seqs: DataFrame, models: list[em.Model], min_sites: int = 10, max_sites: int = 0, tries: int = 3, seed: int = 0, stop_early: bool = True, **options) -> list[Motif]:
    """Online EM with a bias that is bisected until the number of sites is acceptable; the best try by log E-value.

    ``max_sites`` 0 means five times the windows that fit a seed well.  A seed's search
    stops at its first acceptable try (or goes on for all tries if ``stop_early`` is false);
    of acceptable tries the one of least log E-value counts, the first of equal ones.  Without any,
    the last try stands, not accepted.  All seeds still searching share each try's jobs."""
    bounds = [(0.0, 1.0, 1.0)] * len(models)
    fits = hit_counts(seqs, [(scan.goodness(m.theta, m.background), 0.7, False) for m in models])
    most = [max_sites or 5 * max(1, n) for n in fits]
    best: list[Motif | None] = [None] * len(models)
    last: list[Motif | None] = [None] * len(models)
    for attempt in range(tries):
        open_ = [i for i in range(len(models)) if best[i] is None or not stop_early]
        if not open_:
            break
        fitted = em.online_em(seqs, [replace(models[i], bias=bounds[i][1]) for i in open_], seed=seed + attempt, **options)
        counts = site_counts(seqs, fitted)
        good = [k for k, i in enumerate(open_) if min_sites <= counts[k] <= most[i]]
        values = dict(zip(good, log_evalues(seqs, [fitted[k] for k in good], [counts[k] for k in good]), strict=True))
        for k, (i, model) in enumerate(zip(open_, fitted, strict=True)):
            a, b, c = bounds[i]
            if counts[k] > most[i]:
                bounds[i] = (a, (a + b) / 2, b)
            elif counts[k] < min_sites:
                bounds[i] = (b, (b + c) / 2, c)
            last[i] = Motif(model, counts[k], k in values, values.get(k, math.inf), attempt)
            if k in values and (best[i] is None or values[k] < best[i].log_evalue):
                best[i] = last[i]
    return [m for m in (b or x for b, x in zip(best, last, strict=True)) if m is not None]


def erase(seqs: DataFrame, model: em.Model) -> DataFrame:
    """``seqs`` with the model's non-overlapping sites written as N."""
    return scan.erased(seqs, log_odds(model), model.window_rate)


def erase_softly(seqs: DataFrame, model: em.Model) -> DataFrame:
    """seq_id and weights: one minus the largest posterior of all windows that cover each place."""
    return scan.soft_weights(seqs, log_odds(model), model.window_rate)


@dataclass(frozen=True)
class Discovery:
    """Motifs in the order in which they were found, both sets with their sites masked (or ``weights`` of their letters), and why the search stopped."""

    motifs: list[Motif]
    positive: DataFrame
    negative: DataFrame | None
    reason: str


def discover(
    positive: DataFrame, seeds: Iterable[em.Model], negative: DataFrame | None = None, most: int = 5, log_evalue_cut: float = 0.0, fit: str = "online", erasing: str | None = None, **options
) -> Discovery:
    """Motif after motif: fit a seed, test its E-value, erase its sites from both sets, and go on with the next.

    The search ends with the seeds, after ``most`` motifs, or when no letters are left to scan.
    A seed whose motif has too few or many sites, or an E-value above the cut, is passed over.
    ``fit`` is ``online`` (tries as in ``refine``) or ``batch``.  ``erasing`` is ``hard`` (sites become N; always with online
    fits) or ``soft`` (with batch fits: letters keep the weight that earlier motifs leave them, and sites of later ones may
    overlap those).  Erased sets are stored tables."""
    soft = (erasing or ("soft" if fit == "batch" else "hard")) == "soft" and fit == "batch"
    motifs: list[Motif] = []
    now, other = saved(positive), saved(negative) if negative is not None else None
    reason = "seeds are used up"
    for seed in seeds:
        if len(motifs) == most:
            reason = "enough motifs"
            break
        if not hit_counts(now, [(np.zeros((seed.width, 4)).tolist(), -1.0, False)])[0]:
            reason = "no windows left"
            break
        if fit == "online":
            found = refine(now, [seed], **options)[0]
        else:
            held = "weights" if soft and motifs else None
            model = em.batch_em(now, [seed], weights=held, **{k: v for k, v in options.items() if k in ("iterations", "distance")})[0]
            sites = weighted_sites(now, model) if held else site_counts(now, [model])[0]
            value = log_evalues(now, [model], [sites])[0]
            found = Motif(model, sites, sites >= options.get("min_sites", 1), value)
        if not found.accepted or found.log_evalue > log_evalue_cut:
            continue
        if soft:
            motifs.append(replace(found, erased=(found.sites,) + ((weighted_sites(other, found.model),) if other is not None else ())))
            now = saved(scan.softly_erased(now, found.model))
            other = saved(scan.softly_erased(other, found.model)) if other is not None else None
            continue
        masked = saved(erase(now, found.model))
        counts = [masked.agg(F.sum("erased")).first()[0] or 0]
        now = masked.drop("erased")
        if other is not None:
            masked = saved(erase(other, found.model))
            counts.append(masked.agg(F.sum("erased")).first()[0] or 0)
            other = masked.drop("erased")
        motifs.append(replace(found, erased=tuple(counts)))
    return Discovery(motifs, now, other, reason)


def motif_table(spark, motifs: list[Motif]) -> DataFrame:
    """Found motifs as rows for the motif file writer: motif, alt, nsites, log_evalue, pos, A, C, G, T."""
    rows = [(f"M{k}", f"O{k}", m.erased[0] if m.erased else m.sites, float(m.log_evalue), pos, *map(float, row)) for k, m in enumerate(motifs, 1) for pos, row in enumerate(m.model.theta)]
    return spark.createDataFrame(rows, "motif string, alt string, nsites long, log_evalue double, pos int, A double, C double, G double, T double")


def shared_map(own: float = 0.7) -> np.ndarray:
    """Rows of letter probabilities by a word's letter: ``own`` for itself, the rest in equal parts."""
    return np.full((4, 4), (1 - own) / 3) + np.eye(4) * (own - (1 - own) / 3)


def substitution_map(power: int, stay: float = 0.99, transition: float = 0.006) -> np.ndarray:
    """The same after ``power`` steps in each of which a letter stays, goes over to its like (A and G, C and T) or to one of the others."""
    other = (1 - stay - transition) / 2
    step = np.full((4, 4), other) + np.eye(4) * (stay - other)
    for i, j in ((0, 2), (2, 0), (1, 3), (3, 1)):
        step[i, j] = transition
    return np.linalg.matrix_power(step, power)


def start_models(words: DataFrame, background_: np.ndarray, rate: float, own: float = 0.7, word: str = "word", letters: np.ndarray | None = None) -> list[em.Model]:
    """A starting model for each of a few distinct ``words``: letters become rows of a map (``shared_map(own)`` by default), an N's are the background's."""
    letters = shared_map(own) if letters is None else letters
    out = []
    for r in words.select(word).where(F.length(word) > 0).distinct().orderBy(word).collect():
        rows = [list(letters[LETTERS.index(y)]) if y in LETTERS else list(background_) for y in r[0].upper()]
        out.append(em.Model(r[0], np.array(rows), background_, rate))
    return out


def best_by_width(seqs: DataFrame, models: list[em.Model], **options) -> dict[int, Motif]:
    """Of batch-fitted models, for each width the one of least log E-value (the first of equal ones)."""
    fitted = em.batch_em(seqs, models, **options)
    counts = site_counts(seqs, fitted)
    best: dict[int, Motif] = {}
    for model, sites, value in zip(fitted, counts, log_evalues(seqs, fitted, counts), strict=True):
        if model.width not in best or value < best[model.width].log_evalue:
            best[model.width] = Motif(model, sites, sites > 0, value)
    return best
