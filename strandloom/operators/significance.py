"""Significance of motif columns: the distribution of log-likelihood ratios and E-values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.stats import log_product_p
from strandloom.operators.ordered import running_totals

#: Decimals to which ratios are rounded, and how far below a ratio its own value still counts.
DECIMALS, SLACK = 14, 1e-9
#: Sites of the largest sum over all letter counts; larger numbers continue its excess over the limit law.
LARGEST = 2048
#: Factors of placements that ``placements_table`` sums in one.
BLOCK = 1 << 16
#: Numbers of sites between which ``tail_table`` interpolates, and ratios per site of each.
NODES, STEPS = (16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024), 96


def _normal(background: tuple[float, ...]) -> np.ndarray:
    p = np.asarray(background, float)
    return p / p.sum()


def summed_tails(ratios: np.ndarray, sites: int, background: tuple[float, ...]) -> np.ndarray:
    """ln P(ratio or more) for ``sites`` letters, summed over all counts of the four letters.

    For every split of the letters between the first two and the last two, the latter's counts
    are sorted by their part of the ratio and their weights summed from above; each count of the
    former then looks up what it still needs.  Time grows with the square of ``sites``."""
    p, n = _normal(background), sites
    count = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.array([np.where(count > 0, count * np.log(count / (n * q)), 0.0) for q in p])
    factorial = np.array([math.lgamma(c + 1) for c in count])
    weight = count * np.log(p)[:, None] - factorial
    wanted, total = np.asarray(ratios, float) - SLACK, np.full(len(ratios), -np.inf)
    for m in range(n + 1):
        one, two = part[0, : m + 1] + part[1, m::-1], weight[0, : m + 1] + weight[1, m::-1]
        rest = n - m
        three, four = part[2, : rest + 1] + part[3, rest::-1], weight[2, : rest + 1] + weight[3, rest::-1]
        order = np.argsort(three)
        top = four.max()
        above = np.append(np.log(np.maximum(np.cumsum(np.exp(four[order] - top)[::-1])[::-1], 1e-300)) + top, -np.inf)
        far = above[:-1] < top - 30  # far below the largest weight: sum in logs
        if far.any():
            above[:-1] = np.logaddexp.accumulate(four[order][::-1])[::-1]
        found = two + above[np.searchsorted(three[order], wanted[:, None] - one)]
        most = found.max(axis=1)
        some = most > -np.inf
        with np.errstate(under="ignore"):
            total[some] = np.logaddexp(total[some], most[some] + np.log(np.exp(found[some] - most[some, None]).sum(axis=1)))
    return np.minimum(total + factorial[n], 0.0)


def limit_tails(ratios: np.ndarray) -> np.ndarray:
    """ln P(ratio or more) of one column in the limit: twice the ratio is chi-squared with three degrees of freedom."""
    x = np.maximum(np.asarray(ratios, float), 0.0)
    out, low = np.empty(x.shape), x < 600
    near, far = x[low], x[~low]
    erfc = np.array([math.erfc(math.sqrt(v)) for v in near.tolist()])
    out[low] = np.log(np.minimum(erfc + 2 * np.sqrt(near / math.pi) * np.exp(-near), 1.0))
    out[~low] = np.log((2 * far + 1) / np.sqrt(math.pi * far)) - far
    return out


@lru_cache(maxsize=4096)
def _whole(ratios: tuple[float, ...], sites: int, background: tuple[float, ...]) -> tuple[float, ...]:
    x = np.array(ratios)
    if sites <= LARGEST:
        return tuple(summed_tails(x, sites, background))
    half, share = LARGEST // 2, x / sites
    near, nearer = (summed_tails(share * n, n, background) - limit_tails(share * n) for n in (half, LARGEST))
    # The excess over the limit law is a smooth function of the ratio per site and of 1 / sites.
    excess = nearer + (near - nearer) * (1 / sites - 1 / LARGEST) / (1 / half - 1 / LARGEST)
    return tuple(limit_tails(x) + excess)


def log_tails(ratios: np.ndarray, sites: float, background: tuple[float, ...]) -> np.ndarray:
    """ln P(ratio or more) of columns of so many sites, by one method for any number.

    Up to ``LARGEST`` sites every split of the letters is summed.  Beyond, the excess of that sum over the limit law
    is continued in 1 / sites at the same ratio per site; at ``LARGEST`` both agree, so there is no step.
    Between whole numbers of sites the tail is their geometric mean by share."""
    x = tuple(float(r) for r in ratios)
    if sites <= 1:
        return np.zeros(len(x))
    below = math.floor(sites)
    share = sites - below
    values = [np.array(_whole(x, n, tuple(background))) for n in (below, below + 1)[: 1 + (share > 0)]]
    return values[0] if len(values) == 1 else (1 - share) * values[0] + share * values[1]


def log_tail(ratio: float, sites: float, background: tuple[float, ...]) -> float:
    return float(log_tails(np.array([ratio]), sites, background)[0])


@lru_cache(maxsize=16)
def tail_table(background: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ratios per site, and the excess of ``summed_tails`` over the limit law there, a row for each of ``NODES``."""
    share = np.linspace(0, 1, STEPS + 1) ** 2 * -math.log(_normal(background).min())
    return share, np.array([np.maximum(summed_tails(share * n, n, background), -2.0 * n * share[-1] - 50) - limit_tails(share * n) for n in NODES])


def read_tails(ratios: np.ndarray, sites: np.ndarray, background: tuple[float, ...], tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """ln P(ratio or more) of many columns of many numbers of sites, read from ``tail_table`` (or ``tables``, the same made before).

    For comparing alignments of different large sizes at once; what is reported comes from ``log_tails``.  Near the largest
    ratio, where the tail falls in steps of ln(3 * sites), it may be off by one of them."""
    share, table = tables or tail_table(tuple(background))
    sites = np.asarray(sites, float)
    at = np.minimum(np.asarray(ratios, float) / sites, share[-1])
    inverse = 1 / np.array(NODES, float)
    place = np.interp(1 / np.maximum(sites, NODES[0]), inverse[::-1], np.arange(len(NODES))[::-1])
    low = np.minimum(place.astype(int), len(NODES) - 2)
    cell = np.clip(np.searchsorted(share, at, side="right") - 1, 0, len(share) - 2)
    along = (at - share[cell]) / (share[cell + 1] - share[cell])
    excess = [(1 - along) * table[row, cell] + along * table[row, cell + 1] for row in (low, low + 1)]
    beyond = sites > NODES[-1]
    first, last = inverse[-2], inverse[-1]
    slope = np.where(beyond, (1 / sites - last) / (first - last), 0.0)
    mixed = (1 - (place - low)) * excess[0] + (place - low) * excess[1]
    mixed = np.where(beyond, mixed + slope * (((1 - along) * table[-2, cell] + along * table[-2, cell + 1]) - mixed), mixed)
    return np.minimum(limit_tails(np.asarray(ratios, float).ravel()).reshape(np.shape(ratios)) + mixed, 0.0)


def log_chances(counts: np.ndarray, background: tuple[float, ...]) -> np.ndarray:
    """ln P(exactly these counts) of columns of four letters (the last axis), in any order of letters: never above the tail of their ratio."""
    p, counts = _normal(background), np.asarray(counts, int)
    sites = counts.sum(axis=-1)
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, sites.max(initial=0) + 1)))])
    return np.minimum(factorial[sites] + (counts * np.log(p) - factorial[counts]).sum(axis=-1), 0.0)


def mean_ratio(sites: int, background: tuple[float, ...]) -> float:
    """Expected ratio of one column: each letter's count is binomial."""
    count, total = np.arange(1, sites + 1), 0.0
    choose = math.lgamma(sites + 1) - np.array([math.lgamma(c + 1) + math.lgamma(sites - c + 1) for c in count])
    for q in _normal(background):
        log_p = choose + count * math.log(q) + ((sites - count) * math.log1p(-q) if q < 1 else 0.0)
        total += float((np.exp(log_p) * count * np.log(count / (sites * q))).sum())
    return total


def _power(mass: np.ndarray, n: int) -> np.ndarray:
    """Distribution of the sum of ``n`` draws, by repeated squaring."""
    out = np.ones(1)
    while n:
        if n & 1:
            out = np.convolve(out, mass)
        n >>= 1
        if n:
            mass = np.convolve(mass, mass)
    return out


def star_tail(scores: np.ndarray, background: list[float], sites: int, columns: int = 1) -> tuple[np.ndarray, int]:
    """P(sum or more) of star alignments of ``sites`` random sequences, and the least sum.

    In a column the first sequence's letter scores with each other's, in whole numbers (rows: its own letter).  Given
    that letter the others are independent, so a column's sum is a power of one distribution, and
    the alignment's a power of the columns' mixture."""
    scores, p = np.asarray(scores, int), np.asarray(background, float)
    low, high = int(scores.min()), int(scores.max())
    column = np.zeros((high - low) * (sites - 1) + 1)
    for own, share in zip(scores, p, strict=True):
        mass = np.zeros(high - low + 1)
        np.add.at(mass, own - low, p)
        column += share * _power(mass, sites - 1)
    return np.cumsum(_power(column, columns)[::-1])[::-1], low * (sites - 1) * columns


def relative_entropy(columns: DataFrame, background: dict[str, float]) -> DataFrame:
    """Adds ``entropy_nats`` and ``information`` (2 bits less the column's entropy) to rows of A, C, G, T."""
    terms = [F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / q)).otherwise(0.0) for x, q in background.items()]
    bits = [F.when(F.col(x) > 0, F.col(x) * F.log2(x)).otherwise(0.0) for x in background]
    return columns.withColumn("entropy_nats", sum(terms[1:], terms[0])).withColumn("information", 2 + sum(bits[1:], bits[0]))


def column_log_p(background: dict[str, float]):
    """A vectorised function of (rounded ratio, sites) to the log p-value of a column."""
    q = tuple(background.values())

    @F.pandas_udf("double")
    def run(ratio: pd.Series, sites: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=ratio.index)
        for n, own in ratio.groupby(sites):
            out[own.index] = log_tails(own.to_numpy(), n, q)
        return out

    return run


def placements():
    """``stats.log_placements`` as a vectorised function of (starts, sites), in blocks: an array of one row can't hold any number of sites."""

    @F.pandas_udf("double")
    def run(starts: pd.Series, sites: pd.Series) -> pd.Series:
        return pd.Series([math.nan if pd.isna(a) or pd.isna(b) else total_placements(a, b) for a, b in zip(starts, sites, strict=True)], dtype=float)

    return run


def log_ways(seqs: DataFrame, width: int, sites: int, spread: str = "any", strands: int = 2, seq: str = "seq") -> float:
    """Log of the ways to place ``sites`` in the sequences.

    Any number of sites: as ``placements`` has it, among all starts.  At most one a sequence:
    the places of the ``sites`` longest sequences, times the choices of sequences.  Sequences
    are counted by length; one number comes to the driver."""
    places = F.length(seq) - width + 1
    if spread == "any":
        starts = seqs.agg(F.sum(F.greatest(places, F.lit(0)))).first()[0] or 0
        return total_placements(float(starts), float(sites), strands)
    lengths = seqs.where(places > 0).groupBy(places.alias("places")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(lengths, "places", ["n"], descending=True)
    taken = F.greatest(F.least(F.col("n"), F.lit(sites) - (F.col("upto_n") - F.col("n"))), F.lit(0))
    row = ranked.agg(F.sum(taken * F.log(F.col("places") * strands)).alias("ways"), F.max("all_n").alias("n")).first()
    n = row["n"] or 0
    if sites > n:
        return -math.inf
    return row["ways"] + math.lgamma(n + 1) - math.lgamma(sites + 1) - math.lgamma(n - sites + 1)


def _log_factors(starts: float, begin: int, end: int, strands: int) -> np.ndarray:
    """Logs of the factors of ``total_placements`` from the ``begin``-th site on."""
    i = np.arange(begin, end, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(np.floor((starts - i) * strands / (i + 1)))


def total_placements(starts: float, sites: float, strands: int = 2) -> float:
    out = 0.0
    for begin in range(0, int(sites), 1 << 20):
        out += float(_log_factors(starts, begin, min(begin + (1 << 20), int(sites)), strands).sum())
    return out if math.isfinite(out) else math.nan


def placements_table(spark: SparkSession, starts: float, most: int, strands: int = 2) -> np.ndarray:
    """``total_placements`` of every multiple of ``BLOCK`` sites up to ``most``; blocks are summed in tasks, and one number of each comes to the driver."""

    @F.pandas_udf("double")
    def run(block: pd.Series) -> pd.Series:
        return pd.Series([float(_log_factors(starts, b * BLOCK, (b + 1) * BLOCK, strands).sum()) for b in block], dtype=float)

    rows = spark.range(most // BLOCK).select("id", run("id").alias("total")).collect() if most >= BLOCK else []
    return np.cumsum([0.0, *(r["total"] for r in sorted(rows))])


def read_placements(table: np.ndarray, starts: float, sites: np.ndarray, strands: int = 2) -> np.ndarray:
    """``total_placements`` of many numbers of sites at once, from ``placements_table``.

    Each block that they lie in is summed once, so numbers that come in order cost a step each."""
    out, block = np.empty(len(sites)), sites // BLOCK
    for b in np.unique(block):
        own = np.flatnonzero(block == b)
        into = sites[own] - b * BLOCK
        out[own] = table[b] + np.cumsum(np.append(0.0, _log_factors(starts, b * BLOCK, b * BLOCK + int(into.max()), strands)))[into]
    return np.where(np.isfinite(out), out, np.nan)


def motif_significance(columns: DataFrame, keys: list[str], background: dict[str, float], starts: Column | None) -> DataFrame:
    """keys, width, llr, information and log_evalue of each motif.

    ``columns`` has keys, pos, A, C, G, T and nsites; ``starts`` is the number of
    possible places.  A motif's E-value multiplies the p-value of its columns'
    product by the ways to place its sites; without ``starts`` the result has ``log_p``,
    the log of that p-value, in its place."""
    rows = relative_entropy(columns, background).withColumn("ratio", F.round(F.col("nsites") * F.col("entropy_nats"), DECIMALS))
    rows = rows.withColumn("log_p", column_log_p(background)(F.col("ratio"), F.col("nsites").cast("double")))
    more = [] if starts is None else [F.first(starts).alias("starts")]
    motifs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("width"), F.first("nsites").alias("nsites"), F.sum("ratio").alias("llr"), F.round(F.sum("information"), DECIMALS).alias("information"), F.sum("log_p").alias("log_p"), *more)
    log_p = log_product_p(F.col("width").cast("int"), F.col("log_p"))
    if starts is None:
        return motifs.select(*keys, "width", "nsites", "llr", "information", log_p.alias("log_p"))
    return motifs.select(*keys, "width", "nsites", "llr", "information", (log_p + placements()(F.col("starts"), F.col("nsites").cast("long"))).alias("log_evalue"))
