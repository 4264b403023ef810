"""Statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pseudo-count of letters, and what is added to each count before normalising.
LETTER_PSEUDO, NORMALISING_EPS = 0.01, 1e-5
#: Fixed value: pi as the factorial approximation has it.
ROUGH_PI = 3.14159


def entropy(counts: list[Column], eps: float = NORMALISING_EPS) -> Column:
    """Entropy in bits of counts, each raised by ``eps`` and normalised."""
    raised = [c + eps for c in counts]
    total = sum(raised[1:], raised[0])
    terms = [r / total * F.log2(r / total) for r in raised]
    return -sum(terms[1:], terms[0])


def _occurrences(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def letter_entropy(seq: Column) -> Column:
    """Entropy of A, C, G, T in a string, case folded."""
    return entropy([_occurrences(F.upper(seq), x).cast("double") + LETTER_PSEUDO for x in "ACGT"])


def pair_entropy(pairs: Column) -> Column:
    """Entropy of the sixteen letter pairs of a string, from their counts (``tuples.sequence_pair_counts``)."""
    return entropy([pairs[k].cast("double") + LETTER_PSEUDO for k in range(16)])


def log_factorial(n: Column) -> Column:
    """ln n!, exact below 5 and by Stirling's formula from there."""
    n = n.cast("double")
    small = F.element_at(F.array(*(F.lit(math.log(math.factorial(k))) for k in range(5))), (F.greatest(F.least(n, F.lit(4.0)), F.lit(0.0)) + 1).cast("int"))
    return F.when(n < 5, small).otherwise(n * F.log(n) - n + F.log(2 * ROUGH_PI * n) / 2)


def hypergeometric(population: Column, drawn: Column, marked: Column, hits: Column) -> Column:
    """Probability of ``hits`` marked ones among ``drawn`` of ``population``."""
    ways = [marked, population - marked, population - drawn, drawn]
    parts = [population, marked - hits, hits, population - marked - drawn + hits, drawn - hits]
    return F.exp(sum((log_factorial(x) for x in ways[1:]), log_factorial(ways[0])) - sum((log_factorial(x) for x in parts[1:]), log_factorial(parts[0])))


#: Terms of a tail that are summed at a time.
TAIL_BLOCK = 1 << 16


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """``log_factorial`` over an array."""
    with np.errstate(divide="ignore", invalid="ignore"):
        large = n * np.log(n) - n + np.log(2 * ROUGH_PI * n) / 2
    small = np.array([math.log(math.factorial(k)) for k in range(5)])
    return np.where(n < 5, small[np.clip(n, 0, 4).astype(int)], large)


def tail_probability(population: float, drawn: float, marked: float, hits: float, upper: bool) -> float:
    """Sum of hypergeometric terms from ``hits`` on, away from or over the mode, until they vanish."""
    most, least = min(drawn, marked), max(0.0, drawn + marked - population)
    ways = _log_factorials(np.array([marked, population - marked, population - drawn, drawn, population]))
    fixed = ways[:4].sum() - ways[4]
    mode = math.floor((drawn + 1) * (marked + 1) / (population + 2))
    at, total = (max(hits, least) if upper else min(hits, most)), 0.0
    while least <= at <= most:
        k = at + np.arange(min(TAIL_BLOCK, most - at + 1)) if upper else at - np.arange(min(TAIL_BLOCK, at - least + 1))
        terms = np.exp(fixed - sum(_log_factorials(x) for x in (marked - k, k, population - marked - drawn + k, drawn - k)))
        total += float(terms.sum())
        past = k[-1] > mode if upper else k[-1] < mode
        if past and terms[-1] * TAIL_BLOCK <= 1e-16 * total:
            break
        at = k[-1] + (1 if upper else -1)
    return total


def hypergeometric_tail(population: Column, drawn: Column, marked: Column, hits: Column, upper: bool = True) -> Column:
    """Probability of at least (or at most) ``hits``; memory is one block of terms, whatever the population."""

    @F.pandas_udf("double")
    def run(population: pd.Series, drawn: pd.Series, marked: pd.Series, hits: pd.Series) -> pd.Series:
        rows = zip(population, drawn, marked, hits, strict=True)
        return pd.Series([math.nan if any(pd.isna(x) for x in r) else tail_probability(*map(float, r), upper) for r in rows], dtype=float)

    return run(*(c.cast("double") for c in (population, drawn, marked, hits)))


def log10_or_floor(p: Column, floor: float = -30.0) -> Column:
    return F.when(p <= 0, floor).otherwise(F.log10(p))


def mann_whitney_z(group: Column, population: Column, rank_sum: Column) -> Column:
    spread = F.sqrt(group * (population - group) * (population + 1) / 12)
    return F.when(spread > 0, (group * (population + 1) / 2 - rank_sum) / spread).otherwise(0.0)


def kolmogorov_p(distance: Column, effective: Column, terms: int = 100) -> Column:
    """p-value of a two-sample Kolmogorov-Smirnov distance; the alternating series to ``terms`` terms."""
    root = F.sqrt(effective)
    lam = (root + 0.12 + F.lit(0.11) / root) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * lam * lam * j * j)
    )
    return F.when(lam < 0.04, 1.0).otherwise(series)


def log_product_p(n: Column, log_product: Column) -> Column:
    """Log p-value of the log of a product of ``n`` uniform variables."""
    state = F.aggregate(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, i: F.struct((s["term"] * -log_product / i).alias("term"), (s["total"] + s["term"] * -log_product / i).alias("total")),
    )
    return F.when(n == 0, 0.0).otherwise(log_product + F.log(state["total"]))


def log_combinations(n: Column, k: Column) -> Column:
    """ln of n over k, summed term by term."""
    terms = F.transform(F.sequence(F.lit(1), k), lambda i: F.log((n - i + 1) / i))
    return F.when(k == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def log_placements(starts: Column, sites: Column, strands: int = 2, whole_division: bool = True) -> Column:
    """ln of the ways to place ``sites`` among ``starts``; ``whole_division`` truncates each factor."""

    def factor(i: Column) -> Column:
        raw = (starts - i) * strands / (i + 1)
        return F.log(F.floor(raw) if whole_division else raw)

    terms = F.transform(F.sequence(F.lit(0).cast("long"), sites.cast("long") - 1), factor)
    return F.when(sites == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
