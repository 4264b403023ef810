"""Transforms of motif matrices: long tables of keys, pos, A, C, G, T.

A motif is a few rows; tables may hold any number of motifs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import IUPAC

LETTERS = "ACGT"
#: Sites of a motif that has none given, the least frequency before a logarithm, decimals of a scale, and the error of a column's sum that is borne.
DEFAULT_SITES, LEAST_FREQUENCY, SCALE_DECIMALS, SUM_ERROR = 20, 5e-7, 14, 0.01


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _of_letters(rows: DataFrame, value) -> DataFrame:
    """``rows`` with each letter's column replaced by ``value`` of the letter."""
    return rows.select(*(value(c).alias(c) if c in LETTERS else F.col(c) for c in rows.columns))


def _normalised(rows: DataFrame) -> DataFrame:
    total = _total([F.col(x) for x in LETTERS])
    return _of_letters(rows, lambda x: F.when(total == 0, 0.25).otherwise(F.col(x) / total))


def reverse_complement(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Each motif as it reads on the other strand."""
    widths = columns.groupBy(*keys).agg(F.max("pos").alias("__last"))
    swapped = columns.join(widths, keys).withColumn("pos", F.col("__last") - F.col("pos"))
    return _of_letters(swapped.select(*columns.columns), lambda x: F.col(LETTERS[3 - LETTERS.index(x)]))


def balanced(columns: DataFrame) -> DataFrame:
    """Frequencies averaged over complementary letters."""
    return _of_letters(columns, lambda x: (F.col(x) + F.col(LETTERS[3 - LETTERS.index(x)])) / 2)


def with_pseudocount(columns: DataFrame, background: dict[str, float], pseudo: float, sites: Column | int = DEFAULT_SITES) -> DataFrame:
    """Frequencies after ``pseudo`` counts of the background."""
    sites = F.lit(sites)
    return _of_letters(columns, lambda x: (F.col(x) * sites + pseudo * background[x]) / (sites + pseudo))


def scores_of(columns: DataFrame, background: dict[str, float], sites: Column | int = DEFAULT_SITES, pseudo: float = 0.0) -> DataFrame:
    """Frequencies as scores: 100 * log2(p / background), after ``pseudo`` counts."""
    raised = with_pseudocount(columns, background, pseudo, sites)
    return _of_letters(raised, lambda x: 100 * F.log2(F.when(F.col(x) <= 0, LEAST_FREQUENCY).otherwise(F.col(x)) / background[x]))


def frequencies_of(scores: DataFrame, background: dict[str, float], sites: Column | int = DEFAULT_SITES, pseudo: float = 0.0) -> DataFrame:
    """The inverse of ``scores_of``; frequencies are held between 0 and 1 and rows normalised."""
    sites = F.lit(sites)
    raw = _of_letters(scores, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.pow(F.lit(2.0), F.col(x) / 100) * background[x] * (sites + pseudo) - pseudo * background[x]) / sites)))
    return _normalised(raw)


def checked_frequencies_of(scores: DataFrame, background: dict[str, float]) -> DataFrame:
    """Frequencies of scores of 100 * log2; an error where a row's sum is not near one."""
    raw = _of_letters(scores, lambda x: F.pow(F.lit(2.0), F.col(x) / 100) * background[x])
    total = _total([F.col(x) for x in LETTERS])
    legal = F.when(F.abs(total - 1) <= SUM_ERROR, total).otherwise(F.raise_error(F.lit("a column's probabilities don't sum to one: the background doesn't fit")).cast("double"))
    return _of_letters(raw, lambda x: F.col(x) / legal)


def information(background: dict[str, float] | None = None, base: float = 2.0) -> Column:
    """Relative entropy of a row to a background (even by default)."""
    q = background or dict.fromkeys(LETTERS, 0.25)
    return _total([F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / q[x]) / float(np.log(base))).otherwise(0.0) for x in LETTERS])


def trims(columns: DataFrame, keys: list[str], bits: float) -> DataFrame:
    """keys, trim_left, trim_right: columns under ``bits`` of information at either end (all of them on the left if none has more)."""
    enough = F.when(information() >= bits, F.col("pos"))
    ends = columns.groupBy(*keys).agg(F.min(enough).alias("first"), F.max(enough).alias("last"), F.count(F.lit(1)).alias("width"))
    return ends.select(*keys, F.coalesce("first", "width").cast("int").alias("trim_left"), F.coalesce(F.col("width") - 1 - F.col("last"), F.lit(0)).cast("int").alias("trim_right"))


def trimmed(columns: DataFrame, keys: list[str], bits: float) -> DataFrame:
    """The columns between the trims, numbered from 0."""
    cut = columns.join(trims(columns, keys, bits), keys)
    last = F.max("pos").over(Window.partitionBy(*keys))
    kept = cut.withColumn("__last", last).where((F.col("pos") >= F.col("trim_left")) & (F.col("pos") <= F.col("__last") - F.col("trim_right")))
    return kept.withColumn("pos", F.col("pos") - F.col("trim_left")).select(*columns.columns)


def complexity(columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys and complexity: the mean divergence (in nats) of a motif's columns from their own mean."""
    means = columns.groupBy(*keys).agg(*(F.avg(x).alias(f"__{x}") for x in LETTERS))
    terms = [F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / F.col(f"__{x}"))).otherwise(0.0) for x in LETTERS]
    return columns.join(means, keys).groupBy(*keys).agg(F.avg(_total(terms)).alias("complexity"))


def information_position(columns: DataFrame, keys: list[str], background: dict[str, float], percent: float, from_start: bool = True) -> DataFrame:
    """keys and columns: how many columns from an end hold ``percent`` of a motif's relative entropy."""
    rows = columns.withColumn("__h", information(background))
    order = Window.partitionBy(*keys).orderBy(F.col("pos") if from_start else F.col("pos").desc())
    run = rows.withColumns({"__upto": F.sum("__h").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "__all": F.sum("__h").over(Window.partitionBy(*keys)), "__n": F.row_number().over(order)})
    return run.groupBy(*keys).agg(F.coalesce(F.min(F.when(100 * F.col("__upto") >= percent * F.col("__all"), F.col("__n"))), F.max("__n")).alias("columns"))


def best_match(columns: DataFrame, keys: list[str]) -> DataFrame:
    """keys and word: each column's most likely letter, the last of equal ones."""
    letter = F.array_max(F.array(*(F.struct(F.col(x).alias("p"), F.lit(x).alias("letter")) for x in LETTERS)))["letter"]
    rows = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter")))).alias("r"))
    return rows.select(*keys, F.array_join("r.letter", "").alias("word"))


def with_ambiguous(columns: DataFrame) -> DataFrame:
    """Frequencies of the ambiguity codes too: the sum over the letters that each stands for."""
    return columns.select("*", *(_total([F.col(x) for x in members]).alias(code) for code, members in IUPAC.items() if len(members) > 1))


def shared_out(counts: DataFrame) -> DataFrame:
    """Counts of ambiguity codes shared out evenly among the letters that they stand for."""
    codes = {c: m for c, m in IUPAC.items() if len(m) > 1 and c in counts.columns}
    added = {x: _total([F.col(x), *(F.col(c) / len(m) for c, m in codes.items() if x in m)]) for x in LETTERS}
    return counts.select(*(added[c].alias(c) if c in LETTERS else F.col(c) for c in counts.columns if c not in codes))


def score_range(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, least, most: the lowest and highest sum of scores of a word."""
    return scores.groupBy(*keys).agg(F.sum(F.least(*LETTERS)).alias("least"), F.sum(F.greatest(*LETTERS)).alias("most"))


def scaled(scores: DataFrame, keys: list[str], steps: int = 100) -> DataFrame:
    """Scores in whole steps from 0 to ``steps``, with ``scale`` and ``offset`` (scale 0 and untouched scores where all are equal)."""
    ends = scores.groupBy(*keys).agg(F.min(F.least(*LETTERS)).alias("offset"), F.max(F.greatest(*LETTERS)).alias("__high"))
    scale = F.when(F.col("__high") > F.col("offset"), F.round(steps / (F.col("__high") - F.col("offset")), SCALE_DECIMALS)).otherwise(0.0)
    rows = scores.join(ends.withColumn("scale", scale), keys)
    out = _of_letters(rows, lambda x: F.when(F.col("scale") == 0, F.col(x)).otherwise(F.rint((F.col(x) - F.col("offset")) * F.col("scale"))))
    return out.select(*scores.columns, "scale", "offset")


def correlations(scores: DataFrame, key: str, most_columns: int = 100_000) -> DataFrame:
    """one, two, correlation of every pair of motifs (one > two): the best sum of column correlations over all offsets, by the shorter width.

    Columns of motifs meet one another in a join that is broadcast, up to ``most_columns`` of them."""
    mean = _total([F.col(x) for x in LETTERS]) / 4
    centred = scores.select(F.col(key).alias("k"), "pos", *((F.col(x) - mean).alias(x) for x in LETTERS))
    width = Window.partitionBy("k")
    centred = centred.withColumn("w", F.count(F.lit(1)).over(width))
    left = centred.select(*(F.col(c).alias(f"a_{c}") for c in centred.columns))
    right = centred.select(*(F.col(c).alias(f"b_{c}") for c in centred.columns))
    right = F.broadcast(right) if centred.count() <= most_columns else right
    both = left.join(right, F.col("a_k") > F.col("b_k"))
    dot, aa, bb = (_total([F.col(f"{p}_{x}") * F.col(f"{q}_{x}") for x in LETTERS]) for p, q in ("ab", "aa", "bb"))
    r = F.when(aa * bb > 0, dot / F.sqrt(aa * bb)).otherwise(1.0)
    sums = both.groupBy(F.col("a_k").alias("one"), F.col("b_k").alias("two"), (F.col("a_pos") - F.col("b_pos")).alias("off")).agg(F.sum(r).alias("r"), F.first(F.least("a_w", "b_w")).alias("w"))
    return sums.groupBy("one", "two").agg((F.max("r") / F.first("w")).alias("correlation"))


def score_tail(scores: list[list[int]], background: list[float]) -> np.ndarray:
    """P(sum of scores >= s) for s from 0, of a word drawn from the background; ``scores`` are whole numbers from 0.

    A motif's columns are convolved one by one: w * steps + 1 numbers at most."""
    mass = np.ones(1)
    for row in scores:
        grown = np.zeros(len(mass) + max(row))
        for s, p in zip(row, background, strict=True):
            grown[s : s + len(mass)] += p * mass
        mass = grown
    return np.cumsum(mass[::-1])[::-1]


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, count, mean, deviation of values in ``bins`` equal bins of [low, high]; values outside go to the end bins, nulls to none."""
    place = F.floor((F.col(value) - low) / ((high - low) / bins))
    held = F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(held.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
