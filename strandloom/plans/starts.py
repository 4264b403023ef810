"""Search of starting points: every distinct word of the sequences, scored by its best n matches.

A word's matches are the windows that differ from it in the fewest letters.  How many windows agree
with it outside of any m places is one equi-join key per choice of places, and the counts at each number of
differences follow from those by inclusion and exclusion.  So no word meets another, and the work
is words times choices of places, whatever the number of windows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import revcomp
from strandloom.operators.tuples import tuple_counts


def word_counts(seqs: DataFrame, width: int, both_strands: bool = True, seq: str = "seq") -> DataFrame:
    """word, cnt: windows of known letters; with both strands a window counts as each of its two words, but once if they are one."""
    counts = tuple_counts(seqs.select(F.col(seq).alias("seq")), [width]).select("word", "cnt")
    if not both_strands:
        return counts
    both = counts.unionByName(counts.select(revcomp(F.col("word")).alias("word"), "cnt").where(revcomp(F.col("word")) != F.col("word")))
    return both.groupBy("word").agg(F.sum("cnt").alias("cnt"))


def masked(word: Column, places: tuple[int, ...]) -> Column:
    """``word`` without the letters at ``places``, after a mark of which places those are."""
    parts, at = [F.lit("".join(f"{p}." for p in places))], 0
    for p in (*places, None):
        end = p if p is not None else 255
        if end > at:
            parts.append(F.substring(word, at + 1, end - at))
        at = end + 1
    return F.concat(*parts)


def matches(counts: DataFrame, width: int, differences: int) -> DataFrame:
    """word and ``found``: of all windows, those that differ from the word in 0, 1, ... ``differences`` places.

    A window that differs in d places agrees outside of C(width - d, m - d) choices of m places."""
    keys = F.array(*(masked(F.col("word"), places) for m in range(differences + 1) for places in combinations(range(width), m)))
    rows = counts.select("word", "cnt", F.posexplode(keys).alias("choice", "key"))
    sums = rows.groupBy("key").agg(F.sum("cnt").alias("held"))
    sizes = [math.comb(width, m) for m in range(differences + 1)]
    group = F.lit(0)
    for m in range(1, differences + 1):
        group = F.when(F.col("choice") >= sum(sizes[:m]), m).otherwise(group)
    joined = rows.join(sums, "key").groupBy("word").agg(*(F.sum(F.when(group == m, F.col("held")).otherwise(0)).alias(f"t{m}") for m in range(differences + 1)))
    exact: list[Column] = []
    for m in range(differences + 1):
        exact.append(F.col(f"t{m}") - sum((math.comb(width - d, m - d) * exact[d] for d in range(m)), F.lit(0).cast("long")))
    return joined.select("word", F.array(*exact).alias("found"))


def scored(found: DataFrame, width: int, sites: list[int], own: float = 0.7) -> DataFrame:
    """word, nsites, matched, score: for each number of sites the sum of log likelihood ratios (even background) of the word's best so many matches.

    ``matched`` are the sites within the differences that were counted; the rest is taken to
    differ in one place more, the most that they can score."""
    same, other = math.log(own / 0.25), math.log((1 - own) / 3 / 0.25)
    worth = lambda d: (width - d) * same + d * other
    differences = F.size("found")
    rows = found.withColumn("nsites", F.explode(F.array(*map(F.lit, sites))))
    start = F.struct(F.col("nsites").cast("long").alias("left"), F.lit(0.0).alias("score"), F.lit(0).alias("d"))
    step = lambda a, n: F.struct((a["left"] - F.least(a["left"], n)).alias("left"), (a["score"] + F.least(a["left"], n) * worth(a["d"])).alias("score"), (a["d"] + 1).alias("d"))
    done = rows.withColumn("end", F.aggregate("found", start, step))
    total = F.col("end.score") + F.col("end.left") * worth(differences)
    return done.select("word", "nsites", (F.col("nsites") - F.col("end.left")).alias("matched"), total.alias("score"))


def start_points(seqs: DataFrame, width: int, sites: list[int], keep: int = 10, differences: int = 2, own: float = 0.7, both_strands: bool = True) -> DataFrame:
    """nsites, place, word, matched, score: for each number of sites the ``keep`` best words, the first by letters of equal ones.

    Of a word and its reverse complement, which match alike, only the lesser is kept."""
    counts = word_counts(seqs, width, both_strands)
    found = matches(counts, width, differences)
    if both_strands:
        found = found.where(F.col("word") <= revcomp(F.col("word")))
    order = Window.partitionBy("nsites").orderBy(F.round("score", 9).desc(), "word")
    ranked = scored(found, width, sites, own).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return ranked.select("nsites", "place", "word", "matched", "score")
