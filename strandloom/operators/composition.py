"""Letter and tuple statistics, count matrices and what is read off them.

A matrix is a long table (keys, pos, letter, value), or, for small work on one
motif, an array of rows in the order A, C, G, T.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import IUPAC, revcomp
from strandloom.operators.tuples import tuple_counts

LETTERS = "ACGT"
#: Column of each letter of an aligned word, and of a gap or N.
LETTER_WEIGHT, OTHER_WEIGHT, GAP_COLUMN = 0.88, 0.04, (0.23, 0.27, 0.27, 0.23)


def letter_frequencies(seqs: DataFrame, prior: float = 1.0, seq: str = "seq") -> DataFrame:
    """letter and freq over all sequences, each count raised by ``prior``; other letters are ignored."""
    counts = [F.coalesce(F.sum(F.length(seq) - F.length(F.replace(F.col(seq), F.lit(x), F.lit("")))), F.lit(0)).alias(x) for x in LETTERS]
    row = seqs.agg(*counts)
    total = sum((F.col(x) for x in LETTERS[1:]), F.col("A")) + 4 * prior
    return row.select(F.explode(F.array(*(F.struct(F.lit(x).alias("letter"), ((F.col(x) + prior) / total).alias("freq")) for x in LETTERS))).alias("r")).select("r.*")


def pair_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """Counts of adjacent pairs of known letters."""
    return tuple_counts(seqs, [2], seq).withColumnRenamed("word", "pair")


def count_matrix(words: DataFrame, keys: list[str], width: int, word: str = "word") -> DataFrame:
    """keys, pos, A, C, G, T: letters at each place of equal-length words, as one aggregate.

    Case is folded, and other letters count nowhere.  Words of another length are an error."""
    legal = F.when(F.length(word) == width, F.col(word)).otherwise(F.raise_error(F.concat(F.lit("a word of another length than the matrix: "), F.coalesce(F.col(word), F.lit("null")))).cast("string"))
    words = words.withColumn(word, legal)
    placed = [F.struct(F.lit(p).alias("pos"), *(F.count_if(F.upper(F.substring(word, p + 1, 1)) == x).alias(x) for x in LETTERS)) for p in range(width)]
    return words.groupBy(*keys).agg(F.array(*placed).alias("m")).select(*keys, F.inline("m"))


def probability_matrix(counts: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """Rows of a count matrix as probabilities, each count raised by ``pseudo``."""
    total = sum((F.col(x) for x in LETTERS[1:]), F.col("A")) + 4 * pseudo
    return counts.select(*[c for c in counts.columns if c not in LETTERS], *(F.when(total > 0, (F.col(x) + pseudo) / total).otherwise(0.25).alias(x) for x in LETTERS))


def column_information(a: Column, c: Column, g: Column, t: Column, pseudo: float = 0.1, eps: float = 1e-4) -> Column:
    """Entropy in bits of an alignment column's counts, with its two pseudo-counts."""
    total = a + c + g + t
    first = [(x + pseudo) / (total + 4 * pseudo) for x in (a, c, g, t)]
    whole = sum(first[1:], first[0])
    p = [(x + eps) / (whole + 4 * eps) for x in first]
    terms = [x * F.log2(x) for x in p]
    return -sum(terms[1:], terms[0])


def consensus_letter(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Consensus letter of a probability row: one letter from 0.7, a pair above 0.8, else the letter that lacks."""
    total = a + c + g + t
    a, c, g, t = (x / total for x in (a, c, g, t))
    rules = [(a >= 0.7, "A"), (t >= 0.7, "T"), (c >= 0.7, "C"), (g >= 0.7, "G")]
    rules += [(a + t > 0.8, "W"), (a + c > 0.8, "M"), (a + g > 0.8, "R"), (t + c > 0.8, "Y"), (t + g > 0.8, "K"), (c + g > 0.8, "S")]
    rules += [(a < 0.1, "B"), (t < 0.1, "V"), (c < 0.1, "D"), (g < 0.1, "H")]
    return reduce(lambda when, rule: when.when(*rule), rules[1:], F.when(*rules[0])).otherwise("N")


def multilevel_consensus(a: Column, c: Column, g: Column, t: Column, least: float = 0.2) -> Column:
    """Letters of at least ``least``, most likely first (ties by letter)."""
    ranked = F.array_sort(F.array(*(F.struct((-x).alias("p"), F.lit(n).alias("letter")) for x, n in ((a, "A"), (c, "C"), (g, "G"), (t, "T")))))
    return F.array_join(F.transform(F.filter(ranked, lambda r: -r["p"] >= least), lambda r: r["letter"]), "")


def prosite(multilevel: DataFrame, keys: list[str]) -> DataFrame:
    """Regular expression of a motif from its columns' multilevel letters (pos, letters)."""
    part = F.when(F.length("letters") == 1, F.col("letters")).when(F.length("letters") == 0, "N").otherwise(F.concat(F.lit("["), F.col("letters"), F.lit("]")))
    rows = multilevel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("r"))
    return rows.select(*keys, F.array_join("r.part", "").alias("regexp"))


def weighted_pfm(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, A, C, G, T, letter: matrix of aligned words weighted by z, and its consensus letter.

    ``members`` has ``aligned`` (padded with dots on the left) and ``weight``; words
    are padded on the right to the widest of their key."""
    widest = members.groupBy(*keys).agg(F.max(F.length("aligned")).alias("width"))
    padded = members.join(widest, keys).withColumn("aligned", F.rpad("aligned", F.col("width"), "."))
    letters = padded.select(*keys, "weight", F.posexplode(F.filter(F.split("aligned", ""), lambda c: c != "")).alias("pos", "x"))
    gap = F.col("x").isin(".", "N")

    def weight(letter: str) -> Column:
        own = F.when(F.col("x") == letter, LETTER_WEIGHT).otherwise(OTHER_WEIGHT)
        return F.when(gap, GAP_COLUMN[LETTERS.index(letter)]).when(F.col("x").isin(*LETTERS), own).otherwise(0.0)

    sums = letters.groupBy(*keys, "pos").agg(*(F.sum(F.col("weight") * weight(x)).alias(x) for x in LETTERS), F.array_join(F.array_sort(F.collect_set(F.when(F.col("x").isin(*LETTERS), F.col("x")))), "").alias("seen"))
    total = sum((F.col(x) for x in LETTERS[1:]), F.col("A"))
    names = F.create_map(*(F.lit(x) for code, seen in IUPAC.items() for x in (seen, code)))
    return sums.select(*keys, "pos", *((F.col(x) / total).alias(x) for x in LETTERS), F.coalesce(F.try_element_at(names, F.col("seen")), F.lit("N")).alias("letter"))


def consensus_string(pfm: DataFrame, keys: list[str]) -> DataFrame:
    rows = pfm.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("r"))
    return rows.select(*keys, F.array_join("r.letter", "").alias("consensus"))


def word_pfm(words: DataFrame, word: str = "word") -> DataFrame:
    """word, pos, A, C, G, T: a consensus word's own matrix, smoothed and given to four decimals."""
    letters = words.select(F.col(word).alias("word"), F.posexplode(F.filter(F.split(F.upper(word), ""), lambda c: c != "")).alias("pos", "code"))
    table = F.create_map(*(F.lit(x) for code, members in IUPAC.items() if code not in "BDHV" for x in (code, members)))
    members = F.element_at(table, F.col("code"))
    rows = letters.withColumn("members", members)
    share = [F.when(F.contains("members", F.lit(x)), 1 / F.length("members")).otherwise(0.0) for x in LETTERS]
    return rows.select("word", "pos", *(F.round(((s + 0.01) / 1.04), 4).alias(x) for s, x in zip(share, LETTERS, strict=True)))


def markov_counts(seqs: DataFrame, order: int, both_strands: bool = False, seq: str = "seq") -> DataFrame:
    """tuple, cnt: tuples of one to ``order`` + 1 known letters, and their reverse complements if asked."""
    counts = tuple_counts(seqs, list(range(1, order + 2)), seq).withColumnRenamed("word", "tuple")
    if both_strands:
        counts = counts.unionByName(counts.withColumn("tuple", revcomp(F.col("tuple")))).groupBy("tuple").agg(F.sum("cnt").alias("cnt"))
    return counts


def markov_probabilities(counts: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """tuple, prob, conditional: share among tuples of that length, and of the last letter given those before.

    There are few tuples (4 ** order), so the windows over them are small."""
    raised = counts.withColumn("value", F.col("cnt") + epsilon).withColumn("len", F.length("tuple"))
    by_length, by_prefix = Window.partitionBy("len"), Window.partitionBy("len", "prefix")
    rows = raised.withColumn("prefix", F.expr("substring(tuple, 1, length(tuple) - 1)"))
    prefix_mass = F.sum("value").over(by_prefix)
    return rows.select("tuple", "cnt", (F.col("value") / F.sum("value").over(by_length)).alias("prob"), F.when(prefix_mass > 0, F.least(F.col("value") / prefix_mass, F.lit(1.0))).otherwise(0.0).alias("conditional"))


def x_tuples(tuples: DataFrame, value: str = "prob") -> DataFrame:
    """Tuples over A, C, G, T and X, where X stands for any letter: values are summed over what it stands for."""
    letters = F.filter(F.split("tuple", ""), lambda c: c != "")
    grown = F.aggregate(letters, F.array(F.lit("")), lambda words, c: F.flatten(F.transform(words, lambda w: F.array(F.concat(w, c), F.concat(w, F.lit("X"))))))
    rows = tuples.select(F.explode(grown).alias("tuple"), value)
    return rows.groupBy("tuple").agg(F.sum(value).alias(value))


def checked_tuples(tuples: DataFrame, order: int, value: str = "prob", error: float = 1e-2) -> DataFrame:
    """``tuples`` of each length from 1 to ``order`` + 1; an error where some are missing, out of (0, 1], or don't sum to one."""
    sums = tuples.withColumn("__n", F.length("tuple")).groupBy("__n").agg(F.count(F.lit(1)).alias("__have"), F.sum(value).alias("__sum"))
    wrong = (F.col("__have") != F.pow(F.lit(4), F.col("__n"))) | (F.abs(F.col("__sum") - 1) > error)
    lengths = tuples.sparkSession.range(1, order + 2).withColumnRenamed("id", "__n")  # a few rows
    bad = lengths.join(sums, "__n", "left").agg(F.count_if(F.coalesce(wrong, F.lit(True))).alias("__bad"))
    legal = (F.col("__bad") == 0) & (F.col(value) > 0) & (F.col(value) <= 1)
    checked = F.when(legal, F.col(value)).otherwise(F.raise_error(F.lit("tuples are missing or no probabilities")).cast("double"))
    return tuples.join(F.broadcast(bad)).withColumn(value, checked).select(*tuples.columns)


def averaged_strands(tuples: DataFrame, value: str = "prob") -> DataFrame:
    """Tuples with the mean of their own and their reverse complement's value."""
    other = tuples.select(revcomp(F.col("tuple")).alias("tuple"), F.col(value).alias("__other"))
    return tuples.join(other, "tuple", "left").withColumn(value, (F.col(value) + F.coalesce("__other", F.lit(0.0))) / 2).drop("__other")


def log_odds(pfm: DataFrame, background: dict[str, float], scale: float = 1.0, pseudo: float = 0.0) -> DataFrame:
    """Rows of a probability matrix as scale * log2(p / background)."""
    rest = [c for c in pfm.columns if c not in LETTERS]
    return pfm.select(*rest, *((F.log2((F.col(x) + pseudo * background[x]) / (1 + pseudo) / background[x]) * scale).alias(x) for x in LETTERS))
