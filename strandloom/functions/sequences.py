"""Column functions over sequence strings.

All of them are built-in expressions, so they stay inside Spark's JVM plan and
give null for null input.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC code of each set of letters.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "K": "GT", "M": "AC", "S": "CG", "W": "AT", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Amino acids by codon, bases in the order TCAG, stop as ``_``.
CODON_BASES, CODON_LETTERS = "TCAG", "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Letters of the alphabets, in the order in which they are tried.
ALPHABETS = {"DNA": "ACGT", "RNA": "ACGU", "Extended DNA": "ACGTYRN", "Protein": "ACDEFGHIKLMNPQRSTVWY", "Extended Protein": "ACDEFGHIKLMNPQRSTVWYX", "TM Labels": "MIO"}


def normalised(seq: Column) -> Column:
    """Upper case, U as T, and every ambiguity code as N; other characters pass."""
    return F.translate(F.upper(seq), "URYKMBVDHSW", "TNNNNNNNNNN")


def revcomp(seq: Column) -> Column:
    """Reverse complement of upper-case IUPAC letters."""
    return F.reverse(F.translate(seq, "ACGTURYKMBVDHSWN", "TGCAAYRMKVBHDSWN"))


def revcomp_cased(seq: Column) -> Column:
    """Reverse complement that keeps the case of a, c, g, t; ambiguity codes in upper case."""
    return F.reverse(F.translate(seq, "ACGTacgtRYKMBDHV", "TGCAtgcaYRMKVHDB"))


def canonical(word: Column) -> Column:
    """The lesser of a word and its reverse complement."""
    return F.least(word, revcomp(word))


def gapped(left: Column, gap: Column, right: Column) -> Column:
    return F.concat(left, F.repeat(F.lit("N"), gap), right)


def codes(seq: Column, letters: str = "ACGT") -> Column:
    """Place of each letter in ``letters``, -1 for others."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.instr(F.lit(letters), c) - 1)


def revcomp_codes(code: Column) -> Column:
    return F.reverse(F.transform(code, lambda c: F.when(c < 0, c).otherwise(3 - c)))


def is_over(seq: Column, letters: str) -> Column:
    """Whether all characters of a non-empty string are in ``letters``."""
    return (F.length(seq) > 0) & (F.translate(seq, letters, "") == "")


def alphabet_of(seq: Column) -> Column:
    """Name of the first alphabet that has all letters of the string."""
    first, *others = ALPHABETS.items()
    return reduce(lambda when, item: when.when(is_over(seq, item[1]), item[0]), others, F.when(is_over(seq, first[1]), first[0]))


def site(seq: Column, start: Column, width: Column | int) -> Column:
    """``width`` letters from 0-based ``start``; an error where that leaves the string."""
    width = F.lit(width)
    inside = (start >= 0) & (start + width <= F.length(seq))
    return F.when(inside, F.substring(seq, start + 1, width)).otherwise(F.raise_error(F.lit("site outside of sequence")).cast("string"))


def iupac_regex(consensus: Column, between: str = "") -> Column:
    """Regular expression of a consensus; ``between`` (such as ``-*``) stands between symbols."""
    table = F.create_map(*(F.lit(x) for code, letters in IUPAC.items() for x in (code, letters if len(letters) == 1 else f"[{letters}]")))
    symbols = F.filter(F.split(F.upper(consensus), ""), lambda c: c != "")
    return F.array_join(F.transform(symbols, lambda c: F.coalesce(F.try_element_at(table, c), c)), between)


def concrete_words(consensus: Column) -> Column:
    """All strings over ACGT that a consensus stands for; the last ambiguous symbol varies slowest."""
    table = F.create_map(*(F.lit(x) for code, letters in IUPAC.items() for x in (code, letters)))

    def grow(words: Column, c: Column) -> Column:
        letters = F.split(F.element_at(table, c), "")
        return F.flatten(F.transform(letters, lambda x: F.transform(words, lambda w: F.concat(w, x))))

    return F.aggregate(F.split(consensus, ""), F.array(F.lit("")), grow)


def matches(a: Column, b: Column, fold_case: bool = True) -> Column:
    """Equal letters at equal places, up to the shorter length."""
    if fold_case:
        a, b = F.upper(a), F.upper(b)
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x == y).cast("int"))
    return F.when(n == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def translated(seq: Column) -> Column:
    """Protein of frame 0: ``_`` for stop, ``*`` for an unknown codon."""
    table = F.create_map(*(F.lit(x) for codon, letter in zip(product(CODON_BASES, repeat=3), CODON_LETTERS, strict=True) for x in ("".join(codon), letter)))
    places = F.sequence(F.lit(1), F.length(seq) - 2, F.lit(3))
    letters = F.transform(places, lambda i: F.coalesce(F.try_element_at(table, F.upper(F.substring(seq, i, F.lit(3)))), F.lit("*")))
    return F.when(F.length(seq) < 3, F.lit("")).otherwise(F.array_join(letters, ""))


def truncating_mod(x: Column, y: Column) -> Column:
    return x - F.when(x / y < 0, F.ceil(x / y)).otherwise(F.floor(x / y)) * y


def log_number(logx: Column) -> Column:
    """Text such as ``2.1e-009`` of exp(logx): a mantissa of one decimal and a three-digit exponent."""
    log10 = logx / F.log(F.lit(10.0))
    exponent = F.floor(log10)
    mantissa = F.round(F.pow(F.lit(10.0), log10 - exponent), 1)
    carried = mantissa >= 10
    exponent = F.when(carried, exponent + 1).otherwise(exponent)
    return F.format_string("%.1fe%+04d", F.when(carried, 1.0).otherwise(mantissa), exponent.cast("int"))


def log10_of_text(evalue: Column) -> Column:
    """log10 of a number such as ``3.2e-035``, also beyond the range of doubles."""
    mantissa = F.regexp_extract(evalue, r"^\s*([0-9.]+)", 1).cast("double")
    exponent = F.coalesce(F.nullif(F.regexp_extract(evalue, r"[eE]([+-]?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
    return F.log10(mantissa) + exponent


def ambiguous_amino_acid(codon: Column) -> Column:
    """Amino acid of a codon of IUPAC letters: X where its concrete codons differ, ``_`` for stop; null for other letters."""
    legal = codon.rlike("^[" + "".join(IUPAC) + "]{3}$")
    aminos = F.array_distinct(F.transform(concrete_words(F.when(legal, codon)), translated))
    return F.when(legal, F.when(F.size(aminos) == 1, aminos[0]).otherwise("X"))
