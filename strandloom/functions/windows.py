"""Windows of long strings.

``substring`` walks a string from its start, so cutting all windows out of one long
string costs its length squared.  Strings are first cut into blocks that overlap by
one window less a letter; each window then comes from one short block, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window starts of one block.
BLOCK = 256


def blocks(seqs: DataFrame, width: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """``keys``, ``base`` (0-based) and ``block``: BLOCK starts and what the last window needs beyond them."""
    n = F.length(seq)
    bases = F.sequence(F.lit(0), n - width, F.lit(BLOCK))
    long_enough = seqs.where(n >= width)
    return long_enough.select(*keys, F.explode(bases).alias("base"), seq).select(*keys, "base", F.substring(seq, F.col("base") + 1, F.lit(BLOCK + width - 1)).alias("block"))


def windows(seqs: DataFrame, width: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """``keys``, ``start`` (0-based) and ``word``: all windows of ``width`` letters."""
    cut = blocks(seqs, width, keys, seq)
    starts = F.sequence(F.lit(0), F.length("block") - width)
    placed = cut.select(*keys, "base", "block", F.explode(starts).alias("i"))
    return placed.select(*keys, (F.col("base") + F.col("i")).alias("start"), F.substring("block", F.col("i") + 1, F.lit(width)).alias("word"))


def known_windows(seqs: DataFrame, width: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """Windows without N."""
    return windows(seqs, width, keys, seq).where(~F.contains("word", F.lit("N")))
