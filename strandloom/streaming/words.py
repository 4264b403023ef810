"""Words and sites of sequences that arrive as a stream.

``running_counts`` keeps totals in Spark's state store (complete or update mode);
``windowed_counts`` closes event-time windows behind a watermark (append mode);
``sites`` is stateless and keeps every mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import canonical
from strandloom.functions.windows import known_windows
from strandloom.operators import scan


def running_counts(seqs: DataFrame, width: int) -> DataFrame:
    """word, cnt over all sequences so far, both strands folded."""
    words = known_windows(seqs, width, ["seq_id"])
    return words.groupBy(canonical(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def windowed_counts(seqs: DataFrame, width: int, time: str, late: str, span: str) -> DataFrame:
    """window, word, cnt for each span of event time; rows later than ``late`` are left out."""
    words = known_windows(seqs.withWatermark(time, late), width, ["seq_id", time])
    return words.groupBy(F.window(time, span), canonical(F.col("word")).alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def sites(seqs: DataFrame, log_odds: scan.Matrix, rate: float) -> DataFrame:
    """Sites of each sequence as it arrives."""
    return scan.sites(seqs, log_odds, rate)
