"""Helpers that the training-data operators share.

``saved`` (of the library) cuts lineage with a Parquet table in the cluster's shared
folder, ``attach`` joins a per-key table back to rows whose keys may be hot, and
``split_words`` finds the words of a whole Arrow batch with a few numpy passes.
"""

from __future__ import annotations

import ctypes
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import storage
from strandloom.operators.packing import raw_letters, text_offsets
from strandloom.storage import shared_dir

__all__ = ["attach", "ascii_lower", "saved", "shared_dir"]

#: Text bytes handled by one numpy pass; one longer text is still taken whole.
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch: Spark and a Python worker both hold a batch whole.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"
#: At most this many hot keys are broadcast by ``attach``.
HOT_KEYS = 1000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """``storage.saved`` in Arrow batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``; the session's own bounds hold again afterwards."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: conf.get(name) for name in (rows, size)}
    if not 0 < int(before[rows]) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    conf.set(size, BATCH_BYTES)
    try:
        return storage.saved(df, by)
    finally:
        for name, value in before.items():
            conf.set(name, value)


def releasing(kernel):
    """``kernel``, which hands memory back to the system when a task ends: a Python worker lives on, and what it held would stay with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return run


def carried(docs: DataFrame):
    """All columns of ``docs`` as one struct ``row``, so that none of their names can meet an operator's own."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of ``carried`` rows with their ``text`` in front."""
    rows = batch.column(batch.schema.get_field_index("row"))
    return pa.RecordBatch.from_arrays([rows.field("text").cast(pa.string()), *batch.columns], names=["text", *batch.schema.names])


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join ``table`` (one row per ``key``) to ``rows``, safe for hot keys.

    ``weight`` is the number of rows of a key.  Keys that hold over a thousandth
    of all rows (so at most ``HOT_KEYS``) are broadcast; all others are joined
    by a shuffle.  Rows with a null key get nulls."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_KEYS > F.lit(int(total))
    columns = [c for c in table.columns if c != key]
    hot = table.where(is_hot).withColumn("__hot", F.lit(True))
    with_hot = rows.join(F.broadcast(hot), key, "left")
    done = with_hot.where(F.col("__hot")).drop("__hot")
    rest = with_hot.where(F.col("__hot").isNull()).drop("__hot", *columns)
    return done.unionByName(rest.join(table.where(~is_hot), key, "left"))


def ascii_lower(text):
    """Column with A-Z lower-cased and all else left alone.

    ``lower`` does it where a text is pure ASCII, ``translate`` elsewhere."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``size`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and each text's offsets in them; null texts are empty."""
    return raw_letters(text)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; UTF-8 continuation bytes are never in that range."""
    return data + (((data >= 65) & (data <= 90)) * np.uint8(32))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Returns the words, where each text's words begin among them (one more entry
    than texts), and each word's first byte and byte length."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    # The n-th solid byte belongs to the word that the latest start opened.
    marks = np.flatnonzero(begins[solid]) if len(starts) else starts
    kept = data[solid]
    word_offsets = np.append(marks, len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(word_offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(starts, offsets), starts, np.diff(word_offsets)


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned integers."""
    a = a.astype(np.uint64, copy=True)
    a ^= a >> np.uint64(30)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``bounds``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ceil_share(n: int, share: float) -> int:
    """Least integer of at least ``share`` times ``n``, by whole percents where possible."""
    return math.ceil(round(share * n, 9))
