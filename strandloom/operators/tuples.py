"""Kernels over letters in a row: tuple counts, background likelihoods and translation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import CODON_BASES, CODON_LETTERS
from strandloom.operators.packing import letters, packed_batches, pieces

#: Tuple lengths up to which a task counts in a dense table.
DENSE = 10


def _counter(widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {w: np.zeros(4**w, np.int64) for w in widths if w <= DENSE}
        for code, owner, own in packed_batches(batches, ahead=max(widths) - 1):
            for w in widths:
                n = len(code) - w + 1
                if n <= 0:
                    continue
                packed, known = np.zeros(n, np.int64), owner[:n] == owner[w - 1 :]
                for j in range(w):
                    packed = packed * 4 + code[j : j + n]
                    known &= code[j : j + n] < 4
                if own is not None:
                    known[own:] = False
                if w in dense:
                    dense[w] += np.bincount(packed[known], minlength=4**w)
                else:
                    yield _rows(w, *np.unique(packed[known], return_counts=True))
        for w, count in dense.items():
            found = np.flatnonzero(count)
            yield _rows(w, found, count[found])

    return run


def _rows(width: int, packed: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), width, np.int32)), pa.array(packed), pa.array(count.astype(np.int64))], names=["width", "packed", "cnt"])


def packed_counts(seqs: DataFrame, widths: list[int], seq: str = "seq") -> DataFrame:
    """width, packed (two bits a letter, the first one highest), cnt of all windows of known letters of each width; tasks count ahead of the shuffle."""
    per_task = seqs.select(F.col(seq).alias("seq")).mapInArrow(_counter(sorted(widths)), "width int, packed long, cnt long")
    return per_task.groupBy("width", "packed").agg(F.sum("cnt").alias("cnt"))


def tuple_counts(seqs: DataFrame, widths: list[int], seq: str = "seq") -> DataFrame:
    """word, cnt of all windows of known letters of each width."""
    totals = packed_counts(seqs, widths, seq)
    digits = F.lpad(F.conv(F.col("packed").cast("string"), 10, 4), F.col("width"), F.lit("0"))
    return totals.select(F.translate(digits, "0123", "ACGT").alias("word"), "cnt")


def sequence_pair_counts(seqs: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id and ``pairs``: counts of the sixteen adjacent pairs of A, C, G, T in each row, case folded, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                code, offsets = letters(pc.ascii_upper(piece.column(1)))
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                pair = code[:-1].astype(np.int64) * 4 + code[1:]
                known = (code[:-1] < 4) & (code[1:] < 4) & (owner[:-1] == owner[1:])
                counts = np.bincount(owner[:-1][known] * 16 + pair[known], minlength=16 * piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) + 1, 16, dtype=np.int32)), pa.array(counts))], names=["seq_id", "pairs"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, pairs array<long>")


def log_background(seqs: DataFrame, conditionals: dict[str, float], order: int, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id, log_background, letters of each sequence with known letters.

    A letter's context is the run of known letters before it, up to ``order`` of them;
    ``conditionals`` has a probability for each tuple of one to ``order`` + 1 letters."""
    tables = []
    for n in range(1, order + 2):
        table = np.full(4**n, -np.inf)
        for word, p in conditionals.items():
            if len(word) == n and p > 0:
                table[int("".join(str("ACGT".index(x)) for x in word), 4)] = np.log(p)
        tables.append(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                code, offsets = letters(piece.column(1))
                first = np.zeros(len(code), bool)
                first[offsets[:-1][offsets[:-1] < len(code)]] = True
                value, packed, open_ = np.zeros(len(code)), code.astype(np.int64), code < 4
                value[open_] = tables[0][code[open_]]
                fresh = first.copy()  # a context of j letters must not cross a sequence's start
                for j in range(1, order + 1):
                    longer = np.zeros(len(code), bool)
                    longer[j:] = open_[j:] & (code[: len(code) - j] < 4) & ~fresh[j:]
                    packed[j:] += code[: len(code) - j].astype(np.int64) * 4**j
                    value[longer] = tables[j][packed[longer]]
                    open_ = longer
                    fresh[1:] |= fresh[:-1].copy()
                known = np.concatenate([[0], np.cumsum(code < 4)])[offsets]
                ends = np.concatenate([[0.0], np.cumsum(value)])[offsets]
                count, total = np.diff(known), np.diff(ends)
                kept = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(kept)), pa.array(total[kept]), pa.array(count[kept])], names=["seq_id", "log_background", "letters"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, log_background double, letters long")


def proteins(seqs: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """seq_id, protein: frame 0, ``_`` for stop, ``*`` for a codon with unknown letters; null stays null."""
    order = [CODON_BASES.index(x) for x in "ACGT"]
    table = np.full(125, ord("*"), np.uint8)
    for a in range(4):
        for b in range(4):
            for c in range(4):
                table[a * 25 + b * 5 + c] = ord(CODON_LETTERS[order[a] * 16 + order[b] * 4 + order[c]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                code, offsets = letters(piece.column(1))
                code = code.astype(np.int64)
                amino = table[code[:-2] * 25 + code[1:-1] * 5 + code[2:]] if len(code) > 2 else np.zeros(0, np.uint8)
                out = [amino[a : max(a, b - 2) : 3].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.string(), mask=piece.column(1).is_null().to_numpy(zero_copy_only=False))], names=["seq_id", "protein"])

    kind = seqs.schema[key].dataType.simpleString()
    return seqs.select(F.col(key).alias("seq_id"), F.col(seq).alias("seq")).mapInArrow(run, f"seq_id {kind}, protein string")
