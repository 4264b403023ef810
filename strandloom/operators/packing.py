"""Letters of Arrow batches as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Letters handled by one numpy pass; ``stretches`` cuts a longer sequence, ``pieces`` takes it whole.
PIECE = 2 << 20

_CODE = np.full(256, 4, np.uint8)
for _place, _letter in enumerate(b"ACGT"):
    _CODE[_letter] = _place


def raw_letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row (ordinary or large ones; nulls are empty), and where each begins."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def text_offsets(texts: pa.Array) -> np.ndarray:
    """Where each string begins among the array's bytes, and the end of the last."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """0..3 for ACGT and 4 for all else, of all strings in a row, and where each begins."""
    raw, offsets = raw_letters(texts)
    return _CODE[raw], offsets


def fixed_strings(rows: np.ndarray) -> pa.Array:
    """Strings of equal length from rows of bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows)))


def pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about PIECE letters each."""
    texts = batch.column(column)
    if not len(texts):
        return
    offsets = text_offsets(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, min(len(texts), int(np.searchsorted(offsets, offsets[begin] + PIECE, side="right")) - 1))
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass(frozen=True)
class Stretch:
    """A part of a batch.  Of a long sequence it holds one stretch, whose letters begin at ``shift``; what starts from ``first`` and before ``last`` is its own."""

    piece: pa.RecordBatch
    shift: int = 0
    first: int = 0
    last: int | None = None

    @property
    def begins(self) -> bool:
        return self.first == 0

    def own(self, places: np.ndarray) -> np.ndarray:
        """Of places among the letters those that are the stretch's own (all of them where sequences are whole)."""
        return places if self.last is None else places[(places + self.shift >= self.first) & (places + self.shift < self.last)]


def stretches(batch: pa.RecordBatch, column: int = 0, ahead: int = 0, behind: int = 0, size: int | None = None) -> Iterator[Stretch]:
    """``pieces``, but a sequence of more than ``size`` letters (PIECE) comes in stretches of so many.

    A stretch also holds ``behind`` letters before its own and ``ahead`` after them, so that windows that
    start in it are complete.  Nothing is copied."""
    size = size or PIECE
    for piece in pieces(batch, column):
        texts = piece.column(column)
        offsets = text_offsets(texts)
        total = int(offsets[-1] - offsets[0])
        if len(texts) != 1 or total <= size:
            yield Stretch(piece)
            continue
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        for first in range(0, total, size):
            a, last = max(0, first - behind), min(total, first + size)
            ends = np.array([offsets[0] + a, offsets[0] + min(total, last + ahead)], kind)
            part = pa.Array.from_buffers(texts.type, 1, [None, pa.py_buffer(ends), texts.buffers()[2]])
            yield Stretch(piece.set_column(column, piece.schema.names[column], part), a, first, last)


def packed_batches(batches: Iterator[pa.RecordBatch], ahead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Codes of many sequences in a row, the number of the sequence that owns each letter, and how many letters may start a window (None: all)."""
    for batch in batches:
        for part in stretches(batch, 0, ahead):
            code, offsets = letters(part.piece.column(0))
            yield code, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), None if part.last is None else part.last - part.first
