"""Document statistics of whole Arrow batches, and labelled samples of them.

Statistics never read labels, language, source or identifiers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import releasing, segment_sum, slices, split_words, text_bytes

#: Text bytes of one pass; statistics take some hundred bytes of memory for each.
PASS_BYTES = 1 << 20
#: Words of one repeated window.
WINDOW = 3
#: Character classes of the transition shares: white space, letters (all of beyond ASCII counts as such), digits, marks of ordinary prose, other symbols.
CLASSES = ("space", "letter", "digit", "mark", "symbol")
TRANSITIONS = tuple(f"{a}_{b}" for a in CLASSES for b in CLASSES)
#: Names of the ratios that models see, in order: lengths, repetition, letters, and the share of each class transition among all.
RATIOS = ("symbols_per_word", "upper_share", "digit_share", "repeat_share", "dup_line_share", "distinct_share", "word_length", "log_words", "log_words_per_line", "stops_per_word", "wide_share", *TRANSITIONS)


def _of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_SYMBOLS, _UPPER, _DIGITS, _STOPS = _of(b"#*$%&|<>"), _of(bytes(range(65, 91))), _of(b"0123456789"), _of(b".,;:?")
_LETTERS = _of(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xC6)))
_CLASS = np.full(256, 4, np.uint8)
_CLASS[list(b" \t\n\v\f\r")] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b".,;:?!'\"()-")] = 3


def repeated_words(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that stand in a window found twice or more in that text."""
    n, count = len(ids), len(bounds) - 1
    if n < window:
        return np.zeros(count, np.int64)
    text = np.repeat(np.arange(count), np.diff(bounds))
    inside = text[: n - window + 1] == text[window - 1 :]
    place = np.flatnonzero(inside)
    base = int(ids.max()) + 1
    key = ids[place].astype(np.int64)
    for k in range(1, window):
        if len(key) and (int(key.max()) + 1) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + ids[place + k]
    order = np.argsort(key, kind="stable")  # equal windows stay in text order
    key, owner = key[order], text[place[order]]
    same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[place[order[again]] + k] = True
    return segment_sum(covered, bounds)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, lines with a word that equal an earlier line, and lines with a word."""
    count = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A line begins at each text's start and after each line break; the break itself is no part of it.
    text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    begin = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(count), text_of_break])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.append(begin[1:], offsets[-1])
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end = np.where(last, offsets[owner + 1], end - 1)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    kept = data[data != 10]
    removed = np.searchsorted(breaks, begin)
    line_offsets = np.append(begin - removed, len(kept)).astype(np.int32)
    lines = pa.StringArray.from_buffers(len(begin), pa.py_buffer(line_offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (owner * (int(ids.max()) + 1 if len(ids) else 1) + ids)[worded]
    lines_of = np.bincount(owner[worded], minlength=count)
    unique_at = np.unique(key, return_index=True)[1]
    return lines_of - np.bincount(owner[worded][unique_at], minlength=count), lines_of


def transitions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, how often a byte of one class is followed by one of another (a row of ``TRANSITIONS``)."""
    count, kinds = len(offsets) - 1, len(CLASSES)
    if len(data) < 2:
        return np.zeros((count, kinds * kinds), np.int64)
    own = _CLASS[data]
    pair = own[:-1] * np.uint8(kinds) + own[1:]
    ends = np.maximum(offsets - 1, 0)  # the last byte of a text has no follower in it
    return np.array([np.bincount(pair[a : max(a, b)], minlength=kinds**2) for a, b in zip(offsets[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64).reshape(count, kinds**2)


def statistics(text: pa.Array) -> dict[str, np.ndarray]:
    """Whole-number statistics of each text of an Arrow array; null texts are empty."""
    data, offsets = text_bytes(text)
    words, bounds, starts, _ = split_words(data, offsets)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    whole = (data & 0xC0) != 0x80  # the first byte of each character
    space = ((data >= 9) & (data <= 13)) | (data == 32)
    dup_lines, lines = duplicate_lines(data, offsets, starts)

    def count(mask: np.ndarray) -> np.ndarray:
        return segment_sum(mask, offsets)

    return {
        "n_words": np.diff(bounds),
        "word_chars": count(whole & ~space),
        "n_symbols": count(_SYMBOLS[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated_words(ids, bounds),
        "n_lines": lines,
        "n_distinct": distinct_words(ids, bounds),
        "transitions": transitions(data, offsets),
        "n_upper": count(_UPPER[data]),
        "n_letters": count(_LETTERS[data]),
        "n_digits": count(_DIGITS[data]),
        "n_stops": count(_STOPS[data]),
        "n_wide": count(data >= 0xC0),
    }


def distinct_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct words of each text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = np.unique(text.astype(np.int64) * (int(ids.max()) + 1 if len(ids) else 1) + ids)
    return np.bincount(key // (int(ids.max()) + 1 if len(ids) else 1), minlength=len(bounds) - 1)


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """Matrix of ``RATIOS``, a row for each text."""
    words, letters, chars = (np.maximum(s[k], 1).astype(float) for k in ("n_words", "n_letters", "word_chars"))
    lines = np.maximum(s["n_lines"], 1).astype(float)
    steps = s["transitions"] / np.maximum(s["transitions"].sum(axis=1, keepdims=True), 1)
    return np.column_stack([
        s["n_symbols"] / words, s["n_upper"] / letters, s["n_digits"] / chars, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, s["n_distinct"] / words,
        s["word_chars"] / words, np.log1p(s["n_words"]), np.log1p(s["n_words"] / lines), s["n_stops"] / words, s["n_wide"] / chars, steps,
    ])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, size=PASS_BYTES):
            x = ratios(statistics(piece.column(1)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def held_out() -> F.Column:
    """Rows that training never sees: crc32 of the identifier's text is divisible by five."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label, x of all labelled documents outside the held-out fold; of several rows with one doc_id the least x.

    Ratios are made before the join, so that no text is shuffled and no identifiers need to be broadcast."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).alias("label"))
    rows = texts.mapInArrow(releasing(_labelled), "doc_id long, label int, x array<double>").select("doc_id", "x")
    return rows.join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and labels of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hashes of doc_id are taken, so reruns agree.  The
    sample's identifiers (16 bytes a row) are broadcast to the documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = joined.mapInArrow(_labelled, "doc_id long, label int, x array<double>").dropDuplicates(["doc_id"])
    table = rows.orderBy("doc_id").toArrow()
    if not table.num_rows:
        return np.zeros((0, len(RATIOS))), np.zeros(0, np.int64)
    x = np.array(table.column("x").combine_chunks().flatten()).reshape(table.num_rows, len(RATIOS))
    return x, np.array(table.column("label"))
