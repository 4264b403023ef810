"""Packing documents into token windows by multiway differencing.

A document's tokens are cut into whole windows and a remainder.  Remainders are dealt by
a hash into groups of about ``GROUP``, and a group is partitioned over just enough
windows by Karmarkar-Karp differencing: the two partial partitions of the largest
imbalances are merged, the fuller windows of one on the emptier of the other, until
one is left.  The number of windows rises whenever one exceeds the capacity.  The windows come out
nearly equal and nearly full.  As documents may be cut, the least full windows are then
taken apart: their pieces fill up the others to capacity, and what is left (less than a window in
each group) goes into windows whose lengths are powers of two, which need no padding.

Encoding looks words up: neither the normaliser nor the split pattern of the vocabulary
looks across white space, or from an ASCII letter over a comma or a full stop, so
each distinct word of a slice is encoded once.  Only lengths, checksums and the remainders' tokens
are stored; whole windows are never shuffled.

Defined cases: a null or empty text is the end token alone; null and repeated doc_ids stay, each row
is a document of its own; special-token strings in a text are what the vocabulary
file says; a very long text is encoded slice by slice of its words in one task;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import releasing, saved, slices, text_bytes

#: Remainders of one group, about.
GROUP = 512
#: Text bytes encoded in one pass.
SLICE = 4 << 20
#: Words encoded in one call: the library's results are a few hundred bytes a word until they are copied.
CALL = 1 << 13
#: Words whose tokens a Python worker remembers.
REMEMBERED = 1 << 19
#: Cut pieces up to which their row numbers are broadcast (8 bytes each).
BROADCAST_ROWS = 500_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b',.;:!?()"')] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Tokens of texts, word by word.

    The first ``REMEMBERED`` words that a worker meets keep their tokens, in one array; the
    tokens of others are forgotten after their slice."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.code: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: a code for each, and the tokens and sizes of all codes."""
        known = len(self.code)
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        codes[new] = known + np.arange(len(new))
        fresh = [words[i] for i in new.tolist()]
        all_sizes, all_ids = [self.sizes], [self.flat]
        for begin in range(0, len(fresh), CALL):
            ids = [e.ids for e in self.coder.encode_batch_fast(fresh[begin : begin + CALL], add_special_tokens=False)]
            all_sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            all_ids.append(np.fromiter(chain.from_iterable(ids), np.uint32))
        sizes, flat = np.concatenate(all_sizes), np.concatenate(all_ids)
        if known + len(new) <= REMEMBERED:
            self.code.update(zip(fresh, codes[new].tolist(), strict=True))
            self.flat, self.sizes = flat, sizes
        return codes, flat, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and where each text's begin."""
        words, bounds = cut_words(data, offsets)
        coded = words.dictionary_encode()
        codes, flat, sizes = self.tokens(coded.dictionary.to_pylist())
        code = codes[coded.indices.to_numpy(zero_copy_only=False)]
        begins = np.cumsum(sizes) - sizes
        own = sizes[code]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(begins[code] - ends[:-1], own)
        at += np.arange(ends[-1])
        return flat[at], ends[bounds]


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Stretches of texts that encode on their own, and where each text's begin among them.

    Cuts are at ASCII white space, and between an ASCII letter and a stop next to it.
    Letters A-Z are lower-cased unless some special token may stand in the texts."""
    if b"<|" not in data.tobytes():
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    solid = ~_SPACE[data]
    begins = solid.copy()
    letter, stop = _LETTER[data], _STOP[data]
    begins[1:] &= ~solid[:-1] | (letter[1:] & stop[:-1]) | (stop[1:] & letter[:-1])
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    kept = data[solid]
    ends = np.append(np.flatnonzero(begins[solid]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Identifiers, bytes and offsets of texts; a text beyond a slice comes alone."""
    for piece in slices(batch, size=SLICE):
        yield (piece.column(0).to_pylist(), *text_bytes(piece.column(1)))


def _long(coder: Words, data: np.ndarray) -> np.ndarray:
    """Tokens of one text of any length, a slice at a time; slices end before white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(coder.encode(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_DOCUMENTS = "row long, doc_id long, n long, rest long, rest_crc long, rest_ids binary, first long, crcs array<long>"
_NAMES = ["row", "doc_id", "n", "rest", "rest_crc", "rest_ids", "first", "crcs"]


def _encoded(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _words(path)
        part = TaskContext.get().partitionId()
        row, whole = part << 33, part << 40
        for batch in batches:
            for ids, data, offsets in _texts(batch):
                if len(ids) == 1 and len(data) > SLICE:
                    tokens, bounds = _long(coder, data), None
                    bounds = np.array([0, len(tokens)])
                else:
                    tokens, bounds = coder.encode(data, offsets)
                columns: list[list] = [[] for _ in _NAMES]
                for k, doc in enumerate(ids):
                    own = np.append(tokens[bounds[k] : bounds[k + 1]], np.uint32(end)).astype("<u4")
                    full = len(own) // capacity
                    rest = own[full * capacity :].tobytes()
                    crcs = [zlib.crc32(own[i * capacity : (i + 1) * capacity]) for i in range(full)]
                    for column, value in zip(columns, (row, doc, len(own), len(rest) // 4, zlib.crc32(rest), rest, whole, crcs), strict=True):
                        column.append(value)
                    row += 1
                    whole += full
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)], names=_NAMES)

    return run


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]


def encoded(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """A stored row per document: its number, tokens, whole windows (checksums) and remainder."""
    return saved(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(_encoded(path, end, capacity)), _DOCUMENTS))


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``ways`` subsets of nearly equal sums.

    A partial partition holds its subset sums in falling order, less the least of them, and a
    node for each subset; a node is an index or a pair of nodes."""
    heap = [(-s, i, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    left, right = [-1] * n, [-1] * n

    def opened(item) -> tuple[np.ndarray, np.ndarray]:
        spread, i, state = item
        if state is not None:
            return state
        sums, nodes = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], nodes[0] = -spread, i
        return sums, nodes

    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        (sums, nodes), (others, those) = opened(one), opened(two)
        sums, those = sums + others[::-1], those[::-1]
        both = (nodes >= 0) & (those >= 0)
        merged = np.where(nodes >= 0, nodes, those)
        merged[both] = len(left) + np.arange(both.sum())
        left += nodes[both].tolist()
        right += those[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), min(one[1], two[1]), (sums, merged[order])))
    if not heap:
        return [[] for _ in range(ways)]
    subsets = []
    for node in opened(heap[0])[1].tolist():
        leaves, open_nodes = [], [node] if node >= 0 else []
        while open_nodes:
            at = open_nodes.pop()
            if at < n:
                leaves.append(at)
            else:
                open_nodes += [left[at], right[at]]
        subsets.append(leaves)
    return subsets


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the sum allows, and more while one exceeds it."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        subsets = differencing(sizes, ways)
        over = sum(sum(sizes[i] for i in s) > capacity for s in subsets)
        if not over:
            return subsets
        ways += 1 + over // 8


def filled(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length), all of ``capacity`` or of a power of two.

    The fullest windows are kept, as many as the sum fills; the rest are cut up to fill them."""
    subsets = sorted(balanced(sizes, capacity), key=lambda s: -sum(sizes[i] for i in s))
    keep = sum(sizes) // capacity
    windows = [[(i, 0, sizes[i]) for i in s] for s in subsets[:keep]]
    loose = [(i, 0, sizes[i]) for s in subsets[keep:] for i in s][::-1]

    def take(count: int) -> list[tuple[int, int, int]]:
        taken = []
        while count:
            i, start, length = loose.pop()
            used = min(length, count)
            taken.append((i, start, used))
            if used < length:
                loose.append((i, start + used, length - used))
            count -= used
        return taken

    for window in windows:
        window += take(capacity - sum(length for _, _, length in window))
    left = sum(length for _, _, length in loose)
    windows += [take(1 << bit) for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
    return windows


_PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row, doc, n, rest, crc = (table.column(c).to_pylist() for c in ("row", "doc_id", "n", "rest", "rest_crc"))
        group = table.column("group")[0].as_py() if len(row) else 0
        out: list[tuple] = []
        for number, window in enumerate(filled(rest, capacity)):
            offset = 0
            for i, start, length in window:
                out.append((row[i], doc[i], n[i] - rest[i] + start, length, crc[i] if length == rest[i] else None, n[i], (group << 21 | number) * 2 + 1, offset))
                offset += length
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.drop_columns(["rest_ids", "at"])
        crcs = [zlib.crc32(ids.as_buffer()[4 * a : 4 * (a + m)]) for ids, a, m in zip(batch.column("rest_ids"), batch.column("at").to_pylist(), batch.column("length").to_pylist(), strict=True)]
        yield own.set_column(own.schema.get_field_index("ids_crc32"), "ids_crc32", pa.array(crcs, pa.int64()))


def pack(docs: DataFrame, path: str, end: int, capacity: int = 4096) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` is a vocabulary file of ``tokenizers``, ``end`` the token after each document.  Sequences
    hold ``capacity`` tokens or a power of two.  Even sequence_ids are whole windows of one document."""
    stored = encoded(docs, path, end, capacity)
    whole = stored.where(F.size("crcs") > 0).select("doc_id", "n", "first", F.posexplode("crcs").alias("at", "ids_crc32"))
    zero = F.lit(0).cast("long")
    whole = whole.select("doc_id", (F.col("at").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), ((F.col("first") + F.col("at")) * 2).alias("sequence_id"), zero.alias("offset"))
    rests = stored.where("rest > 0").select("row", "doc_id", "n", "rest", "rest_crc")
    groups = max(1, -(-rests.count() // GROUP))
    placed = rests.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    pieces = saved(placed.groupBy("group").applyInArrow(_packed(capacity), _PIECES))
    cut = pieces.where(F.col("ids_crc32").isNull())
    cut = F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
    tokens = stored.where("rest > 0").select("row", "rest_ids", (F.col("n") - F.col("rest")).alias("before"))
    joined = tokens.join(cut, "row").select(*pieces.columns, "rest_ids", (F.col("start") - F.col("before")).alias("at"))
    again = joined.mapInArrow(releasing(_checked), pieces.schema)
    rest = pieces.where(F.col("ids_crc32").isNotNull()).unionByName(again).drop("row")
    return whole.unionByName(rest)


def padding(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """sequences, tokens and padded: what is stored besides tokens if all but powers of two are padded."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return lengths.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padded"))
