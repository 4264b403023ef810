"""SentencePiece encoding and decoding by a relational lattice.

A text is cut between any two characters that stand side by side in no piece, as no
piece can reach across; the parts are its words.  Words are exploded
into substrings of at most the longest piece's length, the substrings meet the piece
table in an equi-join, and the matches are the word's lattice edges.  Edges are
grouped by word and folded with Spark's higher-order ``aggregate``.

The fold depends on the model.  For a BPE vocabulary, scores are merge ranks, and a
best-sum (Viterbi) path over them is not SentencePiece's result.  There the fold
takes edges from the best rank down, and an edge merges its two symbols if both its
ends and exactly one border inside still stand; that is BPE itself, because every
piece is built from better-ranked ones.  ``viterbi`` folds unigram scores.

Frequent words are folded once and broadcast (at most ``FREQUENT`` of them, in at most
``FREQUENT_BYTES``); the others travel with their text and are folded there, so no table
of all words is ever joined.  Texts are numbered where they are read, so ``docs`` should be a
stored table, whose rows keep their order if a task is run again.  Words beyond the fold's 62 borders, or with a piece that is not built from
better-ranked ones (long runs of spaces), are merged by a priority queue instead.

Defined cases: null and empty texts have no ids; U+2581 in a text is a space, as in
the library; null doc_ids stay; repeated rows get equal ids; a very long text is one
task's work, in time linear in its length but for the queue's logarithm; pieces of equal
rank merge from the left; an empty table gives an empty result; other columns are not
read; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import releasing, saved, shuffle_parts, slices, text_bytes

#: Words that are folded ahead and broadcast, at most, their bytes, and the occurrences that make one worth it.
FREQUENT, FREQUENT_BYTES, WORTH = 1 << 20, 64 << 20, 4
#: Distinct words that a counting task holds before it sends them on, and rows of one batch.
HELD, ROWS = 1 << 17, 1 << 16
#: Frequent words that one task folds, about; lattices are many times their words, and a heap that they have grown stays large.
FOLDED = 1 << 13
#: Text bytes of one pass; each looks up its words among all frequent ones.
PASS_BYTES = 1 << 20
#: Bytes of words that are hashed at once; numbers of eight bytes stand beside each.
HASHED = 1 << 18
#: Words of one pass from codes to ids; a longer text is one pass.
PASS_CODES = 1 << 18
#: Borders that one fold can hold, and the bits of an id.
LONGEST, NO_PIECE = 62, (1 << 20) - 1
#: Rank of edges that merge nothing.
LAST = (1 << 20) - 1
SPACE, MARK = " ", "▁"


@dataclass
class Vocabulary:
    """Pieces with ``MARK`` as a space, by id; ``ranks`` are dense, the best score first."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    text_ids: dict[str, int]
    unigram: bool = False
    ranks: dict[str, int] = field(init=False)

    def __post_init__(self):
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in self.text_ids.values()}, reverse=True))}
        self.ranks = {p: order[self.scores[i]] for p, i in self.text_ids.items()}
        if len(self.pieces) >= NO_PIECE:
            raise ValueError("the vocabulary is too large to broadcast")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=str(path))
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i).replace(MARK, SPACE) for i in ids]
        byte_ids = {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        text = {pieces[i]: i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        return cls(pieces, [model.get_score(i) for i in ids], byte_ids, text)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.text_ids))

    @cached_property
    def length_bits(self) -> int:
        """Bits that hold a piece's length less one."""
        bits = max(1, (self.longest - 1).bit_length())
        if bits > 6:
            raise ValueError("pieces are longer than a fold holds")
        return bits

    @cached_property
    def inside(self) -> np.ndarray:
        """By two bytes: whether some piece has two characters side by side of which the first ends and the second begins so."""
        table = np.zeros(1 << 16, bool)
        table[[(a.encode()[-1] << 8) + b.encode()[0] for p in self.text_ids for a, b in zip(p, p[1:], strict=False)]] = True
        return table

    @cached_property
    def irregular(self) -> list[str]:
        """Pieces that merging by rank alone doesn't build."""
        return [] if self.unigram else [p for p in self.text_ids if len(p) > 1 and _by_rank(p, self.ranks, self.longest) != [p]]

    @cached_property
    def decoded(self) -> pa.Array:
        """Bytes of each id."""
        out = [b""] * len(self.pieces)
        for p, i in self.text_ids.items():
            out[i] = p.encode()
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        return pa.array(out, pa.binary())

    def ids_of(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [self.text_ids[p]] if p in self.text_ids else [self.byte_ids[b] for b in p.encode()]
        return out

    @cached_property
    def known(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of text, their ids, and the id of each byte."""
        of_bytes = np.full(256, -1, np.int32)
        of_bytes[list(self.byte_ids)] = list(self.byte_ids.values())
        return pa.array(list(self.text_ids), pa.string()), np.array(list(self.text_ids.values()), np.int32), of_bytes

    def ids_between(self, words: pa.Array, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts between the borders that folds left standing, of all words in a row, and each word's number of ids."""
        pieces, piece_ids, of_bytes = self.known
        data, offsets = text_bytes(words)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        word = np.searchsorted(offsets, at, side="right") - 1
        stands = (borders[word] >> (np.arange(len(at)) - np.searchsorted(at, offsets[:-1])[word])) & 1 == 1
        begins, word = at[stands], word[stands]
        bounds = np.append(begins, len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        found = pc.fill_null(pc.index_in(parts, value_set=pieces), -1).to_numpy(zero_copy_only=False)
        spelt = found < 0
        sizes = np.where(spelt, np.diff(bounds), 1)
        out = np.repeat(np.where(spelt, 0, piece_ids[found]), sizes).astype(np.int32)
        if spelt.any():
            places = np.repeat((np.cumsum(sizes) - sizes)[spelt], sizes[spelt]) + _ramp(sizes[spelt])
            out[places] = of_bytes[data[np.repeat(begins[spelt], sizes[spelt]) + _ramp(sizes[spelt])]]
        return out, np.bincount(word, weights=sizes, minlength=len(words)).astype(np.int64)

    def ids_at(self, word: str, borders: int) -> list[int]:
        """Ids of one word's parts."""
        return self.ids_between(pa.array([word]), np.array([borders]))[0].tolist()

    def merged(self, word: str) -> list[int]:
        """BPE of one word by a priority queue, for any length."""
        n = len(word)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n:
                b = end[end[a]]
                if b - a <= self.longest and (rank := self.ranks.get(word[a:b])) is not None:
                    heapq.heappush(queue, (rank, a, b))

        for a in range(n):
            offer(a)
        while queue:
            _, a, b = heapq.heappop(queue)
            if alive[a] and end[a] < n and end[end[a]] == b:
                alive[end[a]] = False
                end[a] = b
                if b < n:
                    before[b] = a
                offer(before[a])
                offer(a)
        out, a = [], 0
        while a < n:
            out.append(word[a : end[a]])
            a = end[a]
        return self.ids_of(out)


def _by_rank(word: str, ranks: dict[str, int], longest: int) -> list[str]:
    edges = sorted((ranks[word[a:b]], a, b) for a in range(len(word)) for b in range(a + 2, min(len(word), a + longest) + 1) if word[a:b] in ranks)
    borders = set(range(len(word) + 1))
    for _, a, b in edges:
        inside = [k for k in range(a + 1, b) if k in borders]
        if a in borders and b in borders and len(inside) == 1:
            borders.remove(inside[0])
    at = sorted(borders)
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


def cut_words(text: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of each text (with the space that is put before it), and where each text's words begin."""
    if text.null_count:
        text = text.fill_null("")
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, SPACE)
    full = pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(SPACE, text, ""))
    data, offsets = text_bytes(full)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    begins = np.empty(len(data), bool)
    begins[1:] = ~inside[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    begins[1:] &= (data[1:] & 0xC0) != 0x80  # characters stay whole
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.searchsorted(starts, offsets)


def _odd(words: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
    """Words that the fold can't take."""
    odd = pc.greater(pc.utf8_length(words), LONGEST)
    for piece in vocabulary.irregular:
        odd = pc.or_(odd, pc.match_substring(words, piece))
    return odd.to_numpy(zero_copy_only=False)


def _count(shared):
    """Words that a fold takes, and how often a task has them; a word comes again only after ``HELD`` others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held: list[pa.Table] = []

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for piece in slices(batch, size=PASS_BYTES):
                counted = cut_words(piece.column(0), vocabulary.inside)[0].value_counts()
                if not len(counted):
                    continue
                own = pa.table({"word": counted.field(0), "n": counted.field(1)})
                held.append(own.filter(pa.array(~_odd(counted.field(0), vocabulary))))
                if sum(map(len, held)) > 2 * HELD:
                    held[:] = [total()]
                    if len(held[0]) > HELD:
                        yield from held.pop().to_batches(ROWS)
        if held:
            yield from total().to_batches(ROWS)
        held.clear()
        pa.default_memory_pool().release_unused()

    return run


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """From Arrow, as rows of Python would start workers on the executors that stay there beside those of the kernels."""
    pieces, ids = list(vocabulary.text_ids), list(vocabulary.text_ids.values())
    ranks = [vocabulary.ranks[p] if len(p) > 1 else LAST for p in pieces]
    columns = {"piece": pa.array(pieces, pa.string()), "rank": pa.array(ranks, pa.int32()), "id": pa.array(ids, pa.int32()), "score": pa.array([vocabulary.scores[i] for i in ids], pa.float64())}
    return spark.createDataFrame(pa.table(columns))


def lattice(words: DataFrame, vocabulary: Vocabulary, keys: list[str], carried: list[str]) -> DataFrame:
    """``keys`` (which include ``word``), ``edges`` and the ``carried`` columns of every row of ``words``.

    An edge packs rank, begin, length and id; edges are sorted, so the best rank is first.
    Edges of one character merge nothing and are left out of BPE lattices.  ``words``
    must be partitioned by a part of ``keys``; then nothing is shuffled here.  Every
    word keeps at least one row, also the empty one."""
    n, a = F.length("word"), F.col("a")
    least = F.lit(1 if vocabulary.unigram else 2)
    spans = words.withColumn("a", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    spans = spans.withColumn("l", F.explode_outer(F.when(n - a >= least, F.sequence(least, F.least(F.lit(vocabulary.longest), n - a)))))
    spans = spans.withColumn("piece", F.substring("word", a + 1, F.col("l")))
    met = spans.join(F.broadcast(piece_table(words.sparkSession, vocabulary)), "piece", "left")
    met = met.where(F.col("l").isNull() | F.col("id").isNotNull())
    rank, code = F.col("rank").cast("long"), F.col("id").cast("long")
    place = F.shiftleft(a, vocabulary.length_bits) + F.col("l") - 1
    packed = F.shiftleft(rank, 32) + F.shiftleft(place.cast("long"), 20) + code  # null without a piece
    return met.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("edges"), *(F.first(c).alias(c) for c in carried))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _ends(e: Column, bits: int) -> tuple[Column, Column]:
    begin = F.shiftright(e, 20 + bits).bitwiseAND(F.lit(63)).cast("int")
    return begin, begin + F.shiftright(e, 20).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") + 1


def fold_ranks(edges: Column, word: Column, bits: int) -> Column:
    """Borders (as bits) that stand after merging by rank.

    Masks are looked up by an edge's begin and length, since expressions in the fold
    are interpreted for every edge.  An edge merges if three borders stand from its
    begin to its end, and both ends are among them."""
    places = [(a, a + length + 1) for a in range(LONGEST) for length in range(1 << bits)]

    def table(mask) -> Column:
        return F.expr("array(" + ", ".join(f"{mask(a, b) if b <= LONGEST else 0}L" for a, b in places) + ")")

    span, ends, inside = table(lambda a, b: (2 << b) - (1 << a)), table(lambda a, b: (1 << a) | (1 << b)), table(lambda a, b: (1 << b) - (2 << a))

    def step(borders: Column, e: Column) -> Column:
        k = F.shiftright(e, 20).bitwiseAND(F.lit((1 << (6 + bits)) - 1)).cast("int")
        three = F.bit_count(borders.bitwiseAND(F.get(span, k))) == 3
        both = borders.bitwiseAND(F.get(ends, k)) == F.get(ends, k)
        return F.when(three & both, borders - borders.bitwiseAND(F.get(inside, k))).otherwise(borders)

    # All borders of the word; 63 of them fill a long, so the mask is shifted down, not counted up.
    every = F.call_function("shiftrightunsigned", F.lit((1 << (LONGEST + 1)) - 1), LONGEST - F.length(word))
    return F.aggregate(edges, every, step)


def viterbi(edges: Column, scores: Column, word: Column, bits: int, unknown: float = -100.0) -> Column:
    """Borders (as bits) of the best-sum path; ``scores`` maps an edge's id to its score (unigram models).

    The state holds, for each border reached so far, the best sum and the borders of its
    path.  A character without a piece costs ``unknown``."""
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("path")))

    def reach(state: Column, end: Column) -> Column:
        def option(e: Column) -> Column:
            prior = F.element_at(state, _ends(e, bits)[0] + 1)
            gain = F.element_at(scores, e.bitwiseAND(F.lit(NO_PIECE)).cast("int"))
            return F.struct((prior["sum"] + gain).alias("sum"), (prior["path"] + _bit(end)).alias("path"))

        before = F.element_at(state, end)
        alone = F.struct((before["sum"] + unknown).alias("sum"), (before["path"] + _bit(end)).alias("path"))
        here = F.transform(F.filter(edges, lambda e: _ends(e, bits)[1] == end), option)
        return F.concat(state, F.array(F.when(F.size(here) > 0, F.array_max(here)).otherwise(alone)))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), start, reach), -1)["path"]


def word_borders(words: DataFrame, vocabulary: Vocabulary, keys: list[str], carried: list[str]) -> DataFrame:
    """``keys`` (which include ``word``), ``carried`` and ``borders`` for every row of ``words``, by lattice and fold."""
    graph = lattice(words, vocabulary, keys, carried)
    if vocabulary.unigram:
        scores = F.create_map(*(F.lit(x) for i in vocabulary.text_ids.values() for x in (i, float(vocabulary.scores[i]))))
        borders = F.when(F.length("word") > 0, viterbi(F.col("edges"), scores, F.col("word"), vocabulary.length_bits))
    else:
        borders = fold_ranks(F.col("edges"), F.col("word"), vocabulary.length_bits)
    return graph.select(*keys, *carried, borders.alias("borders"))


def _listed_ids(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = shared.value.ids_between(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["word", "n", "ids"])

    return run


def frequent_words(texts: DataFrame, vocabulary: Vocabulary, shared, limit: int) -> tuple[pa.Array, pa.Array]:
    """The most frequent words of the corpus (from ``WORTH`` occurrences) and their ids, the most frequent first.

    There are at most ``limit``, of at most ``FREQUENT_BYTES``.  Counts cover all texts.  The
    least count is found from counts by eighths of a power of two, of which there are at most
    a few hundred."""
    counted = texts.select("text").mapInArrow(releasing(_count(shared)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = saved(counted.where(F.col("n") >= WORTH).withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.col("step").desc()).collect()
    words, size, least = 0, 0, None
    for step in steps:
        if words + step["words"] > limit or size + step["bytes"] > FREQUENT_BYTES:
            break
        words, size, least = words + step["words"], size + step["bytes"], step["step"]
    if least is None:
        return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    chosen = counted.where(F.col("step") >= least).select("word", "n").repartition(-(-words // FOLDED), "word")
    table = word_borders(chosen, vocabulary, ["word"], ["n"]).select("word", "borders", "n").mapInArrow(_listed_ids(shared), "word string, n long, ids array<int>").toArrow()
    table = table.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    return table.column("word").combine_chunks(), table.column("ids").combine_chunks()


#: A row for each text: its word codes, the ids of words that no fold takes, and its other rare words, each after a MARK (which no word has).
_CODED = "row long, doc_id long, text_sha256 binary, codes binary, odd array<array<int>>, rare string"
_ODD = pa.list_(pa.list_(pa.int32()))
_NAMES = ["row", "doc_id", "text_sha256", "codes", "odd", "rare"]


class Listed:
    """Frequent words and their ids, as broadcast; a code is a word's place among them.

    Words are looked up by hash and compared.  One whose hash is also that of an earlier word
    is not found; it then travels with its text like any rare word."""

    def __init__(self, data: bytes):
        table = _from_ipc(data)
        self.words = table.column(0).combine_chunks()
        ids = table.column(1).combine_chunks()
        self.flat, bounds = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        self.begins, self.lengths = bounds[:-1], np.diff(bounds)

    @cached_property
    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hashes(self.words)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], order.astype(np.int32)

    def codes(self, words: pa.Array) -> np.ndarray:
        """Codes of words, -1 for those that are not found."""
        if not len(self.words) or not len(words):
            return np.full(len(words), -1, np.int64)
        hashes, order = self.sorted
        place = order[np.minimum(np.searchsorted(hashes, _hashes(words)), len(order) - 1)]
        same = pc.equal(self.words.take(pa.array(place)), words).to_numpy(zero_copy_only=False)
        return np.where(same, place, -1).astype(np.int64)


def _listed(frequent) -> Listed:
    """Of one broadcast, once for all tasks of a Python worker; it goes when the worker, in a later stage, gives the broadcast up."""
    if not hasattr(frequent, "listed"):
        frequent.listed = Listed(frequent.value)
    return frequent.listed


#: Random numbers by byte and its place in a word; a word's hash is their sum.
_SALT = np.random.default_rng(5).integers(0, 1 << 64, 1 << 16, np.uint64)


def _hashes(words: pa.Array) -> np.ndarray:
    """Of words, none of which is empty."""
    data, offsets = text_bytes(words)
    if not len(data):
        return np.zeros(len(words), np.uint64)
    out, begin = np.empty(len(words), np.uint64), 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + HASHED, side="right")) - 1)
        own = offsets[begin : end + 1]
        place = np.minimum(_ramp(np.diff(own)), 255)
        out[begin:end] = np.add.reduceat(_SALT[(place << 8) | data[own[0] : own[-1]]], own[:-1] - own[0])
        begin = end
    return out


def _code(shared, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, listed = shared.value, _listed(frequent)
        odd_ids: dict[str, list[int]] = {}

        def merged(word: str) -> list[int]:
            ids = odd_ids.get(word) or vocabulary.merged(word)
            if len(word) < 1000 and len(odd_ids) < 10_000:
                odd_ids[word] = ids
            return ids

        for batch in batches:
            for piece in slices(batch, size=PASS_BYTES):
                rows = piece.num_rows
                words, bounds = cut_words(piece.column(2), vocabulary.inside)
                coded = words.dictionary_encode()
                at, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                n, odd = len(known), _odd(known, vocabulary)
                code = listed.codes(known)[at]
                # A text's own words: those that a fold takes come first.
                scarce = np.flatnonzero(code < 0)
                text = np.searchsorted(bounds, scarce, side="right") - 1
                local, place = np.unique((2 * text + odd[at[scarce]]) * n + at[scarce], return_inverse=True)
                halves = np.searchsorted(local, n * np.arange(2 * rows + 1)) if n else np.zeros(2 * rows + 1, np.int64)
                code[scarce] = len(listed.words) + place - halves[2 * text]
                owner, which = np.divmod(local, max(1, n))
                names = known.take(pa.array(which))
                plain = pc.binary_join_element_wise(MARK, names.filter(pa.array(owner % 2 == 0)), "")
                begins = np.concatenate([[0], np.cumsum(np.diff(halves)[::2])])
                marked, ends = text_bytes(plain)
                rare = pa.StringArray.from_buffers(rows, pa.py_buffer(ends[begins].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(marked)))
                others: list[list[list[int]]] = [[] for _ in range(rows)]
                for k in np.flatnonzero(owner % 2).tolist():
                    others[owner[k] // 2].append(merged(names[k].as_py()))
                raw = pc.fill_null(piece.column(2), "")
                if pc.any(pc.match_substring(raw, MARK)).as_py():
                    raw = pc.replace_substring(raw, MARK, SPACE)
                data, offsets = text_bytes(raw)
                data, offsets = np.ascontiguousarray(data), offsets.tolist()
                digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
                bounds = bounds.tolist()
                codes = [packed(code[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(digests, pa.binary()), pa.array(codes, pa.binary()), pa.array(others, _ODD), rare], names=_NAMES)
        pa.default_memory_pool().release_unused()

    return run


def packed(codes: np.ndarray) -> bytes:
    """Codes as their number, their width in bytes, and one compressed plane for each byte, the lowest first."""
    if not len(codes):
        return bytes(5)
    width = max(1, (int(codes.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(codes).to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[5:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    codes = np.zeros(n, np.int64)
    for k in range(width):
        codes |= planes[k].astype(np.int64) << (8 * k)
    return codes


def _to_ipc(words: pa.Array, ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"word": words, "ids": ids})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _assemble(shared, frequent, finish):
    """From word codes and folded rare words to ids; ``finish`` maps (doc_id, text_sha256, ids) batches further."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, listed = shared.value, _listed(frequent)
        for batch in batches:
            counts = [int.from_bytes(c.as_py()[:4], "little") for c in batch.column(0).field(2)]
            begin, held = 0, 0
            for end, count in enumerate([*counts, PASS_CODES + 1]):
                if end > begin and held + count > PASS_CODES:
                    part = batch.slice(begin, end - begin)
                    doc_ids, digests, codes, odd = part.column(0).flatten()
                    ids = _ids([unpacked(c.as_py()) for c in codes], *_own(part.column(1), odd, vocabulary), listed)
                    yield pa.RecordBatch.from_arrays([doc_ids, digests, ids], names=["doc_id", "text_sha256", "ids"])
                    begin, held = end, 0
                held += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(encoded(batches))
        pa.default_memory_pool().release_unused()

    return run


def _own(found: pa.Array, odd: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of texts' own words: all in a row, each word's number, and where each text's folded and odd words begin, folded ones first."""
    many, more = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (found, odd))
    place, words, borders = found.flatten().flatten()
    folded = np.concatenate([[0], np.cumsum(many)])
    order = np.empty(len(place), np.int64)
    order[np.repeat(folded[:-1], many) + place.to_numpy(zero_copy_only=False) - 1] = np.arange(len(place))
    ids, sizes = vocabulary.ids_between(words.take(pa.array(order)), borders.to_numpy(zero_copy_only=False)[order])
    lists = odd.flatten()
    ids = np.concatenate([ids, lists.flatten().to_numpy(zero_copy_only=False)])
    sizes = np.concatenate([sizes, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
    return ids, sizes, folded, folded[-1] + np.concatenate([[0], np.cumsum(more)])


def _ids(codes: list[np.ndarray], own: np.ndarray, sizes: np.ndarray, folded: np.ndarray, odd: np.ndarray, listed: Listed) -> pa.Array:
    """Ids of texts: frequent words from the common table, the others, whose codes follow, from the texts' own."""
    bounds = np.cumsum([0, *map(len, codes)])
    code = np.concatenate(codes)
    scarce = np.flatnonzero(code >= len(listed.words))
    text = np.searchsorted(bounds, scarce, side="right") - 1
    word = folded[text] + code[scarce] - len(listed.words)
    word = np.where(word < folded[text + 1], word, word - folded[text + 1] + odd[text])
    if len(listed.words):
        code[scarce] = 0
        length, begin = listed.lengths[code].astype(np.int64), listed.begins[code]
        length[scarce] = sizes[word]
        out = listed.flat[np.minimum(np.repeat(begin, length) + _ramp(length), len(listed.flat) - 1)]
    else:
        length = sizes[word]
        out = np.empty(length.sum(), np.int32)
    ends = np.concatenate([[0], np.cumsum(length)])
    out[np.repeat(ends[scarce], sizes[word]) + _ramp(sizes[word])] = own[np.repeat((np.cumsum(sizes) - sizes)[word], sizes[word]) + _ramp(sizes[word])]
    return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(out, pa.int32()))


def _ramp(length: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the lengths."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)


def _encode(docs: DataFrame, vocabulary: Vocabulary, limit: int, finish, schema: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = context.broadcast(vocabulary)
    frequent = context.broadcast(_to_ipc(*frequent_words(texts, vocabulary, shared, limit)))
    # All rows of a text meet at this one exchange; folding and gathering keep its partitioning.
    coded = texts.mapInArrow(releasing(_code(shared, frequent)), _CODED)
    coded = coded.repartition(4 * shuffle_parts(docs.sparkSession), "row")  # small tasks, as lattices are many times their words
    # Before the first MARK stands an empty word, whose row carries the text's own columns.
    words = coded.select("*", F.posexplode(F.split("rare", MARK)).alias("place", "word"))
    head = F.when(F.col("place") == 0, F.struct("doc_id", "text_sha256", "codes", "odd")).alias("head")
    folded = word_borders(words.select("row", "place", "word", head), vocabulary, ["row", "place", "word"], ["head"])
    pair = F.when(F.col("place") > 0, F.struct("place", "word", "borders"))
    gathered = folded.groupBy("row").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_list(pair).alias("found"))
    return gathered.select("head", "found").mapInArrow(releasing(_assemble(shared, frequent, finish)), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, limit: int = FREQUENT) -> DataFrame:
    """doc_id, text_sha256 (of the text as it decodes) and ids (array of int) for every row."""
    return _encode(docs, vocabulary, limit, lambda batches: batches, "doc_id long, text_sha256 binary, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text for every row of ``encoded`` (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value.decoded
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), decoded_texts(batch.column(1), pieces)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def decoded_texts(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Texts of lists of ids: all their bytes in one row, cut at the lists' ends."""
    flat = ids.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    parts = pieces.take(pc.if_else(known, flat, 0))  # id 0 is the unknown piece and has no bytes
    ends = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    raw = parts.buffers()[2].to_pybytes() if len(parts) and parts.buffers()[2] is not None else b""
    at = ends[bounds].tolist()
    texts = (raw[a:b] for a, b in zip(at, at[1:], strict=False))
    return pa.array([(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts], pa.string())


def round_trip(docs: DataFrame, vocabulary: Vocabulary, limit: int = FREQUENT) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256 (of the ids as 4-byte little-endian numbers), and whether the text comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value.decoded
        for batch in batches:
            texts = decoded_texts(batch.column(2), pieces)
            same = [hashlib.sha256(t.as_py().encode()).digest() == d.as_py() for t, d in zip(texts, batch.column(1), strict=True)]
            ids = batch.column(2)
            flat, ends = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4"), ids.offsets.to_pylist()
            digest = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.list_value_length(ids), pa.int64()), pa.array(digest), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decodes"])

    return _encode(docs, vocabulary, limit, check, "doc_id long, n_tokens long, ids_sha256 string, decodes boolean")
