"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors become integers, and rows are sorted by label and by their place on a Hilbert
curve through the dimensions that vary most.  Runs of ``BLOCK`` rows are stored as blocks in
Parquet, with each dimension's least and largest value as a zone map.  The inner product
of an anchor with any row of a block lies in the interval that the zone map gives, so only blocks whose
interval meets one of the anchor's windows are read for it.  Positives come first: the fifth
best score in the anchor's own block bounds their window from below.  Each positive then gives a
window of scores for negatives.

Anchors travel to blocks in tiles, and a task holds one block and one tile at a time; what each
block finds is cut to the best of each window before it is merged.  Work is anchors times rows less what the
zone maps exclude, and vectors of little structure exclude little.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no
part; shorter vectors are filled up with zeros; components beyond what scores of 56 bits allow
(2^25 for 64 dimensions) count as that bound; ties go to the smaller vec_id; repeated rows are rows of their own, and a
repeated anchor gives its rows again; labels of any sign and number, one of which may hold any share of
the rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import saved, shuffle_parts

#: Dimensions on the curve and bits of each.
CURVE_DIMS, CURVE_BITS = 8, 6
#: Rows of a block, anchors of a tile, zone maps of a task's share, about.
BLOCK, TILE, ZONES = 1024, 128, 1024
#: Bits of scores.
SCORE_BITS = 56

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of small unsigned integers on the Hilbert curve, by Skilling's transform."""
    x = [column.astype(np.int64) for column in axes.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            is_set = (x[i] & bit) != 0
            swapped = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(is_set, low, swapped)
            x[i] = x[i] ^ swapped
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for column in x:
            place = place << 1 | (column ^ flip) >> b & 1
    return place


def participants(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part; where 7 divides vec_id the label moves on by one, modulo ten."""
    vector, infinite = F.col("embedding").cast("array<double>"), float("inf")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), vector.alias("embedding"))


def whole_numbers(vectors: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, within the bound that scores allow."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    bound = bound_of(dims)
    values = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale), -bound, bound)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def bound_of(dims: int) -> int:
    return min((1 << 31) - 1, int(np.sqrt((1 << SCORE_BITS) / max(1, dims))))


def _summary(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dims), np.zeros(dims)
        low, high = np.full(dims, _HIGH), np.full(dims, _LOW)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column(0), dims, scale)
                n, total, squares = n + len(x), total + x.sum(0), squares + (x.astype(float) ** 2).sum(0)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(dims), np.full(dims, n), total, squares, low, high)], names=["dim", "n", "total", "squares", "low", "high"])

    return run


def _placed(dims: int, scale: int, chosen: list[int], low: np.ndarray, high: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        span = np.maximum(high - low + 1, 1)
        for batch in batches:
            x = whole_numbers(batch.column(2), dims, scale)
            axes = ((x[:, chosen] - low) * float(1 << CURVE_BITS) / span).astype(np.int64)
            vectors = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(x), [None, pa.py_buffer(x.astype("<i4").tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(x))), batch.column(0), batch.column(1), pa.array(hilbert_index(axes, CURVE_BITS)), vectors], names=["row", "vec_id", "label", "place", "vector"])
            row += len(x)

    return run


_BLOCK = "block long, n int, label_lo long, label_hi long, rows binary, ids binary, labels binary, vectors binary, lo binary, hi binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


def _as_block(number: int, rows: pa.Table) -> tuple:
    x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<i4").reshape(rows.num_rows, -1)
    row, ids, labels = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label"))
    return (number, len(x), int(labels.min()), int(labels.max()), row.tobytes(), ids.tobytes(), labels.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes())


def _blocked(size: int):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 33, [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_as_block(number, pa.Table.from_batches(held)), kinds, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == size:
                    yield block()
                    number, held, n = number + 1, [], 0
        if n:
            yield block()

    return run


def blocks(rows: DataFrame, scale: int = 256) -> DataFrame:
    """Blocks of ``participants``, ordered by label and Hilbert curve, as a stored table with zone maps."""
    dims = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    summary = "dim long, n long, total double, squares double, low long, high long"
    found = rows.select("embedding").mapInArrow(_summary(dims, scale), summary).groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # a row for each dimension
    variance = {r["dim"]: r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2 for r in found}
    chosen = sorted(sorted(variance, key=lambda d: -variance[d])[:CURVE_DIMS]) or [0]
    low, high = (np.array([{r["dim"]: r[c] for r in found}.get(d, 0) for d in chosen]) for c in ("low", "high"))
    parts = max(1, min(shuffle_parts(rows.sparkSession), -(-max((r["n"] for r in found), default=0) // BLOCK)))
    placed = saved(rows.mapInArrow(_placed(dims, scale, chosen, low, high), "row long, vec_id long, label long, place long, vector binary"))
    order = ("label", "place", "vec_id", "row")
    return saved(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocked(BLOCK), _BLOCK))


class Block:
    """Arrays of a block's row."""

    def __init__(self, row: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.x = np.frombuffer(row["vectors"], "<i4").reshape(len(self.rows), -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; in floating point where 53 bits hold them."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def zone_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that hold the inner products of each anchor with all vectors of each zone, widened by what rounding may take."""
    up, down, lo, hi = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float), lo.astype(float), hi.astype(float)
    slack = np.abs(a).astype(float) @ np.maximum(np.abs(lo), np.abs(hi)).T * 2.0**-48
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def best_in_windows(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, row) places of the ``top`` allowed scores in each anchor's windows, higher scores and then smaller ids first."""
    some = allowed & (score >= low.min(1)[:, None]) & (score <= high.max(1)[:, None])
    anchor, at = np.nonzero(some)
    order = np.lexsort((rows[at], ids[at], -score[anchor, at], anchor))
    anchor, at = anchor[order], at[order]
    value = score[anchor, at]
    found = []
    for w in range(low.shape[1]):
        inside = np.flatnonzero((value >= low[anchor, w]) & (value <= high[anchor, w]))
        own = anchor[inside]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        kept = inside[rank < top]
        found.append((anchor[kept], np.full(len(kept), w), at[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_ANCHOR = "row long, vec_id long, label long, vector binary, lows array<long>, highs array<long>"


def _anchors(every: int, top: int):
    """Anchors of each block, with a window for their positives: from the ``top``-th best score that their block has for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                own = np.flatnonzero(block.ids % every == 0)
                if not len(own):
                    continue
                score = scores(block.x[own], block.x)
                score[(block.labels[own][:, None] != block.labels) | (own[:, None] == np.arange(len(block.ids)))] = _LOW
                least = np.sort(score, axis=1)[:, -top] if len(block.ids) >= top else np.full(len(own), _LOW)
                columns = [block.rows[own], block.ids[own], block.labels[own], [v.tobytes() for v in block.x[own]], [[v] for v in least.tolist()], [[_HIGH]] * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ANCHOR_KINDS, strict=True)], names=_TILE_NAMES)

    return run


_ANCHOR_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_TILE_NAMES = [c.split()[0] for c in _ANCHOR.split(", ")]
_TILE = "rows binary, ids binary, labels binary, vectors binary, low binary, high binary"


class Tile:
    """Arrays of some anchors, with a row of windows for each."""

    def __init__(self, row: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.x = np.frombuffer(row["vectors"], "<i4").reshape(len(self.rows), -1)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(len(self.rows), -1) for c in ("low", "high"))

    def packed(self, which=slice(None)) -> list[bytes]:
        return [np.ascontiguousarray(c[which]).tobytes() for c in (self.rows, self.ids, self.labels, self.x, self.low, self.high)]


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _TILE.split(", ")]
    for batch in batches:
        for begin in range(0, batch.num_rows, TILE):
            part = batch.slice(begin, TILE)
            columns = [part.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("row", "vec_id", "label")]
            columns.append(b"".join(part.column("vector").to_pylist()))
            columns += [np.array(part.column(c).to_pylist(), np.int64).tobytes() for c in ("lows", "highs")]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=names)


def _choose(same: bool):
    """Which blocks each anchor must read: tiles of anchors that follow their share of zone maps, once for each block that some of them need."""
    names = ["block", *(c.split()[0] for c in _TILE.split(", "))]

    def chosen(zones: list[dict], tile: Tile) -> Iterator[tuple[int, list[bytes]]]:
        lo, hi = (np.array([np.frombuffer(z[c], "<i4") for z in zones]) for c in ("lo", "hi"))
        first, last = (np.array([z[c] for z in zones]) for c in ("label_lo", "label_hi"))
        least, most = zone_bounds(tile.x, lo, hi)
        own = tile.labels[:, None]
        fits = (first <= own) & (own <= last) if same else (first != own) | (own != last)
        need = np.zeros_like(fits)
        for low, high in zip(tile.low.T[:, :, None], tile.high.T[:, :, None], strict=True):
            need |= (low <= high) & (most >= low) & (least <= high)
        need &= fits
        for z in np.flatnonzero(need.any(0)).tolist():
            yield zones[z]["block"], tile.packed(need[:, z])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, zones = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["share"] != share:
                    share, zones = row["share"], []
                if row["block"] is not None:
                    zones.append(row)
                    continue
                for block, tile in chosen(zones, Tile(row)) if zones else ():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in tile)], names=names)

    return run


_FOUND = "anchor long, window int, score long, vec_id long, row long"


def _read(same: bool, top: int):
    """The best of a block for the tiles of anchors that follow it."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["low"] is None:
                    number, block = row["block"], Block(row)
                    continue
                assert number == row["block"]
                tile = Tile(row)
                score = scores(tile.x, block.x)
                allowed = (tile.labels[:, None] == block.labels) == same
                allowed &= tile.rows[:, None] != block.rows
                anchor, window, at = best_in_windows(score, allowed, block.ids, block.rows, tile.low, tile.high, top)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tile.rows[anchor], window.astype(np.int32), score[anchor, at], block.ids[at], block.rows[at])], names=names)

    return run


def chosen_blocks(anchors: DataFrame, table: DataFrame, same: bool) -> DataFrame:
    """block and a tile of the anchors whose windows its zone map meets; a stored table.

    Zone maps are dealt into shares of about ``ZONES``; tiles of anchors visit every share."""
    tiles = saved(anchors.mapInArrow(_tiled, _TILE))
    shares = max(1, -(-table.count() // ZONES))
    zone = table.select(F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"), "block", "label_lo", "label_hi", "lo", "hi")
    visits = tiles.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    # Shares of few zone maps (small tables) are dealt on by tile, so that all cores have some.
    lanes = max(1, shuffle_parts(table.sparkSession) // shares)
    zone = zone.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    visits = visits.withColumn("lane", F.pmod(F.hash("rows"), F.lit(lanes)))
    both = zone.unionByName(visits, allowMissingColumns=True).repartition(shuffle_parts(table.sparkSession), "share", "lane")
    both = both.withColumn("share", F.col("share") * lanes + F.col("lane")).drop("lane")
    ordered = both.sortWithinPartitions("share", F.col("block").isNull())
    return saved(ordered.mapInArrow(_choose(same), f"block long, {_TILE}"))


def best(anchors: DataFrame, table: DataFrame, same: bool, top: int) -> DataFrame:
    """anchor, window, rank, score, vec_id, row: the ``top`` rows of each anchor's windows, of its own label or of others."""
    tiles = chosen_blocks(anchors, table, same)
    needed = table.select("block", "rows", "ids", "labels", "vectors")
    both = needed.unionByName(tiles, allowMissingColumns=True).repartition(shuffle_parts(table.sparkSession), "block")
    found = both.sortWithinPartitions("block", F.col("low").isNotNull()).mapInArrow(_read(same, top), _FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id ``every`` divides; negatives of a positive are the best rows of other labels that
    score at most as the positive does and at least ``percent`` hundredths of that."""
    table = blocks(participants(embeddings), scale)
    anchors = saved(table.select("rows", "ids", "labels", "vectors").mapInArrow(_anchors(every, n_positives), _ANCHOR))
    positives = saved(best(anchors, table, True, n_positives))
    score = F.col("score")
    least = F.ceil(score * percent / 100)  # scores have at most 56 bits: correct below in whole numbers
    least = F.when(least * 100 >= score * percent, F.when((least - 1) * 100 >= score * percent, least - 1).otherwise(least)).otherwise(least + 1)
    window = F.struct("rank", F.when(score < 0, _HIGH).otherwise(least).alias("low"), score.alias("high"))
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w"))  # n_positives at most
    spare = F.array_repeat(F.struct(F.lit(0).alias("rank"), F.lit(_HIGH).alias("low"), F.lit(_LOW).alias("high")), F.lit(n_positives) - F.size("w"))
    windows = windows.withColumn("w", F.concat("w", spare)).select("anchor", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    asking = saved(anchors.drop("lows", "highs").join(windows, F.col("row") == F.col("anchor")).drop("anchor"))
    negatives = best(asking, table, False, n_negatives)
    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", F.col("rank").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives = negatives.select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(negatives, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
