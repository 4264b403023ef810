"""Exact dedup: tree-merge of sorted digest runs.

Every partition sorts its digests and collapses equal ones into a run.  Then
partitions exchange runs in binomial rounds: in round r partitions whose numbers
differ in bit r hand each other the part of their run whose digests fall to the
other's side, so that after log2(parts) rounds each partition holds one share of the
digest space, merged.  (``fan_in`` partners a round make fewer, wider rounds.)  Every
level merges the sorted runs that it gets and keeps, for each verified key (SHA-256
and byte length), one row and the number of rows.  Copies collapse at each level, so
a hot text shrinks before it is sent.  A merging task holds its share of the keys,
about a hundred bytes each; more shuffle partitions make shares smaller.

Defined cases: a null text counts as empty; null doc_ids never win against
others; of rows that tie for the identifier that stays (the same doc_id, or nulls only)
exactly one stays, the first in the stored table for ``duplicates`` and the one of the
least hash of all columns for ``deduplicate``; a very long text is hashed whole by one
task; an empty table gives an empty result; further columns are not read by
``duplicates`` and pass unchanged through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import attach, carried, lower_bytes, releasing, saved, shuffle_parts, slices, text_bytes, with_text

#: Dropped rows up to which their keys are broadcast (48 bytes each).
BROADCAST_ROWS = 200_000
#: Rows of one batch of a run.
BATCH = 1 << 16

_DIGESTED = "doc_id long, digest binary, n_bytes long"
_RUN = "part int, origin int, digest binary, n_bytes long, keep_id long, keep_row long, group_size long"
_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _sha256(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(lower_bytes(data))
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            data, offsets = text_bytes(piece.column(1))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(_sha256(data, offsets), pa.binary()), pa.array(np.diff(offsets))], names=["doc_id", "digest", "n_bytes"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text with A-Z lower-cased, and its length in bytes."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(releasing(_digest), _DIGESTED)


def collapsed(runs: list[pa.RecordBatch], keep: str) -> pa.RecordBatch | None:
    """One sorted run of several: a row for each key, with the identifier and row that stay and the number of rows."""
    table = pa.Table.from_batches(runs)
    if not table.num_rows:
        return None
    digest = table.column("digest").cast(pa.binary(32)).combine_chunks()
    digest = np.frombuffer(digest.buffers()[1], "S32")[digest.offset : digest.offset + len(digest)]
    n_bytes, row, size = (table.column(c).to_numpy() for c in ("n_bytes", "keep_row", "group_size"))
    known = table.column("keep_id").is_valid().to_numpy()
    ids = table.column("keep_id").fill_null(0).to_numpy()
    # A stable sort of joined runs finds and merges them.
    high = digest.view(">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
    order = np.argsort(high, kind="stable")
    tied = high[order][1:] == high[order][:-1]
    if tied.any():  # equal texts, or digests alike in their first bytes: by the whole key, then the row that stays first
        rank = np.where(known, ids if keep == "smallest" else ~ids, 0)
        mixed = np.zeros(len(order), bool)
        mixed[1:] |= tied
        mixed[:-1] |= tied
        own = order[mixed]
        parts = digest.view(">u8").reshape(-1, 4)[own]
        order[mixed] = own[np.lexsort((row[own], rank[own], ~known[own], n_bytes[own], *parts.T[::-1]))]
    words = digest.view(">u8").reshape(-1, 4)[order]
    opens = np.ones(len(order), bool)
    opens[1:] = (words[1:] != words[:-1]).any(axis=1) | (n_bytes[order][1:] != n_bytes[order][:-1])
    first = order[opens]
    sizes = np.add.reduceat(size[order], np.flatnonzero(opens))
    out = table.take(pa.array(first)).combine_chunks().to_batches()[0]
    return out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(sizes))


def _merger(keep: str):
    """Merge the runs that a task gets, each in its order, and hand on one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for origin in set(batch.column("origin").to_pylist()):
                runs.setdefault(origin, []).append(batch.filter(pc.equal(batch.column("origin"), origin)))
        merged = collapsed([b for own in runs.values() for b in own], keep) if runs else None
        for begin in range(0, merged.num_rows if merged else 0, BATCH):
            yield merged.slice(begin, BATCH)

    return merge


def merged_runs(digested: DataFrame, keep: str = "largest", fan_in: int = 2) -> DataFrame:
    """One row per key: digest, n_bytes, keep_id (the ``largest`` or ``smallest``), keep_row, group_size.

    ``digested`` has doc_id, digest, n_bytes and ``row``, a number of its own for every row."""
    rounds = max(1, math.ceil(math.log(max(2, shuffle_parts(digested.sparkSession)), fan_in)))
    parts = fan_in**rounds
    merge = _merger(keep)
    place = F.pmod(F.spark_partition_id(), F.lit(parts)).cast("int")
    one = F.lit(1).cast("long").alias("group_size")
    first = digested.select(place.alias("part"), place.alias("origin"), "digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), one)
    run = first.mapInArrow(merge, _RUN)
    share = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % parts
    for r in range(rounds):
        unit = fan_in**r

        def digit(c, unit=unit):
            return F.floor(c / unit) % fan_in

        to = (F.col("part") + (digit(share) - digit(F.col("part"))) * unit).cast("int")
        sent = run.withColumn("origin", F.col("part")).withColumn("part", to).repartitionById(parts, F.col("part"))
        run = sent.mapInArrow(merge, _RUN)
    return run.drop("part", "origin")


def _numbered(docs: DataFrame) -> DataFrame:
    """A stored table of digests in which every row has a number."""
    return saved(digests(docs).withColumn("row", F.monotonically_increasing_id()))


def duplicates(docs: DataFrame, keep: str = "largest", fan_in: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks one row of each group."""
    digested = _numbered(docs)
    groups = saved(merged_runs(digested, keep, fan_in).select(_key(), "keep_id", "keep_row", "group_size"))
    rows = digested.select("doc_id", "digest", "row", _key())
    return attach(rows, groups, "__key", "group_size").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _key():
    return F.concat(F.col("digest"), F.encode(F.col("n_bytes").cast("string"), "UTF-8")).alias("__key")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in map(with_text, batches):
        for piece in slices(batch):
            hashes = pa.array(_sha256(*text_bytes(piece.column(0))), pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(1), hashes, piece.column(2)], names=["doc", "hash", "row"])


def deduplicate(docs: DataFrame, keep: str = "largest", fan_in: int = 2) -> DataFrame:
    """Rows of ``docs`` that stay, one for each distinct text, all columns unchanged.

    The dropped (doc_id, digest) pairs are broadcast while they are few, and joined by a shuffle beyond that.
    Rows that tie for the identifier that stays are reduced by an aggregate."""
    digested = _numbered(docs)
    groups = saved(merged_runs(digested, keep, fan_in).select(_key(), "keep_id", "group_size"))
    marked = attach(digested.select("doc_id", "digest", _key()), groups, "__key", "group_size")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = saved(marked.where(F.col("group_size") > 1).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__d"), stays.alias("stays")).count())
    gone = marked.where(~F.col("stays")).select("__id", "__d")
    tied = marked.where(F.col("stays") & (F.col("count") > 1)).select("__id", "__d")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), carried(docs))
    kinds = T.StructType([T.StructField("doc", T.LongType()), T.StructField("hash", T.BinaryType()), rows.schema["row"]])
    coded = rows.mapInArrow(releasing(_with_digest), kinds)

    def among(pairs: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        return coded.join(few, F.col("doc").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__d")), how)

    if tied.isEmpty():
        return among(gone, "left_anti").select("row.*")
    one = among(tied, "left_semi").groupBy("doc", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return among(gone.unionByName(tied), "left_anti").select("row.*").unionByName(one.select("row.*"))
