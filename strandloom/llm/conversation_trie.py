"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  Its key is a sum over the turns of hashes of
place and content (four 32-bit sums, each modulo 2^32), so keys of all prefixes are running
sums, which cross partitions by their totals; no task sees a whole conversation.  Nodes
are numbered so that children of one parent are consecutive.  Then every node has an enter and an
exit arc, each knows its successor on the tour, ``list_ranking`` gives the arcs' positions, and
what a node's subtree holds is the difference of prefix sums at its two arcs.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; null
turns come first; turns that tie are ordered by the hash of role and text, so repeated rows are
turns like others; a very long text is hashed whole by one task and goes no further; a
conversation or node may hold any share of the rows; without conversations there
is no node; other columns are not read.  Two of n distinct prefixes share a key with a chance below n^2 / 2^129,
unless someone sets out to build such prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import attach, saved, shuffle_parts
from strandloom.llm.list_ranking import LIMIT, ranks
from strandloom.operators.ordered import running_totals

#: Key of the root, and the sums that make a key.
ROOT, SUMS = "0" * 32, ("c0", "c1", "c2", "c3")
#: Identifiers in one piece of a list that is hashed.
PIECE = 512


def running_within(rows: DataFrame, segment: str, order: list[str], sums: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``upto_x``: the sum of x over the rows of a segment up to the own one.

    Rows are range-partitioned by segment and order.  Only segments at a partition's ends can
    cross into others; their sums there (two rows a partition at most) are broadcast."""
    parts = saved(rows.repartitionByRange(shuffle_parts(rows.sparkSession), segment, *order).withColumn("__part", F.spark_partition_id()))
    ends = parts.groupBy("__part").agg(F.min(segment).alias("lo"), F.max(segment).alias("hi"))
    ends = ends.select("__part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(segment))
    held = parts.join(F.broadcast(ends), ["__part", segment]).groupBy(segment, "__part").agg(*(F.sum(x).alias(x) for x in sums))
    ahead = Window.partitionBy(segment).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(segment, "__part", *(F.sum(x).over(ahead).alias(f"__before_{x}") for x in sums))
    within = Window.partitionBy("__part", segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumns({f"upto_{x}": F.sum(x).over(within) for x in sums}).join(F.broadcast(shifts), ["__part", segment], "left")
    shifted = {f"upto_{x}": F.col(f"upto_{x}") + F.coalesce(F.col(f"__before_{x}"), F.lit(0)) for x in sums}
    return placed.withColumns(shifted).drop("__part", *(f"__before_{x}" for x in sums))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), content (a hash of role and text) and n_bytes (of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", content.alias("content"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"))
    return saved(running_within(rows, "conv_id", ["turn", "content"], ("one",)).select("conv_id", F.col("upto_one").alias("place"), "content", "n_bytes"))


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id and n, its number of turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def with_shared_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after every conversation c takes the first h turns of c - c % family in place of its own, h = crc32(c) % heads.

    Remainders have the sign of c, as in SQL."""
    own = saved(lengths(turns).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % heads, "base": F.col("conv_id") - F.col("conv_id") % family}))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = saved(own.join(bases, "base", "left").select("conv_id", "base", "h", "n", taken.alias("taken")))
    first = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "taken"), "base").where("place <= taken")
    later = attach(turns, plan.select("conv_id", "h", "taken", "n"), "conv_id", "n").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    both = first.select(*turns.columns).unionByName(later.select(*turns.columns))
    return both, plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _key(sums: list[Column]) -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(F.pmod(s, F.lit(1 << 32))), 8, "0")) for s in sums))


def prefixes(turns: DataFrame) -> DataFrame:
    """A stored row per prefix of every conversation: conv_id, depth, key, parent_key, n_bytes of its last text."""
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("content")), 256)
    hashed = turns.withColumn("digest", digest).select("conv_id", "place", "n_bytes", *(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(SUMS)))
    run = running_within(hashed, "conv_id", ["place"], SUMS)
    own, before = [F.col(f"upto_{c}") for c in SUMS], [F.col(f"upto_{c}") - F.col(c) for c in SUMS]
    return saved(run.select("conv_id", F.col("place").alias("depth"), _key(own).alias("key"), _key(before).alias("parent_key"), "n_bytes"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a key's sorted identifiers, as text."""
    part, number, last, held = TaskContext.get().partitionId(), 0, None, []
    out: list[tuple] = []

    def close() -> None:
        nonlocal number, held
        if held:
            out.append((last, part, number, ",".join(map(str, held))))
            number, held = number + 1, []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({c: pa.array(x, kind) for c, kind, x in zip(("key", "part", "number", "ids"), (pa.string(), pa.int32(), pa.int64(), pa.string()), zip(*out, strict=True), strict=True)})
        out.clear()
        return batch

    for batch in batches:
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last or len(held) == PIECE:
                close()
            last = key
            held.append(conv)
        if out:
            yield flushed()
    close()
    if out:
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == last:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((last, state.hexdigest()))
            last, state = key, hashlib.sha256(ids.encode())
        if done:
            yield _named(done)
    if state is not None:
        yield _named([(last, state.hexdigest())])


def _named(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["key", "ends_sha256"])


def list_digests(members: DataFrame) -> DataFrame:
    """key and ends_sha256: SHA-256 of each key's conv_ids, ascending and comma-joined.

    Lists are made in range partitions as pieces of ``PIECE`` identifiers; a task then takes a key's
    pieces in order and holds one at a time."""
    parts = shuffle_parts(members.sparkSession)
    sorted_rows = members.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = sorted_rows.mapInArrow(_pieces, "key string, part int, number long, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "part", "number").mapInArrow(_hashed, "key string, ends_sha256 string")


def _nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, conv_id, depth, parent_key, n_bytes and n_convs of every node."""
    inner = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_convs"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    return inner.unionByName(root.select(F.lit(ROOT).alias("key"), "conv_id", zero.alias("depth"), F.lit(None).cast("string").alias("parent_key"), zero.alias("n_bytes"), "n_convs"))


def _family(nodes: DataFrame) -> DataFrame:
    """Stored nodes with a number, their children's numbers (first to last) and the parent's number, conv_id and children's numbers (eldest to youngest)."""
    siblings = nodes.withColumns({"order": F.concat(F.coalesce("parent_key", F.lit("")), F.col("key")), "one": F.lit(1).cast("long")})
    numbered = saved(running_totals(siblings, "order", ["one"]).withColumnRenamed("upto_one", "id").drop("order", "one", "all_one"))
    kids = numbered.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_children"))
    own = saved(numbered.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = own.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("first").alias("eldest"), F.col("last").alias("youngest"), F.col("n_children").alias("siblings"))
    return saved(attach(own, parents, "parent_key", "siblings").drop("siblings"))


def tour(tree: DataFrame) -> DataFrame:
    """Arcs of the Euler tour, with the arcs before and after each: 2 * id enters a node, 2 * id + 1 leaves it."""
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    inner, child = F.col("parent").isNotNull(), F.col("n_children") > 0
    before = F.when(inner, F.when(F.col("id") > F.col("eldest"), enter - 1).otherwise(F.col("parent") * 2))
    after = F.when(inner, F.when(F.col("id") < F.col("youngest"), enter + 2).otherwise(F.col("parent") * 2 + 1))
    down, up = F.when(child, F.col("first") * 2).otherwise(leave), F.when(child, F.col("last") * 2 + 1).otherwise(enter)
    pair = F.array(F.struct(enter.alias("id"), before.alias("prev"), down.alias("next")), F.struct(leave.alias("id"), up.alias("prev"), after.alias("next")))
    return tree.select(F.explode(pair).alias("arc")).select("arc.*")


def trie(turns: DataFrame, lengths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, place, content and n_bytes, ``lengths`` conv_id and n, also for
    conversations without turns.  ``saved_tokens`` counts bytes that a cache of prefixes need not read again."""
    lengths = saved(lengths)
    rows = prefixes(turns)
    tree = _family(_nodes(rows, lengths))
    placed = ranks(saved(tour(tree)), limit)
    leaf, spared = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("n_bytes")
    values = tree.select((F.col("id") * 2).alias("id"), leaf.alias("leaf"), spared.alias("spared"))
    zero = F.lit(0)
    arcs = placed.join(values, "id", "left").select("id", "rank", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("spared", zero).alias("spared"))
    sums = running_totals(arcs, "rank", ["leaf", "spared"])
    inside = [(F.max(f"upto_{c}") - F.min(f"upto_{c}") + F.sum(c)).alias(name) for c, name in (("leaf", "n_leaves"), ("spared", "saved_tokens"))]
    below = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(*inside)

    ends = rows.join(lengths.where("n > 0").select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
    ends = ends.unionByName(lengths.where("n = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    out = tree.join(below, "id").join(list_digests(ends), "key", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
