"""Distributed list ranking: the place of every element of one linked list.

Elements that hash less than both neighbours leave the list, about a third of them a round,
and their neighbours take each other; no two neighbours leave at once.  When at most
``LIMIT`` are left one task ranks them.  Then the rounds are undone: who left stood
one weight ahead of its successor.  Rounds fall geometrically, so all work together is
linear in the list, with one shuffle a round each way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import saved

#: Elements that one task ranks (24 bytes each).
LIMIT = 1 << 16


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a short list by pointer doubling."""
    rows = list(batches)
    if not rows or not sum(b.num_rows for b in rows):
        return
    table = pa.Table.from_batches(rows)
    ids, weight = table.column("id").to_numpy(), table.column("w").to_numpy()
    order = np.argsort(ids)
    ends = table.column("next").is_null().to_numpy()
    to = np.searchsorted(ids[order], table.column("next").fill_null(0).to_numpy())
    to = np.where(ends, np.arange(len(ids)), order[np.minimum(to, len(ids) - 1)])
    far = np.where(ends, 0, weight)
    while (to != to[to]).any():
        far, to = far + far[to], to[to]
    yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(far.max() - far)], names=["id", "rank"])


def ranks(elements: DataFrame, limit: int = LIMIT) -> DataFrame:
    """id and rank (from 0) of every element of a list.

    ``elements`` has id, prev (null at the head) and next (null at the tail), longs; a stored
    table, as each round reads it twice."""
    state = elements.select("id", "prev", "next", F.lit(1).cast("long").alias("w"))
    left = []
    while state.count() > limit:
        own, before, after = (F.xxhash64(c, F.lit(len(left))) for c in ("id", "prev", "next"))
        leaves = F.col("prev").isNotNull() & F.col("next").isNotNull() & (own < before) & (own < after)
        gone = state.where(leaves).select("id", "prev", "next", "w")
        left.append(gone.select("id", "next", "w"))
        none = F.lit(None).cast("long")
        told = state.where(~leaves).select("id", "prev", "next", "w", none.alias("p"), none.alias("n"))
        told = told.unionByName(gone.select(F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), "w", none.alias("p"), F.col("next").alias("n")))
        told = told.unionByName(gone.select(F.col("next").alias("id"), none.alias("prev"), none.alias("next"), F.lit(0).cast("long").alias("w"), F.col("prev").alias("p"), none.alias("n")))
        ends = (F.coalesce(F.max("p"), F.max("prev")).alias("prev"), F.coalesce(F.max("n"), F.max("next")).alias("next"), F.sum("w").alias("w"))
        state = saved(told.groupBy("id").agg(*ends))
    known = saved(state.select("id", "next", "w").repartition(1).mapInArrow(_ranked, "id long, rank long"))
    for gone in reversed(left):
        ahead = known.select(F.col("id").alias("next"), F.col("rank").alias("then"))
        known = known.unionByName(saved(gone.join(ahead, "next").select("id", (F.col("then") - F.col("w")).alias("rank"))))
    return known
