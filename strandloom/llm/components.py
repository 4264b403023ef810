"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import attach, saved

#: Neighbours of a node from which its edges are no longer left to one task.
HUB = 1000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least neighbour of u; ``least`` has u, m and the number n of u's edges."""
    least = saved(least)
    if least.where(F.col("n") > HUB).isEmpty():
        return edges.join(least, "u")
    return attach(edges, least, "u", "n")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (a, b).

    Each round turns every neighbourhood into a star around its least member, which
    takes a number of rounds logarithmic in the number of nodes.  Neighbourhoods are only
    reduced to their minimum and size, which hubs get by a broadcast (``attach``), so no
    task holds a hub's edges.  Nulls in ``edges`` are no nodes."""
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = saved(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # A row for each neighbour above the centre, and the centre's own row.
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").where("u != v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
