"""Mixing sources to target weights: capped water-filling, all in DataFrame functions.

A source with weight w and size S gets min(max_epochs * S, level * w), with the
level chosen so that the targets add up to all sizes: clamp the sources above
their cap, share what is left by weight, and repeat until none is above.  Each
document is then taken floor(target / S) whole times, and once more where its
seeded position lies below the source's cut.  The cut is found from two levels of
histograms over positions, so no task sees all documents of a source.

A position comes from the seed, doc_id, text and, among rows that agree in both, a rank,
so that null and repeated identifiers spread like any others.

Defined cases: a null text has size 0; a null source is a source of its own; of rows
with one doc_id, source and text any may be the one that is taken more often; sources of equal
cap and weight get equal targets; a very long text counts whole, and a source's cut may miss its
target by half of it; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import carried, saved
from strandloom.operators.ordered import running_totals

WORD = r"[^\x20\x09-\x0D]+"
#: Positions have this many bits; a histogram level resolves CELL of them.
POSITION_BITS, CELL = 48, 12
#: Repeated keys up to which they are broadcast (64 bytes each).
BROADCAST_ROWS = 200_000


def _key():
    """Digest of a document's identifier, source and text."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    return F.sha2(F.concat_ws(":", F.col("doc_id").isNull().cast("string"), F.col("source").isNull().cast("string"), *part), 256)


def position(seed: int, key: str = "__key", rank: str = "__rank"):
    """A document's seeded position in its source."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key, rank), 256), 1, POSITION_BITS // 4), 16, 10).cast("long")


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``__rank``: 0, 1, ... among rows of one ``__key``.

    Keys that occur once, nearly all, have rank 0 and are not shuffled for it.  The others
    are numbered within the partitions in which they lie, and shifted by the partitions before;
    so no task sees all rows of a hot key."""
    repeated = saved(rows.groupBy("__key").count().where("count > 1"))
    size = repeated.agg(F.count(F.lit(1)).alias("keys"), F.sum("count").alias("rows")).first()
    if not size["keys"]:
        return rows.withColumn("__rank", F.lit(0).cast("long"))
    mark = repeated.select("__key", F.lit(True).alias("__again"))
    flagged = rows.join(F.broadcast(mark) if size["keys"] <= BROADCAST_ROWS else mark, "__key", "left")
    stored = saved(flagged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    single = stored.where(F.col("__again").isNull()).withColumn("__rank", F.lit(0).cast("long"))
    several = stored.where("__again")
    counts = several.groupBy("__key", "__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shifts = counts.select("__key", "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at")) - 1
    several = several.withColumn("__own", within).join(shifts, ["__key", "__part"]).withColumn("__rank", F.col("__own") + F.col("__before"))
    return single.drop("__again", "__part", "__at").unionByName(several.select(*single.drop("__again", "__part", "__at").columns))


def sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size in words, and the document's position."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = saved(docs.select("doc_id", "source", size.alias("size"), _key().alias("__key")))
    return ranked(keyed).select("doc_id", "source", "size", position(seed).alias("position"))


def cyclic_weights(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give sources, by code point with null last, the weights of ``cycle`` in turn.

    ``totals`` has a row per source; sources may be many (hosts, say), so they are ranked
    in range partitions that are shifted by the number of sources before them."""
    named = totals.where(F.col("source").isNotNull()).withColumn("__one", F.lit(1))
    placed = running_totals(named, "source", ["__one"]).select(*totals.columns, F.col("upto___one").alias("__place"))
    rest = totals.where(F.col("source").isNull()).join(F.broadcast(named.agg((F.count(F.lit(1)) + 1).alias("__place"))), how="cross")  # one row each
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.col("__place") - 1) % len(cycle) + 1).cast("int")).cast("double")
    return placed.unionByName(rest).withColumn("weight", weight).drop("__place")


def water_fill(totals: DataFrame, max_epochs: float = 3) -> DataFrame:
    """Add ``target`` to source, source_size, weight.  Only sums come to the driver."""
    cap, weight = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight")
    level, clamped = 0.0, -1
    while True:
        over = cap < weight * F.lit(level)
        row = totals.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, cap).otherwise(0.0)).alias("held"), F.sum(F.when(~over, weight).otherwise(0.0)).alias("free"), F.count_if(over).alias("n")
        ).first()
        if row["n"] == clamped or not row["free"]:
            break
        clamped, level = row["n"], (row["all"] - row["held"]) / row["free"]
    if totals.isEmpty() or math.isinf(level):
        level = 0.0
    return totals.withColumn("target", F.least(cap, weight * F.lit(level)))


def _plan(docs: DataFrame, max_epochs: float, weights) -> DataFrame:
    """A row per source: __source, source_size, target, whole and cut; ``docs`` as ``sizes`` gives it."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    filled = water_fill(saved(weights(saved(totals))), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = saved(filled.withColumn("whole", whole).withColumn("part", F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0))))
    plan = plan.withColumnRenamed("source", "__source")

    fine = POSITION_BITS - 2 * CELL
    top, low = F.shiftright("position", POSITION_BITS - CELL), F.shiftright("position", fine) % (1 << CELL)
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def boundary(cells: DataFrame, before) -> DataFrame:
        """The first cell of each source by which ``part`` is reached, with what lies below and through it."""
        run = cells.withColumn("through", F.sum("size").over(upto) + before)
        reached = run.where(F.col("through") >= F.col("part")).withColumn("below", F.col("through") - F.col("size"))
        return reached.groupBy("source").agg(F.min_by(F.struct("cell", "below", "through"), "cell").alias("at"), F.first("part").alias("part"))

    coarse = docs.groupBy("source", top.alias("cell")).agg(F.sum("size").alias("size"))
    coarse = coarse.join(plan, coarse["source"].eqNullSafe(plan["__source"])).where(F.col("part") > 0).select("source", "cell", "size", "part")
    first = saved(boundary(coarse, F.lit(0)).select(F.col("source").alias("__s"), F.col("at.cell").alias("top"), F.col("at.below").alias("before"), "part"))
    inner = docs.join(first, docs["source"].eqNullSafe(first["__s"]) & (top == first["top"]))
    inner = inner.groupBy("source", "top", "before", "part", low.alias("cell")).agg(F.sum("size").alias("size"))
    second = boundary(inner, F.col("before")).join(first.select("__s", "top"), F.col("source").eqNullSafe(F.col("__s")))
    nearer = F.col("at.through") - F.col("part") < F.col("part") - F.col("at.below")
    cut = F.shiftleft(F.col("top"), POSITION_BITS - CELL) + F.shiftleft(F.col("at.cell") + F.when(nearer, 1).otherwise(0), fine)
    cuts = saved(second.select(F.col("source").alias("__c"), cut.alias("cut")))
    joined = plan.join(cuts, F.col("__source").eqNullSafe(F.col("__c")), "left")
    return saved(joined.select("__source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")))


def _repeats():
    return F.col("whole") + F.when(F.col("position") < F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, max_epochs: float = 3, seed: int = 0, weights=cyclic_weights) -> DataFrame:
    """doc_id, size, source_size, target, repeats, taken for every document.

    ``weights`` maps a frame of (source, source_size) to one with ``weight`` too."""
    sized = saved(sizes(docs, seed))
    plan = _plan(sized, max_epochs, weights)
    out = sized.join(plan, sized["source"].eqNullSafe(plan["__source"]))
    return out.select("doc_id", "size", "source_size", "target", _repeats().alias("repeats"), (F.col("size") * _repeats()).alias("taken"))


def sample(docs: DataFrame, max_epochs: float = 3, seed: int = 0, weights=cyclic_weights) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns of ``docs`` unchanged.

    The plan has a row per source; documents themselves are not shuffled while it is small."""
    plan = _plan(saved(sizes(docs, seed)), max_epochs, weights).select("__source", F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    placed = ranked(docs.select(_key().alias("__key"), F.col("source").alias("__from"), carried(docs))).withColumn("__position", position(seed))
    joined = placed.join(plan, F.col("__from").eqNullSafe(F.col("__source")))
    times = (F.col("__whole") + F.when(F.col("__position") < F.col("__cut"), 1).otherwise(0)).cast("int")
    taken = joined.withColumn("__times", times).where(F.col("__times") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")
