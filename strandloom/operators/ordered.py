"""Running totals and ranks over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.storage import saved


def running_totals(rows: DataFrame, key: str, totals: list[str], descending: bool = False) -> DataFrame:
    """``rows`` (one for each ``key``) with ``upto_x`` (own row included) and ``all_x`` for each x of ``totals``.

    Rows are range-partitioned by key once and stored with their partition's number; sums run
    within a partition and are shifted by the totals of the partitions before it, of which
    there is one row each."""
    order: Column = F.desc(key) if descending else F.asc(key)
    parts = saved(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    ahead, everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = parts.groupBy("__part").agg(*(F.sum(x).alias(x) for x in totals))
    shifts = sums.select("__part", *(F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"__before_{x}") for x in totals), *(F.sum(x).over(everything).alias(f"all_{x}") for x in totals))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumns({f"upto_{x}": F.sum(x).over(within) for x in totals}).join(F.broadcast(shifts), "__part")
    return placed.withColumns({f"upto_{x}": F.col(f"upto_{x}") + F.col(f"__before_{x}") for x in totals}).drop("__part", *(f"__before_{x}" for x in totals))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """value and rank: the mean rank (from 1) of each distinct value; nulls have none."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    return running_totals(counts, value, ["cnt"]).select(value, (F.col("upto_cnt") - (F.col("cnt") - 1) / 2).alias("rank"))


def rank_sum(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """members, population, rank_sum of the rows in ``group``."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("cnt"), F.count_if(group).alias("own"))
    ranked = running_totals(counts, value, ["cnt"])
    return ranked.agg(F.sum("own").alias("members"), F.sum("cnt").alias("population"), F.sum((F.col("upto_cnt") - (F.col("cnt") - 1) / 2) * F.col("own")).alias("rank_sum"))


def largest_gap(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """distance, n_in, n_out: the largest gap between the value distributions inside and outside of ``group``."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(group).alias("p"), F.count_if(~group).alias("n"))
    run = running_totals(counts, value, ["p", "n"])
    gap = F.abs(F.col("upto_p") / F.col("all_p") - F.col("upto_n") / F.col("all_n"))
    return run.agg(F.max(gap).alias("distance"), F.first("all_p").alias("n_in"), F.first("all_n").alias("n_out"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rho: Pearson correlation of average ranks."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx, ry = average_ranks(both, x).withColumnRenamed("rank", "rx"), average_ranks(both, y).withColumnRenamed("rank", "ry")
    pairs = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("w")).join(rx, x).join(ry, y)
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    n, sa, sb = F.sum(w), F.sum(w * a), F.sum(w * b)
    covariance = F.sum(w * a * b) / n - sa / n * (sb / n)
    spread = F.sqrt((F.sum(w * a * a) / n - F.pow(sa / n, F.lit(2))) * (F.sum(w * b * b) / n - F.pow(sb / n, F.lit(2))))
    return pairs.agg(F.when(spread > 0, covariance / spread).otherwise(0.0).alias("rho"))
