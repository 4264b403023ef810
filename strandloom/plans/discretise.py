"""From posteriors to sites: the best number of a model's local maxima, and the best range of its columns.

Maxima are found where a sequence is scanned, ranked over range partitions, and their letters
summed into cumulative matrices, so that the E-value of every number of sites is one row's work.
Column ranges are compared by prefix sums of their scores.  Only the best row of each comparison, a
few numbers, comes to the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.stats import log_product_p
from strandloom.operators import em, scan, significance
from strandloom.operators.packing import letters
from strandloom.operators.transforms import LETTERS
from strandloom.storage import saved

#: Numbers of sites up to which each is compared by its exact tails; larger ones by the table of tails.
EACH = 1024
#: Decimals of log E-values and p-values below which two are equal.
SAME = 9


@dataclass(frozen=True)
class Sites:
    """A model fitted to its best sites, their number, where its columns lay in the model before, and the log of its E-value; ``places`` has seq_id, start, strand, word."""

    model: em.Model
    nsites: int
    offset: int
    log_evalue: float
    places: DataFrame


def maxima(seqs: DataFrame, model: em.Model) -> DataFrame:
    """seq_id, start, strand, score, word of the windows that may be sites.

    With any number of sites these are the local maxima of the posterior, with one a sequence at most the
    best window of each sequence (the first of equal ones)."""
    odds = np.log(model.theta / model.background).tolist()
    found = scan.hits(seqs, odds, None, peaks=True, words=True)
    if model.spread == em.ANY:
        return found
    best = found.groupBy("seq_id").agg(F.max_by(F.struct("start", "strand", "score", "word"), F.struct("score", -F.col("start"))).alias("w"))
    return best.select("seq_id", "w.*")


def _counted(width: int, before: dict[int, np.ndarray]):
    """Rank and cumulative letter counts of rows that come part by part and in order; ``before`` has what lies ahead of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, upto = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("__part").to_numpy()
            code = letters(batch.column("word"))[0].reshape(-1, width)
            run = np.ones((len(part), 1 + 4 * width), np.int64)
            run[:, 1:] = (code[:, :, None] == np.arange(4)).reshape(len(part), -1)
            begins = np.flatnonzero(np.diff(part, prepend=-1))
            for first, last in zip(begins, [*begins[1:], len(part)], strict=True):
                if part[first] != now:
                    now, upto = part[first], before[part[first]]
                run[first:last] = np.cumsum(run[first:last], axis=0) + upto
                upto = run[last - 1].copy()
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * 4 * width), pa.array(run[:, 1:].ravel()))
            columns = [*batch.columns[:-1], pa.array(run[:, 0]), counts]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "rank", "counts"])

    return run


def _ranked(sites: DataFrame, width: int) -> tuple[DataFrame, int]:
    """``ranked_counts``, and the number of its rows.

    Rows are range-partitioned once and stored with their partition's number; each partition is then walked in
    order from the counts of those before it, of which one row each comes to the driver."""
    order = F.struct((-F.round("score", SAME)).alias("s"), "seq_id", "start")
    parts = saved(sites.withColumn("order", order).repartitionByRange("order").withColumn("__part", F.spark_partition_id()))
    cells = [F.count_if(F.substring("word", j + 1, 1) == x) for j in range(width) for x in LETTERS]
    before, upto = {}, np.zeros(1 + 4 * width, np.int64)
    for r in parts.groupBy("__part").agg(F.array(F.count(F.lit(1)), *cells).alias("total")).orderBy("__part").collect():
        before[r["__part"]] = upto
        upto = upto + np.array(r["total"], np.int64)
    walked = parts.repartition("__part").sortWithinPartitions("__part", "order").select(*sites.columns, "__part")
    schema = T.StructType([*sites.schema.fields, T.StructField("rank", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    return walked.mapInArrow(_counted(width, before), schema), int(upto[0])


def ranked_counts(sites: DataFrame, width: int) -> DataFrame:
    """``sites`` with ``rank`` (from 1, by falling score, then seq_id and start) and ``counts``: letter counts by column over all sites up to the own one."""
    return _ranked(sites, width)[0]


def column_ratios(counts: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each column of each row's counts (rows, columns, letters)."""
    n = counts.sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, counts * np.log(counts / (np.maximum(n, 1) * background)), 0.0).sum(axis=2)


def log_products(width: int, log_product: np.ndarray) -> np.ndarray:
    """``stats.log_product_p`` of an array: log p-values of products of ``width`` uniform variables."""
    k = np.arange(width)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(k == 0, 0.0, k * np.log(-log_product)[:, None]) - np.array([math.lgamma(x + 1) for x in k])
    return log_product + np.logaddexp.reduce(terms, axis=1)


def _valued(width: int, background: np.ndarray, starts: float, table: np.ndarray, exact: bool):
    """Log E-values of (rank, counts): one row a task, the best of more than ``EACH`` sites, and all of fewer.

    Those of fewer are exact, or lower bounds: the chance of the counts themselves is never above the tail of their ratio."""
    q = tuple(map(float, background))
    tables = None if exact else significance.tail_table(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            rank = batch.column(0).to_numpy()
            if not len(rank):
                continue
            cells = batch.column(1).flatten().to_numpy().reshape(-1, width, 4)
            ratios, many = column_ratios(cells, np.array(q)), rank > EACH
            logs = np.empty(ratios.shape)
            if many.any():
                logs[many] = significance.read_tails(ratios[many], rank[many, None], q, tables)
            if exact:
                for k in np.flatnonzero(~many):
                    logs[k] = significance.log_tails(ratios[k], int(rank[k]), q)
            elif not many.all():
                logs[~many] = significance.log_chances(cells[~many], q)
            value = np.round(log_products(width, logs.sum(axis=1)) + significance.read_placements(table, starts, rank), SAME)
            known = np.flatnonzero(~np.isnan(value))
            few = known[rank[known] <= EACH]
            if len(few):
                yield pa.RecordBatch.from_arrays([pa.array(rank[few]), pa.array(value[few]), batch.column(1).take(pa.array(few))], names=["rank", "value", "counts"])
            rest = known[rank[known] > EACH]
            if len(rest):
                k = rest[np.lexsort((rank[rest], value[rest]))[0]]
                best = min(best or (math.inf, sys.maxsize, None), (value[k], rank[k], batch.column(1).take(pa.array([k]))), key=lambda x: x[:2])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[1]]), pa.array([best[0]]), best[2]], names=["rank", "value", "counts"])

    return run


def best_number(ranked: DataFrame, width: int, background: np.ndarray, starts: int, least: int, most: int | None) -> tuple[int, float, np.ndarray] | None:
    """The number of sites of the least log E-value (the smaller of equal ones), that value and the sites' counts.

    All numbers are compared in one pass over ``ranked``, whose rows should lie together by rank.  Exact sums take up to half a second
    each, so numbers up to ``EACH`` first get a lower bound, and only those whose bound does not exceed the best value found are summed."""
    spark = ranked.sparkSession
    if most is None:
        most = ranked.agg(F.max("rank")).first()[0] or 0
    table = significance.placements_table(spark, float(starts), most)

    def valued(rows: DataFrame, exact: bool) -> list:
        return rows.mapInArrow(_valued(width, background, float(starts), table, exact), "rank long, value double, counts array<long>").collect()

    def summed(few: list) -> list:
        made = spark.createDataFrame([(r["rank"], r["counts"]) for r in few], "rank long, counts array<long>")
        return valued(made.repartition(max(1, min(len(few), 4 * cores)), "rank"), True)

    cores, found = spark.sparkContext.defaultParallelism, valued(ranked.where(F.col("rank").between(least, most)).select("rank", "counts"), False)
    done = [r for r in found if r["rank"] > EACH]
    few = sorted((r for r in found if r["rank"] <= EACH), key=lambda r: (r["value"], r["rank"]))
    done += summed(few[:cores]) if few else []
    top = min((r["value"] for r in done), default=math.inf)
    left = [r for r in few[cores:] if r["value"] <= top + 1e-6 + 1e-9 * abs(top)]
    done += summed(left) if left else []
    best = min(done, key=lambda r: (r["value"], r["rank"]), default=None)
    return best and (best["rank"], best["value"], np.array(best["counts"], float).reshape(width, 4))


def best_ranges(columns: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, offset, width, log_p: the range of at least ``least`` columns whose product has the least p-value.

    ``columns`` has keys, pos (from 0) and log_p, the log p-value of a column.  Of equal ranges the
    narrowest counts, then the leftmost.  Sums are differences of prefix sums."""
    listed = columns.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "log_p"))), lambda r: r["log_p"]).alias("logs"))
    prefix = F.aggregate("logs", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    summed = listed.select(*keys, prefix.alias("prefix"), F.size("logs").alias("n")).where(F.col("n") >= least)
    wide = summed.withColumn("width", F.explode(F.sequence(F.lit(least), "n")))
    ranges = wide.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
    total = F.element_at("prefix", F.col("offset") + F.col("width") + 1) - F.element_at("prefix", F.col("offset") + 1)
    scored = ranges.select(*keys, "offset", "width", F.round(log_product_p(F.col("width"), total), SAME).alias("log_p"))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("offset", "width", "log_p"), F.struct("log_p", "width", "offset")).alias("b"))
    return best.select(*keys, "b.*")


def shortened(sites: DataFrame, width: int, offset: int, kept: int) -> DataFrame:
    """``sites`` of ``width`` letters cut to ``kept`` columns from ``offset``; on the reverse strand the start moves by what is cut off at the end."""
    moved = F.when(F.col("strand") == "-", width - kept - offset).otherwise(offset)
    return sites.withColumns({"start": F.col("start") + moved, "word": F.substring("word", offset + 1, kept)})


def fitted(model: em.Model, counts: np.ndarray, nsites: int, starts: int, sequences: int) -> em.Model:
    """The M step of so many sites, each with a posterior of one."""
    theta = counts + nsites * em.PRIOR * model.background
    share = nsites / max(1, starts if model.spread == em.ANY else sequences)
    return replace(model, theta=theta / theta.sum(axis=1, keepdims=True), rate=min(max(share, 1e-12), 1 - 1e-12), density=nsites / max(1, starts))


def discretise(seqs: DataFrame, model: em.Model, min_sites: int = 2, max_sites: int | None = None, min_width: int = 1) -> Sites | None:
    """The model's sites and columns of least E-value; None if it has fewer maxima than ``min_sites``.

    First the best number of sites at full width, then the best range of columns, then the best number again
    at that width, of at most as many sites."""
    background = model.background / model.background.sum()
    width = model.width
    ranked, found = _ranked(saved(maxima(seqs, model)), width)
    room = seqs.agg(F.sum(F.greatest(F.length("seq") - width + 1, F.lit(0))).alias("starts"), F.count_if(F.length("seq") >= width).alias("n")).first()
    first = best_number(ranked, width, background, room["starts"] or 0, min_sites, found if max_sites is None else min(found, max_sites))
    if first is None:
        return None
    number, value, counts = first
    logs = significance.log_tails(column_ratios(counts[None], background)[0], number, tuple(map(float, background)))
    columns = seqs.sparkSession.createDataFrame([(0, j, float(v)) for j, v in enumerate(logs)], "motif int, pos int, log_p double")
    cut = best_ranges(columns, ["motif"], min(min_width, width)).first()
    offset, kept = cut["offset"], cut["width"]
    best = saved(ranked.where(F.col("rank") <= number).select(*(c for c in ranked.columns if c not in ("rank", "counts"))))
    narrow = best
    starts = room["starts"] or 0
    if kept < width:
        narrow = saved(shortened(best, width, offset, kept))
        starts = seqs.agg(F.sum(F.greatest(F.length("seq") - kept + 1, F.lit(0)))).first()[0] or 0
    again = saved(ranked_counts(narrow, kept))
    number, value, counts = best_number(again, kept, background, starts, min_sites, number)
    exact = significance.log_tails(column_ratios(counts[None], background)[0], number, tuple(map(float, background))).sum()
    ways = significance.log_ways(seqs, kept, number, model.spread)
    series = math.log(math.fsum(math.exp(k * math.log(-exact) - math.lgamma(k + 1)) if exact < 0 else float(k == 0) for k in range(kept)))
    after = fitted(replace(model, theta=model.theta[offset : offset + kept]), counts, number, starts, room["n"])
    return Sites(after, number, offset, exact + series + ways, again.where(F.col("rank") <= number).select("seq_id", "start", "strand", "word"))
