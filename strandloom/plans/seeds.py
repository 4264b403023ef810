"""From two sequence sets to seed matrices: enrichment, clusters, alignment, weighted matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import clustering, composition, enrichment
from strandloom.storage import saved as stored


def numbered(words: DataFrame) -> DataFrame:
    """Words with ``id`` from 0 by gap, falling z and word; ids name edges and clusters.

    Ranks run within a gap and are shifted by the gaps before it."""
    ranked = enrichment.ranked(words)
    sizes = words.groupBy("gap").agg(F.count(F.lit(1)).alias("words"))
    earlier = sizes.select(F.col("gap").alias("g"), F.col("words").alias("w"))
    before = sizes.join(earlier, F.col("g") < F.col("gap"), "left").groupBy("gap").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(before), "gap").withColumn("id", F.col("before") + F.col("rank") - 1).drop("before", "rank")


def similarity_edges(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Edges between all words (id, word) that are near enough."""
    return clustering.distances(clustering.near_similarities(words, threshold), threshold)


def clustered(words: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Members of clusters, and the edges within the threshold."""
    named = words.select("id", "word")
    edges = stored(similarity_edges(named, threshold))
    return clustering.clusters(named, edges, stored, threshold), edges


def seed_alignments(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Aligned members of each cluster with their counts and scores."""
    words = stored(words)
    members, edges = clustered(words, threshold)
    members = stored(members)
    laid = clustering.aligned(members, edges.withColumn("sim", 1 - F.col("dist")), words.select("id", "word"), stored)
    rows = laid.drop("word", "cluster").join(words, "id").join(members.select("id", "cluster", "place"), "id")
    return rows.select("cluster", "place", "id", "aligned", "word", "pos_sites", "neg_sites", "z_corrected", "z", "strand")


def seed_matrices(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """cluster, pos, A, C, G, T, letter: the weighted matrix of every cluster."""
    return composition.weighted_pfm(seed_alignments(words, threshold).withColumn("weight", F.col("z_corrected")), ["cluster"])
