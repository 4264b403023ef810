"""A corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

Defined cases, for every stage: null and empty texts are scored, and are copies of each
other; they have no near copies, size 0 and no ids.  Null doc_ids stay, and lose to others where one
row of several stays.  Null sources are a source of their own.  Very long texts are one task's
work.  Repeated rows are copies.  An empty table gives an empty result.  Columns beyond those
of ``documents`` pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, mixing, ngram_join, quality_classifier, sentencepiece_lattice
from strandloom.llm.common import saved
from strandloom.llm.registry import VOCABULARIES

#: No SQL can express learned scores, seeded near-copy groups and subword ids together.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the preference-ranked classifier rejects go; without labels of both kinds all stay.  A score at the cut is kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep(docs, quality_classifier.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays; of several with that doc_id, the one whose columns hash least."""
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five-word shingles connect, the one with the least doc_id stays; of several, the one whose text and then whose columns hash least."""
    return ngram_join.deduplicate(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; a text without words as often as its source's whole part."""
    return mixing.sample(docs, max_epochs=3, seed=7)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row that is left, repeats included."""
    vocabulary = sentencepiece_lattice.Vocabulary.load(str(VOCABULARIES / "piece_bpe_32k.model"))
    encoded = sentencepiece_lattice.encode(docs, vocabulary)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = saved(docs)
    return docs
