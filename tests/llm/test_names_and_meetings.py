"""Columns of any name pass the pipeline's stages unchanged; short texts of a common part don't all meet."""

import random
import re
from pathlib import Path

import pytest
from conftest_llm import SCHEMA, TEXTS, rows_of
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, mixing, ngram_join, quality_classifier

FOLDER = Path(ngram_join.__file__).parent
MODULES = ("common", "components", "exact_dedup", "mixing", "ngram_join", "quality_classifier", "features")


def internal_names():
    """Every name that the stages' modules give to a column."""
    text = "".join((FOLDER / f"{m}.py").read_text() for m in MODULES)
    found = set(re.findall(r"(?:alias|withColumn|withColumnRenamed)\(\s*\"(\w+)\"", text)) | set(re.findall(r"\"(__\w+)\"", text)) | {"row", "doc", "hash", "upto___one"}
    return sorted(found - {c.split()[0] for c in SCHEMA.split(", ")} - {"text"})


def test_columns_of_every_internal_name_pass(spark):
    names = internal_names()
    assert {"__key", "__rank", "__times", "__source", "__digest", "__doc", "__from"} - set(names) <= {"__digest", "__doc"}
    docs = spark.createDataFrame(rows_of(TEXTS), SCHEMA).select("*", *(F.lit(7).alias(n) for n in (*names, "__digest", "__doc", "a.b")))
    docs = docs.repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    model = quality_classifier.fit(*quality_classifier.training_sample(docs, docs.limit(0).selectExpr("doc_id", "1 AS quality"), "quality", 10))
    for out in (quality_classifier.keep(docs, model), exact_dedup.deduplicate(docs), ngram_join.deduplicate(docs), mixing.sample(docs, 3, 7)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == 7 for r in rows for n in (*names, "__digest", "__doc", "a.b"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def with_common_tail(spark, n):
    rng = random.Random(n)
    tail = "and so they all went home"
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3)) + " " + tail) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("n", [1000, 4000])
def test_short_texts_of_a_common_tail_do_not_meet(spark, monkeypatch, n):
    met = []
    meetings = ngram_join._meetings

    def counted(*args):
        out = meetings(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_meetings", counted)
    found = ngram_join.join(with_common_tail(spark, n), k=3, percent=90)
    assert found.where("component_id != doc_id").isEmpty()
    assert sum(met) <= n // 100


def jaccard_components(texts, k, percent):
    sets = []
    for text in texts:
        words = text.split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k,percent,partners", [(3, 90, 64), (1, 60, 2), (5, 80, 1), (2, 100, 64)])
def test_join_equals_all_pairs(spark, monkeypatch, k, percent, partners):
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    rng, texts = random.Random(percent), []
    for _ in range(60):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words))
            if words:
                words = list(words)
                words[rng.randrange(len(words))] = "changed" + rng.choice("xyz")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(rows, k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_components(texts, k, percent)
