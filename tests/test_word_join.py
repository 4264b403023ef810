"""The lossless join of words against all pairs."""

import random

import pytest

from strandloom.operators import clustering


def words_of(kind, n=150):
    rng = random.Random(n)
    letters = "ACGTRYKMSWBDHV" if kind == "ambiguous" else "ACGT"
    cores = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(12)]
    out = []
    for _ in range(n):
        core = list(rng.choice(cores))
        for _ in range(rng.randint(0, 2)):
            core[rng.randrange(8)] = rng.choice(letters)
        gap = rng.choice([0, 0, 1, 2, 5]) if kind == "gapped" else 0
        out.append("".join(core[:4]) + "N" * gap + "".join(core[4:]) if gap else "".join(core)[rng.randint(0, 1) :])
    return list(enumerate(out))


@pytest.mark.parametrize("kind", ["plain", "gapped", "ambiguous"])
@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.5])
def test_no_near_pair_is_missed(spark, kind, threshold):
    rows = words_of(kind)
    words = spark.createDataFrame(rows, "id long, word string")
    pairs = words.selectExpr("id AS id_a").join(words.selectExpr("id AS id_b")).where("id_a < id_b")
    want = {(r["id_a"], r["id_b"]): (r["sim"], r["strand"], r["off"]) for r in clustering.similarities(words, pairs).collect() if r["sim"] >= 1 - threshold - 1e-6}
    got = {(r["id_a"], r["id_b"]): (r["sim"], r["strand"], r["off"]) for r in clustering.near_similarities(words, threshold).collect()}
    assert got == want and want
    met = clustering.candidate_pairs(words, threshold)
    if kind == "plain" and threshold == 0.15:
        assert met.count() < len(rows) * (len(rows) - 1) / 6  # far fewer are compared than all pairs


def test_words_that_need_share_nothing_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 20)
    words = spark.createDataFrame(words_of("ambiguous", 60), "id long, word string")
    assert clustering.candidate_pairs(words, 0.95) is None
    pairs = words.selectExpr("id AS id_a").join(words.selectExpr("id AS id_b")).where("id_a < id_b")
    want = {(r["id_a"], r["id_b"]) for r in clustering.similarities(words, pairs).collect() if r["sim"] >= 0.05 - 1e-6}
    assert {(r["id_a"], r["id_b"]) for r in clustering.near_similarities(words, 0.95).collect()} == want
    assert clustering.near_similarities(words.limit(0)).collect() == []
