"""Matrix transforms, priors, alignments and readers against brute force."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import alignment, clustering, composition, priors, shuffling, transforms
from strandloom.sources import fasta, motifs
from strandloom.storage import dealt, saved

MATRIX = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.25, 0.25, 0.25, 0.25], [0.1, 0.1, 0.1, 0.7], [0.4, 0.1, 0.4, 0.1]]
ODDS = [[math.log(p / 0.25) for p in row] for row in MATRIX]
EVEN = dict.fromkeys("ACGT", 0.25)


@pytest.fixture(scope="module")
def columns(spark):
    rows = [("m", k, *row) for k, row in enumerate(MATRIX)] + [("flat", k, 0.25, 0.25, 0.25, 0.25) for k in range(3)]
    return spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double")


def matrix_of(rows, motif):
    return [[r[x] for x in "ACGT"] for r in sorted((r for r in rows if r["motif"] == motif), key=lambda r: r["pos"])]


def test_transforms(spark, columns):
    keys = ["motif"]
    turned = matrix_of(transforms.reverse_complement(columns, keys).collect(), "m")
    assert np.allclose(turned, np.array(MATRIX)[::-1, ::-1])
    even = matrix_of(transforms.balanced(columns).collect(), "m")
    assert np.allclose(even, (np.array(MATRIX) + np.array(MATRIX)[:, ::-1]) / 2)
    scores = transforms.scores_of(columns, EVEN, 20, 3.0)
    assert np.allclose(matrix_of(scores.collect(), "m"), 100 * np.log2((np.array(MATRIX) * 20 + 0.75) / 23 / 0.25))
    assert np.allclose(matrix_of(transforms.frequencies_of(scores, EVEN, 20, 3.0).collect(), "m"), MATRIX)
    plain = transforms.scores_of(columns, EVEN)
    assert np.allclose(matrix_of(transforms.checked_frequencies_of(plain, EVEN).collect(), "m"), MATRIX)
    with pytest.raises(Exception, match="sum to one"):
        transforms.checked_frequencies_of(plain, dict.fromkeys("ACGT", 0.2)).collect()
    trims = {r["motif"]: (r["trim_left"], r["trim_right"]) for r in transforms.trims(columns, keys, 0.5).collect()}
    assert trims == {"m": (0, 1), "flat": (3, 0)}
    kept = transforms.trimmed(columns.where("motif = 'm' AND pos >= 2").withColumn("pos", F.col("pos") - 2), keys, 0.5).collect()
    assert np.allclose(matrix_of(kept, "m"), MATRIX[3:4])
    mean = np.mean(MATRIX, axis=0)
    want = float((np.array(MATRIX) * np.log(np.array(MATRIX) / mean)).sum(axis=1).mean())
    assert {r["motif"]: r["complexity"] for r in transforms.complexity(columns, keys).collect()} == {"m": pytest.approx(want), "flat": pytest.approx(0)}
    assert {r["motif"]: r["word"] for r in transforms.best_match(columns, keys).collect()} == {"m": "AGTTG", "flat": "TTT"}
    bits = [sum(p * math.log2(p / 0.25) for p in row) for row in MATRIX]
    for share, start in product((10, 50, 90, 100), (True, False)):
        run = np.cumsum(bits if start else bits[::-1])
        got = {r["motif"]: r["columns"] for r in transforms.information_position(columns, keys, EVEN, share, start).collect()}
        assert got["m"] == 1 + int(np.argmax(100 * run >= share * run[-1] - 1e-12))
    row = transforms.with_ambiguous(columns.where("motif = 'm' AND pos = 4")).first()
    assert row["R"] == pytest.approx(0.8) and row["N"] == pytest.approx(1) and row["B"] == pytest.approx(0.6)
    counts = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 3.0, 4.0)], "pos int, A double, C double, G double, T double, R double, N double")
    assert [transforms.shared_out(counts).first()[x] for x in "ACGT"] == [3.5, 1.0, 2.5, 1.0]
    scaled = transforms.scaled(plain, keys, 100).collect()
    odds = 100 * np.log2(np.array(MATRIX) / 0.25)
    assert np.allclose(matrix_of(scaled, "m"), np.rint((odds - odds.min()) * 100 / (odds.max() - odds.min())))
    assert {r["scale"] for r in scaled if r["motif"] == "flat"} == {0.0}
    ends = {r["motif"]: (r["least"], r["most"]) for r in transforms.score_range(plain, keys).collect()}
    assert ends["m"] == (pytest.approx(odds.min(axis=1).sum()), pytest.approx(odds.max(axis=1).sum()))


def test_correlations(spark):
    rng = np.random.default_rng(2)
    tables = {k: rng.normal(size=(w, 4)) for k, w in ((1, 4), (2, 6), (5, 3))}
    rows = [(k, p, *map(float, row)) for k, t in tables.items() for p, row in enumerate(t)]
    got = {(r["one"], r["two"]): r["correlation"] for r in transforms.correlations(spark.createDataFrame(rows, "k int, pos int, A double, C double, G double, T double"), "k").collect()}
    for one, two in ((2, 1), (5, 1), (5, 2)):
        a, b = tables[one], tables[two]
        best = max(sum(np.corrcoef(a[i], b[i - off])[0, 1] for i in range(max(0, off), min(len(a), off + len(b)))) for off in range(1 - len(b), len(a)))
        assert got[one, two] == pytest.approx(best / min(len(a), len(b)))


def test_score_tail():
    rng = np.random.default_rng(3)
    scores, q = rng.integers(0, 9, (4, 4)).tolist(), [0.4, 0.3, 0.2, 0.1]
    tail = transforms.score_tail(scores, q)
    mass = Counter()
    for word in product(range(4), repeat=4):
        mass[sum(row[x] for row, x in zip(scores, word, strict=True))] += math.prod(q[x] for x in word)
    assert all(tail[s] == pytest.approx(sum(p for t, p in mass.items() if t >= s)) for s in range(len(tail))) and tail[0] == pytest.approx(1)


def test_shuffled_matrices(spark, columns):
    own = columns.where("motif = 'm'")
    mixed = matrix_of(shuffling.shuffled_matrix(own, ["motif"], 3, "columns").collect(), "m")
    assert sorted(mixed) == sorted(MATRIX) and mixed != MATRIX
    mixed = matrix_of(shuffling.shuffled_matrix(own, ["motif"], 3, "letters").collect(), "m")
    assert [sorted(r) for r in mixed] == [sorted(r) for r in MATRIX] and mixed != MATRIX
    mixed = matrix_of(shuffling.shuffled_matrix(own, ["motif"], 3, "cells").collect(), "m")
    assert sorted(sum(mixed, [])) == sorted(sum(MATRIX, [])) and mixed != MATRIX
    noisy = np.array(matrix_of(shuffling.noisy_matrix(own, ["motif"], 0.2, 1).collect(), "m"))
    assert np.allclose(noisy.sum(axis=1), 1) and 0 < np.abs(noisy - MATRIX).max() < 0.2


LIBRARY = """Alphabet= ACGT
NumDistr= 2
Number= 0
Mixture= 0.7
B= 4.0
Alpha= 0.4 0.1 0.1 0.4
FullUpdate= 0
QUpdate= 0
StructID= one
Comment= first
Number= 1
Mixture= 0.3
B= 2.0
Alpha= 0.25 0.25 0.25 0.25
FullUpdate= 0
QUpdate= 0
StructID= two
Comment= second
"""


def test_mixture_priors(spark, tmp_path):
    open(tmp_path / "lib", "w").write(LIBRARY)
    library = priors.read_library(spark, str(tmp_path / "lib"))
    rows = sorted(library.collect(), key=lambda r: r["component"])
    assert [(r["alphabet"], r["mixture"], r["strength"]) for r in rows] == [("ACGT", 0.7, 4.0), ("ACGT", 0.3, 2.0)] and rows[0]["alpha"] == pytest.approx([1.6, 0.4, 0.4, 1.6])
    scaled = priors.read_library(spark, str(tmp_path / "lib"), 6.8).collect()
    assert sum(r["mixture"] * r["strength"] for r in scaled) == pytest.approx(6.8)
    counts = spark.createDataFrame([(0, 9, 0, 1, 2), (1, 0, 0, 0, 0)], "pos int, A long, C long, G long, T long")
    got = {r["pos"]: [r[x] for x in "ACGT"] for r in priors.pseudo_counts(counts, [], library).collect()}
    for pos, y in ((0, (9, 0, 1, 2)), (1, (0, 0, 0, 0))):
        weights = []
        for r in rows:
            a = r["alpha"]
            ll = math.lgamma(sum(y) + 1) + math.lgamma(sum(a)) - math.lgamma(sum(y) + sum(a)) + sum(math.lgamma(k + x) - math.lgamma(k + 1) - math.lgamma(x) for k, x in zip(y, a, strict=True))
            weights.append(r["mixture"] * math.exp(ll))
        want = np.array(weights) @ np.array([r["alpha"] for r in rows]) / sum(weights)
        assert got[pos] == pytest.approx(want.tolist())


def score_of(text, places, opening, extending, free_ends):
    """Score of an alignment from its definition: matches, runs of columns without a place, runs of letters between placed ones."""
    total, last, missing, started = 0.0, -1, 0, False
    for row, p in zip(ODDS, places, strict=True):
        if p < 0:
            total -= extending + (opening if not missing else 0)
            missing += 1
            continue
        skipped = p - last - 1
        if skipped and (started or not free_ends):
            total -= opening + extending * skipped
        total += row["ACGT".index(text[p])] if text[p] != "N" else 0.0
        last, missing, started = p, 0, True
    rest = len(text) - last - 1
    return total - (opening + extending * rest if rest and not free_ends else 0)


@pytest.mark.parametrize("free_ends", [True, False])
def test_alignment_places(spark, free_ends):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGTACGTN") for _ in range(n)) for n in (1, 3, 5, 6, 8, 12, 20)] * 4
    code = {x: k for k, x in enumerate("ACGTN")}
    own = np.hstack([np.array(ODDS), np.zeros((5, 1))])
    for text in texts:
        numbers = np.array([code[x] for x in text])
        for opening, extending in ((1.0, 0.4), (0.2, 0.1), (4.0, 2.0)):
            score, places = alignment.alignment_places(numbers, own, opening, extending, free_ends)
            assert score == pytest.approx(alignment.alignment_score(numbers, own, opening, extending, free_ends))
            placed = [p for p in places if p >= 0]
            assert placed == sorted(set(placed))
            assert score_of(text, places, opening, extending, free_ends) == pytest.approx(score)
    frame = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string").repartition(3)
    assert alignment.alignments(frame, ODDS, free_ends=free_ends).count() == len(texts)


def test_star_alignment(spark):
    word = "ACGTTGCA"
    matrix = [[math.log((0.91 if x == y else 0.03) / 0.25) for x in "ACGT"] for y in word]
    texts = [(0, "TTACGTTGCAGG"), (1, "ACGAATTGCA"), (2, "CCACGTGCA"), (3, "ACGATTGCAT")]
    rows = {r["seq_id"]: r["row"] for r in alignment.star_alignment(spark.createDataFrame(texts, "seq_id int, seq string"), matrix, opening=1.0, extending=0.5).collect()}
    assert len({len(r) for r in rows.values()}) == 1
    assert rows[0].replace(" ", "") == "ACGTTGCA" and rows[1].replace(" ", "") == "ACGAATTGCA" and rows[2].replace(" ", "") == "ACGTGCA" and rows[3].replace(" ", "") == "ACGATTGCA"
    assert rows[0] == "ACG  TTGCA" and rows[1] == "ACGAATTGCA" and rows[3] in ("ACG ATTGCA", "ACGA TTGCA")
    frame = spark.createDataFrame(texts, "seq_id int, seq string")
    gaps, offset, width = alignment.longest_alignment(frame, matrix, 3, opening=1.0, extending=0.5)
    assert (gaps, offset, width) in ((0, 4, 4), (0, 5, 3), (0, 0, 3))
    assert alignment.longest_alignment(frame, matrix, 8, opening=1.0, extending=0.5)[2] >= 8


def test_members_lie_on_the_nearest_earlier_one(spark):
    words = spark.createDataFrame([(0, "AAAACCCC"), (1, "AACCCCGG"), (2, "CCCCGGTT"), (3, "CCGGTTTT")], "id long, word string")
    edges = spark.createDataFrame([(0, 1, 0.8, "+", 2), (0, 2, 0.9, "+", 5), (1, 2, 0.7, "+", 2), (2, 3, 0.7, "+", 2)], "id_a long, id_b long, sim double, strand string, off int")
    members = spark.createDataFrame([(k, 1, k + 1, 4) for k in range(4)], "id long, cluster int, place int, size int")
    laid = {r["id"]: r["shift"] for r in clustering.aligned(members, edges, words, saved).collect()}
    assert laid == {0: 0, 1: 2, 2: 4, 3: 6}  # the edge from 0 to 2 says 5, but 1 is nearer in the cluster
    late = spark.createDataFrame([(0, 1, 1, 4), (3, 1, 2, 4), (1, 1, 3, 4), (2, 1, 4, 4)], "id long, cluster int, place int, size int")
    assert {r["id"]: r["shift"] for r in clustering.aligned(late, edges, words, saved).collect()}[1] == 2


def test_ambiguous_codons(spark):
    cases = {"ATG": "M", "TGR": "X", "CTN": "L", "TAR": "_", "NNN": "X", "RAY": "X", "AT1": None, "YTR": "L"}
    frame = spark.createDataFrame([(c,) for c in cases], "codon string")
    assert {r["codon"]: r["a"] for r in frame.select("codon", S.ambiguous_amino_acid(F.col("codon")).alias("a")).collect()} == cases


def test_tuples_with_x_and_checks(spark):
    p = {"".join(t): 0.25 if len(t) == 1 else 1 / 16 for n in (1, 2) for t in product("ACGT", repeat=n)}
    rows = spark.createDataFrame(list(p.items()), "tuple string, prob double")
    got = {r["tuple"]: r["prob"] for r in composition.x_tuples(rows).collect()}
    assert len(got) == 5 + 25 and got["X"] == pytest.approx(1) and got["AX"] == pytest.approx(0.25) and got["XX"] == pytest.approx(1)
    assert composition.checked_tuples(rows, 1).count() == 20
    for bad in (rows.where("tuple != 'AA'"), rows.withColumn("prob", F.when(F.col("tuple") == "A", 0.0).otherwise(F.col("prob"))), rows.where("length(tuple) = 1")):
        with pytest.raises(Exception, match="tuples are missing"):
            composition.checked_tuples(bad, 1).collect()
    with pytest.raises(Exception, match="another length"):
        composition.count_matrix(spark.createDataFrame([("ACG",), ("AC",)], "word string"), [], 3).collect()


def test_readers_of_numbers(spark, tmp_path):
    open(tmp_path / "words", "w").write("one two\n\n  three\tfour five\n")
    rows = motifs.read_tokens(spark, str(tmp_path / "words")).orderBy("line", "place").collect()
    assert [(r["place"], r["token"]) for r in rows] == [(0, "one"), (1, "two"), (0, "three"), (1, "four"), (2, "five")]
    open(tmp_path / "matrix", "w").write("# a matrix\n1 2.5 -3e1\n\n4 5 6\n")
    assert [r["values"] for r in motifs.read_matrix(spark, str(tmp_path / "matrix")).orderBy("row").collect()] == [[1.0, 2.5, -30.0], [4.0, 5.0, 6.0]]
    open(tmp_path / "odds", "w").write("log-odds matrix: alength= 4 w= 2\n1 2 3 4\n-1 -2 -3 -4\n\nlog-odds matrix: alength= 4 w= 1\n5 6 7 8\n")
    got = motifs.read_log_odds(spark, str(tmp_path / "odds")).orderBy("motif", "pos").collect()
    assert [(r["w"], r["pos"], r["A"], r["T"]) for r in got] == [(2, 0, 1.0, 4.0), (2, 1, -1.0, -4.0), (1, 0, 5.0, 8.0)]
    assert sum(r["p"] for r in motifs.built_in_background(spark, "database", "ACDEFGHIKLMNPQRSTVWY").collect()) == pytest.approx(1, abs=1e-5)
    assert [r["p"] for r in motifs.built_in_background(spark).collect()] == [0.25] * 4
    with pytest.raises(Exception, match="no probability"):
        motifs.checked_background(spark.createDataFrame([("A", 1.5)], "tuple string, p double")).collect()


def test_motif_file_round_trip(spark, columns, tmp_path):
    pfm = columns.withColumns({"alt": F.upper("motif"), "nsites": F.lit(7).cast("long"), "log_evalue": F.lit(-20.0)})
    motifs.write_motif_file(pfm, str(tmp_path / "out"), {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3})
    back = motifs.read_motif_file(spark, str(tmp_path / "out"))
    assert np.allclose(matrix_of(back.collect(), "m"), MATRIX) and {r["nsites"] for r in back.collect()} == {7}
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "A 0.30000 C 0.20000" in text and text.count("MOTIF ") == 2


def test_loading_a_data_set(spark, tmp_path):
    open(tmp_path / "in.fa", "w").write(">WEIGHTS 0.5 0.25 1.0\n>a\nACGT\n>b\nAC\n>a\nGG\n>c\nTT\n")
    loaded = fasta.load(fasta.read_fasta(spark, str(tmp_path / "in.fa")), "ACGT")
    assert {r["name"]: (r["seq"], r["weight"]) for r in loaded.collect()} == {"a": ("ACGT", 0.5), "b": ("AC", 0.25), "c": ("TT", 1.0)}
    many = spark.range(4000).withColumnRenamed("id", "seq_id")
    one = fasta.sampled(many, 0.3, seed=1)
    assert abs(one.count() - 1200) < 120 and one.exceptAll(fasta.sampled(many.repartition(7), 0.3, seed=1)).count() == 0
    open(tmp_path / "empty.fa", "w").write(">a\n>b\nAC\n")
    with pytest.raises(Exception, match="empty sequence"):
        fasta.load(fasta.read_fasta(spark, str(tmp_path / "empty.fa"))).collect()
    fasta.write_masked(spark.createDataFrame([(0, "ACNN")], "seq_id long, seq string"), spark.createDataFrame([(4, "GG")], "seq_id long, seq string"), str(tmp_path / "masked"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "masked/negative")).collect()] == [">sequence5", "GG"]


def test_rows_are_dealt_only_if_they_lie_in_few_parts(spark):
    assert dealt(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(64)
    assert dealt(wide, "id") is wide


def test_aligned_sites(spark, tmp_path):
    open(tmp_path / "ace", "w").write("Motif 1\nACGT 0 1\nACGA 2 5\n** *\nMAP 3\n\nMotif 2\nTTTT 0 1\n****\n")
    for motif, want in ((1, ["ACGT", "ACGA"]), (2, ["TTTT"])):
        assert [r["site"] for r in motifs.read_aligned_sites(spark, str(tmp_path / "ace"), motif).orderBy("place").collect()] == want
