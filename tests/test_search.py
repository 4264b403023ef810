"""Maxima, column ranges, weights, starting words and tiles against brute force."""

import math
import random
import time
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import em, scan, significance, tiles
from strandloom.plans import discretise, refinement, starts
from strandloom.storage import saved

EVEN = np.full(4, 0.25)


def turned(word):
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def matrix_of(word, own=0.85):
    return np.array([[own if x == y else (1 - own) / 3 for x in "ACGT"] for y in word])


def planted(n, words, seed, length=(60, 160)):
    """Random sequences, every second one with each of the words somewhere on either strand."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = [rng.choice("ACGT") for _ in range(rng.randint(*length))]
        if i % 2 == 0:
            room = len(text) // len(words)
            for k, word in enumerate(words):
                at = k * room + rng.randrange(room - len(word))
                text[at : at + len(word)] = word if rng.random() < 0.5 else turned(word)
        rows.append((i, "".join(text)))
    return rows


def window_scores(text, odds):
    w, out = len(odds), {}
    back = odds[::-1, ::-1]
    for j in range(len(text) - w + 1):
        word = text[j : j + w]
        if set(word) <= set("ACGT"):
            codes = ["ACGT".index(x) for x in word]
            one, two = (sum(m[i][c] for i, c in enumerate(codes)) for m in (odds, back))
            out[j] = (max(one, two), turned(word) if two > one + 1e-9 else word)
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    texts = ["", "ACG", "A" * 40, "N" * 30, "ACGTN" * 9, "TGACTCAT" * 5]
    return [*enumerate(texts + ["".join(rng.choice("ACGTACGTN") for _ in range(300)) for _ in range(20)]), (99, None)]


def test_maxima_and_ranked_counts(spark, odd_rows):
    model = em.Model("m", matrix_of("TGACTCAT"), EVEN, 0.01)
    odds = np.log(model.theta / EVEN)
    want = []
    for i, text in odd_rows:
        found = window_scores(text or "", odds)
        for j, (score, word) in found.items():
            near = [(found[k][0], k) for k in range(j - 7, j + 8) if k in found and k != j]
            if all(s < score if k < j else s <= score for s, k in near):
                want.append((-round(score, 9), i, j, word))
    want.sort()
    seqs = spark.createDataFrame(odd_rows, "seq_id long, seq string").repartition(3)
    ranked = discretise.ranked_counts(discretise.maxima(seqs, model), 8).orderBy("rank").collect()
    assert [(r["seq_id"], r["start"], r["word"]) for r in ranked] == [x[1:] for x in want]
    counts = np.zeros((8, 4), int)
    for r, (*_, word) in zip(ranked, want, strict=True):
        counts[np.arange(8), ["ACGT".index(x) for x in word]] += 1
        assert r["counts"] == counts.ravel().tolist()


def test_best_number_and_range_equal_direct_loops(spark):
    rows = planted(120, ["TGACTCAT"], 2)
    seqs = saved(spark.createDataFrame(rows, "seq_id long, seq string").repartition(3))
    flat = np.full((2, 4), 0.25)
    model = em.Model("m", np.vstack([flat, matrix_of("TGACTCAT"), flat[:1]]), EVEN, 0.005)
    ranked = saved(discretise.ranked_counts(discretise.maxima(seqs, model), 11))
    number_of_starts = sum(max(0, len(t) - 10) for _, t in rows)
    number, value, counts = discretise.best_number(ranked, 11, EVEN, number_of_starts, 5, 100)
    values = {}
    for r in ranked.where("rank BETWEEN 5 AND 100").collect():
        ratios = discretise.column_ratios(np.array(r["counts"], float).reshape(1, 11, 4), EVEN)[0]
        log_p = significance.log_tails(ratios, r["rank"], (0.25,) * 4).sum()
        series = math.log(math.fsum((-log_p) ** k / math.factorial(k) for k in range(11)))
        values[r["rank"]] = log_p + series + significance.total_placements(number_of_starts, r["rank"])
    assert values[number] == min(values.values()) and value == pytest.approx(values[number])

    found = discretise.discretise(seqs, model, min_sites=5, min_width=4)
    assert (found.offset, found.model.width) == (2, 8) and 54 <= found.nsites <= 75
    assert "".join("ACGT"[k] for k in found.model.theta.argmax(axis=1)) in ("TGACTCAT", turned("TGACTCAT"))
    texts = dict(rows)
    for r in found.places.collect():
        word = texts[r["seq_id"]][r["start"] : r["start"] + 8]
        assert r["word"] == (word if r["strand"] == "+" else turned(word))
    one = discretise.discretise(seqs, em.Model("m", model.theta, EVEN, 0.5, spread=em.NONE_OR_ONE), min_sites=5, min_width=4)
    assert one.model.width == 8 and one.places.groupBy("seq_id").count().where("count > 1").isEmpty()
    assert discretise.discretise(seqs.limit(0), model) is None


def test_best_number_takes_a_step_a_site(spark):
    # 5,000 perfect sites of eight columns, then random ones: 300,000 numbers of sites, each compared.
    width, most, starts = 8, 300_000, 1_000_000
    rank = np.arange(1, most + 1)
    random_ones = np.maximum(rank - 5000, 0)
    column = np.stack([np.minimum(rank, 5000) + random_ones - 3 * (random_ones // 4), *[random_ones // 4] * 3], axis=1)
    cells = F.array(*(c for _ in range(width) for c in (F.expr("least(id, 5000) + greatest(id - 5000, 0) - 3 * (greatest(id - 5000, 0) div 4)"), *[F.expr("greatest(id - 5000, 0) div 4")] * 3)))
    ranked = saved(spark.range(1, most + 1).select(F.col("id").alias("rank"), cells.alias("counts")))
    began = time.monotonic()
    number, value, counts = discretise.best_number(ranked, width, EVEN, starts, 2, None)
    assert time.monotonic() - began < 60
    ways = np.cumsum(np.log(np.floor((starts - (rank - 1.0)) * 2 / rank)))
    ratios = discretise.column_ratios(column[:, None].astype(float), EVEN)[:, 0]
    logs = np.array([significance.log_tail(ratios[k], k + 1, (0.25,) * 4) if k < 1024 and k % 93 == 0 else math.nan for k in range(1024)])
    logs = width * np.append(logs, significance.read_tails(ratios[1024:], rank[1024:], (0.25,) * 4))
    values = logs + np.log(sum((-logs) ** k / math.factorial(k) for k in range(width))) + ways
    assert number == 1 + np.nanargmin(values) and value == pytest.approx(np.nanmin(values)) and counts.tolist() == [column[number - 1].tolist()] * width
    # Few sites: the best is among those that are summed exactly.
    small = [values[k] for k in range(93, 1024, 93)]
    number, value, _ = discretise.best_number(ranked, width, EVEN, starts, 94, 1024)
    assert value <= min(small) + 1e-6 and value == pytest.approx(width * (x := significance.log_tail(ratios[number - 1], number, (0.25,) * 4)) + math.log(sum((-width * x) ** k / math.factorial(k) for k in range(width))) + ways[number - 1])


def test_placements_and_bounds():
    for starts in (10.0, 500.0, 200_000.0):
        sites = np.array([0, 1, 2, 5, 300, 65_535, 65_536, 65_537, 131_072, 140_000])
        table = np.cumsum([0.0, *(significance._log_factors(starts, b, b + significance.BLOCK, 2).sum() for b in (0, significance.BLOCK))])
        want = [significance.total_placements(starts, int(n)) for n in sites]
        assert significance.read_placements(table, starts, sites) == pytest.approx(want, nan_ok=True)
    rng, q = np.random.default_rng(3), (0.1, 0.4, 0.3, 0.2)
    counts = np.array([rng.multinomial(n, rng.dirichlet(np.full(4, 0.5))) for n in rng.integers(2, 300, 60)])
    chances, ratios = significance.log_chances(counts, q), discretise.column_ratios(counts[:, None].astype(float), np.array(q))[:, 0]
    for c, chance, ratio in zip(counts, chances, ratios, strict=True):
        direct = math.lgamma(c.sum() + 1) + sum(n * math.log(p) - math.lgamma(n + 1) for n, p in zip(c, q, strict=True))
        assert chance == pytest.approx(direct) and chance <= significance.log_tail(ratio, int(c.sum()), q) + 1e-9


def test_best_ranges_equal_all_ranges(spark):
    rng, rows, want = random.Random(6), [], {}
    for m in range(12):
        logs = [rng.choice([-5.0, -1.0, -0.1, 0.0, -30.0]) for _ in range(rng.randint(2, 9))]
        rows += [(m, j, v) for j, v in enumerate(logs)]
        best = None
        for w in range(2, len(logs) + 1):
            for off in range(len(logs) - w + 1):
                total = sum(logs[off : off + w])
                log_p = round(total + math.log(sum((-total) ** k / math.factorial(k) for k in range(w))), 9)
                if best is None or log_p < best[2]:
                    best = (off, w, log_p)
        want[m] = best
    columns = spark.createDataFrame(rows, "motif int, pos int, log_p double").repartition(3)
    got = {r["motif"]: (r["offset"], r["width"]) for r in discretise.best_ranges(columns, ["motif"], 2).collect()}
    assert got == {m: b[:2] for m, b in want.items()}


def test_weighted_step_equals_a_direct_loop(spark, odd_rows):
    rng = random.Random(2)
    model = em.Model("m", matrix_of("TGACT", 0.7), np.array([0.3, 0.2, 0.2, 0.3]), 0.1)
    rows = [(i, t, None if i == 3 else [rng.choice([0.0, 0.2, 1.0, 0.9]) for _ in t or ""]) for i, t in odd_rows]
    z_sum, motif = 0.0, np.zeros((5, 4))
    odds = np.log(model.theta / model.background)
    for _, text, weights in rows:
        for j, (score, word) in window_scores(text or "", odds).items():
            weight = min(weights[j : j + 5]) if weights else 1.0
            z = 0.0 if weight == 0 else 1 / (1 + math.exp(-(score + math.log(weight) + math.log(0.1 / 0.9))))
            z_sum += z
            motif[np.arange(5), ["ACGT".index(x) for x in word]] += z
    seqs = spark.createDataFrame(rows, "seq_id long, seq string, weights array<double>").repartition(2)
    got = em.collected(em.expected_counts(seqs, [model], weights="weights"), [model])[0]
    assert got.z == pytest.approx(z_sum) and np.allclose(got.motif, motif)
    plain = seqs.select("seq_id", "seq")
    again = scan.softly_erased(scan.softly_erased(plain, model), model).collect()
    once = {r["seq_id"]: r["weights"] for r in scan.soft_weights(plain, odds.tolist(), 0.1).collect()}
    for r in again:
        assert len(r["weights"]) == len(r["seq"] or "") and all(b <= a + 1e-12 for a, b in zip(once[r["seq_id"]], r["weights"], strict=True))


def test_overlapping_motifs_are_found_softly(spark):
    rng, rows = random.Random(9), []
    for k in range(150):
        text = [rng.choice("ACGT") for _ in range(80)]
        word = ["CACTTTGCAGAC", "GACGGTTAAGCC", "CACTTTGCAGACGGTTAAGCC"][k % 3]  # the third holds both, which overlap by three letters
        text[20 : 20 + len(word)] = word
        rows.append((k, "".join(text)))
    seqs = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    seeds = [em.Model(w, matrix_of(w, 0.7), EVEN, 0.01) for w in ("CACTTTGCAGAC", "GACGGTTAAGCC")]
    soft = refinement.discover(seqs, seeds, fit="batch", min_sites=20, iterations=10)
    assert ["".join("ACGT"[k] for k in m.model.theta.argmax(axis=1)) for m in soft.motifs] == ["CACTTTGCAGAC", "GACGGTTAAGCC"]
    assert all(m.accepted and m.sites >= 49 for m in soft.motifs) and soft.motifs[0].sites >= 98
    assert soft.positive.where(F.size("weights") != F.length("seq")).isEmpty()
    assert soft.positive.where(F.exists("weights", lambda w: w < 0.05)).count() > 140


@pytest.mark.parametrize("both", [True, False])
def test_start_words_equal_all_pairs(spark, odd_rows, both):
    counts = Counter()
    for _, text in odd_rows:
        for j in range(len(text or "") - 4):
            word = text[j : j + 5]
            if set(word) <= set("ACGT"):
                for w in {word, turned(word)} if both else {word}:
                    counts[w] += 1
    seqs = spark.createDataFrame(odd_rows, "seq_id long, seq string").repartition(3)
    got = {r["word"]: r["found"] for r in starts.matches(starts.word_counts(seqs, 5, both), 5, 2).collect()}
    want = defaultdict(lambda: [0, 0, 0])
    for a, b in product(counts, counts):
        d = sum(x != y for x, y in zip(a, b, strict=True))
        if d <= 2:
            want[a][d] += counts[b]
    assert got == dict(want)


def test_planted_word_is_the_first_start(spark):
    seqs = spark.createDataFrame(planted(200, ["GATTACAG"], 5), "seq_id long, seq string").repartition(3)
    found = starts.start_points(seqs, 8, [50, 100], keep=3).collect()
    assert {(r["nsites"], r["word"]) for r in found if r["place"] == 1} == {(n, min("GATTACAG", turned("GATTACAG"))) for n in (50, 100)}
    models = refinement.start_models(spark.createDataFrame([(found[0]["word"],)], "word string"), EVEN, 0.005)
    assert refinement.best_by_width(seqs, models, iterations=10)[8].sites >= 90


def test_letter_maps(spark):
    assert np.allclose(refinement.substitution_map(0), np.eye(4))
    for power in (1, 40, 5000):
        rows = refinement.substitution_map(power)
        assert np.allclose(rows.sum(axis=1), 1) and np.allclose(rows, rows.T)
        assert rows[0, 2] > rows[0, 1] or power == 5000
    assert np.allclose(refinement.substitution_map(5000), 0.25, atol=1e-6)
    assert np.allclose(refinement.substitution_map(7), np.linalg.matrix_power(refinement.substitution_map(1), 7))
    words = spark.createDataFrame([("ANG",)], "word string")
    for letters in (None, refinement.substitution_map(40)):
        model = refinement.start_models(words, EVEN, 0.1, letters=letters)[0]
        rows = refinement.shared_map() if letters is None else letters
        assert np.allclose(model.theta, [rows[0], EVEN, rows[2]])


def test_tiles_equal_a_greedy_pass(spark, odd_rows):
    motifs = [tiles.scored_motif(w, np.log(matrix_of(w) / 0.25), [0.25] * 4, 20) for w in ("TGACTCA", "ACGTA", "GGGC")]
    got = {r["seq_id"]: r for r in tiles.tiled(spark.createDataFrame(odd_rows, "seq_id long, seq string").repartition(3), motifs, 0.02).collect()}
    assert len(got) == len(odd_rows)
    for i, text in odd_rows:
        open_, log_p = [], []
        for m, motif in enumerate(motifs):
            scores = window_scores(text or "", motif.steps.astype(float))
            w = len(motif.steps)
            for j, (score, word) in scores.items():
                if motif.tail[int(score)] < 0.02:
                    open_.append((motif.tail[int(score)], j, m, j + w, motif.name, "-" if word != text[j : j + w] else "+"))
            if scores:
                p = motif.tail[int(max(s for s, _ in scores.values()))]
                log_p.append(math.log(-math.expm1(2 * (len(text) - w + 1) * math.log1p(-min(p, 1 - 1e-16)))))
        taken = []
        for hit in sorted(open_):
            if all(hit[3] <= t[1] or t[3] <= hit[1] for t in taken):
                taken.append(hit)
        assert [(t["start"], t["end"], t["motif"]) for t in got[i]["tiles"]] == [(t[1], t[3], t[4]) for t in sorted(taken, key=lambda t: t[1])]
        total = sum(log_p)
        assert got[i]["log_p"] == pytest.approx(total + math.log(sum((-total) ** k / math.factorial(k) for k in range(len(log_p)))) if log_p else 0.0)


@pytest.mark.parametrize("n,background", [(2, [0.25] * 4), (4, [0.4, 0.1, 0.2, 0.3])])
def test_star_tails_equal_enumeration(n, background):
    scores = np.array([[3, -1, 0, -2], [-1, 2, -2, 0], [0, -2, 4, -1], [-2, 0, -1, 3]])
    tail, low = significance.star_tail(scores, background, n, columns=2)
    mass = Counter()
    for letters in product(range(4), repeat=n):
        p = math.prod(background[x] for x in letters)
        mass[sum(int(scores[letters[0], x]) for x in letters[1:])] += p
    both = Counter()
    for (a, p), (b, q) in product(mass.items(), mass.items()):
        both[a + b] += p * q
    for s in both:
        assert tail[s - low] == pytest.approx(sum(p for x, p in both.items() if x >= s))
    assert tail[0] == pytest.approx(1)
