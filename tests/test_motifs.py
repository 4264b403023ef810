"""Scans, EM, significance, clusters and streams against brute force."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import clustering, em, scan, significance
from strandloom.plans import refinement, seeds
from strandloom.storage import saved
from strandloom.streaming import words as streaming

MATRIX = [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.1, 0.1, 0.1, 0.7], [0.4, 0.1, 0.4, 0.1]]
ODDS = [[math.log(p / 0.25) for p in row] for row in MATRIX]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return ["", "AGT", "AGTAAGTA", "N" * 9, *("".join(rng.choice("ACGTACGTACGTN") for _ in range(n)) for n in (20, 60, 300, 700))]


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "seq_id long, seq string").repartition(3)


def scores(text):
    for i in range(len(text) - 3):
        word = text[i : i + 4]
        if "N" not in word:
            other = word[::-1].translate(str.maketrans("ACGT", "TGCA"))
            one, two = (sum(ODDS[j]["ACGT".index(x)] for j, x in enumerate(w)) for w in (word, other))
            yield i, "-" if two > one + 1e-9 else "+", max(one, two)


def greedy(starts, width=4):
    kept = []
    for s in sorted(starts):
        if not kept or s >= kept[-1] + width:
            kept.append(s)
    return kept


def test_hits_and_erasing(seqs, texts):
    want = {(k, i, s): v for k, t in enumerate(texts) for i, s, v in scores(t) if v > 1.5}
    got = {(r["seq_id"], r["start"], r["strand"]): r["score"] for r in scan.hits(seqs, ODDS, 1.5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    best = {r["seq_id"]: r["score"] for r in scan.best_scores(seqs, ODDS).collect()}
    assert best == {k: pytest.approx(max(v for *_, v in scores(t))) for k, t in enumerate(texts) if list(scores(t))}
    rate = 1 / (1 + math.exp(1.5))  # whose threshold is 1.5
    masked = {r["seq_id"]: (r["seq"], r["erased"]) for r in scan.erased(seqs, ODDS, rate).collect()}
    apart = Counter((r["seq_id"], r["start"]) for r in scan.hits(seqs, ODDS, 1.5, apart=True).collect())
    assert apart == Counter((k, s) for k in range(len(texts)) for s in greedy(i for j, i, _ in want if j == k))
    for k, t in enumerate(texts):
        starts = greedy(i for j, i, _ in want if j == k)
        for s in starts:
            t = t[:s] + "NNNN" + t[s + 4 :]
        assert masked[k] == (t, len(starts))
    assert masked[99] == (None, 0)


def test_greedy_erase_example():
    assert scan.greedy(np.array([1, 2, 5, 6, 7]), 3).tolist() == [1, 5]
    began = time.time()
    assert len(scan.greedy(np.arange(400_000), 8)) == 50_000 and time.time() - began < 2


def test_site_words(seqs, texts):
    for r in scan.hits(seqs, ODDS, 1.5, words=True, flank=3).collect():
        t, i = texts[r["seq_id"]], r["start"]
        word, left, right = t[i : i + 4], t[max(0, i - 3) : i], t[i + 4 : i + 7]
        if r["strand"] == "-":
            table = str.maketrans("ACGT", "TGCA")
            word, left, right = (x[::-1].translate(table) for x in (word, right, left))
        assert (r["word"], r["left"], r["right"]) == (word, left, right)


def test_soft_erasing(seqs, texts):
    model = em.Model("m", np.array(MATRIX), np.full(4, 0.25), 0.05)
    want = {k: [1.0] * len(t) for k, t in enumerate(texts)} | {99: []}
    for k, t in enumerate(texts):
        for i, _, v in scores(t):
            z = 1 / (1 + math.exp(-(v + math.log(0.05 / 0.95))))
            for p in range(i, i + 4):
                want[k][p] = min(want[k][p], 1 - z)
    got = {r["seq_id"]: r["weights"] for r in refinement.erase_softly(seqs, model).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_expected_counts(seqs, texts):
    model = em.Model("m", np.array(MATRIX), np.full(4, 0.25), 0.05)
    motif, z_sum, n = np.zeros((4, 4)), 0.0, 0
    for t in texts:
        for i, strand, v in scores(t):
            z = 1 / (1 + math.exp(-(v + math.log(0.05 / 0.95))))
            word = t[i : i + 4] if strand == "+" else t[i : i + 4][::-1].translate(str.maketrans("ACGT", "TGCA"))
            for j, x in enumerate(word):
                motif[j, "ACGT".index(x)] += z
            z_sum, n = z_sum + z, n + 1
    found = em.collected(em.expected_counts(seqs, [model, model]), [model, model])
    for k in (0, 1):
        assert np.allclose(found[k].motif, motif) and found[k].z == pytest.approx(z_sum) and found[k].windows == n


@pytest.mark.parametrize("spread", [em.NONE_OR_ONE, em.ONE])
def test_expected_counts_of_one_site_a_sequence(seqs, texts, spread):
    model = em.Model("m", np.array(MATRIX), np.full(4, 0.25), 0.3, spread=spread)
    motif, z_sum, n, log_likelihood = np.zeros((4, 4)), 0.0, 0, 0.0
    for t in texts:
        found = list(scores(t))
        if not found:
            continue
        n += 1
        ratio = [math.exp(v) / len(found) for *_, v in found]
        total = sum(ratio) if spread == em.ONE else 0.7 + 0.3 * sum(ratio)
        log_likelihood += math.log(total)
        for (i, strand, _), r in zip(found, ratio, strict=True):
            z = r / total * (1 if spread == em.ONE else 0.3)
            word = t[i : i + 4] if strand == "+" else t[i : i + 4][::-1].translate(str.maketrans("ACGT", "TGCA"))
            for j, x in enumerate(word):
                motif[j, "ACGT".index(x)] += z
            z_sum += z
    sums = em.collected(em.expected_counts(seqs, [model]), [model])[0]
    assert np.allclose(sums.motif, motif) and sums.z == pytest.approx(z_sum) and sums.sequences == n and sums.log_likelihood == pytest.approx(log_likelihood)
    assert em.maximised(model, sums).rate == pytest.approx(min(z_sum / n, 1 - 1e-12))


def test_steps_in_closed_form():
    for step, slope, begin, count in ((0.05, -0.6, 0, 10), (0.5, -0.6, 0, 3_000_000), (20.0, -0.8, 5, 400_000), (0.05, -0.9, 250_000, 2_000_000), (0.3, -0.6, 99_990, 20)):
        n = np.arange(begin + 1, begin + count + 1, dtype=float)
        assert em.log_left(step, slope, begin, count) == pytest.approx(np.log1p(-np.minimum(step * n**slope, 0.999)).sum(), rel=1e-9)
    assert math.isfinite(em.log_left(0.05, -0.6, 0, 10**15))


def planted(spark, letters="TGACGTCA", sequences=160):
    rng = random.Random(1)
    rows = []
    for k in range(sequences):
        text = [rng.choice("ACGT") for _ in range(120)]
        at = rng.randrange(0, 110)
        text[at : at + 8] = [x if rng.random() < 0.95 else rng.choice("ACGT") for x in letters]
        rows.append((k, "".join(text)))
    return spark.createDataFrame(rows, "seq_id long, seq string").repartition(4)


@pytest.mark.parametrize("fit", ["batch", "online"])
def test_em_recovers_a_planted_motif(spark, fit):
    seqs = planted(spark)
    theta = np.array([[0.55 if x == y else 0.15 for x in "ACGT"] for y in "TGACGTCA"])
    start = em.Model("m", theta, np.full(4, 0.25), 0.01)
    done = (em.batch_em(seqs, [start], iterations=15) if fit == "batch" else em.online_em(seqs, [start], passes=4, batches=4))[0]
    assert "".join("ACGT"[k] for k in done.theta.argmax(axis=1)) == "TGACGTCA"
    assert done.theta.max(axis=1).min() > 0.7 and np.allclose(done.theta.sum(axis=1), 1) and np.isclose(done.background.sum(), 1)


def test_batch_em_takes_one_pass(spark):
    seqs, reads = planted(spark, sequences=60), spark.sparkContext.accumulator(0)
    texts = ["", "ACG", "N" * 20, "ACGTN" * 9, "TGACGTCA" * 6, None]
    seqs = seqs.unionByName(spark.createDataFrame([(900 + k, x) for k, x in enumerate(texts)], "seq_id long, seq string"))

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    theta = np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in "TGACGTCA"])
    skewed = np.array([0.3, 0.2, 0.1, 0.4])
    models = [em.Model("m", theta, np.full(4, 0.25), 0.01), em.Model("short", theta[2:6], skewed, 0.05, bias=1.5), em.Model("one", theta, skewed, 0.4, spread=em.NONE_OR_ONE), em.Model("long", np.vstack([theta, theta[:4]]), skewed, 0.01)]
    for both in (True, False):
        # A pass an iteration, by hand.
        want = []
        for now in models:
            rested = False
            for _ in range(4):
                after = em.maximised(now, em.collected(em.expected_counts(seqs, [now], both), [now])[0])
                moved, now = np.linalg.norm(after.theta - now.theta) >= 1e-3, after
                if not moved:
                    rested = True
                    break
            want.append((now, rested))
        for got, (model, rested) in zip(em.batch_em(seqs, models, iterations=4, both_strands=both), want, strict=True):
            assert (got.name, got.spread, got.bias, got.rested) == (model.name, model.spread, model.bias, rested)
            assert np.allclose(got.theta, model.theta, atol=1e-9) and np.allclose(got.background, model.background, atol=1e-9)
            assert got.rate == pytest.approx(model.rate) and got.density == pytest.approx(model.density)
    for model in models[:2]:
        counts = em.packed_counts(seqs, [model.width]).collect()
        packed, count = (np.array([r[c] for r in counts]) for c in ("packed", "cnt"))
        sums = em.words_expected(np.stack([packed >> 2 * (model.width - 1 - j) & 3 for j in range(model.width)]), count, model)
        direct = em.collected(em.expected_counts(seqs, [model]), [model])[0]
        assert (sums.windows, sums.sites) == (direct.windows, direct.sites) and sums.log_likelihood == pytest.approx(direct.log_likelihood) and np.allclose(sums.other, direct.other)
    em.batch_em(seqs.mapInArrow(counted, seqs.schema), models[:2])
    assert reads.value == 66
    none = em.batch_em(seqs.limit(0), models[:1])[0]
    assert none.rested and np.array_equal(none.theta, theta)


def test_em_says_whether_it_rests(spark):
    seqs = planted(spark, sequences=40)
    theta = np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in "TGACGTCA"])
    start = em.Model("m", theta, np.full(4, 0.25), 0.01)
    assert not em.batch_em(seqs, [start], iterations=1)[0].rested and em.batch_em(seqs, [start])[0].rested
    assert not em.online_em(seqs, [start], passes=1, batches=2)[0].rested


def test_refinement(spark):
    seqs = planted(spark, sequences=60)
    theta = np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in "TGACGTCA"])
    found = refinement.refine(seqs, [em.Model("m", theta, refinement.background(seqs), 0.01)], min_sites=20, max_sites=400, tries=2, passes=2, batches=2)
    assert found[0].accepted and 20 <= found[0].sites <= 400
    assert refinement.erase(seqs, found[0].model).agg(F.sum("erased")).first()[0] > 20


def test_the_best_try_has_the_least_log_evalue(spark, monkeypatch):
    seqs = planted(spark, sequences=60)
    theta = np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in "TGACGTCA"])
    start = em.Model("m", theta, refinement.background(seqs), 0.01)
    values = iter([5.0, -3.0, -3.0, 4.0])
    monkeypatch.setattr(refinement, "log_evalues", lambda seqs, models, sites: [next(values) for _ in models])
    found = refinement.refine(seqs, [start], min_sites=1, max_sites=10_000, tries=4, stop_early=False, passes=1, batches=2)
    assert found[0].log_evalue == -3.0 and found[0].try_number == 1 and found[0].accepted
    monkeypatch.setattr(refinement, "log_evalues", lambda *a: [])
    none = refinement.refine(seqs, [start], min_sites=10**6, max_sites=10**7, tries=2, passes=1, batches=2)
    assert not none[0].accepted and none[0].log_evalue == math.inf and none[0].try_number == 1


def test_log_ways(spark, seqs, texts):
    lengths = sorted((len(t) - 3 for t in texts if len(t) > 3), reverse=True)
    want = sum(math.log(2 * n) for n in lengths[:3]) + math.log(math.comb(len(lengths), 3))
    assert significance.log_ways(seqs, 4, 3, em.NONE_OR_ONE) == pytest.approx(want)
    assert significance.log_ways(seqs, 4, 100, em.ONE) == -math.inf
    starts = sum(lengths)
    assert significance.log_ways(seqs, 4, 5) == pytest.approx(sum(math.log((starts - i) * 2 // (i + 1)) for i in range(5)))


@pytest.mark.parametrize("fit", ["online", "batch"])
def test_motifs_are_found_one_after_another(spark, fit):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        text = [rng.choice("ACGT") for _ in range(100)]
        for word, at in (("CACTTTGCAGAC", 20), ("GGGATAAGCCTA", 70)):
            text[at : at + len(word)] = [x if rng.random() < 0.95 else rng.choice("ACGT") for x in word]
        rows.append((k, "".join(text)))
    positive = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    negative = spark.createDataFrame([(k, "".join(rng.choice("ACGT") for _ in range(150))) for k in range(60)], "seq_id long, seq string")

    def seed(word, name):
        return em.Model(name, np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in word]), np.full(4, 0.25), *((0.005,) if fit == "online" else (0.5, 1.0, False, em.NONE_OR_ONE)))

    seeds_ = [seed("CACTTTGCAGAC", "one"), seed("GGGATAAGCCTA", "two")]
    options = {"min_sites": 40, "max_sites": 2000, "tries": 2, "passes": 2, "batches": 2} if fit == "online" else {"min_sites": 40, "iterations": 10, "erasing": "hard"}
    found = refinement.discover(positive, seeds_, negative, fit=fit, **options)
    assert [m.model.name for m in found.motifs] == ["one", "two"] and found.reason == "seeds are used up"
    assert all(m.accepted and m.log_evalue < 0 and m.erased[0] > 100 > m.erased[1] for m in found.motifs)
    assert ["".join("ACGT"[k] for k in m.model.theta.argmax(axis=1)) for m in found.motifs] == ["CACTTTGCAGAC", "GGGATAAGCCTA"]
    assert found.positive.where(F.contains("seq", F.lit("N" * 12))).count() > 100 and found.negative.count() == 60
    table = refinement.motif_table(spark, found.motifs)
    assert table.count() == 24 and refinement.discover(positive, seeds_[:1], most=0, fit="batch").reason == "enough motifs"


def test_divergence():
    assert em.divergence(np.array([0.7, 0.1, 0.1, 0.1]), np.full(4, 0.25)) == pytest.approx(0.437829784)


def exact_tail(n, background):
    """Ratios (falling) and log tails over all counts of n letters, without a scale."""
    c = np.stack(np.meshgrid(*[np.arange(n + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    c = c[c.sum(axis=1) <= n]
    c = np.column_stack([c, n - c.sum(axis=1)])
    ratio = (c * np.log(np.maximum(c, 1) / (n * np.array(background)))).sum(axis=1)
    factorial = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    order = np.argsort(-ratio)
    return ratio[order], np.logaddexp.accumulate((factorial[n] + (c * np.log(background) - factorial[c]).sum(axis=1))[order])


@pytest.mark.parametrize("background", [(0.25,) * 4, (0.4, 0.3, 0.2, 0.1)])
def test_tails_equal_sums_over_all_counts(background):
    for n in (1, 2, 5, 40):
        ratios, tails = exact_tail(n, background)
        last = np.append(ratios[1:] < ratios[:-1] - 1e-7, True)  # of equal ratios all count
        got = significance.summed_tails(ratios[last], n, background)
        assert np.abs(got - np.minimum(tails[last], 0)).max() < 1e-9
        mean = float((ratios * np.exp(tails)).sum() - (ratios[1:] * np.exp(tails[:-1])).sum())
        assert significance.mean_ratio(n, background) == pytest.approx(mean)


@pytest.mark.parametrize("background", [(0.25,) * 4, (0.4, 0.3, 0.2, 0.1)])
def test_tails_have_no_step_at_any_number_of_sites(background):
    share = np.array([0.001, 0.01, 0.1, 0.4, 0.9])
    for n in (500, significance.LARGEST - 1, significance.LARGEST, significance.LARGEST + 1, 10_000, 100_000):
        here, there = (significance.log_tails(share * k, k, background) for k in (n, n + 1))
        # A site of the same letters is worth its ratio; near the largest ratio the counts themselves leave steps.
        assert (np.abs(there - here + share) < [0.02, 0.02, 0.02, 0.02, 0.2]).all()
    # Beyond the largest sum, against the sum itself: hundredths of a unit of thousands.
    for n in (3000, 5000):
        off = significance.log_tails(share * n, n, background) - significance.summed_tails(share * n, n, background)
        assert np.abs(off).max() < 0.12
    ratios, sites = np.array([5.0, 50.0, 200.0, 900.0]), np.array([100, 300, 1000, 20_000])
    exact = [significance.log_tail(r, n, background) for r, n in zip(ratios, sites, strict=True)]
    assert np.abs(significance.read_tails(ratios, sites, background) - exact).max() < 0.2


def test_significance_counts_all_sites(spark):
    rows = [(m, pos, 0.7, 0.1, 0.1, 0.1, n) for m, n in (("few", 150), ("many", 400), ("most", 3_000_000)) for pos in range(4)]
    columns = spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double, nsites long")
    got = {r["motif"]: r for r in significance.motif_significance(columns, ["motif"], dict.fromkeys("ACGT", 0.25), F.lit(10_000_000)).collect()}
    ratio = {m: r["llr"] / r["nsites"] for m, r in got.items()}
    assert ratio["many"] == pytest.approx(ratio["few"]) and ratio["most"] == pytest.approx(ratio["few"])
    for m, n in (("few", 150), ("many", 400), ("most", 3_000_000)):
        i = np.arange(n)
        ways = np.log((10_000_000 - i) * 2 // (i + 1)).sum()
        p = 4 * significance.log_tail(got[m]["llr"] / 4, n, (0.25,) * 4)
        assert got[m]["log_evalue"] == pytest.approx(ways + p + math.log(sum((-p) ** k / math.factorial(k) for k in range(4))))


def test_query_of_significance_counts_all_hits(spark):
    from strandloom import queries

    folder = "/root/testdata/sf0.1"
    hits = queries.hit_words(spark, folder).count()
    assert hits > 200 and queries.motif_significance(spark, folder).first()["nsites"] == hits


def test_roc(spark):
    rows = [(3.0, True), (2.0, True), (2.0, False), (1.0, False), (0.5, True), (0.0, False)]
    got = scan.roc(spark.createDataFrame(rows, "score double, positive boolean")).first()
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    tp, area = 0, 0
    for _, positive in order:
        tp += positive
        area += 0 if positive else tp
    assert got["auc"] == pytest.approx(area / 9) and got["err"] == 2
    apart = scan.roc(spark.createDataFrame([(3.0, True), (1.0, False)], "score double, positive boolean")).first()
    assert (apart["auc"], apart["threshold"], apart["err"]) == (3.0, 2.0, 0)


def correlation(a, b):
    def column(x):
        p = [(float(y in clustering.IUPAC[x]) / len(clustering.IUPAC[x]) + 0.01) / 1.04 for y in "ACGT"]
        p = np.array(p) - np.mean(p)
        return p / np.linalg.norm(p) if np.linalg.norm(p) > 1e-9 else np.zeros(4)

    return float(column(a) @ column(b))


def test_similarities(spark):
    rng = random.Random(5)
    words = [(k, "".join(rng.choice("ACGTN") for _ in range(rng.choice((5, 6, 8))))) for k in range(12)]
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    frame = spark.createDataFrame(words, "id long, word string")
    table = str.maketrans("ACGT", "TGCA")
    for r in clustering.similarities(frame, spark.createDataFrame(pairs, "id_a long, id_b long")).collect():
        a, b = words[r["id_a"]][1], words[r["id_b"]][1]
        best = max(sum(correlation(a[i], w[i - off]) for i in range(max(0, off), min(len(a), off + len(w)))) / min(len(a), len(w)) for w in (b, b[::-1].translate(table)) for off in range(1 - len(b), len(a)))
        assert r["sim"] == pytest.approx(best, abs=1e-8)


@pytest.mark.parametrize("threshold", [0.3, 0.45])
def test_edges_of_all_pairs(spark, threshold):
    rng = random.Random(7)
    words = ["GGATACTG", "AGTGTCCG", "", "ACRTNGCA", "ACG"]
    for _ in range(100):
        word = "".join(rng.choice("ACGT") for _ in range(8))
        words.append(word[:4] + "N" * rng.choice((0, 0, 0, 1, 2, 3, 6)) + word[4:])
    # Neighbours of a word by one letter and one place, so that many pairs are near.
    words += [rng.choice("ACGT") + w[:3] + rng.choice("ACGT") + w[4:-1] for w in words[5:65]]
    table, score = str.maketrans("ACGTR", "TGCAY"), {(x, y): correlation(x, y) for x in "ACGTRYN" for y in "ACGTRYN"}
    want = {}
    for i, a in enumerate(words):
        for j in range(i + 1, len(words)):
            b = words[j]
            if a and b:
                best = max(sum(score[a[k], w[k - off]] for k in range(max(0, off), min(len(a), off + len(w)))) / min(len(a), len(b)) for w in (b, b[::-1].translate(table)) for off in range(1 - len(b), len(a)))
                if round(1 - round(best, 9), 9) <= threshold:
                    want[i, j] = 1 - best
    frame = spark.createDataFrame(list(enumerate(words)), "id long, word string").repartition(3)
    rows = seeds.similarity_edges(frame, threshold).collect()
    assert len(rows) == len(want) and (0, 1) in want
    assert {(r["id_a"], r["id_b"]): r["dist"] for r in rows} == {k: pytest.approx(d, abs=1e-8) for k, d in want.items()}


def test_clusters_and_alignment(spark):
    words = spark.createDataFrame([(0, "ACGTTGAC"), (1, "CGTTGACA"), (2, "GTCAACGT"), (3, "TTTTCCCC"), (4, "TTTTCCCA"), (5, "GGGGGGGA")], "id long, word string")
    edges = saved(seeds.similarity_edges(words, 0.3))
    members = saved(clustering.clusters(words, edges, saved, 0.3))
    groups = {}
    for r in members.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert groups[1] == {0, 1, 2} and {3, 4} in groups.values() and {5} in groups.values()
    laid = {r["id"]: r for r in clustering.aligned(members, edges.withColumn("sim", 1 - F.col("dist")), words, saved).collect()}
    assert len(laid) == 6
    for r in laid.values():
        assert r["aligned"].lstrip(".") in (r["word"], r["word"][::-1].translate(str.maketrans("ACGT", "TGCA")))
    columns = [laid[i]["aligned"].ljust(12, ".") for i in (0, 1, 2)]
    assert all(len(set(c) - {"."}) <= 1 for c in zip(*columns, strict=True))


def test_missing_pairs_count_as_far(spark):
    words = spark.createDataFrame([(k, "A") for k in range(5)], "id long, word string")
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.15), (3, 4, 0.2)], "id_a long, id_b long, dist double")
    got = {}
    for r in clustering.clusters(words, edges, saved, 0.3).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    # 0-2 has no edge, so {0, 1} and 2 are (0.15 + 1) / 2 apart.
    assert sorted(map(sorted, got.values())) == [[0, 1], [2], [3, 4]]


def test_streaming_counts(spark, seqs, tmp_path):
    folder = str(tmp_path / "in")
    seqs.write.parquet(folder)
    stream = spark.readStream.schema(seqs.schema).parquet(folder)
    query = streaming.running_counts(stream, 4).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    got = {r["word"]: r["cnt"] for r in spark.table("counts").collect()}
    assert got == {r["word"]: r["cnt"] for r in streaming.running_counts(seqs, 4).collect()}


def gotoh(text, rows, opening, extending, free_ends):
    """Best global score by the three-table recurrence, cell by cell."""
    n, w = len(text), len(rows)
    best = [[-math.inf] * (n + 1) for _ in range(w + 1)]
    up = [[-math.inf] * (n + 1) for _ in range(w + 1)]
    for j in range(n + 1):
        best[0][j] = 0.0 if free_ends or not j else -(opening + extending * j)
    for i in range(1, w + 1):
        left = -math.inf
        for j in range(n + 1):
            up[i][j] = max(best[i - 1][j] - opening, up[i - 1][j]) - extending
            both = best[i - 1][j - 1] + (rows[i - 1]["ACGT".index(text[j - 1])] if text[j - 1] != "N" else 0.0) if j else -math.inf
            if j:
                left = max(best[i][j - 1] - opening, left) - extending
            best[i][j] = max(both, up[i][j], left)
    return max(best[w]) if free_ends else best[w][n]


@pytest.mark.parametrize("free_ends", [True, False])
def test_alignment_scores(spark, seqs, texts, free_ends):
    from strandloom.operators import alignment

    got = {r["seq_id"]: r["score"] for r in alignment.alignment_scores(seqs, ODDS, 1.3, 0.4, free_ends).collect()}
    assert got == {k: pytest.approx(gotoh(t, ODDS, 1.3, 0.4, free_ends)) for k, t in enumerate(texts)}


def test_best_start_of_each_width(spark):
    rng = random.Random(7)
    rows = []
    for k in range(100):
        text = [rng.choice("ACGT") for _ in range(80)]
        text[30:42] = "CACTTTGCAGAC"
        rows.append((k, "".join(text)))
    seqs = spark.createDataFrame(rows, "seq_id long, seq string").repartition(3)
    words = spark.createDataFrame([("CACTTTGCAG",), ("GGGGGGGGGG",), ("CACTTTGCAGAC",), ("CACTNTGCAGAC",), ("AAAAAAAAAAAA",)], "word string")
    models = refinement.start_models(words, np.full(4, 0.25), 0.012)
    assert [m.width for m in models] == [12, 12, 10, 12, 10] and np.allclose(models[1].theta[4], 0.25)
    best = refinement.best_by_width(seqs, models, iterations=6)
    assert set(best) == {10, 12} and best[12].model.name in ("CACTTTGCAGAC", "CACTNTGCAGAC") and best[10].model.name == "CACTTTGCAG"
    assert all(m.log_evalue < -100 and m.sites >= 90 for m in best.values())
