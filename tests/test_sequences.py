"""Column functions, sources and SQL functions on small inputs."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions import stats
from strandloom.functions.register import register
from strandloom.functions.windows import known_windows, windows
from strandloom.operators import composition, enrichment, ordered, shuffling, tuples
from strandloom.sources import fasta, motifs


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_scalar_functions(spark):
    assert value(spark, S.revcomp(F.lit("ACGTNRY"))) == "RYNACGT"
    assert value(spark, S.revcomp(S.revcomp(F.lit("ACGTRYKMBVDHSWN")))) == "ACGTRYKMBVDHSWN"
    assert value(spark, S.revcomp_cased(F.lit("AcgTB"))) == "VAcgT"
    assert value(spark, S.normalised(F.lit("acguRYx"))) == "ACGTNNX"
    assert value(spark, S.codes(F.lit("ACGTN"))) == [0, 1, 2, 3, -1]
    assert value(spark, S.revcomp_codes(S.codes(F.lit("ACGN")))) == [-1, 1, 2, 3]
    assert value(spark, S.iupac_regex(F.lit("aRn"))) == "A[AG][ACGT]"
    assert value(spark, S.iupac_regex(F.lit("AC"), "-*")) == "A-*C"
    assert value(spark, S.concrete_words(F.lit("RAY"))) == ["AAC", "GAC", "AAT", "GAT"]
    assert value(spark, S.translated(F.lit("ATGTAANNNA"))) == "M_*"
    assert value(spark, S.matches(F.lit("ACgt"), F.lit("acgA"))) == 3
    assert value(spark, S.matches(F.lit("ACgt"), F.lit("acgA"), fold_case=False)) == 1
    assert value(spark, S.alphabet_of(F.lit("ACGU"))) == "RNA"
    assert value(spark, S.truncating_mod(F.lit(-7), F.lit(3))) == -1
    assert value(spark, S.log_number(F.lit(-20.0))) == "2.1e-009"
    assert value(spark, S.log_number(F.log(F.lit(9.97e-5)))) == "1.0e-004"
    assert value(spark, S.log10_of_text(F.lit("3.2e-035"))) == pytest.approx(math.log10(3.2) - 35)
    assert value(spark, S.site(F.lit("ACGT"), F.lit(1), 2)) == "CG"
    with pytest.raises(Exception, match="outside"):
        value(spark, S.site(F.lit("ACGT"), F.lit(3), 2))


def test_statistics(spark):
    assert value(spark, stats.letter_entropy(F.lit("ACGT"))) == pytest.approx(2)
    assert value(spark, stats.letter_entropy(F.lit("AAAA"))) == pytest.approx(0.075030429, abs=1e-8)
    assert value(spark, stats.letter_entropy(F.lit("aacg"))) == pytest.approx(1.522536891, abs=1e-8)
    n, d, k, x = (F.lit(v) for v in (10, 4, 5, 3))
    assert value(spark, stats.hypergeometric(n, d, k, x)) == pytest.approx(0.229025869, abs=1e-7)
    assert value(spark, stats.hypergeometric_tail(n, d, k, x)) == pytest.approx(0.252312862, abs=1e-7)
    for upper in (True, False):
        for hits in (0, 3, 7, 12):
            ks = range(hits, 13) if upper else range(hits + 1)
            want = sum(math.exp(sum(stats._log_factorials(np.array([12.0, 38, 30, 20]))) - sum(stats._log_factorials(np.array([50.0, 12 - i, i, 18 + i, 20 - i])))) for i in ks)
            assert value(spark, stats.hypergeometric_tail(F.lit(50), F.lit(20), F.lit(12), F.lit(hits), upper)) == pytest.approx(want)
    assert stats.tail_probability(1e9, 1e8, 1e8, 1e7 + 3000, True) == pytest.approx(0.5 * math.erfc(2999.5 / math.sqrt(2 * 8.1e6)), rel=1e-2)
    assert value(spark, stats.mann_whitney_z(F.lit(3), F.lit(10), F.lit(10))) == pytest.approx(1.481487494, abs=1e-8)
    assert value(spark, stats.kolmogorov_p(F.lit(0.3), F.lit(50.0))) == pytest.approx(0.000174213, abs=1e-8)
    assert value(spark, stats.log_product_p(F.lit(2), F.log(F.lit(0.01)))) == pytest.approx(-2.881480767, abs=1e-8)
    assert value(spark, stats.log_product_p(F.lit(3), F.log(F.lit(0.001)))) == pytest.approx(-3.449349401, abs=1e-8)
    assert value(spark, stats.log_placements(F.lit(12), F.lit(3))) == pytest.approx(7.367708572, abs=1e-8)
    assert value(spark, stats.log_placements(F.lit(12), F.lit(3), whole_division=False)) == pytest.approx(7.473069088, abs=1e-8)
    assert value(spark, stats.log_combinations(F.lit(10), F.lit(3))) == pytest.approx(math.log(120))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 1, 7, 8, 30, 255, 256, 257, 263, 264, 1000)]
    return made + [made[4], "ACGTACGT", "N" * 20]


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "seq_id long, seq string").repartition(3)


@pytest.mark.parametrize("width", [1, 8, 20])
def test_windows(spark, texts, width):
    want = Counter((k, i, t[i : i + width]) for k, t in enumerate(texts) for i in range(len(t) - width + 1))
    assert Counter(tuple(r) for r in windows(frame(spark, texts), width, ["seq_id"]).collect()) == want
    assert Counter(tuple(r) for r in known_windows(frame(spark, texts), width, ["seq_id"]).collect()) == Counter({k: v for k, v in want.items() if "N" not in k[2]})


@pytest.mark.parametrize("half", [1, 4, 5])
def test_gapped_counts(spark, texts, half):
    want = Counter()
    for t in texts:
        for gap in range(4):
            width = 2 * half + gap
            for i in range(len(t) - width + 1):
                a, b = t[i : i + half], t[i + half + gap : i + width]
                if "N" not in a + b:
                    word = a + "N" * gap + b
                    want[gap, min(word, rc(b) + "N" * gap + rc(a))] += 1
    got = {(r["gap"], r["word"]): r["cnt"] for r in enrichment.gapped_counts(frame(spark, texts), half, 0, 3).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("half", [2, 5])
def test_gapped_counts_of_two_sets(spark, texts, half):
    rows = frame(spark, texts)
    own = F.when(F.col("seq_id") % 3 == 0, F.lit(True)).when(F.col("seq_id") % 3 == 1, F.lit(False))
    got = {(r["gap"], r["word"]): (r["pos_sites"], r["neg_sites"]) for r in enrichment.gapped_counts_of_two(rows, own, half, 0, 2).collect()}
    one, two = ({(r["gap"], r["word"]): r["cnt"] for r in enrichment.gapped_counts(rows.where(w), half, 0, 2).collect()} for w in (F.coalesce(own, F.lit(False)), ~F.coalesce(own, F.lit(False))))
    assert got == {k: (one.get(k), two.get(k)) for k in one | two}


def test_enrichment_rules(spark):
    counts = spark.createDataFrame([(0, "AAAA", 9, 4), (0, "CCCC", 9, None), (0, "GGGG", 3, None), (0, "TTTT", 8, 2), (0, "TTTA", None, 5)], "gap int, word string, pos_sites long, neg_sites long")
    rows = {r["word"]: r for r in enrichment.zscores(counts).collect()}
    assert len(rows) == 4
    assert (rows["AAAA"]["z"], rows["CCCC"]["z"], rows["CCCC"]["neg_sites"]) == (2.5, 8.0, 0)
    spread = np.std([2.5, 8.0, 2.0, 6 / math.sqrt(2)])
    assert rows["AAAA"]["z_corrected"] == pytest.approx(2.5 / spread)
    scored = spark.createDataFrame([(0, "A", 9, 9.0), (0, "B", 8, 8.0), (0, "C", 1, 7.0), (0, "D", 9, 6.0), (1, "E", 9, 1.0)], "gap int, word string, pos_sites int, z double").withColumn("z_corrected", F.col("z"))
    assert sorted(r["word"] for r in enrichment.prefix_cut(scored, 5, 5.0).collect()) == ["A", "B"]


def test_weighted_matrix(spark):
    members = spark.createDataFrame([("c", "A", 6.0), ("c", "CG", 2.0), ("c", ".", 2.0)], "cluster string, aligned string, weight double")
    rows = {r["pos"]: r for r in composition.weighted_pfm(members, ["cluster"]).collect()}
    assert [rows[0][x] for x in "ACGT"] == pytest.approx([0.582, 0.254, 0.086, 0.078]) and rows[0]["letter"] == "M" and rows[1]["letter"] == "G"
    word = {r["code"] if "code" in r else r["pos"]: r for r in composition.word_pfm(spark.createDataFrame([("AN",)], "word string")).collect()}
    assert [word[0][x] for x in "ACGT"] == [0.9712, 0.0096, 0.0096, 0.0096] and [word[1][x] for x in "ACGT"] == [0.25] * 4


def test_shuffle_keeps_pairs(spark):
    rng = random.Random(4)
    texts = ["", "A", "AC", "AAAA", *("".join(rng.choice("ACGTN") for _ in range(n)) for n in (3, 10, 80, 400))]
    rows = shuffling.shuffled(frame(spark, texts), seed=3, copies=2).collect()
    assert len(rows) == 2 * (len(texts) + 1)
    for r in rows:
        s, t = (texts + [None])[min(r["seq_id"], len(texts))], r["seq"]
        if s is None:
            assert t is None
            continue
        assert len(s) == len(t) and s[:1] == t[:1] and s[-1:] == t[-1:]
        assert Counter(zip(s, s[1:], strict=False)) == Counter(zip(t, t[1:], strict=False))
    again = shuffling.shuffled(frame(spark, texts).repartition(1), seed=3, copies=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_running_totals(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 30), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "v int, own boolean").repartition(5)
    values = sorted(v for v, _ in rows)
    ranks = {r["v"]: r["rank"] for r in ordered.average_ranks(df, "v").collect()}
    assert ranks == {v: values.index(v) + (values.count(v) + 1) / 2 for v in set(values)}
    row = ordered.rank_sum(df, "v", F.col("own")).first()
    assert row["rank_sum"] == sum(ranks[v] for v, own in rows if own)
    pairs = spark.createDataFrame([(x, (x * 7) % 11) for x in range(50)], "x int, y int")
    rx = {v: r for v, r in ((r["x"], r["rank"]) for r in ordered.average_ranks(pairs, "x").collect())}
    ry = {v: r for v, r in ((r["y"], r["rank"]) for r in ordered.average_ranks(pairs, "y").collect())}
    want = np.corrcoef([rx[x] for x in range(50)], [ry[(x * 7) % 11] for x in range(50)])[0, 1]
    assert ordered.spearman(pairs, "x", "y").first()["rho"] == pytest.approx(want)


FASTA = ">one first  record\nACGT\nACGT*\n>two\nacgu\n\n>one again\nNNN AC\n"


def test_fasta(spark, tmp_path):
    path = str(tmp_path / "in.fa")
    open(path, "w").write(FASTA)
    want = [("one", "one first  record", "ACGTACGT"), ("two", "two", "acgu"), ("one", "one again", "NNNAC")]
    seqs = fasta.read_fasta(spark, path)
    assert [(r["name"], r["info"], r["seq"]) for r in seqs.orderBy("seq_id").collect()] == want
    assert {r["name"]: r["seq"] for r in fasta.first_of_each_name(seqs).collect()} == {"one": "ACGTACGT", "two": "acgu"}
    assert [r["seq"] for r in fasta.unambiguous(seqs).orderBy("seq_id").collect()] == ["ACGTACGT", "ACGT", "NNNAC"]
    fasta.write_fasta(seqs, str(tmp_path / "out"), 3)
    assert [(r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("name", "seq").collect()] == sorted((n, s) for n, _, s in want)
    with pytest.raises(Exception, match="illegal"):
        fasta.checked(seqs, "ACG").collect()


def test_swissprot(spark, tmp_path):
    path = str(tmp_path / "in.sp")
    open(path, "w").write("ID   P1 X\nDE   some protein\nDE   more\nSQ   SEQUENCE\n     MKV LA\n     GG.*\n//\nID   P2 Y\nDE   other\nSQ   S\n     aa\n//\n")
    assert [tuple(r)[1:] for r in fasta.read_swissprot(spark, path).orderBy("seq_id").collect()] == [("P1", "some protein more", "MKVLAGG"), ("P2", "other", "AA")]


MOTIF_FILE = motifs.MOTIF_FILE_HEADER + "\nMOTIF one alt1\n\nletter-probability matrix: alength= 4 w= 2 nsites= 17 E= 4.1e-009\n 0.1 0.2 0.3 0.4\n 1.0 0.0 0.0 0.0\n\nMOTIF two\nletter-probability matrix: alength= 4 w= 1 nsites= 5 E= 1e-2\n0.25 0.25 0.25 0.25\n"


def test_motif_files(spark, tmp_path):
    path = str(tmp_path / "in.motifs")
    open(path, "w").write(MOTIF_FILE)
    rows = motifs.read_motif_file(spark, path).orderBy("motif", "pos").collect()
    assert [(r["motif"], r["w"], r["nsites"], r["evalue"], r["pos"], r["A"], r["T"]) for r in rows] == [("one", 2, 17, 4.1e-9, 0, 0.1, 0.4), ("one", 2, 17, 4.1e-9, 1, 1.0, 0.0), ("two", 1, 5, 0.01, 0, 0.25, 0.25)]
    words = spark.createDataFrame([("ACGT", 5, 0, 2.5, 8.0), ("ACNGT", 7, 1, 3.5, 9.0)], motifs.WORDS)
    motifs.write_words(words, str(tmp_path / "words"))
    assert sorted(map(tuple, motifs.read_words(spark, str(tmp_path / "words")).collect())) == sorted(map(tuple, words.collect()))
    pfm = spark.createDataFrame([("cluster1", "AN", 0, 0.7, 0.1, 0.1, 0.1), ("cluster1", "AN", 1, 0.25, 0.25, 0.25, 0.25)], "motif string, consensus string, pos int, A double, C double, G double, T double")
    text = motifs.seed_matrix_text(pfm).first()["value"]
    open(tmp_path / "wm", "w").write(text + text.replace("cluster1", "cluster2"))
    back = motifs.read_seed_matrices(spark, str(tmp_path / "wm"), 0.1).orderBy("motif", "pos").collect()
    assert [r["motif"] for r in back] == ["cluster1"] * 2 + ["cluster2"] * 2 and back[0]["A"] == pytest.approx(0.8 / 1.4)
    open(tmp_path / "bg", "w").write("# comment\nA 0.3\nC 0.2\nG 0.2\nT 0.3\nAA 0.1\n")
    background = motifs.read_background(spark, str(tmp_path / "bg"))
    assert motifs.missing_tuples(background, 0).count() == 0 and motifs.missing_tuples(background, 1).count() == 15


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT revcomp('AACG') AS a, canonical_kmer('TTTT') AS b, letters_known('ACGN') AS c").first().asDict() == {"a": "CGTT", "b": "AAAA", "c": False}
    texts = ["ACGTNA", "", None, "ACG", "NACGTTTACGGGTACN"]
    spark.createDataFrame(list(enumerate(texts)), "k int, seq string").createOrReplaceTempView("given")
    rows = spark.sql("SELECT g.k, t.start, t.word FROM given g, LATERAL gapped_kmers(g.seq, 1, 3) AS t").collect()
    want = {(k, i, s[i] + "NNN" + s[i + 4]) for k, s in enumerate(texts) for i in range(len(s or "") - 4) if "N" not in s[i] + s[i + 4]}
    assert Counter(map(tuple, rows)) == Counter(want)
    rows = spark.sql("SELECT t.* FROM VALUES ('aCCgCC') AS s(seq), LATERAL regex_match(s.seq, 'c+') AS t").collect()
    assert [tuple(r) for r in rows] == [(m.start(), m.group(), 1.0) for m in re.finditer("C+", "aCCgCC")]
    assert spark.sql("SELECT t.start FROM VALUES ('cCCgCC') AS s(seq), LATERAL regex_match(s.seq, 'C+', true) AS t").collect() == [(1,), (4,)]
    rows = spark.sql("SELECT g.k, t.start, t.word, t.score FROM (SELECT *, consensus_matrix('ACR') AS m FROM given) g, LATERAL pwm_match(g.seq, g.m, 2.0D) AS t").collect()
    odds = {"A": "A", "C": "C", "R": "AG"}
    table = [[math.log(max(1e-4, (x in odds[c]) / len(odds[c])) / 0.25) for x in "ACGT"] for c in "ACR"]
    want = {}
    for k, text in enumerate(texts):
        for i in range(len(text or "") - 2):
            word = text[i : i + 3]
            if "N" not in word and (score := sum(row["ACGT".index(x)] for row, x in zip(table, word, strict=True))) > 2:
                want[k, i, word] = score
    assert {tuple(r[:3]): r[3] for r in rows} == {key: pytest.approx(v) for key, v in want.items()} and len(want) > 2


def test_markov(spark, texts):
    got = {r["tuple"]: r["cnt"] for r in composition.markov_counts(frame(spark, texts), 2).collect()}
    want = Counter(t[i : i + n] for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1) if "N" not in t[i : i + n])
    assert got == dict(want)
    both = {r["tuple"]: r["cnt"] for r in composition.markov_counts(frame(spark, texts), 1, both_strands=True).collect()}
    assert all(both[t] == both[rc(t)] for t in both)
    table = composition.markov_probabilities(spark.createDataFrame(list(got.items()), "tuple string, cnt long")).collect()
    for prefix in ("".join(p) for p in product("ACGT", repeat=2)):
        assert sum(r["conditional"] for r in table if len(r["tuple"]) == 3 and r["tuple"].startswith(prefix)) == pytest.approx(1)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_log_background(spark, texts, order):
    rng = random.Random(order)
    p = {"".join(t): rng.uniform(0.05, 0.9) for n in range(1, order + 2) for t in product("ACGT", repeat=n)}
    want = {}
    for k, t in enumerate(texts):
        total, count = 0.0, 0
        for i, x in enumerate(t):
            if x == "N":
                continue
            run = re.search("[ACGT]*$", t[max(0, i - order) : i]).group()
            total, count = total + math.log(p[run + x]), count + 1
        if count:
            want[k] = (pytest.approx(total), count)
    got = {r["seq_id"]: (r["log_background"], r["letters"]) for r in tuples.log_background(frame(spark, texts), p, order).collect()}
    assert got == want


def test_proteins(spark, texts):
    rows = frame(spark, texts)
    got = {r["seq_id"]: r["protein"] for r in tuples.proteins(rows).collect()}
    assert got == {r["seq_id"]: r["v"] for r in rows.select("seq_id", S.translated(F.col("seq")).alias("v")).collect()}


def test_wide_tuples(spark, texts):
    got = {r["word"]: r["cnt"] for r in tuples.tuple_counts(frame(spark, texts), [3, 12]).collect()}
    assert got == dict(Counter(t[i : i + n] for t in texts for n in (3, 12) for i in range(len(t) - n + 1) if "N" not in t[i : i + n]))
