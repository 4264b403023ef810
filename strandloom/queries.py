"""Registered queries of the motif engine and their DuckDB twins.

Sequences come from ``documents``: each text's letters become ACGT by their place in
the alphabet modulo four, all else N.  The positive set is the English documents, the
negative set all others.  Every query reads whole tables and whole texts.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.functions import stats, windows
from strandloom.operators import composition, em, enrichment, ordered, scan, shuffling, significance, tuples
from strandloom.plans import refinement, seeds
from strandloom.sources import fasta, motifs
from strandloom.storage import dealt, saved

ALPHABET = string.ascii_lowercase + string.ascii_uppercase
DNA = "".join("ACGT"[string.ascii_lowercase.index(x.lower()) % 4] for x in ALPHABET)
#: The motif that scans look for, and the share of windows that are its sites.
MOTIF, RATE = "TGACTCAT", 0.002
HALF, MAX_GAP, MIN_SITES, Z_CUT = 4, 10, 5, 5.0
LETTERS = "ACGT"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, lang, source, seq."""
    seq = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), ALPHABET, DNA), "[^ACGT]", "N")
    return dealt(_read(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("seq_id"), "lang", "source", seq.alias("seq"))


#: The positive set.
ENGLISH = "lang = 'en'"


SEQS = f"seqs AS MATERIALIZED (SELECT doc_id AS seq_id, lang, source, regexp_replace(translate(coalesce(text, ''), '{ALPHABET}', '{DNA}'), '[^ACGT]', 'N', 'g') AS seq FROM documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _windows(width: int, known: bool = True) -> str:
    """CTEs up to ``wins`` (seq_id, lang, start, word)."""
    return f"""{SEQS},
chunks AS MATERIALIZED (SELECT seq_id, lang, base, substr(seq, base + 1, {256 + width - 1}) AS part, length(seq) AS n FROM (SELECT *, unnest(range(0, length(seq), 256)) AS base FROM seqs)),
wins AS (SELECT seq_id, lang, base + i AS start, substr(part, i + 1, {width}) AS word FROM (SELECT *, unnest(range(0, least(256, n - base - {width} + 1))) AS i FROM chunks) {f"WHERE NOT contains(substr(part, i + 1, {width}), 'N')" if known else ""})"""


def motif_matrix(consensus: str = MOTIF, own: float = 0.85) -> list[list[float]]:
    rest = (1 - own) / 3
    return [[own if x == letter else rest for x in LETTERS] for letter in consensus]


def motif_odds() -> list[list[float]]:
    """Natural log-odds over a uniform background."""
    return [[math.log(p / 0.25) for p in row] for row in motif_matrix()]


def _score_sql(table: list[list[float]], word: str = "word") -> str:
    rows = []
    for reverse in (False, True):
        m = [r[::-1] for r in table[::-1]] if reverse else table
        rows.append(" + ".join(f"CASE substr({word}, {j + 1}, 1) " + " ".join(f"WHEN '{x}' THEN {v!r}::DOUBLE" for x, v in zip(LETTERS, row, strict=True)) + " END" for j, row in enumerate(m)))
    return f"greatest({rows[0]}, {rows[1]})"


THRESHOLD = math.log((1 - RATE) / RATE)
_HITS = f"{_windows(len(MOTIF))}, scored AS (SELECT seq_id, lang, start, word, {_score_sql(motif_odds())} AS score FROM wins), hits AS (SELECT * FROM scored WHERE score > {THRESHOLD!r})"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- sequences and words ---------------------------------------------------------------------------


@_query(f"WITH {SEQS}, c AS (SELECT letter, sum(length(seq) - length(replace(seq, letter, ''))) + 1 AS n FROM seqs, (VALUES ('A'), ('C'), ('G'), ('T')) l(letter) GROUP BY letter) SELECT letter, round(n / sum(n) OVER (), 9) AS freq FROM c")
def letter_freqs(spark, sf_dir):
    return composition.letter_frequencies(sequences(spark, sf_dir)).select("letter", F.round("freq", 9).alias("freq"))


@_query(f"WITH {SEQS} SELECT seq_id, {RC.format('seq')} AS rc FROM seqs")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", S.revcomp(F.col("seq")).alias("rc"))


@_query(f"WITH {_windows(8)} SELECT least(word, {RC.format('word')}) AS word, count(*) AS cnt FROM wins GROUP BY 1")
def canonical_kmers(spark, sf_dir):
    words = tuples.tuple_counts(sequences(spark, sf_dir), [8])
    return words.groupBy(S.canonical(F.col("word")).alias("word")).agg(F.sum("cnt").alias("cnt"))


_FULL = 2 * HALF + MAX_GAP
_GAPPED = f"""{_windows(HALF, known=False).replace('AS start, substr', f'AS start, n, substr(part, i + 1, {_FULL}) AS long, substr')},
gaps AS (SELECT lang, unnest(range(0, {MAX_GAP + 1})) AS gap, word AS a, long FROM wins WHERE NOT contains(word, 'N')),
words AS (SELECT lang, gap, a, substr(long, {HALF} + gap + 1, {HALF}) AS b FROM gaps),
counts AS (SELECT coalesce(lang = 'en', FALSE) AS pos, gap, least(a || repeat('N', gap) || b, {RC.format('b')} || repeat('N', gap) || {RC.format('a')}) AS word, count(*) AS cnt FROM words WHERE length(b) = {HALF} AND NOT contains(b, 'N') GROUP BY ALL)""".replace(f"substr(seq, base + 1, {256 + HALF - 1})", f"substr(seq, base + 1, {256 + _FULL - 1})")
_SCORED = f"""{_GAPPED}, joined AS (SELECT p.gap, p.word, p.cnt AS pos_sites, coalesce(n.cnt, 0) AS neg_sites, (p.cnt - coalesce(n.cnt, 1)) / sqrt(coalesce(n.cnt, 1)) AS z
FROM (FROM counts WHERE pos) p LEFT JOIN (FROM counts WHERE NOT pos) n ON p.gap = n.gap AND p.word = n.word),
scored AS (SELECT *, z / stddev_pop(z) OVER (PARTITION BY gap) AS z_corrected FROM joined)"""
_PREFIX = f"{_SCORED}, marked AS (SELECT *, bool_and(z_corrected >= {Z_CUT} AND pos_sites >= {MIN_SITES}) OVER (PARTITION BY gap ORDER BY z DESC, word ROWS UNBOUNDED PRECEDING) AS ok FROM scored)"


@_query(f"WITH {_GAPPED} SELECT gap::INT AS gap, word, sum(cnt)::BIGINT AS cnt FROM counts GROUP BY ALL")
def gapped_kmer_counts(spark, sf_dir):
    return enrichment.gapped_counts(sequences(spark, sf_dir), HALF, 0, MAX_GAP)


def _scored(spark, sf_dir) -> DataFrame:
    return enrichment.zscores(saved(enrichment.gapped_counts_of_two(sequences(spark, sf_dir), F.expr(ENGLISH), HALF, 0, MAX_GAP)))


def _rounded_words(words: DataFrame) -> DataFrame:
    return words.select("gap", "word", "pos_sites", "neg_sites", F.round("z", 6).alias("z"), F.round("z_corrected", 6).alias("z_corrected"))


_WORD_COLUMNS = "gap::INT AS gap, word, pos_sites, neg_sites, round(z, 6) AS z, round(z_corrected, 6) AS z_corrected"


@_query(f"WITH {_SCORED} SELECT {_WORD_COLUMNS} FROM scored")
def kmer_zscores(spark, sf_dir):
    return _rounded_words(_scored(spark, sf_dir))


def enriched(spark, sf_dir) -> DataFrame:
    return enrichment.enrichment(sequences(spark, sf_dir), F.expr(ENGLISH), HALF, 0, MAX_GAP, MIN_SITES, Z_CUT)


@_query(f"WITH {_PREFIX} SELECT {_WORD_COLUMNS} FROM marked WHERE ok")
def kmer_enrichment_prefix(spark, sf_dir):
    return _rounded_words(enriched(spark, sf_dir))


@_query(f"WITH {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY z DESC) AS k FROM scored) SELECT word, gap::INT AS gap, pos_sites, neg_sites, round(z_corrected, 6) AS z_corrected, round(z, 6) AS z FROM best WHERE k = 1 ORDER BY best.z DESC, word LIMIT 50")
def top_k_seeds(spark, sf_dir):
    return enrichment.top_words(_scored(spark, sf_dir), 50).select("word", "gap", "pos_sites", "neg_sites", F.round("z_corrected", 6).alias("z_corrected"), F.round("z", 6).alias("z"))


_IUPAC_LETTERS = "ACGTRYKMSWBDHVNACGTRYKMSWB"
_IUPAC_SQL = "p_name_codes"
for _code, _members in S.IUPAC.items():
    if len(_members) > 1:
        _IUPAC_SQL = f"replace({_IUPAC_SQL}, '{_code.lower()}', '[{_members}]')"


@_query(f"SELECT p_partkey, upper(p_name_codes) AS consensus, upper({_IUPAC_SQL}) AS regex FROM (SELECT p_partkey, lower(translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '{string.ascii_uppercase}', '{_IUPAC_LETTERS}')) AS p_name_codes FROM part)")
def iupac_regex(spark, sf_dir):
    """Part names read as consensus strings."""
    consensus = F.translate(F.regexp_replace(F.upper("p_name"), "[^A-Z]", ""), string.ascii_uppercase, _IUPAC_LETTERS)
    return _read(spark, sf_dir, "part").select("p_partkey", consensus.alias("consensus"), S.iupac_regex(consensus).alias("regex"))


@_query(f"WITH {_windows(5)}, l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), k AS (SELECT a.x || b.x || c.x || d.x || e.x AS word FROM l a, l b, l c, l d, l e) SELECT k.word, count(wins.word) AS cnt FROM k LEFT JOIN wins ON k.word = wins.word GROUP BY k.word")
def kmer_catalog(spark, sf_dir):
    """Every 5-mer with its count, also those that do not occur."""
    counts = tuples.tuple_counts(sequences(spark, sf_dir), [5])
    catalog = spark.range(1).select(F.explode(S.concrete_words(F.lit("N" * 5))).alias("word"))
    return catalog.join(counts, "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@_query(f"""WITH {_windows(3, known=False)}, t AS (SELECT unnest(string_split('{S.CODON_LETTERS}', '')) AS aa, unnest(range(64)) AS i),
codons AS (SELECT aa, substr('{S.CODON_BASES}', (i // 16) + 1, 1) || substr('{S.CODON_BASES}', (i // 4) % 4 + 1, 1) || substr('{S.CODON_BASES}', i % 4 + 1, 1) AS codon FROM t)
SELECT seqs.seq_id, coalesce(p.protein, '') AS protein FROM seqs LEFT JOIN (SELECT seq_id, string_agg(coalesce(aa, '*'), '' ORDER BY start) AS protein FROM wins LEFT JOIN codons ON word = codon WHERE start % 3 = 0 GROUP BY seq_id) p ON seqs.seq_id = p.seq_id""")
def codon_translate(spark, sf_dir):
    """Frame-0 proteins."""
    return tuples.proteins(sequences(spark, sf_dir))


def _entropy_sql(counts: list[str]) -> str:
    total = " + ".join(f"({c} + 1e-5)" for c in counts)
    return "-(" + " + ".join(f"(({c} + 1e-5) / ({total})) * log2(({c} + 1e-5) / ({total}))" for c in counts) + ")"


@_query(f"WITH {SEQS}, c AS (SELECT seq_id, " + ", ".join(f"length(seq) - length(replace(seq, '{x}', '')) + 0.01::DOUBLE AS {x.lower()}" for x in LETTERS) + f" FROM seqs) SELECT seq_id, round({_entropy_sql(list('acgt'))}, 6) AS entropy FROM c")
def seq_entropy_1mer(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", F.round(stats.letter_entropy(F.col("seq")), 6).alias("entropy"))


@_query(f"WITH {_windows(2)}, c AS (SELECT seqs.seq_id, " + ", ".join(f"count(*) FILTER (WHERE word = '{a}{b}') + 0.01::DOUBLE AS p_{a}{b}" for a in LETTERS for b in LETTERS) + f" FROM seqs LEFT JOIN wins ON seqs.seq_id = wins.seq_id GROUP BY seqs.seq_id) SELECT seq_id, round({_entropy_sql(['p_' + a + b for a in LETTERS for b in LETTERS])}, 6) AS entropy FROM c")
def seq_entropy_2mer(spark, sf_dir):
    counts = tuples.sequence_pair_counts(sequences(spark, sf_dir))
    return counts.select("seq_id", F.round(stats.pair_entropy(F.col("pairs")), 6).alias("entropy"))


@_query(f"WITH {_windows(2)} SELECT word AS pair, count(*) AS cnt FROM wins GROUP BY word")
def dinuc_counts(spark, sf_dir):
    return composition.pair_counts(sequences(spark, sf_dir))


@_query(f"WITH {SEQS} SELECT source, min(seq_id) AS seq_id FROM seqs GROUP BY source")
def dedupe_by_name(spark, sf_dir):
    """The first record of each name (here: source)."""
    named = sequences(spark, sf_dir).withColumn("name", F.col("source"))
    return fasta.first_of_each_name(named).select("source", "seq_id")


@_query(f"""WITH {SEQS}, c AS (SELECT letter, sum((CASE WHEN lang = 'en' THEN 1.0 ELSE 0.5 END)::DOUBLE * (length(seq) - length(replace(seq, letter, '')))) AS w FROM seqs, (VALUES ('A'), ('C'), ('G'), ('T')) l(letter) GROUP BY letter)
SELECT a.letter, round((a.w + b.w) / 2 / sum(a.w) OVER (), 9) AS freq FROM c a JOIN c b ON b.letter = translate(a.letter, 'ACGT', 'TGCA')""")
def weighted_residues(spark, sf_dir):
    """Weighted letter shares, averaged over both strands (non-English sequences weigh half)."""
    seqs = sequences(spark, sf_dir).withColumn("w", F.when(F.col("lang") == "en", 1.0).otherwise(0.5))
    row = seqs.agg(*(F.sum(F.col("w") * (F.length("seq") - F.length(F.replace("seq", F.lit(x), F.lit(""))))).alias(x) for x in LETTERS))
    total = sum((F.col(x) for x in "CGT"), F.col("A"))
    pairs = F.array(*(F.struct(F.lit(x).alias("letter"), F.round((F.col(x) + F.col(y)) / 2 / total, 9).alias("freq")) for x, y in zip(LETTERS, LETTERS[::-1], strict=True)))
    return row.select(F.inline(pairs))


# --- scans and matrices ----------------------------------------------------------------------------


def hits(spark, sf_dir, **options) -> DataFrame:
    return scan.sites(sequences(spark, sf_dir), motif_odds(), RATE, **options)


def hit_words(spark, sf_dir) -> DataFrame:
    return hits(spark, sf_dir, words=True)


_FORWARD, _BACKWARD = (_score_sql(motif_odds())[len("greatest(") : -1].split(" END, ", 1)[k] + (" END" if k == 0 else "") for k in (0, 1))
_ORIENTED = f"{_HITS}, sites AS (SELECT seq_id, start, CASE WHEN ({_BACKWARD}) > ({_FORWARD}) + 1e-9 THEN {RC.format('word')} ELSE word END AS word, score FROM hits)"


@_query(f"WITH {_ORIENTED} SELECT h.seq_id, h.start, round(h.score, 6) AS score, CASE WHEN s.word <> h.word THEN '-' ELSE '+' END AS strand FROM hits h JOIN sites s USING (seq_id, start)")
def pwm_scan_hits(spark, sf_dir):
    return hits(spark, sf_dir).select("seq_id", "start", "strand", F.round("score", 6).alias("score"))


@_query(f"WITH {_HITS} SELECT seq_id, round(max(score), 6) AS score FROM scored GROUP BY seq_id")
def pwm_best_per_seq(spark, sf_dir):
    return scan.best_scores(sequences(spark, sf_dir), motif_odds()).select("seq_id", F.round("score", 6).alias("score"))


@_query(f"WITH {_HITS} SELECT seq_id, count(*) AS sites FROM hits GROUP BY seq_id")
def nsites(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("sites"))


@_query(f"WITH {_windows(len(MOTIF))}, g AS (SELECT seq_id, {_score_sql(scan.goodness(motif_matrix(), [0.25] * 4))} AS goodness FROM wins) SELECT seq_id, count(*) AS sites FROM g WHERE goodness > 0.7 GROUP BY seq_id")
def goodness_sites(spark, sf_dir):
    found = scan.hits(sequences(spark, sf_dir), scan.goodness(motif_matrix(), [0.25] * 4), 0.7)
    return found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("sites"))


@_query(f"""WITH RECURSIVE {_HITS}, kept AS (SELECT seq_id, min(start) AS start FROM hits GROUP BY seq_id
UNION ALL SELECT k.seq_id, (SELECT min(h.start) FROM hits h WHERE h.seq_id = k.seq_id AND h.start >= k.start + {len(MOTIF)}) AS start FROM kept k WHERE k.start IS NOT NULL),
places AS (SELECT seq_id, list(start ORDER BY start) AS starts FROM kept WHERE start IS NOT NULL GROUP BY seq_id)
SELECT s.seq_id, coalesce(len(starts), 0)::INT AS erased, CASE WHEN starts IS NULL THEN seq ELSE list_aggregate(list_transform(list_zip(list_prepend(-{len(MOTIF)}, starts), list_append(starts, length(seq))), lambda x: substr(seq, x[1] + {len(MOTIF)} + 1, x[2] - x[1] - {len(MOTIF)})), 'string_agg', '{"N" * len(MOTIF)}') END AS seq
FROM seqs s LEFT JOIN places p ON s.seq_id = p.seq_id""")
def erase_sites(spark, sf_dir):
    """Whole sequences with the sites of a greedy pass masked."""
    return scan.erased(sequences(spark, sf_dir), motif_odds(), RATE).select("seq_id", "erased", "seq")


@_query(f"""WITH {_HITS}, p AS (SELECT seq_id, start, 1 / (1 + exp(-(score + {math.log(RATE / (1 - RATE))!r}::DOUBLE))) AS z FROM scored),
c AS (SELECT seq_id, start + unnest(range({len(MOTIF)})) AS pos, z FROM p), w AS (SELECT seq_id, pos, max(z) AS z FROM c GROUP BY seq_id, pos)
SELECT s.seq_id, length(s.seq)::INT AS places, round(coalesce(sum(w.z), 0), 6) AS lost, round(1 - coalesce(max(w.z), 0), 6) AS least, coalesce(min(w.pos) FILTER (WHERE w.z > 0.5), -1)::INT AS first_half FROM seqs s LEFT JOIN w ON s.seq_id = w.seq_id GROUP BY s.seq_id, s.seq""")
def soft_erase(spark, sf_dir):
    """How much weight each sequence loses to the posteriors of all its windows, its least weight, and its first place of a weight under one half."""
    model = em.Model("motif", *_model_arrays(), RATE)
    rows = refinement.erase_softly(sequences(spark, sf_dir), model)
    lost = F.aggregate("weights", F.lit(0.0), lambda s, w: s + (1 - w))
    first = F.coalesce(F.array_position(F.transform("weights", lambda w: w < 0.5), F.lit(True)) - 1, F.lit(-1)).cast("int")
    return rows.select("seq_id", F.size("weights").alias("places"), F.round(lost, 6).alias("lost"), F.round(F.coalesce(F.array_min("weights"), F.lit(1.0)), 6).alias("least"), first.alias("first_half"))


def _model_arrays():
    return np.array(motif_matrix()), np.full(4, 0.25)


_COUNTS = f"{_ORIENTED}, m AS (SELECT j AS pos, substr(word, j + 1, 1) AS x FROM sites, range({len(MOTIF)}) t(j)), cm AS (SELECT pos::INT AS pos, count(*) FILTER (WHERE x = 'A') AS A, count(*) FILTER (WHERE x = 'C') AS C, count(*) FILTER (WHERE x = 'G') AS G, count(*) FILTER (WHERE x = 'T') AS T FROM m GROUP BY pos)"
_PROBS = f"{_COUNTS}, pm AS (SELECT pos, " + ", ".join(f"({x} + 0.5) / (A + C + G + T + 2.0::DOUBLE) AS {x}" for x in LETTERS) + " FROM cm)"


@_query(f"WITH {_COUNTS} SELECT * FROM cm")
def count_matrix(spark, sf_dir):
    return composition.count_matrix(hit_words(spark, sf_dir), [], len(MOTIF))


def _probabilities(spark, sf_dir) -> DataFrame:
    return composition.probability_matrix(count_matrix(spark, sf_dir), 0.5)


@_query(f"WITH {_PROBS} SELECT pos, " + ", ".join(f"round(log2({x} / 0.25) * 100, 5) AS {x}" for x in LETTERS) + " FROM pm")
def log_odds_matrix(spark, sf_dir):
    odds = composition.log_odds(_probabilities(spark, sf_dir), dict.fromkeys(LETTERS, 0.25), 100.0)
    return odds.select("pos", *(F.round(x, 5).alias(x) for x in LETTERS))


def _info_sql() -> str:
    first = {x: f"(({x} + 0.1) / (A + C + G + T + 0.4::DOUBLE))" for x in LETTERS}
    whole = " + ".join(first.values())
    return "-(" + " + ".join(f"(({v} + 0.0001) / ({whole} + 0.0004)) * log2(({v} + 0.0001) / ({whole} + 0.0004))" for v in first.values()) + ")"


@_query(f"WITH {_COUNTS} SELECT pos, round({_info_sql()}, 6) AS info, round(2 - {_info_sql()}, 6) AS order_bits FROM cm")
def column_info(spark, sf_dir):
    info = composition.column_information(*(F.col(x).cast("double") for x in LETTERS))
    return count_matrix(spark, sf_dir).select("pos", F.round(info, 6).alias("info"), F.round(2 - info, 6).alias("order_bits"))


@_query(f"""WITH {_PROBS}, r AS (SELECT pos, unnest(['A', 'C', 'G', 'T']) AS x, unnest([A, C, G, T]) AS p FROM pm), lv AS (SELECT pos, string_agg(x, '' ORDER BY p DESC, x) FILTER (WHERE p >= 0.2) AS levels FROM r GROUP BY pos)
SELECT pos, CASE WHEN A >= 0.7 THEN 'A' WHEN T >= 0.7 THEN 'T' WHEN C >= 0.7 THEN 'C' WHEN G >= 0.7 THEN 'G' WHEN A + T > 0.8 THEN 'W' WHEN A + C > 0.8 THEN 'M' WHEN A + G > 0.8 THEN 'R' WHEN T + C > 0.8 THEN 'Y' WHEN T + G > 0.8 THEN 'K' WHEN C + G > 0.8 THEN 'S' WHEN A < 0.1 THEN 'B' WHEN T < 0.1 THEN 'V' WHEN C < 0.1 THEN 'D' WHEN G < 0.1 THEN 'H' ELSE 'N' END AS letter, coalesce(levels, '') AS levels FROM pm JOIN lv USING (pos)""")
def column_consensus(spark, sf_dir):
    columns = [F.col(x) for x in LETTERS]
    return _probabilities(spark, sf_dir).select("pos", composition.consensus_letter(*columns).alias("letter"), composition.multilevel_consensus(*columns).alias("levels"))


def _weighted_column(letter: str) -> str:
    gap = composition.GAP_COLUMN[LETTERS.index(letter)]
    return f"sum(w * CASE WHEN x IN ('.', 'N') THEN {gap} WHEN x = '{letter}' THEN 0.88 ELSE 0.04 END::DOUBLE) AS {letter}"


_NAMES = "MAP {" + ", ".join(f"'{seen}': '{code}'" for code, seen in S.IUPAC.items()) + "}"


@_query(f"""WITH {_PREFIX}, al AS (SELECT gap, rpad(word, {2 * HALF} + gap::INT, '.') AS word, z_corrected AS w FROM marked WHERE ok), ch AS (SELECT gap, w, j AS pos, substr(word, j + 1, 1) AS x FROM al, range({_FULL}) t(j) WHERE j < length(word)),
s AS (SELECT gap, pos, {", ".join(map(_weighted_column, LETTERS))}, string_agg(DISTINCT x, '' ORDER BY x) FILTER (WHERE x <> 'N') AS seen FROM ch GROUP BY gap, pos)
SELECT gap::INT AS gap, pos::INT AS pos, {", ".join(f"round({x} / (A + C + G + T), 6) AS {x}" for x in LETTERS)}, coalesce({_NAMES}[seen], 'N') AS letter FROM s""")
def weighted_pfm(spark, sf_dir):
    """The matrix of each gap's enriched words, weighted by corrected z."""
    members = enriched(spark, sf_dir).select("gap", F.col("word").alias("aligned"), F.col("z_corrected").alias("weight"))
    return composition.weighted_pfm(members, ["gap"]).select("gap", "pos", *(F.round(x, 6).alias(x) for x in LETTERS), "letter")


_BEST = f"{_HITS}, s AS (SELECT seq_id, coalesce(lang = 'en', FALSE) AS positive, round(max(score), 6) AS score FROM scored GROUP BY ALL)"


def _labelled_scores(spark, sf_dir) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    named = seqs.select(F.struct("seq_id", F.coalesce(F.expr(ENGLISH), F.lit(False)).alias("positive")).alias("row"), "seq")
    best = scan.best_scores(named, motif_odds(), key="row")
    return best.select(F.round("score", 6).alias("score"), F.col("seq_id.positive").alias("positive"))


@_query(f"""WITH {_BEST}, b AS (SELECT score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM s GROUP BY score),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM b WINDOW w AS (ORDER BY score DESC)), e AS (SELECT *, np - tp + fp AS err FROM r),
k AS (SELECT max(score) AS high, min(score) AS last FROM e WHERE err = (SELECT min(err) FROM e)),
u AS (SELECT sum(n * (tp - p)) / any_value(np * nn) AS area, min(score) FILTER (WHERE p > 0) - max(score) FILTER (WHERE n > 0) AS margin, any_value(np) AS np, any_value(nn) AS nn, min(err) AS err FROM e)
SELECT np::BIGINT AS positives, nn::BIGINT AS negatives, err::BIGINT AS err, round((high + coalesce((SELECT max(score) FROM b WHERE score < k.last), last)) / 2, 6) AS threshold, round(area + CASE WHEN area = 1 THEN margin ELSE 0 END, 6) AS auc FROM u, k""")
def roc_threshold(spark, sf_dir):
    return scan.roc(_labelled_scores(spark, sf_dir)).select("positives", "negatives", "err", F.round("threshold", 6).alias("threshold"), F.round("auc", 6).alias("auc"))


@_query(f"""WITH {_BEST}, ends AS (SELECT min(score) AS low, max(score) AS high FROM s), b AS (SELECT CASE WHEN high > low THEN least(floor((score - low) / (high - low) * 50), 49) ELSE 0 END::BIGINT AS bin, positive FROM s, ends),
c AS (SELECT g.bin, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM range(50) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin),
e AS (SELECT bin, bin / 50 AS q, coalesce(sum(p) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(n) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS err FROM c)
SELECT round(q, 6) AS q, err::BIGINT AS err, round(avg(err) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM e""")
def q_grid(spark, sf_dir):
    return scan.mixing_grid(_labelled_scores(spark, sf_dir), 50).select(F.round("q", 6).alias("q"), "err", F.round("smoothed", 6).alias("smoothed"))


# --- backgrounds and EM ----------------------------------------------------------------------------

_TUPLES = f"{_windows(3, known=False).replace('least(256, n - base - 3 + 1)', 'least(256, n - base)')}, tuples AS (SELECT tuple, count(*) AS cnt FROM (SELECT unnest([substr(word, 1, 1), CASE WHEN length(word) > 1 THEN substr(word, 1, 2) END, CASE WHEN length(word) > 2 THEN word END]) AS tuple FROM wins) WHERE tuple IS NOT NULL AND NOT contains(tuple, 'N') GROUP BY tuple)"
_CONDITIONAL = f"{_TUPLES}, mk AS (SELECT tuple, cnt, cnt / sum(cnt) OVER (PARTITION BY length(tuple)) AS prob, least(cnt / sum(cnt) OVER (PARTITION BY length(tuple), left(tuple, -1)), 1.0) AS conditional FROM tuples)"


@_query(f"WITH {_TUPLES} SELECT * FROM tuples")
def markov_counts(spark, sf_dir):
    return composition.markov_counts(sequences(spark, sf_dir), 2)


@_query(f"WITH {_CONDITIONAL} SELECT tuple, round(prob, 9) AS prob, round(conditional, 9) AS conditional FROM mk")
def markov_conditional(spark, sf_dir):
    table = composition.markov_probabilities(markov_counts(spark, sf_dir))
    return table.select("tuple", F.round("prob", 9).alias("prob"), F.round("conditional", 9).alias("conditional"))


@_query(f"""WITH {_CONDITIONAL}, q AS (SELECT seq_id, start, word, substr(word, 1, 2) AS pair FROM (SELECT seq_id, base + i AS start, substr(' ' || part, i + 1, 2) AS word FROM (SELECT *, unnest(range(0, least(256, n - base))) AS i FROM chunks2)))
SELECT q.seq_id, round(sum(ln(mk.conditional)), 4) AS log_background, count(*) AS letters FROM q JOIN mk ON mk.tuple = CASE WHEN left(q.word, 1) IN ('A', 'C', 'G', 'T') THEN q.word ELSE right(q.word, 1) END WHERE right(q.word, 1) <> 'N' GROUP BY q.seq_id""".replace("chunks2", "(SELECT seq_id, base, n, substr('N' || seq, base + 1, 257) AS part FROM (SELECT *, unnest(range(0, length(seq), 256)) AS base, length(seq) AS n FROM seqs))").replace("substr(' ' || part, i + 1, 2)", "substr(part, i + 1, 2)"))
def cumulative_background(spark, sf_dir):
    """Log probability of each sequence under an order-1 background; unknown letters reset the context."""
    seqs = sequences(spark, sf_dir)
    table = composition.markov_probabilities(composition.markov_counts(seqs, 1))
    conditionals = {r["tuple"]: r["conditional"] for r in table.collect()}  # 4 + 16 tuples
    return tuples.log_background(seqs, conditionals, 1).select("seq_id", F.round("log_background", 4).alias("log_background"), "letters")


_POSTERIOR = f"{_HITS}, z AS (SELECT CASE WHEN ({_BACKWARD}) > ({_FORWARD}) + 1e-9 THEN {RC.format('word')} ELSE word END AS word, 1 / (1 + exp(-(score + {math.log(RATE / (1 - RATE))!r}::DOUBLE))) AS z FROM scored)"


@_query(f"WITH {_POSTERIOR}, l AS (SELECT j::INT AS pos, substr(word, j + 1, 1) AS x, z FROM z, range({len(MOTIF)}) t(j)) SELECT pos, " + ", ".join(f"round(sum(z) FILTER (WHERE x = '{x}'), 3) AS {x}" for x in LETTERS) + " FROM l GROUP BY pos")
def e_step(spark, sf_dir):
    """Expected letter counts of one E step over all windows."""
    model = em.Model("motif", *_model_arrays(), RATE)
    row = em.expected_counts(sequences(spark, sf_dir), [model])
    cells = row.select(F.posexplode("motif").alias("cell", "v"))
    return cells.groupBy(F.floor(F.col("cell") / 4).cast("int").alias("pos")).agg(*(F.round(F.sum(F.when(F.col("cell") % 4 == k, F.col("v"))), 3).alias(x) for k, x in enumerate(LETTERS)))


_RATIOS = f"{_HITS}, r AS (SELECT seq_id, CASE WHEN ({_BACKWARD}) > ({_FORWARD}) + 1e-9 THEN {RC.format('word')} ELSE word END AS word, exp(score) AS r FROM scored)"
#: Share of sequences that hold a site, where there is none or one.
ONE_SHARE = 0.4


def _m_step_sql(z: str, total: str) -> str:
    """Matrix and rate after one M step, from ``z`` (word, z), every window once."""
    cells = ", ".join(f"(sum(z) FILTER (WHERE x = '{x}') + {em.PRIOR} * 0.25 * any_value(zs)) AS {x}" for x in LETTERS)
    rows = ", ".join(f"round({x} / (A + C + G + T), 6) AS {x}" for x in LETTERS)
    return f"{z}, zt AS (SELECT sum(z) AS zs FROM z), l AS (SELECT j::INT AS pos, substr(word, j + 1, 1) AS x, z FROM z, range({len(MOTIF)}) t(j)), m AS (SELECT pos, any_value(zs) AS zs, {cells} FROM l, zt GROUP BY pos) SELECT pos, {rows}, round(zs / (SELECT {total}), 9) AS rate FROM m"


def _one_step(spark, sf_dir, model: em.Model) -> DataFrame:
    seqs = sequences(spark, sf_dir)
    after = em.maximised(model, em.collected(em.expected_counts(seqs, [model]), [model])[0])
    return _models(spark, [after]).select("pos", *(F.round(x, 6).alias(x) for x in LETTERS), F.round("rate", 9).alias("rate"))


@_query("WITH " + _m_step_sql(_POSTERIOR, "count(*) FROM z"))
def m_step(spark, sf_dir):
    """The model after one step of EM, with any number of sites in a sequence."""
    return _one_step(spark, sf_dir, em.Model("motif", *_model_arrays(), RATE))


@_query("WITH " + _m_step_sql(f"{_RATIOS}, n AS (SELECT *, {ONE_SHARE}::DOUBLE / count(*) OVER (PARTITION BY seq_id) * r AS g FROM r), z AS (SELECT seq_id, word, g / ({1 - ONE_SHARE}::DOUBLE + sum(g) OVER (PARTITION BY seq_id)) AS z FROM n)", "count(DISTINCT seq_id) FROM z"))
def m_step_none_or_one(spark, sf_dir):
    """The model after one step of EM, with at most one site in a sequence."""
    return _one_step(spark, sf_dir, em.Model("motif", *_model_arrays(), ONE_SHARE, spread=em.NONE_OR_ONE))


@_query("WITH " + _m_step_sql(f"{_RATIOS}, z AS (SELECT seq_id, word, r / sum(r) OVER (PARTITION BY seq_id) AS z FROM r)", "count(DISTINCT seq_id) FROM z").replace("round(zs / (SELECT count(DISTINCT seq_id) FROM z), 9)", "round(least(zs / (SELECT count(DISTINCT seq_id) FROM z), 1.0), 9)"))
def m_step_one(spark, sf_dir):
    """The model after one step of EM, with exactly one site in a sequence."""
    return _one_step(spark, sf_dir, em.Model("motif", *_model_arrays(), ONE_SHARE, spread=em.ONE))


@_query()
def batch_em(spark, sf_dir):
    """EM from the scan motif until it rests, over 50 passes at most: matrix, rate, and whether it rests."""
    return _models(spark, em.batch_em(sequences(spark, sf_dir), [em.Model("motif", *_model_arrays(), RATE)]))


@_query()
def online_em(spark, sf_dir):
    """Online EM by seeded mini-batches until it rests, over five passes at most."""
    return _models(spark, em.online_em(sequences(spark, sf_dir), [em.Model("motif", *_model_arrays(), RATE)]))


def _models(spark, models) -> DataFrame:
    rows = [(m.name, pos, *map(float, row), float(m.rate), m.rested) for m in models for pos, row in enumerate(m.theta)]
    return spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double, rate double, rested boolean")


@_query()
def motif_significance(spark, sf_dir):
    """E-value and information of the matrix that the hits of the scan give."""
    words = hit_words(spark, sf_dir).withColumn("motif", F.lit(MOTIF))
    counts = composition.count_matrix(words, ["motif"], len(MOTIF))
    total = sum((F.col(x) for x in "CGT"), F.col("A"))
    columns = composition.probability_matrix(counts.withColumn("nsites", total))
    starts = sequences(spark, sf_dir).agg(F.sum(F.greatest(F.length("seq") - len(MOTIF) + 1, F.lit(0))).alias("starts"))
    return significance.motif_significance(columns.join(F.broadcast(starts)), ["motif"], dict.fromkeys(LETTERS, 0.25), F.col("starts"))


@_query()
def dinuc_shuffle(spark, sf_dir):
    """Every sequence shuffled with its letter pairs kept."""
    return shuffling.shuffled(sequences(spark, sf_dir), seed=1)


@_query(f"WITH {_windows(2, known=False)}, p AS (SELECT seq_id, word, count(*) AS n FROM wins GROUP BY ALL), e AS (SELECT seq_id, coalesce(left(seq, 1), '') AS first, coalesce(right(seq, 1), '') AS last, length(seq) AS n FROM seqs) SELECT e.seq_id, e.n::INT AS letters, e.first, e.last, coalesce(string_agg(p.word || p.n, ',' ORDER BY p.word), '') AS pairs FROM e LEFT JOIN p ON e.seq_id = p.seq_id GROUP BY ALL")
def dinuc_shuffle_pairs(spark, sf_dir):
    """What a shuffle keeps of each sequence: its length, ends and pair counts (the SQL reads them from the sequences as they were)."""
    mixed = shuffling.shuffled(sequences(spark, sf_dir), seed=1)
    counted = windows.windows(mixed, 2, ["seq_id"]).groupBy("seq_id", "word").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("word", "n"))), ",").alias("pairs"))
    ends = mixed.select("seq_id", F.length("seq").alias("letters"), F.left("seq", F.lit(1)).alias("first"), F.right("seq", F.lit(1)).alias("last"))
    return ends.join(listed, "seq_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit("")))


@_query()
def seed_matrices(spark, sf_dir):
    """Weighted matrices of the clusters of enriched words."""
    return seeds.seed_matrices(seeds.numbered(enriched(spark, sf_dir)))


@_query(rf"WITH {SEQS} SELECT '>sequence' || seq_id || chr(10) || regexp_replace(seq, '(.{{60}})(.)', '\1' || chr(10) || '\2', 'g') AS value FROM seqs".replace(r"regexp_replace(seq, '(.{60})(.)', '\1' || chr(10) || '\2', 'g')", "(SELECT coalesce(string_agg(substr(seq, i + 1, 60), chr(10) ORDER BY i), '') FROM range(0, length(seq), 60) t(i))"))
def fasta_records(spark, sf_dir):
    """All sequences as wrapped FASTA records."""
    return fasta.fasta_text(sequences(spark, sf_dir).select("seq_id", F.concat(F.lit("sequence"), "seq_id").alias("name"), F.lit(None).cast("string").alias("info"), "seq"))


@_query(f"""WITH {_PROBS}, i AS (SELECT *, 2 + A * log2(A) + C * log2(C) + G * log2(G) + T * log2(T) AS info FROM pm), h AS (SELECT pos, unnest(['A', 'C', 'G', 'T']) AS letter, info * unnest([A, C, G, T]) AS height FROM i)
SELECT pos, letter, round(height, 6) AS height, row_number() OVER (PARTITION BY pos ORDER BY height, letter)::INT AS rank FROM h""")
def logo_heights(spark, sf_dir):
    return motifs.logo_heights(_probabilities(spark, sf_dir), []).select("pos", "letter", F.round("height", 6).alias("height"), "rank")


# --- statistics ------------------------------------------------------------------------------------


def _lf(x: str) -> str:
    return f"(CASE WHEN ({x}) < 2 THEN 0 WHEN ({x}) < 5 THEN CASE ({x})::INT WHEN 2 THEN ln(2) WHEN 3 THEN ln(6) ELSE ln(24) END ELSE ({x}) * ln({x}) - ({x}) + ln(2 * 3.14159::DOUBLE * ({x})) / 2 END)"


_HYPER = f"exp({_lf('marked')} + {_lf('pop - marked')} + {_lf('pop - drawn')} + {_lf('drawn')} - {_lf('pop')} - {_lf('marked - i')} - {_lf('i')} - {_lf('pop - marked - drawn + i')} - {_lf('drawn - i')})"


@_query(f"""WITH g AS (SELECT source, count(*)::DOUBLE AS drawn, count(*) FILTER (WHERE quality = 1)::DOUBLE AS hits FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT *, sum(drawn) OVER () AS pop, sum(hits) OVER () AS marked FROM g),
e AS (SELECT *, unnest(range(hits::BIGINT, least(drawn, marked)::BIGINT + 1))::DOUBLE AS i FROM t) SELECT source, drawn::BIGINT AS drawn, hits::BIGINT AS hits, round(sum({_HYPER}), 6) AS p FROM e GROUP BY source, drawn, hits""")
def hypergeom_pvalue(spark, sf_dir):
    """Over-representation of good documents in each source."""
    joined = _read(spark, sf_dir, "documents").select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    groups = joined.groupBy("source").agg(F.count(F.lit(1)).alias("drawn"), F.count_if(F.col("quality") == 1).alias("hits"))
    totals = groups.agg(F.sum("drawn").alias("population"), F.sum("hits").alias("marked"))
    p = stats.hypergeometric_tail(F.col("population"), F.col("drawn"), F.col("marked"), F.col("hits"))
    return groups.join(F.broadcast(totals)).select("source", "drawn", "hits", F.round(p, 6).alias("p"))


@_query("""WITH v AS (SELECT n_chars, quality = 1 AS own FROM documents JOIN labels USING (doc_id)), r AS (SELECT own, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk FROM v),
s AS (SELECT count(*) FILTER (WHERE own)::DOUBLE AS g, count(*)::DOUBLE AS n, sum(rk) FILTER (WHERE own) AS rs FROM r) SELECT g::BIGINT AS members, n::BIGINT AS population, round(rs, 3) AS rank_sum, round((g * (n + 1) / 2 - rs) / sqrt(g * (n - g) * (n + 1) / 12), 6) AS z FROM s""")
def mann_whitney(spark, sf_dir):
    """Whether good documents are longer or shorter."""
    joined = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    row = ordered.rank_sum(joined, "n_chars", F.col("quality") == 1)
    return row.select("members", "population", F.round("rank_sum", 3).alias("rank_sum"), F.round(stats.mann_whitney_z(F.col("members"), F.col("population"), F.col("rank_sum")), 6).alias("z"))


_KS_TERMS = " + ".join(f"{2 if j % 2 else -2} * exp(-2 * lam * lam * {j * j})" for j in range(1, 101))


@_query(f"""WITH b AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY 1),
c AS (SELECT abs(sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER ()) AS gap, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM b WINDOW w AS (ORDER BY v)),
d AS (SELECT max(gap) AS distance, any_value(np)::DOUBLE AS np, any_value(nn)::DOUBLE AS nn FROM c), l AS (SELECT *, sqrt(np * nn / (np + nn)) AS root FROM d), m AS (SELECT *, (root + 0.12 + 0.11 / root) * distance AS lam FROM l)
SELECT round(distance, 9) AS distance, np::BIGINT AS n_in, nn::BIGINT AS n_out, round(CASE WHEN lam < 0.04 THEN 1 ELSE {_KS_TERMS} END, 6) AS p FROM m""")
def ks_stat(spark, sf_dir):
    """Distance of price distributions between returned and other lines."""
    row = ordered.largest_gap(_read(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    effective = F.col("n_in") * F.col("n_out") / (F.col("n_in") + F.col("n_out"))
    return row.select(F.round("distance", 9).alias("distance"), "n_in", "n_out", F.round(stats.kolmogorov_p(F.col("distance"), effective), 6).alias("p"))


@_query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def pearson(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@_query("""WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM v) SELECT round(corr(rx, ry), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    return ordered.spearman(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"))


@_query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def pop_std_median(spark, sf_dir):
    q = "l_quantity"
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("deviation"), F.median(q).alias("median"), F.min(q).alias("least"), F.max(q).alias("most"))
