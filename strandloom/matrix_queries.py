"""Registered queries of motif matrices, alignments and small functions, and their DuckDB twins.

Matrices are those of ``weighted_pfm``: one for each gap of the enriched words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import queries as base
from strandloom.functions import sequences as S
from strandloom.functions import windows
from strandloom.operators import alignment, composition, em, priors, transforms
from strandloom.plans import seeds
from strandloom.queries import LETTERS, MOTIF, RATE, _query, _read, sequences
from strandloom.sources import motifs
from strandloom.storage import saved

EVEN = dict.fromkeys(LETTERS, 0.25)
#: Sites and pseudo-count of the scores, bits of a trim, share of the information.
SITES, PSEUDO, BITS, PERCENT, STEPS = 20, 5.0, 0.9, 50.0, 100

_SUMS = base.ORACLE_SQL["weighted_pfm"].removeprefix("WITH ").rsplit("\nSELECT ", 1)[0]
_PF = f"{_SUMS}, pf AS (SELECT gap::INT AS gap, pos::INT AS pos, " + ", ".join(f"{x} / (A + C + G + T) AS {x}" for x in LETTERS) + " FROM s)"
_SCORES = f"{_PF}, sc AS (SELECT gap, pos, " + ", ".join(f"100 * log2(({x} * {SITES} + {PSEUDO * 0.25}) / {SITES + PSEUDO} / 0.25) AS {x}" for x in LETTERS) + " FROM pf)"


def _pfm(spark, sf_dir) -> DataFrame:
    members = base.enriched(spark, sf_dir).select("gap", F.col("word").alias("aligned"), F.col("z_corrected").alias("weight"))
    return saved(composition.weighted_pfm(members, ["gap"]).drop("letter"))


def _scores(spark, sf_dir) -> DataFrame:
    return transforms.scores_of(_pfm(spark, sf_dir), EVEN, SITES, PSEUDO)


def _rounded(rows: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    return rows.select(*keys, *(F.round(x, places).alias(x) for x in LETTERS))


_CELLS = ", ".join(f"round({x}, 6) AS {x}" for x in LETTERS)


@_query(f"WITH {_PF} SELECT gap, (max(pos) OVER (PARTITION BY gap) - pos)::INT AS pos, round(T, 6) AS A, round(G, 6) AS C, round(C, 6) AS G, round(A, 6) AS T FROM pf")
def motif_revcomp(spark, sf_dir):
    return _rounded(transforms.reverse_complement(_pfm(spark, sf_dir), ["gap"]), "gap", "pos")


@_query(f"WITH {_SCORES} SELECT gap, pos, {_CELLS} FROM sc")
def motif_scores(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), "gap", "pos")


@_query(f"WITH {_SCORES}, f AS (SELECT gap, pos, " + ", ".join(f"greatest(0, least(1, (pow(2, {x} / 100) * 0.25 * {SITES + PSEUDO} - {PSEUDO * 0.25}) / {SITES})) AS {x}" for x in LETTERS) + " FROM sc) SELECT gap, pos, " + ", ".join(f"round({x} / (A + C + G + T), 6) AS {x}" for x in LETTERS) + " FROM f")
def motif_frequencies(spark, sf_dir):
    """Frequencies that scores give back."""
    return _rounded(transforms.frequencies_of(_scores(spark, sf_dir), EVEN, SITES, PSEUDO), "gap", "pos")


_INFO = "(" + " + ".join(f"{x} * log2({x} / 0.25)" for x in LETTERS) + ")"


@_query(f"WITH {_PF}, i AS (SELECT gap, pos, {_INFO} AS h FROM pf), e AS (SELECT gap, min(pos) FILTER (WHERE h >= {BITS}) AS f, max(pos) FILTER (WHERE h >= {BITS}) AS l, count(*) AS w FROM i GROUP BY gap) SELECT gap, coalesce(f, w)::INT AS trim_left, coalesce(w - 1 - l, 0)::INT AS trim_right FROM e")
def motif_trims(spark, sf_dir):
    return transforms.trims(_pfm(spark, sf_dir), ["gap"], BITS)


@_query(f"WITH {_PF}, m AS (SELECT *, " + ", ".join(f"avg({x}) OVER (PARTITION BY gap) AS m{x}" for x in LETTERS) + f" FROM pf) SELECT gap, round(avg({' + '.join(f'{x} * ln({x} / m{x})' for x in LETTERS)}), 6) AS complexity FROM m GROUP BY gap")
def motif_complexity(spark, sf_dir):
    return transforms.complexity(_pfm(spark, sf_dir), ["gap"]).select("gap", F.round("complexity", 6).alias("complexity"))


@_query(f"WITH {_PF}, i AS (SELECT gap, pos, {_INFO} AS h FROM pf), r AS (SELECT gap, sum(h) OVER (PARTITION BY gap ORDER BY pos) AS upto, sum(h) OVER (PARTITION BY gap) AS total, row_number() OVER (PARTITION BY gap ORDER BY pos) AS n FROM i) SELECT gap, coalesce(min(n) FILTER (WHERE 100 * upto >= {PERCENT} * total), max(n))::INT AS columns FROM r GROUP BY gap")
def motif_information_position(spark, sf_dir):
    return transforms.information_position(_pfm(spark, sf_dir), ["gap"], EVEN, PERCENT)


@_query(f"WITH {_PF} SELECT gap, string_agg(CASE WHEN T >= A AND T >= C AND T >= G THEN 'T' WHEN G >= A AND G >= C THEN 'G' WHEN C >= A THEN 'C' ELSE 'A' END, '' ORDER BY pos) AS word FROM pf GROUP BY gap")
def motif_best_match(spark, sf_dir):
    return transforms.best_match(_pfm(spark, sf_dir), ["gap"])


_AMBIGUOUS = {code: members for code, members in S.IUPAC.items() if len(members) > 1}


@_query(f"WITH {_PF} SELECT gap, pos, " + ", ".join(f"round({' + '.join(m)}, 6) AS sum_{c}" for c, m in _AMBIGUOUS.items()) + " FROM pf")
def motif_ambiguity(spark, sf_dir):
    rows = transforms.with_ambiguous(_pfm(spark, sf_dir))
    return rows.select("gap", "pos", *(F.round(c, 6).alias(f"sum_{c}") for c in _AMBIGUOUS))


@_query(f"WITH {_SCORES}, e AS (SELECT *, min(least(A, C, G, T)) OVER g AS low, max(greatest(A, C, G, T)) OVER g AS high FROM sc WINDOW g AS (PARTITION BY gap)) SELECT gap, pos, " + ", ".join(f"round_even(({x} - low) * round({STEPS} / (high - low), 14), 0) AS {x}" for x in LETTERS) + ", round(low, 6) AS lowest FROM e")
def motif_scaled_scores(spark, sf_dir):
    rows = transforms.scaled(_scores(spark, sf_dir), ["gap"], STEPS)
    return rows.select("gap", "pos", *LETTERS, F.round("offset", 6).alias("lowest"))


_MEAN = "(A + C + G + T) / 4"


@_query(f"""WITH {_SCORES}, c AS (SELECT gap, pos, {", ".join(f"{x} - {_MEAN} AS c{x}" for x in LETTERS)}, count(*) OVER (PARTITION BY gap) AS w FROM sc),
r AS (SELECT a.gap AS one, b.gap AS two, a.pos - b.pos AS off, least(a.w, b.w) AS w, sum(CASE WHEN {" + ".join(f"a.c{x} * a.c{x}" for x in LETTERS)} = 0 OR {" + ".join(f"b.c{x} * b.c{x}" for x in LETTERS)} = 0 THEN 1.0 ELSE ({" + ".join(f"a.c{x} * b.c{x}" for x in LETTERS)}) / sqrt(({" + ".join(f"a.c{x} * a.c{x}" for x in LETTERS)}) * ({" + ".join(f"b.c{x} * b.c{x}" for x in LETTERS)})) END) AS r FROM c a JOIN c b ON a.gap > b.gap GROUP BY ALL)
SELECT one, two, round(max(r / w), 5) AS correlation FROM r GROUP BY one, two""")
def motif_correlation(spark, sf_dir):
    return transforms.correlations(_scores(spark, sf_dir), "gap").select("one", "two", F.round("correlation", 5).alias("correlation"))


@_query(base.ORACLE_SQL["markov_conditional"].rsplit(" SELECT ", 1)[0] + ", x AS (SELECT unnest(CASE length(tuple) WHEN 1 THEN [tuple, 'X'] WHEN 2 THEN [tuple, 'X' || right(tuple, 1), left(tuple, 1) || 'X', 'XX'] ELSE [a || b || c for a in [substr(tuple, 1, 1), 'X'] for b in [substr(tuple, 2, 1), 'X'] for c in [substr(tuple, 3, 1), 'X']] END) AS tuple, prob FROM mk) SELECT tuple, round(sum(prob), 9) AS prob FROM x GROUP BY tuple".replace("[a || b || c for a in [substr(tuple, 1, 1), 'X'] for b in [substr(tuple, 2, 1), 'X'] for c in [substr(tuple, 3, 1), 'X']]", "[" + ", ".join(" || ".join(f"substr(tuple, {k + 1}, 1)" if mask >> k & 1 else "'X'" for k in range(3)) for mask in range(8)) + "]"))
def markov_x_tuples(spark, sf_dir):
    """Tuple probabilities where X stands for any letter."""
    return composition.x_tuples(composition.markov_probabilities(base.markov_counts(spark, sf_dir))).select("tuple", F.round("prob", 9).alias("prob"))


@_query(base.ORACLE_SQL["markov_conditional"].rsplit(" SELECT ", 1)[0] + f" SELECT a.tuple, round((a.prob + coalesce(b.prob, 0)) / 2, 9) AS prob FROM mk a LEFT JOIN mk b ON b.tuple = {base.RC.format('a.tuple')}")
def markov_both_strands(spark, sf_dir):
    """Tuple probabilities averaged with those of the reverse complement."""
    table = composition.markov_probabilities(base.markov_counts(spark, sf_dir))
    return composition.averaged_strands(table).select("tuple", F.round("prob", 9).alias("prob"))


#: Mixture of priors over the columns of a motif: share and alphas (A, C, G, T) of each component.
PRIORS = [(0.6, [2.0, 0.3, 0.3, 0.3]), (0.3, [0.3, 2.0, 2.0, 0.3]), (0.1, [1.5, 1.5, 1.5, 1.5])]
_LIB = ", ".join(f"({m}::DOUBLE, {', '.join(f'{a}::DOUBLE' for a in alpha)})" for m, alpha in PRIORS)
_LL = "ln(mix) + lgamma(A + C + G + T + 1) + lgamma(pA + pC + pG + pT) - lgamma(A + C + G + T + pA + pC + pG + pT)" + "".join(f" + lgamma({x} + p{x}) - lgamma({x} + 1) - lgamma(p{x})" for x in LETTERS)


@_query(f"WITH {base._COUNTS}, lib(mix, pA, pC, pG, pT) AS (VALUES {_LIB}), p AS (SELECT *, {_LL} AS ll FROM cm, lib), w AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY pos)) AS w FROM p) SELECT pos, " + ", ".join(f"round(sum(w * p{x}) / sum(w), 6) AS {x}" for x in LETTERS) + " FROM w GROUP BY pos")
def mixture_pseudocounts(spark, sf_dir):
    """Prior counts of each column of the scan's hits under a mixture of priors."""
    library = spark.createDataFrame([(k, m, alpha) for k, (m, alpha) in enumerate(PRIORS)], "component int, mixture double, alpha array<double>")
    return _rounded(priors.pseudo_counts(base.count_matrix(spark, sf_dir), [], library), "pos")


def _steps() -> list[list[int]]:
    """The scan motif's log-odds in whole steps from 0."""
    odds = np.array(base.motif_odds())
    return np.rint((odds - odds.min()) * (STEPS / (odds.max() - odds.min()))).astype(int).tolist()


def _step_sql(word: str, reverse: bool) -> str:
    rows = [r[::-1] for r in _steps()[::-1]] if reverse else _steps()
    return " + ".join(f"CASE substr({word}, {j + 1}, 1) " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in zip(LETTERS, row, strict=True)) + " END" for j, row in enumerate(rows))


_ANY_WORD = "SELECT " + " || ".join(f"l{k}.x" for k in range(len(MOTIF))) + " AS w FROM " + ", ".join(f"l l{k}" for k in range(len(MOTIF)))


@_query(f"WITH {base._ORIENTED}, l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x), a AS ({_ANY_WORD}), t AS (SELECT {_step_sql('w', False)} AS s, count(*) / {4 ** len(MOTIF)} AS p FROM a GROUP BY 1), u AS (SELECT seq_id, start, {_step_sql('word', False)} AS steps FROM sites) SELECT u.seq_id, u.start, u.steps::BIGINT AS steps, round(sum(t.p), 12) AS p FROM u JOIN t ON t.s >= u.steps GROUP BY ALL")
def site_pvalues(spark, sf_dir):
    """Sites with the probability that a random word scores as high, in whole steps of the motif's scores."""
    steps = _steps()
    tail = transforms.score_tail(steps, [0.25] * 4).tolist()  # one number for each whole score
    letters = [F.element_at(F.create_map(*(F.lit(v) for pair in zip(LETTERS, row, strict=True) for v in pair)), F.substring("word", j + 1, 1)) for j, row in enumerate(steps)]
    table = F.broadcast(spark.createDataFrame(list(enumerate(tail)), "steps long, p double"))
    scored = base.hit_words(spark, sf_dir).select("seq_id", "start", sum(letters[1:], letters[0]).cast("long").alias("steps"))
    return scored.join(table, "steps").select("seq_id", "start", "steps", F.round("p", 12).alias("p"))


@_query("WITH h AS (SELECT greatest(0, least(19, floor(l_extendedprice / 5000)))::INT AS bin, l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL) SELECT bin, count(*) AS count, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation FROM h GROUP BY bin")
def price_histogram(spark, sf_dir):
    rows = transforms.histogram(_read(spark, sf_dir, "lineitem"), "l_extendedprice", 20, 0.0, 100_000.0)
    return rows.select("bin", "count", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@_query(f"WITH {base._HITS} SELECT count(*) AS windows, round(sum(ln({RATE}::DOUBLE * exp(score) + {1 - RATE}::DOUBLE)), 3) AS log_likelihood, count(DISTINCT seq_id) AS sequences FROM scored")
def expected_log_likelihood(spark, sf_dir):
    row = em.expected_counts(sequences(spark, sf_dir), [em.Model("motif", *base._model_arrays(), RATE)])
    return row.select("windows", F.round("log_likelihood", 3).alias("log_likelihood"), "sequences")


@_query(f"WITH {base._windows(8)} SELECT seq_id, count(*) AS windows, min(start)::INT AS first, max(start)::INT AS last FROM wins GROUP BY seq_id")
def known_windows(spark, sf_dir):
    rows = windows.known_windows(sequences(spark, sf_dir), 8, ["seq_id"])
    return rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("first"), F.max("start").alias("last"))


_MEMBER_SQL = "MAP {" + ", ".join(f"'{c}': '{m}'" for c, m in S.IUPAC.items() if c not in "BDHV") + "}"


@_query(f"WITH {base._PREFIX}, w AS (SELECT DISTINCT word FROM marked WHERE ok), c AS (SELECT word, j::INT AS pos, {_MEMBER_SQL}[substr(word, j + 1, 1)] AS m FROM w, range({base._FULL}) t(j) WHERE j < length(word)) SELECT word, pos, " + ", ".join(f"round((CASE WHEN contains(m, '{x}') THEN 1.0::DOUBLE / length(m) ELSE 0 END + 0.01) / 1.04, 4) AS {x}" for x in LETTERS) + " FROM c")
def word_matrices(spark, sf_dir):
    """The matrix of each enriched word by itself."""
    return composition.word_pfm(base.enriched(spark, sf_dir).select("word").distinct())


_NAME = "upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))"


@_query(f"""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, {_NAME} AS u, floor(log10(p_retailprice * 1.0007::DOUBLE)) AS ex, round(pow(10, log10(p_retailprice * 1.0007::DOUBLE) - floor(log10(p_retailprice * 1.0007::DOUBLE))), 1) AS mant FROM part), m AS (SELECT p_partkey, count(*) FILTER (WHERE substr(upper(p_name), i + 1, 1) = substr(upper(p_brand), i + 1, 1)) AS same FROM p, range(200) t(i) WHERE i < least(length(p_name), length(p_brand)) GROUP BY p_partkey)
SELECT p.p_partkey, reverse(translate(p_name, 'ACGTacgtRYKMBDHV', 'TGCAtgcaYRMKVHDB')) AS turned, coalesce(same, 0)::INT AS same, regexp_matches(u, '^[ACGT]+$') AS dna, (-p_size - trunc(-p_size / 7.0) * 7)::INT AS remainder,
substr(p_name, 2, 3) AS site, array_to_string(list_transform(string_split(u, ''), lambda c: (instr('ACGT', c) - 1)::VARCHAR), ',') AS codes, printf('%.1fe%+04d', CASE WHEN mant >= 10 THEN 1.0 ELSE mant END, (ex + CASE WHEN mant >= 10 THEN 1 ELSE 0 END)::INT) AS number FROM p LEFT JOIN m USING (p_partkey)""")
def string_functions(spark, sf_dir):
    """Small column functions over part names: reverse complement with case, identity, alphabet test, remainder, site, letter codes, log numbers."""
    part = _read(spark, sf_dir, "part")
    name = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    return part.select(
        "p_partkey", S.revcomp_cased(F.col("p_name")).alias("turned"), S.matches(F.col("p_name"), F.col("p_brand")).alias("same"), S.is_over(name, "ACGT").alias("dna"),
        S.truncating_mod(-F.col("p_size"), F.lit(7)).cast("int").alias("remainder"), S.site(F.col("p_name"), F.lit(1), 3).alias("site"), F.array_join(S.codes(name).cast("array<string>"), ",").alias("codes"),
        S.log_number(F.log(F.col("p_retailprice") * 1.0007)).alias("number"),
    )


_CODES_OF = f"upper(translate(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '{base.string.ascii_uppercase}', '{base._IUPAC_LETTERS}'))"
_ALL_MEMBERS = "MAP {" + ", ".join(f"'{c}': '{m}'" for c, m in S.IUPAC.items()) + "}"


@_query(f"""WITH t AS (SELECT unnest(string_split('{S.CODON_LETTERS}', '')) AS aa, unnest(range(64)) AS i), codons AS (SELECT aa, {" || ".join(f"substr('{S.CODON_BASES}', (i // {4 ** (2 - k)}) % 4 + 1, 1)" for k in range(3))} AS codon FROM t),
c AS (SELECT DISTINCT substr(code, i + 1, 3) AS codon FROM (SELECT code, unnest(range(0, length(code) - 2, 3)) AS i FROM (SELECT {_CODES_OF} AS code FROM part))), x AS (SELECT c.codon, d.aa FROM c JOIN codons d ON {" AND ".join(f"contains({_ALL_MEMBERS}[substr(c.codon, {k}, 1)], substr(d.codon, {k}, 1))" for k in (1, 2, 3))})
SELECT codon, CASE WHEN count(DISTINCT aa) = 1 THEN min(aa) ELSE 'X' END AS amino FROM x GROUP BY codon""")
def ambiguous_codons(spark, sf_dir):
    """Amino acids of all ambiguous codons of part names, in frame 0."""
    code = F.translate(F.regexp_replace(F.upper("p_name"), "[^A-Z]", ""), base.string.ascii_uppercase, base._IUPAC_LETTERS)
    named = _read(spark, sf_dir, "part").select(code.alias("code")).where(F.length("code") >= 3)
    codons = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 2, F.lit(3)), lambda i: F.substring(F.col("code"), i, F.lit(3)))).alias("codon")).distinct()
    return codons.select("codon", S.ambiguous_amino_acid(F.col("codon")).alias("amino"))


_EDGES = f"""WITH {base._PREFIX}, named AS (SELECT row_number() OVER (ORDER BY gap, z DESC, word) - 1 AS id, word FROM marked WHERE ok),
turned AS (SELECT id, '+' AS strand, word AS w FROM named UNION ALL SELECT id, '-', {base.RC.format("word")} FROM named),
cells AS (SELECT id, strand, length(w) AS n, j::INT AS pos, substr(w, j + 1, 1) AS x FROM turned, range({base._FULL}) t(j) WHERE j < length(w) AND substr(w, j + 1, 1) <> 'N'),
sums AS (SELECT a.id AS id_a, b.id AS id_b, b.strand, a.pos - b.pos AS off, round(sum(CASE WHEN a.x = b.x THEN 1.0::DOUBLE ELSE -1.0::DOUBLE / 3 END) / any_value(least(a.n, b.n)), 9) AS sim FROM cells a JOIN cells b ON a.id < b.id AND a.strand = '+' GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY id_a, id_b ORDER BY sim DESC, strand, off) AS k FROM sums)
SELECT id_a, id_b, round(1 - sim, 6) AS dist, strand, off FROM best WHERE k = 1 AND round(1 - sim, 9) <= 0.3"""


@_query(_EDGES)
def pair_similarity_edges(spark, sf_dir):
    """Edges between enriched words within the distance threshold."""
    edges = seeds.similarity_edges(saved(seeds.numbered(base.enriched(spark, sf_dir))).select("id", "word"))
    return edges.select("id_a", "id_b", F.round("dist", 6).alias("dist"), "strand", "off")


@_query()
def motif_alignment(spark, sf_dir):
    """Each sequence aligned to the scan motif with gaps: score, the columns that have a place, and the first one."""
    found = alignment.alignments(sequences(spark, sf_dir), base.motif_odds())
    placed = F.filter("places", lambda p: p >= 0)
    return found.select("seq_id", F.round("score", 6).alias("score"), F.size(placed).alias("placed"), F.coalesce(F.array_min(placed), F.lit(-1)).alias("first"))


@_query()
def motif_file_text(spark, sf_dir):
    """The matrix of the scan's hits, with its E-value, as the text of a motif file's block."""
    hits = base.hit_words(spark, sf_dir).withColumn("motif", F.lit("M1"))
    columns = composition.probability_matrix(composition.count_matrix(hits, ["motif"], len(MOTIF)).withColumn("nsites", F.col("A") + F.col("C") + F.col("G") + F.col("T")))
    value = base.motif_significance(spark, sf_dir).select("log_evalue")  # one row
    return motifs.motif_block_text(columns.withColumn("alt", F.lit(MOTIF)).join(F.broadcast(value)))
