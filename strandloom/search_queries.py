"""Registered queries of the search for motifs (maxima, ranges of columns, starting points, weights, tiles) and their DuckDB twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from strandloom import queries as base
from strandloom.operators import em, scan, tiles
from strandloom.plans import discretise, starts
from strandloom.queries import LETTERS, MOTIF, RATE, RC, THRESHOLD, _query, sequences
from strandloom.storage import saved

WIDTH = len(MOTIF)
_NEAR = "PARTITION BY seq_id ORDER BY start RANGE BETWEEN"
_PEAKS = f"""{base._HITS}, near AS (SELECT *, max(score) OVER ({_NEAR} {WIDTH - 1} PRECEDING AND 1 PRECEDING) AS before, max(score) OVER ({_NEAR} 1 FOLLOWING AND {WIDTH - 1} FOLLOWING) AS after FROM scored),
peaks AS (SELECT seq_id, start, CASE WHEN ({base._BACKWARD}) > ({base._FORWARD}) + 1e-9 THEN {RC.format('word')} ELSE word END AS word, score FROM near WHERE coalesce(before < score, TRUE) AND coalesce(after <= score, TRUE))"""


def _model() -> em.Model:
    return em.Model("motif", *base._model_arrays(), RATE)


@_query(f"WITH {_PEAKS} SELECT seq_id, count(*) AS peaks, min(start) AS first, max(start) AS last, sum(start)::BIGINT AS places, round(max(score), 6) AS best FROM peaks GROUP BY seq_id")
def site_maxima(spark, sf_dir):
    """Local maxima of the scan motif's score in each sequence, all of them."""
    found = discretise.maxima(sequences(spark, sf_dir), _model())
    return found.groupBy("seq_id").agg(F.count(F.lit(1)).alias("peaks"), F.min("start").alias("first"), F.max("start").alias("last"), F.sum("start").alias("places"), F.round(F.max("score"), 6).alias("best"))


_CELLS = " + ".join(f"{4 * j + k + 1} * count(*) FILTER (WHERE substr(word, {j + 1}, 1) = '{x}') OVER r" for j in range(WIDTH) for k, x in enumerate(LETTERS))


@_query(f"WITH {_PEAKS} SELECT seq_id, start, row_number() OVER r AS rank, ({_CELLS})::BIGINT AS cells FROM peaks WHERE score > {THRESHOLD!r} WINDOW r AS (ORDER BY round(score, 9) DESC, seq_id, start)")
def ranked_maxima(spark, sf_dir):
    """Maxima above the Bayes threshold by rank, with a checksum of the letter counts over all up to each."""
    found = discretise.maxima(sequences(spark, sf_dir), _model()).where(F.col("score") > THRESHOLD)
    ranked = discretise.ranked_counts(found, WIDTH)
    cells = F.aggregate(F.transform("counts", lambda c, k: c * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return ranked.select("seq_id", "start", "rank", cells.alias("cells"))


_RATIO = " + ".join(f"CASE WHEN {x} > 0 THEN {x} * ln({x} / (0.25::DOUBLE * (A + C + G + T))) ELSE 0 END" for x in LETTERS)
#: Least width of a range of columns.
LEAST_WIDTH = 3


@_query(f"""WITH {base._COUNTS}, b AS (SELECT pos, -({_RATIO}) AS v FROM cm), p AS (SELECT pos, sum(v) OVER (ORDER BY pos) AS upto, v FROM b),
r AS (SELECT a.pos AS "offset", z.pos - a.pos + 1 AS width, z.upto - a.upto + a.v AS total FROM p a JOIN p z ON z.pos - a.pos + 1 >= {LEAST_WIDTH}),
s AS (SELECT "offset", width, round(total + ln(list_sum(list_transform(range(width), lambda k: CASE WHEN k = 0 THEN 1 ELSE exp(k * ln(-total) - lgamma(k + 1)) END))), 9) AS log_p FROM r)
SELECT "offset"::INT AS "offset", width::INT AS width, round(log_p, 5) AS log_p FROM s ORDER BY s.log_p, width, "offset" LIMIT 1""")
def best_column_range(spark, sf_dir):
    """The range of the scan motif's columns whose product is least likely, each column bounded by its likelihood ratio."""
    cells = [F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (F.lit(0.25) * (F.col("A") + F.col("C") + F.col("G") + F.col("T"))))).otherwise(0.0) for x in LETTERS]
    columns = base.count_matrix(spark, sf_dir).select(F.lit(0).alias("motif"), "pos", (-sum(cells[1:], cells[0])).alias("log_p"))
    return discretise.best_ranges(columns, ["motif"], LEAST_WIDTH).select("offset", "width", F.round("log_p", 5).alias("log_p"))


@_query()
def discretised_motif(spark, sf_dir):
    """The scan motif with a flat column at either end, after its best sites and columns are found: offset, sites, log E-value, matrix."""
    flat = np.full((1, 4), 0.25)
    theta, even = base._model_arrays()
    model = em.Model("motif", np.vstack([flat, theta, flat]), even, RATE)
    found = discretise.discretise(saved(sequences(spark, sf_dir).select("seq_id", "seq")), model, min_sites=2, min_width=4)
    rows = [(found.offset, found.nsites, float(found.log_evalue), j, *map(float, row)) for j, row in enumerate(found.model.theta)] if found else []
    return spark.createDataFrame(rows, "offset int, nsites long, log_evalue double, pos int, A double, C double, G double, T double")


_SOFT = f"""{base._HITS}, z0 AS (SELECT *, 1 / (1 + exp(-(score + {math.log(RATE / (1 - RATE))!r}::DOUBLE))) AS z FROM scored),
c AS (SELECT seq_id, start + unnest(range({WIDTH})) AS pos, z FROM z0), lost AS (SELECT seq_id, pos, max(z) AS z FROM c GROUP BY seq_id, pos),
pw AS (SELECT z0.seq_id, z0.start, z0.word, z0.score, min(1 - lost.z) AS weight FROM z0 JOIN lost ON lost.seq_id = z0.seq_id AND lost.pos BETWEEN z0.start AND z0.start + {WIDTH - 1} GROUP BY ALL),
z AS (SELECT CASE WHEN ({base._BACKWARD}) > ({base._FORWARD}) + 1e-9 THEN {RC.format('word')} ELSE word END AS word, 1 / (1 + exp(-(score + ln(greatest(weight, 1e-300)) + {math.log(RATE / (1 - RATE))!r}::DOUBLE))) AS z FROM pw)"""


@_query("WITH " + base._m_step_sql(_SOFT, "count(*) FROM z"))
def weighted_m_step(spark, sf_dir):
    """The scan motif after one step of EM in which letters weigh what the motif's own posteriors leave them."""
    model = _model()
    seqs = scan.softly_erased(sequences(spark, sf_dir).select("seq_id", "seq"), model)
    after = em.maximised(model, em.collected(em.expected_counts(seqs, [model], weights="weights"), [model])[0])
    return base._models(spark, [after]).select("pos", *(F.round(x, 6).alias(x) for x in LETTERS), F.round("rate", 9).alias("rate"))


#: Width of starting words, numbers of sites, and words kept of each.
START_WIDTH, START_SITES, STARTS = 6, [50, 500, 5000], 20
_SAME, _OTHER = math.log(0.7 / 0.25), math.log(0.1 / 0.25)


@_query(f"""WITH {base._windows(START_WIDTH)}, k AS MATERIALIZED (SELECT word, count(*) AS cnt FROM wins GROUP BY word),
both_ AS MATERIALIZED (SELECT word, sum(cnt) AS cnt FROM (SELECT word, cnt FROM k UNION ALL SELECT {RC.format('word')}, cnt FROM k WHERE {RC.format('word')} <> word) GROUP BY word),
f AS (SELECT a.word, sum(b.cnt) FILTER (WHERE hamming(a.word, b.word) = 0) AS n0, coalesce(sum(b.cnt) FILTER (WHERE hamming(a.word, b.word) = 1), 0) AS n1, coalesce(sum(b.cnt) FILTER (WHERE hamming(a.word, b.word) = 2), 0) AS n2
  FROM both_ a JOIN both_ b ON hamming(a.word, b.word) <= 2 WHERE a.word <= {RC.format('a.word')} GROUP BY a.word),
s AS (SELECT word, n AS nsites, least(n, n0) AS m0, least(greatest(n - n0, 0), n1) AS m1, least(greatest(n - n0 - n1, 0), n2) AS m2 FROM f, (SELECT unnest({START_SITES}) AS n)),
t AS (SELECT word, nsites, m0 + m1 + m2 AS matched, m0 * {START_WIDTH * _SAME!r}::DOUBLE + m1 * {(START_WIDTH - 1) * _SAME + _OTHER!r}::DOUBLE + m2 * {(START_WIDTH - 2) * _SAME + 2 * _OTHER!r}::DOUBLE + (nsites - m0 - m1 - m2) * {(START_WIDTH - 3) * _SAME + 3 * _OTHER!r}::DOUBLE AS score FROM s)
SELECT nsites::INT AS nsites, place::INT AS place, word, matched::BIGINT AS matched, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY nsites ORDER BY round(score, 9) DESC, word) AS place FROM t) WHERE place <= {STARTS}""")
def start_words(spark, sf_dir):
    """The best starting words of the sequences for several numbers of sites, among all their words."""
    found = starts.start_points(sequences(spark, sf_dir), START_WIDTH, START_SITES, STARTS)
    return found.select("nsites", "place", "word", F.col("matched").cast("long").alias("matched"), F.round("score", 5).alias("score"))


#: Motifs that tiles are chosen from, whole steps of their scores, and the p-value below which hits count.
TILE_WORDS, TILE_STEPS, TILE_P = (MOTIF, "CACGTGAC", "GGGCGGAA"), 20, 5e-4


def _tile_motifs() -> list[tiles.Scored]:
    return [tiles.scored_motif(w, [[math.log(p / 0.25) for p in row] for row in base.motif_matrix(w)], [0.25] * 4, TILE_STEPS) for w in TILE_WORDS]


def _whole_sql(steps: np.ndarray) -> str:
    return " + ".join(f"CASE substr(word, {j + 1}, 1) " + " ".join(f"WHEN '{x}' THEN {int(v)}" for x, v in zip(LETTERS, row, strict=True)) + " END" for j, row in enumerate(steps))


_TAILS = ", ".join(f"({m}, {s}, {float(p)!r}::DOUBLE)" for m, motif in enumerate(_tile_motifs()) for s, p in enumerate(motif.tail))
_TILE_SCORES = " UNION ALL ".join(f"SELECT seq_id, start, {m} AS m, '{motif.name}' AS motif, {_whole_sql(motif.steps)} AS one, {_whole_sql(motif.steps[::-1, ::-1])} AS two FROM wins" for m, motif in enumerate(_tile_motifs()))


@_query(f"""WITH RECURSIVE {base._windows(WIDTH)}, tails(m, s, p) AS (VALUES {_TAILS}), sc AS (SELECT seq_id, start, m, motif, greatest(one, two) AS s, CASE WHEN two > one THEN '-' ELSE '+' END AS strand FROM ({_TILE_SCORES})),
h AS (SELECT seq_id, list({{'start': start, 'm': m, 'motif': motif, 'strand': strand}} ORDER BY p, start, m) AS open_ FROM sc JOIN tails USING (m, s) WHERE p < {TILE_P} GROUP BY seq_id),
r AS (SELECT seq_id, open_[1] AS t, list_filter(open_[2:], lambda x: x.start >= open_[1].start + {WIDTH} OR x.start <= open_[1].start - {WIDTH}) AS open_ FROM h
  UNION ALL SELECT seq_id, open_[1] AS t, list_filter(open_[2:], lambda x: x.start >= open_[1].start + {WIDTH} OR x.start <= open_[1].start - {WIDTH}) AS open_ FROM r WHERE len(open_) > 0),
d AS (SELECT seq_id, string_agg(t.start || t.strand || t.motif, ' ' ORDER BY t.start) AS diagram FROM r GROUP BY seq_id),
b AS (SELECT seq_id, m, max(s) AS s FROM sc GROUP BY seq_id, m), l AS (SELECT b.seq_id, ln(-(exp((length(seqs.seq) - {WIDTH - 1}) * 2 * ln(1 - p)) - 1)) AS v FROM b JOIN tails USING (m, s) JOIN seqs ON seqs.seq_id = b.seq_id),
g AS (SELECT seq_id, sum(v) AS v, count(*) AS n FROM l GROUP BY seq_id)
SELECT seqs.seq_id, coalesce(diagram, '') AS diagram, round(coalesce(v + ln(CASE n WHEN 1 THEN 1 WHEN 2 THEN 1 - v ELSE 1 - v + v * v / 2 END), 0), 4) AS log_p FROM seqs LEFT JOIN d USING (seq_id) LEFT JOIN g ON g.seq_id = seqs.seq_id""")
def motif_tiles(spark, sf_dir):
    """Non-overlapping sites of three motifs in each sequence, by p-value, and the combined p-value of the sequence."""
    found = tiles.tiled(sequences(spark, sf_dir), _tile_motifs(), TILE_P)
    diagram = F.array_join(F.transform("tiles", lambda t: F.concat(t["start"].cast("string"), t["strand"], t["motif"])), " ")
    return found.select("seq_id", diagram.alias("diagram"), F.round("log_p", 4).alias("log_p"))
