"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import conversation_trie, exact_dedup, hard_negatives, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_lattice, token_counts, url_filters

#: Folder of public vocabulary files.
VOCABULARIES = Path("/opt/tokenizers")
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Fixed values of the query: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS rn, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.rn, rules.host || rules.path AS rule, rules.verdict,
  row_number() OVER (PARTITION BY u.rn ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC, rules.host || rules.path DESC) AS k
  FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rn = m.rn AND m.k = 1
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _read(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, _read(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabularies: Path = VOCABULARIES) -> DataFrame:
    ranks = (vocabularies / "byte_bpe_50k.tiktoken").read_bytes()
    lengths = token_counts.encoded_lengths(_read(spark, sf_dir, "documents"), ranks, BYTE_PATTERN)
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_read(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(s) AS text_sha256 FROM t
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str, vocabularies: Path = VOCABULARIES) -> DataFrame:
    vocabulary = sentencepiece_lattice.Vocabulary.load(str(vocabularies / "piece_bpe_32k.model"))
    return sentencepiece_lattice.round_trip(_read(spark, sf_dir, "documents"), vocabulary)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), max_epochs=3, seed=7)


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  CAST('0x' || substr(sha256('7:' || key || ':' || (row_number() OVER (PARTITION BY key) - 1)), 1, 12) AS BIGINT) AS position
  FROM (SELECT *, sha256(concat_ws(':', (doc_id IS NULL)::VARCHAR, (source IS NULL)::VARCHAR, coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), coalesce(text, ''))) AS key FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free, sum(source_size) OVER ()::DOUBLE AS all_size
  FROM r WINDOW w AS (ORDER BY cap / weight RANGE BETWEEN UNBOUNDED PRECEDING AND 0 PRECEDING EXCLUDE GROUP)),
l AS (SELECT max((all_size - held) / free) FILTER (WHERE (all_size - held) / free > 0) AS level FROM c WHERE (all_size - held) / free <= cap / weight),
p AS (SELECT source, source_size, least(cap, weight * level) AS target FROM r, l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
z AS (SELECT *, greatest(target - whole * source_size, 0) AS part FROM q),
h AS (SELECT source, position >> 24 AS cell, sum(size) AS size FROM d GROUP BY ALL),
t AS (SELECT source, cell, size, sum(size) OVER (PARTITION BY source ORDER BY cell) AS through FROM h),
b AS (SELECT z.source, min_by(t.cell + CASE WHEN t.through - part < part - (t.through - t.size) THEN 1 ELSE 0 END, t.cell) AS cut
  FROM z JOIN t ON t.source IS NOT DISTINCT FROM z.source WHERE part > 0 AND t.through >= part GROUP BY z.source)
SELECT d.doc_id, d.size, z.source_size, z.target, z.whole + CASE WHEN (d.position >> 24) < coalesce(b.cut, 0) THEN 1 ELSE 0 END AS repeats,
  d.size * (z.whole + CASE WHEN (d.position >> 24) < coalesce(b.cut, 0) THEN 1 ELSE 0 END) AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"), k=3, percent=90)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rn, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS grams FROM d),
c AS (SELECT grams, min(doc_id) AS rep, len(grams) AS n, row_number() OVER () AS class FROM s WHERE len(grams) > 0 GROUP BY grams),
g AS (SELECT class, n, unnest(grams) AS gram FROM c),
links AS (SELECT a.class AS x, b.class AS y FROM g a JOIN g b ON a.gram = b.gram AND a.class <> b.class AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT class AS x, class AS y FROM c UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT r.x AS class, min(c.rep) AS component_id FROM reach r JOIN c ON c.class = r.y GROUP BY r.x)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.grams = c.grams LEFT JOIN least l ON l.class = c.class
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in rows)


OP9_SQL = rf"""
WITH tpl(template, label, is_exact, is_base, grams, k, place, gram) AS (VALUES {_values(license_scan.templates())}),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT rn, unnest(words) AS a, unnest(range(len(words))) AS pos FROM d),
l AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM w WINDOW o AS (PARTITION BY rn ORDER BY pos)),
g AS (SELECT rn, pos, a || ' ' || b AS gram FROM l WHERE b IS NOT NULL UNION ALL SELECT rn, pos, a || ' ' || b || ' ' || c || ' ' || e AS gram FROM l WHERE e IS NOT NULL),
v AS (SELECT rn, template, label, is_exact, is_base, grams, k, pos - place AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high FROM g JOIN tpl USING (gram) GROUP BY ALL),
r AS (SELECT *, CASE WHEN is_exact OR diagonal - lag(diagonal) OVER o > {license_scan.SLACK} THEN 1 ELSE 0 END AS opens FROM v WINDOW o AS (PARTITION BY rn, template ORDER BY diagonal)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY rn, template ORDER BY diagonal) AS run FROM r),
m AS (SELECT rn, template, label, is_exact, is_base, grams, k, run, sum(votes) AS votes, min(diagonal) AS start, max(high) - min(low) + any_value(k) AS extent FROM s GROUP BY ALL),
f AS (SELECT *, least(votes / grams, 1.0::DOUBLE) AS share, CASE WHEN is_exact THEN votes = grams ELSE least(votes / grams, 1.0::DOUBLE) >= CASE WHEN k = {license_scan.LONG} THEN {license_scan.LONG_SHARE} ELSE {license_scan.MIN_SHARE} END AND extent <= {license_scan.MAX_STRETCH} * (grams + k - 1) END AS found FROM m),
t AS (SELECT rn, count(*) FILTER (WHERE found AND is_base) AS n_base, min(start) FILTER (WHERE found AND is_base) AS first_word, max(start) FILTER (WHERE found AND is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found AND is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found) AS labels, max(share) AS score FROM f GROUP BY rn)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN t USING (rn)
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a digest in place of the string itself."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(_read(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.with_shared_heads(turns, family=5, heads=9))


#: crc32 bit by bit: a byte enters with the first of its eight steps.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS place, content, strlen(text) AS bytes FROM (SELECT *, sha256(strlen(role) || ':' || role || text) AS content FROM t)),
n AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 9 AS h FROM p GROUP BY conv_id),
l AS (SELECT a.*, least(a.h, coalesce(b.n, 0)) AS taken FROM n a LEFT JOIN n b ON a.base = b.conv_id),
r AS (SELECT l.conv_id, p.place AS depth, p.content, p.bytes FROM l JOIN p ON p.conv_id = l.base AND p.place <= l.taken UNION ALL
  SELECT l.conv_id, p.place - l.h + l.taken, p.content, p.bytes FROM l JOIN p ON p.conv_id = l.conv_id AND p.place > l.h),
q AS (SELECT conv_id, depth, bytes, string_agg(content, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM l),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, seq) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM q),
v AS (SELECT node, depth, any_value(bytes) AS bytes, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY node, depth),
up AS (SELECT v.node, v.depth, m.node AS parent FROM v LEFT JOIN m ON m.conv_id = v.node AND m.depth = v.depth - 1),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
w AS (SELECT v.*, up.parent, coalesce(n_children, 0) AS n_children FROM v JOIN up USING (node, depth) LEFT JOIN kids ON kids.parent = v.node AND kids.depth = v.depth),
below AS (SELECT m.node, m.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes) AS saved_tokens FROM w JOIN m ON m.conv_id = w.node AND m.depth <= w.depth GROUP BY m.node, m.depth)
SELECT w.node AS conv_id, w.depth::BIGINT AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256 FROM w JOIN below b USING (node, depth)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), every=100, n_positives=5, n_negatives=5, percent=80, scale=256)


OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rn, a.vec_id AS anchor_id, b.vec_id, b.rn AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.rn <> b.rn),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.rn, p.other ORDER BY n.score DESC, n.vec_id, n.other))::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.rn = p.rn AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score QUALIFY rank <= 5
"""


#: Fixed value of the query: the token after each document.
END_TOKEN = 2


def op13_packing(spark: SparkSession, sf_dir: str, vocabularies: Path = VOCABULARIES) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), str(vocabularies / "word_bpe_49k.json"), END_TOKEN, capacity=4096)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_quality_classifier, op3_quality_rules, op4_token_counts, op5_exact_dedup, op6_sentencepiece, op7_mixing, op8_ngram_join, op9_license_scan, op10_secret_scan, op11_conversation_trie, op12_hard_negatives, op13_packing)
}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op7_mixing": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_license_scan": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
