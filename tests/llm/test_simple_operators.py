"""URL filters, exact dedup, mixing and token counts against brute force."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from conftest_llm import LOWER, TEXTS, WORD

from strandloom.llm import exact_dedup, mixing, token_counts, url_filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    "http://example.net/en/1", "https://A.Example.NET/en/x?q=/de/", "http://example.net/de/", "ftp://example.com/de/#x", "http://notexample.com/de/", "http://sub.example.com/de", "http://x.org/fr/a",
    None, "", "no scheme", "http://", "http://net/", "http://net", "x://y://net/", "http://a.net?x=/en/", "HTTP://B.ORG/FR/", "http://example.net./en/", "http://example.net/en/1",
]


def expected_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :] if at >= 0 else ""
    for c in "?#":
        path = path.split(c)[0]
    host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(k if k else None, u, "h", "r") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in url_filters.judge(pages, rules).collect())
    assert got == Counter((k if k else None, *expected_verdict(u)) for k, u in enumerate(URLS))
    assert url_filters.judge(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("keep,pick", [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, no_docs, keep, pick):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter()
    for i, t in TEXTS:
        key = (t or "").translate(LOWER)
        ids = [x for x in groups[key] if x is not None]
        best = pick(ids) if ids else None
        want[(i, best, len(groups[key]), hashlib.sha256(key.encode()).hexdigest())] += 1
    got = exact_dedup.duplicates(docs, keep).collect()
    assert Counter((*r[:3], r[4]) for r in got) == want
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert Counter(map(tuple, exact_dedup.duplicates(docs, keep, fan_in=3).collect())) == Counter(map(tuple, got))
    kept = exact_dedup.deduplicate(docs, keep)
    assert kept.columns == docs.columns
    assert Counter((r["text"] or "").translate(LOWER) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.duplicates(no_docs).collect() == [] and exact_dedup.deduplicate(no_docs).collect() == []


def filled(sizes, weights, epochs):
    """Targets by the repeated clamping that defines them."""
    total, held = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in held}
        level = (total - sum(held.values())) / sum(free.values()) if free else 0
        over = [s for s, w in free.items() if w * level > epochs * sizes[s]]
        if not over:
            return held | {s: w * level for s, w in free.items()}
        held |= {s: epochs * sizes[s] for s in over}


def check_mix(docs, rows, tolerance):
    got = mixing.mix(docs, 3, seed=7).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, 3)
    assert len(got) == len(rows)
    by_size = defaultdict(list)
    for r in got:
        assert r["taken"] == r["size"] * r["repeats"] and r["taken"] <= 3 * r["size"]
        by_size[r["source_size"], round(r["target"], 6)].append(r)
    assert set(by_size) == {(sizes[s], round(targets[s], 6)) for s in sizes}
    for (_, target), own in by_size.items():
        assert abs(sum(r["taken"] for r in own) - target) <= tolerance(own)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5), 3, seed=7).collect()))
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["repeats"]
    sampled = mixing.sample(docs, 3, seed=7)
    assert sampled.columns == docs.columns
    assert Counter(r["doc_id"] for r in sampled.collect()) == +taken


def test_mixing_table(table):
    docs = table("documents")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check_mix(docs, rows, lambda own: max(r["size"] for r in own) / 2 + 1)


def test_mixing_edge_cases(docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check_mix(docs, rows, lambda own: 2 * max(r["size"] for r in own) + 1)
    assert mixing.mix(no_docs).collect() == [] and mixing.sample(no_docs).collect() == []


def test_token_counts(docs, no_docs):
    import tiktoken

    from strandloom.llm.registry import BYTE_PATTERN, VOCABULARIES

    ranks = Path(VOCABULARIES / "byte_bpe_50k.tiktoken").read_bytes()
    encoder = token_counts.encoding(ranks, BYTE_PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    lengths = [len(encoder.encode_ordinary(t or "")) for _, t in TEXTS]
    got = token_counts.encoded_lengths(docs, ranks, BYTE_PATTERN)
    assert Counter(r["n_tokens"] for r in got.collect()) == Counter(lengths)
    sums = token_counts.suffix_sums(token_counts.length_histogram(got), block=7)
    for r in sums.collect():
        n = r["n_tokens"]
        assert (r["docs"], r["docs_over"], r["tokens_over"]) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert (r["total_tokens"], r["truncated_tokens"]) == (sum(lengths), sum(min(x, n) for x in lengths))
    limits = docs.sparkSession.createDataFrame([(0,), (3,), (50,), (10**6,)], "context_limit long")
    for r in token_counts.at_limits(sums, limits).collect():
        n = r["context_limit"]
        assert (r["docs_over"], r["truncated_tokens"]) == (sum(x > n for x in lengths), sum(min(x, n) for x in lengths))
    shares = docs.sparkSession.createDataFrame([(0.5,), (1.0,)], "share double")
    assert {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, shares).collect()}[1.0] == max(lengths)
    empty = token_counts.encoded_lengths(no_docs, ranks, BYTE_PATTERN)
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).collect() == []


def test_exact_dedup_of_ties(spark):
    rows = [(5, "Same", 1), (5, "SAME", 2), (None, "same", 3), (None, "n", 4), (None, "N", 5), (None, "n", 6), (7, "other", 7), (7, "n", 8)]
    made = spark.createDataFrame(rows, "doc_id long, text string, keep_row int").repartition(3)
    got = exact_dedup.duplicates(made).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]) == Counter({(5, 5, 3): 1, (7, 7, 4): 1, (7, 7, 1): 1})
    stay = exact_dedup.deduplicate(made.where("keep_row < 8"))
    assert Counter((r["doc_id"], r["text"].lower()) for r in stay.collect()) == Counter([(5, "same"), (None, "n"), (7, "other")])
    assert sorted(map(tuple, stay.collect()), key=str) == sorted(map(tuple, exact_dedup.deduplicate(made.where("keep_row < 8").repartition(5)).collect()), key=str)


def test_merged_runs_against_a_dictionary():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = [(bytes([7, 7, 7, 7, 7, 7, 7, 7]) if k % 3 else b"") + hashlib.sha256(bytes([k])).digest() for k in range(40)]
    keys = [k[:32] for k in keys]
    rows = [(int(rng.integers(0, 4)), keys[rng.integers(0, 40)], int(rng.integers(0, 2)), None if rng.random() < 0.3 else int(rng.integers(-5, 5)), n, 1) for n in range(600)]
    runs = []
    for origin in range(4):
        own = sorted((r for r in rows if r[0] == origin), key=lambda r: (r[1], r[2]))
        columns = list(zip(*own, strict=True))
        runs.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([(0,) * len(own), *columns], exact_dedup._KINDS, strict=True)], names=["part", "origin", "digest", "n_bytes", "keep_id", "keep_row", "group_size"]))
    for keep, sign in (("largest", -1), ("smallest", 1)):
        want = {}
        for _, digest, n, i, row, _ in rows:
            best, size = want.get((digest, n), (None, 0))
            mark = (i is None, sign * (i or 0), row)
            want[digest, n] = (min(best, mark) if best else mark, size + 1)
        got = exact_dedup.collapsed(runs, keep).to_pylist()
        assert [(r["digest"], r["n_bytes"]) for r in got] == sorted(want)
        assert all((r["keep_row"], r["group_size"]) == (want[r["digest"], r["n_bytes"]][0][2], want[r["digest"], r["n_bytes"]][1]) for r in got)


@pytest.mark.parametrize("unit", [" ", "\n", "\u3000", " \t", "x", "7", "#"])
def test_token_counts_of_very_long_runs(unit):
    from strandloom.llm.registry import BYTE_PATTERN, VOCABULARIES

    encoder = token_counts.encoding(Path(VOCABULARIES / "byte_bpe_50k.tiktoken").read_bytes(), BYTE_PATTERN)
    for before, after in (("", ""), ("word", "word"), ("a ", " 1"), ("#\n", "\n#"), ("x", "\n"), ("", "'s")):
        text = before + unit * 1500 + after + unit * 999 + "end" + unit * 2000
        assert token_counts.encoded_length(encoder, text) == len(encoder.encode_ordinary(text))
    assert token_counts.encoded_length(encoder, "a" + unit * 2_000_000 + "b") > 0


def test_mixing_of_null_and_repeated_identifiers(spark):
    rows = [(None, "one two three", "a") for _ in range(60)] + [(4, "w " * 5, "a") for _ in range(20)] + [(k, "x y", None) for k in range(40)] + [(None, None, None)] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    check_mix(made, rows, lambda own: max(r["size"] for r in own) / 2 + 1)


def test_url_filters_of_very_long_hosts_and_paths(spark):
    urls = ["http://" + "a." * 40_000 + "example.net/en/" + "x/" * 500_000, "http://" + "b" * 1_000_000 + ".org/fr/?" + "q" * 100_000, "http://" + "." * 5000 + "net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted(map(tuple, url_filters.judge(pages, rules).collect())) == [(k, *expected_verdict(u)) for k, u in enumerate(urls)]


def test_very_long_texts_in_dedup_and_mixing(spark):
    texts = [(k, unit * (2_000_000 // len(unit)), "s") for k, unit in enumerate((" ", "\n", "x", "#", "word ", "WORD "))]
    made = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3)
    kept = {r["doc_id"]: (r["kept"], r["group_size"]) for r in exact_dedup.duplicates(made).collect()}
    assert kept[4] == (False, 2) and kept[5] == (True, 2) and kept[0] == (True, 1)
    check_mix(made, texts, lambda own: max(r["size"] for r in own) + 1)


def test_suffix_sums_against_sql(table):
    import duckdb

    from strandloom.llm.registry import BYTE_PATTERN, VOCABULARIES

    docs = table("documents")
    ranks = Path(VOCABULARIES / "byte_bpe_50k.tiktoken").read_bytes()
    lengths = token_counts.encoded_lengths(docs, ranks, BYTE_PATTERN).toPandas()
    assert len(lengths)
    want = duckdb.sql("""WITH h AS (SELECT n_tokens, count(*) AS docs FROM lengths GROUP BY 1) SELECT n_tokens, docs,
        coalesce(sum(docs) OVER later, 0)::BIGINT AS docs_over, coalesce(sum(docs * n_tokens) OVER later, 0)::BIGINT AS tokens_over, (sum(docs * n_tokens) OVER ())::BIGINT AS total_tokens,
        (sum(docs * n_tokens) OVER () - coalesce(sum(docs * n_tokens) OVER later, 0) + coalesce(sum(docs) OVER later, 0) * n_tokens)::BIGINT AS truncated_tokens
        FROM h WINDOW later AS (ORDER BY n_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""").fetchall()
    spark = docs.sparkSession
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame(lengths)))
    assert sorted(tuple(r)[:6] for r in sums.collect()) == sorted(want)
