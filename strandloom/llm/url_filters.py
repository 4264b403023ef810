"""URL filters: host suffixes and path prefixes joined to rules by hash, all in DataFrame functions.

Each distinct (host, path) is expanded into host suffixes (of the numbers of labels that
rules have) times path prefixes (of the lengths that rules have).  The expansions meet the rules in
an equi-join on the first bytes of their SHA-256; the full digest then confirms,
and the longest rule wins.

Defined cases: a null url, or one without ``://``, has empty host and path and gets
the default verdict; a null page_id stays null; rows that repeat stay as they are;
of rules with the same host and path the first by verdict counts; among rules of equal length the
one with the longer host wins; hosts and paths of any length cost a row for each shape of
rule; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import attach, saved

#: Hexadecimal digits of the digest that the join compares.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest and its short prefix."""
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    full = _digest(F.concat("host", "path"))
    return rules.select(
        F.col("host").alias("rule_host"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), full.alias("rule_digest"), F.substring(full, 1, PREFIX_DIGITS).alias("short"), F.length("path").alias("path_length"), _labels("host").alias("labels")
    )


def _labels(host: str) -> Column:
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."), F.lit(""))) + 1


def expansions(urls: DataFrame, labels: list[int], path_lengths: list[int]) -> DataFrame:
    """Distinct (host, path) times its host suffixes and path prefixes of the given sizes."""
    suffixes = F.array_compact(F.array(*(F.when(_labels("host") >= n, F.substring_index("host", ".", -n)) for n in labels)))
    lengths = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    return urls.where(F.col("host") != "").withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    The lengths of rule paths and the label counts of rule hosts come to the driver;
    there are at most as many as a path has characters, and a host labels."""
    seen = saved(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    table = saved(rule_table(rules))
    lengths = sorted(r[0] for r in table.select("path_length").distinct().collect())
    labels = sorted(r[0] for r in table.select("labels").distinct().collect())
    key = F.concat_ws("\u0000", "host", "path").alias("__key")
    urls = saved(seen.groupBy("host", "path").count())
    full = _digest(F.concat("suffix", "prefix"))
    hashed = saved(expansions(urls, labels or [1], lengths or [0]).select("host", "path", "suffix", full.alias("digest")))
    # Every url of a top-level domain has one expansion in common: each meets the rules once, and is handed back by weight.
    keys = hashed.groupBy("digest").agg(F.first("suffix").alias("suffix"), F.count(F.lit(1)).alias("urls")).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    same = (keys["short"] == table["short"]) & (keys["digest"] == table["rule_digest"]) & (keys["suffix"] == table["rule_host"])
    ruled = saved(keys.join(table, same, "left").select("digest", "urls", "rule_host", "rule", "rule_verdict"))
    met = attach(hashed.select("host", "path", "digest"), ruled, "digest", "urls").where(F.col("rule").isNotNull())
    order = F.struct(F.length("rule"), F.length("rule_host"), "rule")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    verdicts = saved(urls.join(best, ["host", "path"], "left").select(key, "count", "best"))
    rows = seen.withColumn("__key", F.concat_ws("\u0000", "host", "path"))
    return attach(rows, verdicts, "__key", "count").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
