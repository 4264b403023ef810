"""FASTA and Swiss-Prot records as DataFrames, and back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import normalised
from strandloom.operators.ordered import running_totals

SCHEMA = "seq_id long, name string, info string, seq string"


def parse_records(lines: Iterator[str]) -> Iterator[tuple[int, str, str, str]]:
    """Number, name, description and letters of each FASTA record; ``*`` at word ends is dropped."""
    name, info, body, number = None, "", [], 0
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield number, name, info, "".join(body)
                number += 1
            info, body = line[1:], []
            name = info.split()[0] if info.split() else ""
        elif name is not None:
            body += [word.strip("*") for word in line.split()]
    if name is not None:
        yield number, name, info, "".join(body)


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    head = F.regexp_replace(F.col("value"), r"^>", "")
    lines = F.split(head, r"\r?\n")
    info = lines[0]
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.array_join(F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), lambda w: F.btrim(w, F.lit("*"))), ""))
    named = rows.where(F.trim("value") != "").select("file_path", "file_block_start", F.monotonically_increasing_id().alias("seq_id"), F.regexp_extract(info, r"^\s*(\S*)", 1).alias("name"), info.alias("info"), F.array_join(body, "").alias("seq"))
    return named


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, name, info, seq of the records of FASTA files of any size.

    Spark's text reader splits at ``>`` preceded by a line break, so large files are
    read in parallel; seq_id orders the records of a file's split."""
    return _records(spark, path).select("seq_id", "name", "info", "seq")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """The same with seq_id from 0 without gaps, by file, then by place in it, however the files are split."""
    rows = _records(spark, path).select(F.struct("file_path", "file_block_start", "seq_id").alias("at"), "name", "info", "seq", F.lit(1).alias("one"))
    return running_totals(rows, "at", ["one"]).select((F.col("upto_one") - 1).alias("seq_id"), "name", "info", "seq")


def checked(seqs: DataFrame, letters: str) -> DataFrame:
    """``seqs`` in upper case without ``*`` and ``.``; an error where other letters remain."""
    clean = F.translate(F.upper(F.regexp_replace("seq", r"\s", "")), "*.", "")
    legal = F.translate(clean, letters, "") == ""
    return seqs.withColumn("seq", F.when(legal, clean).otherwise(F.raise_error(F.concat(F.lit("illegal letter in "), F.col("name"))).cast("string")))


def unambiguous(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", normalised(F.col("seq")))


def first_of_each_name(seqs: DataFrame) -> DataFrame:
    """Records whose name did not occur before, as one aggregate (no window over a hot name)."""
    best = seqs.groupBy("name").agg(F.min("seq_id").alias("seq_id"))
    return seqs.join(best.select("seq_id"), "seq_id", "left_semi")


def weighted(seqs: DataFrame) -> DataFrame:
    """Sequences with ``weight`` from a record named WEIGHTS (numbers in file order), one where it has none.

    Sequences are numbered in range partitions that are shifted by those before them."""
    numbers = F.split(F.trim(F.regexp_replace("info", r"^\S+", "")), r"\s+")
    rows = seqs.where("name = 'WEIGHTS'").select(F.posexplode(numbers).alias("place", "w")).select("place", F.col("w").cast("double").alias("w"))
    rest = seqs.where("name is distinct from 'WEIGHTS'")
    placed = running_totals(rest.withColumn("__one", F.lit(1)), "seq_id", ["__one"]).withColumn("place", F.col("upto___one") - 1)
    weight = F.coalesce("w", F.lit(1.0))
    legal = F.when((weight > 0) & (weight <= 1), weight).otherwise(F.raise_error(F.lit("weights lie in (0, 1]")).cast("double"))
    return placed.join(rows, "place", "left").withColumn("weight", legal).select(*seqs.columns, "weight")


def sampled(seqs: DataFrame, share: float, seed: int = 0, key: str = "seq_id") -> DataFrame:
    """Each sequence with probability ``share``, decided by a hash of (seed, key), so that runs agree."""
    return seqs.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def load(seqs: DataFrame, letters: str | None = None, share: float = 1.0, seed: int = 0) -> DataFrame:
    """A data set of FASTA records: weights, letters checked, the first record of each name, a sample.

    An empty sequence is an error."""
    rows = weighted(seqs)
    rows = checked(rows, letters) if letters else rows
    rows = first_of_each_name(rows)
    rows = sampled(rows, share, seed) if share < 1 else rows
    return rows.withColumn("seq", F.when(F.length("seq") > 0, F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("empty sequence "), F.col("name"))).cast("string")))


def read_swissprot(spark: SparkSession, path: str) -> DataFrame:
    """Records of ID, DE and SQ lines that end with ``//``."""
    rows = spark.read.option("lineSep", "//\n").text(path)
    text = F.col("value")
    body = F.regexp_extract(text, r"(?s)\nSQ[^\n]*\n(.*)$", 1)
    described = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^DE\s+(.*)$"), 1), " ")
    out = rows.select(F.monotonically_increasing_id().alias("seq_id"), F.regexp_extract(text, r"(?m)^ID\s+(\S+)", 1).alias("name"), described.alias("info"), F.upper(F.regexp_replace(body, r"[\s0-9*.]", "")).alias("seq"))
    return out.where("name != ''")


def fasta_text(seqs: DataFrame, width: int = 60) -> DataFrame:
    """``value``: FASTA records wrapped at ``width`` letters."""
    wrapped = F.regexp_replace("seq", rf"(.{{{width}}})(?=.)", "$1\n")
    return seqs.select(F.concat(F.lit(">"), F.coalesce("info", "name"), F.lit("\n"), wrapped).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    """A folder of FASTA parts, one for each partition."""
    fasta_text(seqs, width).write.mode("overwrite").text(path)


def write_masked(positive: DataFrame, negative: DataFrame, folder: str, width: int = 0) -> None:
    """Both sets as FASTA folders under ``folder``, sequences named by their number (unwrapped if ``width`` is 0)."""
    for name, seqs in (("positive", positive), ("negative", negative)):
        named = seqs.select(F.concat(F.lit(">sequence"), F.col("seq_id") + 1, F.lit("\n"), F.col("seq")).alias("value"))
        rows = named if not width else fasta_text(seqs.select(F.concat(F.lit("sequence"), F.col("seq_id") + 1).alias("name"), F.lit(None).cast("string").alias("info"), "seq"), width)
        rows.write.mode("overwrite").text(f"{folder}/{name}")
