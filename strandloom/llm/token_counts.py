"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Documents are encoded once; only their lengths are aggregated.  The suffix sums
then answer, for every context limit, how many documents and tokens lie above it
and how many tokens remain if texts are cut there; quantiles come from the same
rows.  Suffix sums run in two levels (blocks of lengths, then lengths in a block),
so no task sees the whole histogram.

Defined cases: a null or empty text has length 0; null doc_ids stay; repeated rows
count as often as they occur, and texts of one length share its row; special-token strings
in a text are ordinary text; a very long text is encoded whole by one task, also with runs
of white space, letters or symbols of any length (``cut_runs``); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import saved

#: Lengths of one block of the histogram.
BLOCK = 256


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """A byte-level encoder from the text of a rank file (base64 token, rank)."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: White space as the split pattern has it, and the length from which a run of it is cut out.
_SPACES, LONG_RUN = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", 1000
_LONG_RUN = re.compile(f"{_SPACES}{{{LONG_RUN},}}")


def cut_runs(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of a text that encode on their own, and whether a part is a single unit of the split pattern.

    The pattern takes a run of white space up to its last character as one unit (the whole
    run at the text's end), and that last character opens the next unit.  Looking for
    the end of a very long run would exhaust the pattern engine's stack."""
    at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield False, text[at : run.start()]
        yield True, text[run.start() : end]
        at = end
    if at < len(text):
        yield False, text[at:]


def encoded_length(encoder, text: str) -> int:
    # The encoder takes a single unit by this call only.
    return sum(len(encoder._encode_single_piece(part) if unit else encoder.encode_ordinary(part)) for unit, part in cut_runs(text))


def encoded_lengths(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id and n_tokens for every row; the vocabulary (under a megabyte) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            lengths = [encoded_length(encoder, text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and docs, a row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length n: docs of it, docs and tokens above it, tokens in all, tokens left
    when texts are cut at n, and the share of documents no longer than n."""
    rows = saved(histogram.withColumn("block", F.floor(F.col("n_tokens") / block)))
    tokens = F.col("docs") * F.col("n_tokens")
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum(tokens).alias("block_tokens"))
    # Blocks are few: the longest text over BLOCK at most.
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    above = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("docs_past"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_past"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    after = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(above, "block")
    docs_over = F.col("docs_past") + F.coalesce(F.sum("docs").over(after), F.lit(0))
    tokens_over = F.col("tokens_past") + F.coalesce(F.sum(tokens).over(after), F.lit(0))
    sums = joined.select("n_tokens", "docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "all_docs", "all_tokens")
    return sums.select(
        "n_tokens", "docs", "docs_over", "tokens_over", F.col("all_tokens").alias("total_tokens"),
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Answers for any context limits (a frame with ``context_limit``), also lengths that do not occur.

    ``limits`` is a short list of questions, which is broadcast.  The largest occurring
    length up to a limit answers it: nothing lies between the two.  Each length goes to the
    limits of its range, found in the sorted list, and the rest is one aggregate."""
    asked = sorted({r["context_limit"] for r in limits.select("context_limit").where(F.col("context_limit").isNotNull()).distinct().collect()})
    listed = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<long>")
    row = F.struct("n_tokens", "docs_over", "tokens_over", "share_within")
    # The first limit not below a length; later limits without a length of their own look back to it.
    place = F.size(F.filter(listed, lambda limit: limit < F.col("n_tokens")))
    best = {r["place"]: r["best"] for r in sums.groupBy(place.alias("place")).agg(F.max(row).alias("best")).collect()}
    total = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("docs"), F.lit(0)).alias("d")).first()
    answers, last = [], None
    for k, limit in enumerate(asked):
        last = best.get(k, last)
        over, tokens_over, share = (last["docs_over"], last["tokens_over"], last["share_within"]) if last else (total["d"], total["t"], 0.0)
        answers.append((limit, over, tokens_over, total["t"] - tokens_over + over * limit, share))
    table = sums.sparkSession.createDataFrame(answers, "context_limit long, docs_over long, tokens_over long, truncated_tokens long, share_within double")
    return limits.join(F.broadcast(table), "context_limit")  # a row for each limit


def quantiles(sums: DataFrame, shares: DataFrame) -> DataFrame:
    """For each ``share`` (a short list of questions) the least length within which at least that share of documents lies."""
    asked = sorted({r["share"] for r in shares.select("share").where(F.col("share").isNotNull()).distinct().collect()})
    least = [F.min(F.when(F.col("share_within") >= share, F.col("n_tokens"))).alias(f"q{k}") for k, share in enumerate(asked)]
    found = sums.agg(*least).first() if asked else []
    table = sums.sparkSession.createDataFrame([(share, n) for share, n in zip(asked, found, strict=True) if n is not None], "share double, n_tokens long")
    return shares.join(F.broadcast(table), "share")
