"""SQL surface: functions and table functions for ``spark.sql``."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import IUPAC
from strandloom.operators.packing import fixed_strings, letters, raw_letters
from strandloom.operators.scan import window_scores

_MEMBERS = "map(" + ", ".join(f"'{code}', '{members}'" for code, members in IUPAC.items()) + ")"
#: SQL bodies of the functions, by signature.
FUNCTIONS = {
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTURYKMBVDHSWN', 'TGCAAYRMKVBHDSWN'))",
    "canonical_kmer(s STRING) RETURNS STRING": "least(s, reverse(translate(s, 'ACGTURYKMBVDHSWN', 'TGCAAYRMKVBHDSWN')))",
    "normalised_seq(s STRING) RETURNS STRING": "translate(upper(s), 'URYKMBVDHSW', 'TNNNNNNNNNN')",
    "letters_known(s STRING) RETURNS BOOLEAN": "length(s) > 0 AND translate(s, 'ACGT', '') = ''",
    "consensus_matrix(s STRING) RETURNS ARRAY<ARRAY<DOUBLE>>": "transform(filter(split(upper(s), ''), c -> c != ''), c -> transform(array('A', 'C', 'G', 'T'), x -> CASE WHEN contains(element_at(" + _MEMBERS + ", c), x) THEN 1D / length(element_at(" + _MEMBERS + ", c)) ELSE 0D END))",
}


def _encoded(seq: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and codes of a sequence; a null is an empty one."""
    text = pa.array([seq or ""])
    return raw_letters(text)[0], letters(text)[0]


# Spark joins only ordinary table functions laterally; each scores its whole row with numpy and yields what it finds.
@F.udtf(returnType="start int, word string")
class GappedKmers:
    """Words of two halves around a gap, written with N; halves hold known letters only."""

    def eval(self, seq: str, half: int, gap: int):
        raw, code = _encoded(seq)
        width = 2 * half + gap
        bad = np.concatenate([[0], np.cumsum(code == 4)])
        n = max(0, len(code) - width + 1)
        at = np.flatnonzero((bad[half : half + n] == bad[:n]) & (bad[width : width + n] == bad[half + gap : half + gap + n]))
        words = raw[at[:, None] + np.arange(width)]
        words[:, half : half + gap] = ord("N")
        yield from zip(at.tolist(), fixed_strings(words).to_pylist(), strict=True)


@F.udtf(returnType="start int, found string, score double")
class MatchRegex:
    """Non-overlapping matches of a regular expression; case is ignored unless ``cased``."""

    def eval(self, seq: str, pattern: str, cased: bool = False):
        for m in re.finditer(pattern, seq or "", 0 if cased else re.IGNORECASE):
            yield m.start(), m.group(), 1.0


@F.udtf(returnType="start int, word string, score double")
class ScoreMatrix:
    """Windows whose natural log-odds against a probability matrix (rows of A, C, G, T) exceed ``least``; smaller probabilities count as 1e-4."""

    def eval(self, seq: str, matrix: list, least: float):
        raw, code = _encoded(seq)
        odds = np.log(np.maximum(np.array(matrix, float), 1e-4) / 0.25)
        score = window_scores(code, np.hstack([odds, np.full((len(odds), 1), -np.inf)]))
        at = np.flatnonzero(score > float(least))
        yield from zip(at.tolist(), fixed_strings(raw[at[:, None] + np.arange(len(odds))]).to_pylist(), score[at].tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; table functions join with LATERAL."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for name, function in {"gapped_kmers": GappedKmers, "regex_match": MatchRegex, "pwm_match": ScoreMatrix}.items():
        spark.udtf.register(name, function)
