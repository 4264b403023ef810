"""Seeded shuffles of sequences and rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ACGT"


def dinucleotide_shuffle(seq: str, rng: np.random.Generator) -> str:
    """A random string with the same letter pairs, first and last letter.

    Letters are vertices and pairs are edges of a graph in which the string is an
    Euler path.  A random last exit of each letter is drawn until all exits lead to
    the final letter; the other exits are shuffled before it, and the path is walked."""
    if len(seq) < 3:
        return seq
    code, letters = np.unique(np.frombuffer(seq.encode("utf-32-le"), np.uint32), return_inverse=True)
    # The exits of each letter, in one pass: sorted by the letter before them.
    by_letter = np.argsort(letters[:-1], kind="stable")
    ends = np.cumsum(np.bincount(letters[:-1], minlength=len(code)))
    exits = np.split(letters[1:][by_letter], ends[:-1])
    final = int(letters[-1])
    while True:
        last = [int(rng.choice(e)) if len(e) else final for e in exits]
        reaches = np.zeros(len(code), bool)
        reaches[final] = True
        for _ in range(len(code)):
            for v in range(len(code)):
                reaches[v] |= reaches[last[v]]
        if all(reaches[v] for v in range(len(code)) if len(exits[v])):
            break
    order = []
    for v, e in enumerate(exits):
        rest = e.copy()
        if v != final and len(e):
            rest = np.delete(rest, int(np.flatnonzero(rest == last[v])[0]))
        rng.shuffle(rest)
        order.append(rest.tolist() + ([last[v]] if v != final and len(e) else []))
    following = [iter(o).__next__ for o in order]
    at = int(letters[0])
    path = [at]
    for _ in range(len(letters) - 1):
        at = following[at]()
        path.append(at)
    return code[path].astype(np.uint32).tobytes().decode("utf-32-le")


def shuffled(seqs: DataFrame, seed: int = 0, copies: int = 1, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """key, copy, seq: ``copies`` shuffles of each sequence, each seeded by (seed, key, copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, c, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                own = hashlib.blake2b(f"{seed}:{k}:{c}".encode(), digest_size=8).digest()
                out.append(None if s is None else dinucleotide_shuffle(s, np.random.default_rng(int.from_bytes(own, "little"))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["key", "copy", "seq"])

    rows = seqs.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.col(seq).alias("seq"))
    kind = seqs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, copy int, seq string").withColumnRenamed("key", key)


def seeded_order(seed: int, *keys: str) -> Column:
    """A sort key that is random in its seed and the same in every run."""
    return F.xxhash64(F.lit(seed), *keys)


def shuffled_matrix(columns: DataFrame, keys: list[str], seed: int = 0, by: str = "columns") -> DataFrame:
    """Rows of a matrix (keys, pos, A, C, G, T) with its ``columns`` (places), ``letters`` or ``cells`` in seeded random order.

    A matrix is a few rows of a key; its order is that of hashes, the same in every run."""
    if by == "columns":
        placed = columns.withColumns({
            "__from": F.row_number().over(Window.partitionBy(*keys).orderBy("pos")),
            "__to": F.row_number().over(Window.partitionBy(*keys).orderBy(seeded_order(seed, *keys, "pos"), "pos")),
        })
        places = placed.select(*keys, F.col("__from").alias("__to"), F.col("pos").alias("__pos"))
        return placed.drop("pos").join(places, [*keys, "__to"]).withColumnRenamed("__pos", "pos").select(*columns.columns)
    if by == "letters":
        cells = F.array(*LETTERS)
        mixed = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.xxhash64(F.lit(seed), *keys, k).alias("at"), F.get(cells, k).alias("v"))))
        return columns.withColumn("__v", mixed).select(*[c for c in columns.columns if c not in LETTERS], *(F.col("__v")[k]["v"].alias(x) for k, x in enumerate(LETTERS)))
    cells = columns.select(*keys, "pos", F.posexplode(F.array(*LETTERS)).alias("__k", "__v"))
    cells = cells.withColumns({
        "__from": F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "__k")),
        "__to": F.row_number().over(Window.partitionBy(*keys).orderBy(seeded_order(seed, *keys, "pos", "__k"), "pos", "__k")),
    })
    values = cells.select(*keys, F.col("__to").alias("__from"), F.col("__v").alias("__new"))
    filled = cells.join(values, [*keys, "__from"]).groupBy(*keys, "pos").agg(*(F.max(F.when(F.col("__k") == k, F.col("__new"))).alias(x) for k, x in enumerate(LETTERS)))
    return columns.drop(*LETTERS).join(filled, [*keys, "pos"]).select(*columns.columns)


def noisy_matrix(columns: DataFrame, keys: list[str], level: float, seed: int = 0) -> DataFrame:
    """Cells raised by seeded noise between 0 and ``level``, rows normalised."""
    noise = {x: F.col(x) + level * (F.pmod(F.xxhash64(F.lit(seed), *keys, "pos", F.lit(x)), F.lit(1 << 30)) / (1 << 30)) for x in LETTERS}
    total = sum((noise[x] for x in "CGT"), noise["A"])
    return columns.withColumns({x: noise[x] / total for x in LETTERS})


def bootstrap(rows: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    return rows.sample(withReplacement=True, fraction=share, seed=seed)
