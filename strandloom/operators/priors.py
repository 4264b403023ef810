"""Pseudo-counts from mixtures of Dirichlet distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "ACGT"


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series(np.vectorize(math.lgamma, otypes=[float])(x.to_numpy(float)) if len(x) else np.zeros(0))


def read_library(spark: SparkSession, path: str, strength: float = 0.0) -> DataFrame:
    """component, mixture, strength, alpha (array), alphabet of a library file; ``strength`` above 0 scales all to that mean strength.

    A file names its alphabet and number of components, and has a block of lines for each."""
    text = spark.read.text(path, wholetext=True)
    alphabet = F.regexp_extract("value", r"Alphabet=\s*(\S+)", 1)
    parts = F.slice(F.split("value", r"(?m)^\s*Number=?"), 2, 1 << 20)
    rows = text.select(alphabet.alias("alphabet"), F.posexplode(parts).alias("component", "part"))

    def field(name: str):
        return F.regexp_extract("part", rf"(?m)^\s*{name}=?\s+([^\n]*)", 1)

    numbers = F.transform(F.filter(F.split(F.trim(field("Alpha")), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    found = rows.select("component", "alphabet", field("Mixture").cast("double").alias("mixture"), field("B").cast("double").alias("strength"), numbers.alias("shares"))
    found = found.withColumn("alpha", F.transform("shares", lambda x: x * F.col("strength"))).drop("shares")
    if strength <= 0:
        return found
    mean = found.agg(F.sum(F.col("mixture") * F.col("strength")).alias("mean"))
    scale = F.lit(strength) / F.col("mean")
    return found.join(F.broadcast(mean)).withColumns({"alpha": F.transform("alpha", lambda x: x * scale), "strength": F.col("strength") * scale}).drop("mean")


def pseudo_counts(counts: DataFrame, keys: list[str], library: DataFrame) -> DataFrame:
    """keys, pos and the expected prior counts of A, C, G, T, given each column's counts.

    ``library`` has component, mixture, alpha (four numbers): a few rows, which are broadcast.
    A component weighs by its mixture share times the likelihood of the column's counts."""
    n, a0 = F.col("A") + F.col("C") + F.col("G") + F.col("T"), F.aggregate("alpha", F.lit(0.0), lambda s, x: s + x)
    likelihood = log_gamma(n + 1.0) + log_gamma(a0) - log_gamma(n + a0)
    for k, x in enumerate(LETTERS):
        likelihood = likelihood + log_gamma(F.col(x) + F.col("alpha")[k]) - log_gamma(F.col(x) + 1.0) - log_gamma(F.col("alpha")[k])
    met = counts.select(*keys, "pos", *(F.col(x).cast("double").alias(x) for x in LETTERS)).join(F.broadcast(library.select("component", "mixture", "alpha")))
    met = met.withColumn("ll", F.log("mixture") + likelihood)
    top = met.groupBy(*keys, "pos").agg(F.max("ll").alias("top"))
    weighed = met.join(top, [*keys, "pos"]).withColumn("w", F.exp(F.col("ll") - F.col("top")))
    return weighed.groupBy(*keys, "pos").agg(*((F.sum(F.col("w") * F.col("alpha")[k]) / F.sum("w")).alias(x) for k, x in enumerate(LETTERS)))
