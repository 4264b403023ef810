"""Tables in the cluster's shared folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary one; on a cluster that is an
    error, as executors could not read each other's files."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``saved`` writes within are deleted at the end, also after an error.

    Write a result elsewhere before, as a DataFrame that reads such tables can't be read afterwards.
    Scopes nest; a table belongs to the innermost one. Use them from one thread."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The table is read with column pruning; ``by`` makes folders of a column's values, of
    which a filter on it reads only its own."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over the cluster's cores by ``keys`` if it is read in fewer parts than there are cores.

    A table of few row groups would leave most of them idle; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
