"""Online EM over a stream: the model advances with every micro-batch and outlives a restart.

The state after a micro-batch is one row of a table in ``folder``, under the batch's number.  A batch
that runs again finds its row and does nothing, so each window counts once.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandloom.operators import em

_STATE = "batch long, seen long, rate double, model_rate double, density double, motif array<double>, other array<double>, background array<double>"


def _latest(spark: SparkSession, folder: str):
    """The state after the last batch, a single row; None before the first."""
    try:
        rows = spark.read.schema(_STATE).parquet(f"{folder}/after=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("batch")).first()


def _restored(start: em.Model, row) -> tuple[em.Model, em.Averages]:
    if row is None:
        return start, em.Averages.of(start)
    motif, other = (np.array(row[c]).reshape(-1, 4) for c in ("motif", "other"))
    now = em.replace(start, theta=motif / motif.sum(axis=1, keepdims=True), background=np.array(row["background"]), rate=row["model_rate"], density=row["density"])
    return now, em.Averages(row["rate"], motif, other, row["seen"])


def current_model(spark: SparkSession, start: em.Model, folder: str) -> em.Model:
    """The model after all batches so far."""
    return _restored(start, _latest(spark, folder))[0]


def learned(stream: DataFrame, start: em.Model, folder: str, first_step: float = 0.05, decay: float = -0.6, both_strands: bool = True) -> DataStreamWriter:
    """A writer that advances ``start`` by each micro-batch of sequences (``seq``); start it with a checkpoint of its own.

    ``folder`` lies where all executors read, as the checkpoint does.  Only one row of sums comes to the driver a batch."""
    step = max(first_step, 10 * start.rate)

    def advance(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        row = _latest(spark, folder)
        if row is not None and row["batch"] >= number:
            return
        now, state = _restored(start, row)
        found = em.collected(em.expected_counts(batch, [now], both_strands), [now])
        if not found:
            return
        after, state = em.online_step(start, now, state, found[0], step, decay)
        values = (number, state.seen, float(state.rate), float(after.rate), float(after.density), *(x.ravel().tolist() for x in (state.motif, state.other, after.background)))
        spark.createDataFrame([values], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/after={number:012d}")

    return stream.writeStream.foreachBatch(advance)
