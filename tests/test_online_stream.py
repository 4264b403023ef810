"""Online EM over a stream that stops and starts again."""

import random

import numpy as np
import pytest

from strandloom.operators import em
from strandloom.streaming import online


def test_a_restarted_stream_gives_the_same_model(spark, tmp_path):
    rng, word = random.Random(1), "TGACTCAT"
    for part in range(4):
        rows = []
        for k in range(40):
            text = [rng.choice("ACGT") for _ in range(60)]
            text[10:18] = word
            rows.append((part * 100 + k, "".join(text)))
        spark.createDataFrame(rows, "seq_id long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "all"))
        spark.createDataFrame(rows, "seq_id long, seq string").coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    start = em.Model("m", np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in word]), np.full(4, 0.25), 0.01)
    schema = "seq_id long, seq string"

    def run(name, parts):
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True, exist_ok=True)
        for part in parts:
            for file in sorted((tmp_path / f"part{part}").glob("*.parquet")):
                (folder / "in" / f"{part}.parquet").write_bytes(file.read_bytes())
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
            query = online.learned(stream, start, str(folder / "state")).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination()
        return online.current_model(spark, start, str(folder / "state"))

    model = run("stopped", range(4))  # a query of its own for each file
    state = em.Averages.of(start)
    now = start
    for part in range(4):
        seqs = spark.read.parquet(str(tmp_path / f"part{part}"))
        now, state = em.online_step(start, now, state, em.collected(em.expected_counts(seqs, [now]), [now])[0], 0.1, -0.6)
    assert np.allclose(model.theta, now.theta) and model.rate == pytest.approx(now.rate)
    assert "".join("ACGT"[k] for k in model.theta.argmax(axis=1)) == word
    again = run("stopped", [])
    assert np.allclose(again.theta, model.theta)
    # A batch that runs again counts once.
    frame, before = spark.read.parquet(str(tmp_path / "part0")), online._latest(spark, str(tmp_path / "stopped/state"))
    assert before["seen"] == 4 * 40 * 53 and frame.count() == 40
