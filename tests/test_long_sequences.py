"""Sequences longer than a task's block: scans, masks, counts and E steps are those of the whole."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import em, enrichment, packing, scan, tuples

WORD = "TGACTCAT"
MATRIX = np.array([[0.7 if x == y else 0.1 for x in "ACGT"] for y in WORD])
ODDS = np.log(MATRIX / 0.25).tolist()


def batch():
    rng = random.Random(2)
    texts = ["ACGT" * 3, "".join(rng.choice("ACGTACGTACGTN") for _ in range(5000)) + WORD * 40 + "TGACTC" * 90, None, "TGACTCAT" * 20]
    return pa.record_batch({"seq_id": pa.array(range(4)), "seq": pa.array(texts)})


def collected(kernel, *columns):
    table = pa.Table.from_batches(list(kernel(iter([batch().select(list(columns))]))))
    return table.to_pylist()


@pytest.mark.parametrize("size", [100, 333, 1000])
@pytest.mark.parametrize("options", [{}, {"apart": True}, {"peaks": True}, {"words": True, "flank": 7}, {"apart": True, "peaks": True, "flank": 30}])
def test_hits(monkeypatch, size, options):
    args = {"apart": False, "words": False, "flank": 0, "peaks": False} | options
    whole = collected(scan._scan(ODDS, 0.5, True, **args), "seq_id", "seq")
    monkeypatch.setattr(packing, "PIECE", size)
    assert collected(scan._scan(ODDS, 0.5, True, **args), "seq_id", "seq") == whole and whole


@pytest.mark.parametrize("size", [100, 333])
def test_counts_and_steps(monkeypatch, size):
    def totals(rows, keys):
        out = {}
        for r in rows:
            k = tuple(r[x] for x in keys)
            out[k] = out.get(k, 0) + r["cnt"]
        return {k: v for k, v in out.items() if v}

    marked = batch().append_column("own", pa.array([True, False, True, True]))
    rng = random.Random(1)
    weights = pa.array([None if t.as_py() is None else [rng.random() for _ in t.as_py()] for t in batch().column(1)], pa.list_(pa.float64()))
    weighed = pa.record_batch({"seq": batch().column(1), "weights": weights})
    model = em.Model("m", MATRIX, np.full(4, 0.25), 0.01)

    def all_of():
        gapped = pa.Table.from_batches(list(enrichment._counter(4, range(0, 6))(iter([marked.select(["seq", "own"])])))).to_pylist()
        words = pa.Table.from_batches(list(tuples._counter([3, 12])(iter([batch().select(["seq"])])))).to_pylist()
        steps = [pa.Table.from_batches(list(em._expected([model], True)(iter([b])))).to_pylist()[0] for b in (batch().select(["seq"]), weighed)]
        return totals(gapped, ("own", "gap", "packed")), totals(words, ("width", "packed")), [[s["z"], s["log_likelihood"], s["windows"], s["sites"], *s["motif"], *s["other"]] for s in steps]

    monkeypatch.setattr(em, "PIECE", 1 << 21)
    whole = all_of()
    monkeypatch.setattr(packing, "PIECE", size)
    monkeypatch.setattr(em, "PIECE", size)
    again = all_of()
    assert again[:2] == whole[:2] and np.allclose(again[2], whole[2])


@pytest.mark.parametrize("size", [100, 1000])
def test_masks(spark, monkeypatch, size):
    frame = spark.createDataFrame(batch().to_pandas().astype(object).where(lambda d: d.notna(), None).values.tolist(), "seq_id long, seq string")
    whole = scan.erased(frame, ODDS, 0.01)
    kernels = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: kernels.append(f))
    scan.erased(frame, ODDS, 0.01)
    monkeypatch.undo()
    monkeypatch.setattr(packing, "PIECE", size)
    got = pa.Table.from_batches(list(kernels[0](iter([batch()])))).to_pylist()
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in whole.collect()) and sum(r["erased"] for r in got) > 50
