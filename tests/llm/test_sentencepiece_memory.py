"""What the SentencePiece operator holds at once on executors."""

import subprocess
import sys
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.llm import sentencepiece_lattice as lattice
from strandloom.llm.registry import VOCABULARIES


def test_a_task_folds_few_of_the_frequent_words(spark, monkeypatch):
    import sentencepiece

    path = str(VOCABULARIES / "piece_bpe_32k.model")
    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=path), lattice.Vocabulary.load(path)
    words = ["".join(chr(97 + k // 26**p % 26) for p in range(3)) for k in range(600)]
    texts = [(k, " ".join(words[k * 50 :] + words[: k * 50])) for k in range(5)]
    most, borders = [], lattice.word_borders

    def watched(frame, *more):
        most.append(frame.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return borders(frame, *more)

    monkeypatch.setattr(lattice, "FOLDED", 16, raising=False)
    monkeypatch.setattr(lattice, "word_borders", watched)
    got = lattice.encode(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {k: library.encode(t) for k, t in texts}
    assert most[0] < 64  # all 600 met in one task


def test_hashing_holds_a_part_of_all_words(monkeypatch):
    words = pa.array([f"{k:06d}" * 10 for k in range(100_000)])
    tracemalloc.start()
    whole = lattice._hashes(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # several numbers of eight bytes for each of 6 MB of letters came to over 100 MB
    monkeypatch.setattr(lattice, "HASHED", 1)
    some = words.slice(7, 1000)
    assert lattice._hashes(some).tolist() == whole[7:1007].tolist()


def test_pieces_need_no_python_on_executors(spark):
    vocabulary = lattice.Vocabulary([f"<{b}>" for b in range(256)] + ["a", "ab", "b"], [0.0] * 256 + [-1.0, -2.0, -1.5], {b: b for b in range(256)}, {"a": 256, "ab": 257, "b": 258})
    pieces = lattice.piece_table(spark, vocabulary)
    assert pieces.dtypes == [("piece", "string"), ("rank", "int"), ("id", "int"), ("score", "double")]
    assert sorted(map(tuple, pieces.collect())) == [("a", lattice.LAST, 256, -1.0), ("ab", 2, 257, -2.0), ("b", lattice.LAST, 258, -1.5)]
    assert "ExistingRDD" not in pieces._jdf.queryExecution().executedPlan().toString()


def test_workers_import_no_pandas():
    code = "import sys, strandloom.llm.sentencepiece_lattice; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_listed_words_go_with_their_broadcast():
    import gc
    import weakref

    class Shared:
        value = lattice._to_ipc(pa.array([" a"]), pa.array([[1]], pa.list_(pa.int32())))

    shared = Shared()
    assert lattice._listed(shared) is lattice._listed(shared)
    listed = weakref.ref(lattice._listed(shared))
    del shared
    gc.collect()
    assert listed() is None  # a cache of the module kept the last one in workers for good
