"""FASTA folders to motif files in one call, numbered records, and scopes of stored tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.plans import refinement, workflow
from strandloom.sources import fasta, motifs
from strandloom.storage import saved, scope, shared_dir

WORD = "CACGTTTGGC"


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Sixty sequences with the word planted (a letter in twenty changed), in two files, and sixty without."""
    rng, root = random.Random(5), tmp_path_factory.mktemp("fasta")
    for name, planted in (("positive", True), ("negative", False)):
        os.mkdir(root / name)
        for part in range(2):
            with open(root / name / f"part{part}.fa", "w") as f:
                for k in range(30):
                    text = [rng.choice("ACGT") for _ in range(90)]
                    if planted:
                        at = rng.randrange(80)
                        text[at : at + len(WORD)] = [x if rng.random() < 0.95 else rng.choice("ACGT") for x in WORD]
                    f.write(f">{name}{part}_{k}\n" + "".join(text[:60]) + "\n" + "".join(text[60:]) + "\n")
    with open(root / "seeds.txt", "w") as f:
        for name, word in (("first", "TTAATTAATT"), ("second", WORD)):
            f.write(f">{name}\t{word}\n" + "".join("\t".join(f"{0.85 if x == y else 0.05:.6f}" for x in "ACGT") + "\n" for y in word) + "\n")
    return root


def test_from_folders_and_a_seed_file_to_a_motif_file(spark, folders, tmp_path):
    options = {"min_sites": 30, "max_sites": 200, "tries": 2, "passes": 2, "batches": 2}
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    found = workflow.find_motifs(spark, str(folders / "positive"), str(folders / "negative"), str(tmp_path), str(folders / "seeds.txt"), index=2, pseudo=0.01, given_background=True, save_masked=True, **options)
    assert [m.model.name for m in found] == ["second"] and found[0].log_evalue < 0 and found[0].erased[0] > 30 > found[0].erased[1]
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before  # nothing stored is left
    rows = motifs.read_motif_file(spark, str(tmp_path / "motifs")).orderBy("pos").collect()
    assert "".join("ACGT"[int(np.argmax([r[x] for x in "ACGT"]))] for r in rows) == WORD and {r["nsites"] for r in rows} == {found[0].erased[0]}
    assert spark.read.parquet(str(tmp_path / "logos")).count() == 4 * len(WORD)
    masked = fasta.read_numbered(spark, str(tmp_path / "masked/positive"))
    assert masked.agg(F.sum(F.length(F.regexp_replace("seq", "[^N]", "")))).first()[0] == len(WORD) * found[0].erased[0]
    assert {r["name"] for r in masked.collect()} == {f"sequence{k}" for k in range(1, 61)}
    with pytest.raises(ValueError, match="number 3"):
        workflow.find_motifs(spark, str(folders / "positive"), str(folders / "negative"), str(tmp_path), str(folders / "seeds.txt"), index=3)
    with pytest.raises(ValueError, match="soft"):
        workflow.find_motifs(spark, "-", "-", str(tmp_path), fit="batch", save_masked=True)
    none = workflow.find_motifs(spark, str(folders / "negative"), str(folders / "positive"), str(tmp_path / "none"), str(folders / "seeds.txt"), index=1, pseudo=0.01, min_sites=1000, max_sites=2000, tries=1, passes=1, batches=1)
    assert none == [] and "MOTIF" not in "".join(r["value"] for r in spark.read.text(str(tmp_path / "none/motifs")).collect())


def test_seeds_are_made_where_none_are_given(spark, folders, tmp_path):
    words = workflow.Words(half=4, min_gap=0, max_gap=1, min_sites=10, z_threshold=6.0)
    found = workflow.find_motifs(spark, str(folders / "positive"), str(folders / "negative"), str(tmp_path), words=words, pseudo=0.01, most=1, fit="batch", erasing="hard", min_sites=20, iterations=8)
    assert len(found) == 1 and found[0].log_evalue < 0
    made = motifs.read_seed_matrices(spark, str(tmp_path / "seeds"))
    names = [r["motif"] for r in made.select("block", "motif").distinct().orderBy("block").collect()]
    assert names and names[0] == found[0].model.name
    best = "".join("ACGT"[k] for k in found[0].model.theta.argmax(axis=1))
    both = {WORD, WORD[::-1].translate(str.maketrans("ACGT", "TGCA"))}
    assert any(best in w or w[1:-1] in best or best[1:-1] in w for w in both)


def test_numbers_follow_files_however_they_are_split(spark, folders):
    want = [f"positive{part}_{k}" for part in range(2) for k in range(30)]
    for size in ("128m", "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = fasta.read_numbered(spark, str(folders / "positive")).orderBy("seq_id").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [r["seq_id"] for r in rows] == list(range(60)) and [r["name"] for r in rows] == want and {len(r["seq"]) for r in rows} == {90}


def test_seed_stream_keeps_the_order_of_its_keys(spark):
    rows = [(10, "b", 1, 0.1, 0.2, 0.3, 0.4), (10, "b", 0, 0.4, 0.3, 0.2, 0.1), (2, "c", 0, 0.25, 0.25, 0.25, 0.25)]
    got = list(refinement.seed_stream(spark.createDataFrame(rows, "block long, motif string, pos int, A double, C double, G double, T double"), np.full(4, 0.25), 0.1, ("block", "motif")))
    assert [m.name for m in got] == ["c", "b"] and got[1].theta.tolist() == [[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]


def test_scopes_delete_their_tables_also_after_errors(spark):
    outer = saved(spark.range(3))
    folder = shared_dir(spark).removeprefix("file:")
    held = set(os.listdir(folder))
    with scope(spark):
        first = saved(spark.range(5))
        with pytest.raises(RuntimeError), scope(spark):
            saved(spark.range(7))
            raise RuntimeError
        assert first.count() == 5 and len(set(os.listdir(folder)) - held) == 1
    assert set(os.listdir(folder)) == held and outer.count() == 3
