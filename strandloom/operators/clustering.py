"""Similarity of words, group-average clusters and their alignment.

Clusters grow in rounds of reciprocal nearest pairs: every pair whose two clusters
are each other's nearest is merged at once.  Group-average linkage merges the same
pairs that way as one by one, and a round is a few joins over the edge table, so no
component of words is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import IUPAC, revcomp
from strandloom.operators.composition import LETTERS
from strandloom.operators.ordered import running_totals
from strandloom.storage import saved

#: Shapes of parts up to which words are cut into parts of all of them.
MOST_SHAPES = 2000
#: Words of a block; blocks are compared with each other.
BLOCK = 128
#: Codes and their complements.
CODES, COMPLEMENTS = "ACGTRYKMSWBDHVN", "TGCAYRMKSWVHDBN"
#: Distance of a pair of clusters whose members have no edge.
MISSING = 1.0


def _correlations() -> np.ndarray:
    """Pearson correlation of the columns of any two codes (zero for N)."""
    rows = np.array([[float(x in IUPAC[code]) / len(IUPAC[code]) for x in LETTERS] for code in CODES])
    rows = (rows + 0.01) / 1.04
    rows = rows - rows.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 1e-9)
    return unit @ unit.T


def _best_offsets(a: np.ndarray, b: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of equal-width words, the best score and its smallest offset."""
    na, nb = a.shape[1], b.shape[1]
    best, at = np.full(len(a), -np.inf), np.zeros(len(a), np.int64)
    for off in range(1 - nb, na):
        i = np.arange(max(off, 0), min(na, off + nb))
        score = np.round(table[a[:, i], b[:, i - off]].sum(axis=1) / min(na, nb), 9)
        better = score > best
        best, at = np.where(better, score, best), np.where(better, off, at)
    return best, at


def _coder():
    """A function of a word to its code numbers, and the code number of each one's complement."""
    place = np.zeros(128, np.int64)
    place[[ord(c) for c in CODES]] = np.arange(len(CODES))
    return lambda word: place[np.frombuffer(word.encode(), np.uint8)], np.array([CODES.index(c) for c in COMPLEMENTS])


def _both_strands(a: np.ndarray, b: np.ndarray, table: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of equal-width words, the best score, its strand and its offset."""
    plus, plus_off = _best_offsets(a, b, table)
    minus, minus_off = _best_offsets(a, other[b[:, ::-1]], table)
    turned = minus > plus
    return np.where(turned, minus, plus), np.where(turned, "-", "+").astype(object), np.where(turned, minus_off, plus_off)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _correlations()
    coded, other = _coder()
    for batch in batches:
        words = [[coded(w) for w in batch.column(k).to_pylist()] for k in (2, 3)]
        widths: dict[tuple[int, int], list[int]] = {}
        for r, (x, y) in enumerate(zip(*words, strict=True)):
            widths.setdefault((len(x), len(y)), []).append(r)
        sim, off, strand = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "+", object)
        for rows in widths.values():
            a, b = (np.array([side[r] for r in rows]) for side in words)
            sim[rows], strand[rows], off[rows] = _both_strands(a, b, table, other)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim), pa.array(strand, pa.string()), pa.array(off.astype(np.int32))], names=["id_a", "id_b", "sim", "strand", "off"])


def _compare_blocks(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _correlations()
        coded, other = _coder()

        def by_width(block: pa.ListScalar) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            groups: dict[int, list[tuple[int, np.ndarray]]] = {}
            for row in block.as_py():
                groups.setdefault(len(row["word"]), []).append((row["id"], coded(row["word"])))
            sides = ((n, np.array([i for i, _ in rows], np.int64), np.array([w for _, w in rows])) for n, rows in groups.items())
            return {n: (ids, codes, (codes != CODES.index("N")).sum(axis=1)) for n, ids, codes in sides}

        def compared(ones, others) -> Iterator[pa.RecordBatch]:
            for (na, (ids_a, a, known_a)), (nb, (ids_b, b, known_b)) in product(ones.items(), others.items()):
                # No column scores over 1 and N scores 0, so no pair left out here can reach the least score.
                hope = np.minimum(known_a[:, None], known_b) >= least * min(na, nb) - 1e-6
                i, j = np.nonzero((ids_a[:, None] < ids_b) & hope)
                if not len(i):
                    continue
                sim, strand, off = _both_strands(a[i], b[j], table, other)
                near = sim >= least - 1e-6
                columns = [pa.array(ids_a[i[near]]), pa.array(ids_b[j[near]]), pa.array(sim[near]), pa.array(strand[near], pa.string()), pa.array(off[near].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["id_a", "id_b", "sim", "strand", "off"])

        for batch in batches:
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                one, two = by_width(left), by_width(right)
                yield from compared(one, two)
                if not same:
                    yield from compared(two, one)

    return run


def equal_letters(known: int, width: int, least: float, apart: float) -> int:
    """Letters that a word with ``known`` letters in ``width`` columns shares at least, in place, with any wider word of similarity ``least``.

    Equal columns score one, others ``apart`` at most, and N and what doesn't overlap zero."""
    apart = max(apart, 0.0)
    return int(np.ceil((least * width - apart * known) / (1 - apart) - 1e-6))


def parts_of(word: str, least: float, apart: float) -> list[str] | None:
    """Stretches of ``word`` (letters, and ``.`` for N between them) of which one at least stands in every wider word of similarity ``least``.

    A word of k letters that shares m of them misses k - m, so of k - m + 1 parts one is whole.
    None where nothing need be shared; no parts where no word comes so near."""
    at = [i for i, x in enumerate(word) if x != "N"]
    shared = equal_letters(len(at), len(word), least, apart)
    if shared > len(at):
        return []
    if shared < 1:
        return None
    cuts = np.linspace(0, len(at), len(at) - shared + 2).astype(int)
    return ["".join(word[i] if word[i] != "N" else "." for i in range(at[a], at[b - 1] + 1)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shape_of(part: str) -> str:
    return "".join("." if x == "." else "x" for x in part)


def _signatures(least: float, apart: float, shapes: list[str]):
    masks = [[i for i, x in enumerate(shape) if x == "x"] for shape in shapes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = str.maketrans(CODES, COMPLEMENTS)
        for batch in batches:
            rows: list[tuple] = []
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(part, number, len(word), True) for part in set(parts_of(word, least, apart) or [])]
                held = set()
                for text in (word, word[::-1].translate(turned)):
                    for shape, mask in zip(shapes, masks, strict=True):
                        for start in range(len(text) - len(shape) + 1):
                            letters = [text[start + i] for i in mask]
                            if "N" not in letters:
                                part = ["."] * len(shape)
                                for i, x in zip(mask, letters, strict=True):
                                    part[i] = x
                                held.add("".join(part))
                rows += [(part, number, len(word), False) for part in held]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["part", "id", "width", "own"])

    return run


def _shapes(least: float, apart: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str | None] = set()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                parts = parts_of(word, least, apart)
                seen |= {None} if parts is None else {shape_of(p) for p in parts}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen, key=str), pa.string())], names=["shape"])

    return run


def candidate_pairs(words: DataFrame, threshold: float = 0.3) -> DataFrame | None:
    """id_a < id_b of every pair of ``words`` (id, word) that can be within ``threshold``, from an equi-join of parts.

    None where some word need share nothing with a near one, or where parts have more than
    ``MOST_SHAPES`` shapes."""
    least = 1 - threshold
    codes = {r["x"] for r in words.select(F.explode(F.split("word", "")).alias("x")).distinct().where("x NOT IN ('', 'N')").collect()}  # fifteen at most
    table, known = _correlations(), [CODES.index(x) for x in sorted(codes)]
    apart = max((float(table[i, j]) for i in known for j in known if i != j), default=-1 / 3)
    found = words.select("word").mapInArrow(_shapes(least, apart), "shape string").distinct().limit(MOST_SHAPES + 1).collect()
    if len(found) > MOST_SHAPES or any(r["shape"] is None for r in found):
        return None
    rows = saved(words.select(F.col("id").cast("long"), "word").mapInArrow(_signatures(least, apart, sorted(r["shape"] for r in found)), "part string, id long, width int, own boolean"))
    short = rows.where("own").select("part", F.col("id").alias("i"), F.col("width").alias("wi"))
    wide = rows.where("NOT own").select("part", F.col("id").alias("j"), F.col("width").alias("wj"))
    met = short.join(wide, "part").where((F.col("i") != F.col("j")) & ((F.col("wi") < F.col("wj")) | ((F.col("wi") == F.col("wj")) & (F.col("i") < F.col("j")))))
    return met.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def near_similarities(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``similarities`` of all pairs of ``words`` (id, word) that can be within ``threshold``.

    Pairs are those that share a part (``candidate_pairs``), and none is missed.  Where the threshold is so wide that near
    words need share no letter, blocks of words are paired and compared inside tasks.  Empty words have
    no columns and no pairs."""
    words = saved(words.where(F.length("word") > 0).select(F.col("id").cast("long").alias("id"), "word"))
    pairs = candidate_pairs(words, threshold)
    if pairs is not None:
        return similarities(words, pairs).where(F.col("sim") >= 1 - threshold - 1e-6)
    blocks = max(1, -(-words.count() // BLOCK))
    block = words.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "word")).alias("rows"))
    left = block.select(F.col("block").alias("a"), F.col("rows").alias("left"))
    # Each two blocks meet once, in a stated pairing.
    paired = left.withColumn("b", F.explode(F.sequence("a", F.lit(blocks - 1).cast("long"))))
    both = paired.join(block.select(F.col("block").alias("b"), F.col("rows").alias("right")), "b").select("left", "right", (F.col("a") == F.col("b")).alias("same"))
    return both.mapInArrow(_compare_blocks(1 - threshold), "id_a long, id_b long, sim double, strand string, off int")


def similarities(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a, id_b, sim, strand, off: the best mean column correlation over offsets and strands.

    Columns are summed over the overlap and divided by the shorter width; ``off`` places
    the second word's first column on the first word.  Ties go to the plus strand, then
    to the smallest offset.  A column is one of fifteen codes, so its correlation with
    another is looked up."""
    a = words.select(F.col("id").alias("id_a"), F.col("word").alias("wa"))
    b = words.select(F.col("id").alias("id_b"), F.col("word").alias("wb"))
    joined = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "wa", "wb")
    return joined.mapInArrow(_compare, "id_a long, id_b long, sim double, strand string, off int")


def distances(sims: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Edges no longer than ``threshold``."""
    return sims.select("id_a", "id_b", F.round(1 - F.col("sim"), 9).alias("dist"), "strand", "off").where(F.col("dist") <= threshold)


def clusters(words: DataFrame, edges: DataFrame, cut, threshold: float = 0.3, missing: float = MISSING) -> DataFrame:
    """id, cluster, place: clusters numbered from one by falling size (ties by least id).

    ``cut`` stores a frame and returns it without lineage.  The distance of two
    clusters is the mean over all member pairs, a pair without an edge counting
    ``missing``; merged pairs beyond ``threshold`` are dropped and count as missing later."""
    now = cut(edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("dist").alias("d")))
    member = cut(words.select(F.col("id").alias("id"), F.col("id").alias("cluster"), F.lit(0).alias("step")))
    step = 0
    while not now.isEmpty():
        step += 1
        sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        nearest = both.groupBy("a").agg(F.min(F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))).alias("n"))
        chosen = nearest.groupBy("n").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").select("n.lo", "n.hi")
        chosen = cut(chosen)
        into = chosen.select(F.col("hi").alias("old"), F.col("lo").alias("new"))
        sized = now.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
        moved = sized.join(into.select(F.col("old").alias("a"), F.col("new").alias("na")), "a", "left").join(into.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b", "left")
        a, b = F.coalesce("na", "a"), F.coalesce("nb", "b")
        weight = F.col("sa") * F.col("sb")
        renamed = moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), weight.alias("w"), (F.col("d") * weight).alias("wd")).where("a != b")
        summed = renamed.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"))
        order = F.when(F.col("new").isNotNull(), F.lit(step)).otherwise(F.col("step"))
        member = cut(member.join(into, member["cluster"] == into["old"], "left").select("id", F.coalesce("new", "cluster").alias("cluster"), order.alias("step")))
        sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
        full = summed.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("sb")), "b")
        pairs = F.col("sa") * F.col("sb")
        mean = F.round((F.col("wd") + missing * (pairs - F.col("w"))) / pairs, 9)
        now = cut(full.select("a", "b", mean.alias("d")).where(F.col("d") <= threshold))
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    ordered = sizes.withColumns({"__order": F.struct((-F.col("size")).alias("size"), "cluster"), "__one": F.lit(1)})
    number = running_totals(ordered, "__order", ["__one"]).select("cluster", "size", F.col("upto___one").cast("int").alias("number"))
    within = Window.partitionBy("cluster").orderBy("step", "id")
    return member.withColumn("place", F.row_number().over(within)).join(number, "cluster").select("id", F.col("number").alias("cluster"), "place", "size")


def aligned(members: DataFrame, sims: DataFrame, words: DataFrame, cut) -> DataFrame:
    """cluster, id, word, strand, shift, aligned: members laid over the first one of their cluster.

    A member takes strand and offset from the nearest earlier member (by place in the
    cluster) that it has an edge with; one that has no earlier neighbour, from its best edge to a
    member that is laid already.  Every round lays all members whose neighbour is laid; then
    every cluster is shifted to start at column 0."""
    width = words.select("id", F.length("word").alias("width"))
    flip = F.when(F.col("strand") == "+", "+").otherwise("-")
    a, b = width.select(F.col("id").alias("id_a"), F.col("width").alias("wa")), width.select(F.col("id").alias("id_b"), F.col("width").alias("wb"))
    base = sims.join(a, "id_a").join(b, "id_b")
    forth = base.select(F.col("id_a").alias("from"), F.col("id_b").alias("to"), "sim", flip.alias("s"), F.col("off").alias("o"), F.col("wa").alias("wf"), F.col("wb").alias("wt"))
    # Seen from the second word, the first lies the other way; on the reverse strand its far end comes first.
    back = base.select(F.col("id_b").alias("from"), F.col("id_a").alias("to"), "sim", flip.alias("s"), F.when(F.col("strand") == "+", -F.col("off")).otherwise(F.col("off") + F.col("wb") - F.col("wa")).alias("o"), F.col("wb").alias("wf"), F.col("wa").alias("wt"))
    arcs = forth.unionByName(back)
    of = members.select("id", "cluster", "place")
    arcs = cut(arcs.join(of.select(F.col("id").alias("from"), F.col("cluster").alias("cf"), F.col("place").alias("pf")), "from").join(of.select(F.col("id").alias("to"), F.col("cluster").alias("ct"), F.col("place").alias("pt")), "to").where("cf = ct").drop("ct"))
    nearest = arcs.where("pf < pt").groupBy("to").agg(F.max_by("from", F.struct("pf", "sim")).alias("from"))
    chosen = cut(arcs.join(nearest, ["from", "to"]))
    done = cut(members.where("place = 1").select("id", "cluster", F.lit("+").alias("strand"), F.lit(0).alias("shift")))
    following = [chosen, arcs]
    while True:
        reached = following[0].join(done.select(F.col("id").alias("from"), F.col("strand").alias("fs"), F.col("shift").alias("fo")), "from").join(done.select(F.col("id").alias("to")), "to", "left_anti")
        strand = F.when(F.col("fs") == "+", F.col("s")).otherwise(F.when(F.col("s") == "+", "-").otherwise("+"))
        place = F.col("fo") + F.when(F.col("fs") == "+", F.col("o")).otherwise(F.col("wf") - F.col("o") - F.col("wt"))
        ring = reached.groupBy(F.col("to").alias("id"), F.col("cf").alias("cluster")).agg(F.max_by(F.struct(strand.alias("strand"), place.alias("shift")), F.struct("sim", -F.col("from"))).alias("r"))
        ring = cut(ring.select("id", "cluster", "r.strand", "r.shift"))
        if ring.isEmpty() and following[0] is arcs:
            break
        # When no nearest earlier member is laid any more, one round goes by the best edges of all.
        following = following[::-1] if ring.isEmpty() or following[0] is arcs else following
        done = cut(done.unionByName(ring))
    least = done.groupBy("cluster").agg(F.min("shift").alias("least"))
    out = done.join(least, "cluster").join(words, "id").withColumn("shift", F.col("shift") - F.col("least"))
    turned = F.when(F.col("strand") == "-", revcomp(F.col("word"))).otherwise(F.col("word"))
    return out.withColumn("aligned", F.concat(F.repeat(F.lit("."), F.col("shift")), turned)).drop("least")
