"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets form a class.  Tokens (shingle hashes) are ranked
by an estimate of their frequency, rare ones first; two sets that are similar
enough share a token of their prefixes in that order (any order is
right, a good one is fast), and the first that they share stands early enough in both to leave room for
their overlap.  Similar classes (equal minhashes and like sizes) are
gathered in groups of bounded size, and the matrix holds which group has which prefix
token, with its members' sizes and the room behind the token.  Two groups meet only where sizes and room
allow a link, and are a pair only if slightly longer prefixes share several tokens; then each member is bounded by its overlap with the other group's token union, and only
groups that qualify are opened.  Verified links are reduced to a spanning forest
before they leave a task, so no group of copies becomes all its pairs.

Defined cases: a null or empty text has no set, links with nothing and is its own
component; a text with fewer words than a shingle has one shingle, all its words;
null doc_ids are never the least of a component with other ids; repeated rows are
copies of one class, and ``deduplicate`` keeps one row of a component whatever its ids are;
a very long text is one task's work, and alone in its group; an empty table gives an
empty result; other columns are not read.  Sets are of 64-bit hashes, classes of 64-bit digests: among a billion
documents the chance that any two classes are confused is about three percent.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import attach, carried, lower_bytes, mix, releasing, saved, shuffle_parts, slices, split_words, text_bytes
from strandloom.llm.components import components

#: Counters of the frequency sketch (a power of two) and of one block of it.
COUNTERS, BLOCK = 1 << 21, 1 << 16
#: Tokens that a linked pair shares in prefixes that are longer by all but one of them (fewer if its sets are smaller).
SHARED = 4
#: Classes of one group and tokens of their sets, about.
GROUP, GROUP_TOKENS = 64, 1 << 20
#: Groups of one token that meet in one task; more frequent tokens are split.
SPLIT = 1000
#: Partners of one group that are verified in a row; a group of more goes to more tasks.
PARTNERS = 64
#: Tasks that add frequency sketches before the last sum.
ADDERS = 64
#: Candidate rows up to which their identifiers are broadcast (16 bytes each).
BROADCAST_ROWS = 500_000

_SLIM = "doc_id long, mark long, n int, key long, label long, block int, counts binary"
_U = np.uint64


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, A-Z lower-cased."""
    data, offsets = text_bytes(text)
    words, bounds, _, _ = split_words(lower_bytes(data), offsets)
    coded = words.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, _U)
    hashed = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else known
    rolled = hashed[: max(0, len(hashed) - k + 1)].copy()
    for j in range(1, k):
        rolled = mix(rolled * _U(0x9E3779B97F4A7C15) + hashed[j : j + len(rolled)])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            sets.append(np.frombuffer(hashlib.blake2b(hashed[a:b].tobytes(), digest_size=8).digest(), _U))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def class_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def group_label(tokens: np.ndarray, percent: int) -> int:
    """Two minhashes and the size class, in one number; any labels give right results."""
    size = int(np.log(len(tokens)) / np.log(100 / percent) / 2) if percent < 100 else len(tokens)
    least = [int(mix(tokens * _U(c)).min()) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    return int(mix(np.array([(least[0] * 31 + least[1] * 17 + size) % (1 << 64)], dtype=_U))[0].astype(np.int64))


def least_overlap(n: np.ndarray | int, percent: int):
    """Tokens that a set of size n shares at least with any set it links to."""
    return (percent * n + 99) // 100


def _first_pass(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for piece in slices(batch):
                sets = shingle_sets(piece.column(2), k)
                sketch += np.bincount((np.concatenate(sets) & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                n = np.array([len(s) for s in sets], np.int32)
                none = n == 0
                keys = pa.array([class_key(s) if len(s) else 0 for s in sets], pa.int64(), mask=none)
                labels = pa.array([group_label(s, percent) if len(s) else 0 for s in sets], pa.int64(), mask=none)
                yield _slim(piece.column(0), piece.column(1), pa.array(n), keys, labels, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()))
        if sketch.any():
            used = [(k, _squeezed(b)) for k, b in enumerate(sketch.reshape(-1, BLOCK)) if b.any()]
            m, longs = len(used), pa.nulls(len(used), pa.int64())
            yield _slim(longs, longs, pa.nulls(m, pa.int32()), longs, longs, pa.array([k for k, _ in used], pa.int32()), pa.array([b for _, b in used], pa.binary()))

    return run


def _slim(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "mark", "n", "key", "label", "block", "counts"])


def _squeezed(counts: np.ndarray) -> bytes:
    """Counters of a block that are not zero: places, then counts."""
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype(np.uint32).tobytes() + counts[at].astype(np.int64).tobytes(), 1)


def _added(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = zlib.decompress(counts.as_py())
            n = len(raw) // 12
            own = total.setdefault(block, np.zeros(BLOCK, np.int64))
            own[np.frombuffer(raw, np.uint32, n)] += np.frombuffer(raw[4 * n :], np.int64)
    return total


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, own in _added(batches).items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_squeezed(own)], pa.binary())], names=["block", "counts"])


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, own in _added(batches).items():
        scaled = np.rint(4 * np.log2(1 + own)).astype(np.uint8)  # an order needs no exact counts
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([scaled.tobytes()], pa.binary())], names=["block", "counts"])


def frequency_ranks(sketch: DataFrame) -> np.ndarray:
    """Log-scaled token frequency by counter; two megabytes, whatever the input.

    Sketches are added as a tree: first within ``ADDERS`` times as many tasks as there
    are blocks, then by block."""
    schema = "block int, counts binary"
    near = sketch.withColumn("adder", F.spark_partition_id() % ADDERS).repartition("block", "adder").select("block", "counts").mapInArrow(_counts, schema)
    blocks = near.repartition("block").mapInArrow(_coarse, schema).collect()
    ranks = np.zeros(COUNTERS, np.uint8)
    for block, counts in blocks:
        ranks[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, np.uint8)
    return ranks


def _prefixes(k: int, percent: int, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch):
                tokens, keys, rooms, plain = [], [], [], []
                for s in shingle_sets(piece.column(0), k):
                    key = class_key(s) if len(s) else None
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    least = least_overlap(len(s), percent)
                    n = len(s) - least + min(SHARED, least)
                    r = rank[(s & _U(COUNTERS - 1)).astype(np.int64)]
                    # The order is (rank, hash); sets are sorted by hash, and a stable sort keeps that.
                    tokens.append(s[np.argsort(r, kind="stable")[:n]].view(np.int64))
                    keys.append(np.full(n, key, np.int64))
                    rooms.append(len(s) - np.arange(n, dtype=np.int32))
                    plain.append(np.arange(n) <= len(s) - least)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, keys, rooms, plain)], names=["token", "key", "room", "plain"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sets = [s for s in shingle_sets(piece.column(0), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "tokens"])

    return run


class _Forest:
    """Union-find over the members of two groups."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def linked_pairs(one: list[np.ndarray], two: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of ``one`` and of ``two`` (or within ``one``).

    A member of ``one`` whose overlap with the token union of ``two`` is too small opens nothing."""
    other = one if two is None else two
    union = np.unique(np.concatenate(other))
    sizes = np.array([len(s) for s in other])
    rows = []
    for i, s in enumerate(one):
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        if (union[at] == s).sum() >= least_overlap(len(s), percent):
            rows.append(i)
    if not rows:
        return []
    common = np.zeros((len(rows), len(other)), np.int64)
    width = max(1, (1 << 22) // max(len(rows), len(other)))
    for begin in range(0, len(union), width):
        part = union[begin : begin + width]
        common += (_incidence([one[i] for i in rows], part) @ _incidence(other, part).T).astype(np.int64)
    own = np.array([len(one[i]) for i in rows])
    linked = 100 * common >= percent * (own[:, None] + sizes[None, :] - common)
    shift = 0 if two is None else len(one)
    forest, links = _Forest(shift + len(other)), []
    for r, j in zip(*np.nonzero(linked), strict=True):
        i = rows[r]
        if (two is not None or i != j) and forest.join(i, int(j) + shift):
            links.append((i, int(j)))
    return links


def _incidence(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, tokens[0]) : np.searchsorted(s, tokens[-1], side="right")]
        at = np.searchsorted(tokens, s)
        out[i, at[tokens[np.minimum(at, len(tokens) - 1)] == s]] = 1
    return out


def _members(block) -> tuple[list[int], list[np.ndarray]]:
    members = block.as_py()
    return [m["key"] for m in members], [np.frombuffer(m["tokens"], _U) for m in members]


def _linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs, strict=True) if pairs else ([], []))], names=["a", "b"])


def _within(percent: int):
    """Links among the members of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                keys, sets = _members(block)
                yield _linked([(keys[i], keys[j]) for i, j in linked_pairs(sets, None, percent)])

    return run


def _across(percent: int):
    """Links between groups and their partners, which follow them; a row without ``partner`` opens a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets = [], []
        for batch in batches:
            for partner, block in zip(batch.column("partner").to_pylist(), batch.column("members"), strict=True):
                if partner is None:
                    keys, sets = _members(block)
                    continue
                those, found = _members(block)
                yield _linked([(keys[i], those[j]) for i, j in linked_pairs(sets, found, percent)])

    return run


def may_link(percent: int):
    """Whether the sizes of two groups' members, and the room behind their token, allow a link; columns of g begin with g, those of h with h."""
    sizes = (F.col("gl") * percent <= F.col("hm") * 100) & (F.col("hl") * percent <= F.col("gm") * 100)
    return (F.col("g") < F.col("h")) & sizes & (F.least("gr", "hr") * (100 + percent) >= (F.col("gl") + F.col("hl")) * percent)


def _meetings(matrix: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups g < h that tokens let meet, and how many do (``common``).

    A token of many groups is dealt over tasks: its left rows by a hash, its right rows to each."""
    crowded = saved(matrix.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > SPLIT))
    left, right = (matrix.select("token", F.col("group").alias(x), F.col("least").alias(f"{x}l"), F.col("most").alias(f"{x}m"), F.col("room").alias(f"{x}r")) for x in "gh")
    if crowded.isEmpty():
        return left.join(right, "token").where(may_link(percent)).groupBy("g", "h").agg(F.count(F.lit(1)).alias("common"))
    salts = crowded.select("token", F.ceil(F.col("groups") / SPLIT).cast("int").alias("salts"), "groups")
    left = attach(left, salts, "token", "groups").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("g"), "salts"), F.lit(0).cast("long")))
    right = attach(right, salts, "token", "groups").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("long"))))
    return left.drop("salts", "groups").join(right.drop("salts", "groups"), ["token", "salt"]).where(may_link(percent)).groupBy("g", "h").agg(F.count(F.lit(1)).alias("common"))


def _confirmed(met: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``met`` whose longer prefixes share as many tokens as those of a linked pair do.

    Pairs that have met on so many already are sure.  For the others each group's tokens (of at most
    ``GROUP_TOKENS`` or one class's) come as a list."""
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))
    needs = placed.groupBy("group").agg(F.min(need).alias("need"))
    met = met.join(needs.select(F.col("group").alias("g"), F.col("need").alias("gn")), "g").join(needs.select(F.col("group").alias("h"), F.col("need").alias("hn")), "h")
    met = saved(met.select("g", "h", "common", F.least("gn", "hn").alias("need")))
    doubtful = met.where("common < need").select("g", "h", "need")
    asked = doubtful.select(F.explode(F.array("g", "h")).alias("group")).distinct()
    lists = saved(placed.join(asked, "group").groupBy("group").agg(F.collect_set("token").alias("tokens")))
    both = doubtful.join(lists.select(F.col("group").alias("g"), F.col("tokens").alias("gt")), "g").join(lists.select(F.col("group").alias("h"), F.col("tokens").alias("ht")), "h")
    return met.where("common >= need").select("g", "h").unionByName(both.where(F.size(F.array_intersect("gt", "ht")) >= F.col("need")).select("g", "h"))


def _beside_partners(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """group, copy, partner, members: the sets of the groups on the left of ``pairs``, and behind them those of their partners.

    A group of many partners has copies, and its pairs are dealt over them at both ends,
    so that neither a group's pairs nor its sets gather in one task."""
    sides = {x: pairs.groupBy(F.col(x).alias("group")).agg(F.count(F.lit(1)).alias("partners")).withColumn("copies", F.ceil(F.col("partners") / PARTNERS).cast("long")) for x in "gh"}
    spread = {}
    for x, other in (("g", "h"), ("h", "g")):
        many = saved(sides[x].where("copies > 1"))
        table = many.select(F.col("group").alias(x), "partners", F.col("copies").alias("n"))
        pairs = attach(pairs, table, x, "partners").withColumn(f"{x}_copy", F.pmod(F.xxhash64(other), F.coalesce("n", F.lit(1).cast("long")))).drop("partners", "n")
        few = (lambda t: F.broadcast(t)) if many.count() <= BROADCAST_ROWS else (lambda t: t)
        used = blocks.join(F.broadcast(sides[x].select("group")) if sides[x].count() <= BROADCAST_ROWS else sides[x].select("group"), "group", "left_semi")
        held = used.join(few(many.select("group", "copies")), "group", "left")
        spread[x] = held.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), "members")
    there = spread["h"].select(F.col("group").alias("h"), F.col("copy").alias("h_copy"), "members")
    partners = pairs.join(there, ["h", "h_copy"]).select(F.col("g").alias("group"), F.col("g_copy").alias("copy"), F.col("h").alias("partner"), "members")
    opened = spread["g"].select("group", "copy", F.lit(None).cast("long").alias("partner"), "members")
    parts = shuffle_parts(blocks.sparkSession)
    return opened.unionByName(partners).repartition(parts, "group", "copy").sortWithinPartitions("group", "copy", F.col("partner").isNotNull())


def class_links(texts: DataFrame, classes: DataFrame, ranks: np.ndarray, k: int, percent: int) -> DataFrame:
    """Links (a, b) between class keys that connect all classes that similar pairs connect."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    prefixes = saved(texts.select("text").mapInArrow(releasing(_prefixes(k, percent, shared)), "token long, key long, room int, plain boolean"))
    ends = prefixes.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("rows"))
    shared_tokens = saved(ends.where("lo < hi").select("token", "rows"))
    postings = saved(attach(prefixes, shared_tokens, "token", "rows").where(F.col("rows").isNotNull()).select("token", "key", "room", "plain").distinct())

    met = classes.join(postings.select("key").distinct(), "key")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_TOKENS))
    crowd = saved(met.groupBy("label").agg(parts.alias("parts"), F.count(F.lit(1)).alias("rows")))
    member = attach(met.select("label", "key", "n", "rep"), crowd, "label", "rows").select("key", "n", "rep", F.xxhash64("label", F.pmod(F.xxhash64("key"), "parts")).alias("group"))
    member = saved(member)
    bounds = (F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    placed = saved(postings.join(member, "key"))
    matrix = saved(placed.where("plain").groupBy("token", "group").agg(*bounds))
    pairs = saved(_confirmed(_meetings(matrix, percent), placed, percent))

    crowds = member.groupBy("group").count().where("count > 1").select("group")
    wanted = pairs.select(F.explode(F.array("g", "h")).alias("group")).unionByName(crowds).distinct()
    wanted = saved(member.join(wanted, "group"))
    ids = wanted.select(F.col("rep").alias("__rep")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi").select("text").mapInArrow(releasing(_sets(k)), "key long, tokens binary")
    sets = found.join(wanted.select("key", "group"), "key").groupBy("key").agg(F.first("group").alias("group"), F.first("tokens").alias("tokens"))
    blocks = saved(sets.groupBy("group").agg(F.collect_list(F.struct("key", "tokens")).alias("members")))
    links = "a long, b long"
    within = blocks.where(F.size("members") > 1).select("members").mapInArrow(releasing(_within(percent)), links)
    return saved(within.unionByName(_beside_partners(pairs, blocks).mapInArrow(releasing(_across(percent)), links)))


def _joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n, component (a class key; null without a set) and component_id for every row."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    first = saved(texts.mapInArrow(releasing(_first_pass(k, percent)), _SLIM))
    slim = first.where(F.col("block").isNull()).select("doc_id", "mark", "n", "key", "label")
    classes = slim.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("label").alias("label"))
    classes = saved(classes.withColumn("component", F.col("key")))
    links = class_links(texts.drop("mark"), classes.drop("component"), frequency_ranks(first.where(F.col("block").isNotNull()).select("block", "counts")), k, percent)
    if not links.isEmpty():
        linked = components(links).join(classes, F.col("node") == F.col("key")).select("key", "root", "rep")
        linked = saved(linked)
        least = saved(linked.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("classes")))
        roots = attach(linked.select("key", "root"), least, "root", "classes").select("key", F.col("root").alias("__root"), "least")
        classes = classes.join(roots, "key", "left").withColumns({"rep": F.coalesce("least", "rep"), "component": F.coalesce("__root", "component")})
    table = saved(classes.select("key", F.col("rep").alias("component_id"), "component", "copies"))
    return attach(slim.select("doc_id", "mark", "n", "key"), table, "key", "copies").drop("key", "copies")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of
    distinct k-word shingles; component_id is the least doc_id reachable by links."""
    out = _joined(docs, k, percent)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without all but one of each component; columns unchanged.

    The row of the least doc_id stays (nulls come last), of several such rows the one
    whose text and then whose columns hash least.  Documents without a set all stay."""
    found = saved(_joined(docs, k, percent).where(F.col("component").isNotNull()).select("component", "doc_id", "mark"))
    pair = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = saved(found.groupBy("component").agg(F.min(pair).alias("best"), F.count(F.lit(1)).alias("rows")))
    marked = attach(found, best.where("rows > 1"), "component", "rows").where(F.col("rows").isNotNull())
    stays = pair == F.col("best")
    marked = saved(marked.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), stays.alias("stays")).count())
    gone, tied = (marked.where(which).select("__id", "__mark") for which in (~F.col("stays"), F.col("stays") & (F.col("count") > 1)))
    coded = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("hash"), carried(docs))

    def among(pairs: DataFrame, how: str) -> DataFrame:
        few = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        return coded.join(few, F.col("doc").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__mark")), how)

    if tied.isEmpty():
        return among(gone, "left_anti").select("row.*")
    one = among(tied, "left_semi").groupBy("doc", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return among(gone.unionByName(tied), "left_anti").select("row.*").unionByName(one.select("row.*"))
