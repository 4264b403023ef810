"""Conversation tries, hard negatives and packing against brute force."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import TEXTS

from strandloom.llm import conversation_trie, hard_negatives, list_ranking, packing, registry
from strandloom.llm.common import text_bytes

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def slow_trie(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            content = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conversations[conv].append((turn is not None, turn or 0, content, role, text))
    own = {c: [(x[3], x[4]) for x in sorted(turns)] for c, turns in conversations.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    sys.setrecursionlimit(10_000)

    @lru_cache(None)
    def below(node):
        leaves, spared = int(not children[node]), (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        for child in children[node]:
            more = below(child)
            leaves, spared = leaves + more[0], spared + more[1]
        return leaves, spared

    out = Counter()
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(rebuilt[c]) == len(node))))
        out[(min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def odd_conversations():
    rng = random.Random(3)
    ids = [None, -3, -7, 0, 1, 2, 3, 4, 5, 6, 9, 10, 10**12, *range(20, 40)]
    rows = [(rng.choice(ids), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "a"]), rng.choice([None, "", "é", "xxx"])) for _ in range(400)]
    rows += [(5, k, "user", "one conversation of half the rows") for k in range(300)]
    return rows + [(7, 0, "user", "x" * 500_000)] * 2


@pytest.mark.parametrize("limit", [60, 1 << 16])
def test_trie_of_odd_conversations(spark, limit):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, 7, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, place int, key string, __part int")
    turns = conversation_trie.ordered_turns(table.repartition(5))
    got = conversation_trie.trie(*conversation_trie.with_shared_heads(turns), limit=limit)
    assert Counter(map(tuple, got.collect())) == slow_trie(rows)


def test_trie_of_the_table_and_of_nothing(spark, data_dir, table):
    got = registry.op11_conversation_trie(spark, data_dir)
    assert Counter(map(tuple, got.collect())) == slow_trie(map(tuple, table("conversations").select("conv_id", "turn", "role", "text").collect()))
    none = conversation_trie.ordered_turns(table("conversations").limit(0))
    assert conversation_trie.trie(none, conversation_trie.lengths(none)).collect() == []


def test_long_lists_are_hashed_in_pieces(spark):
    members = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 7)) AS key", "id AS conv_id")
    want = defaultdict(list)
    for key, conv in members.collect():
        want[key].append(conv)
    got = dict(map(tuple, conversation_trie.list_digests(members.repartition(3)).collect()))
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("n,limit", [(1, 1), (2, 2), (3, 2), (500, 10), (500, 1000)])
def test_list_ranking(spark, n, limit):
    order = list(range(100, 100 + n))
    random.Random(n).shuffle(order)
    rows = [(x, order[k - 1] if k else None, order[k + 1] if k + 1 < n else None) for k, x in enumerate(order)]
    got = list_ranking.ranks(spark.createDataFrame(rows, "id long, prev long, next long"), limit)
    assert sorted(map(tuple, got.collect())) == sorted((x, k) for k, x in enumerate(order))


def slow_negatives(rows):
    used = []
    for vec, vector, label in rows:
        if vec is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            moved = math.fmod(label + 1, 10) if vec % 7 == 0 else label
            used.append((vec, [math.floor(256 * float(x)) for x in vector], int(moved)))
    out = Counter()
    for i, (vec, vector, label) in enumerate(used):
        if vec % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, other, strict=False)), w, j) for j, (w, other, _) in enumerate(used)]
        positives = sorted(x for x in scored if x[2] != i and used[x[2]][2] == label)[:5]
        others = sorted(x for x in scored if used[x[2]][2] != label)
        for p in positives:
            fit = [x for x in others if 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]][:5]
            for rank, x in enumerate(fit):
                out[(vec, p[1], rank + 1, x[1], -p[0], -x[0])] += 1
    return out


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ZONES", 3)
    rng, rows = random.Random(5), []
    for i in range(600):
        size = rng.choice([0, 3, 4]) if i % 50 == 0 else 4
        parts = [None if i % 61 == 0 else 0.0, float("nan") if i % 59 == 0 else 0.125, 0.5, -0.25, rng.random() * 0.1, 3e4 if i % 83 == 0 else 0.25]
        rows.append((rng.choice([None, 0, 100, 200, -100, 7, rng.randint(-50, 900)]), None if i % 97 == 0 else [rng.choice(parts) for _ in range(size)], rng.choice([None, 1, 1, 1, 2, -3, 9])))
    table = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, block int, rows string, rank int")
    read = [tuple(r)[:3] for r in table.collect()]
    assert Counter(map(tuple, hard_negatives.mine(table.repartition(3)).collect())) == slow_negatives(read)
    assert hard_negatives.mine(table.limit(0)).collect() == []
    alone = table.where("vec_id = 200").limit(1)
    assert hard_negatives.mine(alone).collect() == []


def test_zone_maps_exclude_blocks_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    rows = [(k, (centres[k % 8] + 0.02 * rng.normal(size=8)).tolist(), k % 8) for k in range(4001) if k % 7]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    blocks = hard_negatives.blocks(hard_negatives.participants(table))
    anchors = blocks.select("rows", "ids", "labels", "vectors").mapInArrow(hard_negatives._anchors(100, 5), hard_negatives._ANCHOR)
    read = hard_negatives.chosen_blocks(anchors, blocks, True).selectExpr("sum(length(rows) / 8)").first()[0]
    assert read < 0.15 * blocks.count() * anchors.count()
    assert Counter(map(tuple, hard_negatives.mine(table).collect())) == slow_negatives(map(tuple, table.collect()))


def test_hilbert_curve_visits_neighbours():
    cells = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    place = hard_negatives.hilbert_index(cells, 3)
    path = cells[np.argsort(place)]
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_scores_beyond_floating_point_are_exact():
    a, b = np.array([[2**27 + 1, 3]]), np.array([[2**27 - 1, 5]])
    assert hard_negatives.scores(a, b).tolist() == [[(2**27 + 1) * (2**27 - 1) + 15]]


def check_pieces(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in texts:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(doc, len(ids), zlib.crc32(ids))] += 1
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    crcs = {}
    for doc, text in texts:
        crcs.setdefault(doc, []).append(np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    for doc, own in documents.items():
        assert sum(r["length"] for r in own) == sum(map(len, crcs[doc]))
        starts = Counter((r["start"], r["length"], r["doc_tokens"]) for r in own)
        for r in own:
            assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in crcs[doc])
        if len(crcs[doc]) == 1:
            at = 0
            for start, length, _ in sorted(starts):
                assert start == at
                at += length
    assert set(documents) == {doc for doc, _ in texts}


def test_packing_of_odd_texts(docs, no_docs):
    check_pieces(packing.pack(docs, VOCABULARY, 2).collect(), TEXTS)
    assert packing.pack(no_docs, VOCABULARY, 2).collect() == []


def test_packing_of_the_table(spark, data_dir, table):
    pieces = registry.op13_packing(spark, data_dir)
    check_pieces(pieces.collect(), [(r["doc_id"], r["text"]) for r in table("documents").collect()])
    assert packing.padding(pieces).first()["padded"] == 0


def test_words_encode_as_whole_texts():
    coder, rng = packing.Words(VOCABULARY), random.Random(1)
    letters = [*"abAB'st,.;:!?()\"<|>-_ 1²½\n\t 　éÉ́̊Σσİßǅ日本😀‍\u0000\x1c\x85", "<|endoftext|>", "'re", "'LL", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for begin in range(0, len(texts), 50):
        part = texts[begin : begin + 50]
        tokens, bounds = coder.encode(*text_bytes(pa.array(part)))
        for k, text in enumerate(part):
            assert tokens[bounds[k] : bounds[k + 1]].tolist() == coder.coder.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_in_bounded_calls():
    coder = packing.Words(VOCABULARY)
    whole, calls = coder.coder, []

    class Watched:
        def encode_batch_fast(self, words, **options):
            calls.append(len(words))
            return whole.encode_batch_fast(words, **options)

    coder.coder = Watched()
    texts = [" ".join(f"w{k}x" for k in range(a, a + 15_000)) for a in (0, 15_000, 20_000)]
    tokens, bounds = coder.encode(*text_bytes(pa.array(texts)))
    again, _ = coder.encode(*text_bytes(pa.array(texts)))
    assert again.tolist() == tokens.tolist()
    for k, text in enumerate(texts):
        assert tokens[bounds[k] : bounds[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids
    assert max(calls) <= 1 << 13 and sum(calls) == 35_000


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 500)
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdé.,'") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + "y" * 2000
    coder = packing.Words(VOCABULARY)
    assert packing._long(coder, np.frombuffer(text.encode(), np.uint8)).tolist() == coder.coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity,n,most", [(4096, 300, 4095), (4096, 300, 400), (4096, 3, 3000), (4096, 1, 7), (64, 200, 40), (4096, 3, 2100), (4096, 0, 5)])
def test_differencing(capacity, n, most):
    rng = random.Random(n)
    sizes = [rng.randint(max(1, most // 2 if n == 3 else 1), most) for _ in range(n)]
    subsets = packing.balanced(sizes, capacity)
    assert sorted(i for s in subsets for i in s) == list(range(n))
    sums = [sum(sizes[i] for i in s) for s in subsets]
    assert all(x <= capacity for x in sums)
    if n > 100:
        assert max(sums) - min(sums) <= max(sizes)
    covered = defaultdict(list)
    for window in packing.filled(sizes, capacity):
        total = sum(length for _, _, length in window)
        assert total == capacity or total & (total - 1) == 0
        for i, start, length in window:
            covered[i].append((start, length))
    for i, pieces in covered.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == sizes[i]


def test_differencing_balances_better_than_greedy_order():
    sums = [sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert max(sums) - min(sums) == 2
