"""Centroid clusters, the conversation trie and document packing against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from landquill.llm import centroids, packing, prefix_trie, queries, vectors
from landquill.llm import textblocks as tb
from landquill.llm.word_ids import Coder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_clusters(rows, k, d, scale, rounds, seed="2"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(x)) for x in v]))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    places = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(places))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        for n, vs in mine.items():
            places[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i is None, i or 0, *reversed(nearest(v))) for i, v in kept)), places


@pytest.mark.parametrize("size", [1.0, 3e4, 1e8, 1e12])
def test_clusters_of_every_number_type(spark, size):
    """Ties on bisecting planes, repeated rows and ids, null ids, and components that need doubles, 64 bits or more."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 60), [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0, rng.uniform(-1, 1)]) * size for _ in range(4)]) for _ in range(120)]
    rows += [rows[0], rows[1], (None, [size] * 4), (7, None), (8, [1.0] * 3), (9, [1.0, None, 1.0, 1.0]), (10, [math.nan] * 4), (11, [math.inf] * 4), (12, []), (13, [0.0] * 4)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    members, places = centroids.cluster_vectors(table, k=9, d=4, scale=256, rounds=3)
    want, final = plain_clusters(rows, 9, 4, 256, 3)
    got = members.collect()
    fits = lambda x: x if x < 1 << 63 else None
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got if r.distance is not None) == [w for w in want if fits(w[3]) is not None]
    assert len(got) == len(want)
    assert {r.cluster: list(r.centroid) for r in places.collect()} == dict(enumerate(final))


def test_clusters_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(3, [1.0, 2.0]), (4, [5.0, 2.0])], "vec_id long, embedding array<float>")
    members, places = centroids.cluster_vectors(few, k=40, d=2)
    assert sorted(r.distance for r in members.collect()) == [0, 0] and places.count() == 2
    members, places = centroids.cluster_vectors(few.limit(0), k=40, d=2)
    assert members.collect() == places.collect() == []


def plain_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def visit(p):
        leaves, saved = (0 if kids[p] else 1), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in kids[p]:
            a, b = visit(q)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(str(c) for c in sorted(members[p]) if whole[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        visit(())
    return sorted(map(str, out))


def test_trie_over_many_shards(spark, monkeypatch):
    """Shared heads, copies of whole conversations, missing group heads, null turns, texts and ids, tied turns; shards of a few rows cut all of it."""
    rng = random.Random(9)
    rows = []
    for c in [*range(40), *range(100, 160), *range(203, 240, 4), 1001, 1002]:
        same = c % 3 == 0
        for t in range(rng.choice([1, 3, 9, 12])):
            rows.append((c, rng.choice([t, t, None, 1]) if c % 7 == 0 else t, rng.choice(["user", None, ""]) if not same else "user", rng.choice(["a", "é", "", None, "long " * 9]) if not same else f"t{t}"))
    rows += [(None, 0, "user", "x"), (0, 0, "user", "t0"), (0, 0, "user", "t0")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    want = plain_trie(rows)
    for least, most in ((500, 50_000), (3, 3), (1, 1)):
        monkeypatch.setattr(prefix_trie, "LEAST_ROWS", least)
        monkeypatch.setattr(prefix_trie, "MOST_ROWS", most)
        assert sorted(str(tuple(r)) for r in prefix_trie.conversation_trie(table).collect()) == want
    assert prefix_trie.conversation_trie(table.limit(0)).collect() == []
    # conversations that are left without turns are members of the root
    monkeypatch.setattr(prefix_trie, "_PIECE", 2)
    alone = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]
    assert sorted(str(tuple(r)) for r in prefix_trie.conversation_trie(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")).collect()) == plain_trie(alone)


TEXTS = ["", "a", "A1b2--c's don't <|endoftext|> x<|startoftext|>", "  x  ", "é́ café ÀB ǅ", "\x1c\x1d a\x1cb", "1234 ..,, '' \x00 \x7f", "ΑΣ ΣΑΣ", "日本 語　a b c d\x85e", "'s 't a's'", "<|end of text|>", "İ I ı", "a" * 3000, "̀x ́y", "¼² x²", "ﬀ ´ ¨ʹ;·"]


def test_ids_equal_the_library(spark):
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    coder, got = Coder(TOKENIZER), []
    for _ in range(2):  # the second time from memory
        got = []
        for _, _, data, where in tb.blocks(pa.array(docs + TEXTS, pa.large_string()), 1 << 16):
            ids, at = coder.encode(data, where)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(docs + TEXTS, add_special_tokens=False)]
    assert got == want


def packed_well(rows, capacity):
    """Every sequence is gapless and within capacity; how many there are, and the least that the lengths allow."""
    held = defaultdict(list)
    for sequence, offset, length in rows:
        held[sequence].append((offset, length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(n for _, _, n in rows) // capacity)


def test_ids_of_random_mixtures_equal_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1é' -.<|>,(́ñ´;≠\nsT'日  ~}{|") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", "a", "é", "'s", " ", ".", "<|startoftext|>", "1"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    coder, got = Coder(TOKENIZER), []
    for _, _, data, where in tb.blocks(pa.array(texts, pa.large_string())):
        ids, at = coder.encode(data, where)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_packing_of_documents(spark):
    long_text = " ".join(["one two three"] * 3000)
    rows = [(i % 40, t) for i, t in enumerate(TEXTS * 4)] + [(1, None), (None, "x"), (5, long_text), (5, long_text), (6, " ".join(["word"] * 2047)), (7, " ".join(["word"] * 2048))]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, tuple(ids[k : k + 2048])] += 1
    got = packing.pack_documents(docs, TOKENIZER).collect()
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    n, least = packed_well([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert n == least
    assert packing.pack_documents(docs.limit(0), TOKENIZER).collect() == []


def test_packing_over_levels_and_islands(spark, monkeypatch):
    """Lengths that are hard to fit, in small blocks: all placed once, and close to the least number of sequences."""
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(5)
    lengths = [rng.choice([34, 33, 32, 51, 49, 26, 100, 67, 1, 2]) for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(lengths)), "no long, length long")
    got = packing.pack(table, 100).collect()
    assert sorted(r.no for r in got) == list(range(300))
    n, least = packed_well([(r.sequence_id, r.offset, lengths[r.no]) for r in got], 100)
    assert n <= least * 1.04 + 2


def test_islands_improve_on_best_fit():
    """Triplets that fill bins exactly, which best fit by size does not find."""
    rng = np.random.default_rng(1)
    length = []
    for _ in range(30):
        a, b = rng.integers(380, 490), rng.integers(250, 300)
        length += [a, b, 1000 - a - b]
    groups = packing.Groupings(np.array(length), 1000, np.random.default_rng(2))
    first = groups.fresh(1, True)
    best = groups.evolve(first + groups.fresh(5, False), 60)[0]
    assert groups.fills(best).max() <= 1000 and groups.worth(best) >= groups.worth(first[0])
    assert sorted(np.unique(best)) == list(range(best.max() + 1)) and len(groups.fills(best)) <= len(groups.fills(first[0]))


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_document_packing(spark, sf).collect()
    ids = {}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids[r.doc_id] = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    n, least = packed_well([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert n <= least + 1
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(str(tuple(r)) for r in queries.op12_conversation_trie(spark, sf).collect()) == plain_trie(data)


def test_a_query_meets_a_falling_part_of_clustered_vectors():
    """The index is chosen anew for each size: recall stays, and the part of the vectors that a query meets falls as they grow."""
    rng = np.random.default_rng(0)
    parts = []
    for clusters in (20, 400, 4000):
        centre = rng.normal(size=(clusters, 32))
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        x = (centre[:, None] + rng.normal(size=(clusters, 15, 32)) * 0.03).reshape(-1, 32)
        q = x[:: max(1, len(x) // 40)][:40]
        near, of = np.argsort(-(q @ x.T), 1)[:, 1:11].ravel(), np.repeat(np.arange(len(q)), 10)
        scale = float(np.sqrt((x * x).sum(1)).max())
        index = vectors.choose_index(scale, q, x[near], of, x[rng.choice(len(x), min(1000, len(x)), False)])
        hashing = vectors.StableHash(scale, index)
        assert hashing.meet(q, x[near])[of, np.arange(len(of))].mean() >= 0.9
        parts.append(hashing.meet(q, x[rng.choice(len(x), min(4000, len(x)), False)]).mean())
    assert max(parts[1:]) < parts[0] and max(parts) < 0.15
