import re
import tracemalloc
from collections import defaultdict

import numpy as np
import xxhash

from verbatlas.llm import simhash


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {k: k for k in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_fingerprints_and_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"W{i}é" for i in range(300)]
    texts = {i: " ".join(rng.choice(vocab, rng.integers(1, 400))) for i in range(120)}
    for i in range(120, 200):
        words = texts[i - 120].split(" ")
        words[int(rng.integers(len(words)))] = "edited"
        texts[i] = "\x0b".join(words)
    texts |= {200: None, 201: "", 202: " \t\n", 203: "a", 204: "A", 205: "a b c", 206: "x " * 30000}
    docs = spark.createDataFrame([(k, t, "fp") for k, t in texts.items()], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, leaf_size=4).collect()}
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    assert {k: v[0] for k, v in got.items()} == fps
    assert {k: v[1] for k, v in got.items()} == brute_components(fps)
    assert len({v[1] for v in got.values()}) < len(texts) - 20


def test_repeated_and_null_ids_and_ties(spark):
    rows = [(5, "a b c d"), (5, "w x y z"), (9, "a b c d"), (7, "w x y z"), (7, "w x y z"), (None, "lone text here"), (None, "a b c d"), (None, "lone text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (7, 5), (7, 5), (None, None), (None, 5), (None, None)], key=str)
    assert simhash.near_duplicates(docs.where("false")).collect() == []


def test_dealing_joins_each_near_pair_once(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    hot = np.full(200, base[0] & np.uint64(0xFFFFFFFF00000000)) | rng.integers(0, 1 << 32, 200, dtype=np.uint64)  # one node holds most
    keys = np.unique(np.concatenate([base, base ^ np.uint64(1 << 62), hot]))
    df = spark.createDataFrame([(0, int(k), int(k)) for k in keys.view(np.int64)], "turn int, key long, rep long")
    depth = simhash.depth_of(len(keys), 32, 2, 32)
    assert depth == 4
    sides = defaultdict(lambda: ([], [], []))
    for r in simhash.deal(df, ["turn"], depth, 32).collect():
        sides[r.low, r.high, r.c1, r.c2][r.side].append(r.rep)
    met = defaultdict(int)
    for left, right, own in sides.values():
        assert not own or not left and not right
        assert max(len(left), len(right), len(own)) <= 64
        for pairs in ([(a, b) for a in left for b in right], [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]):
            for a, b in pairs:
                met[min(a, b), max(a, b)] += 1
    top = lambda k: (k & (1 << 64) - 1) >> 60
    values = [int(k) for k in keys.view(np.int64)]
    assert met == {(min(a, b), max(a, b)): 1 for i, a in enumerate(values) for b in values[i + 1 :] if (top(a) ^ top(b)).bit_count() <= 1}


def test_trie_join_equals_all_pairs_on_dense_values():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6)).astype(np.uint64)) if True else b for b in base for _ in range(30)]
    a = np.unique(np.array(near + list(base), np.uint64))
    b = np.unique(np.concatenate([a[::3], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    found = {(int(i), int(j)) for x, y in simhash.similar(a, b, 3, step=64) for i, j in zip(x, y)}
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 3}
    own = defaultdict(int)
    for x, y in simhash.similar(a, None, 3, step=64):
        for i, j in zip(x, y):
            own[int(i), int(j)] += 1
    assert set(own) == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
    assert set(own.values()) == {1}


def test_trie_join_holds_a_bounded_number_of_pairs():
    a = np.unique(np.random.default_rng(2).integers(0, 1 << 24, 1 << 16, dtype=np.uint64) << np.uint64(40))
    tracemalloc.start()
    found = sum(len(i) for i, _ in simhash.similar(a, None, 2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > len(a) // 2
    assert most < 32 << 20


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
