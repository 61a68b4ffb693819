import numpy as np

from verbatlas.llm import near_copies


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_unit_equals_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64)
    sig = np.repeat(base, 20, axis=0)
    flips = rng.random((600, 256)) < rng.choice([0.01, 0.05], 600)[:, None]
    sig ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    key = sig[:, 0] & np.uint64(0xFFFFFFFFFF000000)
    most = 30

    def brute(pairs):
        root = list(range(600))
        find = lambda x: x if root[x] == x else find(root[x])
        for i, j in pairs:
            if int(key[i] ^ key[j]).bit_count() <= 3 and int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        return [find(i) for i in range(600)]

    own = near_copies.link_unit(key, sig, np.full(600, 2), 3, most, step=100)
    assert own.tolist() == brute((i, j) for i in range(600) for j in range(i + 1, 600))
    side = rng.integers(0, 2, 600)
    cross = near_copies.link_unit(key, sig, side, 3, most)
    assert cross.tolist() == brute((i, j) for i in range(600) for j in range(600) if side[i] == 0 and side[j] == 1)


def test_recall_and_precision_by_similarity(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(150):
        words = list(rng.choice(vocab, int(rng.integers(150, 400))))
        texts.append(" ".join(words))
        other = words.copy()
        for k in rng.choice(len(other), max(1, int(len(other) * rng.choice([0.005, 0.01, 0.1]))), replace=False):
            other[k] = "edit"
        texts.append(" ".join(other))
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(900, None, ""), (901, "", ""), (902, "a b", ""), (903, "A  b", ""), (904, texts[0], ""), (904, texts[0], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = near_copies.near_copies(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[901] == 900 and by[903] == 902 and by[904] == 0
    high = [by[i] == by[i + 1] for i in range(0, 300, 2) if jaccard(texts[i], texts[i + 1]) >= 0.85]
    low = [by[i] == by[i + 1] for i in range(0, 300, 2) if jaccard(texts[i], texts[i + 1]) < 0.7]
    assert len(high) > 60 and np.mean(high) > 0.95
    assert len(low) > 20 and not any(low)
    assert near_copies.near_copies(docs.where("false")).collect() == []


def spread_pairs(rng, similarities, each):
    """Texts in pairs whose five-word shingles have about the given similarity: one run of words in each is its own."""
    texts = []
    for j in similarities:
        for _ in range(each):
            words = [f"v{k}" for k in rng.integers(0, 1 << 40, 304)]
            n = round(300 * (1 - j) / (1 + j))
            own = lambda: [f"v{k}" for k in rng.integers(0, 1 << 40, max(1, n - 4))]  # noqa: E731, B023
            at = int(rng.integers(5, 290 - n))
            texts += [" ".join(words[:at] + own() + words[at + max(1, n - 4) :]) for _ in range(2)]
    return texts


def test_links_are_the_pairs_of_exact_similarity(spark):
    texts = spread_pairs(np.random.default_rng(2), np.linspace(0.65, 0.9, 26), 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    exact = np.array([jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)])
    linked = np.array([by[i] == by[i + 1] for i in range(0, len(texts), 2)])
    assert not linked[exact < 0.8].any()
    assert (exact >= 0.8).sum() > 150 and linked[exact >= 0.8].mean() > 0.97
    just = (exact >= 0.8) & (exact < 0.83)
    assert just.sum() > 30 and linked[just].mean() > 0.93


def test_blocks_of_a_large_component_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(200)]
    texts = []
    for _ in range(120):
        other = words.copy()
        for k in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            other[k] = f"e{rng.integers(1 << 40)}"
        texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    for how in (near_copies.Tables(), near_copies.Tables(block_rows=20)):
        by = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, how).collect()}
        assert [by[i] for i in range(120)] == root
    assert 1 < len(set(root)) < 120


def test_links_do_not_depend_on_the_depth_of_the_trie(spark):
    how = near_copies.Tables(tables=4)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    sig = np.repeat(base, 2, axis=0) ^ np.packbits(rng.random((600, 256)) < 0.04, axis=1, bitorder="little").view(np.uint64)
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "rep long, sig binary")
    found = [{tuple(sorted(r)) for r in near_copies.links(reps, near_copies.Tables(tables=4, leaf_size=n)).collect()} for n in (how.leaf_size, 1)]
    assert len(found[0]) > 150 and found[0] == found[1]


def test_one_row_of_each_class_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    word = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, word("a")), (1, word("a")), (1, word("b")), (2, word("a") + " end"), (None, word("c")), (None, word("c")), (None, word("b")), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, word("a")), (1, word("b")), (None, word("c")), (7, None)], key=str)
