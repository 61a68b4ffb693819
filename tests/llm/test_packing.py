import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from verbatlas.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  x", "it's  we'll 12345 ½ ²³ x­", "<|endoftext|> a <|endoftext|>", "日本語 текст 👍🏽 é", "\x1c\x1d a\x85b c​",
    "'s's ''t '", "naïve — “quoted” … 5€", "\ttabs\r\n\r\n x\x0b\x0c ", "a" * 5000, "wörter und straße " * 2000, "ᾳ ǅ ʰ ͅ ⅷ ٣",
]


def test_encoder_equals_tokenizers():
    own, public = packing.encoder(PATH), Tokenizer.from_file(PATH)
    assert own.fast is not None
    rng = np.random.default_rng(8)
    letters = list("ab éß'’ \t\n.,!1٣½ʼ́​ \x1c\x85<|>%ÀñȺ—")
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    for t in texts:
        assert own(t).tolist() == public.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def check(rows, packed, size):
    public = Tokenizer.from_file(PATH)
    want = {}
    for i, text in rows:
        ids = [*public.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size if len(ids) > size else len(ids)
        cuts = [0, *range(first, len(ids), size)] if first else list(range(0, len(ids), size))
        for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            want[i, k] = (s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want
    assert len(packed) == len(want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_pack_is_whole_gapless_and_tight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(1, 140)))) for i in range(600)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, length int, piece string")
    packed = packing.pack(docs, PATH, 128, shard_items=300).collect()
    assert any(r.generations and r.gained for r in packed)  # the shards are the work of crossovers
    n = check(rows, packed, 128)
    total = sum(r.length for r in packed)
    assert n <= 1.02 * -(-total // 128) + 3
    ids = packing.sequences(docs, spark.createDataFrame(packed), PATH, 128).collect()
    assert len(ids) == n and sum(len(r.ids) for r in ids) == total and max(len(r.ids) for r in ids) <= 128


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    packed = packing.pack(docs, PATH).collect()
    assert sorted(r.offset for r in packed) == [0, 3, 6, 9, 12] and len({r.sequence_id for r in packed}) == 1
    assert packing.pack(docs.where("false"), PATH).collect() == []


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 400)
    a, b = (packing.best_fit(lengths, rng.permutation(400), 100) for _ in range(2))
    child = packing.crossover(lengths, a, b, 100, rng)
    assert child.min() == 0 and np.bincount(child, lengths).max() <= 100
    best, begun, _ = packing.evolve(lengths, [a, b], 100, [1])
    assert packing.fitness(lengths, best) <= min(packing.fitness(lengths, a), packing.fitness(lengths, b)) and best.max() < begun


def triplets(n, capacity, seed):
    """Lengths that fill ``n`` bins exactly, three in each."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(int(0.38 * capacity), int(0.49 * capacity)))
        b = int(rng.integers(capacity // 4, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return np.array(out)


def test_crossover_beats_best_fit_on_a_hard_instance(monkeypatch):
    lengths = triplets(40, 1000, 0)
    bins = lambda b: int(b.max()) + 1
    plain = bins(packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 1000))
    how = {"population": 8, "generations": 50}
    real, calls = packing.crossover, []
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or real(*a))
    best, begun, done = packing.evolve(lengths, [], 1000, [1], **how)
    assert plain >= 45 and bins(best) <= 44 < begun and np.bincount(best, lengths).max() <= 1000
    assert done == 50 and len(calls) == 400
    monkeypatch.setattr(packing, "crossover", lambda lengths, mother, father, capacity, rng: mother.copy())
    assert bins(packing.evolve(lengths, [], 1000, [1], **how)[0]) == begun


def test_islands_migrate_and_report(spark):
    lengths = triplets(30, 500, 3)
    items = spark.createDataFrame([(i, 0, int(n), "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, other string")
    few = {r.doc_id: r for r in packing.group(items, 500, epochs=1, population=6, generations=8).collect()}
    many = {r.doc_id: r for r in packing.group(items, 500, epochs=5, population=6, generations=8).collect()}
    bins = lambda rows: len({r.sequence_id for r in rows.values()})
    plain = int(packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), 500).max()) + 1
    assert len(few) == len(many) == 90 and 30 <= bins(many) <= bins(few) <= plain and bins(many) < plain
    assert few[0].generations == 3 * 8 and many[0].generations > 24 and many[0].gained > 0
