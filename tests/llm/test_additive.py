import numpy as np

from verbatlas.llm import additive


def brute(rows, k=5, every=50):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ok = [(i, v / np.abs(v).max()) for i, v in ok]
    best = {}
    for i, q in ok:
        if i % every == 0:
            for j, v in ok:
                if j != i and len(v) == len(q):
                    score = float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v)))
                    best.setdefault(i, {})[j] = max(score, best.get(i, {}).get(j, -2))
    return {i: [(j, s) for s, j in sorted(((s, j) for j, s in found.items()), key=lambda x: (-round(x[0], 12), x[1]))[:k]] for i, found in best.items()}


def test_encoding_reconstructs_and_a_wider_beam_is_no_worse():
    rng = np.random.default_rng(0)
    x = additive._unit(rng.normal(size=(1500, 24)))
    how = additive.Quantiser(books=6, words=64)
    books = additive.train(x, how)
    lost = {}
    for beam in (1, 8):
        codes, near = additive.encode(x, books, beam)
        back = sum(books[m][codes[:, m]] for m in range(6))
        assert np.allclose(back, near, atol=1e-4)
        lost[beam] = ((x - back) ** 2).sum(axis=1).mean()
    assert lost[8] < lost[1] < 0.5


def collected(df, **how):
    got = {}
    for r in additive.nearest(df, how=additive.Quantiser(books=8, words=64, **how)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(found) for q, found in got.items()}


def test_equals_brute_force_whatever_the_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in np.float32(rng.normal(size=24))]) for i in range(3000)]
    centre = rng.normal(size=24)
    rows += [(4000 + i, [float(c) for c in np.float32(centre + 0.05 * rng.normal(size=24))]) for i in range(1200)]  # a large group of near copies
    rows += [(5200 + i, rows[50][1]) for i in range(400)]  # copies: ties go to the smallest ids
    rows += [(6000 + i, [float(c) for c in rng.normal(size=7)]) for i in range(150)]  # another length
    rows += [(50, [float(c) for c in rng.normal(size=24)]), (100, rows[100][1]), (7, rows[9][1])]  # repeated ids, with other vectors and the same
    rows += [(7000, [1e200, 1e200] + [0.0] * 22), (7001, [1e200] + [0.0] * 23), (7050, [1e-200] * 24), (7051, [1e-200, 2e-201] + [0.0] * 22), (7052, [5e-324, 1.5e-323] + [0.0] * 22)]
    nan = float("nan")
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [nan] * 24), (9150, [None] + [1.0] * 23), (9200, [1.0]), (None, rows[0][1]), (9250, [])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    want = brute(rows)
    for parts, how in ((1, {}), (8, {"block_bytes": 24 * 8 * 20})):
        got = collected(df.repartition(parts), **how)
        assert set(got) == set(want)
        for q, found in got.items():
            assert [(r, j) for r, j, _ in found] == [(r + 1, j) for r, (j, _) in enumerate(want[q])], q
            assert all(abs(s - t) < 1e-12 for (_, _, s), (_, t) in zip(found, want[q]))
    assert abs(dict((j, s) for _, j, s in got[7000])[7001] - 0.5**0.5) < 1e-12


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in additive.nearest(df).collect())
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert additive.nearest(df.where("false")).collect() == []
