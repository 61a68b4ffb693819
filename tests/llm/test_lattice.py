import numpy as np

from verbatlas.llm import lattice


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (300, 8))
    got = lattice.decode_e8(x)
    twice = 2 * got
    assert np.array_equal(twice, np.rint(twice)) and len({*map(float, (twice % 2).std(axis=1))}) == 1 and not (got.sum(axis=1) % 2).any()
    d = ((x - got) ** 2).sum(axis=1)
    for v in lattice.shortest_vectors():
        assert (d <= ((x - got - v) ** 2).sum(axis=1) + 1e-12).all()


def test_cells_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    x = lattice._unit(rng.normal(size=(200, 24)))
    how = lattice.Lattice()
    whole = lattice.cells(x, how)
    assert np.array_equal(whole[37:38], lattice.cells(x[37:38], how)) and np.array_equal(whole[5:90], lattice.cells(x[5:90], how))
    assert all(len(set(c)) == len(c) for c in whole[:, 0].tolist())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x, z = lattice._unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    z = lattice._unit(z - (z * x).sum(axis=1)[:, None] * x)
    for cosine, least in ((0.95, 0.9), (0.97, 0.99), (0.99, 0.999)):
        a, b = (lattice.cells(v, lattice.Lattice()) for v in (x, cosine * x + np.sqrt(1 - cosine**2) * z))
        met = (b == a[:, :, :1]).any(axis=(1, 2)) | (a == b[:, :, :1]).any(axis=(1, 2))
        assert met.mean() >= least


def brute(rows, threshold=0.95):
    """By row: links to other rows, the smallest id reachable."""
    unit = {}
    for n, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit[n] = x / np.linalg.norm(x)
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                if root[a] != root[b]:
                    old, new = root[b], root[a]
                    root = [new if r == old else r for r in root]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[n] and rows[m][0] is not None]
        least = min(ids, default=None)
        out.append((i, links[n], least, i == least))
    return sorted(out, key=str)


def test_links_and_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((i, [float(c) for c in np.float32(base + 0.02 * rng.normal(size=16))]))
            i += 1
    first = rows[0][1]
    rows += [(1000 + k, first) for k in range(90)] + [(2000, [3 * c for c in first])]
    rows += [(4000 + k, [float(c) for c in np.float32(np.ones(3) + 0.01 * rng.normal(size=3))]) for k in range(9)] + [(4100, [0.0, 1.0])] * 2  # other lengths
    rows += [(1, first), (1, first), (5, rows[5][1]), (None, first), (None, [1.0, -1.0, 5.0, 0.0, 0.0])]  # repeated and null ids
    rows += [(5000, [1e200, 1e200] + [0.0] * 14), (5001, [1e-200, 1e-200] + [0.0] * 14), (5002, [1e200, 0.0] + [0.0] * 14), (5003, [5e-324, 5e-324] + [0.0] * 14)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None), (3001, [0.0] * 16), (3001, [0.0] * 16), (3002, [nan] + [1.0] * 15), (3003, [inf] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3006, [])]
    df = spark.createDataFrame([(k, v, 7, True) for k, v in rows], "vec_id long, embedding array<double>, rep int, home boolean")
    want = brute(rows)
    for parts in (1, 8):
        got = lattice.near_duplicates(df.repartition(parts), how=lattice.Lattice(block_rows=16)).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == want
    none = df.where("false")
    assert lattice.near_duplicates(none).collect() == []
    assert [tuple(r) for r in lattice.near_duplicates(df.where("vec_id = 3002")).collect()] == [(3002, 0, 3002, True)]
    short = spark.createDataFrame([(1, [1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in lattice.near_duplicates(short).collect()] == [(1, 0, 1, True)]
