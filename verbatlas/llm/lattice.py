"""Embedding near-duplicates by E8 lattice hashing.

1. Vectors that are null, zero or hold null or non-finite components link with
   nothing. Equal vectors collapse to one representative with its count; it carries
   the keys of its cells from here on.
2. In each of ``tables`` tables a vector is projected by a random matrix to
   ``blocks`` x 8 numbers, shifted, and decoded to the nearest point of the lattice
   E8 in every block: its home cell. The ``probes`` next nearest cells (neighbours
   by the 240 shortest vectors of E8) are probed too.
3. Only (cell, id) rows are shuffled first; cells that hold a single vector, which
   are almost all, are dropped before any vector moves.
4. Vectors meet where one is at home and the other at home or probing. Cells with
   more than ``block_rows`` rows are cut into blocks, each pair of blocks being a
   work unit, so a hot cell is spread over many tasks and no pair is lost.
5. The cosine is verified in double precision. A pair that meets in several cells
   counts in the first of them only, which each task can tell by itself, so links
   are counted without ever listing them; a spanning forest of each unit goes on
   to the distributed components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import Forest, connected_components, drop_tables, materialise


@dataclass(frozen=True)
class Lattice:
    """Recall of a pair at cosine 0.95 is 0.97 with these values, at 0.97 over 0.999 (see the README)."""

    tables: int = 12
    blocks: int = 2
    probes: int = 3
    spread: float = 0.72
    seed: int = 8
    block_rows: int = 2048


def shortest_vectors() -> np.ndarray:
    """The 240 vectors of E8 of squared length 2."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _halves() -> np.ndarray:
    """One of each pair of opposite shortest vectors: 120, the others being their negatives."""
    every = shortest_vectors()
    return every[[k for k, v in enumerate(every) if v[np.flatnonzero(v)[0]] > 0]]


_HALF = _halves()
_SHORTEST = np.concatenate([_HALF, -_HALF])


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    near = np.rint(x)
    off = x - near
    worst, row = np.abs(off).argmax(axis=1), np.arange(len(x))
    odd = near.sum(axis=1) % 2 != 0
    near[row, worst] += np.where(odd, np.where(off[row, worst] >= 0, 1.0, -1.0), 0.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _product(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x @ m, each row summed in the same order whatever the number of rows: a vector always has the same cells."""
    out = np.zeros((len(x), m.shape[1]))
    for k in range(m.shape[0]):
        out += x[:, k : k + 1] * m[k]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cells(unit: np.ndarray, how: Lattice) -> np.ndarray:
    """Keys (n, tables, 1 + probes) of unit vectors: the home cell first, then the nearest others."""
    n, d = unit.shape
    rng = np.random.default_rng(how.seed)
    projection = rng.normal(size=(d, how.tables * how.blocks * 8)) * how.spread
    shift = rng.uniform(0, 2, how.tables * how.blocks * 8)
    odd = rng.integers(0, 1 << 63, how.blocks * 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = _product(unit, projection) + shift
    wide = min(8, 2 + how.probes)
    out = np.empty((n, how.tables, 1 + how.probes), np.uint64)
    for t in range(how.tables):
        point, cost = [], []
        for b in range(how.blocks):
            x = low[:, (t * how.blocks + b) * 8 : (t * how.blocks + b + 1) * 8]
            home = decode_e8(x)
            toward = _product(x - home, _HALF.T)
            toward = np.concatenate([toward, -toward], axis=1)  # how far the rest points to each neighbouring cell
            next_ = np.sort(np.argpartition(-toward, wide - 1, axis=1)[:, :wide], axis=1)
            more = 2 - 2 * np.take_along_axis(toward, next_, axis=1)
            order = np.argsort(more, axis=1, kind="stable")
            next_, more = np.take_along_axis(next_, order, axis=1), np.take_along_axis(more, order, axis=1)
            point.append(np.concatenate([home[:, None], home[:, None] + _SHORTEST[next_]], axis=1))
            cost.append(np.concatenate([np.zeros((n, 1)), more], axis=1))
        parts = []  # the hash of a block's point, for each of its choices
        for b, p in enumerate(point):
            whole = (2 * p).astype(np.int64).astype(np.uint64)
            parts.append(_mix((whole * odd[8 * b : 8 * b + 8]).sum(axis=2, dtype=np.uint64)) * np.uint64(2 * b + 1))
        total, key = cost[0], parts[0]
        for c, k in zip(cost[1:], parts[1:], strict=True):
            total = (total[:, :, None] + c[:, None, :]).reshape(n, -1)
            key = (key[:, :, None] + k[:, None, :]).reshape(n, -1)
        best = np.argsort(total, axis=1, kind="stable")[:, : 1 + how.probes]
        own = ((t + 1) * 0x9E3779B97F4A7C15 + d * 0xD6E8FEB86659FD93) % (1 << 64)  # vectors of other lengths never share a cell
        out[:, t] = _mix(np.take_along_axis(key, best, axis=1) + np.uint64(own))
    return out


def usable(vector: Column) -> Column:
    """True for vectors with finite components only, not all zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows of vectors of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_length(column: pa.ListArray | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors of a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        places = np.flatnonzero(lengths == d)
        yield places, _matrix(column if len(places) == len(column) else column.take(pa.array(places)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, exactly, so that squares of very large or small components stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_rows(distinct: DataFrame, how: Lattice) -> DataFrame:
    """``distinct`` with ``keys`` added: the cells of its ``vector`` in every table, each with the home cell first."""
    at = distinct.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                keys = np.empty((part.num_rows, how.tables * (1 + how.probes)), np.uint64)
                for places, x in by_length(part.column(at)):
                    keys[places] = cells(_unit(x), how).reshape(len(places), -1)
                values = pa.array(keys.reshape(-1).view(np.int64))
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), values)
                yield pa.RecordBatch.from_arrays([*part.columns, held], [*part.schema.names, "keys"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return distinct.mapInArrow(run, f"{ddl}, keys array<long>")


def _pairs(unit: np.ndarray, low: int = 48, step: int = 1 << 16) -> Iterator[tuple[int, int] | tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by unit: (start, end) of each large unit, and index pairs of small ones, at most ``step`` at a time."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.empty(0, int)
    ends = np.r_[starts[1:], len(unit)].astype(int)
    size = ends - starts
    for s, e in zip(starts[size > low], ends[size > low], strict=True):
        yield int(s), int(e)
    after = np.concatenate([np.arange(n - 1, -1, -1) for n in size[size <= low]] or [np.empty(0, int)])  # rows behind each in its unit
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[size <= low], ends[size <= low], strict=True)] or [np.empty(0, int)])
    total = np.cumsum(after)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        m = after[at:end]
        i = np.repeat(rows[at:end], m)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = end


def _near(x: np.ndarray, unit: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows of one unit at cosine ``threshold`` or more, some at a time.

    All are decided by the same sum, whatever the size of their unit: the matrix product only leaves out those that are clearly below.
    """
    for a, b in _pairs(unit):
        if isinstance(a, int):
            for s in range(a, b, 512):
                i, j = np.nonzero(x[s : min(s + 512, b)] @ x[a:b].T >= threshold - 1e-9)
                up = i + s < j + a
                i, j = i[up] + s, j[up] + a
                for at in range(0, len(i), 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    yield p[near], q[near]
        else:
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            yield a[near], b[near]


def _verify_length(rows: pa.Table, x: np.ndarray, threshold: float, how: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, other, links) of rows sorted by (unit, rep): a spanning forest of the links, and the links counted here by rep."""
    unit, key, rep, home, block, weight = (rows.column(c).to_numpy() for c in ("unit", "key", "rep", "home", "block", "weight"))
    own = rows.column("own").to_numpy()  # the unit joins a block with itself
    _, first, code = np.unique(rep, return_index=True, return_inverse=True)
    every = rows.column("keys").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), how.tables, 1 + how.probes)[first]
    links, tree = np.zeros(len(first)), Forest(len(rep))
    for i, j in _near(x, unit, threshold):
        ok = (home[i] | home[j]) & (own[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        tree.link(i, j)
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            a, b = every[code[p]], every[code[q]]
            meets = np.stack([(b == a[:, :, :1]).any(axis=2), (a == b[:, :, :1]).any(axis=2)])
            table = meets.any(axis=0).argmax(axis=1)  # the first table where the two meet
            k = np.arange(len(p))
            none = np.uint64(np.iinfo(np.uint64).max)
            event = np.minimum(np.where(meets[0, k, table], a[k, table, 0], none), np.where(meets[1, k, table], b[k, table, 0], none))
            here = event == key[p].view(np.uint64)
            links += np.bincount(code[p[here]], weight[q[here]], len(links)) + np.bincount(code[q[here]], weight[p[here]], len(links))
    moved = np.flatnonzero(tree.root != np.arange(len(rep)))
    hit = np.flatnonzero(links)
    return (
        np.concatenate([rep[moved], rep[first[hit]]]),
        np.concatenate([rep[tree.root[moved]], rep[first[hit]]]),
        np.concatenate([np.zeros(len(moved)), links[hit]]).astype(np.int64),
    )


def _verify(threshold: float, how: Lattice):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((rows.column("rep").to_numpy(), rows.column("unit").to_numpy()))))
        found = [_verify_length(rows.take(pa.array(places)), _unit(x), threshold, how) for places, x in by_length(rows.column("vector"))]
        return pa.table({name: pa.array(np.concatenate(c), pa.int64()) for name, c in zip(("rep", "other", "links"), zip(*found, strict=True), strict=True)})

    return run


def units(keys: DataFrame, how: Lattice) -> DataFrame:
    """Rows (unit, key, rep, home, block, own) such that two rows of a key meet in exactly one unit.

    Keys with a single row or nobody at home are left out. A key with more than
    ``block_rows`` rows is dealt to blocks by a hash of rep; a row goes to the units
    that pair its block with each other block, and with itself (``own``).
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 AND any").select("key", "n")
    blocks = F.ceil(F.col("n") / how.block_rows).cast("int")
    return (
        keys.join(counts, "key")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("unit"), "key", "rep", "home", "block", (F.col("block") == F.col("with")).alias("own"))
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, how: Lattice = Lattice()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding)``.

    ``n_links`` counts the other rows at cosine ``threshold`` or more that the cells
    bring together, ``component_id`` is the smallest vec_id reachable over links,
    ``kept`` whether it is the row's own. Vectors link with those of their own length
    only. Unusable vectors (null, zero, null or non-finite components) have no links
    and are their own component. A repeated vec_id has a row for each of its rows,
    which count as links of each other if they are near; a null vec_id has its row,
    but is the component of null ids only. Other columns are ignored; no rows give
    no rows.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    mark = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("again"), "vector").alias("h2")]
    marked = materialise(ids.select("vec_id", F.when(usable(F.col("vector")), F.struct(*mark)).alias("mark")), "vector-ids")
    good = ids.where(usable(F.col("vector")))
    distinct = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # a number of its own for each distinct vector, fixed by being written once
    reps = materialise(cell_rows(distinct.select(F.monotonically_increasing_id().alias("rep"), "least", "weight", "vector", *mark), how), "vector-reps")
    keyed = reps.select("rep", F.posexplode("keys").alias("pos", "key")).select("key", "rep", (F.col("pos") % (1 + how.probes) == 0).alias("home"))
    dealt = materialise(units(keyed, how), "cell-units")
    groups = max(1, dealt.count() // 20_000)
    found = materialise(
        dealt.join(reps.select("rep", "weight", "vector", "keys"), "rep")
        .groupBy(F.pmod("unit", F.lit(groups)).alias("group"))
        .applyInArrow(lambda t: _verify(threshold, how)(t), "rep long, other long, links long"),
        "vector-links",
    )
    counts = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("rep <> other").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    full = materialise(
        reps.select("rep", "least", "weight", "h1", "h2").join(counts, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left").select(
            "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class")
        ),
        "vector-classes",
    )
    drop_tables(spark, dealt, found, reps)
    lowest = full.groupBy("class").agg(F.min("least").alias("component_id"))
    known = marked.where("mark IS NOT NULL").select("vec_id", "mark.*").join(full.join(lowest, "class").select("h1", "h2", "n_links", "component_id"), ["h1", "h2"])
    alone = marked.where("mark IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = known.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
