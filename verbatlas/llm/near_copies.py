"""Near copies at a given similarity: the trie self-join of ``simhash`` over several tables, then exact Jaccard.

A single 64-bit fingerprint at 3 bits finds pairs that differ in a few shingles of
a hundred. To reach pairs of Jaccard similarity 0.8, whose fingerprints differ in
about 15 % of all bits, every text gets a SimHash signature of 256 bits over its
set of shingles; each table takes 28 of them, in an order of its own, as the key
of a binary trie that is joined with itself at 2 bits. Key pairs that meet are
candidates if their whole signatures differ in no more bits than hardly any pair
at the similarity does. Candidates decide nothing: within each component of them
the whole shingle sets of the texts are compared, and only pairs at the
similarity or above are links.

The tries are dealt out as in ``simhash``: two keys within 2 bits differ in at most
one bit of one half, so each table has two tries, the halves swapped in one, whose
upper levels are walked with one bit, at 1 + depth places a row. What is found does
not depend on the depth. Tables that fit one node need no such levels. A task
returns spanning forests only, and skips pairs that are connected already, so a
dense group costs little more than its size. A large component is cut into blocks,
each pair of which is a work unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.llm.common import Forest, bounded_batches, connected_components, fresh, lean, materialise
from verbatlas.llm.lattice import _mix
from verbatlas.llm.simhash import _BITS, _PLACE, UNIT, deal, depth_of, shingle_hashes, similar


@dataclass(frozen=True)
class Tables:
    """``slack``: bits of the signature by which candidates may differ beyond what ``similarity`` has on average, as a share.

    It is about four standard deviations. ``block_rows``, ``block_shingles``: what a block of a large component holds.
    """

    words: int = 5
    similarity: float = 0.8
    tables: int = 32
    bits: int = 28
    budget: int = 2
    slack: float = 0.085
    leaf_size: int = 1 << 18
    seed: int = 6
    block_rows: int = 1024
    block_shingles: int = 1 << 21

    @property
    def most(self) -> int:
        """Differing signature bits up to which two texts are candidates."""
        cosine = 2 * self.similarity / (1 + self.similarity)
        return int(256 * (math.acos(cosine) / math.pi + self.slack))

    def positions(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.stack([rng.permutation(256)[: self.bits] for _ in range(self.tables)])


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The hashes of the distinct shingles, in order."""
    return np.unique(shingle_hashes(text or b"", words))


def sign(h: np.ndarray) -> bytes:
    """256 SimHash bits of a set of shingles; all zero for the empty set."""
    if not len(h):
        return bytes(32)
    out = []
    for k in range(4):
        each = h if not k else _mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        counts = np.bincount((each.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
        out.append(np.packbits(2 * (counts @ _BITS).ravel() > len(h), bitorder="little"))
    return np.concatenate(out).tobytes()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, rep, sig, n) of every row: ``rep`` is a hash of the whole set of shingles, ``n`` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(xxhash.xxh64_intdigest(h.tobytes()), sign(h), len(h)) for t in b.column(2) for h in [shingle_set(t.as_py(), words)]]
            rep, sig, n = zip(*rows, strict=True) if rows else ((), (), ())
            rep = pa.array(np.array(rep, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), rep, pa.array(sig, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "text_key", "rep", "sig", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return bounded_batches(rows).mapInArrow(lean(run), "doc_id long, text_key long, rep long, sig binary, n long")


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def table_keys(reps: DataFrame, how: Tables) -> DataFrame:
    """(tab, key, rep, sig): the key has the table's bits at the top of a 64-bit number."""
    places = how.positions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(_bytes(b.column(1)), axis=1, bitorder="little")
            for t, p in enumerate(places):
                whole = np.zeros((b.num_rows, 64), np.uint8)
                whole[:, : how.bits] = bits[:, p]
                key = np.packbits(whole, axis=1).view(">u8").ravel().astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key.view(np.int64)), b.column(0), b.column(1)], ["tab", "key", "rep", "sig"])

    return reps.select("rep", "sig").mapInArrow(lean(run), "tab int, key long, rep long, sig binary")


def link_unit(key: np.ndarray, sig: np.ndarray, side: np.ndarray, budget: int, most: int, step: int = 1 << 16) -> np.ndarray:
    """Roots of the rows of one work unit; sides 0 and 1 are joined, or side 2 with itself."""
    forest = Forest(len(key))
    groups, starts, ends = [], [], []
    for rows in (np.flatnonzero(side != 1), np.flatnonzero(side == 1)):
        rows = rows[np.argsort(key[rows], kind="stable")]
        distinct, first = np.unique(key[rows], return_index=True)
        groups.append((rows, distinct))
        starts.append(first)
        ends.append(np.r_[first[1:], len(rows)].astype(int))
    (rows_a, keys_a), (rows_b, keys_b) = groups
    own = not (side != 2).any()
    if own:
        rows_b, starts[1], ends[1] = rows_a, starts[0], ends[0]
        pairs = similar(keys_a, None, budget)
        same = np.flatnonzero(ends[0] - starts[0] > 1)
        pairs = (p for more in ([(same, same)], pairs) for p in more)
    else:
        pairs = similar(keys_a, keys_b, budget)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(sig[x] ^ sig[y]).sum(axis=-1, dtype=np.int32) <= most

    for i, j in pairs:
        m, n = ends[0][i] - starts[0][i], ends[1][j] - starts[1][j]
        small = m * n <= 4096
        i_, j_, m_, n_ = i[small], j[small], m[small], n[small]
        total = np.cumsum(m_ * n_)
        at = 0
        while at < len(i_):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
            size = (m_ * n_)[at:end]
            which = np.repeat(np.arange(at, end), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            x, y = rows_a[starts[0][i_[which]] + k // n_[which]], rows_b[starts[1][j_[which]] + k % n_[which]]
            apart = forest.root[x] != forest.root[y]
            x, y = x[apart], y[apart]
            ok = near(x, y)
            forest.link(x[ok], y[ok])
            at = end
        for a, b in zip(i[~small], j[~small], strict=True):  # large groups: only what isn't connected yet
            xs, ys = rows_a[starts[0][a] : ends[0][a]], rows_b[starts[1][b] : ends[1][b]]
            for x in xs:
                rest = ys[forest.root[ys] != forest.root[x]]
                for s in range(0, len(rest), step):
                    y = rest[s : s + step]
                    y = y[near(np.full(len(y), x), y)]
                    if len(y):
                        forest.link(np.full(len(y), x), y)
    return forest.root


def _join_leaves(how: Tables):
    def run(rows: pa.Table) -> pa.Table:
        rep = rows.column("rep").to_numpy()
        rows = rows.take(pa.array(np.argsort(rep, kind="stable")))  # the smallest id of a component is its root
        rep = rows.column("rep").to_numpy()
        sig = np.ascontiguousarray(_bytes(rows.column("sig"))).view(np.uint64)
        root = link_unit(rows.column("key").to_numpy().view(np.uint64), sig, rows.column("side").to_numpy(), how.budget, how.most)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"src": pa.array(rep[moved], pa.int64()), "dst": pa.array(rep[root[moved]], pa.int64())})

    return run


def links(reps: DataFrame, how: Tables) -> DataFrame:
    """Edges (src, dst) of ``reps(rep, sig)`` that span the components of the candidates found."""
    if how.budget > 3:
        raise ValueError("one bit in a half is enough for a budget of 3 at most")
    half = how.bits // 2
    depth = depth_of(reps.count(), how.leaf_size, 0, half)
    keys = table_keys(reps, how).withColumn("turn", F.lit(0))
    if depth:
        low = F.shiftrightunsigned(F.shiftleft("key", half), half)  # the bits behind the first half
        swapped = F.shiftleft("key", half).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("key").bitwiseXOR(low), 64 - half), 64 - how.bits))
        keys = keys.withColumn("key", F.explode(F.array(F.struct(F.lit(0).alias("turn"), "key"), F.struct(F.lit(1).alias("turn"), swapped.alias("key")))))
        keys = keys.select("tab", "rep", "sig", "key.turn", "key.key")
    dealt = deal(keys, ["tab", "turn"], depth, how.leaf_size)
    return dealt.groupBy("tab", "turn", *UNIT).applyInArrow(lean(_join_leaves(how)), "src long, dst long")


def verify_unit(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, most: int, similarity: float) -> np.ndarray:
    """Roots of the rows of one work unit over pairs of exact similarity; sides 0 and 1 are joined, or side 2 with itself.

    Every pair within ``most`` bits is compared by its whole sets unless it is connected already.
    """
    forest = Forest(len(sets))
    sizes = np.array([len(h) for h in sets], np.int64)
    second = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side != 1):
        y = second if side[x] == 0 else np.arange(x + 1, len(sets))
        y = y[forest.root[y] != forest.root[x]]
        y = y[np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]) - 1e-6]
        apart = np.bitwise_count(sig[y] ^ sig[x]).sum(axis=-1, dtype=np.int32)
        y = y[np.argsort(apart, kind="stable")[: int((apart <= most).sum())]]
        some = 8  # the nearest first: one link connects a row with all of a dense group
        while len(y):
            now, y = y[:some], y[some:]
            each = np.concatenate([sets[k] for k in now])
            found = sets[x][np.minimum(np.searchsorted(sets[x], each), sizes[x] - 1)] == each
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
            ok = now[both / (sizes[x] + sizes[now] - both) >= similarity]
            if len(ok):
                forest.link(np.full(len(ok), x), ok)
                y = y[forest.root[y] != forest.root[x]]
            some = min(2 * some, 256)
    return forest.root


def _verify(how: Tables):
    def run(rows: pa.Table) -> pa.Table:
        unit = rows.column("unit").to_numpy()
        rep = rows.column("rep").to_numpy()
        order = np.lexsort((rep, unit))
        unit, rep, side = unit[order], rep[order], rows.column("side").to_numpy()[order]
        sig = np.ascontiguousarray(_bytes(rows.column("sig"))).view(np.uint64)[order]
        held = rows.column("shingles")
        src, dst = [rep[:0]], [rep[:0]]
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(unit)], strict=True):
            sets = [np.frombuffer(held[int(k)].as_py(), np.uint64) for k in order[a:b]]
            root = verify_unit(sig[a:b], sets, side[a:b], how.most, how.similarity)
            moved = np.flatnonzero(root != np.arange(len(root)))
            src.append(rep[a:b][moved])
            dst.append(rep[a:b][root[moved]])
        return pa.table({"src": pa.array(np.concatenate(src), pa.int64()), "dst": pa.array(np.concatenate(dst), pa.int64())})

    return run


def exact_links(docs: DataFrame, reps: DataFrame, candidates: DataFrame, how: Tables) -> DataFrame:
    """Edges (src, dst) that span the pairs of exact similarity within each component of ``candidates(node, component)``.

    A component of more rows or shingles than a block holds is cut into blocks by
    a hash, and each pair of blocks is a unit; small components share buckets.
    """
    members = materialise(
        reps.join(candidates, F.col("rep") == F.col("node")).select("rep", "text_key", "sig", "n", "component"), "candidates"
    )
    parts = F.greatest(F.ceil(F.count("*") / how.block_rows), F.ceil(F.sum("n") / how.block_shingles)).cast("int")
    large = members.groupBy("component").agg(parts.alias("blocks")).where("blocks > 1")
    total, rows = members.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(1, total * 4 // how.block_shingles, rows * 8 // how.block_rows)
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = pa.array([shingle_set(t.as_py(), how.words).tobytes() for t in b.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], held], ["rep", "sig", "component", "shingles"])

    whole = members.join(texts, "text_key").select(F.col("text").cast("binary").alias("text"), "rep", "sig", "component")
    whole = bounded_batches(whole).mapInArrow(lean(sets), "rep long, sig binary, component long, shingles binary")
    block, other = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        whole.join(large, "component", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", other)
        .withColumn("unit", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("side", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1))
        .withColumn("bucket", F.when(F.col("blocks") == 1, F.pmod("unit", F.lit(buckets))).otherwise(F.col("unit")))
        .select("bucket", "unit", "side", "rep", "sig", "shingles")
    )
    return dealt.groupBy("bucket").applyInArrow(lean(_verify(how)), "src long, dst long")


def _classes(docs: DataFrame, how: Tables) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (rep, least, class): ``least`` is the smallest doc_id of ``rep``."""
    sigs = materialise(signatures(docs, how.words), "signatures")
    reps = materialise(sigs.groupBy("rep", "sig", "n").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key")), "signature-reps")
    found = connected_components(exact_links(docs, reps, connected_components(links(reps, how)), how))
    return sigs, reps.join(found, F.col("rep") == F.col("node"), "left").select("rep", "least", F.coalesce("component", "rep").alias("class"))


def near_copies(docs: DataFrame, how: Tables = Tables()) -> DataFrame:
    """doc_id and component_id (smallest doc_id of the class of near copies) of every row of ``docs``.

    Null and empty texts are copies of each other; texts of fewer words than a
    shingle have one shingle of them all; repeated rows are copies; other columns
    are ignored; an empty table gives no rows.
    """
    sigs, classes = _classes(docs, how)
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return sigs.join(classes.join(least, "class").select("rep", "component_id"), "rep").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, how: Tables = Tables()) -> DataFrame:
    """Exactly one row of ``docs`` of each class of near copies: one with the smallest doc_id.

    Rows are told apart by doc_id and text, so ids may be null (they come last)
    or repeated; of rows that agree in both, any one is kept.
    """
    sigs, classes = _classes(docs, how)
    id, null = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull()
    first = F.min(F.struct(null.alias("no_id"), id.alias("id"), F.col("text_key").alias("text"))).alias("first")
    kept = sigs.join(classes.select("rep", "class"), "rep").groupBy("class").agg(first).select("first.*")
    *key, nth = fresh(docs.columns, "no_id", "id", "text_key", "nth")
    marked = docs.withColumns(dict(zip(key, (null, id, F.xxhash64("text")), strict=True))).join(kept.toDF(*key), key, "left_semi")
    return marked.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))).where(F.col(nth) == 1).drop(*key, nth)
