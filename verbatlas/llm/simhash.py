"""SimHash near-duplicates by a self-join of the binary trie of the fingerprints.

1. Every whole text gets a 64-bit SimHash of its word shingles (Arrow batches).
2. Equal fingerprints collapse to one row, so copies cost nothing further on.
3. The upper levels of the trie are walked by dealing out rows. Two fingerprints
   within 3 bits differ in at most one bit of their upper or of their lower half,
   so there are two tries, one of them over the halves swapped, and in the upper
   levels of each (all within the first half) a budget of one bit is enough: a node
   is joined with itself and with the nodes that differ from it in one bit, which
   gives each row 1 + depth places in a trie. The depth grows with the logarithm of
   the rows, so nodes hold a bounded number of them at any size; a node that holds
   more than its share (similar texts share their first bits) is cut into chunks by
   a hash, and each pair of chunks is joined.
4. Each pair of nodes is one group: a task walks the rest of both sub-tries together
   with the whole error budget, and returns only a spanning forest of the links found
   (connectivity needs no more), so a dense group emits no quadratic result.
5. Components of the forests, over all node pairs, by distributed star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import bounded_batches, connected_components, materialise

#: Over-full nodes up to which their table (24 bytes a row) is broadcast; more of them are joined by a shuffle.
FEW_NODES = 100_000
UNIT = ["low", "high", "c1", "c2"]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a UTF-8 text, repeats included."""
    w = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not w:
        return np.empty(0, np.uint64)
    x = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([x(b" ".join(w), 42)], np.uint64)
    join = b" ".join
    return np.fromiter((x(join(s), 42) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash, as an unsigned number; 0 without any word."""
    h = shingle_hashes(text or b"", words)
    if not len(h):
        return 0
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def depth_of(rows: int, leaf_size: int, least: int, half: int) -> int:
    """Levels to walk so that nodes hold about ``leaf_size`` rows, within the first half of the key."""
    return min(half, max(least, math.ceil(math.log2(max(1.0, rows / leaf_size)))))


def deal(rows: DataFrame, trie: list[str], depth: int, leaf_size: int) -> DataFrame:
    """Rows of ``rows(*trie, key, rep, ...)`` with (low, high, c1, c2) of each pair of nodes they are joined in, and their ``side``.

    Nodes are the first ``depth`` bits of ``key``, in each of the tries that the
    columns ``trie`` name. Sides 0 and 1 are joined, or side 2 with itself. Two rows
    whose first bits differ in one place at most meet in exactly one pair.
    """
    first = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    rows = rows.withColumn("p", first)
    full = materialise(rows.groupBy(*trie, "p").agg(F.count("*").alias("n")).where(F.col("n") > leaf_size).select(*trie, "p", F.ceil(F.col("n") / leaf_size).cast("int").alias("n")), "full-nodes")
    n = full.count()
    some = F.broadcast(full) if n <= FEW_NODES else full
    near = F.explode(F.array(F.col("p"), *(F.col("p").bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(depth))))
    if n:
        rows = rows.join(some.withColumnRenamed("n", "own_n"), [*trie, "p"], "left")
        other = some.withColumnsRenamed({"p": "q", "n": "other_n"})
        rows = rows.withColumn("q", near).join(other, [*trie, "q"], "left")
    else:
        rows = rows.withColumn("q", near).withColumns({"own_n": F.lit(1), "other_n": F.lit(1)})
    one = lambda c: F.coalesce(c, F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), one("own_n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), one("other_n") - 1)))
    before = (F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("own") < F.col("other")))
    same = (F.col("p") == F.col("q")) & (F.col("own") == F.col("other"))
    return rows.withColumns(
        {
            "low": F.least("p", "q"), "high": F.greatest("p", "q"), "side": F.when(same, 2).when(before, 0).otherwise(1),
            "c1": F.when(before, F.col("own")).otherwise(F.col("other")), "c2": F.when(before, F.col("other")).otherwise(F.col("own")),
        }
    ).drop("p", "q", "own", "other", "own_n", "other_n")


def similar(a: np.ndarray, b: np.ndarray | None, budget: int, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i into a, j into b) of sorted, distinct uint64 values at Hamming distance <= budget.

    ``b`` None joins a with itself (i < j). Both tries are walked together in
    frontiers of at most about ``step`` node pairs, depth first, and the values below
    small ones are compared about ``step`` pairs at a time, so memory is bounded.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(depth: int) -> tuple[np.ndarray, np.ndarray]:
        if depth not in ones:
            bit = np.uint64(63 - depth)
            count = lambda x: np.concatenate([[0], np.cumsum((x >> bit) & np.uint64(1), dtype=np.int32)]).astype(np.int32)
            ones[depth] = (count(a), count(a) if own else count(b))
            if own:
                ones[depth] = (ones[depth][0], ones[depth][0])
        return ones[depth]

    start = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int32)
    stack = [(0, start)]
    while stack:
        depth, f = stack.pop()
        la, ha, lb, hb, err = f
        small = (ha - la).astype(np.int64) * (hb - lb) <= 16
        if depth == 64:
            small[:] = True
        if small.any():
            sl, sh, tl, th = la[small], ha[small], lb[small], hb[small]
            n = ((sh - sl) * (th - tl)).astype(np.int64)
            total, end = np.cumsum(n), 0
            while end < len(n):
                at, end = end, max(end + 1, int(np.searchsorted(total, (total[end - 1] if end else 0) + step, side="right")))
                part = slice(at, end)
                m = n[part]
                which = np.repeat(np.arange(len(m)), m)
                k = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                width = (th[part] - tl[part])[which]
                i, j = sl[part][which] + k // width, tl[part][which] + k % width
                ok = np.bitwise_count(a[i] ^ b[j]) <= budget
                if own:
                    ok &= i < j
                if ok.any():
                    yield i[ok], j[ok]
            f = f[:, ~small]
            la, ha, lb, hb, err = f
        if not f.shape[1]:
            continue
        ca, cb = level(depth)
        ma, mb = ha - (ca[ha] - ca[la]), hb - (cb[hb] - cb[lb])
        parts = [
            np.stack([la, ma, lb, mb, err]),
            np.stack([ma, ha, mb, hb, err]),
            np.stack([la, ma, mb, hb, err + 1]),
            np.stack([ma, ha, lb, mb, err + 1])[:, ~((la == lb) & (ha == hb))] if own else np.stack([ma, ha, lb, mb, err + 1]),
        ]
        g = np.concatenate(parts, axis=1)
        g = g[:, (g[0] < g[1]) & (g[2] < g[3]) & (g[4] <= budget)]
        for at in range(0, g.shape[1], step):
            stack.append((depth + 1, g[:, at : at + step]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n nodes."""
    root = np.arange(n)
    for i, j in links:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, lo, hi = i[apart], j[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(root, hi, lo)
            while True:  # shorten the paths
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _join_leaves(budget: int):
    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        key = rows.column("key").to_numpy().view(np.uint64)
        rep = rows.column("rep").to_numpy()
        first, second = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        order = first[np.argsort(key[first], kind="stable")]
        if (side == 2).any():
            both, links = order, similar(key[order], None, budget)
        else:
            other = second[np.argsort(key[second], kind="stable")]
            both = np.concatenate([order, other])
            links = ((i, j + len(order)) for i, j in similar(key[order], key[other], budget))
        root = forest(len(both), links)
        moved = np.flatnonzero(root != np.arange(len(both)))
        return pa.table({"src": pa.array(rep[both[moved]], pa.int64()), "dst": pa.array(rep[both[root[moved]]], pa.int64())})

    return run


def trie_links(reps: DataFrame, budget: int = 3, leaf_size: int = 4096, least_depth: int = 5) -> DataFrame:
    """Edges (src, dst) that connect all rows of ``reps(fp, rep)`` at ``budget`` (3 at most) or fewer differing bits.

    ``fp`` is distinct; the edges span the same components as all links do.
    """
    if budget > 3:
        raise ValueError("one bit in a half is enough for a budget of 3 at most")
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    keys = reps.select("rep", F.posexplode(F.array(F.col("fp"), swapped)).alias("turn", "key"))
    depth = depth_of(reps.count(), leaf_size, least_depth, 32)
    dealt = deal(keys, ["turn"], depth, leaf_size)
    return dealt.groupBy("turn", *UNIT).applyInArrow(_join_leaves(budget), "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3, leaf_size: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of ``budget`` or fewer bits).

    One row per row of ``docs``; a null doc_id has its row and is the component of
    null ids only. Null and empty texts have fingerprint 0 and are
    linked with each other like any others; fewer words than a shingle make one
    shingle of them all; repeated doc_ids each keep their row; other columns are
    ignored; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, words), "fingerprints")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.col("fp")), "representatives")
    found = connected_components(trie_links(reps, budget, leaf_size))
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return fps.join(classes.join(lowest, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
