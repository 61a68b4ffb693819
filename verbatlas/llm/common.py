"""What the operators share: tables, folds, names, connected components."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.sources.batches import BATCH_BYTES, bounded_batches, lean
from verbatlas.sources.scratch import drop_tables, materialise, new_path, shared_dir

__all__ = ["BATCH_BYTES", "Forest", "bounded_batches", "connected_components", "drop_tables", "fold_ascii", "fresh", "held_out", "lean", "learnable", "materialise", "new_path", "shared_dir", "table", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that no column of a table has, whatever its case: the given ones, with underscores in front as needed."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


class Forest:
    """Components of numbers 0..n-1; ``root`` is always the smallest of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns labels from: crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the other folds; a null id is in none of them."""
    return F.coalesce(_fold(doc_id) != 0, F.lit(False))


def unit_hash(col: Column, seed: str) -> Column:
    """A number in [0, 1) from a value, the same on every run and in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(col.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def fold_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Nodes with more edges than this, and than one in ``HUBS`` of all, are hubs: fewer than 2 * ``HUBS`` of them, whatever the graph.
HUB_EDGES, HUBS = 512, 4096


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """One large-star or small-star step over edges (u > v).

    Every step links the neighbours of a node to the smallest of them, by a partial
    aggregation and a join back. Nodes of more than ``hub`` edges don't take part in
    the shuffled join, where all their edges would meet in one task: they are so
    few that their minima are broadcast, and their edges stay where they are.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
    hubs = F.broadcast(least.where(F.col("n") > hub).select(F.col("k").alias("hub"), F.col("m").alias("hub_m")))
    told = both.join(hubs, F.col("u") == F.col("hub"), "left")
    hot = told.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m"))
    cold = told.where("hub IS NULL").select("u", "v").join(least.where(F.col("n") <= hub).select("k", "m"), F.col("u") == F.col("k")).select("u", "v", "m")
    joined = hot.union(cold)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(src, dst)``.

    Alternating large-star and small-star steps; each round's edges are written
    to the shared folder. Nodes without edges do not appear. Null ends and loops
    are ignored.
    """
    spark = edges.sparkSession
    now = materialise(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"
    )
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        hub = max(HUB_EDGES, seen[0] // HUBS)
        half = materialise(_star(now, True, hub), "edges")
        after = materialise(_star(half, False, hub), "edges")
        new = mark(after)
        drop_tables(spark, now, half)
        now = after
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
