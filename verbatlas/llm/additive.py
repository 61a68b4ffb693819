"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of ``books`` codewords, one of each
full-dimensional codebook. Codebooks are trained one after another on the
residuals of a bounded sample; every vector is encoded by a beam search that keeps
the ``beam`` best partial sums. The index holds, for every row, the codes, the norm
of the approximation, the angle between it and the vector, and the vector itself.

A query is answered from lookup tables: its inner products with all codewords,
added up over the codes of a row and divided by the stored norm, are the cosine of
the approximation. With the stored angle that bounds the cosine of the row itself
(two angles that meet differ by no more than their sum), so all rows that can be
among the k nearest, and hardly any others, are reranked by the exact cosine in
double precision. Which rows are found does not depend on how they lie in batches.

Queries are broadcast in blocks of ``block_bytes``, so what is sent is bounded
whatever their number; each block scans the index once, and each partition of the
index returns only its best rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.llm.common import drop_tables, materialise, new_path, unit_hash
from verbatlas.llm.lattice import _matrix, _unit, scaled, usable


@dataclass(frozen=True)
class Quantiser:
    """``sample``: rows that codebooks are trained on at most, of each length of vectors; ``first``: best estimates that are reranked to begin with."""

    books: int = 16
    words: int = 256
    beam: int = 4
    sample: int = 8192
    rounds: int = 6
    first: int = 32
    block_bytes: int = 32 << 20
    seed: int = 2


def train(sample: np.ndarray, how: Quantiser) -> np.ndarray:
    """Codebooks (books, words, dimensions) by k-means on the residuals, from unit vectors."""
    rng = np.random.default_rng(how.seed)
    rest = sample.astype(np.float32)
    words = min(how.words, len(rest))
    books = np.zeros((how.books, words, rest.shape[1]), np.float32)
    for m in range(how.books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(how.rounds):
            near = (rest @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
            count = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            sums = np.add.reduceat(rest[order], np.minimum(np.r_[0, np.cumsum(count)[:-1]], len(rest) - 1), axis=0)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.choice(len(rest), words)])
        near = (rest @ centre.T - 0.5 * (centre * centre).sum(axis=1)).argmax(axis=1)
        books[m] = centre
        rest = rest - centre[near]
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms): for every row of x the best sum of codewords that the beam search finds, and its length."""
    n, d = x.shape
    x = x.astype(np.float32)
    words = books.shape[1]
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        b = rest.shape[1]
        square = (rest * rest).sum(axis=2)
        cost = square[:, :, None] - 2 * (rest.reshape(n * b, d) @ book.T).reshape(n, b, words) + (book * book).sum(axis=1)
        cost = cost.reshape(n, b * words)
        keep = min(beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        parent, word = best // words, best % words
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    last = (rest * rest).sum(axis=2).argmin(axis=1)
    k = np.arange(n)
    return codes[k, last], x - rest[k, last]


def index(vectors: DataFrame, how: Quantiser = Quantiser()) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, vector, codes, norm and angle of every row of ``vectors(vec_id, vector)``, usable vectors of one length."""
    total = vectors.count()
    share = min(1.0, how.sample / max(total, 1))
    rows = vectors.where(unit_hash(F.xxhash64("vector"), str(how.seed)) < share).orderBy("vec_id").toArrow()
    if not len(rows):
        rows = vectors.limit(1).toArrow()
    books = train(_unit(_matrix(rows.column("vector"))), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                unit = _unit(_matrix(part.column(1)))
                codes, near = encode(unit, books, how.beam)
                norms = np.sqrt((near.astype(np.float64) ** 2).sum(axis=1))
                cosine = (near * unit).sum(axis=1) / np.maximum(norms, 1e-30)
                angles = np.arccos(np.clip(cosine, -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float32)), pa.array(angles.astype(np.float32))],
                    ["vec_id", "vector", "codes", "norm", "angle"],
                )

    return materialise(vectors.mapInArrow(run, "vec_id long, vector array<double>, codes binary, norm float, angle float"), "vector-index"), books


class Top:
    """The k best (score, id) of each query so far: highest score, then smallest id, no id twice."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates ``ids`` at ``score`` for the queries ``q``."""
        touched = np.unique(q)
        have = np.isfinite(self.score[touched])
        q = np.concatenate([q, np.repeat(touched, have.sum(axis=1))])
        ids = np.concatenate([ids, self.id[touched][have]])
        score = np.concatenate([score, self.score[touched][have]])
        order = np.lexsort((-score, ids, q))  # of an id that is there several times the best
        q, ids, score = q[order], ids[order], score[order]
        best = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]
        q, ids, score = q[best], ids[best], score[best]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = rank < self.k
        self.score[touched], self.id[touched] = -np.inf, np.iinfo(np.int64).max
        self.score[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = score[keep], ids[keep]


def _first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those with k equal rows of other, smaller ids, or one of their own id: these change nothing."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    start = np.r_[True, g[1:] != g[:-1]]
    new = start | np.r_[True, i[1:] != i[:-1]]
    nth = np.cumsum(new)
    rank = nth - np.maximum.accumulate(np.where(start, nth, 0))
    return np.sort(order[new & (rank < k)])


def _scan(block: tuple[np.ndarray, np.ndarray], books: np.ndarray, k: int, how: Quantiser, per: int = 256, step: int = 1 << 15):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = block[0], scaled(block[1])
        qn = np.sqrt((q * q).sum(axis=1))
        top = Top(len(qid), k)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
            keep = _first_copies(x, ids, k + 1)  # one of them may be the query itself
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)[keep]
            norms, angle = (b.column(c).to_numpy()[keep] for c in (3, 4))
            ids, x = ids[keep], scaled(x[keep])
            size = np.sqrt((x * x).sum(axis=1))
            near_cos, near_sin = np.cos(angle), np.sin(angle)

            def exact(rows: np.ndarray, of: np.ndarray, ids=ids, x=x, size=size) -> None:
                for at in range(0, len(rows), step):
                    r, c = rows[at : at + step], of[at : at + step]
                    other = ids[r] != qid[c]
                    r, c = r[other], c[other]
                    if len(r):
                        top.add(c, ids[r], (x[r] * q[c]).sum(axis=1) / (size[r] * qn[c]))

            for at in range(0, len(qid), per):
                part = np.arange(at, min(at + per, len(qid)))
                unit = (q[part] / qn[part, None]).astype(np.float32)
                estimate = np.zeros((len(ids), len(part)), np.float32)
                for book, code in zip(books, codes.T, strict=True):
                    estimate += (book @ unit.T)[code]
                estimate /= np.maximum(norms, 1e-12)[:, None]
                some = min(how.first, len(ids))
                best = np.argpartition(-estimate, some - 1, axis=0)[:some]
                exact(best.T.ravel(), np.repeat(part, some))
                worst = np.clip(top.score[part, k - 1], -1, 1).astype(np.float32)  # -inf, with fewer than k found: any row may be among them
                bound = near_cos[:, None] * worst - near_sin[:, None] * np.sqrt(1 - worst * worst)
                able = (estimate >= bound - 1e-5) | (worst <= -1)
                able[best, np.arange(len(part))] = False
                rows, of = np.nonzero(able)
                order = np.argsort(of, kind="stable")
                exact(rows[order], part[of[order]])
        there = np.isfinite(top.score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, there.sum(axis=1))), pa.array(top.id[there]), pa.array(top.score[there])], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, books: np.ndarray, queries: DataFrame, k: int = 5, how: Quantiser = Quantiser()) -> DataFrame:
    """query_id, vec_id, score: rows of an index of which the k nearest to every query, but not itself, are all; ``nearest`` ranks them.

    ``queries(vec_id, vector)`` are usable vectors of the index's length.
    """
    spark = rows.sparkSession
    path = new_path(spark, "nearest")
    queries = materialise(queries.select("vec_id", "vector"), "queries")
    per = max(1, how.block_bytes // (8 * books.shape[2]))
    blocks = max(1, -(-queries.count() // per))
    ddl = "query_id long, vec_id long, score double"
    spark.createDataFrame([], ddl).write.parquet(path)
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if len(got):
            block = (got.column("vec_id").to_numpy(), _matrix(got.column("vector")))
            rows.mapInArrow(_scan(block, books, k, how), ddl).write.mode("append").parquet(path)
    drop_tables(spark, queries)
    return spark.read.schema(ddl).parquet(path)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, how: Quantiser = Quantiser()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other rows for the rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``every``.

    Ties go to the smaller vec_id; with fewer candidates than k there are fewer rows.
    Vectors that are null, zero or hold null or non-finite components are neither
    queries nor candidates, nor are rows with a null vec_id. Vectors are near to those
    of their own length only; each length has its own index. Rows of one vec_id are
    one candidate and one query, at the best cosine of any of their vectors, and never
    candidates of each other. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    found = None
    for length in sorted(r["d"] for r in ids.select(F.size("vector").alias("d")).distinct().collect()):
        rows, books = index(ids.where(F.size("vector") == length), how)
        more = search(rows, books, rows.where(F.col("vec_id") % every == 0), k, how)
        drop_tables(spark, rows)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
