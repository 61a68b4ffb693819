"""Packing documents into sequences with a grouping genetic algorithm on islands.

Every document becomes its token ids and an end id. Longer ones are cut into
pieces of the sequence length, the first being the shorter one; a full piece is a
sequence of its own. All other pieces are dealt by hash to shards of about
``shard_items`` pieces. Each shard is solved by several islands, every one of
which evolves a population of its own, from parents that best fit makes of the
pieces in orders that differ in how far they are from falling length. Between
epochs an island's elite moves to the next island of the ring. A chromosome is a
set of bins, not a list of numbers:

- crossover injects whole, well-filled bins of one parent into the other,
- bins of the other parent that share a document with them are dissolved
  (so no document is there twice),
- the displaced documents are put back by best fit, longest first.

Fitness is the number of bins, then the sum of squared fillings. An island stops
at the lower bound ceil(tokens / capacity), a shard when one of its islands does.
Islands, epochs and shards are rows of a DataFrame: a lost executor repeats its
rows, with the same seeds. A shard of which best fit by falling length alone would
make fewer bins takes those.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import bounded_batches, materialise

#: Characters whose classes are the same in every Unicode table and regex library.
_PLAIN = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f\\u2010-\\u2027\\u20ac]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts, those that ``tokenizers`` gives for the file at ``path``.

    Plain texts go through tiktoken with the ranks of the same file, several times
    faster; texts with rare characters or special tokens go through tokenizers.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
        if byte_level and in_order and not spec.get("normalizer"):
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            hidden = [b for b in range(256) if b not in shown]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
            ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than ``size``."""
    if length <= size:
        return [(0, length)]
    first = length % size
    starts = [0] * bool(first) + list(range(first, length, size))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of every piece of every row."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    part = ids[s : s + n]
                    for column, value in zip(out, (doc, k, s, n, zlib.crc32(part), part.astype(np.int32)), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, ddl)


# -- the grouping genetic algorithm on one shard ---------------------------------


class Bins:
    """Bins of known rest: the tightest one that takes a length is found from a bit mask of the rests."""

    def __init__(self, capacity: int):
        self.by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.capacity, self.n = 0, capacity, 0

    def add(self, name: int, rest: int) -> None:
        self.by_rest[rest].append(name)
        self.mask |= 1 << rest

    def new(self) -> int:
        self.n += 1
        return self.n - 1

    def put(self, length: int) -> int:
        """Best fit: the bin with the least rest that is enough, else a new one."""
        high = self.mask >> length
        if high:
            rest = length + (high & -high).bit_length() - 1
            stack = self.by_rest[rest]
            name = stack.pop()
            if not stack:
                self.mask ^= 1 << rest
        else:
            name, rest = self.new(), self.capacity
        self.add(name, rest - length)
        return name


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.empty(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        out[i] = bins.put(n)
    return out


def fitness(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Smaller is better."""
    fill = np.bincount(bins, lengths)
    return len(fill), -float((fill * fill).sum())


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``mother`` with a share of the father's fullest bins."""
    fill = np.bincount(father, lengths)
    well = np.argsort(-fill, kind="stable")[: max(1, int(len(fill) * rng.uniform(0.2, 0.6)))]
    chosen = np.zeros(len(fill), bool)
    chosen[well[rng.random(len(well)) < 0.7]] = True
    injected = chosen[father]
    n_mother = int(mother.max()) + 1
    broken = np.zeros(n_mother, bool)
    broken[mother[injected]] = True
    rest = np.bincount(mother, lengths, n_mother)
    broken |= rest < np.quantile(rest, 0.05)  # the emptiest bins are dissolved as well
    loose = ~injected & broken[mother]
    child = np.where(injected, father + n_mother, mother)
    child[loose] = -1
    names, code = np.unique(child[~loose], return_inverse=True)
    child[~loose] = code
    if loose.any():
        bins = Bins(capacity)
        bins.n = len(names)
        for name, filled in enumerate(np.bincount(code, lengths[~loose], len(names)).astype(int).tolist()):
            bins.add(name, capacity - filled)
        at = np.flatnonzero(loose)
        for i in at[np.argsort(-lengths[at], kind="stable")].tolist():
            child[i] = bins.put(int(lengths[i]))
    return child


def parents(lengths: np.ndarray, capacity: int, count: int, pull: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit of the pieces in random orders, longer ones earlier the more so the higher ``pull`` (0: any order)."""
    orders = (np.argsort(-(lengths**pull) * rng.uniform(0, 1, len(lengths)), kind="stable") for _ in range(count))
    return [best_fit(lengths, order, capacity) for order in orders]


def evolve(
    lengths: np.ndarray, elites: list[np.ndarray], capacity: int, seed: list[int], population: int = 4, generations: int = 6, pull: float = 1.0
) -> tuple[np.ndarray, int, int]:
    """(grouping, bins of the best parent, generations): the best that an island finds, a bin number from 0 on for every length."""
    if not len(lengths):
        return np.empty(0, np.int64), 0, 0
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    people = [*elites, *parents(lengths, capacity, max(2, population - len(elites)), pull, rng)]
    rank = lambda b: fitness(lengths, b)
    people.sort(key=rank)
    begun, done = rank(people[0])[0], 0
    while done < generations and rank(people[0])[0] > least:
        children = []
        for _ in range(population):
            mother, father = rng.choice(len(people), 2, replace=False)
            children.append(crossover(lengths, people[mother], people[father], capacity, rng))
        people = sorted([*people, *children], key=rank)[:population]
        done += 1
    return np.unique(people[0], return_inverse=True)[1], begun, done


def offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place of each piece in its bin, in the order of the pieces, without gaps."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.searchsorted(bins[order], bins[order], side="left")
    out = np.empty(len(lengths), np.int64)
    out[order] = starts - starts[first] if len(first) else starts
    return out


def _pull(island: int, islands: int) -> float:
    """How much length counts in the orders of an island's parents: nothing on the first, more on each that follows."""
    return island / islands


def _islands(capacity: int, epoch: int, seed: int, islands: int, population: int, generations: int):
    schema = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("best", pa.list_(pa.int32())), ("cost", pa.int32()), ("least", pa.int32()), ("begun", pa.int32()), ("generations", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for shard, island, lengths, elites in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                own, sizes = [np.array(e, np.int64) for e in elites], np.array(lengths, np.int64)
                best, begun, done = evolve(sizes, own, capacity, [seed, epoch, shard, island], population, generations, _pull(island, islands))
                rows.append((shard, island, lengths, best.tolist(), int(best.max()) + 1, -(-int(sizes.sum()) // capacity), begun, done))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def group(
    items: DataFrame, capacity: int = 2048, shard_items: int = 8192, islands: int = 3, epochs: int = 4, population: int = 4, generations: int = 4, seed: int = 11
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``items(doc_id, piece, length, ...)``; lengths from 1 to capacity.

    And what the evolution of its shard did: ``generations`` of all its islands,
    and ``gained``, the bins of the best first parent of the winning island less those of the result.
    """
    n = items.count()
    shards = max(1, -(-n // shard_items))
    columns = [c for c in items.columns if c not in ("length", "doc_id", "piece")]
    struct = F.struct("length", "doc_id", "piece", *columns)
    dealt = materialise(
        items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", *columns), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(struct)).alias("items")),
        "pack-shards",
    )
    state = dealt.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.length").cast("array<int>").alias("lengths"),
        F.array().cast("array<array<int>>").alias("elites"),
    ).repartition(min(4096, shards * islands), "shard", "island")
    ddl = "shard int, island int, lengths array<int>, best array<int>, cost int, least int, begun int, generations int"
    history, solved = [], []
    for epoch in range(epochs):
        found = materialise(state.mapInArrow(_islands(capacity, epoch, seed, islands, population, generations), ddl), "pack-epoch")
        history.append(found.select("shard", "island", "begun", "generations", F.lit(epoch).alias("epoch")))
        over = found.groupBy("shard").agg(F.min("cost").alias("cost"), F.first("least").alias("least")).where("cost > least").select("shard")
        solved.append(found.join(over, "shard", "left_anti") if epoch < epochs - 1 else found)
        if epoch == epochs - 1 or over.isEmpty():
            break
        left = found.join(over, "shard", "left_semi")
        own = left.select("shard", "island", "lengths", F.col("best").alias("own"))
        moved = left.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("best").alias("guest"))
        state = own.join(moved, ["shard", "island"]).select("shard", "island", "lengths", F.array("own", "guest").alias("elites"))
        state = state.repartition(min(4096, shards * islands), "shard", "island")
    every = solved[0]
    for more in solved[1:]:
        every = every.unionByName(more)
    best = every.groupBy("shard").agg(F.min_by(F.struct("lengths", "best", "island"), F.struct("cost", "island")).alias("best")).select("shard", "best.*")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, at = [], []
            for lengths, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sizes, x = np.array(lengths, np.int64), np.array(x, np.int64)
                plain = best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)
                x = plain if plain.max() < x.max() else x
                bins.append(x.tolist())
                at.append(offsets(sizes, x).tolist())
            cost = [max(x) + 1 for x in bins]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bins, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int64())), pa.array(cost, pa.int32()), b.column(3)], ["shard", "best", "at", "cost", "island"])

    done = history[0]
    for more in history[1:]:
        done = done.unionByName(more)
    first = done.where("epoch = 0").select("shard", "island", "begun")
    total = done.groupBy("shard").agg(F.sum("generations").cast("int").alias("generations"))
    placed = best.mapInArrow(place, "shard int, best array<int>, at array<long>, cost int, island int").join(first, ["shard", "island"]).join(total, "shard")
    return (
        dealt.join(placed, "shard")
        .select("shard", "generations", (F.col("begun") - F.col("cost")).alias("gained"), F.inline(F.arrays_zip("items", "best", "at")))
        .select("items.*", (F.col("best").cast("long") * F.lit(shards) + F.col("shard")).alias("sequence_id"), F.col("at").alias("offset"), "generations", "gained")
    )


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, **how: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, generations and gained of every piece of every row of ``docs``.

    The last two tell of the evolution of the piece's shard (see ``group``), and
    are 0 for full pieces, which need none. A null text counts as empty and is the end id alone; a repeated row is packed
    as often as it is there; other columns are ignored; an empty table gives no
    piece. Full pieces have negative sequence ids, shared ones those from 0 on.
    """
    cut_up = materialise(pieces(docs, tokenizer, size, end_id), "pack-pieces")
    parts = cut_up.withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart
    none = [F.lit(0).alias("generations"), F.lit(0).alias("gained")]
    full = parts.where(F.col("length") == size).select(*cut_up.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *none)
    some = materialise(parts.where(F.col("length") < size), "pack-items")
    return group(some, size, **how).select(*full.columns).unionByName(full)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """The real output: sequence_id and its ``ids``, the pieces in their places. Needs distinct doc_ids."""
    ids = pieces(docs, tokenizer, size, end_id, with_ids=True).select("doc_id", "piece", "ids")
    return (
        packed.select("doc_id", "piece", "sequence_id", "offset")
        .join(ids, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
