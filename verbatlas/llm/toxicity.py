"""Toxicity by non-negative positive-unlabelled learning (nnPU), in numpy.

Confirmed toxic documents are the positives, other documents of the learning
folds, whatever their label, the unlabelled text. With the class prior p and the
logistic loss l, the risk is

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

for a linear g over binary features: the words of a text, and beginnings of 4, 5 and
6 letters that one, two or four of its words share (so inflected forms that were
never seen still count, and several of them more than one by chance). The
corrected negative part never goes below zero: when a step would take it there,
the step goes up its gradient instead, as the non-negative estimator has it. The
risk also chooses the features: an l1 penalty leaves weight only to those that
lower it by more than the penalty.

The classifier is fitted on a bounded sample (``max_positive`` and
``max_unlabelled`` documents, chosen by a hash of doc_id). The executors count the
sample's features, then tell for each of its documents which of the candidates it
has: the driver gets candidates and their places, no texts. The prior comes from
all labelled rows of the learning folds; every whole text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import bounded_batches, drop_tables, lean, learnable, materialise, unit_hash

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 50_000


#: So many different words of a text must share a beginning for each of its features.
LEVELS = (1, 2, 4)


def beginnings(word: str) -> tuple[str, ...]:
    """The beginnings of 4, 5 and 6 letters that are shorter than the word."""
    return tuple(word[:n] for n in (4, 5, 6) if len(word) > n)


def document_features(text: str | None) -> set[str]:
    """The words of a text, and ``beginning*n`` for each beginning that n different words share, n being a level."""
    words = set(_WORD.findall((text or "").lower()))
    shared = Counter(p for w in words for p in beginnings(w))
    return words | {f"{p}*{n}" for p, c in shared.items() for n in LEVELS if c >= n}


@dataclass
class Model:
    """Weights of features, and the bias. Without positives it scores every text with ``prior``."""

    weights: dict[str, float]
    bias: float
    prior: float
    known: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.begin = {f.partition("*")[0] for f in self.weights if "*" in f}

    def decision(self, text: str | None) -> float:
        """The bias and the weights of the features that ``document_features`` finds."""
        hit: list[str] = []
        shared: Counter = Counter()
        for w in set(_WORD.findall((text or "").lower())):
            f = self.known.get(w)
            if f is None:
                if len(self.known) >= _CACHE:
                    self.known.clear()
                f = self.known[w] = ((w,) if w in self.weights else (), tuple(p for p in beginnings(w) if p in self.begin))
            if f[0]:
                hit.append(w)
            for p in f[1]:
                shared[p] += 1
        hit += [x for p, c in shared.items() for n in LEVELS if c >= n and (x := f"{p}*{n}") in self.weights]
        return self.bias + sum(self.weights[x] for x in sorted(hit))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.decision(text), -500, 500))))


@dataclass(frozen=True)
class Rows:
    """Documents as sets of features: feature ``column[k]`` is in document ``row[k]``, of ``n``."""

    row: np.ndarray
    column: np.ndarray
    n: int

    @staticmethod
    def of(places: Sequence[Sequence[int]]) -> Rows:
        sizes = [len(p) for p in places]
        return Rows(np.repeat(np.arange(len(places)), sizes), np.fromiter((c for p in places for c in p), np.int64, sum(sizes)), len(places))

    def score(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n) + b

    def back(self, d: np.ndarray, features: int) -> np.ndarray:
        """Slopes of the weights from those of the documents' scores."""
        return np.bincount(self.column, d[self.row], features)


def _slope(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def risk(pos: Rows, rest: Rows, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, float]:
    """(risk, negative part, step direction of the weights, of the bias).

    The direction is the gradient of the risk, but where the negative part is below
    zero: there it is the gradient of minus that part, so that a step raises it.
    """
    gp, gu = pos.score(w, b), rest.score(w, b)
    negative = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
    value = float(prior * np.logaddexp(0, -gp).mean()) + max(0.0, negative)
    up_p, up_u = _slope(gp), _slope(gu)  # slopes of l(-g); those of l(g) are these less 1
    if negative >= 0:
        dp, du = prior * ((up_p - 1) - up_p) / pos.n, up_u / rest.n
    else:
        dp, du = prior * up_p / pos.n, -up_u / rest.n
    return value, negative, pos.back(dp, len(w)) + rest.back(du, len(w)), float(dp.sum() + du.sum())


def minimise(pos: Rows, rest: Rows, features: int, prior: float, steps: int = 300, rate: float = 0.1, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the risk, each step followed by the l1 penalty's own."""
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, steps + 1):
        _, _, dw, db = risk(pos, rest, w, b, prior)
        g = np.append(dw, db)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        moved = np.append(w, b) - pace * m / (1 - 0.9**t)
        w, b = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - pace[:-1] * l1, 0.0), float(moved[-1])
    return w, b


def stands_apart(p: float, u: float, n_p: int, n_u: int, apart: float):
    """Whether a share ``p`` of the positives exceeds a share ``u`` of the unlabelled texts by ``apart`` standard errors; for numbers and columns."""
    both = (p * n_p + u * n_u) / (n_p + n_u)
    return (p - u > 0) & ((p - u) * (p - u) > apart * apart * both * (1 - both) * (1 / n_p + 1 / n_u))


def fit(positive: Sequence[str | None], unlabelled: Sequence[str | None], prior: float, least: int = 2, apart: float = 4.0, **how: float) -> Model:
    """A model from texts: candidates are the features of at least ``least`` positives that stand ``apart``; see ``train``."""
    prior = min(max(prior, 1e-4), 0.9999)
    n_p, n_u = len(positive), len(unlabelled)
    seen, there = (Counter(f for t in texts for f in document_features(t)) for texts in (positive, unlabelled))
    good = sorted(f for f, n in seen.items() if n >= least and n_u and stands_apart(n / n_p, there[f] / n_u, n_p, n_u, apart))
    index = {f: k for k, f in enumerate(good)}
    rows = [Rows.of([sorted(index[f] for f in document_features(t) if f in index) for t in texts]) for texts in (positive, unlabelled)]
    return _model(good, *rows, prior, **how)


def _model(names: list[str], pos: Rows, rest: Rows, prior: float, **how: float) -> Model:
    if not names:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    w, b = minimise(pos, rest, len(names), prior, **how)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, b, prior)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 8000, seed: int = 3, least: int = 2, apart: float = 4.0, **how: float) -> Model:
    """Fit on the learning folds of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    Null labels, null ids and labels without document say nothing; a document counts
    as toxic if any of its labels is 1; rows with one doc_id are learned from each.
    """
    marks = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    own = docs.select("doc_id", "text").where(learnable(F.col("doc_id")))
    total = own.select("doc_id").count()
    if not n or not toxic or not total:
        return Model({}, -10.0 if not toxic else 0.0, 0.0)
    prior = min(max(toxic / n, 1e-4), 0.9999)
    pick = lambda name, bound, of: (unit_hash(F.col("doc_id"), f"{seed}{name}") < min(1.0, bound / max(of, 1)))
    chosen = marks.where(F.col("toxic") == 1).where(pick("p", max_positive, toxic)).select("doc_id")  # about max_positive ids
    positive = own.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", F.lit(1).alias("p"))
    unlabelled = own.where(pick("u", max_unlabelled, total)).select("text", F.lit(0).alias("p"))
    sample = bounded_batches(materialise(positive.union(unlabelled), "toxicity-sample"))
    sizes = {r["p"]: r["n"] for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))), prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own_counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, p in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own_counts[p].update(document_features(text.as_py()))
            names = list(own_counts[0] | own_counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([own_counts[p][f] for f in names], pa.int64()) for p in (1, 0))], ["feature", "n_p", "n_u"])

    counted = sample.mapInArrow(lean(count), "feature string, n_p long, n_u long").groupBy("feature").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u"))
    good = counted.where((F.col("n_p") >= least) & stands_apart(F.col("n_p") / n_p, F.col("n_u") / n_u, n_p, n_u, apart)).select("feature")
    names = sorted(good.toArrow().column(0).to_pylist())
    index = {f: k for k, f in enumerate(names)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(index[f] for f in document_features(t.as_py()) if f in index) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], ["p", "places"])

    got = sample.mapInArrow(lean(place), "p int, places array<int>").toArrow()
    drop_tables(docs.sparkSession, sample)
    which, places = got.column("p").to_numpy(), got.column("places").to_pylist()
    rows = [Rows.of(sorted(x for x, q in zip(places, which, strict=True) if q == p)) for p in (1, 0)]  # in an order that no partition decides
    return _model(names, *rows, prior, **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 from 0.5 on) of every row, repeated ones and null ids too; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.fromiter((model.score(t.as_py()) for t in b.column(1)), np.float64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows whose text scores 0.5 or more. One pass, no shuffle."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.fromiter((model.decision(t.as_py()) < 0 for t in b.column(at)), bool, b.num_rows)
            yield b.filter(pa.array(keep))

    return bounded_batches(docs).mapInArrow(lean(run), docs.schema)
