"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that training
never saw falls back to its character n-grams: the longest order of which any gram
is known scores it, else the next shorter one, down to single letters. A text's
score in a language is the count-weighted sum over its words, and its language the
best of them; ``score`` is the share of that language in the posterior of the mean
word.

The model is fitted on a bounded sample (about ``max_docs`` labelled documents of
the learning folds, chosen by a hash of doc_id), whole texts each. Their words are
counted by the executors; the driver gets the counts of the sample's words, not its
texts. Every word of the sample is known, and every gram of them: what is sent to
the executors is bounded by the sample. All rows and whole texts are predicted.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import bounded_batches, held_out, learnable, unit_hash

__all__ = ["Model", "fit", "fit_counts", "grams", "held_out", "letters", "predict", "train"]

UNKNOWN = "und"
_CACHE = 200_000


def _letter_class() -> str:
    """A character class of what ``\\w`` holds but letters: numbers of all kinds, and the underscore."""
    odd = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    runs = [[odd[0], odd[0]]]
    for c in odd[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


_WORD = re.compile(rf"[^\W\d_{_letter_class()}]+")


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode categories L); other numbers and marks part them."""
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word; from two letters on its ends are marked."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language, a row for each known word, and for each known n-gram by order."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    orders: dict[int, tuple[dict[str, int], np.ndarray]]

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        """Empty the cache of unseen words: rows behind those of the known ones."""
        self.rows = dict(self.words)
        self.logs = np.concatenate([self.word_logs, np.zeros((_CACHE, len(self.languages)))])

    def __getstate__(self) -> tuple:
        return self.languages, self.words, self.word_logs, self.orders

    def __setstate__(self, state: tuple) -> None:
        self.languages, self.words, self.word_logs, self.orders = state
        self.forget()

    def backoff(self, w: str) -> np.ndarray:
        """Mean log frequencies of the known grams of the longest order that has any; zeros if none has."""
        for n in sorted(self.orders, reverse=True):
            known, logs = self.orders[n]
            found = [k for k in map(known.get, grams(w, n)) if k is not None]
            if found:
                return logs[found].sum(axis=0) / len(found)
        return np.zeros(len(self.languages))

    def row(self, w: str) -> int:
        k = self.rows.get(w)
        if k is None:
            k = len(self.rows)
            self.logs[k] = self.backoff(w)
            self.rows[w] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letters(text))
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        total, every = np.zeros(len(self.languages)), list(counts)
        for at in range(0, len(every), _CACHE // 2):
            part = every[at : at + _CACHE // 2]
            if len(self.rows) + len(part) > len(self.logs):
                self.forget()
            found = [self.rows.get(w, -1) for w in part]
            found = [self.row(w) if k < 0 else k for k, w in zip(found, part, strict=True)]
            total += np.array([counts[w] for w in part], float) @ self.logs[found]
        mean = total / counts.total()
        k = int(np.argmax(mean))
        return self.languages[k], float(1 / np.exp(mean - mean[k]).sum())


def fit_counts(by: dict[str, Counter], orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """A model from counts of words by language. Frequencies are smoothed by one half of a count."""
    by = {lang: c for lang, c in sorted(by.items()) if c}
    languages = list(by)

    def logs(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
        every = sorted(set().union(*counts))
        whole = np.array([c.total() for c in counts], float) + 0.5 * len(every)
        table = np.array([[c[x] for c in counts] for x in every], float).reshape(len(every), len(counts))
        return {x: k for k, x in enumerate(every)}, np.log((table + 0.5) / whole)

    found = {}
    for n in orders:
        counts = [Counter() for _ in languages]
        for c, lang in zip(counts, languages, strict=True):
            for w, m in by[lang].items():
                for g in grams(w, n):
                    c[g] += m
        found[n] = logs(counts)
    return Model(languages, *logs(list(by.values())), found)


def fit(samples: Iterable[tuple[str, str | None]], orders: tuple[int, ...] = (5, 4, 3, 2, 1)) -> Model:
    """A model from (language, text)."""
    by: dict[str, Counter] = {}
    for lang, text in samples:
        by.setdefault(lang, Counter()).update(letters(text))
    return fit_counts(by, orders)


def train(docs: DataFrame, max_docs: int = 4000, seed: int = 5) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: rows of the learning folds with a language and a text; null ids are in no fold."""
    usable = docs.select("doc_id", "text", "lang").where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = usable.select("doc_id").count()
    sample = usable.where(unit_hash(F.col("doc_id"), str(seed)) < min(1.0, max_docs / max(total, 1))).select(F.col("lang").cast("string").alias("lang"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own.setdefault(lang, Counter()).update(letters(text.as_py()))
            rows = [(lang, w, n) for lang, c in own.items() for w, n in c.items()]
            lang, w, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    counted = bounded_batches(sample).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    by: dict[str, Counter] = {}
    for lang, w, n in zip(*(counted.column(k).to_pylist() for k in range(3)), strict=True):
        by.setdefault(lang, Counter())[w] = n
    return fit_counts(by)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, repeated ones too; ``und`` and 0 for null texts and those without a letter.

    Ties go to the language that is first by name; without any training text all
    is ``und``; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
