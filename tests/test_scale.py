"""Work that grows with the texts is done once, in tasks of bounded size, with the results of the plain way."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import corpus as C
from verbatlas.operators import lm, validate
from verbatlas.plans import catalogue
from verbatlas.sources import sinks

SCHEMA = "doc_id long, sent_id int, tokens array<string>"


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    words = [*"abcdefgh", "<s>", "</s>"]  # marks as ordinary tokens too
    return [(d, s, rng.choices(words, k=rng.randint(0, 6))) for d in (9, -4, 3, 0, 12) for s in range(8)]


@pytest.fixture(scope="module")
def corpus(spark, lines):
    return spark.createDataFrame(lines, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_large_tables_are_dealt_into_pieces_of_bounded_size(spark, tmp_path, monkeypatch):
    spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(C, "TASK_BYTES", size // 20)
    monkeypatch.setattr(C, "SPLIT_BYTES", size // 20, raising=False)
    pieces = C.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.glom().map(len).collect()
    assert sum(pieces) == 50_000 and len(pieces) >= 20 and max(pieces) < 2 * 50_000 / 20
    assert C.spread(spark.createDataFrame([(1,)], "a int")).count() == 1


def test_asked_bigrams_need_no_count_of_the_others(spark, corpus):
    pairs = spark.createDataFrame([("a", "b"), ("b", "zz"), ("<s>", "c"), ("d", "</s>"), ("yy", "a"), ("a", "b")], "w1 string, w2 string")
    whole, some = lm.fit_bigram(corpus), lm.fit_bigram(corpus, asked=pairs)
    assert rows(some.unigrams) == rows(whole.unigrams) and rows(some.scalars) == rows(whole.scalars)
    assert rows(lm.bigram_probability(some, pairs)) == rows(lm.bigram_probability(whole, pairs))
    assert some.bigrams.count() < whole.bigrams.count() / 2


def test_many_asked_bigrams_are_not_broadcast(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "ASKED", 1)
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "w1 string, w2 string")
    assert rows(lm.fit_bigram(corpus, asked=pairs).bigrams) == rows(lm.fit_bigram(corpus).bigrams)


def test_starts_add_up_like_the_bigrams(spark, corpus):
    model, starts = lm.fit_bigram(corpus), lm.fit_starts(corpus)
    assert rows(starts.unigrams) == rows(model.unigrams) and rows(starts.scalars) == rows(model.scalars)
    assert rows(starts.words) == rows(model.bigrams.groupBy("w1").agg(F.sum("cnt"), F.count("*")))
    assert rows(lm.bigram_counts(corpus)) == rows(model.bigrams)
    assert lm.fit_starts(corpus.where("false")).scalars.first().vocab_size == 0


@pytest.mark.parametrize("n", [1, 4, 10, 1000])
def test_most_common_bigrams_break_ties_by_place(spark, lines, corpus, n):
    seen, first = Counter(), {}
    for d, s, tokens in sorted(lines):
        marked = ["<s>", *tokens, "</s>"] if tokens else []
        for p, pair in enumerate(zip(marked, marked[1:], strict=False)):
            seen[pair] += 1
            first.setdefault(pair, (d, s, p))
    want = sorted(seen, key=lambda pair: (-seen[pair], first[pair]))[:n]
    whole = lm.fit_bigram(corpus)
    got = lm.most_common_bigrams(corpus, lambda some: some, n)
    assert {(r.w1, r.w2): r.cnt for r in got.collect()} == {pair: seen[pair] for pair in want}
    assert rows(got.select("w1", "w2", "p")) == rows(lm.bigram_probability(whole, got.select("w1", "w2")))


def counted(spark, rows):
    """The rows, and how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def look(tokens):
        seen.add(1)
        return tokens

    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("tokens", look("tokens")), seen


def test_a_corpus_is_made_once_to_be_written_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_LINES", 7, raising=False)
    made = [(d, s, [f"{d}", f"{s}"]) for d in range(20) for s in range(5)]
    df, seen = counted(spark, made)
    sinks.write_corpus(df, str(tmp_path / "c"))
    assert seen.value == len(made)
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "c").glob("part*"))]
    assert [line for f in files for line in f] == [" ".join(t) for _, _, t in made]
    assert max(map(len, files)) <= 7


def test_a_corpus_is_checked_in_one_pass(spark, tmp_path):
    spark.createDataFrame([(1, "One two three. Four five six.", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.corpus_is_clean(spark, str(tmp_path))
    assert tuple(got.first()) == (2, 0, 0)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    lines = spark.createDataFrame([(v,) for v in ["a  b", " a\t", "", "a b"]], "value string").withColumn("line_no", F.lit(1))
    found = lines.where("value <> ''").agg(F.sum(F.size(validate.line_problems(F.col("value"))))).first()[0]
    assert found == validate.corpus_format(lines).count() == 4  # two spaces; one space ahead, which leaves an empty piece, and a tab


def test_counts_of_a_million_keep_all_their_digits(spark):
    one = spark.createDataFrame([(1, ".", 1_993_243), (2, "a token of over 14", 7)], "rank long, token string, freq long")
    got = one.orderBy("rank").select(sinks.fixed_width(("rank", "%5d"), ("token", 14), ("freq", "%,8d"))).collect()
    assert [r.line for r in got] == [f"{1:>5} {'.':<14} {1_993_243:>8,}", f"{2:>5} {'a token of over 14':<14} {7:>8,}"]
