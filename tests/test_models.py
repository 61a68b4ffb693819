import math

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import corpus as C
from verbatlas.operators import lm, ranking, validate, zipf
from verbatlas.streaming import counts


def corpus(spark, *lines):
    return spark.createDataFrame([(i, 0, line.split()) for i, line in enumerate(lines)], "doc_id long, sent_id int, tokens array<string>")


def test_bigram_model_by_hand(spark, tmp_path):
    model = lm.fit_bigram(corpus(spark, "a b a", "a c"))
    assert {r.token: r.cnt for r in model.unigrams.collect()} == {"<s>": 2, "a": 3, "b": 1, "c": 1, "</s>": 2}
    assert {(r.w1, r.w2): r.cnt for r in model.bigrams.collect()} == {("<s>", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("a", "</s>"): 1, ("a", "c"): 1, ("c", "</s>"): 1}
    assert model.scalars.first().asDict() == {"vocab_size": 5, "total_tokens": 9, "sentence_count": 2, "total_bigrams": 7}
    pairs = spark.createDataFrame([("a", "b"), ("<s>", "a"), ("zzz", "x")], "w1 string, w2 string")
    assert {(r.w1, r.w2): r.p for r in lm.bigram_probability(model, pairs).collect()} == {("a", "b"): 2 / 8, ("<s>", "a"): 3 / 7, ("zzz", "x"): 1 / 5}
    got = lm.bigram_perplexity(model, corpus(spark, "a b")).first()
    assert got.perplexity == pytest.approx(56 ** (1 / 3)) and got.events == 3
    model.write(str(tmp_path / "m"))
    again = lm.Bigram.read(spark, str(tmp_path / "m"))
    assert lm.bigram_perplexity(again, corpus(spark, "a b")).first().perplexity == pytest.approx(got.perplexity)
    twice = lm.fit_bigram(corpus(spark, "a b a", "a c"), corpus(spark, "a b a", "a c"))
    assert twice.scalars.first().total_bigrams == 14
    placed = lm.fit_bigram(corpus(spark, "a b a", "a c"), places=True)
    top = lm.top_bigrams(placed, 3).collect()
    assert [(r.w1, r.w2, r.cnt) for r in sorted(top, key=lambda r: -r.cnt)][0] == ("<s>", "a", 2) and {(r.w1, r.w2) for r in top[:3]} == {("<s>", "a"), ("a", "b"), ("b", "a")}
    odd = lm.fit_bigram(corpus(spark, "a </s> b <s> </s>", "</s>"))  # marks as ordinary tokens
    assert {r.token: r.cnt for r in odd.unigrams.collect()} == {"<s>": 3, "a": 1, "</s>": 5, "b": 1}


def test_texts_are_read_once_for_a_model(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two {i} three. four five six.", "en") for i in range(50)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "texts"))
    model = lm.fit_bigram(C.build_corpus(spark.read.parquet(str(tmp_path / "texts"))))
    found = lm.bigram_perplexity(model, corpus(spark, "one two"))
    assert found.first().events == 3
    assert not any("/texts" in f for frame in (found, model.unigrams, model.bigrams, model.scalars) for f in frame.inputFiles())


def test_places_order_like_their_parts(spark):
    ids = [-(2**63), -5, -1, 0, 1, 7, 2**62, 2**63 - 1]
    rows = [(d, s, p) for d in ids for s in (0, 3, 2**31 - 1) for p in (0, 9, 2**31 - 1)]
    df = spark.createDataFrame(rows, "doc_id long, sent_id int, pos int")
    got = [tuple(r)[:3] for r in df.select("*", C.place(df).alias("k")).orderBy("k").collect()]
    assert got == sorted(rows)
    text = spark.createDataFrame([("b", 0, 0), ("a", 1, 0)], "doc_id string, sent_id int, pos int")
    assert text.select("doc_id", C.place(text).alias("k")).orderBy("k").first().doc_id == "a"


def test_no_group_is_lost(spark):
    rows = [(1, "One two three. Four five the.", "en"), (2, "The a an", "de"), (3, "x", None), (4, None, None), (5, "a b c. d e f.", None), (6, "tiny", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    built = C.build_corpus(docs, keep=("lang",))
    got = {r.lang: (r.documents, r.sentences, r.total_tokens, r.vocabulary_size, r.ttr) for r in C.stats(built, docs).collect()}
    assert got == {"en": (1, 2, 8, 7, 7 / 8), "de": (1, 1, 3, 3, 1.0), None: (3, 2, 8, 7, 7 / 8), "fr": (1, 0, 0, 0, None)}
    share = {r.lang: (r.tokens, r.stop_words) for r in C.stopword_share(built, ["the", "a", "an"]).collect()}
    assert share == {"en": (8, 1), "de": (3, 3), None: (8, 1)}


def test_unigram_model_by_hand(spark):
    cnt = lm.unigram_counts(corpus(spark, "a b a", "a c"))
    assert lm.unigram_perplexity(cnt, corpus(spark, "a b")).first().perplexity == pytest.approx(math.sqrt(8))
    assert {r.token: r.n for r in lm.oov(cnt, corpus(spark, "a q q r")).collect()} == {"q": 2, "r": 1}


def test_nothing_to_score_and_unfitted_models_raise(spark):
    model, none = lm.fit_bigram(corpus(spark, "a")), corpus(spark).where("false")
    with pytest.raises(Exception, match="no events"):
        lm.bigram_perplexity(model, none).collect()
    with pytest.raises(Exception, match="not been fitted"):
        lm.bigram_perplexity(lm.fit_bigram(none), corpus(spark, "a")).collect()


def test_zipf_edges(spark):
    exact = spark.createDataFrame([(f"w{r:02}", 1000.0 / r) for r in range(1, 51)], "token string, freq double")
    got = zipf.fit(zipf.points(zipf.ranks(exact))).first()
    assert got.s == pytest.approx(1) and got.r2 == pytest.approx(1) and got.n == 45
    flat = spark.createDataFrame([(f"w{r}", 7) for r in range(20)], "token string, freq long")
    assert tuple(zipf.fit(zipf.points(zipf.ranks(flat))).first())[:2] == (0.0, 0.0)
    few = spark.createDataFrame([(f"w{r}", 9 - r) for r in range(9)], "token string, freq long")
    assert zipf.points(zipf.ranks(few)).count() == 9


def test_global_rank_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = ranking.global_rank(df, F.asc("v")).collect()
    assert sorted((r["rank"], r.v) for r in got) == [(i + 1, i) for i in range(1000)]


def test_corpus_properties(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five!", "en"), (2, "Tiny. A b c d.", "en"), (3, None, "de")], "doc_id long, text string, lang string")
    got = C.build_corpus(docs, keep=("lang",))
    assert [(r.doc_id, r.sent_id, " ".join(r.tokens)) for r in sorted(got.collect())] == [(1, 0, "one two three ."), (1, 1, "four five !"), (2, 1, "a b c d .")]
    model = lm.fit_bigram(got)
    s, words = model.scalars.first(), C.words(got)
    assert s.total_bigrams == words.count() + 3 and s.vocab_size == words.select("token").distinct().count() + 2
    sums = lm.bigram_probability(model, model.bigrams.select("w1", "w2")).count()
    assert sums == model.bigrams.count()
    assert {r.ch: r.occurrences for r in C.char_counts(got, "e☃").collect()} == {"e": 4, "☃": 0}


def test_line_and_record_checks(spark):
    lines = ["a b c", "", "a  b", " a b", "a b ", "a\tb", " "]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string")
    got = {}
    for r in validate.corpus_format(df).collect():
        got.setdefault(r.line_no, []).append(r.problem)
    many = "multiple consecutive spaces"
    assert got == {3: [many], 4: [many, "leading space"], 5: [many, "trailing space"], 6: ["tab character"], 7: [many, "leading space", "trailing space"]}
    notes = {r.problem for r in validate.corpus_format(df, labels="notebook").collect()}
    assert notes == {"double space", "edge space", "tab or CR"}
    ok = '{"id": %s, "url": "u", "date_retrieved": "d", "raw_text": "t", "more": 1}'
    rows = [ok % 1, ok % "true", "", ok % '"1"', ok % "1.5", ok % "null", '{"id": 1}', "{oops", "[1]"]
    bad = {}
    for r in validate.record_schema(spark.createDataFrame(list(enumerate(rows)), "n int, value string"), "value", "n").collect():
        bad.setdefault(r.n, []).append(r.problem)
    wrong = ["wrong type: id"]
    assert bad == {3: wrong, 4: wrong, 5: wrong, 6: ["missing key: url", "missing key: date_retrieved", "missing key: raw_text"], 7: ["invalid JSON object"], 8: ["invalid JSON object"]}


def test_thresholds_files_and_authors(spark, tmp_path):
    one = spark.sql("SELECT 3000L AS n, 1.2D AS s, 0.95D AS r, 500D AS p")
    checks = lambda df: {r.check: r.passed for r in df.select(F.inline(validate.thresholds(F.col("n"), F.col("s"), F.col("r"), F.col("p"), F.lit(35)))).collect()}
    assert all(checks(one).values()) and len(checks(one)) == 5
    bad = checks(spark.sql("SELECT 2499L AS n, 2.1D AS s, 0.9D AS r, CAST(NULL AS DOUBLE) AS p"))
    assert {k for k, v in bad.items() if v} == {"stop_words"}
    paths = ["submissions/group_01_nupe/HW1_assignment.py", "submissions/group_5_x_y/sub/HW1_assignment.py", "submissions/team/HW1_assignment.ipynb", "docs/HW1_assignment.md", "submissions/group_2_a/other.py", "submissions/group_05_gbagyi/HW1_assignment.ipynb"]
    got = {r.path: r.language for r in validate.submitted(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: "nupe", paths[1]: None, paths[2]: None, paths[5]: "gbagyi"}
    log = spark.createDataFrame([("1 A <a@x>",), (" 1 A <a@x> ",), ("",), ("  ",), ("2 B <b@x>",)], "line string")
    assert tuple(validate.distinct_authors(log).first()) == (2, True)
    assert tuple(validate.distinct_authors(log.where("false")).first()) == (0, False)
    ok = '{"id": 1, "url": "u", "date_retrieved": "d", "raw_text": "t"}'
    for name, lines in (("x", [ok, "", "{oops"]), ("y", [ok, '{"id": 2}', ok, "[]"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "raw.jsonl").write_text("\n".join(lines) + "\n")
    found = {(r.file[-len("x/raw.jsonl") :], r.line_no, r.problem) for r in validate.check_files(spark, str(tmp_path / "*" / "*.jsonl")).collect()}
    invalid = "invalid JSON object"
    assert found == {("x/raw.jsonl", 3, invalid), ("y/raw.jsonl", 4, invalid)} | {("y/raw.jsonl", 2, f"missing key: {k}") for k in ("url", "date_retrieved", "raw_text")}


def test_quality_checks(spark):
    lines = {"english": "wa the nu", "site_text": "next chapter", "digit": "a 1", "missing_letter": "ɓ?a b\ufffd", "attached_punctuation": "a. b", "short": "ab"}
    df = spark.createDataFrame([(v,) for v in [*lines.values(), "wa nu .", "a * b"]], "value string")
    got = {r.check: r.lines for r in validate.qa_counts(df).collect()}
    assert got == {k: 2 if k == "attached_punctuation" else 1 for k in lines}


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, text in enumerate(("a b a\n\n", "a c\n")):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
    stream = counts.bigram_counts(counts.corpus_stream(spark, str(tmp_path / "in"), 1))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed_bigrams").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.w1, r.w2): r.cnt for r in spark.table("streamed_bigrams").collect()} == {(r.w1, r.w2): r.cnt for r in lm.fit_bigram(corpus(spark, "a b a", "a c")).bigrams.collect()}
