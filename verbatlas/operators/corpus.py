"""Corpus building and its statistics: rows of (doc_id, lang, sent_id, tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.functions import text as T

#: Bytes of input that a task works on, and bytes from which on a table is taken to have no known size.
TASK_BYTES, UNKNOWN_BYTES = 16 << 20, 1 << 42


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt into pieces of about ``TASK_BYTES``, one for each core at least.

    A file of one row group is one task however many splits it is cut into, so the
    longest task would grow with the table.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def split_docs(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, sent_id, sentence): normalised texts cut into sentences."""
    return spread(docs).select(F.col(id).alias("doc_id"), *keep, T.normalize(F.col(text)).alias("text")).select(
        "doc_id", *keep, F.posexplode(T.sentences(F.col("text"))).alias("sent_id", "sentence")
    )


def tokenize(sents: DataFrame, **how) -> DataFrame:
    return sents.withColumn("tokens", T.tokens(F.col("sentence"), **how)).drop("sentence")


def build_corpus(docs: DataFrame, min_tokens: int = 3, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), **how) -> DataFrame:
    """Sentences of at least ``min_tokens`` tokens, punctuation included. One stage, no shuffle but that of ``spread``."""
    return tokenize(split_docs(docs, id, text, keep), **how).where(F.size("tokens") >= min_tokens)


def words(corpus: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, token)."""
    return corpus.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "token"))


def place(df: DataFrame) -> Column:
    """(doc_id, sent_id, pos) as one number of the same order, which hash aggregation takes the least of; a struct for other ids."""
    kinds = dict(df.dtypes)
    if kinds["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct("doc_id", "sent_id", "pos")
    within = F.shiftleft(F.col("sent_id").cast("long"), 32) + F.col("pos")
    return F.col("doc_id").cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + within.cast("decimal(19,0)")


def token_freq(corpus: DataFrame) -> DataFrame:
    """(token, freq, first): count and place of the first appearance of every token."""
    each = words(corpus)
    return each.groupBy("token").agg(F.count("*").alias("freq"), F.min(place(each)).alias("first"))


def stats(corpus: DataFrame, docs: DataFrame, by: str = "lang") -> DataFrame:
    """documents, sentences, total_tokens, vocabulary_size, type-token ratio and tokens a sentence, by group.

    Every group of ``docs`` has a row, null and groups without a sentence too: their
    counts are 0 and the ratios over them null. Counted from (group, token) in one
    pass over the corpus, a null token standing for a sentence.
    """
    n_docs = docs.groupBy(by).agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    each = corpus.select(F.col(by).alias("_by"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("token")).groupBy("_by", "token").agg(F.count("*").alias("n"))
    sizes = each.groupBy("_by").agg(
        F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("sentences"), F.sum(F.when(F.col("token").isNotNull(), F.col("n"))).alias("total_tokens"), F.count("token").alias("vocabulary_size")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    joined = n_docs.join(sizes, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, "documents", zero("sentences"), zero("total_tokens"), zero("vocabulary_size"), "n_chars").select(
        "*",
        ratio("vocabulary_size", "total_tokens").alias("ttr"),
        ratio("total_tokens", "sentences").alias("tokens_per_sentence"),
        ratio("n_chars", "documents").alias("chars_per_document"),
    )


def stopword_share(corpus: DataFrame, stop_words: list[str], by: str = "lang") -> DataFrame:
    """(by, tokens, stop_words, share) of every group with a token, the null group too."""
    is_stop = F.col("token").isin(list(dict.fromkeys(stop_words)))
    counts = corpus.select(by, F.explode("tokens").alias("token")).groupBy(by).agg(F.count("*").alias("tokens"), F.count_if(is_stop).alias("stop_words"))
    return counts.withColumn("share", F.col("stop_words") / F.col("tokens"))


def char_counts(corpus: DataFrame, chars: str) -> DataFrame:
    """(ch, occurrences) of single characters in the joined lines."""
    line = T.joined(F.col("tokens"))
    sums = corpus.agg(*(F.sum(F.length(line) - F.length(F.replace(line, F.lit(c)))).alias(f"c{k}") for k, c in enumerate(chars)))
    pairs = F.array(*(F.struct(F.lit(c).alias("ch"), F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("long").alias("occurrences")) for k, c in enumerate(chars)))
    return sums.select(F.inline(pairs))


def marked(corpus: DataFrame) -> DataFrame:
    """Sentences with their boundary marks."""
    return corpus.withColumn("tokens", F.concat(F.array(F.lit("<s>")), "tokens", F.array(F.lit("</s>"))))


def bigrams(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, w1, w2) of adjacent tokens, within the row: no window, no shuffle."""
    each = sents.select("doc_id", "sent_id", "tokens", F.posexplode("tokens").alias("pos", "w1")).where(F.col("pos") < F.size("tokens") - 1)
    return each.select("doc_id", "sent_id", "pos", "w1", F.get("tokens", F.col("pos") + 1).alias("w2"))
