"""Counts over streams of sentences: fitting on more text only adds to the counts of before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import corpus as C


def corpus_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Token arrays of corpus text files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.filter(F.split("value", r"(?U)\s+", -1), lambda t: t != "").alias("tokens")).where(F.size("tokens") > 0)


def bigram_counts(stream: DataFrame) -> DataFrame:
    """(w1, w2, cnt), for output mode complete or update."""
    keyed = C.marked(stream).select(F.lit(0).alias("doc_id"), F.lit(0).alias("sent_id"), "tokens")
    return C.bigrams(keyed).groupBy("w1", "w2").agg(F.count("*").alias("cnt"))


def unigram_counts(stream: DataFrame) -> DataFrame:
    """(token, cnt), for output mode complete or update."""
    return stream.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))
