"""Readers of JSON Lines and text files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("date_retrieved", T.StringType()), T.StructField("raw_text", T.StringType())]
)


def read_records(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """JSON Lines of a declared schema; blank lines are skipped, bad JSON fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files; ``\\n``, ``\\r\\n`` and ``\\r`` end a line.

    Lines are numbered by the order of the file's splits and of the lines in them;
    only the line counts of a file's splits are added up in one place.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value"
    )
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), ["file", "start"]).select("file", (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_no"), "value")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_first(spark: SparkSession, glob: str) -> DataFrame:
    """Lines of the file that is first by path among those of a glob."""
    rows = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), "value")
    first = rows.agg(F.min("file").alias("file"))
    return rows.join(F.broadcast(first), "file", "left_semi").select("value")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_id, tokens) of a processed corpus file: a sentence a line, split at white space, blank lines skipped."""
    lines = read_lines(spark, path)
    found = F.filter(F.split("value", r"(?U)\s+", -1), lambda t: t != "")
    return lines.select(F.lit(0).cast("long").alias("doc_id"), F.col("line_no").alias("sent_id"), found.alias("tokens")).where(F.size("tokens") > 0)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def project_root(start: str, marker: str = "tests") -> Path:
    """The nearest folder from ``start`` upwards that holds ``marker``; raises if none does."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / marker).exists():
            return folder
    raise FileNotFoundError(f"no folder above {start} holds {marker}")


def preview(lines: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows by the given columns."""
    return lines.orderBy(*order).limit(n)


def count_records(spark: SparkSession, path: str) -> int:
    """Non-blank lines: what a run that finds its output already there reports."""
    return spark.read.text(path).where(F.trim("value") != "").count()
