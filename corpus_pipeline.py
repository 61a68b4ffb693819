"""From raw documents to packed sequences: five stages, each one operator over all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; other
columns of their input, whatever their names, are left out. An empty table gives
an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm import lines, mixing, near_copies, packing, toxicity
from verbatlas.llm.common import materialise, table
from verbatlas.llm.queries import LINES, byte_bpe, document_hosts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores as toxic; learned from these documents and ``labels``.

    A null text counts as empty and stays; every row is judged by its own whole
    text, so repeated rows fare alike and null ids make no difference. Without
    labels or without toxic ones every row stays.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that recur over a site: the host of a page that shows the document, else its source.

    Every row stays, null and empty texts as they are; ``n_chars`` follows the text
    where a line went. A null source is a site of its own; a repeated text counts
    once and its rows lose the same lines.
    """
    slim = lines.drop_boilerplate(docs.select(*COLUMNS), hosts=document_hosts(spark, sf_dir), **LINES)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return slim.select(*COLUMNS[:-1], n_chars.alias("n_chars"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies (five-word shingles, similarity 0.8): one with the smallest id.

    Null ids come last, repeated ids are told apart by their texts; of equal rows one
    stays. Null and empty texts are copies of each other; texts of fewer words than
    a shingle are compared by all their words.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that source, language and topic meet their target shares.

    A hash of the id decides, so rows of one id and cell fare alike; a null id has
    the hash of an empty one. Texts without words are drawn at the budget's share.
    """
    return mixing.mix(docs.select(*COLUMNS)).where("_kept").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens.

    A null text is the end id alone; every row is packed, repeated ones and null ids too.
    """
    return packing.pack(docs, byte_bpe(), size=2048, end_id=0)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier and the fingerprints are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
