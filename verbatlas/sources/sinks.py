"""Writers: JSON Lines, corpus text, fixed-width tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.sources.scratch import drop_tables, materialise


def write_records(records: DataFrame, path: str) -> None:
    """JSON Lines in the key order of the columns, not escaped; raises if there is no record."""
    if records.isEmpty():
        raise ValueError("no record to write")
    records.write.mode("overwrite").json(path)


#: Lines of a part file at most.
FILE_LINES = 250_000


def write_corpus(corpus: DataFrame, path: str, one_file: bool = False) -> None:
    """A sentence a line, tokens joined by spaces, in document order over the part files.

    ``one_file`` gathers the lines in one task, for corpora that other tools read
    whole. A corpus without a sentence is one blank line. The lines are made once:
    they are written to the shared folder before the sort, which reads its input twice.
    """
    made = materialise(corpus.select("doc_id", "sent_id", F.array_join("tokens", " ").alias("value")), "lines")
    if made.isEmpty():
        corpus.sparkSession.createDataFrame([("",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        lines = made.orderBy("doc_id", "sent_id").select("value")
        (lines.coalesce(1) if one_file else lines).write.mode("overwrite").option("maxRecordsPerFile", 0 if one_file else FILE_LINES).text(path)
    drop_tables(corpus.sparkSession, made)


def fixed_width(*columns: tuple[str, int | str]) -> Column:
    """A line of a console table: (column, width) left-aligned, or (column, printf format)."""
    parts = [f"%-{w}s" if isinstance(w, int) else w for _, w in columns]
    return F.format_string(" ".join(parts), *(F.col(c) for c, _ in columns)).alias("line")
