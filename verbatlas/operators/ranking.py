"""Dense positions of a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatlas.sources.scratch import materialise


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds 1..n in the given total order.

    A range-partitioned sort numbers the rows within their partitions; only the
    row counts of the partitions are added up in one place. The sorted rows are
    written to the shared folder once, so the counts and the ranks rest on the
    same sort even if an executor is lost in between.
    """
    shift = 33
    rows = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", shift)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    ranked = rows.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row a partition of the sort
    return ranked.withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", shift) + 1).drop("_id", "_part", "_before")
