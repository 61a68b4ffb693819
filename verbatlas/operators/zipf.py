"""Zipf's law: ranks, log-log regression, points to plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.ranking import global_rank


def ranks(freq: DataFrame) -> DataFrame:
    """Adds ``rank`` 1..V by falling frequency (ties by token)."""
    return global_rank(freq.select("token", "freq"), F.desc("freq"), F.asc("token"))


def points(ranked: DataFrame, trim_head: int = 5, trim_singletons: bool = True, least: int = 10) -> DataFrame:
    """The (rank, freq) rows to fit on: all of them if fewer than ``least`` remain after trimming."""
    keep = F.lit(True)
    if trim_head > 0:
        keep = keep & (F.col("rank") > trim_head)
    if trim_singletons:
        keep = keep & (F.col("freq") > 1)
    left = ranked.agg(F.count_if(keep).alias("_left"))
    return ranked.crossJoin(F.broadcast(left)).where((F.col("_left") < least) | keep).drop("_left")


def fit(kept: DataFrame) -> DataFrame:
    """One row: s (slope with its sign turned), r2 (0 if all frequencies are equal), intercept, n."""
    x, y = F.log10("rank"), F.log10("freq")
    flat = F.min("freq") == F.max("freq")
    return kept.agg(
        F.when(flat, 0.0).otherwise(-F.regr_slope(y, x)).alias("s"),
        F.when(flat, 0.0).otherwise(F.regr_r2(y, x)).alias("r2"),
        F.when(flat, F.log10(F.max("freq"))).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.count("*").alias("n"),
    )


def plot_points(ranked: DataFrame, fitted: DataFrame) -> DataFrame:
    """(rank, freq, fitted frequency): what a log-log plot shows."""
    line = F.pow(10.0, F.col("intercept") - F.col("s") * F.log10("rank"))
    return ranked.crossJoin(F.broadcast(fitted)).select("rank", "freq", line.alias("fit"))
