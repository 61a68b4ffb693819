"""Arrow batches between the JVM and Python: bounded by bytes, their memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from inspect import isgeneratorfunction

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch that goes to Python: a task holds a few of them, however long the texts are.
BATCH_BYTES = "2m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut at ``BATCH_BYTES`` unless the session already names a size of its own.

    By rows alone a batch holds 10,000 whole texts, which for long texts is more than
    a worker can hold. The setting stays with the session, as plans are run later.
    """
    conf = df.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, BATCH_BYTES)
    return df


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Returns memory that Arrow and numpy have freed to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow (a generator) or applyInArrow, which gives freed memory back when its rows are done.

    A worker serves tasks of later stages too; without it, it would hold the most
    that any task needed, next to what the JVM needs then.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    def grouped(rows: pa.Table) -> pa.Table:
        out = run(rows)
        give_back()
        return out

    return mapped if isgeneratorfunction(run) else grouped
