"""Arrow batches of long texts stay small, and a size that the user names stays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from verbatlas.llm.common import BATCH_BYTES, bounded_batches, lean

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    own = spark.newSession()
    long = own.range(0, 60, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))  # 1 MB each
    got = bounded_batches(long).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 60
    assert max(r["size"] for r in got) < 10 << 20
    assert len(got) > 4


def test_own_setting_stays(spark):
    own = spark.newSession()
    bounded_batches(own.range(1))
    assert own.conf.get(KEY) == BATCH_BYTES
    own.conf.set(KEY, "2m")
    bounded_batches(own.range(1))
    assert own.conf.get(KEY) == "2m"


def test_batches_end_soon_after_their_bound(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    long = spark.newSession().range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 100_000).alias("text"))  # 0.5 MB each
    assert max(r["size"] for r in bounded_batches(long).mapInArrow(sizes, "size long").collect()) < 4 << 20


def test_workers_give_memory_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    pins = []

    def run(batches):
        for b in batches:
            blocks = [bytearray(1000) for _ in range(200_000)]
            pins.append(blocks[-1])  # the end of the heap stays in use, so free() alone gives nothing back
            yield b

    def grouped(rows):
        return next(run([rows]))

    one = pa.record_batch({"x": [1, 2]})
    before = held()
    assert list(lean(run)([one, one])) == [one, one]
    assert lean(grouped)(one) is one
    assert held() - before < 50 << 20
