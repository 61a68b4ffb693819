"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``.

    Where that is unset and all runs in one process (tests), a temporary folder
    that goes with the process; anywhere else executors could not see such a
    folder, so an unset name is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="verbatlas-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted with all below when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, computes the rows
    once and gives the optimiser the true size of the table.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(sc: SparkContext, folder: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.get(sc.applicationId, set()).discard(folder)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    sc = spark.sparkContext
    for df in frames:
        for file in df.inputFiles()[:1]:
            _delete(sc, file.rpartition("/")[0])


@atexit.register
def _clear() -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        for folder in list(_MADE.get(sc.applicationId, ())):
            _delete(sc, folder)
