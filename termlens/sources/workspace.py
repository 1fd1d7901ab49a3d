"""Where jobs keep tables between stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Where the setting is missing, a session whose driver and executors are one
    process gets a temporary folder, removed when the process ends; any other
    session (a cluster, however small) is an error.
    """
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="termlens-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/termlens/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a stored table's files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getContentSummary(target).getLength()


def remove_stored(spark: SparkSession) -> None:
    """Delete every table that this process has stored, once the results that read them are written."""
    while _made:
        remove(spark, _made.pop())


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and read it back: short lineage, kept when
    executors are lost, and its size is known to the planner."""
    spark = df.sparkSession
    target = path or new_folder(spark, label)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
