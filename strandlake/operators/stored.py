"""Intermediate results in the folder that driver and executors share.

What a lazy result still reads can't go before the result has been read, so such tables stay until
``release`` or the end of the application, which deletes them (so does the end of a killed driver's
JVM, if it gets to its shutdown hooks).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE = threading.local()
#: Folders of applications that this process has made.
_FOLDERS: set[str] = set()


def _made() -> list[str]:
    """Paths given out in this thread that haven't been deleted, oldest first."""
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a folder of this machine if Spark runs on it alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "strandlake-shared")).rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in a folder of the application that goes when it ends."""
    own = f"{shared_dir(spark)}/strandlake/{spark.sparkContext.applicationId}"
    if own not in _FOLDERS:
        files, place = _file_system(spark, own)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _FOLDERS.add(own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    _made().append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read again: short lineage that survives lost executors."""
    path, schema = fresh(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def mark() -> int:
    """How many tables this thread has now, for ``release``."""
    return len(_made())


def release(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes the tables of this thread made since that mark, but for the newest so many. Results that read them can't be read any more."""
    paths = _made()
    for path in paths[since : max(since, len(paths) - but)]:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)
    if path in _made():
        _made().remove(path)
