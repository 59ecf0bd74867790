"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without that setting a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sievework-"))
    return "file://" + _own_folder[0]


def staged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder (a folder for each value of ``by``) and read again: it is computed once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/sievework/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _staged.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for ``release_staged``."""
    return len(_staged)


def release_staged(since: int = 0, keep: int = 0) -> None:
    """Deletes the tables staged since a mark, but for the last ``keep``; results that were not written before can't be read any more."""
    last = len(_staged) - keep
    gone = _staged[since:last]
    del _staged[since:last]
    for spark, path in gone:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return


atexit.register(release_staged)
