"""Tables in shared storage that cut a plan in two: what is built once is read by many queries."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="octolith-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes ``df`` and reads it again.  Lost executors don't matter: every one can read the table."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes with ``drop_stored``."""
    _written.append(f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}")
    return _written[-1]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read any more, while a job goes on."""
    for table in tables:
        _delete(table.sparkSession, table._stored_at)


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that this process has stored; for when no result that reads them is needed any more."""
    n = len(_written)
    for path in list(_written):
        _delete(spark, path)
    return n
