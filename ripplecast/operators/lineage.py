"""Tables that end a plan's lineage: written to the shared folder and read back.

A reread table has its true size, so a loop's plans stay small and its joins are chosen by what is there;
a lost executor costs nothing that was written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where driver and tasks share the disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="ripplecast-"))
    return _own[0]


def stable(df: DataFrame) -> DataFrame:
    """df's rows as a table of their own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stable_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes stable tables that no later plan reads; other frames are let be."""
    for df in frames:
        path = getattr(df, "_stable_path", None)
        if path in _kept:
            _delete(path, _kept.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_kept.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return
