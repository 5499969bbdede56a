"""Folders and tables that a session writes and reads again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.
    Only a local session may lack that setting; it gets a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="planlens-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: lineage and plan end there. It lives until ``drop`` or ``sweep``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._planlens_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.pop(path, None)


def drop(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and nothing needs any more."""
    delete(df.sparkSession, df._planlens_path)


def sweep() -> None:
    """Delete all that is left; results that were not written need it."""
    for path, spark in list(_KEPT.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            delete(spark, path)


atexit.register(sweep)
