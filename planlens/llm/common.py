"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of word splitting, as a Java regex class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="planlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_KEPT: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation. The table lives until ``discard``
    or ``sweep``; what is left goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/planlens-{name}-{uuid.uuid4().hex}"
    _KEPT[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._planlens_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing needs any more."""
    _delete(df.sparkSession, df._planlens_path)


def sweep() -> None:
    """Delete all tables that ``materialize`` wrote; results that were not written need them."""
    for path, spark in list(_KEPT.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            _delete(spark, path)


atexit.register(sweep)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null ids count as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker."""
    import sys
    import types

    return sys.modules.setdefault("_planlens_worker_cache", types.SimpleNamespace(d={})).d


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
