"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master, where driver and executors
    are one process, may go without: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a ``stored`` table that a later one replaces."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for each worker process and key.

    A worker keeps the thing of one key at a time: what an earlier operator left there goes.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """Let go of what this worker keeps, and give its memory back to the machine.

    For the end of tasks that keep much: the worker idles on beside stages of another kind, which need the memory.
    """
    _KEPT.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library, which gives memory back by itself


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which a user sets by the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
