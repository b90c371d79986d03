"""Intermediate tables that are read more than once: written to the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="seriesloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset, and only on a local master, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as soon as it is done, not when the driver happens to collect garbage. For writes, whose plans
    nothing reads again; the session's setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table: its lineage is cut, a lost executor costs a read, and the planner knows its size."""
    path = f"{shared_folder(df.sparkSession)}/seriesloom-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(df: DataFrame) -> None:
    """Deletes a table of `settled` that nothing reads any more."""
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
    place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
