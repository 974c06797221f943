"""Cutting lineage with tables in the shared folder, so that a lost executor costs a re-read and no re-run."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one of our own (local runs only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sievecraft-")
        spark.conf.set("spark.checkpoint.dir", _OWN[app])
    return _OWN[app]


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting that holds inside the block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, _FREE, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sievecraft_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote; nothing may read it any more."""
    path = getattr(df, "_sievecraft_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
