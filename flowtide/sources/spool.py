"""Intermediate tables in the folder that driver and executors share: read again instead of computed again, also after lost executors.

Each application has a folder of its own there. :func:`discard` takes away a table that nothing reads any more, :func:`discard_all` the
whole folder; results that were not evaluated yet may still need it, so callers do that at the end of a run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all runs on one machine, as in tests.
LOCAL_DIR = "/tmp/checkpoints/flowtide"


class SpoolError(ValueError):
    """There is no shared folder."""


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``. On a cluster it must be set: a local folder would differ between executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise SpoolError("spark.checkpoint.dir must name a folder that driver and executors share")
    return LOCAL_DIR


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}"


def spooled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: cuts the lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._spool_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete spooled tables whose readers have all been written out themselves; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_spool_path", None)
        if path:
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this application has spooled."""
    _delete(spark, own_dir(spark))
