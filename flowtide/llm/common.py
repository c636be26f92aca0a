"""Helpers shared by the corpus operators: table access, spooling to shared storage, Arrow stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from ..sources.spool import discard as discard
from ..sources.spool import spooled as spool

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch where the session has Spark's default of 10 000: whole texts can be long, and JVM and Python each hold batches.
BATCH_ROWS = 1000
#: Bytes of such a batch, where the session has no bound: rows can be much larger than texts, as packed shingles are. A longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, tag: str, most_rows: int = 20_000) -> DataFrame:
    """``df`` written out, and marked for broadcast if it has no more than ``most_rows`` rows; else joins shuffle it."""
    kept = spool(df, tag)
    return F.broadcast(kept) if kept.limit(most_rows + 1).count() <= most_rows else kept


def redealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly. A join then shuffles both of its sides itself, so that Spark can split a hot key's partition."""
    return df.hint("rebalance")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over whole rows; ``fn`` sees the batches of one task and must keep bounded state only."""
    ship(df.sparkSession)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(setting) == "10000":
        df.sparkSession.conf.set(setting, str(BATCH_ROWS))
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) is None:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: workers are kept for later tasks, and idle ones would hold their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def utf8(values: pa.Array) -> list[bytes]:
    """The values of a string array as UTF-8 bytes, null as empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def ids_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only; extra columns of the input stay out of the operators' way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
