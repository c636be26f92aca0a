"""Structured Streaming over the batch operators: pair analysis with carried state, and windowed counts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import RelParams, analyze, load_history


def stream_pairs(flows: DataFrame, p: RelParams, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch continues from the state that the last one left; a batch that is repeated starts from the same state again.

    Batches must come in order of time, whole windows at a time, as the batch analysis asks.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        done = sorted(int(x.name) for x in Path(out).glob("*") if x.name.isdigit() and int(x.name) < number and (x / "history" / "state" / "_SUCCESS").exists())
        history = load_history(batch.sparkSession, f"{out}/{done[-1]}/history", p) if done else None
        analyze(batch, p, f"{out}/{number}", history=history)

    return flows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_flows(flows: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """Flows, bytes and approximate destinations per host and window, with a watermark; exact distincts stay in batch."""
    window = F.window("flow_start", f"{minutes} minutes")
    out = flows.withWatermark("flow_start", late).groupBy("src_ip", window.alias("w")).agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes_total"), F.approx_count_distinct("dst_ip").alias("approx_dst_ip"))
    return out.select("src_ip", F.col("w.start").alias("window_start"), "flows", "bytes_total", "approx_dst_ip")
