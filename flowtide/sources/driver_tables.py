"""Flow views over the general-purpose test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as flows: users are sources, the number in props picks the destination."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.select("event_id", "ts", "user_id", "event_type", k.alias("k"), cents.alias("cents"))
    kind, k, cents = F.col("event_type"), F.col("k"), F.col("cents")
    seconds = lambda n: F.make_dt_interval(secs=n)
    port = F.when(kind == "click", 443).when(kind == "view", 80).when(kind == "purchase", 8443).when(kind == "signup", 53)
    return e.select(
        F.col("ts").alias("flow_start"),
        F.when((kind == "error") & (k >= 90), F.col("ts") - seconds(F.lit(5))).otherwise(F.col("ts") + seconds(k)).alias("flow_end"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 250).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        F.when(k < 60, F.concat(F.lit("10.1.0."), k.cast("string"))).when(k < 90, F.concat(F.lit("203.0.113."), k.cast("string"))).otherwise(F.concat(F.lit("host-"), k.cast("string"))).alias("dst_ip"),
        port.cast("long").alias("dst_port"), F.when(kind == "error", 1).when(kind == "signup", 17).otherwise(6).cast("long").alias("protocol"),
        F.when(cents >= 500, cents - 500).cast("double").alias("bytes"), F.when(k > 0, k).cast("double").alias("packets"),
        F.lit("events").alias("source_file"), F.col("event_id").alias("source_row_index"),
    )


def event_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flows as a raw export has them: starts as text with an offset, ends as text without, padded addresses, negative sizes."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = event_flows(spark, sf_dir)
    return e.select(
        F.concat(text(F.col("flow_start") + F.expr("INTERVAL '05:30' HOUR TO MINUTE")), F.lit("+05:30")).alias("flow_start_time"), text(F.col("flow_end")).alias("flow_end_time"),
        F.concat(F.lit("  "), "src_ip", F.lit(" ")).alias("src_id_addr"), F.col("dst_ip").alias("dist_id_addr"), F.col("dst_port").cast("int").alias("dist_port"),
        F.col("protocol").cast("short").alias("ip_protocol_id"), F.coalesce("bytes", F.lit(-1.0)).alias("num_bytes"), F.col("packets").cast("float").alias("num_packets"),
        F.lit("x").alias("unused"), "source_file", "source_row_index",
    )


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table lineitem as flows from suppliers to parts."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.col("l_shipdate").alias("flow_start"), F.col("l_suppkey").cast("string").alias("src_ip"), F.col("l_partkey").cast("string").alias("dst_ip"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("double").alias("bytes"), F.col("l_quantity").alias("packets"),
    )
