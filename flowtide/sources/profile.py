"""Profile of the input flows in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.features import usable, with_derived


def _distinct(column: str | Column, exact: bool) -> Column:
    return F.countDistinct(column) if exact else F.approx_count_distinct(column)


def profile_flows(flows: DataFrame, exact: bool = False, minutes: int = 60) -> DataFrame:
    """One row of counts; distinct counts are approximate unless ``exact``. Windows of ``minutes`` give the number of host windows; flows
    without a column flow_start_status count none as invalid or without an offset."""
    rows = with_derived(flows)
    status = F.col("flow_start_status") if "flow_start_status" in rows.columns else F.lit(None).cast("string")
    window = F.struct("src_ip", F.floor((F.unix_micros(F.col("flow_start").cast("timestamp")) - 946_684_800_000_000) / (minutes * 60_000_000)).alias("w"))  # from 2000 on
    has_window = F.col("src_ip").isNotNull() & F.col("flow_start").isNotNull()
    host_window = F.when(has_window, F.xxhash64(window) if not exact else window)
    missing = lambda c: F.count_if(F.col(c).isNull())
    return rows.agg(
        F.count("*").alias("n_rows"), missing("bytes").alias("null_bytes"), missing("packets").alias("null_packets"), missing("dst_port").alias("null_ports"),
        F.count_if(F.col("flow_end") < F.col("flow_start")).alias("ends_before_start"), missing("dst_is_private").alias("dst_not_ipv4"),
        F.min("flow_start").alias("first_start"), F.max("flow_start").alias("last_start"), _distinct("src_ip", exact).alias("n_src"), _distinct("dst_ip", exact).alias("n_dst"),
        _distinct("dst_port", exact).alias("n_ports"), _distinct(host_window, exact).alias("n_host_windows"), F.count_if(status == "invalid").alias("invalid_starts"), F.count_if(status == "no_offset").alias("starts_without_offset"),
    )


def profile_days(flows: DataFrame, exact: bool = False) -> DataFrame:
    """Flows and hosts of each UTC day."""
    return usable(flows).groupBy(F.to_date("flow_start").alias("flow_date")).agg(F.count("*").alias("flows"), _distinct("src_ip", exact).alias("hosts"))
