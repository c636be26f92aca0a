"""Directed pairs over time: what each pair did before, from strictly earlier windows only, with history carried across runs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import instant
from .features import bucketed, usable

STATE_VERSION = 1


class RelationshipError(ValueError):
    """The analysis can't continue."""


@dataclass(frozen=True)
class RelParams:
    """Window width, lookbacks and thresholds of the analysis."""

    window_minutes: int = 60
    novelty_lookback_days: float = 7
    baseline_lookback_days: float = 7
    warmup_days: float = 7
    min_support: int = 4
    log2_threshold: float = 2.0
    group_by_port: bool = False
    group_by_protocol: bool = False

    @property
    def pair_cols(self) -> list[str]:
        return ["src_ip", "dst_ip", *(["dst_port"] if self.group_by_port else []), *(["protocol"] if self.group_by_protocol else [])]


def _span(days: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(days * 86400)).cast("decimal(18,6)"))


def pair_windows(flows: DataFrame, p: RelParams) -> DataFrame:
    """Sparse pair x window rows: flows, bytes, packets."""
    rows = bucketed(usable(flows, "src_ip", "dst_ip"), p.window_minutes)
    return rows.groupBy(*p.pair_cols, "window_start").agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def null_safe(left: str, right: str, cols: Sequence[str]) -> Column:
    """Equality of all columns, nulls equal."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def pair_signals(new: DataFrame, p: RelParams, history_start: datetime, recent: DataFrame | None = None, summary: DataFrame | None = None, ntz: bool = False) -> DataFrame:
    """Signals of each new pair window. recent: earlier pair windows within the baseline lookback; summary: first and last sighting.

    All windows share one partitioning and order: a single shuffle and sort.
    """
    cols = p.pair_cols
    base = ["window_start", "flows", "bytes", "packets"]
    rows = new.select(*cols, *base, F.lit(True).alias("is_new"))
    if recent is not None:
        rows = rows.unionByName(recent.select(*cols, *base, F.lit(False).alias("is_new")))
    w = W.partitionBy(*cols).orderBy("window_start")
    # strictly earlier windows of the lookback: a pair has one row for a window, so excluding the current instant excludes the row
    frame = f"OVER (PARTITION BY {', '.join(cols)} ORDER BY window_start RANGE BETWEEN INTERVAL '{int(p.baseline_lookback_days * 86400)}' SECOND PRECEDING AND INTERVAL '0.000001' SECOND PRECEDING)"
    rows = rows.select(
        *cols, *base, "is_new", F.lag("window_start").over(w).alias("prev"), F.min("window_start").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("first_in"),
        F.expr(f"count(*) {frame}").alias("baseline_support"), F.expr(f"percentile(flows, 0.5) {frame}").alias("baseline_flows_median"), F.expr(f"percentile(bytes, 0.5) {frame}").alias("baseline_bytes_median"),
    ).where("is_new").drop("is_new")
    if summary is not None:
        known = summary.select(*cols, F.col("first_seen").alias("h_first"), F.col("last_seen").alias("h_last"))
        rows = rows.alias("a").join(known.alias("h"), null_safe("a", "h", cols), "left").select("a.*", "h.h_first", "h.h_last")
    else:
        kind = "timestamp_ntz" if ntz else "timestamp"
        rows = rows.withColumns({"h_first": F.lit(None).cast(kind), "h_last": F.lit(None).cast(kind)})
    last = F.coalesce("prev", "h_last")
    warm = F.col("window_start") < F.lit(instant(history_start, ntz)) + _span(p.warmup_days)
    change = F.log2((F.col("flows") + 1.0) / (F.col("baseline_flows_median") + 1.0))
    rows = rows.withColumns({"first_seen": F.least("first_in", "h_first"), "last_seen_before": last, "warmup": warm, "log2_change": F.when(F.col("baseline_support") >= p.min_support, change)})
    novelty = F.when(F.col("last_seen_before").isNull(), F.when(F.col("warmup"), "warmup").otherwise("never_seen")).when(
        F.col("last_seen_before") < F.col("window_start") - _span(p.novelty_lookback_days), "recently_unseen"
    ).otherwise("seen_recently")
    status = F.when(F.col("baseline_support") < p.min_support, "insufficient_history").when(F.col("log2_change") >= p.log2_threshold, "increase").when(
        F.col("log2_change") <= -p.log2_threshold, "decrease"
    ).otherwise("stable")
    rows = rows.withColumns({
        "window_end": F.col("window_start") + F.expr(f"interval {p.window_minutes} minutes"), "flow_date": F.to_date("window_start"),
        "days_since_last_seen": F.datediff("window_start", "last_seen_before").cast("long"), "novelty_status": novelty, "change_status": status,
    })
    return rows.select(*cols, "window_start", "window_end", "flow_date", "flows", "bytes", "packets", "first_seen", "last_seen_before", "days_since_last_seen", "baseline_support", "baseline_flows_median", "baseline_bytes_median", "log2_change", "novelty_status", "change_status", "warmup")


def host_relationships(signals: DataFrame) -> DataFrame:
    """Per host and window: counts of pair signals; novelty is null in warm-up."""
    new = F.count_if(F.col("novelty_status") == "never_seen")
    return signals.groupBy("src_ip", "window_start", "window_end", "flow_date").agg(
        F.count("*").alias("rel_pairs"), F.any_value("warmup").alias("rel_warmup"),
        F.when(~F.any_value("warmup"), new).alias("rel_new_dst"), F.when(~F.any_value("warmup"), new / F.count("*")).alias("rel_new_dst_share"),
        F.count_if(F.col("novelty_status") == "recently_unseen").alias("rel_recently_unseen_dst"),
        F.count_if(F.col("change_status") == "increase").alias("rel_freq_increase"), F.count_if(F.col("change_status") == "decrease").alias("rel_freq_decrease"),
        F.max(F.abs("log2_change")).alias("rel_max_abs_log2_change"), F.count_if(F.col("change_status") == "insufficient_history").alias("rel_pairs_insufficient_history"),
    )


def pair_evidence(signals: DataFrame) -> DataFrame:
    """Notable pair windows with a reason."""
    reasons = [
        F.when(F.col("novelty_status") == "never_seen", F.lit("pair not seen before")),
        F.when(F.col("novelty_status") == "recently_unseen", F.concat(F.lit("last seen "), F.date_format("last_seen_before", "yyyy-MM-dd"), F.lit(", "), F.col("days_since_last_seen").cast("string"), F.lit(" days before"))),
        F.when(F.col("change_status").isin("increase", "decrease"), F.concat(F.lit("flows "), F.col("change_status"), F.lit(" against a median of "), F.format_string("%.1f", F.col("baseline_flows_median")))),
    ]
    notable = F.col("novelty_status").isin("never_seen", "recently_unseen") | F.col("change_status").isin("increase", "decrease")
    return signals.where(notable).withColumn("reason", F.concat_ws("; ", *reasons))


def pair_summary(new: DataFrame, p: RelParams, old: DataFrame | None = None) -> DataFrame:
    """first_seen, last_seen and active_windows of each pair, merged with an earlier summary."""
    rows = new.groupBy(*p.pair_cols).agg(F.min("window_start").alias("first_seen"), F.max("window_start").alias("last_seen"), F.count("*").alias("active_windows"))
    if old is None:
        return rows
    both = rows.unionByName(old.select(*rows.columns))
    return both.groupBy(*p.pair_cols).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("active_windows").alias("active_windows"))


def recent_pairs(new: DataFrame, p: RelParams, end: datetime, old: DataFrame | None = None, ntz: bool = False) -> DataFrame:
    """Pair windows of the last baseline lookback before ``end``."""
    cols = [*p.pair_cols, "window_start", "flows", "bytes", "packets"]
    rows = new.select(*cols) if old is None else old.select(*cols).unionByName(new.select(*cols))
    return rows.where(F.col("window_start") >= instant(end - timedelta(days=p.baseline_lookback_days), ntz))


@dataclass(frozen=True)
class History:
    """Carried state: two tables and bounds."""

    start: datetime
    end: datetime
    summary: DataFrame
    recent: DataFrame


def load_history(spark: SparkSession, path: str, p: RelParams) -> History:
    """The state that an earlier run left; version and parameters must match."""
    meta = json.loads(spark.read.text(f"{path}/state").first()["value"])
    if meta["version"] != STATE_VERSION or meta["params"] != asdict(p):
        raise RelationshipError("the history was made with other parameters or another version")
    at = datetime.fromisoformat
    return History(at(meta["start"]), at(meta["end"]), spark.read.parquet(f"{path}/summary"), spark.read.parquet(f"{path}/recent"))


def analyze(flows: DataFrame, p: RelParams, out: str, start: datetime | None = None, end: datetime | None = None, history: History | None = None, ntz: bool = False) -> dict:
    """Write pair windows, host summary, evidence and the next state under ``out``; returns bounds and counts.

    Refuses data from before the end of the history. Empty input writes typed empty tables.
    """
    spark = flows.sparkSession
    if start is not None:
        flows = flows.where(F.col("flow_start") >= instant(start, ntz))
    if end is not None:
        flows = flows.where(F.col("flow_start") < instant(end, ntz))
    pair_windows(flows, p).write.mode("overwrite").parquet(f"{out}/pairs_new")
    new = spark.read.parquet(f"{out}/pairs_new")
    row = new.agg(F.min(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss")).alias("lo"), F.max(F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss")).alias("hi"), F.count("*").alias("n")).first()
    lo, hi = (datetime.fromisoformat(v) if v else None for v in (row["lo"], row["hi"]))
    if history and lo and lo < history.end:
        raise RelationshipError(f"data of {lo} is older than the end of the history, {history.end}")
    begin = history.start if history else start or lo or datetime(1970, 1, 1)
    until = end or (hi + timedelta(minutes=p.window_minutes) if hi else history.end if history else begin)
    old = (history.recent, history.summary) if history else (None, None)
    pair_signals(new, p, begin, *old, ntz=ntz).write.mode("overwrite").parquet(f"{out}/pair_windows")
    signals = spark.read.parquet(f"{out}/pair_windows")
    host_relationships(signals).write.mode("overwrite").parquet(f"{out}/host_windows")
    pair_evidence(signals).write.mode("overwrite").parquet(f"{out}/evidence")
    pair_summary(new, p, old[1]).write.mode("overwrite").parquet(f"{out}/history/summary")
    recent_pairs(new, p, until, old[0], ntz).write.mode("overwrite").parquet(f"{out}/history/recent")
    meta = {"version": STATE_VERSION, "params": asdict(p), "start": begin.isoformat(), "end": until.isoformat()}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/history/state")
    return {"start": begin, "end": until, "pair_windows": row["n"]}


def copy_history(spark: SparkSession, path: str, target: str) -> None:
    """The state of a run, written again elsewhere."""
    for part in ("summary", "recent"):
        spark.read.parquet(f"{path}/{part}").write.mode("overwrite").parquet(f"{target}/{part}")
    spark.read.text(f"{path}/state").coalesce(1).write.mode("overwrite").text(f"{target}/state")


def status_counts(signals: DataFrame) -> DataFrame:
    """Pair windows of each novelty and each change status: signal, status, n."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"{s}_status").alias("status")) for s in ("novelty", "change")]))
    return signals.select(each.alias("x")).groupBy("x.signal", "x.status").agg(F.count("*").alias("n"))


def top_new_pairs(evidence: DataFrame, p: RelParams, n: int) -> DataFrame:
    """The n new or recently unseen pair windows with the most flows, then bytes; ties by window and pair."""
    rows = evidence.where(F.col("novelty_status").isin("never_seen", "recently_unseen"))
    return rows.orderBy(F.desc("flows"), F.desc(F.coalesce("bytes", F.lit(0.0))), "window_start", *p.pair_cols).limit(n)


def top_changes(evidence: DataFrame, p: RelParams, n: int) -> DataFrame:
    """The n pair windows that changed most, by absolute log2 change, then flows; ties by window and pair."""
    rows = evidence.where(F.col("change_status").isin("increase", "decrease"))
    return rows.orderBy(F.desc(F.round(F.abs("log2_change"), 9)), F.desc("flows"), "window_start", *p.pair_cols).limit(n)


def top_hosts(signals: DataFrame, n: int = 10) -> DataFrame:
    """The n hosts with the most new or recently unseen pair windows, then increases."""
    of = lambda column, status: F.count_if(F.col(f"{column}_status") == status)
    rows = signals.groupBy("src_ip").agg(
        of("novelty", "never_seen").alias("never_seen"), of("novelty", "recently_unseen").alias("recently_unseen"), of("change", "increase").alias("increases"),
        of("change", "decrease").alias("decreases"), F.countDistinct("window_start").alias("windows"),
    )
    return rows.orderBy(F.desc(F.col("never_seen") + F.col("recently_unseen")), F.desc("increases"), "src_ip").limit(n)


def extend_features(table: DataFrame, host_windows: DataFrame) -> DataFrame:
    """The feature table with the six pair features."""
    cols = ["rel_pairs", "rel_new_dst", "rel_recently_unseen_dst", "rel_freq_increase", "rel_freq_decrease", "rel_max_abs_log2_change"]
    return table.join(host_windows.select("src_ip", "window_start", *cols), ["src_ip", "window_start"], "left")
