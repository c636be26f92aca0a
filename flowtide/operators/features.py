"""Host x window features: a registry of Column factories, one aggregation, quality in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import duration, finite, heavy_tailed, is_private
from .ordering import quantiles

KEYS = ["src_ip", "window_start"]
TRACE = ["src_ip", "window_start", "window_end", "flow_date", "first_flow_start", "last_flow_start"]


class FeatureError(ValueError):
    """A feature can't be computed or doesn't exist."""


@dataclass(frozen=True)
class FeatureDef:
    """A feature: its aggregate, the columns it needs, and whether it is heavy-tailed."""

    name: str
    make: Callable[[], Column]
    needs: tuple[str, ...] = ()
    log1p: bool = False
    doc: str = ""


def _share(condition: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.avg(condition().cast("double"))


FEATURES = [
    FeatureDef("flows", lambda: F.count("*"), (), True, "flows that start in the window"),
    FeatureDef("bytes_total", lambda: F.sum("bytes"), ("bytes",), True, "sum of bytes"),
    FeatureDef("packets_total", lambda: F.sum("packets"), ("packets",), True, "sum of packets"),
    FeatureDef("max_flow_bytes", lambda: F.max("bytes"), ("bytes",), True, "largest flow in bytes"),
    FeatureDef("bytes_per_packet", lambda: F.try_divide(F.sum("bytes"), F.nullif(F.sum("packets"), F.lit(0.0))), ("bytes", "packets"), True, "bytes over packets"),
    FeatureDef("uniq_dst_ip", lambda: F.countDistinct("dst_ip"), ("dst_ip",), True, "distinct destinations"),
    FeatureDef("uniq_dst_port", lambda: F.countDistinct("dst_port"), ("dst_port",), True, "distinct destination ports"),
    FeatureDef("internal_share", _share(lambda: F.col("dst_is_private")), ("dst_ip",), False, "share of private destinations"),
    FeatureDef("tcp_share", _share(lambda: F.col("protocol") == 6), ("protocol",), False, "share of TCP"),
    FeatureDef("udp_share", _share(lambda: F.col("protocol") == 17), ("protocol",), False, "share of UDP"),
    FeatureDef("icmp_share", _share(lambda: F.col("protocol") == 1), ("protocol",), False, "share of ICMP"),
    FeatureDef("mean_duration_s", lambda: F.avg("duration_s"), ("flow_end",), True, "mean duration"),
]
#: Features of the pair analysis that can join the table.
PAIR_FEATURES = ["rel_pairs", "rel_new_dst", "rel_recently_unseen_dst", "rel_freq_increase", "rel_freq_decrease", "rel_max_abs_log2_change"]
BY_NAME = {f.name: f for f in FEATURES}


def select_features(available: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Names in the order of definition; unknown or unavailable ones are refused."""
    known = [f.name for f in FEATURES] + PAIR_FEATURES
    for name in [*(include or ()), *exclude]:
        if name not in known:
            raise FeatureError(f"unknown feature {name!r}")
    if missing := [n for n in include or () if n not in available]:
        raise FeatureError(f"not available: {missing}")
    return [n for n in known if n in available and (include is None or n in include) and n not in exclude]


def with_derived(flows: DataFrame) -> DataFrame:
    """Adds duration_s and dst_is_private where they are missing."""
    out = flows
    if "duration_s" not in out.columns:
        out = out.withColumn("duration_s", duration(F.col("flow_start"), F.col("flow_end")))
    if "dst_is_private" not in out.columns:
        out = out.withColumn("dst_is_private", is_private(F.col("dst_ip")))
    return out


def usable(flows: DataFrame, *needed: str) -> DataFrame:
    """Flows with a start and non-empty addresses."""
    condition = F.col("flow_start").isNotNull()
    for c in needed or ("src_ip",):
        condition = condition & F.col(c).isNotNull() & (F.col(c) != "")
    return flows.where(condition)


def bucketed(flows: DataFrame, minutes: int, ts: str = "flow_start") -> DataFrame:
    """Adds window_start, window_end and flow_date of the half-open, UTC-aligned window."""
    if 1440 % minutes:
        raise FeatureError("a window must divide a day")
    width = F.expr(f"interval {minutes} minutes")
    start = F.window(F.col(ts), f"{minutes} minutes").getField("start")
    return flows.withColumn("window_start", start).withColumn("window_end", F.col("window_start") + width).withColumn("flow_date", F.to_date("window_start"))


def host_window_features(flows: DataFrame, minutes: int, names: Sequence[str] | None = None) -> DataFrame:
    """One row per host and window with a flow: trace columns and features."""
    chosen = [BY_NAME[n] for n in (names or [f.name for f in FEATURES])]
    rows = bucketed(usable(with_derived(flows)), minutes)
    files = [F.countDistinct("source_file").alias("n_source_files")] if "source_file" in rows.columns else []
    return rows.groupBy("src_ip", "window_start", "window_end", "flow_date").agg(
        F.min("flow_start").alias("first_flow_start"), F.max("flow_start").alias("last_flow_start"), *files, *[f.make().alias(f.name) for f in chosen]
    )


def transformed(name: str) -> Column:
    """A feature as models see it."""
    value = F.col(name).cast("double")
    return heavy_tailed(value) if name in PAIR_FEATURES or BY_NAME[name].log1p else finite(value)


def feature_quality(table: DataFrame, names: Sequence[str], train: Column) -> DataFrame:
    """feature, rows, non_null, train_finite, train_std and status (ok, all_null, constant), from one scan."""
    aggs = [F.count("*").alias("rows")]
    for n in names:
        value = F.when(train, finite(F.col(n).cast("double")))
        aggs += [F.count(n).alias(f"{n}__non_null"), F.count(value).alias(f"{n}__finite"), F.stddev_pop(value).alias(f"{n}__std")]
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("rows"), F.col(f"{n}__non_null").alias("non_null"), F.col(f"{n}__finite").alias("train_finite"), F.col(f"{n}__std").alias("train_std")) for n in names])
    out = table.agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")
    return out.withColumn("status", F.when(F.col("train_finite") == 0, "all_null").when(F.col("train_std") == 0, "constant").otherwise("ok"))


def training_stats(table: DataFrame, names: Sequence[str], train: Column) -> DataFrame:
    """One row: min_, max_ of each feature, med_ and scale_ of its transformed values (IQR / 1.349, else population std, else null)."""
    aggs = []
    for n in names:
        raw, t = F.when(train, finite(F.col(n).cast("double"))), F.when(train, transformed(n))
        aggs += [F.min(raw).alias(f"min_{n}"), F.max(raw).alias(f"max_{n}"), F.stddev_pop(t).alias(f"std_{n}")]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), transformed(n).alias("t")) for n in names]))
    q = quantiles(table.where(train).select(cells.alias("c")).select("c.*"), ["feature"], "t", (0.25, 0.5, 0.75))
    q = q.agg(*[F.max(F.when(F.col("feature") == n, F.col("q"))).alias(f"q_{n}") for n in names])
    row = table.agg(*aggs).crossJoin(F.broadcast(q))  # one row each
    cols = []
    for n in names:
        q = F.col(f"q_{n}")
        iqr = q[2] - q[0]
        scale = F.when(iqr > 0, iqr / 1.349).when(F.col(f"std_{n}") > 0, F.col(f"std_{n}"))
        cols += [F.col(f"min_{n}"), F.col(f"max_{n}"), q[1].alias(f"med_{n}"), scale.alias(f"scale_{n}")]
    return row.select(*cols)


def host_context(table: DataFrame, train: Column, names: Sequence[str] = ("flows", "bytes_total", "uniq_dst_ip", "uniq_dst_port")) -> DataFrame:
    """Per host of the training period: train_windows and medians."""
    rows = table.where(train)
    return rows.groupBy("src_ip").agg(F.count("*").alias("train_windows"), *[F.median(F.col(n).cast("double")).alias(f"train_median_{n}") for n in names])


def robust_z(name: str) -> Column:
    """Deviation of a feature from the training median on the model scale; needs the columns of :func:`training_stats`."""
    return (transformed(name) - F.col(f"med_{name}")) / F.col(f"scale_{name}")


def beyond_range(names: Sequence[str]) -> Column:
    """Names of the features outside their training range."""
    return F.array_compact(F.array(*[F.when((F.col(n) < F.col(f"min_{n}")) | (F.col(n) > F.col(f"max_{n}")), F.lit(n)) for n in names]))


def with_stats(table: DataFrame, stats: DataFrame) -> DataFrame:
    """Each row beside the one row of statistics."""
    return table.crossJoin(F.broadcast(stats))  # one row


def largest_deviations(names: Sequence[str], k: int = 3) -> Column:
    """The k largest deviations (a: absolute, to six places; f: feature; v: value; z), ties by name, last first."""
    cells = F.array(*[F.struct(F.round(F.abs(robust_z(n)), 6).alias("a"), F.lit(n).alias("f"), F.col(n).cast("double").alias("v"), F.round(robust_z(n), 6).alias("z")) for n in names])
    return F.slice(F.sort_array(F.filter(cells, lambda c: c["a"].isNotNull()), asc=False), 1, k)


def top_deviations(names: Sequence[str], k: int = 3) -> Column:
    """The k largest deviations as text ``feature=value (z +x)``."""
    return F.array_join(F.transform(largest_deviations(names, k), lambda c: F.format_string("%s=%.2f (z %+.2f)", c["f"], c["v"], c["z"])), "; ")


def training_sample(table: DataFrame, train: Column, max_rows: int, n_days: int, seed: int, key: Column | None = None) -> DataFrame:
    """A deterministic sample: at most ceil(max_rows / n_days) rows a day, then max_rows, by hash. Row-local, so later rows change nothing."""
    from pyspark.sql import Window as W

    cap = -(-max_rows // max(1, n_days))
    h = key if key is not None else F.xxhash64("src_ip", "window_start", F.lit(seed))
    rows = table.where(train).withColumn("__h", h)
    day = W.partitionBy("flow_date").orderBy("__h", *KEYS)
    kept = rows.withColumn("__r", F.row_number().over(day)).where(F.col("__r") <= cap)
    return kept.orderBy("__h", *KEYS).limit(max_rows).drop("__h", "__r")
