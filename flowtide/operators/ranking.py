"""From raw scores to ranks: cutoffs, percentiles, bands, alerts, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .ordering import numbered, ordered_counts
from .features import beyond_range, top_deviations, with_stats

BANDS = {"Critical": 0.999, "High": 0.995, "Medium": 0.99, "Low": 0.975}
BELOW = "Below thresholds"
REVIEW = ("Critical", "High")
#: Grid points in hundred-thousandths: every 0.001, and every 0.00001 from 0.99.
GRID = [*range(0, 99_000, 100), *range(99_000, 100_001)]


class BandError(ValueError):
    """The bands can't be calibrated."""


@dataclass(frozen=True)
class Cutoffs:
    """Thresholds of one model, highest band first, and the percentile grid of its reference scores."""

    model: str
    n: int
    thresholds: dict[str, float]
    grid: list[float] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)


def band_quantiles(bands: dict[str, float] | None = None, budgets: dict[str, float] | None = None, windows_per_day: float | None = None) -> dict[str, float]:
    """Fixed quantiles, or 1 - budget / windows per day."""
    if not budgets:
        return dict(bands or BANDS)
    if not windows_per_day or any(b >= windows_per_day for b in budgets.values()):
        raise BandError("a daily budget must be below the windows of a day")
    return {name: 1 - b / windows_per_day for name, b in budgets.items()}


def reference_scores(scores: DataFrame, models: Sequence[str], where: Column) -> DataFrame:
    """model and s: all finite scores of each model in the reference period."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), finite(F.col(f"{m}_raw")).alias("s")) for m in models]))
    return scores.where(where).select(each.alias("x")).select("x.model", "x.s").where("s is not null")


def wanted_places(n: int, quantiles: dict[str, float]) -> tuple[dict[str, int], np.ndarray]:
    """Of n ordered scores, the place ceil(q (n - 1)) of each band's cutoff, and the places floor(q (n - 1)) of the percentile grid."""
    return {b: math.ceil(round(q * (n - 1), 9)) for b, q in quantiles.items()}, np.array([m * (n - 1) // 100_000 for m in GRID])


def calibrate(reference: DataFrame, models: Sequence[str], quantiles: dict[str, float]) -> dict[str, Cutoffs]:
    """Observed scores at the wanted places of each model (rows of ``reference``: model, s); needs 10 scores.

    One sort by range serves all models, and at most a row for each wanted place comes to the driver.
    """
    counted = ordered_counts(reference, ["model"], "s")

    @F.pandas_udf("boolean")
    def holds(before: pd.Series, times: pd.Series, total: pd.Series) -> pd.Series:
        out = np.zeros(len(before), bool)
        for n in total.unique().tolist():
            cuts, grid = wanted_places(n, quantiles)
            wanted, own = np.unique([*cuts.values(), *grid]), (total == n).to_numpy()
            out[own] = np.searchsorted(wanted, before[own].to_numpy()) < np.searchsorted(wanted, (before + times)[own].to_numpy())
        return pd.Series(out)

    found = counted.where(holds("before", "times", "total")).select("model", "s", (F.col("before") + F.col("times")).alias("upto"), "total").collect()
    out = {}
    for m in models:
        rows = sorted((r["upto"], r["s"], r["total"]) for r in found if r["model"] == m)
        n = rows[0][2] if rows else 0
        if n < 10:
            raise BandError(f"{m}: {n} reference scores; 10 are needed")
        upto, values = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        cuts, grid = wanted_places(n, quantiles)
        kept = np.unique(np.searchsorted(upto, grid, side="right"))
        out[m] = Cutoffs(m, n, {b: float(values[np.searchsorted(upto, i, side="right")]) for b, i in cuts.items()}, values[kept].tolist(), (upto[kept] / n).tolist())
    return out


def band(raw: Column, thresholds: dict[str, float], below: str = BELOW) -> Column:
    """The first band whose cutoff the score reaches."""
    out = None
    for name, cut in thresholds.items():
        out = F.when(raw >= F.lit(cut), F.lit(name)) if out is None else out.when(raw >= F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(below))


def percentile_of(raw: Column, cutoffs: Cutoffs) -> Column:
    """Share of the largest grid score that doesn't exceed the score, 0 below the grid: an as-of lookup in a sorted array."""
    grid, shares = np.array(cutoffs.grid), np.append(np.array(cutoffs.shares), 0.0)

    @F.pandas_udf("double")
    def look(s: pd.Series) -> pd.Series:
        return pd.Series(shares[np.searchsorted(grid, s.to_numpy(), side="right") - 1]).where(s.notna())

    return look(raw)


def percentile_asof(scores: DataFrame, raw: str, grid: DataFrame) -> DataFrame:
    """The same as a relational as-of join with a grid (score, share): each grid row holds up to the next one."""
    upper = F.lead("score").over(W.orderBy("score"))  # the grid has at most 1 991 rows
    spans = grid.select("score", "share", F.coalesce(upper, F.lit(float("inf"))).alias("__next"))
    out = scores.join(F.broadcast(spans), (F.col(raw) >= F.col("score")) & (F.col(raw) < F.col("__next")), "left")
    return out.withColumn(f"{raw.removesuffix('_raw')}_pct", F.coalesce("share", F.lit(0.0))).drop("score", "share", "__next")


def scored_windows(table: DataFrame, models: Sequence[str], cutoffs: dict[str, Cutoffs], below: str = BELOW) -> DataFrame:
    """Adds <model>_pct and <model>_band to rows that carry <model>_raw."""
    out = table
    for m in models:
        out = out.withColumn(f"{m}_pct", percentile_of(F.col(f"{m}_raw"), cutoffs[m])).withColumn(f"{m}_band", band(F.col(f"{m}_raw"), cutoffs[m].thresholds, below))
    return out


def in_review(models: Sequence[str], review: Sequence[str] = REVIEW) -> Column:
    """Whether any model puts the row in a review band."""
    out = F.lit(False)
    for m in models:
        out = out | F.col(f"{m}_band").isin(*review)
    return out


def beyond_range_counts(scores: DataFrame, models: Sequence[str], review: Sequence[str] = REVIEW) -> DataFrame:
    """One row: windows outside training with an input beyond its training range, and those of them in no review band."""
    beyond = (F.size("beyond_train_range") > 0) & (F.col("period") != "train")
    return scores.agg(F.count_if(beyond).alias("windows_beyond"), F.count_if(beyond & ~in_review(models, review)).alias("not_in_review"))


def best_band(models: Sequence[str], order: Sequence[str]) -> Column:
    """The highest band over the models."""
    out = F.lit(BELOW)
    for name in reversed(list(order)):
        hit = F.lit(False)
        for m in models:
            hit = hit | (F.col(f"{m}_band") == name)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def ranked_alerts(scores: DataFrame, models: Sequence[str], order: Sequence[str] = tuple(BANDS), review: Sequence[str] = REVIEW) -> DataFrame:
    """The review rows: review_band, models_in_review, max_pct and alert_rank (max percentile, then their sum, host, window).

    The rank comes from a sort by range, so no task gathers all review rows.
    """
    rows = scores.where(in_review(models, review))
    total = sum((F.col(f"{m}_pct") for m in models), F.lit(0.0))
    rows = rows.withColumns({
        "review_band": best_band(models, order),
        "models_in_review": F.array_compact(F.array(*[F.when(F.col(f"{m}_band").isin(*review), F.lit(m)) for m in models])),
        "max_pct": F.greatest(*[F.col(f"{m}_pct") for m in models]) if len(models) > 1 else F.col(f"{models[0]}_pct"),
        "__sum": total,
    })
    ranked = numbered(rows, (F.desc("max_pct"), F.desc("__sum"), F.col("src_ip"), F.col("window_start")), "alert_rank")
    return ranked.withColumn("alert_rank", F.col("alert_rank").cast("int")).drop("__sum")


def alert_context(alerts: DataFrame, stats: DataFrame, hosts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds deviations, range flags and what training knows of the host."""
    rows = with_stats(alerts, stats).withColumn("top_deviations", top_deviations(names)).withColumn("beyond_train_range", beyond_range(names))
    rows = rows.drop(*stats.columns).join(hosts, "src_ip", "left")
    return rows.withColumn("entity_seen_in_train", F.col("train_windows").isNotNull()).withColumnRenamed("train_windows", "entity_train_windows")


def alert_traces(alerts: DataFrame, flows: DataFrame, top_n: int, k: int) -> DataFrame:
    """Per alert up to rank top_n: flow count, source files, and the first k rows by start, file and row number.

    flows: src_ip, window_start (the flow's bucket), flow_start, source_file, source_row_index. The interval join is an equi-join on the
    bucket. Rows are ranked before they are collected, so a window with many flows gathers k of them.
    """
    keys = alerts.where(F.col("alert_rank") <= top_n).select("src_ip", "window_start", "alert_rank")
    keys = F.broadcast(keys) if top_n <= 10_000 else keys
    rows = flows.join(keys, ["src_ip", "window_start"])
    order = W.partitionBy("src_ip", "window_start").orderBy("flow_start", "source_file", "source_row_index")
    ranked = rows.withColumn("__r", F.row_number().over(order))
    first = F.when(F.col("__r") <= k, F.struct("__r", F.struct(F.col("source_file").alias("file"), F.col("source_row_index").alias("row_index")).alias("t")))
    return ranked.groupBy("src_ip", "window_start", "alert_rank").agg(
        F.count("*").alias("trace_flow_count"), F.array_sort(F.collect_set("source_file")).alias("trace_source_files"),
        F.transform(F.array_sort(F.collect_list(first)), lambda x: x["t"]).alias("trace_rows"),
    )


def daily_summary(scores: DataFrame, models: Sequence[str], order: Sequence[str] = tuple(BANDS), below: str = BELOW, day_category: Column | None = None) -> DataFrame:
    """Per flow_date: period, windows, hosts, flows, counts of each band, maxima, and the annotation category of the day, an expression
    over flow_date."""
    aggs = [F.max("period").alias("period"), F.count("*").alias("windows"), F.countDistinct("src_ip").alias("hosts"), F.sum("flows").alias("flows")]
    for m in models:
        aggs += [F.count_if(F.col(f"{m}_band") == b).alias(f"{m}_{b.lower()}") for b in order]
        aggs += [F.count_if(F.col(f"{m}_band") == below).alias(f"{m}_below"), F.max(f"{m}_raw").alias(f"{m}_max_raw"), F.max(f"{m}_pct").alias(f"{m}_max_pct")]
    out = scores.groupBy("flow_date").agg(*aggs)
    return out if day_category is None else out.withColumn("day_category", day_category)


def entity_summary(scores: DataFrame, models: Sequence[str], review: Sequence[str] = REVIEW) -> DataFrame:
    """Per host: windows, first and last window, flows, training windows, per model maxima and counts; ties go to the earliest window."""
    aggs = [F.count("*").alias("windows"), F.min("window_start").alias("first_window"), F.max("window_start").alias("last_window"), F.sum("flows").alias("flows"), F.count_if(F.col("period") == "train").alias("train_windows")]
    for m in models:
        top = F.max(F.struct(F.col(f"{m}_raw"), (-F.unix_seconds(F.col("window_start").cast("timestamp"))).alias("t"), F.col("window_start").alias("w")))
        aggs += [F.max(f"{m}_pct").alias(f"{m}_max_pct"), F.count_if(F.col(f"{m}_band").isin(*review)).alias(f"{m}_review"), top.getField("w").alias(f"{m}_top_window")]
        if "annotation_category" in scores.columns:
            aggs.append(F.count_if(F.col(f"{m}_band").isin(*review) & (F.col("annotation_category") == "inside")).alias(f"{m}_review_inside"))
    return scores.groupBy("src_ip").agg(*aggs)
