"""Small aggregates that charts draw: every one covers all rows, and its size is bounded by buckets, bins or a stated number of hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Charts show days up to so many of them, weeks beyond.
MOST_DAYS = 120


def bucket(n_days: int, date: str = "flow_date") -> Column:
    """The day, or the Monday of its week in long periods."""
    return F.col(date) if n_days <= MOST_DAYS else F.date_trunc("week", date).cast("date")


def rarity(pct: Column, n_reference: int) -> Column:
    """-log10(1 - percentile), with 1 - percentile no less than 1 / (n + 1)."""
    return -F.log10(F.greatest(1 - pct, F.lit(1.0 / (n_reference + 1))))


def bands_by_bucket(scores: DataFrame, model: str, at: Column) -> DataFrame:
    """Windows of each band in each bucket."""
    return scores.groupBy(at.alias("bucket"), F.col(f"{model}_band").alias("band")).agg(F.count("*").alias("windows"))


def review_by_bucket(scores: DataFrame, review: Column, at: Column) -> DataFrame:
    """Windows and review windows of each bucket."""
    return scores.groupBy(at.alias("bucket")).agg(F.count("*").alias("windows"), F.count_if(review).alias("review"))


def host_heatmap(scores: DataFrame, models: Sequence[str], review: Column, at: Column, hosts: int) -> DataFrame:
    """Highest percentile of any model by host and bucket, for the hosts with the most review windows."""
    best = scores.groupBy("src_ip").agg(F.count_if(review).alias("n")).orderBy(F.desc("n"), "src_ip").limit(hosts).select("src_ip")
    top = [F.col(f"{m}_pct") for m in models]
    rows = scores.select("src_ip", at.alias("bucket"), (F.greatest(*top) if len(top) > 1 else top[0]).alias("pct"))
    return rows.join(best, "src_ip", "left_semi").groupBy("src_ip", "bucket").agg(F.max("pct").alias("max_pct"))


def hexagons(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Centre of the hexagon (flat spacing ``width``) that holds a point: the nearer one of two offset grids."""
    tall = width * math.sqrt(3)
    ax, ay = F.round(x / width) * width, F.round(y / tall) * tall
    bx, by = (F.floor(x / width) + 0.5) * width, (F.floor(y / tall) + 0.5) * tall
    near = (x - ax) * (x - ax) + (y - ay) * (y - ay) <= (x - bx) * (x - bx) + (y - by) * (y - by)
    return F.when(near, ax).otherwise(bx), F.when(near, ay).otherwise(by)


def hexbin(scores: DataFrame, a: str, b: str, n_reference: int, width: float = 0.1) -> DataFrame:
    """Windows in each hexagon of the two models' rarities."""
    x, y = hexagons(rarity(F.col(f"{a}_pct"), n_reference), rarity(F.col(f"{b}_pct"), n_reference), width)
    return scores.groupBy(F.round(x, 6).alias("x"), F.round(y, 6).alias("y")).agg(F.count("*").alias("windows"))


def zoom_centres(scores: DataFrame, model: str, n: int, gap: timedelta, most: int = 500) -> list[datetime]:
    """Starts of up to n of the ``most`` highest windows, picked by score and at least ``gap`` apart."""
    rows = scores.where(F.col(f"{model}_raw").isNotNull()).orderBy(F.desc(f"{model}_raw"), "src_ip", "window_start").select(F.col("window_start").cast("timestamp_ntz").alias("t")).limit(most).collect()
    picked: list[datetime] = []
    for (t,) in rows:
        if len(picked) < n and all(abs(t - p) >= gap for p in picked):
            picked.append(t)
    return picked


def zoom(scores: DataFrame, review: Column, centre: datetime, around: timedelta) -> DataFrame:
    """Review windows by start around a centre."""
    t = F.col("window_start").cast("timestamp_ntz")
    inside = (t >= F.lit(centre - around).cast("timestamp_ntz")) & (t <= F.lit(centre + around).cast("timestamp_ntz"))
    return scores.where(inside).groupBy(t.alias("bucket")).agg(F.count("*").alias("windows"), F.count_if(review).alias("review"))
