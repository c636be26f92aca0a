"""Row numbers, ranks and exact quantiles over any number of rows, without a window that gathers them in one task.

Rows are dealt out by range and sorted within partitions; each partition counts its own, and the sums of earlier partitions (one
row for each partition and group) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.spool import spooled

_LOW = (1 << 33) - 1  # monotonically_increasing_id: place in the partition below, partition above


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its row number (1-based, long) in a total order."""
    dealt = spooled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row for each partition
    return dealt.join(starts, "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND(_LOW) + 1).drop("__id", "__part", "__start")


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values that aren't null in each group: how often (times), how many rows come before, and the group's rows (total).

    The number of groups must be small (periods, features); that of rows and values needn't be.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    dealt = spooled(counts.repartitionByRange(*keys, value).withColumn("__part", F.spark_partition_id()), "counts")
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("times").alias("__n"))
    groups = W.partitionBy(*keys)
    starts = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(groups.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(groups).alias("total"))
    own = W.partitionBy(*keys, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inner = dealt.withColumn("__before", F.coalesce(F.sum("times").over(own), F.lit(0)))
    return inner.join(starts, [*keys, "__part"]).select(*keys, value, "times", (F.col("__start") + F.col("__before")).alias("before"), "total")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Per group the array ``q`` of exact quantiles, linear between neighbours."""
    picks = []
    for p in probabilities:
        at = F.lit(p) * (F.col("total") - 1)
        holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("times"))
        picks += [F.max(F.when(holds(F.floor(at)), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))]
    rows = ordered_counts(df, keys, value).groupBy(*keys).agg(F.max("total").alias("__t"), *[c.alias(f"__{i}") for i, c in enumerate(picks)])
    out = []
    for i, p in enumerate(probabilities):
        at, lo, hi = F.lit(p) * (F.col("__t") - 1), F.col(f"__{2 * i}"), F.col(f"__{2 * i + 1}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return rows.select(*keys, F.array(*out).alias("q"))


def discrete_quantile(df: DataFrame, value: str, probability: float) -> DataFrame:
    """One row, ``cut``: the smallest value that at least this share of the rows don't exceed."""
    rows = ordered_counts(df.select(F.lit(0).alias("__g"), value), ["__g"], value)
    return rows.agg(F.min(F.when(F.col("before") + F.col("times") >= F.lit(probability) * F.col("total"), F.col(value))).alias("cut"))


def with_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the rank of their value in the group (equal values, equal rank); a null has none."""
    ranks = ordered_counts(df.select(*keys, value), keys, value).select(*keys, value, (F.col("before") + 1).alias(name))
    return df.join(ranks, [*keys, value], "left")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str) -> DataFrame:
    """The first n rows of each group; Spark drops later rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
