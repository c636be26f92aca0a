"""Diagnostics over scored windows: distributions, volumes, concentration, agreement, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.spool import spooled
from .ordering import discrete_quantile, numbered, quantiles, top, with_rank

CURVE = (0.9, 0.95, 0.975, 0.99, 0.995, 0.999, 0.9995)
FLOOR = 1e-4


def score_distribution(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per period and model: n, min, continuous quantiles and max."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{m}_raw").alias("s")) for m in models]))
    rows = spooled(scores.select("period", cells.alias("c")).select("period", "c.model", "c.s"), "distribution")
    out = rows.groupBy("period", "model").agg(F.count("s").alias("n"), F.min("s").alias("min"), F.max("s").alias("max"))
    out = out.join(quantiles(rows, ["period", "model"], "s", (0.5, 0.9, 0.99, 0.999)), ["period", "model"], "left")
    return out.select("period", "model", "n", "min", *[F.col("q")[i].alias(name) for i, name in enumerate(("q50", "q90", "q99", "q999"))], "max")


def band_volume(scores: DataFrame, model: str) -> DataFrame:
    """Windows in each band, and per day of the period."""
    days = scores.groupBy("period").agg(F.countDistinct("flow_date").alias("days"))
    counts = scores.groupBy("period", F.col(f"{model}_band").alias("band")).agg(F.count("*").alias("windows"))
    return counts.join(days, "period").select("period", "band", "windows", (F.col("windows") / F.col("days")).alias("per_day"))


def cutoff_curve(scores: DataFrame, model: str, thresholds: dict[float, float]) -> DataFrame:
    """Windows a day at or above each reference quantile, by period; one aggregate for all quantiles."""
    aggs = [F.count_if(F.col(f"{model}_raw") >= t).alias(f"c{i}") for i, t in enumerate(thresholds.values())]
    row = scores.groupBy("period").agg(F.countDistinct("flow_date").alias("days"), *aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"c{i}").alias("windows")) for i, q in enumerate(thresholds)]))
    return row.select("period", "days", cells.alias("c")).select("period", "c.quantile", "c.windows", (F.col("c.windows") / F.col("days")).alias("per_day"))


def top_per_day(scores: DataFrame, model: str, k: int) -> DataFrame:
    """The k highest scores of each day."""
    return top(scores, ["flow_date"], _best(model), k, "day_rank")


def _best(model: str) -> tuple[Column, ...]:
    return F.desc(f"{model}_raw"), F.col("src_ip"), F.col("window_start")


def _shared_tops(scores: DataFrame, a: str, b: str, keys: Sequence[str], n: int) -> DataFrame:
    """How many of the n highest of each group the models share (both), of the first one's (first) and of either's (either)."""
    names = [*keys, "src_ip", "window_start"]
    tops = [top(scores.select(*names, f"{m}_raw"), keys, _best(m), n, "r").select(*names, F.lit(m == a).alias("is_a")) for m in (a, b)]
    hits = tops[0].unionByName(tops[1]).groupBy(*names).agg(F.count("*").alias("c"), F.bool_or("is_a").alias("in_a"))
    return hits.groupBy(*keys).agg(F.count_if(F.col("c") == 2).alias("both"), F.count_if("in_a").alias("first"), F.count("*").alias("either"))


def concentration(scores: DataFrame, model: str, k: int, top_hosts: int = 5) -> DataFrame:
    """Per period, how the daily top-k spreads over hosts."""
    per_host = top_per_day(scores, model, k).groupBy("period", "src_ip").agg(F.count("*").alias("n"))
    ranked = per_host.withColumn("r", F.row_number().over(W.partitionBy("period").orderBy(F.desc("n"), "src_ip")))
    return ranked.groupBy("period").agg(
        F.sum("n").alias("total"), F.count("*").alias("hosts"), (F.sum(F.when(F.col("r") <= top_hosts, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"),
        F.min_by("src_ip", "r").alias("most_frequent_host"), F.max("n").alias("most_frequent_count"),
    )


def annotation_overlap(scores: DataFrame, model: str, category: Column, review: Sequence[str], k: int) -> DataFrame:
    """Shares of categories among all windows, review windows and the daily top-k, by period, and their ratios to the base."""
    rows = scores.withColumn("cat", category)
    base = rows.groupBy("period", "cat").agg(F.count("*").alias("base"), F.count_if(F.col(f"{model}_band").isin(*review)).alias("review"))
    tops = top_per_day(rows, model, k).groupBy("period", "cat").agg(F.count("*").alias("top"))
    both = base.join(tops, ["period", "cat"], "left").withColumn("top", F.coalesce("top", F.lit(0).cast("long")))
    w = W.partitionBy("period")
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(w))
    both = both.withColumns({f"{c}_share": share(c) for c in ("base", "review", "top")})
    return both.withColumns({f"{c}_ratio": F.try_divide(F.col(f"{c}_share"), F.col("base_share")) for c in ("review", "top")})


def buffer_sensitivity(scores: DataFrame, model: str, near: dict[float, Column], review: Sequence[str], k: int) -> DataFrame:
    """For each buffer width (hours) and period, the share of windows, review windows and daily top-k in an annotation or its buffer, and
    their ratios to the share of all windows. near: what counts as such at each width. All widths are counted in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("buffer_hours"), c.alias("near")) for h, c in near.items()])).alias("x")
    hit = F.col(f"{model}_band").isin(*review)
    part = lambda cond: F.try_divide(F.count_if(cond & F.col("x.near")), F.count_if(cond))
    base = scores.select("period", hit.alias("hit"), each).groupBy("x.buffer_hours", "period").agg(part(F.lit(True)).alias("base_share"), part(F.col("hit")).alias("review_share"))
    tops = top_per_day(scores, model, k).select("period", each).groupBy("x.buffer_hours", "period").agg(part(F.lit(True)).alias("top_share"))
    both = base.join(tops, ["buffer_hours", "period"], "left")
    return both.withColumns({f"{c}_ratio": F.try_divide(F.col(f"{c}_share"), F.col("base_share")) for c in ("review", "top")})


def model_agreement(scores: DataFrame, a: str, b: str, top_n: int, k: int, review: Sequence[str]) -> DataFrame:
    """Per period: Spearman, Jaccard of the top n, mean overlap of daily top-k, and review counts."""
    rows = spooled(scores.select("period", "flow_date", "src_ip", "window_start", *[f"{m}_{c}" for m in (a, b) for c in ("raw", "band")]), "agreement")
    daily = _shared_tops(rows, a, b, ["period", "flow_date"], k).groupBy("period").agg(F.avg(F.try_divide("both", "first")).alias("daily_overlap"))
    best = _shared_tops(rows, a, b, ["period"], top_n).select("period", F.try_divide("both", "either").alias("top_jaccard"))
    va, vb = F.col(f"{a}_band").isin(*review), F.col(f"{b}_band").isin(*review)
    ranked = with_rank(with_rank(rows, ["period"], f"{a}_raw", "ra"), ["period"], f"{b}_raw", "rb")
    main = ranked.groupBy("period").agg(
        F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("spearman"), F.count_if(va & vb).alias("both_review"), F.count_if(va & ~vb).alias("only_a"), F.count_if(vb & ~va).alias("only_b")
    )
    return main.join(best, "period", "left").join(daily, "period", "left")


def disagreements(scores: DataFrame, a: str, b: str, period: str, n: int) -> DataFrame:
    """Rows in one model's top n but not the other's, by best rank, 2 n at most."""
    rows = scores.where(F.col("period") == period).select("src_ip", "window_start", f"{a}_raw", f"{b}_raw")
    ranked = numbered(numbered(rows, _best(a), "rank_a"), _best(b), "rank_b")
    odd = ranked.where((F.col("rank_a") <= n) != (F.col("rank_b") <= n))
    ints = [F.col(c).cast("int").alias(c) for c in ("rank_a", "rank_b")]
    return odd.orderBy(F.least("rank_a", "rank_b"), "src_ip", "window_start").limit(2 * n).select("src_ip", "window_start", f"{a}_raw", f"{b}_raw", *ints)


def rank_agreement(x: DataFrame, xc: str, y: DataFrame, yc: str, top_n: int) -> DataFrame:
    """Spearman and top-n Jaccard of two score tables on the same windows."""
    both = x.select("src_ip", "window_start", F.col(xc).alias("x_raw")).join(y.select("src_ip", "window_start", F.col(yc).alias("y_raw")), ["src_ip", "window_start"])
    rows = spooled(both.withColumn("g", F.lit(0)), "agreement")
    tops = _shared_tops(rows, "x", "y", ["g"], top_n).select(F.try_divide("both", "either").alias("top_jaccard"))
    ranked = with_rank(with_rank(rows, ["g"], "x_raw", "rx"), ["g"], "y_raw", "ry")
    main = ranked.agg(F.count("*").alias("n"), F.corr(F.col("rx").cast("double"), F.col("ry").cast("double")).alias("spearman"))
    return main.join(tops, how="left")  # one row each


def top_categories(scores: DataFrame, raw: str, n: int, category: Column) -> DataFrame:
    """Shares of annotation categories among the n highest scores."""
    best = scores.withColumn("cat", category).orderBy(F.desc(raw), "src_ip", "window_start").limit(n)
    return best.groupBy("cat").agg(F.count("*").alias("windows")).withColumn("share", F.col("windows") / F.sum("windows").over(W.partitionBy()))


def training_concentration(scores: DataFrame, raw: str, quantile: float, limit: int) -> DataFrame:
    """Hosts in the top share of training scores."""
    train = spooled(scores.where(F.col("period") == "train").select("src_ip", raw), "training")
    cut = discrete_quantile(train, raw, quantile)
    reach = train.crossJoin(F.broadcast(cut)).where(F.col(raw) >= F.col("cut"))  # one row
    per = reach.groupBy("src_ip").agg(F.count("*").alias("windows"))
    return per.withColumn("share", F.col("windows") / F.sum("windows").over(W.partitionBy())).orderBy(F.desc("windows"), "src_ip").limit(limit)


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """-1 for null or not finite, else the first edge that isn't exceeded, else the last bin."""
    v = finite(value.cast("double"))
    out = F.when(v.isNull(), F.lit(-1))
    for i, e in enumerate(edges):
        out = out.when(v <= F.lit(e), F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def training_edges(table: DataFrame, names: Sequence[str], train: Column, parts: int = 10) -> dict[str, list[float]]:
    """Quantiles of each feature in training, which bound the bins of its drift; a feature without a value there has none."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names]))
    rows = quantiles(table.where(train).select(cells.alias("c")).select("c.*"), ["feature"], "v", [i / parts for i in range(1, parts)])
    return {r["feature"]: sorted({q for q in r["q"] if q is not None}) for r in rows.collect() if r["q"] is not None}


def feature_drift(table: DataFrame, edges: dict[str, list[float]], train: Column, bucket: Column) -> DataFrame:
    """Population stability index of each feature and time bucket against training; all features in one pass, shares floored."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), bin_of(F.col(n), e).alias("bin")) for n, e in edges.items()]))
    rows = table.select(bucket.alias("bucket"), train.alias("is_train"), cells.alias("c")).select("bucket", "is_train", "c.feature", "c.bin")
    now = rows.groupBy("feature", "bucket", "bin").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t"))
    base = now.groupBy("feature", "bin").agg(F.sum("t").alias("t"))
    base = base.withColumn("expected", F.greatest(F.try_divide(F.col("t"), F.sum("t").over(W.partitionBy("feature"))), F.lit(FLOOR))).drop("t")
    buckets = now.select("feature", "bucket").distinct()
    actual = now.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("feature", "bucket"))).select("feature", "bucket", "bin", "share")
    grid = buckets.join(base, "feature").join(actual, ["feature", "bucket", "bin"], "left").withColumn("actual", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(FLOOR)))
    return grid.groupBy("feature", "bucket").agg(F.sum((F.col("actual") - F.col("expected")) * F.log(F.col("actual") / F.col("expected"))).alias("psi"))


def score_histogram(scores: DataFrame, raw: str, lo: float, hi: float, bins: int = 60) -> DataFrame:
    """Counts in equal-width bins by period."""
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(raw) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return scores.where(F.col(raw).isNotNull()).groupBy("period", b.alias("bin")).agg(F.count("*").alias("windows"))
