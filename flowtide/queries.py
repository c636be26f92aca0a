"""Queries of the flow operators over the driver's tables, each with SQL that DuckDB runs on the same tables.

``events`` (and ``lineitem``) are seen as flows by :mod:`sources.driver_tables`. A day of January 2024 belongs to train (1-15),
validation (16-22) or test (23-30). Two stand-in scores, the largest and the mean absolute robust z, feed the ranking queries.
Doubles are rounded before they are compared or given out.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.scalars import text_time
from .operators import chart_data as C
from .operators import diagnostics as D
from .operators import features as FT
from .operators import models as M
from .operators import pairs as P
from .operators import periods as PE
from .operators import ranking as R
from .operators.ordering import discrete_quantile
from .sources.driver_tables import event_export, event_flows, lineitem_flows
from .sources.flows import build_mapping, canonical_flows
from .sources.spool import spooled

PERIODS = [PE.Period("train", date(2024, 1, 1), date(2024, 1, 16)), PE.Period("validation", date(2024, 1, 16), date(2024, 1, 23)), PE.Period("test", date(2024, 1, 23), date(2024, 1, 31))]
NOTES = [PE.Annotation("maintenance", datetime(2024, 1, 10), datetime(2024, 1, 11)), PE.Annotation("incident", datetime(2024, 1, 18, 6), datetime(2024, 1, 18, 9))]
BUFFER = 6.0
SCORED = ["flows", "bytes_total", "packets_total", "uniq_dst_ip", "uniq_dst_port", "mean_duration_s", "tcp_share"]
MODELS = ["a", "b"]
MINUTES = 360
REL = P.RelParams(window_minutes=1440, novelty_lookback_days=7, baseline_lookback_days=7, warmup_days=7, min_support=1, log2_threshold=0.5)
REL_START = datetime(2024, 1, 1)
REL_CUT = datetime(2024, 1, 16)
SF = tuple[SparkSession, str]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a query and its SQL."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def label(ts: Column) -> Column:
    return PE.period_label(PERIODS, ts, ntz=True)


def is_train() -> Column:
    return PERIODS[0].where(F.col("window_start"), ntz=True)


def hosts(spark: SparkSession, d: str, minutes: int = MINUTES) -> DataFrame:
    return FT.host_window_features(event_flows(spark, d).drop("source_file"), minutes)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Features, period, and the stand-in scores a_raw and b_raw; written out once, since ranking reads them several times."""
    t = spooled(hosts(spark, d), "features")
    t = FT.with_stats(t, FT.training_stats(t, SCORED, is_train())).withColumn("period", label(F.col("window_start")))
    z = [F.abs(FT.robust_z(n)) for n in SCORED]
    mean = sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0)) / len(SCORED)
    t = t.withColumn("a_raw", F.round(F.greatest(*z), 6)).withColumn("b_raw", F.round(mean, 6)).drop(*[f"{p}_{n}" for n in SCORED for p in ("min", "max", "med", "scale")])
    return spooled(t, "scored")


def cutoffs(s: DataFrame) -> dict[str, R.Cutoffs]:
    return R.calibrate(R.reference_scores(s, MODELS, F.col("period") == "validation"), MODELS, R.BANDS)


def banded(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return R.scored_windows(s, MODELS, cutoffs(s))


def category() -> Column:
    return PE.annotation_category(F.col("window_start"), F.col("window_end"), NOTES, BUFFER, ntz=True)


# ---------------------------------------------------------------- SQL of the same steps
_FLOWS = """e AS (
  SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events
), flows AS (
  SELECT ts AS flow_start, CASE WHEN event_type = 'error' AND k >= 90 THEN ts - INTERVAL 5 SECOND ELSE ts + k * INTERVAL 1 SECOND END AS flow_end,
    '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS src_ip,
    CASE WHEN k < 60 THEN '10.1.0.' || k WHEN k < 90 THEN '203.0.113.' || k ELSE 'host-' || k END AS dst_ip,
    CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443 WHEN 'signup' THEN 53 END AS BIGINT) AS dst_port,
    CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS BIGINT) AS protocol,
    CAST(CASE WHEN cents >= 500 THEN cents - 500 END AS DOUBLE) AS bytes, CAST(CASE WHEN k > 0 THEN k END AS DOUBLE) AS packets, event_id AS source_row_index
  FROM e
), rows_ AS (
  SELECT *, CASE WHEN flow_end >= flow_start THEN epoch_us(flow_end) / 1e6 - epoch_us(flow_start) / 1e6 END AS duration_s,
    CASE WHEN regexp_matches(dst_ip, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$') THEN regexp_matches(dst_ip, '^(10[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.])') END AS dst_is_private
  FROM flows WHERE flow_start IS NOT NULL AND src_ip IS NOT NULL AND src_ip <> ''
)"""


def _hosts_sql(minutes: int = MINUTES) -> str:
    return f"""hw AS (
  SELECT src_ip, w AS window_start, w + INTERVAL {minutes} MINUTE AS window_end, CAST(w AS DATE) AS flow_date, min(flow_start) AS first_flow_start, max(flow_start) AS last_flow_start,
    count(*) AS flows, sum(bytes) AS bytes_total, sum(packets) AS packets_total, max(bytes) AS max_flow_bytes, sum(bytes) / nullif(sum(packets), 0) AS bytes_per_packet,
    count(DISTINCT dst_ip) AS uniq_dst_ip, count(DISTINCT dst_port) AS uniq_dst_port, avg(CAST(dst_is_private AS INT)) AS internal_share,
    avg(CAST(protocol = 6 AS INT)) AS tcp_share, avg(CAST(protocol = 17 AS INT)) AS udp_share, avg(CAST(protocol = 1 AS INT)) AS icmp_share, avg(duration_s) AS mean_duration_s
  FROM (SELECT *, time_bucket(INTERVAL {minutes} MINUTE, flow_start, TIMESTAMP '2000-01-01') AS w FROM rows_) GROUP BY src_ip, w
)"""


_TRAIN = "window_start >= TIMESTAMP '2024-01-01' AND window_start < TIMESTAMP '2024-01-16'"
_PERIOD = f"CASE WHEN {_TRAIN} THEN 'train' WHEN window_start >= TIMESTAMP '2024-01-16' AND window_start < TIMESTAMP '2024-01-23' THEN 'validation' WHEN window_start >= TIMESTAMP '2024-01-23' AND window_start < TIMESTAMP '2024-01-31' THEN 'test' ELSE 'unassigned' END"


def _t(n: str) -> str:
    return f"ln(1 + greatest(CAST({n} AS DOUBLE), 0))" if n in FT.PAIR_FEATURES or FT.BY_NAME[n].log1p else f"CAST({n} AS DOUBLE)"


def _guard(n: str) -> str:
    return f"CASE WHEN {n} IS NOT NULL THEN {_t(n)} END"


_STATS = "stats AS (SELECT " + ", ".join(
    f"min(CAST({n} AS DOUBLE)) AS min_{n}, max(CAST({n} AS DOUBLE)) AS max_{n}, quantile_cont({_guard(n)}, 0.5) AS med_{n}, "
    f"CASE WHEN quantile_cont({_guard(n)}, 0.75) - quantile_cont({_guard(n)}, 0.25) > 0 THEN (quantile_cont({_guard(n)}, 0.75) - quantile_cont({_guard(n)}, 0.25)) / 1.349 WHEN stddev_pop({_guard(n)}) > 0 THEN stddev_pop({_guard(n)}) END AS scale_{n}"
    for n in SCORED
) + f" FROM hw WHERE {_TRAIN})"
_Z = {n: f"({_guard(n)} - med_{n}) / scale_{n}" for n in SCORED}
_SCORED = f"scored AS (SELECT hw.*, {_PERIOD} AS period, round(greatest({', '.join(f'abs({z})' for z in _Z.values())}), 6) AS a_raw, round(({' + '.join(f'coalesce(abs({z}), 0)' for z in _Z.values())}) / {len(SCORED)}, 6) AS b_raw FROM hw, stats)"
_REF = "".join(f""", ref_{m} AS (SELECT {m}_raw AS s, row_number() OVER (ORDER BY {m}_raw) - 1 AS i, count(*) OVER () AS n, cume_dist() OVER (ORDER BY {m}_raw) AS share FROM scored WHERE period = 'validation' AND {m}_raw IS NOT NULL)
, cut_{m} AS (SELECT {', '.join(f"max(s) FILTER (WHERE i = CAST(ceil(round({q} * (n - 1), 9)) AS BIGINT)) AS {b.lower()}" for b, q in R.BANDS.items())} FROM ref_{m})
, places_{m} AS (SELECT DISTINCT (g * (n - 1)) // 100000 AS i FROM (SELECT unnest(range(0, 99000, 100)) AS g UNION ALL SELECT unnest(range(99000, 100001)) AS g), (SELECT max(n) AS n FROM ref_{m}))
, grid_{m} AS (SELECT DISTINCT s AS score, share FROM ref_{m} JOIN places_{m} USING (i))""" for m in MODELS)


def _band_sql(m: str) -> str:
    return f"CASE WHEN {m}_raw >= cut_{m}.critical THEN 'Critical' WHEN {m}_raw >= cut_{m}.high THEN 'High' WHEN {m}_raw >= cut_{m}.medium THEN 'Medium' WHEN {m}_raw >= cut_{m}.low THEN 'Low' ELSE 'Below thresholds' END"


_BANDED = f"""banded AS (SELECT x.*, coalesce(ga.share, 0) AS a_pct, {_band_sql('a')} AS a_band, coalesce(gb.share, 0) AS b_pct, {_band_sql('b')} AS b_band
  FROM scored x ASOF LEFT JOIN grid_a ga ON x.a_raw >= ga.score ASOF LEFT JOIN grid_b gb ON x.b_raw >= gb.score, cut_a, cut_b)"""
_BASE = f"WITH {_FLOWS}, {_hosts_sql()}"
_SC = f"{_BASE}, {_STATS}, {_SCORED}"
_BD = f"{_SC}{_REF}, {_BANDED}"
_OVER = lambda pad: " OR ".join(f"(window_start < TIMESTAMP '{a.end}' + INTERVAL {pad} HOUR AND window_end > TIMESTAMP '{a.start}' - INTERVAL {pad} HOUR)" for a in NOTES)
_CAT = f"CASE WHEN {_OVER(0)} THEN 'inside' WHEN {_OVER(6)} THEN 'buffer' ELSE 'outside' END"
_DAY_CAT = _CAT.replace("window_start", "CAST(flow_date AS TIMESTAMP)").replace("window_end", "(CAST(flow_date AS TIMESTAMP) + INTERVAL 1 DAY)")
_REVIEW = "(a_band IN ('Critical', 'High') OR b_band IN ('Critical', 'High'))"
_FEATURE_COLS = [f.name for f in FT.FEATURES]


# ---------------------------------------------------------------- sources and features
@query("flow_projection", f"WITH {_FLOWS} SELECT flow_start, flow_end, src_ip, dst_ip, dst_port, protocol, bytes, packets, round(duration_s, 6) AS duration_s, dst_is_private, source_row_index FROM rows_")
def flow_projection(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.usable(FT.with_derived(event_flows(spark, d))).drop("source_file"))


@query("flow_mapping", f"""WITH {_FLOWS} SELECT epoch_us(flow_start) AS start_us, 'ok' AS flow_start_status, epoch_us(flow_end) AS end_us, 'no_offset' AS flow_end_status, src_ip, dst_ip, dst_port, protocol, bytes, packets,
  round(duration_s, 6) AS duration_s, dst_is_private, source_row_index FROM rows_""")
def flow_mapping(spark: SparkSession, d: str) -> DataFrame:
    """The table as a raw export, with text times, padded addresses, narrow integers and negative sizes, through the explicit mapping."""
    raw = event_export(spark, d)
    own = [f for f in raw.schema if not f.name.startswith("source_")]
    report = build_mapping(StructType(own), {f.name: 1 for f in own}, 1)
    rows = FT.usable(canonical_flows(raw, report))
    return rounded(rows.select(F.unix_micros("flow_start").alias("start_us"), "flow_start_status", F.unix_micros("flow_end").alias("end_us"), "flow_end_status", "src_ip", "dst_ip", "dst_port", "protocol", "bytes", "packets", "duration_s", "dst_is_private", "source_row_index"))


_TEXTS = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.123456+05:30", "2024-01-02 03:04", "2024-02-30 00:00:00", "2024-01-02", "x", "2024-01-02 03:04:05 UTC", "2024-01-02 03:04:05-0330", "2024-01-02 03:04:05+15:00", None]
_WANT = [("2024-01-02 03:04:05", "no_offset"), ("2024-01-02 03:04:05", "ok"), ("2024-01-01 21:34:05.123456", "ok"), ("2024-01-02 03:04:00", "no_offset"), (None, "invalid"), (None, "invalid"), (None, "invalid"), ("2024-01-02 03:04:05", "ok"), ("2024-01-02 06:34:05", "ok"), (None, "invalid"), (None, None)]
_lit = lambda v: "NULL" if v is None else f"'{v}'"


@query("timestamp_parse_status", "SELECT r_regionkey, raw, CASE WHEN v IS NULL THEN NULL ELSE epoch_us(CAST(v AS TIMESTAMP)) END AS micros, status FROM region, (VALUES " + ", ".join(f"({_lit(t)}, {_lit(v)}, {_lit(s)})" for t, (v, s) in zip(_TEXTS, _WANT, strict=True)) + ") AS x(raw, v, status)")
def timestamp_parse_status(spark: SparkSession, d: str) -> DataFrame:
    texts = F.explode(F.array(*[F.lit(t).cast("string") for t in _TEXTS]))
    rows = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", texts.alias("raw"))
    value, status = text_time(F.col("raw"))
    return rows.select("r_regionkey", "raw", F.unix_micros(value).alias("micros"), status.alias("status"))


@query("input_profile", f"""WITH {_FLOWS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE bytes IS NULL) AS null_bytes, count(*) FILTER (WHERE packets IS NULL) AS null_packets, count(*) FILTER (WHERE dst_port IS NULL) AS null_ports,
  count(*) FILTER (WHERE flow_end < flow_start) AS ends_before_start, count(*) FILTER (WHERE dst_is_private IS NULL) AS dst_not_ipv4, min(flow_start) AS first_start, max(flow_start) AS last_start, count(DISTINCT src_ip) AS n_src, count(DISTINCT dst_ip) AS n_dst,
  count(DISTINCT dst_port) AS n_ports, count(DISTINCT (src_ip, time_bucket(INTERVAL {MINUTES} MINUTE, flow_start, TIMESTAMP '2000-01-01'))) AS n_host_windows, 0 AS invalid_starts, 0 AS starts_without_offset FROM rows_""")
def input_profile(spark: SparkSession, d: str) -> DataFrame:
    from .sources.profile import profile_flows

    return profile_flows(event_flows(spark, d), exact=True, minutes=MINUTES)


@query("daily_profile", f"WITH {_FLOWS} SELECT CAST(flow_start AS DATE) AS flow_date, count(*) AS flows, count(DISTINCT src_ip) AS hosts FROM rows_ GROUP BY 1")
def daily_profile(spark: SparkSession, d: str) -> DataFrame:
    from .sources.profile import profile_days

    return profile_days(event_flows(spark, d), exact=True)


def _features_sql(minutes: int) -> str:
    cols = ", ".join(n if n in ("flows", "uniq_dst_ip", "uniq_dst_port") else f"round({n}, 6) AS {n}" for n in _FEATURE_COLS)
    return f"WITH {_FLOWS}, {_hosts_sql(minutes)} SELECT src_ip, window_start, window_end, flow_date, first_flow_start, last_flow_start, {cols} FROM hw"


@query("host_window_features", _features_sql(60))
def host_window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hosts(spark, d, 60))


@query("host_window_features_daily", _features_sql(1440))
def host_window_features_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hosts(spark, d, 1440))


@query("feature_quality", _BASE + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) AS n_rows, count({n}) AS non_null, count({n}) FILTER (WHERE {_TRAIN}) AS train_finite, round(stddev_pop(CAST({n} AS DOUBLE)) FILTER (WHERE {_TRAIN}), 6) AS train_std, CASE WHEN count({n}) FILTER (WHERE {_TRAIN}) = 0 THEN 'all_null' WHEN stddev_pop(CAST({n} AS DOUBLE)) FILTER (WHERE {_TRAIN}) = 0 THEN 'constant' ELSE 'ok' END AS status FROM hw"
    for n in _FEATURE_COLS))
def feature_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.feature_quality(hosts(spark, d), _FEATURE_COLS, is_train()).withColumnRenamed("rows", "n_rows"))


@query("period_labels", f"{_BASE} SELECT src_ip, window_start, {_PERIOD} AS period FROM hw")
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    return hosts(spark, d).select("src_ip", "window_start", label(F.col("window_start")).alias("period"))


@query("annotation_categories", f"{_BASE} SELECT src_ip, window_start, {_CAT} AS category, nullif(concat_ws(',', " + ", ".join(
    f"CASE WHEN window_start < TIMESTAMP '{a.end}' + INTERVAL 6 HOUR AND window_end > TIMESTAMP '{a.start}' - INTERVAL 6 HOUR THEN '{a.name}' END" for a in NOTES) + "), '') AS names FROM hw")
def annotation_categories(spark: SparkSession, d: str) -> DataFrame:
    names = PE.annotation_names(F.col("window_start"), F.col("window_end"), NOTES, BUFFER, ntz=True)
    return hosts(spark, d).select("src_ip", "window_start", category().alias("category"), names.alias("names"))


@query("training_sample_md5", f"""{_BASE}, h AS (SELECT src_ip, window_start, flow_date, md5(src_ip || strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS h FROM hw WHERE {_TRAIN}),
  r AS (SELECT *, row_number() OVER (PARTITION BY flow_date ORDER BY h, src_ip, window_start) AS r FROM h) SELECT src_ip, window_start FROM r WHERE r <= 20 ORDER BY h, src_ip, window_start LIMIT 300""")
def training_sample_md5(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.concat("src_ip", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).cast("binary"))
    return FT.training_sample(hosts(spark, d), is_train(), 300, 15, 0, key).select("src_ip", "window_start")


@query("train_stats_robust", f"{_BASE}, {_STATS} SELECT " + ", ".join(f"round({p}_{n}, 6) AS {p}_{n}" for n in SCORED for p in ("min", "max", "med", "scale")) + " FROM stats")
def train_stats_robust(spark: SparkSession, d: str) -> DataFrame:
    return rounded(FT.training_stats(hosts(spark, d), SCORED, is_train()))


@query("train_host_context", f"{_BASE} SELECT src_ip, count(*) AS train_windows, " + ", ".join(f"median(CAST({n} AS DOUBLE)) AS train_median_{n}" for n in ("flows", "bytes_total", "uniq_dst_ip", "uniq_dst_port")) + f" FROM hw WHERE {_TRAIN} GROUP BY src_ip")
def train_host_context(spark: SparkSession, d: str) -> DataFrame:
    return FT.host_context(hosts(spark, d), is_train())


# ---------------------------------------------------------------- ranking
@query("robust_z_scores", f"{_SC} SELECT src_ip, window_start, period, a_raw, b_raw FROM scored")
def robust_z_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("src_ip", "window_start", "period", "a_raw", "b_raw")


@query("band_cutoffs", f"{_SC}{_REF} " + " UNION ALL ".join(f"SELECT '{m}' AS model, '{b}' AS band, {b.lower()} AS cutoff FROM cut_{m}" for m in MODELS for b in R.BANDS))
def band_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    rows = [(m, b, v) for m, c in cutoffs(scored(spark, d)).items() for b, v in c.thresholds.items()]
    return spark.createDataFrame(rows, "model string, band string, cutoff double")


_BUDGET = {"Critical": 1.0, "High": 5.0}


@query("band_budget", f"{_SC}, n AS (SELECT count(*) AS w, count(DISTINCT flow_date) AS dd FROM scored WHERE period = 'validation'), ref AS (SELECT a_raw AS s, row_number() OVER (ORDER BY a_raw) - 1 AS i, count(*) OVER () AS c FROM scored WHERE period = 'validation' AND a_raw IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{b}' AS band, round(1 - {v} / (w / dd), 9) AS quantile, max(s) FILTER (WHERE i = CAST(ceil(round((1 - {v} / (w / dd)) * (c - 1), 9)) AS BIGINT)) AS cutoff FROM ref, n GROUP BY w, dd" for b, v in _BUDGET.items()))
def band_budget(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    row = s.where(F.col("period") == "validation").agg((F.count("*") / F.countDistinct("flow_date")).alias("w")).first()
    q = R.band_quantiles(budgets=_BUDGET, windows_per_day=row["w"])
    c = R.calibrate(R.reference_scores(s, ["a"], F.col("period") == "validation"), ["a"], q)["a"]
    return spark.createDataFrame([(b, round(q[b], 9), c.thresholds[b]) for b in _BUDGET], "band string, quantile double, cutoff double")


@query("percentile_asof", f"{_BD} SELECT src_ip, window_start, a_raw, round(a_pct, 9) AS a_pct FROM banded")
def percentile_asof(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    c = cutoffs(s)["a"]
    grid = spark.createDataFrame(list(zip(c.grid, c.shares, strict=True)), "score double, share double")
    return rounded(R.percentile_asof(s.select("src_ip", "window_start", "a_raw"), "a_raw", grid), 9)


@query("scored_windows", f"{_BD} SELECT src_ip, window_start, period, a_raw, round(a_pct, 9) AS a_pct, a_band, b_raw, round(b_pct, 9) AS b_pct, b_band, concat_ws(',', " + ", ".join(f"CASE WHEN {n} < min_{n} OR {n} > max_{n} THEN '{n}' END" for n in SCORED) + ") AS beyond FROM banded, stats")
def scored_windows(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    rows = FT.with_stats(b, FT.training_stats(b, SCORED, is_train()))
    return rounded(rows.select("src_ip", "window_start", "period", "a_raw", "a_pct", "a_band", "b_raw", "b_pct", "b_band", F.array_join(FT.beyond_range(SCORED), ",").alias("beyond")), 9)


_BEST = "CASE " + " ".join(f"WHEN a_band = '{b}' OR b_band = '{b}' THEN '{b}'" for b in R.BANDS) + " END"
_ALERTS = f"""alerts AS (SELECT src_ip, window_start, window_end, {_BEST} AS review_band, concat_ws(',', CASE WHEN a_band IN ('Critical', 'High') THEN 'a' END, CASE WHEN b_band IN ('Critical', 'High') THEN 'b' END) AS models,
  round(greatest(a_pct, b_pct), 9) AS max_pct, row_number() OVER (ORDER BY greatest(a_pct, b_pct) DESC, a_pct + b_pct DESC, src_ip, window_start) AS alert_rank FROM banded WHERE {_REVIEW})"""


@query("ranked_alerts", f"{_BD}, {_ALERTS} SELECT src_ip, window_start, review_band, models, max_pct, CAST(alert_rank AS INTEGER) AS alert_rank FROM alerts")
def ranked_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = R.ranked_alerts(banded(spark, d), MODELS)
    return rounded(rows.select("src_ip", "window_start", "review_band", F.array_join("models_in_review", ",").alias("models"), "max_pct", "alert_rank"), 9)


_DEV = "unnest([" + ", ".join(f"{{'a': round(abs({z}), 6), 'f': '{n}', 'v': CAST({n} AS DOUBLE), 'z': round({z}, 6)}}" for n, z in _Z.items()) + "])"


@query("alert_deviations", f"""{_BD}, {_ALERTS}, dev AS (SELECT src_ip, window_start, {_DEV} AS d FROM hw JOIN alerts USING (src_ip, window_start), stats),
  top AS (SELECT src_ip, window_start, d.f AS f, d.v AS v, d.z AS z, row_number() OVER (PARTITION BY src_ip, window_start ORDER BY d.a DESC, d.f DESC) AS r FROM dev WHERE d.a IS NOT NULL)
  SELECT src_ip, window_start, CAST(r AS INTEGER) AS place, f AS feature, round(v, 6) AS value, round(z, 4) AS z FROM top WHERE r <= 3""")
def alert_deviations(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    rows = FT.with_stats(R.ranked_alerts(b, MODELS), FT.training_stats(b, SCORED, is_train()))
    out = rows.select("src_ip", "window_start", F.posexplode(FT.largest_deviations(SCORED)).alias("p", "c"))
    return out.select("src_ip", "window_start", (F.col("p") + 1).alias("place"), F.col("c.f").alias("feature"), F.round("c.v", 6).alias("value"), F.round("c.z", 4).alias("z"))


@query("alert_traces", f"""{_BD}, {_ALERTS}, t AS (SELECT a.src_ip, a.window_start, a.alert_rank, r.source_row_index, row_number() OVER (PARTITION BY a.src_ip, a.window_start ORDER BY r.flow_start, r.source_row_index) AS k
  FROM alerts a JOIN rows_ r ON r.src_ip = a.src_ip AND r.flow_start >= a.window_start AND r.flow_start < a.window_end WHERE a.alert_rank <= 20)
  SELECT src_ip, window_start, CAST(alert_rank AS INTEGER) AS alert_rank, count(*) AS trace_flow_count, string_agg(CAST(source_row_index AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) AS row_numbers FROM t GROUP BY ALL""")
def alert_traces(spark: SparkSession, d: str) -> DataFrame:
    alerts = R.ranked_alerts(banded(spark, d), MODELS)
    flows = FT.bucketed(event_flows(spark, d), MINUTES).select("src_ip", "window_start", "flow_start", "source_file", "source_row_index")
    t = R.alert_traces(alerts, flows, 20, 5)
    return t.select("src_ip", "window_start", "alert_rank", "trace_flow_count", F.array_join(F.transform("trace_rows", lambda x: x["row_index"].cast("string")), ",").alias("row_numbers"))


@query("alert_context", f"""{_BD}, {_ALERTS}, ctx AS (SELECT src_ip, count(*) AS tw, median(CAST(flows AS DOUBLE)) AS tf FROM hw WHERE {_TRAIN} GROUP BY src_ip)
  SELECT a.src_ip, a.window_start, tw IS NOT NULL AS entity_seen_in_train, tw AS entity_train_windows, tf AS train_median_flows FROM alerts a LEFT JOIN ctx ON ctx.src_ip = a.src_ip""")
def alert_context(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    rows = R.alert_context(R.ranked_alerts(b, MODELS), FT.training_stats(b, SCORED, is_train()), FT.host_context(b, is_train()), SCORED)
    return rows.select("src_ip", "window_start", "entity_seen_in_train", "entity_train_windows", "train_median_flows")


def _daily_counts(m: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {m}_band = '{b}') AS {m}_{b.lower()}" for b in R.BANDS) + f", count(*) FILTER (WHERE {m}_band = 'Below thresholds') AS {m}_below, max({m}_raw) AS {m}_max_raw, round(max({m}_pct), 9) AS {m}_max_pct"


@query("daily_summary", f"{_BD} SELECT flow_date, max(period) AS period, count(*) AS windows, count(DISTINCT src_ip) AS hosts, CAST(sum(flows) AS BIGINT) AS flows, {_DAY_CAT} AS day_category, {_daily_counts('a')}, {_daily_counts('b')} FROM banded GROUP BY flow_date")
def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.daily_summary(banded(spark, d), MODELS, day_category=PE.day_category(F.col("flow_date"), NOTES, BUFFER, ntz=True)), 9)


@query("entity_summary", f"{_BD}, x AS (SELECT *, {_CAT} AS cat FROM banded) SELECT src_ip, count(*) AS windows, min(window_start) AS first_window, max(window_start) AS last_window, CAST(sum(flows) AS BIGINT) AS flows, count(*) FILTER (WHERE period = 'train') AS train_windows, " + ", ".join(
    f"round(max({m}_pct), 9) AS {m}_max_pct, count(*) FILTER (WHERE {m}_band IN ('Critical', 'High')) AS {m}_review, arg_max(window_start, ({m}_raw, -epoch(window_start))) AS {m}_top_window, count(*) FILTER (WHERE {m}_band IN ('Critical', 'High') AND cat = 'inside') AS {m}_review_inside" for m in MODELS) + " FROM x GROUP BY src_ip")
def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.entity_summary(banded(spark, d).withColumn("annotation_category", category()), MODELS), 9)


# ---------------------------------------------------------------- diagnostics
@query("score_distribution", f"{_SC} " + " UNION ALL ".join(f"SELECT period, '{m}' AS model, count({m}_raw) AS n, min({m}_raw) AS min, round(quantile_cont({m}_raw, 0.5), 6) AS q50, round(quantile_cont({m}_raw, 0.9), 6) AS q90, round(quantile_cont({m}_raw, 0.99), 6) AS q99, round(quantile_cont({m}_raw, 0.999), 6) AS q999, max({m}_raw) AS max FROM scored GROUP BY period" for m in MODELS))
def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.score_distribution(scored(spark, d), MODELS))


@query("band_volume", f"{_BD}, dd AS (SELECT period, count(DISTINCT flow_date) AS days FROM banded GROUP BY period) SELECT period, a_band AS band, count(*) AS windows, round(count(*) / max(days), 6) AS per_day FROM banded JOIN dd USING (period) GROUP BY period, a_band")
def band_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.band_volume(banded(spark, d), "a"))


_CURVE = {0.9: 1.0, 0.99: 2.0, 0.999: 4.0}


@query("cutoff_curve", f"{_SC} " + " UNION ALL ".join(f"SELECT period, CAST({q} AS DOUBLE) AS quantile, count(*) FILTER (WHERE a_raw >= {t}) AS windows, round(count(*) FILTER (WHERE a_raw >= {t}) / count(DISTINCT flow_date), 6) AS per_day FROM scored GROUP BY period" for q, t in _CURVE.items()))
def cutoff_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.cutoff_curve(scored(spark, d), "a", _CURVE))


@query("score_histogram", f"{_SC} SELECT period, CAST(least(floor((a_raw - 0.0) / (12.0 / 60)), 59) AS INTEGER) AS bin, count(*) AS windows FROM scored WHERE a_raw IS NOT NULL GROUP BY 1, 2")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.score_histogram(scored(spark, d), "a_raw", 0.0, 12.0)


_TOPK = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_date ORDER BY a_raw DESC NULLS LAST, src_ip, window_start) AS day_rank FROM {src}) WHERE day_rank <= 10)"


@query("topk_per_day", f"{_SC}, {_TOPK.format(src='scored')} SELECT src_ip, window_start, flow_date, a_raw, CAST(day_rank AS INTEGER) AS day_rank FROM top")
def topk_per_day(spark: SparkSession, d: str) -> DataFrame:
    return D.top_per_day(scored(spark, d), "a", 10).select("src_ip", "window_start", "flow_date", "a_raw", "day_rank")


@query("topk_concentration", f"""{_SC}, {_TOPK.format(src='scored')}, per AS (SELECT period, src_ip, count(*) AS n FROM top GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, src_ip) AS r FROM per)
  SELECT period, CAST(sum(n) AS BIGINT) AS total, count(*) AS hosts, round(coalesce(sum(n) FILTER (WHERE r <= 5), 0) / sum(n), 6) AS top_share, min(src_ip) FILTER (WHERE r = 1) AS most_frequent_host, max(n) AS most_frequent_count FROM rk GROUP BY period""")
def topk_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.concentration(scored(spark, d), "a", 10))


@query("annotation_overlap", f"""{_BD}, x AS (SELECT *, {_CAT} AS cat FROM banded), {_TOPK.format(src='x')}, b AS (SELECT period, cat, count(*) AS base, count(*) FILTER (WHERE a_band IN ('Critical', 'High')) AS review FROM x GROUP BY ALL),
  t AS (SELECT period, cat, count(*) AS top FROM top GROUP BY ALL), j AS (SELECT b.*, coalesce(top, 0) AS top FROM b LEFT JOIN t USING (period, cat)), s AS (SELECT *, base / sum(base) OVER w AS bs, review / nullif(sum(review) OVER w, 0) AS rs, top / nullif(sum(top) OVER w, 0) AS ts FROM j WINDOW w AS (PARTITION BY period))
  SELECT period, cat, base, review, top, round(bs, 6) AS base_share, round(rs, 6) AS review_share, round(ts, 6) AS top_share, round(rs / bs, 6) AS review_ratio, round(ts / bs, 6) AS top_ratio FROM s""")
def annotation_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.annotation_overlap(banded(spark, d), "a", category(), R.REVIEW, 10))


_BUFFERS = (0, 6, 24)


@query("annotation_buffers", f"""{_BD}, {_TOPK.format(src='banded')}, """ + ", ".join(f"""x{h} AS (SELECT {h}.0::DOUBLE AS buffer_hours, period, count(*) FILTER (WHERE {_OVER(h)}) / count(*) AS b, count(*) FILTER (WHERE ({_OVER(h)}) AND a_band IN ('Critical', 'High')) / nullif(count(*) FILTER (WHERE a_band IN ('Critical', 'High')), 0) AS r FROM banded GROUP BY period),
  y{h} AS (SELECT period, count(*) FILTER (WHERE {_OVER(h)}) / count(*) AS t FROM top GROUP BY period)""" for h in _BUFFERS) + " " + " UNION ALL ".join(f"SELECT buffer_hours, period, round(b, 6) AS base_share, round(r, 6) AS review_share, round(t, 6) AS top_share, round(r / nullif(b, 0), 6) AS review_ratio, round(t / nullif(b, 0), 6) AS top_ratio FROM x{h} LEFT JOIN y{h} USING (period)" for h in _BUFFERS))
def annotation_buffers(spark: SparkSession, d: str) -> DataFrame:
    near = {h: PE.annotation_category(F.col("window_start"), F.col("window_end"), NOTES, h, ntz=True) != "outside" for h in _BUFFERS}
    return rounded(D.buffer_sensitivity(banded(spark, d), "a", near, R.REVIEW, 10))


@query("beyond_range", f"""{_BD} SELECT count(*) AS windows_beyond, count(*) FILTER (WHERE NOT {_REVIEW}) AS not_in_review FROM banded, stats WHERE period <> 'train' AND ({' OR '.join(f'CAST({n} AS DOUBLE) < min_{n} OR CAST({n} AS DOUBLE) > max_{n}' for n in SCORED)})""")
def beyond_range(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    rows = FT.with_stats(b, FT.training_stats(b, SCORED, is_train())).withColumn("beyond_train_range", FT.beyond_range(SCORED))
    return R.beyond_range_counts(rows, MODELS)


_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY a_raw) AS ra, rank() OVER (PARTITION BY period ORDER BY b_raw) AS rb, row_number() OVER (PARTITION BY period ORDER BY a_raw DESC, src_ip, window_start) AS na, row_number() OVER (PARTITION BY period ORDER BY b_raw DESC, src_ip, window_start) AS nb,
  row_number() OVER (PARTITION BY period, flow_date ORDER BY a_raw DESC, src_ip, window_start) AS da, row_number() OVER (PARTITION BY period, flow_date ORDER BY b_raw DESC, src_ip, window_start) AS db FROM {src})"""


@query("model_agreement", f"""{_BD}, {_RANKS.format(src='banded')}, dd AS (SELECT period, avg(o) AS daily_overlap FROM (SELECT period, flow_date, count(*) FILTER (WHERE da <= 10 AND db <= 10) / count(*) FILTER (WHERE da <= 10) AS o FROM r GROUP BY ALL) GROUP BY period)
  SELECT period, round(corr(ra, rb), 6) AS spearman, round(count(*) FILTER (WHERE na <= 100 AND nb <= 100) / count(*) FILTER (WHERE na <= 100 OR nb <= 100), 6) AS top_jaccard, count(*) FILTER (WHERE a_band IN ('Critical', 'High') AND b_band IN ('Critical', 'High')) AS both_review,
  count(*) FILTER (WHERE a_band IN ('Critical', 'High') AND b_band NOT IN ('Critical', 'High')) AS only_a, count(*) FILTER (WHERE b_band IN ('Critical', 'High') AND a_band NOT IN ('Critical', 'High')) AS only_b, round(max(daily_overlap), 6) AS daily_overlap FROM r JOIN dd USING (period) GROUP BY period""")
def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.model_agreement(banded(spark, d), "a", "b", 100, 10, R.REVIEW))


@query("rank_agreement", f"""{_SC}, r AS (SELECT rank() OVER (ORDER BY a_raw) AS rx, rank() OVER (ORDER BY b_raw) AS ry, row_number() OVER (ORDER BY a_raw DESC, src_ip, window_start) AS nx, row_number() OVER (ORDER BY b_raw DESC, src_ip, window_start) AS ny FROM scored WHERE period = 'validation')
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(count(*) FILTER (WHERE nx <= 100 AND ny <= 100) / count(*) FILTER (WHERE nx <= 100 OR ny <= 100), 6) AS top_jaccard FROM r""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = scored(spark, d).where(F.col("period") == "validation")
    return rounded(D.rank_agreement(v, "a_raw", v, "b_raw", 100))


@query("disagreements", f"""{_SC}, r AS (SELECT src_ip, window_start, a_raw, b_raw, row_number() OVER (ORDER BY a_raw DESC, src_ip, window_start) AS rank_a, row_number() OVER (ORDER BY b_raw DESC, src_ip, window_start) AS rank_b FROM scored WHERE period = 'validation')
  SELECT src_ip, window_start, a_raw, b_raw, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b FROM r WHERE (rank_a <= 25) <> (rank_b <= 25) ORDER BY least(rank_a, rank_b), src_ip, window_start LIMIT 50""")
def disagreements(spark: SparkSession, d: str) -> DataFrame:
    return D.disagreements(scored(spark, d), "a", "b", "validation", 25)


@query("top_categories", f"{_SC}, t AS (SELECT {_CAT} AS cat FROM scored ORDER BY a_raw DESC NULLS LAST, src_ip, window_start LIMIT 100) SELECT cat, count(*) AS windows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY cat")
def top_categories(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.top_categories(scored(spark, d), "a_raw", 100, category()))


@query("training_concentration", f"""{_SC}, cut AS (SELECT quantile_disc(a_raw, 0.99) AS c FROM scored WHERE period = 'train'), t AS (SELECT src_ip, count(*) AS windows FROM scored, cut WHERE period = 'train' AND a_raw >= c GROUP BY src_ip)
  SELECT src_ip, windows, round(windows / sum(windows) OVER (), 6) AS share FROM t ORDER BY windows DESC, src_ip LIMIT 10""")
def training_concentration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.training_concentration(scored(spark, d), "a_raw", 0.99, 10))


_EDGES = {"flows": [1.0, 2.0, 3.0], "bytes_total": [5000.0, 20000.0, 60000.0], "mean_duration_s": [20.0, 50.0, 80.0]}
_BINS = ", ".join("{'f': '%s', 'b': CASE WHEN %s IS NULL THEN -1 %s ELSE %d END}" % (n, n, " ".join(f"WHEN {n} <= {x} THEN {i}" for i, x in enumerate(e)), len(e)) for n, e in _EDGES.items())


@query("feature_drift_psi", f"""{_BASE}, x AS (SELECT CAST(date_trunc('week', flow_date) AS DATE) AS bucket, ({_TRAIN}) AS tr, unnest([{_BINS}]) AS c FROM hw), now_ AS (SELECT c.f AS feature, bucket, c.b AS bin, count(*) AS n, count(*) FILTER (WHERE tr) AS t FROM x GROUP BY ALL),
  base AS (SELECT feature, bin, greatest(sum(t) / sum(sum(t)) OVER (PARTITION BY feature), 1e-4) AS expected FROM now_ GROUP BY feature, bin), act AS (SELECT feature, bucket, bin, n / sum(n) OVER (PARTITION BY feature, bucket) AS share FROM now_),
  g AS (SELECT b.feature, w.bucket, b.expected, greatest(coalesce(a.share, 0), 1e-4) AS actual FROM base b JOIN (SELECT DISTINCT feature, bucket FROM now_) w USING (feature) LEFT JOIN act a ON a.feature = b.feature AND a.bucket = w.bucket AND a.bin = b.bin)
  SELECT feature, bucket, round(sum((actual - expected) * ln(actual / expected)), 6) AS psi FROM g GROUP BY feature, bucket""")
def feature_drift_psi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.feature_drift(hosts(spark, d), _EDGES, is_train(), F.date_trunc("week", "flow_date").cast("date")))


# ---------------------------------------------------------------- charts
@query("bands_by_bucket", f"{_BD} SELECT flow_date AS bucket, a_band AS band, count(*) AS windows FROM banded GROUP BY ALL")
def bands_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return C.bands_by_bucket(banded(spark, d), "a", C.bucket(30))


@query("review_by_bucket", f"{_BD} SELECT CAST(date_trunc('week', flow_date) AS DATE) AS bucket, count(*) AS windows, count(*) FILTER (WHERE {_REVIEW}) AS review FROM banded GROUP BY 1")
def review_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return C.review_by_bucket(banded(spark, d), R.in_review(MODELS), C.bucket(C.MOST_DAYS + 1))


@query("host_heatmap", f"""{_BD}, best AS (SELECT src_ip FROM banded GROUP BY src_ip ORDER BY count(*) FILTER (WHERE {_REVIEW}) DESC, src_ip LIMIT 30)
  SELECT src_ip, flow_date AS bucket, round(max(greatest(a_pct, b_pct)), 9) AS max_pct FROM banded WHERE src_ip IN (SELECT src_ip FROM best) GROUP BY ALL""")
def host_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.host_heatmap(banded(spark, d), MODELS, R.in_review(MODELS), C.bucket(30), 30), 9)


_RARE = lambda m: f"-log10(greatest(1 - {m}_pct, 1.0 / 1001))"


@query("score_rarity", f"{_BD} SELECT src_ip, window_start, round({_RARE('a')}, 6) AS a_rarity, round({_RARE('b')}, 6) AS b_rarity FROM banded")
def score_rarity(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.round(C.rarity(F.col(f"{m}_pct"), 1000), 6).alias(f"{m}_rarity") for m in MODELS]
    return banded(spark, d).select("src_ip", "window_start", *cols)


@query("rarity_hexbin")
def rarity_hexbin(spark: SparkSession, d: str) -> DataFrame:
    return C.hexbin(banded(spark, d), "a", "b", 1000)


# ---------------------------------------------------------------- pairs
def _pairs_sql(cols: str = "src_ip, dst_ip", minutes: int = 1440, src: str = "rows_") -> str:
    return f"pw AS (SELECT {cols}, time_bucket(INTERVAL {minutes} MINUTE, flow_start, TIMESTAMP '2000-01-01') AS window_start, count(*) AS flows, sum(bytes) AS bytes, sum(packets) AS packets FROM {src} WHERE dst_ip IS NOT NULL AND dst_ip <> '' GROUP BY ALL)"


def _signals_sql(cols: list[str], support: int = 1, thr: float = 0.5, start: str = "TIMESTAMP '2024-01-01'") -> str:
    part = ", ".join(cols)
    frame = f"OVER (PARTITION BY {part} ORDER BY window_start RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)"
    return f"""sg0 AS (SELECT *, lag(window_start) OVER p AS last_seen_before, min(window_start) OVER p AS first_seen, count(*) {frame} AS baseline_support, median(flows) {frame} AS baseline_flows_median, median(bytes) {frame} AS baseline_bytes_median FROM pw WINDOW p AS (PARTITION BY {part} ORDER BY window_start)),
  sg1 AS (SELECT *, window_start < {start} + INTERVAL 7 DAY AS warmup, CASE WHEN baseline_support >= {support} THEN log2((flows + 1.0) / (baseline_flows_median + 1.0)) END AS log2_change FROM sg0),
  signals AS (SELECT *, window_start + INTERVAL 1 DAY AS window_end, CAST(window_start AS DATE) AS flow_date, datediff('day', last_seen_before, window_start) AS days_since_last_seen,
    CASE WHEN last_seen_before IS NULL THEN CASE WHEN warmup THEN 'warmup' ELSE 'never_seen' END WHEN last_seen_before < window_start - INTERVAL 7 DAY THEN 'recently_unseen' ELSE 'seen_recently' END AS novelty_status,
    CASE WHEN baseline_support < {support} THEN 'insufficient_history' WHEN log2_change >= {thr} THEN 'increase' WHEN log2_change <= -{thr} THEN 'decrease' ELSE 'stable' END AS change_status FROM sg1)"""


_SIGNAL_COLS = "src_ip, dst_ip, window_start, window_end, flow_date, flows, bytes, packets, first_seen, last_seen_before, days_since_last_seen, baseline_support, round(baseline_flows_median, 6) AS baseline_flows_median, round(baseline_bytes_median, 6) AS baseline_bytes_median, round(log2_change, 6) AS log2_change, novelty_status, change_status, warmup"
_PAIRS = f"WITH {_FLOWS}, {_pairs_sql()}"
_SIG = f"{_PAIRS}, {_signals_sql(['src_ip', 'dst_ip'])}"
_HOSTS = """hr AS (SELECT src_ip, window_start, window_end, flow_date, count(*) AS rel_pairs, bool_or(warmup) AS rel_warmup, CASE WHEN NOT bool_or(warmup) THEN count(*) FILTER (WHERE novelty_status = 'never_seen') END AS rel_new_dst, CASE WHEN NOT bool_or(warmup) THEN count(*) FILTER (WHERE novelty_status = 'never_seen') / count(*) END AS rel_new_dst_share,
  count(*) FILTER (WHERE novelty_status = 'recently_unseen') AS rel_recently_unseen_dst, count(*) FILTER (WHERE change_status = 'increase') AS rel_freq_increase, count(*) FILTER (WHERE change_status = 'decrease') AS rel_freq_decrease, max(abs(log2_change)) AS rel_max_abs_log2_change, count(*) FILTER (WHERE change_status = 'insufficient_history') AS rel_pairs_insufficient_history FROM signals GROUP BY ALL)"""


@query("pair_windows", f"{_PAIRS} SELECT * FROM pw")
def pair_windows(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_windows(event_flows(spark, d), REL)


@query("pair_windows_port_proto", f"WITH {_FLOWS}, {_pairs_sql('src_ip, dst_ip, dst_port, protocol')} SELECT * FROM pw")
def pair_windows_port_proto(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_windows(event_flows(spark, d), P.RelParams(window_minutes=1440, group_by_port=True, group_by_protocol=True))


def signals(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_signals(P.pair_windows(event_flows(spark, d), REL), REL, REL_START, ntz=True)


@query("pair_signals", f"{_SIG} SELECT {_SIGNAL_COLS} FROM signals")
def pair_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals(spark, d))


@query("pair_host_summary", f"{_SIG}, {_HOSTS} SELECT * REPLACE (round(rel_new_dst_share, 6) AS rel_new_dst_share, round(rel_max_abs_log2_change, 6) AS rel_max_abs_log2_change) FROM hr")
def pair_host_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.host_relationships(signals(spark, d)))


@query("pair_evidence", f"""{_SIG} SELECT src_ip, dst_ip, window_start, novelty_status, change_status, concat_ws('; ', CASE WHEN novelty_status = 'never_seen' THEN 'pair not seen before' END, CASE WHEN novelty_status = 'recently_unseen' THEN 'last seen ' || strftime(last_seen_before, '%Y-%m-%d') || ', ' || days_since_last_seen || ' days before' END,
  CASE WHEN change_status IN ('increase', 'decrease') THEN 'flows ' || change_status || ' against a median of ' || printf('%.1f', baseline_flows_median) END) AS reason FROM signals WHERE novelty_status IN ('never_seen', 'recently_unseen') OR change_status IN ('increase', 'decrease')""")
def pair_evidence(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_evidence(signals(spark, d)).select("src_ip", "dst_ip", "window_start", "novelty_status", "change_status", "reason")


@query("pair_status_counts", f"{_SIG} SELECT 'novelty' AS signal, novelty_status AS status, count(*) AS n FROM signals GROUP BY 2 UNION ALL SELECT 'change', change_status, count(*) FROM signals GROUP BY 2")
def pair_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.status_counts(signals(spark, d))


@query("pair_top_new", f"{_SIG} SELECT src_ip, dst_ip, window_start, novelty_status, flows, bytes FROM signals WHERE novelty_status IN ('never_seen', 'recently_unseen') ORDER BY flows DESC, coalesce(bytes, 0) DESC, window_start, src_ip, dst_ip LIMIT 25")
def pair_top_new(spark: SparkSession, d: str) -> DataFrame:
    return P.top_new_pairs(P.pair_evidence(signals(spark, d)), REL, 25).select("src_ip", "dst_ip", "window_start", "novelty_status", "flows", "bytes")


@query("pair_top_changes", f"{_SIG} SELECT src_ip, dst_ip, window_start, change_status, flows, round(log2_change, 6) AS log2_change FROM signals WHERE change_status IN ('increase', 'decrease') ORDER BY round(abs(log2_change), 9) DESC, flows DESC, window_start, src_ip, dst_ip LIMIT 25")
def pair_top_changes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.top_changes(P.pair_evidence(signals(spark, d)), REL, 25).select("src_ip", "dst_ip", "window_start", "change_status", "flows", "log2_change"))


@query("pair_top_hosts", f"""{_SIG} SELECT src_ip, count(*) FILTER (WHERE novelty_status = 'never_seen') AS never_seen, count(*) FILTER (WHERE novelty_status = 'recently_unseen') AS recently_unseen, count(*) FILTER (WHERE change_status = 'increase') AS increases,
  count(*) FILTER (WHERE change_status = 'decrease') AS decreases, count(DISTINCT window_start) AS windows FROM signals GROUP BY src_ip ORDER BY never_seen + recently_unseen DESC, increases DESC, src_ip LIMIT 10""")
def pair_top_hosts(spark: SparkSession, d: str) -> DataFrame:
    return P.top_hosts(signals(spark, d))


@query("pair_state", f"{_PAIRS} SELECT src_ip, dst_ip, min(window_start) AS first_seen, max(window_start) AS last_seen, count(*) AS active_windows FROM pw GROUP BY src_ip, dst_ip")
def pair_state(spark: SparkSession, d: str) -> DataFrame:
    """The summary of the first half merged with that of the second."""
    new = P.pair_windows(event_flows(spark, d), REL)
    cut = PERIODS[1].where(F.col("window_start"), ntz=True) | PERIODS[2].where(F.col("window_start"), ntz=True)
    return P.pair_summary(new.where(cut), REL, P.pair_summary(new.where(~cut), REL))


@query("pair_signals_carried", f"{_SIG} SELECT {_SIGNAL_COLS} FROM signals WHERE window_start >= TIMESTAMP '2024-01-16'")
def pair_signals_carried(spark: SparkSession, d: str) -> DataFrame:
    """The second half, from the first half's state: equal to the second half of a single pass."""
    rows = P.pair_windows(event_flows(spark, d), REL)
    first = rows.where(PERIODS[0].where(F.col("window_start"), ntz=True))
    later = rows.where(~PERIODS[0].where(F.col("window_start"), ntz=True))
    return rounded(P.pair_signals(later, REL, REL_START, P.recent_pairs(first, REL, REL_CUT, ntz=True), P.pair_summary(first, REL), ntz=True))


@query("features_with_pair_summary", f"WITH {_FLOWS}, {_hosts_sql(1440)}, {_pairs_sql()}, {_signals_sql(['src_ip', 'dst_ip'])}, {_HOSTS} SELECT hw.src_ip, hw.window_start, hw.flows, rel_pairs, rel_new_dst, rel_recently_unseen_dst, rel_freq_increase, rel_freq_decrease, round(rel_max_abs_log2_change, 6) AS rel_max_abs_log2_change FROM hw LEFT JOIN hr ON hr.src_ip = hw.src_ip AND hr.window_start = hw.window_start")
def features_with_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    t = P.extend_features(hosts(spark, d, 1440), P.host_relationships(signals(spark, d)))
    return rounded(t.select("src_ip", "window_start", "flows", *FT.PAIR_FEATURES))


@query("trimmed_training_rows", f"{_SC}, cut AS (SELECT quantile_disc(a_raw, 0.99) AS c FROM scored WHERE period = 'train') SELECT src_ip, window_start, flows FROM hw WHERE (src_ip, window_start) IN (SELECT (src_ip, window_start) FROM scored, cut WHERE period = 'train' AND a_raw < c)")
def trimmed_training_rows(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where(F.col("period") == "train")
    cut = discrete_quantile(s, "a_raw", 0.99)
    kept = s.crossJoin(F.broadcast(cut)).where(F.col("a_raw") < F.col("cut")).select("src_ip", "window_start")
    return hosts(spark, d).join(kept, ["src_ip", "window_start"], "left_semi").select("src_ip", "window_start", "flows")


@query("pair_trend", f"{_SIG} SELECT CAST(date_trunc('week', window_start) AS DATE) AS week, count(*) AS pair_windows, count(*) FILTER (WHERE novelty_status = 'never_seen') AS never_seen, count(*) FILTER (WHERE novelty_status = 'recently_unseen') AS recently_unseen, count(*) FILTER (WHERE change_status = 'increase') AS increases, count(*) FILTER (WHERE change_status = 'decrease') AS decreases FROM signals GROUP BY 1")
def pair_trend(spark: SparkSession, d: str) -> DataFrame:
    n, c = F.col("novelty_status"), F.col("change_status")
    return signals(spark, d).groupBy(F.date_trunc("week", "window_start").cast("date").alias("week")).agg(
        F.count("*").alias("pair_windows"), F.count_if(n == "never_seen").alias("never_seen"), F.count_if(n == "recently_unseen").alias("recently_unseen"),
        F.count_if(c == "increase").alias("increases"), F.count_if(c == "decrease").alias("decreases"),
    )


@query("lineitem_pair_signals", "WITH rows_ AS (SELECT l_shipdate AS flow_start, CAST(l_suppkey AS VARCHAR) AS src_ip, CAST(l_partkey AS VARCHAR) AS dst_ip, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) AS bytes, l_quantity AS packets FROM lineitem), " + _pairs_sql() + ", " + _signals_sql(["src_ip", "dst_ip"], start="TIMESTAMP '1992-01-01'") + f" SELECT {_SIGNAL_COLS} FROM signals")
def lineitem_pair_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.pair_signals(P.pair_windows(lineitem_flows(spark, d), REL), REL, datetime(1992, 1, 1), ntz=True))


# ---------------------------------------------------------------- models (no SQL)
IFOREST = M.ModelSpec("iforest", settings={"n_estimators": 100})
OCSVM = M.ModelSpec("ocsvm", settings={"nu": 0.05})


def _model(spark: SparkSession, d: str, spec: M.ModelSpec, rows: int) -> tuple[DataFrame, M.FittedModel]:
    t = hosts(spark, d)
    return t, M.fit_model(t, SCORED, is_train(), spec, 15, rows)


@query("iforest_scores")
def iforest_scores(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d, IFOREST, 5000)
    return M.score_table(t, [m]).select("src_ip", "window_start", F.round("iforest_raw", 9).alias("iforest_raw"))


@query("ocsvm_scores")
def ocsvm_scores(spark: SparkSession, d: str) -> DataFrame:
    t, m = _model(spark, d, OCSVM, 1500)
    return M.score_table(t, [m]).select("src_ip", "window_start", F.round("ocsvm_raw", 6).alias("ocsvm_raw"))


@query("bundle_roundtrip_scores")
def bundle_roundtrip_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a model that was stored and read back."""
    t, m = _model(spark, d, IFOREST, 5000)
    return M.score_table(t, [M.FittedModel.from_bytes(m.to_bytes())]).select("src_ip", "window_start", F.round("iforest_raw", 9).alias("iforest_raw"))
