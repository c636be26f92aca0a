from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import features as FT
from flowtide.operators import models as M
from flowtide.operators import pairs as P
from flowtide.operators import periods as PE
from flowtide.operators import ranking as R

FLOW = "src_ip string, dst_ip string, dst_port long, protocol long, bytes double, packets double, flow_start timestamp, flow_end timestamp"
T0 = datetime(2026, 1, 5, 10)


def test_hand_computed_features(spark):
    rows = [("10.0.0.1", "10.0.1.1", 443, 6, 100.0, 2.0, T0, T0 + timedelta(seconds=2))] * 2 + [("10.0.0.1", "8.8.8.8", 53, 17, None, 1.0, T0, T0 + timedelta(seconds=4))]
    r = FT.host_window_features(spark.createDataFrame(rows, FLOW), 60).first()
    assert (r["flows"], r["bytes_total"], r["packets_total"], r["max_flow_bytes"], r["bytes_per_packet"], r["uniq_dst_ip"], r["uniq_dst_port"]) == (3, 200, 5, 100, 40, 2, 2)
    assert [r[c] for c in ("internal_share", "tcp_share", "udp_share", "icmp_share", "mean_duration_s")] == pytest.approx([2 / 3, 2 / 3, 1 / 3, 0, 8 / 3])


def test_half_open_windows_and_selection(spark):
    rows = [("h", "d", 1, 6, 1.0, 1.0, T0 + timedelta(minutes=m), None) for m in (0, 59, 60)]
    assert sorted(r["flows"] for r in FT.host_window_features(spark.createDataFrame(rows, FLOW), 60).collect()) == [1, 2]
    assert FT.select_features(["tcp_share", "flows"], None, ["flows"]) == ["tcp_share"]
    for bad in (["nope"], ["bytes_total"]):
        with pytest.raises(FT.FeatureError):
            FT.select_features(["flows"], bad)


def test_periods():
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(8)]
    p = PE.split_by_fractions(days, {"train": 0.5, "validation": 0.25, "test": 0.25})
    assert [(x.name, (x.end - x.start).days) for x in p] == [("train", 4), ("validation", 2), ("test", 2)]
    with pytest.raises(PE.SplitError):
        PE.check_periods([p[1], p[0]])
    a = PE.Annotation("x", T0, T0 + timedelta(hours=1))
    assert PE.overlapping([a], T0 + timedelta(hours=1), T0 + timedelta(hours=2)) == [] and PE.overlapping([a], T0 + timedelta(hours=1), T0 + timedelta(hours=2), 1) == [a]


def test_calibration(spark):
    c = R.calibrate(spark.range(1000).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("s")), ["m"], R.BANDS)["m"]
    assert list(c.thresholds.values()) == [999, 995, 990, 975]
    assert c.grid == sorted(set(c.grid)) and c.shares[-1] == 1.0
    df = spark.createDataFrame([(-1.0,), (0.0,), (500.5,), (5000.0,)], "x double").select(R.percentile_of(F.col("x"), c).alias("p"), R.band(F.col("x"), c.thresholds).alias("b"))
    assert [(round(r["p"], 3), r["b"]) for r in df.collect()] == [(0.0, R.BELOW), (0.001, R.BELOW), (0.501, R.BELOW), (1.0, "Critical")]
    with pytest.raises(R.BandError):
        R.calibrate(spark.range(9).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("s")), ["m"], R.BANDS)
    with pytest.raises(R.BandError):
        R.band_quantiles(budgets={"High": 10}, windows_per_day=5)


PARAMS = P.RelParams(60, 1, 1, 0, 2, 1.0)


def pair_flows(spark, hours, dst="d"):
    return spark.createDataFrame([("s", dst, 1, 6, 100.0, 2.0, T0 + timedelta(hours=h), None) for h, n in hours for _ in range(n)], FLOW)


def signals(spark, hours, p=PARAMS, **kw):
    out = P.pair_signals(P.pair_windows(pair_flows(spark, hours), p), p, T0, **kw)
    return [(r["novelty_status"], r["change_status"]) for r in out.orderBy("window_start").collect()]


def test_pair_statuses(spark):
    assert signals(spark, [(0, 1), (24, 1), (49, 1)]) == [("never_seen", "insufficient_history"), ("seen_recently", "insufficient_history"), ("recently_unseen", "insufficient_history")]
    got = signals(spark, [(0, 4), (1, 4), (2, 20), (3, 1), (4, 4)])
    assert [c for _, c in got] == ["insufficient_history", "insufficient_history", "increase", "decrease", "stable"]
    assert signals(spark, [(0, 1)], P.RelParams(60, 1, 1, 7, 2, 1.0))[0][0] == "warmup"


def test_future_changes_nothing(spark):
    hours = [(0, 4), (1, 2), (5, 9)]
    assert signals(spark, [*hours, (9, 50)])[:3] == signals(spark, hours)


def test_carried_state(spark, tmp_path):
    hours = [(h, 1 + h % 4) for h in (0, 1, 2, 5, 20, 21, 30, 31, 57)]
    whole = P.analyze(pair_flows(spark, hours), PARAMS, str(tmp_path / "all"))
    cut = T0 + timedelta(hours=20)
    P.analyze(pair_flows(spark, hours), PARAMS, str(tmp_path / "a"), end=cut)
    h = P.load_history(spark, str(tmp_path / "a" / "history"), PARAMS)
    P.analyze(pair_flows(spark, hours), PARAMS, str(tmp_path / "b"), start=cut, history=h)
    read = lambda n: sorted(map(str, spark.read.parquet(str(tmp_path / n / "pair_windows")).collect()))
    assert read("all") == sorted(read("a") + read("b")) and whole["pair_windows"] == 9
    with pytest.raises(P.RelationshipError):
        P.analyze(pair_flows(spark, hours), PARAMS, str(tmp_path / "c"), history=h)
    with pytest.raises(P.RelationshipError):
        P.load_history(spark, str(tmp_path / "a" / "history"), P.RelParams())
    P.analyze(pair_flows(spark, hours).where("false"), PARAMS, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d" / "evidence")).count() == 0


@pytest.mark.parametrize("kind", ["iforest", "ocsvm"])
def test_models(kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    fit = lambda: M.KINDS[kind].fit(x, **({"n_estimators": 50, "seed": 1} if kind == "iforest" else {"nu": 0.1}))
    m = fit()
    far = m.score(np.array([[6.0, 6, 6], [0, 0, 0]]))
    assert far[0] > far[1] and far[0] >= np.quantile(m.score(x), 0.99)
    assert np.array_equal(m.score(x), fit().score(x))
    f = M.FittedModel(M.ModelSpec(kind), ["tcp_share", "udp_share", "icmp_share"], M.Scaling.fit(x, "robust"), m, 400)
    data = f.to_bytes()
    assert np.array_equal(M.FittedModel.from_bytes(data).raw_scores(x), f.raw_scores(x))
    with pytest.raises(M.ModelError):
        M.FittedModel.from_bytes(data, "0" * 64)


def test_svm_optimum():
    """Few violations of the nu-property: at most nu of the rows lie outside, at least nu are support vectors."""
    x = np.random.default_rng(1).normal(size=(300, 2))
    m = M.OneClassSVM.fit(x, nu=0.2)
    assert m.alpha.sum() == pytest.approx(60) and len(m.alpha) >= 60 and (m.alpha >= 1 - 1e-9).sum() <= 60


def test_sample_is_stable(spark):
    rows = [(f"h{i}", datetime(2026, 1, 1) + timedelta(hours=i), date(2026, 1, 1) + timedelta(days=i // 24)) for i in range(96)]
    df = spark.createDataFrame(rows, "src_ip string, window_start timestamp, flow_date date")
    early = F.col("flow_date") < F.lit(date(2026, 1, 4))
    a = FT.training_sample(df, early, 30, 3, 1).collect()
    b = FT.training_sample(df.where(early).repartition(5), early, 30, 3, 1).collect()
    assert len(a) == 30 and sorted(map(str, a)) == sorted(map(str, b))
