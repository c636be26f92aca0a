import random

import numpy as np
from pyspark.sql import functions as F

from flowtide.operators import ordering as O

VALUES = random.Random(3).choices([None, 1.0, 1.0, 1.0, 2.5, -4.0, 7.0, 7.5], k=400)


def rows(spark):
    return spark.createDataFrame([("hot" if i % 3 else "cold", i, v) for i, v in enumerate(VALUES)], "g string, id int, v double").repartition(7)


def test_numbers_follow_the_order(spark):
    got = O.numbered(rows(spark), (F.desc("v"), F.col("id")), "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))] == list(range(1, 401))
    assert O.numbered(rows(spark).limit(0), (F.col("v"),), "n").count() == 0


def test_quantiles_and_ranks(spark):
    df = rows(spark)
    for r in O.quantiles(df, ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect():
        own = [v for i, v in enumerate(VALUES) if v is not None and (i % 3 > 0) == (r["g"] == "hot")]
        assert np.allclose(r["q"], np.quantile(own, (0, 0.25, 0.5, 0.9, 1)))
    for r in O.with_rank(df, ["g"], "v", "rank").collect():
        own = [v for i, v in enumerate(VALUES) if v is not None and (i % 3 > 0) == (r["g"] == "hot")]
        assert r["rank"] == (None if r["v"] is None else 1 + sum(v < r["v"] for v in own))
    known = sorted(v for v in VALUES if v is not None)
    for p in (0.01, 0.5, 0.99, 1.0):
        assert O.discrete_quantile(df, "v", p).first()["cut"] == known[max(0, int(np.ceil(p * len(known))) - 1)]
    assert O.discrete_quantile(df.limit(0), "v", 0.5).first()["cut"] is None and O.quantiles(df.limit(0), ["g"], "v", (0.5,)).count() == 0


def test_no_window_gathers_all_rows(spark):
    plan = O.numbered(rows(spark), (F.col("id"),), "n").select("id", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" not in plan
    best = O.top(rows(spark), ["g"], (F.desc("v"), F.col("id")), 2, "r").collect()
    assert len(best) == 4 and all(r["v"] == 7.5 for r in best)


def test_all_reference_scores_count(spark):
    """Calibration reads every finite score of the reference period, however many there are."""
    from flowtide.operators.ranking import reference_scores

    n = 5_000_100
    scores = spark.range(0, n + 2).selectExpr("cast(id as string) as src_ip", "timestamp_seconds(id) as window_start", f"case when id = {n} then double('nan') when id < {n} then double(id) end as a_raw")
    assert reference_scores(scores, ["a"], F.lit(True)).count() == n
