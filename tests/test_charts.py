import math
import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from flowtide.operators import chart_data as C
from flowtide.plans import charts


def test_every_point_is_in_its_nearest_hexagon(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-1, 3), rng.uniform(-1, 3)) for _ in range(200)]
    x, y = C.hexagons(F.col("x"), F.col("y"), 0.2)
    tall = 0.2 * math.sqrt(3)
    grid = [(i * 0.2 + o * 0.1, j * tall + o * tall / 2) for i in range(-8, 20) for j in range(-6, 12) for o in (0, 1)]
    for px, py, cx, cy in spark.createDataFrame(points, "x double, y double").select("x", "y", x, y).collect():
        nearest = min(math.dist((px, py), g) for g in grid)
        assert math.isclose(math.dist((px, py), (cx, cy)), nearest, abs_tol=1e-9)


def test_rarity_has_a_floor(spark):
    df = spark.createDataFrame([(0.0,), (0.9,), (1.0,)], "p double").select(C.rarity(F.col("p"), 999))
    assert [round(r[0], 9) for r in df.collect()] == [0, 1, 3]


def test_zoom_centres_keep_their_distance(spark):
    t0 = datetime(2026, 1, 1)
    rows = [("h", t0 + timedelta(hours=h), s) for h, s in ((0, 9.0), (1, 8.0), (30, 7.0), (31, 7.0), (60, None), (90, 1.0))]
    df = spark.createDataFrame(rows, "src_ip string, window_start timestamp, m_raw double")
    assert C.zoom_centres(df, "m", 3, timedelta(days=1)) == [t0, t0 + timedelta(hours=30), t0 + timedelta(hours=90)]
    assert C.zoom_centres(df.limit(0), "m", 3, timedelta(days=1)) == []
    assert C.zoom(df, F.col("m_raw") > 8, t0, timedelta(hours=12)).orderBy("bucket").collect()[1]["review"] == 0


def test_backdrop_covers_the_buckets_that_it_touches():
    days = [date(2026, 1, d) for d in (1, 2, 3, 5)]
    at = lambda d, h=0: datetime(2026, 1, d, h)
    draw = lambda *spans: charts.Backdrop([(*s, 0.2) for s in spans], [("test", at(3)), ("later", at(9))]).draw(days, 10.0)
    out = draw((at(1, 12), at(3)))
    assert 'x="0.0" y="0" width="20.0"' in out and 'x1="20.0"' in out and "later" not in out
    assert "span" not in draw((at(4, 1), at(4, 9)), (at(6), at(8)))  # a day without a bar, and after the last one
    assert charts.Backdrop([(at(1), at(2), 0.2)], [("a", at(1))]).draw([], 1.0) == ""


def test_figures_hold_for_any_input():
    for f in (charts.bars([], "a<b"), charts.stacked([(1, "x", 0.0)], "a<b"), charts.lines([("s", 1.0, 2.0), ("s", 1.0, 2.0)], "a<b"), charts.heatmap([("h", 1, 0.5)], "a<b"), charts.heatmap([], "a<b"), charts.hexagons([(1.0, 1.0, 3.0)], "a<b")):
        assert f.startswith("<figure>") and "\n" not in f and "a&lt;b" in f
