import re

import pytest

from flowtide.llm import mixing


def fill(sizes, weights, total, cap=2):
    """Water-filling by repeated resharing."""
    target, open_ = {}, dict(weights)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            del open_[s]
    return target


def test_mix(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), ["a", "b", "c", None, "hot"][min(4, i % 9)], 3) for i in range(4000)] + [(9000 + i, "same text here", "a", 3) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = ["a", "b", "c", "hot", None]
    want = fill(sizes, dict(zip(order, (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(sizes.values()))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 400
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_odd(spark, odd, odd_rows, empty):
    got = mixing.mix(odd).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows)
    assert mixing.mix(empty).count() == 0 and mixing.resample(empty).count() == 0
    assert mixing.resample(odd).columns == odd.columns
    assert mixing.resample(odd).count() == sum(r["copies"] for r in got)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(df).collect()] == [(0.0, 0), (0.0, 0)]
