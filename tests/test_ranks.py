"""Exact quantiles: by Spark's percentiles and by ranges of ranks, against sorting."""

import math
import random

import pytest

from scriptorium.operators import ranks

WANTED = {"v": {"low": ("nearest", 0.0), "p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "top": ("nearest", 1.0), "median": ("between", 0.5), "q9": ("between", 0.9)}}


def brute(values):
    s = sorted(v for v in values if v is not None)
    if not s:
        return (None,) * 6

    def nearest(p):
        return s[max(1, math.ceil(len(s) * p)) - 1]

    def between(p):
        at = (len(s) - 1) * p
        a, b = s[math.floor(at)], s[math.ceil(at)]
        return a + (b - a) * (at - math.floor(at))

    return (nearest(0.0), nearest(0.5), nearest(0.95), nearest(1.0), between(0.5), between(0.9))


@pytest.mark.parametrize("few", [10**6, 0])
def test_against_sorting(spark, few):
    """One group holds most rows and one value most of these; there is a null group, and groups of one row and of nulls."""
    g = random.Random(2)
    rows = [("big", 1.0 if g.random() < 0.5 else g.random()) for _ in range(3000)] + [(None, float(x)) for x in range(10)] + [("one", 5.0), ("none", None), ("none", None)] + [(f"g{i % 9}", g.choice([None, g.gauss(0, 1)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    got = {r.k: tuple(r)[1:] for r in ranks.quantiles(df, WANTED, ["k"], few).collect()}
    assert set(got) == set(by)
    for k, values in by.items():
        assert got[k] == pytest.approx(brute(values)), k
    whole = ranks.quantiles(df, WANTED, few=few).collect()
    assert len(whole) == 1
    assert tuple(whole[0]) == pytest.approx(brute([v for _, v in rows]))


@pytest.mark.parametrize("few", [10**6, 0])
def test_several_columns_keys_and_no_rows(spark, few):
    rows = [(i % 3, i % 2, i, i * 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b int, n int, x double")
    wanted = {"n": {"n50": ("nearest", 0.5)}, "x": {"x50": ("between", 0.5)}}
    got = {(r.a, r.b): (r.n50, r.x50) for r in ranks.quantiles(df, wanted, ["a", "b"], few).collect()}
    for a in range(3):
        for b in range(2):
            mine = [r for r in rows if r[:2] == (a, b)]
            assert got[a, b] == pytest.approx((brute([r[2] for r in mine])[1], brute([r[3] for r in mine])[4]))
    none = ranks.quantiles(df.where("false"), wanted, few=few).collect()
    assert [tuple(r) for r in none] == [(None, None)]
    assert ranks.quantiles(df.where("false"), wanted, ["a"], few).collect() == []
