"""Recursions at any length and ranks under ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import crosssection as cs
from panelforge.operators import risk
from panelforge.operators import timeseries as ts

N = 50_000


@pytest.fixture(scope="module")
def series():
    r = random.Random(2)
    return [r.gauss(0, 1) if k < 30_000 else 0.0 for k in range(N)]


def test_ewma_state_is_the_recursion(spark, series):
    """50,000 sessions at a half life of 2, the last 20,000 all zero: as the recursion, and never NaN."""
    df = spark.createDataFrame([(e, 20_000 + k, x) for e in (1, 2) for k, x in enumerate(series[: N if e == 1 else 7])], "e int, s int, x double").repartition(5)
    got = {(r.e, r.s - 20_000): r.state for r in ts.ewma_state(df, "e", "s", "x", 2).collect()}
    keep, state = 0.5**0.5, series[0]
    for k, x in enumerate(series):
        state = x if k == 0 else (1 - keep) * x + keep * state
        assert math.isclose(got[1, k], state, rel_tol=1e-9, abs_tol=1e-300)
        assert k >= 7 or math.isclose(got[2, k], state, rel_tol=1e-12)


def test_one_day_sigma_on_day_numbers(spark, series):
    """Sessions far from zero, with gaps longer than a block and unobserved ones."""
    rows = [("f", 20_000 + k, x if k % 7 else None) for k, x in enumerate(series[:3000])] + [("f", 90_000 + k, x) for k, x in enumerate(series[:50])]
    got = {r.s: r.sigma for r in risk.one_day_sigma(spark.createDataFrame(rows, "f string, s int, x double").repartition(3), "f", "s", "x", 12, 5).collect()}
    square = weight = 0.0
    seen, last = 0, 20_000
    for _, s, x in rows:
        keep = 0.5 ** ((s - last) / 12)
        square, weight, last = square * keep, weight * keep, s
        want = math.sqrt(square / weight) if seen >= 5 and weight > 0 else None
        assert got[s] is None if want is None else math.isclose(got[s], want, rel_tol=1e-9)
        if x is not None:
            square, weight, seen = square + x * x, weight + 1, seen + 1


def test_regime_on_long_calendars(spark, series):
    rows = [(k, x, 1.0 if k > 2 else None) for k, x in enumerate(series)]
    got = {r.s: r.lam for r in risk.regime(spark.createDataFrame(rows, "s int, x double, sigma double"), "s", "x", "sigma", 8).collect()}
    keep, state = 0.5 ** (1 / 8), None
    for k, x, sigma in rows:
        if sigma is not None:
            b = min(max(x, -10), 10) ** 2
            state = b if state is None else (1 - keep) * b + keep * state
        assert math.isclose(got[k], 1.0 if state is None else math.sqrt(state), rel_tol=1e-8, abs_tol=1e-150)


def test_ties_are_counted_once_and_spread(spark, monkeypatch):
    """With 90 % equal values quantiles read one row a value, and ranks deal the equal rows to all partitions."""
    r = random.Random(3)
    rows = [(k % 2, 5 if r.random() < 0.9 else r.randint(0, 50)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "g int, x int").repartition(8)
    got = {q.g: (q.a, q.b, q.c, q.n) for q in cs.quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.03, "c": 0.995}, "n").collect()}
    for g in (0, 1):
        own = sorted(x for k, x in rows if k == g)
        want = []
        for q in (0.5, 0.03, 0.995):
            at = (len(own) - 1) * q
            lo, hi = own[math.floor(at)], own[math.ceil(at)]
            want.append(lo + (at - math.floor(at)) * (hi - lo))
        assert got[g] == pytest.approx((*want, len(own)))
    dealt, stored = [], ts.stored
    monkeypatch.setattr(ts, "stored", lambda df, tag: dealt.append(stored(df, tag)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        ranks = ts.ranked(df, ["g"], ["x"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(p["count"] for p in dealt[0].groupBy("_part").count().collect()) < 0.3 * len(rows)
    for g in (0, 1):
        own = sorted((q["rank"], q.x) for q in ranks.filter(F.col("g") == g).collect())
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)
