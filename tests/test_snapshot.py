"""Asset-level risk against the matrices it never makes."""

import random

import numpy as np
import pytest

from panelforge.operators import snapshot as sn

N, IND, STY = 40, ["auto", "bank", "tech"], ["size", "value"]
NAMES = ["country", *IND, *STY]


@pytest.fixture(scope="module")
def model(spark):
    r = np.random.default_rng(3)
    root = r.normal(size=(6, 6)) * 0.02
    cov = root @ root.T
    industry = [IND[k % 3] for k in range(N)]
    styles = r.normal(size=(N, 2))
    spec, mcap = r.uniform(0.02, 0.1, N), r.uniform(1, 9, N)
    estu = [k % 5 != 0 for k in range(N)]
    x = np.zeros((N, 6))
    x[:, 0] = 1
    for k, i in enumerate(industry):
        x[k, 1 + IND.index(i)] = 1
    x[:, 4:] = styles
    make = spark.createDataFrame
    exposures = make([(k, industry[k], *map(float, styles[k])) for k in range(N)], "sid int, industry string, size double, value double").repartition(3)
    specific = make([(k, float(spec[k])) for k in range(N)], "sid int, sigma double")
    universe = make([(k, f"T{k}", float(mcap[k]), estu[k]) for k in range(N)], "sid int, ticker string, mcap double, in_estu boolean")
    upper = make([(*sorted((NAMES[i], NAMES[j])), float(cov[i, j])) for i in range(6) for j in range(i, 6)], "i string, j string, cov double")
    snap = sn.assemble(exposures, specific, universe, upper, STY)
    market = np.where(estu, mcap, 0) / np.where(estu, mcap, 0).sum()
    return snap, x, cov, spec**2, market


def holdings(spark):
    r = random.Random(4)
    a = [("a", k, r.random() / 10, None) for k in range(0, N, 2)] + [("a", 0, 0.01, None), ("a", 999, 0.5, None)]
    b = [("b", k, 1 / 10 if k < 10 else 0.0, 1 / N) for k in range(N)]
    return a + b, spark.createDataFrame(a + b, "portfolio string, sid int, weight double, bench_weight double")


def test_tables_against_matrices(spark, model):
    snap, x, cov, spec, market = model
    rows, df = holdings(spark)
    report = sn.portfolio_risk(snap, df)
    totals = {r.portfolio: r for r in report.totals.collect()}
    for p in "ab":
        h, b = np.zeros(N), np.zeros(N)
        for q, k, w, bw in rows:
            if q == p and k < N:
                h[k] += w
                b[k] += bw or 0
        w = h - b if p == "b" else h
        bench = b if p == "b" else market
        big = x @ cov @ x.T + np.diag(spec)
        sigma = np.sqrt(w @ big @ w)
        beta = big @ bench / (bench @ big @ bench)
        t = totals[p]
        assert (t.active, t.sigma, t.specific_var, t.beta) == (p == "b", pytest.approx(sigma), pytest.approx((w * w * spec).sum()), pytest.approx(h @ beta))
        assets = {r.sid: r for r in report.assets.filter(report.assets.portfolio == p).collect()}
        assert len(assets) == N
        for k in range(N):
            assert (assets[k].weight, assets[k].mctr, assets[k].beta) == pytest.approx((w[k], (big @ w)[k] / sigma, beta[k]))
        assert sum(r.contrib for r in assets.values()) == pytest.approx(sigma) and sum(r.pct_risk for r in assets.values()) == pytest.approx(1)
        factors = {r.factor: r for r in report.factors.filter(report.factors.portfolio == p).collect()}
        e = x.T @ w
        for k, n in enumerate(NAMES):
            assert (factors[n].exposure, factors[n].vol, factors[n].contrib_var) == pytest.approx((e[k], np.sqrt(cov[k, k]), e[k] * (cov @ e)[k]))
            assert factors[n].xsr * sigma == pytest.approx(factors[n].contrib_var)
        groups = {r.group: r for r in report.groups.filter(report.groups.portfolio == p).collect()}
        assert set(groups) == {"country", "industry", "style", "specific"} and sum(g.contrib_var for g in groups.values()) == pytest.approx(sigma**2)


def test_empty_portfolios_unmatched_tickers_and_unknown_industries(spark, model):
    snap = model[0]
    df = spark.createDataFrame([("z", 1, 0.0, None), ("y", 1, 0.3, 0.3)], "portfolio string, sid int, weight double, bench_weight double")
    report = sn.portfolio_risk(snap, df)
    assert {(r.portfolio, r.sigma) for r in report.totals.collect()} == {("z", 0.0), ("y", 0.0)}
    assert report.assets.filter("mctr <> 0 OR contrib <> 0").count() == 0
    named = spark.createDataFrame([("a", "T3"), ("a", "ZZ")], "portfolio string, ticker string")
    assert [tuple(r) for r in sn.unmatched(snap, named).collect()] == [("a", "ZZ")]
    make = spark.createDataFrame
    odd = sn.assemble(make([(1, "mining", 0.0, 0.0)], "sid int, industry string, size double, value double"), make([(1, 0.1)], "sid int, sigma double"), make([(1, "T", 1.0, True)], "sid int, ticker string, mcap double, in_estu boolean"), snap.cov, STY)
    with pytest.raises(Exception, match="no factor for industry mining"):
        odd.assets.collect()
