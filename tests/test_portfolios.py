"""Portfolios and validation that SQL can't express, against plain numpy; edge cases of market values and links."""

import numpy as np

from panelforge.operators import dense
from panelforge.operators import valuation as va
from panelforge.plans import registry, risks


def _triangle(spark, values, column="cov"):
    names = [f"f{k}" for k in range(len(values))]
    rows = [(1, names[i], names[j], float(values[i, j])) for i in range(len(values)) for j in range(i, len(values))]
    return names, spark.createDataFrame(rows, f"date int, factor_i string, factor_j string, {column} double")


def test_minimum_risk_is_the_least(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    m = x.T @ x / 40
    names, cov = _triangle(spark, m)
    found = dense.minimum_risk(cov, "date").collect()
    for k, target in enumerate(names):
        w = np.array([next(r.weight for r in found if r.target == target and r.factor == f) for f in names])
        sigma = next(r.sigma for r in found if r.target == target)
        assert abs(w[k] - 1) < 1e-9 and abs(sigma**2 - w @ m @ w) < 1e-9
        for _ in range(20):  # any other portfolio with a unit of the target has more risk
            other = w + rng.normal(size=5) * (np.arange(5) != k)
            assert other @ m @ other >= sigma**2 - 1e-12


def test_eigen_battery_by_hand(spark):
    rng = np.random.default_rng(2)
    cov, ret, before, after = [], [], [], []
    for date in range(6):
        x = rng.normal(size=(30, 3))
        pre = x.T @ x / 30
        post = pre * 1.44
        got = rng.normal(size=3)
        cov += [(date, f"f{i}", f"f{j}", float(pre[i, j]), float(post[i, j])) for i in range(3) for j in range(i, 3)]
        ret += [(date, f"f{i}", float(got[i])) for i in range(3)]
        values, vectors = np.linalg.eigh(pre)
        z = vectors.T @ got / np.sqrt(values)
        before.append(np.abs(z))
        after.append(np.abs(z) / 1.2)
    found = dense.eigen_battery(
        spark.createDataFrame(cov, "date int, factor_i string, factor_j string, cov_pre_eigen double, cov_final double"), spark.createDataFrame(ret, "date int, factor string, ret double"), "date"
    ).collect()
    assert sorted(r.k for r in found) == [0, 1, 2] and {r.n for r in found} == {6}
    for r in found:  # an eigenvector's sign is free, the ratio of both biases isn't
        assert abs(r.bias_before / r.bias_after - 1.2) < 1e-9


def test_pure_portfolios_give_the_factor_returns(spark, sf):
    from pyspark.sql import functions as F

    from panelforge.plans.crosssections import _regression_input
    from panelforge.plans.portfolios import _pure

    y = _regression_input(spark, sf).select("year", "sid", "y")
    got = {(r.year, r.factor): r.f for r in _pure(spark, sf).join(y, ["year", "sid"]).groupBy("year", "factor").agg(F.sum(F.col("weight") * F.col("y")).alias("f")).collect()}
    want = {(r.year, r.factor): r.f for r in registry.QUERIES["factor_returns_wls"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_structural_level_of_an_industry_without_rows(spark):
    rows = [(1, k, 2.0 if k < 5 else 8.0, float(k % 3), "a" if k < 5 else "b", 1.0, True) for k in range(10)] + [(1, 10, None, 0.0, "c", 1.0, False)]
    df = spark.createDataFrame(rows, "d int, sid int, sigma double, style double, industry string, w double, fit boolean")
    found = {r.sid: r.structural for r in dense.structural_sigma(df, "d", "sid", "sigma", ["style"], "industry", "w", df.fit).collect()}
    assert abs(found[0] - 2) < 1e-6 and abs(found[9] - 8) < 1e-6 and abs(found[10] - 4) < 1e-6


def test_links_over_keys(spark):
    df = spark.createDataFrame([(5, "x", None), (3, "x", "p"), (9, None, "p"), (7, None, None), (7, None, None), (2, "y", "q"), (None, "y", "z")], "id int, a string, b string")
    found = {r.id: r.component for r in va.linked_by_keys(df, "id", [df.a, df.b]).collect()}
    assert found == {5: 3, 3: 3, 9: 3, 7: 7, 2: 2}
    assert va.linked_by_keys(df.limit(0), "id", [df.a, df.b]).count() == 0


def test_links_along_a_long_chain(spark):
    rows = [(k, f"k{(k + 1) // 2}", f"j{k // 2}") for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(5)
    assert {r.component for r in va.linked_by_keys(df, "id", [df.a, df.b]).collect()} == {0}


def test_market_caps_follow_splits(spark):
    days = spark.createDataFrame([(1, s, 100.0 / (2 if s >= 3 else 1), 0.0, 10, 2.0 if s >= 3 else 1.0) for s in range(1, 6)], "sid int, s int, close double, ret double, volume int, cum double")
    counts = spark.createDataFrame([(1, 2, 1000.0), (1, 4, 9e9)], "sid int, s int, count double")
    floats = spark.createDataFrame([(1, 1, 50000.0)], "sid int, s int, value double")
    found = {r.s: r for r in va.market_caps(days, counts, floats, "sid", "s", (0.001, 0.1), 5, 2, 9, 0.2).collect()}
    assert (found[1].source, found[1].shares) == ("float", 500.0)
    assert (found[2].source, found[2].mcap, found[2].flag) == ("count", 100000.0, "continuity")
    assert (found[3].shares, found[3].mcap, found[3].flag) == (2000.0, 100000.0, None)  # the split changes nothing
    assert (found[5].source, found[5].shares) == ("float", 1000.0)  # the second count is implausible, the first too old


def test_least_risk_of_the_model(spark, sf):
    found = registry.QUERIES["minimum_risk"](spark, sf)
    own = {r.target: r.weight for r in found.filter("target = factor").collect()}
    assert own and all(abs(w - 1) < 1e-6 for w in own.values())
    factors = {r.i for r in risks._cov(spark, sf).select("i").distinct().collect()}
    assert set(own) <= factors


def test_fresh_by_priority(spark):
    from pyspark.sql import functions as F

    day = lambda df: df.withColumn("d", F.to_date("d"))
    facts = day(spark.createDataFrame([(1, "2024-01-01", "a", 1.0), (1, "2024-01-05", "b", 2.0), (1, "2024-01-06", "z", 9.0), (1, "2024-01-07", "a", None)], "k int, d string, c string, v double"))
    dates = day(spark.createDataFrame([(1, "2023-12-31"), (1, "2024-01-01"), (1, "2024-01-11"), (1, "2024-01-14"), (1, "2024-02-14"), (2, "2024-01-11")], "k int, d string"))
    found = {(r.k, str(r.d)): (r.v, r.c) for r in va.fresh_by_priority(dates, facts, ["k"], "d", "c", "v", ["a", "b"], 10).collect()}
    assert found[1, "2024-01-01"] == found[1, "2024-01-11"] == (1.0, "a") and found[1, "2024-01-14"] == (2.0, "b")
    assert found[1, "2023-12-31"] == found[1, "2024-02-14"] == found[2, "2024-01-11"] == (None, None)


def test_valuation_zero_fill(spark):
    df = spark.createDataFrame([(100.0, 5.0, None, None, None, None), (100.0, 5.0, -20.0, None, 30.0, None), (0.0, 5.0, 10.0, 50.0, 5.0, 5.0)], "mc double, ni double, be double, ta double, ld double, cd double")
    c = va.ratios(df.mc, df.ni, df.ni, df.be, df.ta, df.cd, df.ld, df.cd)
    got = [tuple(r) for r in df.select(*(x.alias(n) for n, x in c.items())).collect()]
    assert got[0] == (0.05, 0.05, None, None, None, None)  # no balance sheet: nothing is filled
    assert got[1] == (0.05, 0.05, -0.2, 1.3, None, None)
    assert got[2] == (None, None, None, None, 0.2, 2.0)


def _problem(seed, n=30, k=5):
    rng = np.random.default_rng(seed)
    x, half = rng.normal(size=(n, k)), rng.normal(size=(k, k)) * 0.02
    bench = rng.random(n) + 0.2
    spec = rng.random(n) * 0.004 + 0.0005
    f = half @ half.T
    return x, f, spec, bench / bench.sum(), rng.normal(size=n) * 0.01, x @ f @ x.T + np.diag(spec)


def test_active_weights_closed_forms():
    """Against formulas where few constraints bind, and against the projected gradient of the plain problem."""
    for seed in range(5):
        x, f, spec, bench, alpha, full = _problem(seed)
        w, status = dense.active_weights(x, f, spec, bench, cap=1.0)
        assert status == "OPTIMAL" and np.abs(w - bench).max() < 1e-6
        ones, inverse = np.ones(len(bench)), np.linalg.inv(full)
        tilt = inverse @ (alpha - ones * (ones @ inverse @ alpha) / (ones @ inverse @ ones))
        want = bench + tilt / 2000
        assert want.min() > 0
        w, status = dense.active_weights(x, f, spec, bench, alpha=alpha, aversion=1000.0, cap=1.0)
        assert status == "OPTIMAL" and np.abs(w - want).max() < 1e-6
        limit = 0.4 * float(bench.min()) / np.abs(tilt).max() * float(np.sqrt(tilt @ full @ tilt))
        w, status = dense.active_weights(x, f, spec, bench, alpha=alpha, aversion=1e-3, cap=1.0, tracking=limit)
        assert status == "OPTIMAL" and np.abs(w - bench - tilt * limit / np.sqrt(tilt @ full @ tilt)).max() < 1e-5
        w, status = dense.active_weights(x, f, spec, np.zeros(len(bench)), alpha=alpha, aversion=2.0, cap=0.2)
        assert status == "OPTIMAL" and np.abs(w - dense.solve_weights(full, alpha, 0.2, 4.0)).max() < 1e-4


def test_active_weights_under_all_bounds():
    """Every bound holds, and no feasible portfolio found at random does better."""
    for seed in range(4):
        x, f, spec, bench, alpha, full = _problem(seed)
        prev = np.full(len(bench), 1 / len(bench))
        bands = np.array([0.1, 0.1, 0.05, np.inf, np.inf])
        w, status = dense.active_weights(x, f, spec, bench, alpha=alpha, aversion=1.0, cap=0.1, bands=bands, tracking=0.01, prev=prev, turnover=0.6)
        fits = lambda w, room=0.0: np.abs(w - prev).sum() <= 0.6 + room and (np.abs(x.T @ (w - bench)) <= bands + room).all() and (w - bench) @ full @ (w - bench) <= (0.01 + room) ** 2 and w.min() >= -room and w.max() <= 0.1 + room
        gain = lambda w: alpha @ w - (w - bench) @ full @ (w - bench)
        assert status == "OPTIMAL" and abs(w.sum() - 1) < 1e-9 and fits(w, 1e-6)
        rng, tried = np.random.default_rng(seed), 0
        for _ in range(4000):
            i, j = rng.choice(len(bench), 2, replace=False)
            step = np.zeros(len(bench))
            step[i], step[j] = 1, -1
            other = w + step * rng.random() * 0.01 if rng.random() < 0.5 else w + rng.random() * (bench - w) + step * rng.random() * 0.02
            if fits(other):
                tried += 1
                assert gain(other) <= gain(w) + 1e-7
        assert tried > 100
    assert dense.active_weights(x, f, spec, bench, alpha=alpha, cap=0.01, rounds=3000)[1] == "INFEASIBLE"


def test_active_weights_of_keys(spark):
    x, f, spec, bench, alpha, full = _problem(9, n=12, k=3)
    names, cov = _triangle(spark, f)
    data = [(1, i, dict(zip(names, map(float, x[i]))), float(spec[i]), float(bench[i]), float(alpha[i])) for i in range(12)]
    data += [(1, None, None, 0.1, 0.1, 0.1), (1, 50, None, None, 0.1, 0.1), (2, 1, None, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(data, "date int, sid int, exposures map<string,double>, spec_var double, bench double, alpha double")
    found = {r.sid: r for r in dense.optimize_active(df, cov, "date", "sid", aversion=5.0, cap=0.3).collect()}
    want, _ = dense.active_weights(x, f, spec, bench, alpha=alpha, aversion=5.0, cap=0.3)
    assert sorted(found) == list(range(12)) and {r.status for r in found.values()} == {"OPTIMAL"}
    assert max(abs(found[i].weight - want[i]) for i in range(12)) < 1e-6
    assert dense.optimize_active(df.limit(0), cov, "date", "sid").count() == 0


def test_active_weights_query(spark, sf):
    found = registry.QUERIES["active_weights"](spark, sf).collect()
    assert len(found) > 10 and abs(sum(r.weight for r in found) - 1) < 1e-3
    assert {r.status for r in found} == {"OPTIMAL"} and found[0].tracking_error <= 0.05 + 1e-5


def test_covariance_gate(spark):
    good, bad = np.diag([1.0, 2.0]), np.array([[1.0, 2.0], [2.0, 1.0]])
    data = [(d, f"f{i}", f"f{j}", None if d == 3 else float(m[i, j])) for d, m in ((1, good), (2, bad), (3, good)) for i in range(2) for j in range(i, 2)]
    cov = spark.createDataFrame(data, "date int, factor_i string, factor_j string, cov double")
    dates = spark.createDataFrame([(k,) for k in range(1, 5)], "date int")
    assert {r.date: r.ok for r in dense.covariance_gate(dates, cov, "date", "cov").collect()} == {1: True, 2: False, 3: False, 4: False}


def test_predecessors(spark):
    from datetime import date as d

    issuers = spark.createDataFrame([(1, d(2010, 1, 1)), (2, d(2010, 1, 1)), (3, d(2010, 1, 1)), (4, d(2010, 1, 1))], "issuer long, first date")
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (10, "a"), (11, "a"), (12, "a"), (13, "b"), (14, "")], "id long, key string")
    spans = [(1, d(2012, 1, 1), d(2020, 1, 1), 9), (10, d(2000, 1, 1), d(2011, 1, 1), 5), (11, d(2001, 1, 1), d(2011, 1, 1), 5), (12, d(2013, 1, 1), d(2020, 1, 1), 5), (13, d(2000, 1, 1), d(2005, 1, 1), 5), (14, d(2000, 1, 1), d(2015, 1, 1), 1), (4, d(2010, 1, 5), d(2015, 1, 1), 1)]
    from panelforge.operators import staging as st

    got = st.predecessors(issuers, names, spark.createDataFrame(spans, "id long, first_filed date, last_filed date, n long"), 30, 90).collect()
    assert {(r.issuer, r.id, r.role) for r in got} == {(k, k, "primary") for k in (1, 2, 3, 4)} | {(1, 10, "predecessor"), (2, None, "none"), (3, None, "none")}
    assert st.predecessors(issuers.limit(0), names, spark.createDataFrame(spans, "id long, first_filed date, last_filed date, n long"), 30, 90).count() == 0
