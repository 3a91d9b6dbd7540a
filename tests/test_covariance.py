"""Running covariances against rebuilds from the whole history, refreshes against single dates."""

import datetime
import itertools

import numpy as np
import pytest

from panelforge.operators import covariance as cv
from panelforge.operators import dense

NAMES, T, HL, LAGS = ["a", "b", "c"], 40, 6.0, 2


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(5)
    x = r.normal(size=(T, 3)) @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1]])
    x[7, 1] = x[:12, 2] = np.nan  # a gap, and a factor that comes later
    return x


@pytest.fixture(scope="module")
def panel(spark, values):
    rows = [(n, 100 + t, float(values[t, k])) for t in range(T) for k, n in enumerate(NAMES) if np.isfinite(values[t, k])]
    return spark.createDataFrame(rows, "f string, s int, x double").repartition(4)


def rebuilt(values, t):
    """The covariance as of t by plain sums over the history."""
    x = np.nan_to_num(values[: t + 1])
    w = 0.5 ** ((t - np.arange(t + 1)) / HL)
    out = (x * w[:, None]).T @ x
    for k in range(1, LAGS + 1):
        c = (x[:-k] * w[k:, None]).T @ x[k:] if t >= k else 0 * out
        out = out + (1 - k / (LAGS + 1)) * (c + c.T)
    return out / w.sum()


def test_every_date_is_a_rebuild(panel, values):
    got = {(r.s - 100, r.i, r.j): r["cov"] for r in cv.running_covariances(panel, "f", "s", "x", HL, LAGS).collect()}
    for t in range(T):
        want = rebuilt(values, t)
        for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(NAMES), 2):
            if "c" in (a, b) and t < 12:
                assert (t, a, b) not in got
            else:
                assert got[t, a, b] == pytest.approx(want[i, j], abs=1e-12)


def test_state_moves_by_a_session(spark, panel, values):
    from panelforge.sources.store import stored

    state = stored(cv.moment_state(panel, "f", "s", "x", HL, LAGS, 120), "state")
    for s in range(121, 126):
        recent = panel.filter(f"s BETWEEN {s - LAGS} AND {s}")
        state = stored(cv.advance_state(state, recent, "f", "s", "x", HL, LAGS), "state")
        want = rebuilt(values, s - 100)
        for r in cv.state_covariance(state, LAGS).collect():
            assert r.s == s and r["cov"] == pytest.approx(want[NAMES.index(r.i), NAMES.index(r.j)], abs=1e-12)


def test_weekly_refresh_regime_and_provisional(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in (3, 4, 7, 8, 9)]  # Thursday, Friday, Monday to Wednesday
    marks = {r.date: r.refresh for r in cv.refresh_days(spark.createDataFrame([(d,) for d in days], "date date"), "date", "weekly").collect()}
    assert [marks[d] for d in days] == [True, False, True, False, False]
    r = np.random.default_rng(1)
    mats = []
    for _ in days:
        a = r.normal(size=(3, 30))
        mats.append(a @ a.T / 30)
    make = spark.createDataFrame
    pre = make([(d, NAMES[i], NAMES[j], float(m[i, j])) for d, m in zip(days, mats) for i in range(3) for j in range(i, 3)], "date date, i string, j string, cov double")
    refresh = cv.refresh_days(make([(d,) for d in days], "date date"), "date", "weekly")
    lam = make([(d, 1.0 + k / 10) for k, d in enumerate(days) if k != 1], "date date, lambda double")
    windows = make([(d, 20 + k) for k, d in enumerate(days)], "date date, n int")
    args = dict(windows=windows, estimator=(20, 1, 20, 1), sims=50, scale=1.0, horizon=21.0, provisional=23)
    rows = cv.layered(pre, refresh, lam, "date", **args).collect()
    daily = cv.layered(pre, cv.refresh_days(make([(d,) for d in days], "date date"), "date", "daily"), lam, "date", **args).collect()
    got, all_new = ({(q.date, q.factor_i, q.factor_j): q for q in some} for some in (rows, daily))
    assert len(got) == 5 * 6 and {q.date for q in rows if q.provisional} == set(days[:3])
    for k, d in enumerate(days):
        last = days[0] if k < 2 else days[2]
        import hashlib

        own = int.from_bytes(hashlib.sha256(f"7|{last}".encode()).digest()[:8], "big")
        m = mats[days.index(last)]
        _, _, bias = dense.eigen_adjusted(m, 20 + days.index(last), 50, 1.0, own, lambda x: dense.split_covariance(x, 20, 1, 20, 1))
        values, vectors = np.linalg.eigh(mats[k])
        want = (vectors * (bias**2 * values)) @ vectors.T * 21 * (1.0 if k == 1 else 1.0 + k / 10) ** 2
        for i in range(3):
            for j in range(i, 3):
                q = got[d, NAMES[i], NAMES[j]]
                assert (q.cov_final, q.cov_pre_eigen) == pytest.approx((want[i, j], 21 * mats[k][i, j]))
                assert (q.cov_final == all_new[d, NAMES[i], NAMES[j]].cov_final) == (k in (0, 2))
