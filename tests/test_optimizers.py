"""Optimal weights against a second solver that tries every set of binding bounds, and by date."""

import itertools

import numpy as np
import pytest

from panelforge.operators import dense
from panelforge.plans import registry, risks


def exact(cov, alpha, cap, aversion, extra=None):
    """The best long-only weights, by solving the equations of each choice of bounds; extra: a row and its bounds."""
    n, best = len(alpha), (-np.inf, None)
    rows = [(np.ones(n), 1.0)]
    choices = [None] if extra is None else [None, extra[1], extra[2]]
    for state in itertools.product((0, 1, 2), repeat=n):  # free, at 0, at the cap
        for at in choices:
            fixed = rows + ([(extra[0], at)] if at is not None else []) + [(np.eye(n)[i], 0.0 if s == 1 else cap) for i, s in enumerate(state) if s]
            a, b = np.array([r for r, _ in fixed]), np.array([v for _, v in fixed])
            kkt = np.block([[aversion * cov, a.T], [a, np.zeros((len(a), len(a)))]])
            w = np.linalg.lstsq(kkt, np.concatenate([alpha, b]), rcond=None)[0][:n]
            ok = np.abs(a @ w - b).max() < 1e-9 and w.min() > -1e-9 and w.max() < cap + 1e-9
            ok = ok and (extra is None or extra[1] - 1e-9 <= extra[0] @ w <= extra[2] + 1e-9)
            value = alpha @ w - aversion / 2 * w @ cov @ w
            if ok and value > best[0]:
                best = (value, w)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_long_only_weights_are_the_exact_ones(seed):
    r = np.random.default_rng(seed)
    a = r.normal(size=(5, 12))
    cov, alpha = a @ a.T / 12, r.normal(size=5) * 0.5
    value, w = exact(cov, alpha, 0.4, 4.0)
    got = dense.solve_weights(cov, alpha, 0.4, 4.0)
    assert np.abs(got - w).max() < 1e-5 and alpha @ got - 2 * got @ cov @ got == pytest.approx(value, abs=1e-8)


@pytest.mark.parametrize("seed", range(4))
def test_active_weights_under_a_band_are_the_exact_ones(seed):
    """One band on an exposure: the objective's risk is that of the active weights."""
    r = np.random.default_rng(10 + seed)
    n, x = 5, r.normal(size=(5, 2))
    root = r.normal(size=(2, 6)) * 0.2
    f, spec, bench, alpha = root @ root.T, r.uniform(0.02, 0.1, n), np.full(n, 0.2), r.normal(size=n) * 0.3
    got, status = dense.active_weights(x, f, spec, bench, alpha=alpha, aversion=3.0, cap=0.5, bands=np.array([0.1, np.inf]))
    big = x @ f @ x.T + np.diag(spec)
    middle = x[:, 0] @ bench
    # alpha'w - 3 (w - b)'S(w - b) = (alpha + 6 S b)'w - 6/2 w'Sw + constant
    _, w = exact(big, alpha + 6.0 * big @ bench, 0.5, 6.0, (x[:, 0], middle - 0.1, middle + 0.1))
    assert status == "OPTIMAL" and np.abs(got - w).max() < 1e-5


def test_each_date_is_its_own_problem(spark, sf):
    cov = {}
    for q in risks._dated(spark, sf).collect():
        cov.setdefault(q.date, {})[q.factor_i, q.factor_j] = q["cov"]
    means = {}
    for q in risks._panel(spark, sf).collect():
        means.setdefault(q.factor, {})[q.m] = q.ret
    got = {}
    for q in registry.QUERIES["optimal_weights_by_date"](spark, sf).collect():
        got.setdefault(q.date, {})[q.factor] = q.weight
    least = {}
    for q in registry.QUERIES["minimum_risk_by_date"](spark, sf).collect():
        least.setdefault(q.date, {})[q.target, q.factor] = q.weight
    assert len(got) > 5 and got.keys() == cov.keys() == least.keys()
    for d, own in cov.items():
        names = sorted({n for pair in own for n in pair})
        full = np.array([[own.get((a, b), own.get((b, a))) for b in names] for a in names])
        # Views are those of factors with a return at the date; others have none.
        alpha = np.array([np.mean([v for m, v in means[n].items() if m <= d]) / 10 if d in means[n] else 0.0 for n in names])
        w = dense.solve_weights(full, alpha, 0.10, 4.0)
        assert np.abs(w - [got[d][n] for n in names]).max() < 2e-6
        inverse = np.linalg.pinv(full, hermitian=True)
        for k, t in enumerate(names):
            if inverse[k, k] > 0:
                scale = max(1.0, np.abs(inverse[:, k] / inverse[k, k]).max())
                assert np.abs(inverse[:, k] / inverse[k, k] - [least[d][t, n] for n in names]).max() < 1e-4 * scale
            else:  # a factor that never moves
                assert (t, t) not in least[d]


def test_active_weights_by_date_keep_their_bounds(spark, sf):
    rows = registry.QUERIES["active_weights_by_date"](spark, sf).collect()
    dates = {}
    for q in rows:
        dates.setdefault(q.date, []).append(q)
    assert len(dates) > 5
    for some in dates.values():
        assert {q.status for q in some} <= {"OPTIMAL", "INACCURATE", "INFEASIBLE"}
        if some[0].status == "OPTIMAL":
            assert sum(q.weight for q in some) == pytest.approx(1, abs=1e-3) and all(-1e-5 <= q.weight <= 0.1 + 1e-4 for q in some) and some[0].tracking_error <= 0.05 + 1e-4
