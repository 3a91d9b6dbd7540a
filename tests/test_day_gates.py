"""A clean day passes every gate; each fault fails its own."""

import pytest

from panelforge.operators import gates as gt

N = 503
RULES = gt.GateRules(slow_styles=("growth",))


def inputs(spark, faults):
    """A date for each fault (0 is clean): a dict from date to what differs."""
    rows = {k: [] for k in ("universe", "prices", "qa", "stats", "factors", "cov", "regimes", "specific")}
    for d, over in faults.items():
        n, priced = over.get("n", N), over.get("priced", N)
        rows["universe"] += [(d, k, k % 10 != 0) for k in range(n)]
        rows["prices"] += [(d, k, 10.0 if k < priced else 0.0) for k in range(n)]
        rows["specific"] += [(d, k, over.get("sigma", {}).get(k, 0.08)) for k in range(n)]
        rows["qa"] += [(d, s, 1e-9, 1.0 + 1e-9, over.get("imputed", 3), over.get("vif", 2.0), over.get("stability", {}).get(s, 0.97)) for s in ("beta", "growth")] if over.get("qa", True) else []
        rows["stats"] += [(d, over.get("status", "ok"), n, over.get("condition", 50.0), 1e-14, 0.3, over.get("tracking", 1e-5))]
        rows["factors"] += [(d, "energy", over.get("shock", 1.0))]
        rows["cov"] += over.get("cov", [(d, "a", "a", 1.0), (d, "a", "b", 0.2), (d, "b", "b", 1.0)])
        rows["regimes"] += [(d, over.get("lam", 1.1), 0.9)]
    schema = {
        "universe": "date int, sid int, in_estu boolean", "prices": "date int, sid int, close double", "qa": "date int, style string, mean_cw double, std_ew double, imputed int, vif double, stability double",
        "stats": "date int, status string, n int, condition double, constraint_resid double, r2 double, tracking double", "factors": "date int, factor string, f_over_sigma double", "cov": "date int, i string, j string, cov double",
        "regimes": "date int, factor_lambda double, specific_lambda double", "specific": "date int, sid int, sigma double",
    }
    return gt.DayInputs(**{k: spark.createDataFrame(v, schema[k]) for k, v in rows.items()})


FAULTS = {
    0: ({}, set(), set()),
    1: ({"priced": 480}, {"data_freshness"}, set()),
    2: ({"status": "too_few_names"}, {"regression"}, set()),
    3: ({"cov": [(3, "a", "a", 1.0), (3, "a", "b", 2.0), (3, "b", "a", 2.0), (3, "b", "b", 1.0)]}, {"factor_covariance"}, set()),
    4: ({"cov": [(4, "a", "a", 1.0), (4, "a", "b", 0.1), (4, "b", "a", 0.2), (4, "b", "b", 1.0)]}, {"factor_covariance"}, set()),
    5: ({"sigma": {7: None}}, {"specific_coverage"}, set()),
    6: ({"sigma": {7: float("nan")}}, {"specific_coverage"}, set()),
    7: ({"n": 512, "priced": 512, "lam": 2.7, "shock": -7.5, "stability": {"beta": 0.94, "growth": 0.9}}, set(), {"universe", "vra", "factor_shock", "stability"}),
    8: ({"vif": 6.0}, set(), {"vif_warn"}),
    9: ({"vif": 11.0}, {"vif"}, {"vif_warn"}),
    10: ({"qa": False}, {"exposure_moments"}, set()),
    11: ({"cov": []}, {"factor_covariance"}, set()),
    12: ({"imputed": 90, "tracking": 0.01, "lam": None}, set(), {"imputation", "country_tracking", "vra"}),
}


@pytest.fixture(scope="module")
def found(spark):
    gates = gt.day_gates(inputs(spark, {d: f[0] for d, f in FAULTS.items()}), RULES).collect()
    out = {}
    for g in gates:
        out.setdefault(g.date, {})[g.gate] = g
    return out


@pytest.mark.parametrize("day", FAULTS)
def test_each_fault_fails_its_gate(found, day):
    failed = {level: {g.gate for g in found[day].values() if not g.ok and g.level == level} for level in ("FAIL", "WARN")}
    assert failed == {"FAIL": FAULTS[day][1], "WARN": FAULTS[day][2]}


def test_all_fifteen_gates_and_status(spark, found):
    assert len(found[0]) == 15 and "beta 0.94" == found[7]["stability"].detail and found[7]["factor_shock"].detail == "energy -7.5"
    assert len(found[10]) == 11 and len(found[2]) == 13  # without exposures, or a regression, what looks at them isn't asked
    status = gt.day_status(gt.day_gates(inputs(spark, {d: f[0] for d, f in FAULTS.items()}), RULES))
    assert {r.date: r.status for r in status.collect()} == {d: gt.QUARANTINED if f[1] else gt.OK for d, f in FAULTS.items()}
    assert status.agg(gt.publishable(status)).first()[0] == 12
