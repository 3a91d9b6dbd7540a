"""Style exposures on one made-up date and a thin one, regressions against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import exposures as ex
from panelforge.plans import registry

MODEL = ex.StyleModel(
    weights={"size": {"ln": 1.0}, "beta": {"hb": 1.0}, "value": {"btop": 1.0}, "growth": {"eg": 0.3, "sg": 0.7}, "vol": {"dastd": 1.0}},
    size="size", cubes={"size3": "size", "beta3": "beta"}, targets={"vol": ["beta", "size"], "size3": ["size"], "beta3": ["beta"]}, unclipped=["ln"],
)
N = 400


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for k in range(N):
        cap = math.exp(r.gauss(10, 1.5))
        hb = None if r.random() < 0.05 else r.gauss(1, 0.3)
        btop = 1e6 if k == 5 else r.gauss(0.5, 0.2)
        eg, sg = (None if r.random() < 0.3 else r.gauss(0, 1) for _ in range(2))
        dastd = 0.02 + 0.005 * (hb or 1) + 0.003 * r.gauss(0, 1)
        out.append((1, k, f"i{k % 5}" if k % 40 else None, cap, math.sqrt(cap), k % 10 != 9, k % 10 not in (8, 9), math.log(cap), hb, btop, eg, sg, dastd))
    return out + [(2, *row[1:]) for row in out[:20]]


SCHEMA = "date int, sid int, industry string, cap double, w double, in_cov boolean, in_estu boolean, ln double, hb double, btop double, eg double, sg double, dastd double"


@pytest.fixture(scope="module")
def built(spark, rows):
    found, counts = ex.build_exposures(spark.createDataFrame(rows, SCHEMA).repartition(4), "date", "cap", "w", "industry", MODEL)
    return found, {r.sid: r for r in found.collect()}, {r.descriptor: r for r in counts.collect()}


def test_moments_of_every_style(built, rows):
    _, found, _ = built
    assert len(found) == N * 9 // 10 and {r.date for r in found.values()} == {1}  # the second date has too few
    estu = [r for r in found.values() if r.in_estu]
    for s in MODEL.styles:
        assert all(r[s] is not None for r in found.values())
        x, cap = np.array([r[s] for r in estu]), np.array([r.cap for r in estu])
        assert abs((cap * x).sum() / cap.sum()) < 1e-9 and abs(x.std() - 1) < 1e-9


def test_styles_are_orthogonal_after_imputing(built):
    estu = [r for r in built[1].values() if r.in_estu]
    w = np.array([r.w for r in estu])
    for s, targets in MODEL.targets.items():
        for t in targets:
            x, y = (np.array([r[c] for r in estu]) for c in (s, t))
            x, y = x - (w * x).sum() / w.sum(), y - (w * y).sum() / w.sum()
            assert abs((w * x * y).sum()) / math.sqrt((w * x * x).sum() * (w * y * y).sum()) < 1e-9


def test_errors_and_imputation(built, rows):
    _, found, counts = built
    assert counts["btop"].n_error >= 1 and found[5].imp_value
    assert counts["hb"].n_valid == sum(r[8] is not None for r in rows if r[0] == 1 and r[5])
    for r in (r for r in rows if r[0] == 1 and r[5]):
        assert found[r[1]].imp_growth == (r[10] is None and r[11] is None) and found[r[1]].imp_beta == (r[8] is None)


def test_size_is_the_standardised_log(built, rows):
    own = {r[1]: r for r in rows if r[0] == 1 and r[5]}
    estu = [r for r in own.values() if r[6]]
    x, cap = np.array([r[7] for r in estu]), np.array([r[3] for r in estu])
    m, s = (cap * x).sum() / cap.sum(), x.std()
    assert all(built[1][k].size == pytest.approx((r[7] - m) / s, abs=1e-9) for k, r in own.items())


def test_plans_scan_little(built):
    """All styles of all dates: no plan reads more than eight tables."""
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8


def test_registered_chains_scan_little(spark, sf):
    from panelforge.plans import registry

    for name in ("style_exposures", "exposure_chain", "exposure_moments"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 8, name


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fits_on_many_regressors(spark, k):
    """Against least squares, with null rows, a weight that is null, and a regressor that repeats another."""
    r = random.Random(k)
    rows = []
    for d in (1, 2):
        for i in range(60):
            z = [r.gauss(0, 1) for _ in range(k)]
            z = [*z[:-1], z[0]] if d == 2 and k > 1 else z
            rows.append((d, i, 1 + sum(z) * 0.7 + r.gauss(0, 1) if i % 13 else None, r.random() + 0.1 if i % 17 else None, i % 5 != 0, *(z if i % 19 else [None] * k)))
    rows += [(3, i, float(i), 1.0, True, *[float(i)] * k) for i in range(2)]  # too few rows for a fit
    names = [f"z{j}" for j in range(k)]
    df = spark.createDataFrame(rows, "d int, i int, y double, w double, fit boolean, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(q.d, q.i): q.resid for q in ex.orthogonalized(df, ["d"], "y", names, "w", F.col("fit")).collect()}
    for d in (1, 2):
        own = [q for q in rows if q[0] == d]
        ok = [q for q in own if q[4] and None not in q]
        a, sw = np.array([[1, *q[5:]] for q in ok]), np.sqrt([q[3] for q in ok])
        b = np.linalg.lstsq(a * sw[:, None], np.array([q[2] for q in ok]) * sw, rcond=None)[0]
        for q in own:
            want = None if q[2] is None or q[5] is None else q[2] - b @ np.array([1, *q[5:]])
            assert got[d, q[1]] is None if want is None else got[d, q[1]] == pytest.approx(want, abs=1e-8)
    assert [got[3, i] for i in range(2)] == [0.0, 1.0]


@pytest.mark.parametrize("near", [0.001, -0.2])
def test_medians_are_exact(spark, monkeypatch, near):
    """Ties, nulls, one value and none; with brackets that hold no median all are found over all values."""
    import statistics

    from panelforge.operators import crosssection as cs

    monkeypatch.setattr(cs, "NEAR", near)
    rows = [(k % 3, (k * 7919 % 5003) / 7, float(k % 4) if k % 5 else None, 1.5 if k == 0 else None) for k in range(5000)]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double").repartition(7)
    found = {r.g: (r.a, r.b, r.c) for r in cs.medians(df, ["g"], {"a": df.x, "b": df.y, "c": df.z}).collect()}
    own = lambda g, i: [r[i] for r in rows if r[0] == g and r[i] is not None]
    assert found == {g: tuple(statistics.median(own(g, i)) if own(g, i) else None for i in (1, 2, 3)) for g in range(3)}


def test_rows_are_made_once_and_counts_without_exposures(spark, sf, monkeypatch):
    tags = []
    monkeypatch.setattr(ex, "stored", lambda df, tag, stored=ex.stored: tags.append(tag) or stored(df, tag))
    assert registry.QUERIES["descriptor_counts"](spark, sf).count() > 0
    assert tags == ["rows", "descriptors"]


def test_moments_without_a_table_between(spark, sf, monkeypatch):
    from panelforge.plans import styles

    tags = []
    monkeypatch.setattr(styles, "stored", lambda df, tag, stored=styles.stored: tags.append(tag) or stored(df, tag))
    assert registry.QUERIES["style_qa"](spark, sf).columns and tags == []
