"""The eigenvalue correction: its estimator, and forecasts at every date."""

import numpy as np

from panelforge.operators import dense
from panelforge.plans import registry, risks


def estimator(x):
    return dense.split_covariance(x, 24, 2, 48, 2)


def test_bias_is_the_estimators():
    f = np.diag([1.0, 2.0, 5.0]) + 0.3
    values, vectors = np.linalg.eigh(f)
    rng, ratio = np.random.default_rng(3), np.zeros(3)
    for _ in range(200):
        found, turned = np.linalg.eigh(estimator((rng.standard_normal((60, 3)) * np.sqrt(values)) @ vectors.T))
        ratio += np.diag(turned.T @ f @ turned) / found
    bias = dense.eigen_adjusted(f, 60, 200, 1.0, 3, estimator)[2]
    assert np.allclose(bias, np.sqrt(ratio / 200))
    assert not np.allclose(bias, dense.eigen_adjusted(f, 60, 200, 1.0, 3)[2], rtol=0.02)


def test_every_date_has_its_window(spark, sf):
    got = registry.QUERIES["eigen_adjusted_cov"](spark, sf).toPandas()
    panel = risks._panel(spark, sf).toPandas()
    sessions = sorted(panel["m"].unique())
    assert sorted(got["m"].unique()) == sessions[23:]
    for m in (sessions[23], sessions[-1]):
        wide = panel[panel["m"] <= m].pivot_table(index="m", columns="factor", values="ret").sort_index().fillna(0.0)
        pre, own = estimator(wide.to_numpy()), got[got["m"] == m].sort_values(["factor_i", "factor_j"])
        assert np.allclose(own["cov_pre_eigen"], pre[np.triu_indices(len(pre))], atol=1e-7) and not np.allclose(own["cov_final"], own["cov_pre_eigen"], atol=1e-6)
