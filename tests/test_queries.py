"""Every registered query of the library against the SQL that a second engine runs on the same tables."""

import pytest
from oracle import difference

from panelforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(name, spark, sf, duck):
    assert difference(registry.QUERIES[name](spark, sf), duck, registry.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf):
    df = registry.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_flagship():
    assert registry.FLAGSHIP in registry.QUERIES


def test_unknown_values_are_errors(spark):
    from panelforge import functions as fn

    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert [r[0] for r in df.select(fn.strict_map(df.x, {"a": 1})).collect()] == [1, None]
    with pytest.raises(Exception, match="unknown value"):
        df.select(fn.strict_map(df.x, {"b": 1})).collect()


def test_weights_are_the_best(spark, sf):
    """No shift of weight between two factors that the bounds allow raises the objective."""
    import numpy as np

    from panelforge.plans import risks

    w = {r.factor: r.weight for r in registry.QUERIES["optimal_weights"](spark, sf).collect()}
    names = sorted(w)
    at = {n: k for k, n in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for i, j, c in risks._cov(spark, sf).collect():
        cov[at[i], at[j]] = cov[at[j], at[i]] = c
    alpha = np.zeros(len(names))
    for r in risks._panel(spark, sf).groupBy("factor").avg("ret").collect():
        alpha[at[r[0]]] = r[1] / 10
    x = np.array([w[n] for n in names])
    assert abs(x.sum() - 1) < 1e-4 and x.min() >= -1e-6 and x.max() <= max(0.1, 1 / len(names)) + 1e-6
    slope = alpha - 4.0 * cov @ x
    give, take = x > 1e-4, x < max(0.1, 1 / len(names)) - 1e-4
    assert slope[take].max() <= slope[give].min() + 2e-4


def test_ranks_over_partitions(spark):
    from panelforge.operators import crosssection as cs
    from panelforge.operators import timeseries as ts

    rows = [(k % 2, (k * 7919) % 1000) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    got = {(r.g, r.rank): r.x for r in ts.ranked(df, ["g"], ["x"]).collect()}
    for g in (0, 1):
        own = sorted(x for k, x in rows if k == g)
        assert [got[g, n + 1] for n in range(len(own))] == own
        middle = (own[len(own) // 2 - 1] + own[len(own) // 2]) / 2
        assert {r.g: r.m for r in cs.quantiles(df, ["g"], "x", {"m": 0.5}).collect()}[g] == middle
