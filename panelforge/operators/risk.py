"""Factor covariance, forecast scaling, portfolio risk and forecast tests on long tables.

Panels are (factor, session, x), matrices (i, j, cov) with i <= j. A factor panel has a row per factor and
session and a matrix a row per pair of factors: both follow the model's size, not the number of entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.timeseries import decayed_sums
from panelforge.sources.store import stored


def ewma_weights(sessions: DataFrame, session: str, half_life: float) -> DataFrame:
    """session, age and its weight, which halves every half life and sums to one."""
    last = sessions.select(session).distinct().agg(F.max(session).alias("_last"))
    aged = sessions.select(session).distinct().crossJoin(F.broadcast(last)).withColumn("k", F.pow(F.lit(0.5), (F.col("_last") - F.col(session)) / half_life))
    total = aged.agg(F.sum("k").alias("_total"))
    return aged.crossJoin(F.broadcast(total)).select(session, (F.col("k") / F.col("_total")).alias("w"))


def lag_moments(panel: DataFrame, factor: str, session: str, x: str, half_life: float, lag: int = 0) -> DataFrame:
    """i, j, c: weighted sum of x_i at (s - lag) times x_j at s, weights on the later; all pairs of factors.

    Weights are normalised over all sessions, so a lag loses the weight of its first ones.
    """
    later = panel.join(ewma_weights(panel, session, half_life), session).select(F.col(factor).alias("j"), F.col(session).alias("s"), F.col(x).alias("xj"), "w")
    earlier = panel.select(F.col(factor).alias("i"), (F.col(session) + lag).alias("s"), F.col(x).alias("xi"))
    return later.join(earlier, "s").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("xi") * F.col("xj")).alias("c"))


def serial_covariance(panel: DataFrame, factor: str, session: str, x: str, half_life: float, lags: int) -> DataFrame:
    """i, j (i <= j), cov with Bartlett-weighted lags in both directions: all lags in one join of the panel with itself.

    The panel is written first, as it is read several times; it has a row per factor and session.
    """
    panel = stored(panel.select(factor, session, x), "factor-panel")
    later = panel.join(ewma_weights(panel, session, half_life), session).select(F.col(factor).alias("j"), F.col(x).alias("xj"), "w", F.col(session).alias("at"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    later = later.withColumn("s", F.col("at") - F.col("lag"))
    earlier = panel.select(F.col(factor).alias("i"), F.col(session).alias("s"), F.col(x).alias("xi"))
    # A lag counts with its transpose: once in either order of two factors, twice for one with itself.
    times = F.when(F.col("lag") == 0, (F.col("i") <= F.col("j")).cast("double")).otherwise((1 - F.col("lag") / (lags + 1)) * F.when(F.col("i") == F.col("j"), 2.0).otherwise(1.0))
    c = F.sum(times * F.col("w") * F.col("xi") * F.col("xj"))
    return later.join(earlier, "s").groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(c.alias("cov"))


def mirrored(cov: DataFrame) -> DataFrame:
    """The whole matrix from its upper triangle."""
    return cov.unionByName(cov.filter("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def one_day_sigma(panel: DataFrame, factor: str, session: str, x: str, half_life: float, least: int, name: str = "sigma") -> DataFrame:
    """The forecast made before each session: decayed mean square of the earlier ones, null under ``least``."""
    before = Window.partitionBy(factor).orderBy(session).rangeBetween(Window.unboundedPreceding, -1)
    found = F.col(x).isNotNull()
    rows = panel.withColumn("_seen", F.count(x).over(before))
    rows = decayed_sums(rows, [factor], session, {"_square": F.col(x) * F.col(x), "_weight": found.cast("double")}, half_life, strict=True)
    # Long after the last observation both sums are below the smallest double: then nothing is known.
    value = F.sqrt(F.try_divide("_square", F.nullif("_weight", F.lit(0.0))))
    return rows.withColumn(name, F.when(F.col("_seen") >= least, value)).drop("_seen", "_square", "_weight")


def regime(panel: DataFrame, session: str, x: str, sigma: str, half_life: float, cap: float = 10.0) -> DataFrame:
    """session, b2 (mean square of capped x / sigma) and lam: root of its decayed recursion, seeded by the first.

    A session without a usable factor keeps the last b2; before the first, lam is 1. One row per session.
    """
    z = F.when(F.col(sigma) > 0, F.least(F.greatest(F.col(x) / F.col(sigma), F.lit(-cap)), F.lit(cap)))
    b2 = panel.groupBy(session).agg(F.avg(z * z).alias("b2")).withColumn("_one", F.lit(0))
    order = Window.partitionBy("_one").orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    b = b2.withColumn("_f", F.last("b2", ignorenulls=True).over(order)).withColumn("_n", F.count("_f").over(order))
    keep = 0.5 ** (1 / half_life)
    w = F.when(F.col("_n") == 1, F.col("_f")).when(F.col("_n") > 1, (1 - keep) * F.col("_f"))
    s = decayed_sums(b, ["_one"], "_n", {"_state": w}, half_life)
    return s.select(session, "b2", F.when(F.col("_n") > 0, F.sqrt("_state")).otherwise(1.0).alias("lam"))


def specific_variance(panel: DataFrame, sid: str, session: str, u: str, window: int, half_life: float, lags: int, lag_half_life: float) -> DataFrame:
    """sid, n, v0, ratio and variance from each entity's last observations, gaps skipped.

    v0 is the decayed mean square; ratio the serial-correlation multiplier, bounded to [0.25, 4].
    """
    newest = Window.partitionBy(sid).orderBy(F.col(session).desc())
    x = panel.filter(F.col(u).isNotNull()).withColumn("_age", F.row_number().over(newest) - 1).filter(F.col("_age") < window)
    older = Window.partitionBy(sid).orderBy(session)
    w = lambda hl: F.pow(F.lit(0.5), F.col("_age") / F.lit(float(hl)))
    x = x.withColumns({f"_l{k}": F.lag(u, k).over(older) for k in range(1, lags + 1)})
    c = lambda k: F.sum(w(lag_half_life) * F.col(u) * F.col(f"_l{k}" if k else u)) / F.sum(w(lag_half_life))
    serial = sum((2 * (1 - k / (lags + 1)) * F.coalesce(c(k), F.lit(0.0)) for k in range(1, lags + 1)), c(0))
    found = x.groupBy(sid).agg(F.count("*").alias("n"), (F.sum(w(half_life) * F.col(u) * F.col(u)) / F.sum(w(half_life))).alias("v0"), F.try_divide(serial, F.nullif(c(0), F.lit(0.0))).alias("ratio"))
    return found.withColumn("variance", F.col("v0") * F.least(F.greatest("ratio", F.lit(0.25)), F.lit(4.0)))


def decompose(exposures: DataFrame, cov: DataFrame) -> DataFrame:
    """factor, x, contribution (Euler share of the factor variance), sigma of the whole. exposures: factor, x."""
    full = mirrored(cov).join(exposures.select(F.col("factor").alias("j"), F.col("x").alias("xj")), "j")
    own = full.groupBy("i").agg(F.sum(F.col("cov") * F.col("xj")).alias("fx")).withColumnRenamed("i", "factor")
    parts = exposures.join(own, "factor").withColumn("contribution", F.col("x") * F.col("fx"))
    total = parts.agg(F.sqrt(F.greatest(F.sum("contribution"), F.lit(0.0))).alias("sigma"))
    return parts.crossJoin(F.broadcast(total)).select("factor", "x", "contribution", F.try_divide("fx", F.nullif("sigma", F.lit(0.0))).alias("mctr"), "sigma")


def exposures_of(weights: DataFrame, loadings: DataFrame) -> DataFrame:
    """factor, x: weighted sum of the holdings' loadings. weights: sid, w; loadings: sid, factor, value."""
    return loadings.join(weights, "sid").groupBy("factor").agg(F.sum(F.col("w") * F.col("value")).alias("x"))


def forecast_tests(tests: DataFrame, by: Sequence[str], b: str, order: str, window: int = 12) -> DataFrame:
    """by, n, bias (deviation of standardised returns), mrad (mean distance of rolling deviations from 1), qlike."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    x = tests.filter(F.col(b).isNotNull()).withColumn("_r", F.when(F.count(b).over(w) == window, F.stddev_samp(b).over(w)))
    b2 = F.col(b) * F.col(b) + 1e-12
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_samp(b).alias("bias"), F.avg(F.abs(F.col("_r") - 1)).alias("mrad"), F.avg(b2 - F.ln(b2)).alias("qlike"))


def spaced(sessions: DataFrame, session: str, gap: int) -> DataFrame:
    """Every session at least ``gap`` after the last chosen one, from the first on; sessions are a calendar."""
    one = sessions.select(session).distinct().agg(F.array_sort(F.collect_list(session)).alias("all"))
    start = F.struct(F.array().cast(f"array<{dict(sessions.dtypes)[session]}>").alias("chosen"))
    step = lambda a, s: F.struct(F.when((F.size(a["chosen"]) == 0) | (s - F.try_element_at(a["chosen"], F.lit(-1)) >= gap), F.concat(a["chosen"], F.array(s))).otherwise(a["chosen"]).alias("chosen"))
    return one.select(F.explode(F.aggregate("all", start, step)["chosen"]).alias(session))
