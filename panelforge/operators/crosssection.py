"""Operators on cross-sections: robust and weighted moments, standardisation, one-regressor fits, groups.

A cross-section is all rows of one key (a date). Moments are aggregated with map-side combine and joined
back by key, so a row is shuffled at most by the join; the moment table has a row per key. Rows whose value
is null have a null result and take no part in moments; nothing is ever NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.timeseries import running
from panelforge.sources.store import stored

#: Scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.4826


def attach(df: DataFrame, by: Sequence[str], where: Column | None = None, **aggregates: Column) -> DataFrame:
    """df with aggregates of the rows of its key; ``where`` limits the rows that are aggregated."""
    some = df if where is None else df.filter(where)
    return df.join(some.groupBy(*by).agg(*(a.alias(n) for n, a in aggregates.items())), list(by), "left")


def weighted_mean(x: str, w: str) -> Column:
    """Over rows with both."""
    ok = F.col(x).isNotNull() & F.col(w).isNotNull()
    return F.try_divide(F.sum(F.when(ok, F.col(w) * F.col(x))), F.sum(F.when(ok, F.col(w))))


def weighted_corr(x: str, y: str, w: str, least: int = 3) -> Column:
    """Weighted Pearson correlation over rows with all three; null under ``least`` rows or without variance."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(w).isNotNull()
    s = lambda c: F.sum(F.when(ok, F.col(w) * c)) / F.nullif(F.sum(F.when(ok, F.col(w))), F.lit(0.0))
    mx, my = s(F.col(x)), s(F.col(y))
    vx, vy = s(F.col(x) * F.col(x)) - mx * mx, s(F.col(y) * F.col(y)) - my * my
    good = (F.count(F.when(ok, 1)) >= least) & (vx > 0) & (vy > 0)
    return F.when(good, F.try_divide(s(F.col(x) * F.col(y)) - mx * my, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))))


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: dict[str, float], size: str | None = None) -> DataFrame:
    """by and, for each name, the exact quantile of the not-null x of the key, linear between ranks; size: their number.

    Rows are counted by value first, in each task, so that a value of many rows costs one; ranks are found in the running sum of
    the counts over a sort of the values of all keys.
    """
    counted = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    found = running(counted, by, ["_x"], F.col("_n"), "_upto", "_size")
    picks = []
    for name, q in shares.items():
        at = (F.col("_size") - 1) * F.lit(q)
        lo, hi = (F.min(F.when(F.col("_upto") > f(at), F.col("_x"))) for f in (F.floor, F.ceil))
        picks.append((lo + (F.max(at) - F.floor(F.max(at))) * (hi - lo)).alias(name))
    return found.groupBy(*by).agg(*picks, *([F.max("_size").alias(size)] if size else []))


#: Shares of the values around a median that are looked at one by one, and the accuracy of the sketch that finds them.
NEAR, ACCURACY = 0.001, 10_000


def medians(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """by and, for each name, the exact median of its not-null values; df is read several times and should be stored.

    A sketch brackets each median; the values below the bracket are counted, and only those inside, about 2 * NEAR of all, are
    shuffled and ranked. Medians that their bracket turns out not to hold are found by ``quantiles`` over all their values.
    """
    x = df.select(*by, *(c.cast("double").alias(n) for n, c in columns.items()))
    ends = F.array(F.lit(0.5 - NEAR), F.lit(0.5 + NEAR))
    sketch = x.groupBy(*by).agg(*(F.struct(F.percentile_approx(n, ends, ACCURACY).alias("at"), F.count(n).alias("n")).alias(f"_b_{n}") for n in columns))
    sketch = stored(sketch, "brackets")
    lo, hi = (lambda n, k=k: F.get(F.col(f"_b_{n}.at"), k) for k in (0, 1))
    inside = lambda n: F.col(n).between(lo(n), hi(n))
    near = x.join(sketch, list(by)).filter(reduce(lambda a, b: a | b, (F.coalesce(inside(n), F.lit(False)) for n in columns)))
    values = near.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), F.when(inside(n), F.col(n)).alias("_x")) for n in columns)))).filter("_x IS NOT NULL")
    counted = values.groupBy(*by, "_name", "_x").agg(F.count("*").alias("_n"))
    below = x.join(sketch, list(by)).groupBy(*by).agg(*(F.count_if(F.col(n) < lo(n)).alias(n) for n in columns))
    below = below.join(sketch, list(by)).select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(n).alias("_below"), F.col(f"_b_{n}.n").alias("_all")) for n in columns)))).filter("_all > 0")
    ranked = running(counted, [*by, "_name"], ["_x"], F.col("_n"), "_upto", "_size").join(below, [*by, "_name"])
    at = (F.col("_all") - 1) / 2
    upto = F.col("_below") + F.col("_upto")
    first, second = (F.min(F.when(upto > f(at), F.col("_x"))) for f in (F.floor, F.ceil))
    holds = F.bool_and((F.col("_below") <= F.floor(at)) & (F.col("_below") + F.col("_size") > F.ceil(at)))
    found = stored(ranked.groupBy(*by, "_name").agg(holds.alias("_holds"), ((first + second) / 2).alias("_m")), "medians")
    missed = below.join(found.filter("_holds"), [*by, "_name"], "left_anti").select(*by, "_name")
    if not missed.isEmpty():
        rest = x.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(n).alias("_x")) for n in columns)))).join(missed, [*by, "_name"], "left_semi")
        found = found.filter("_holds").unionByName(quantiles(rest, [*by, "_name"], "_x", {"_m": 0.5}).withColumn("_holds", F.lit(True)))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == n, F.col("_m"))).alias(n) for n in columns))


def robust_centre(df: DataFrame, by: Sequence[str], x: str, where: Column) -> DataFrame:
    """df with _med and _mad of x over the rows of ``where``."""
    df = df.join(quantiles(df.filter(where), by, x, {"_med": 0.5}), list(by), "left")
    off = df.filter(where).select(*by, F.abs(F.col(x) - F.col("_med")).alias("_off"))
    return df.join(quantiles(off, by, "_off", {"_mad": 0.5}), list(by), "left")


def robust_z(df: DataFrame, by: Sequence[str], x: str, where: Column, name: str = "z") -> DataFrame:
    """Deviation from the median in scaled median absolute deviations; 0 where that deviation is 0."""
    z = F.when(F.col("_mad") > 0, (F.col(x) - F.col("_med")) / (MAD_SCALE * F.col("_mad"))).otherwise(F.when(F.col(x).isNotNull(), F.lit(0.0)))
    return robust_centre(df, by, x, where).withColumn(name, z).drop("_med", "_mad")


def mad_clip(df: DataFrame, by: Sequence[str], x: str, where: Column, k: float, name: str = "clipped") -> DataFrame:
    """x within k scaled deviations of the median; unchanged where the deviation is 0."""
    reach = F.lit(k * MAD_SCALE) * F.col("_mad")
    clipped = F.when(F.col(x).isNull() | ~(F.col("_mad") > 0) | F.col("_mad").isNull(), F.col(x)).otherwise(F.least(F.greatest(F.col(x), F.col("_med") - reach), F.col("_med") + reach))
    return robust_centre(df, by, x, where).withColumn(name, clipped).drop("_med", "_mad")


def trim_sigma(df: DataFrame, by: Sequence[str], x: str, where: Column, k: float = 3.0, name: str = "trimmed") -> DataFrame:
    """x within k population deviations of the equal-weighted mean of ``where``."""
    df = attach(df, by, where, _m=F.avg(x), _s=F.stddev_pop(x))
    clipped = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_m") - k * F.col("_s")), F.col("_m") + k * F.col("_s")))
    return df.withColumn(name, clipped).drop("_m", "_s")


def standardize(df: DataFrame, by: Sequence[str], x: str, cap: str, where: Column, name: str = "std") -> DataFrame:
    """(x - cap-weighted mean) / equal-weighted population deviation, both over ``where``, for all rows."""
    df = attach(df, by, where, _m=weighted_mean(x, cap), _s=F.stddev_pop(x))
    return df.withColumn(name, F.when(F.col("_s") > 0, (F.col(x) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def combine(weights: dict[str, float]) -> Column:
    """Weighted mean of a row's columns, weights renormalised over those that are not null."""
    total = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    return F.try_divide(value, F.nullif(total, F.lit(0.0)))


def orthogonalize(df: DataFrame, by: Sequence[str], y: str, x: str, w: str, fit: Column, name: str = "resid") -> DataFrame:
    """Residual of the weighted fit y ~ 1 + x over ``fit``, for all rows with both."""
    df = attach(df, by, fit & F.col(y).isNotNull() & F.col(x).isNotNull(), _my=weighted_mean(y, w), _mx=weighted_mean(x, w))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    df = attach(df, by, fit & F.col(y).isNotNull() & F.col(x).isNotNull(), _b=F.try_divide(F.sum(F.col(w) * dx * dy), F.nullif(F.sum(F.col(w) * dx * dx), F.lit(0.0))))
    return df.withColumn(name, dy - F.coalesce("_b", F.lit(0.0)) * dx).drop("_my", "_mx", "_b")


def impute(df: DataFrame, by: Sequence[str], x: str, group: str, covariate: str, w: str, fit: Column, name: str = "filled") -> DataFrame:
    """Nulls of x from the weighted fit x ~ group dummies + covariate over ``fit``; 0 where the fit says nothing.

    By partialling out, the slope is the weighted within-group slope and a group's level its means'.
    """
    ok = fit & F.col(x).isNotNull() & F.col(covariate).isNotNull()
    df = attach(df, [*by, group], ok, _mx=weighted_mean(x, w), _mc=weighted_mean(covariate, w))
    dx, dc = F.col(x) - F.col("_mx"), F.col(covariate) - F.col("_mc")
    df = attach(df, by, ok, _b=F.try_divide(F.sum(F.col(w) * dc * dx), F.nullif(F.sum(F.col(w) * dc * dc), F.lit(0.0))))
    fitted = F.col("_mx") + F.coalesce("_b", F.lit(0.0)) * dc
    return df.withColumn(name, F.coalesce(F.col(x), fitted, F.lit(0.0))).drop("_mx", "_mc", "_b")


def edge_groups(df: DataFrame, by: Sequence[str], x: str, k: int, name: str = "decile") -> DataFrame:
    """Number of quantile edges (1/k ... (k-1)/k, linear) at or below x; -1 for keys with fewer than k rows."""
    names = [f"_q{i}" for i in range(1, k)]
    df = df.join(quantiles(df, by, x, {n: i / k for i, n in enumerate(names, 1)}, "_n"), list(by), "left")
    place = sum(((F.col(x) >= F.col(n)).cast("int") for n in names), F.lit(0))
    return df.withColumn(name, F.when(F.col(x).isNull(), None).when(F.col("_n") < k, -1).otherwise(place).cast("int")).drop(*names, "_n")


def shrink(df: DataFrame, by: Sequence[str], sigma: str, cap: str, q: float, name: str = "shrunk") -> DataFrame:
    """Each sigma drawn toward its group's cap-weighted mean, the more the further it lies off in group deviations."""
    df = attach(df, by, F.col(sigma).isNotNull(), _m=weighted_mean(sigma, cap))
    df = df.withColumn("_d", F.abs(F.col(sigma) - F.col("_m")))
    df = attach(df, by, F.col(sigma).isNotNull(), _delta=F.sqrt(F.avg(F.col("_d") * F.col("_d"))))
    v = F.coalesce(F.try_divide(q * F.col("_d"), F.nullif(F.col("_delta") + q * F.col("_d"), F.lit(0.0))), F.lit(0.0))
    return df.withColumn(name, v * F.col("_m") + (1 - v) * F.col(sigma)).drop("_m", "_d", "_delta")


def coverage_gamma(x: str, h_min: int, h_ramp: int) -> Column:
    """Trust in a time-series estimate: enough observations, and a deviation near the robust one. An aggregate."""
    n, s = F.count(x), F.stddev_samp(x)
    robust = (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))) / 1.35
    z = F.abs(F.try_divide(s - robust, F.when(robust > 0, robust)))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.when(n < 2, 0.0).otherwise(unit((n - h_min) / F.lit(float(h_ramp))) * F.coalesce(unit(F.exp(1 - z)), F.lit(0.0)))


def share(df: DataFrame, by: Sequence[str], x: str, name: str = "share") -> DataFrame:
    """df with x over the sum of its key, by an aggregate that is joined back."""
    return attach(df, by, _total=F.sum(x)).withColumn(name, F.try_divide(F.col(x), F.nullif("_total", F.lit(0.0)))).drop("_total")
