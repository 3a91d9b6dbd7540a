"""A model of one date as tables, and the risk of portfolios in factor form: by factor, by group and by asset.

Assets are rows with their few loadings as an array; a matrix of assets by assets is never made. Exposures are one aggregate
over the held assets. What a portfolio adds to the assets' rows is a map of factors, of which there are few, so marginals of millions of
assets are computed where the rows lie: the maps are sent along below a checked size, else joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.risk import mirrored

COUNTRY = "country"
#: The most portfolio maps, in cells of portfolios by factors, that go to every task.
SENT_CELLS = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    """assets: sid, ticker, mcap, in_estu, spec_var, loads (array of factor, value). cov: i, j, cov with i <= j. groups: factor, group."""

    assets: DataFrame
    cov: DataFrame
    groups: DataFrame


def assemble(exposures: DataFrame, specific: DataFrame, universe: DataFrame, cov: DataFrame, styles: Sequence[str]) -> Snapshot:
    """The date's tables joined: assets with exposures and a specific risk, and what the universe says of them.

    exposures: sid, industry, styles; specific: sid, sigma; universe: sid, ticker, mcap, in_estu. An asset whose industry
    has no factor in the covariance is an error; one without an industry loads on country and styles only.
    """
    factors = cov.select(F.explode(F.array("i", "j")).alias("factor")).distinct()
    x = exposures.join(factors.select(F.col("factor").alias("industry"), F.lit(True).alias("_known")), "industry", "left")
    bad = F.col("industry").isNotNull() & F.col("_known").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no factor for industry "), "industry")).cast("string")).otherwise(F.col("industry"))
    load = lambda name, value: F.struct(name.alias("factor"), value.cast("double").alias("value"))
    loads = F.filter(F.array(load(F.lit(COUNTRY), F.lit(1.0)), load(checked, F.lit(1.0)), *(load(F.lit(s), F.col(s)) for s in styles)), lambda v: v["factor"].isNotNull() & v["value"].isNotNull())
    assets = x.select("sid", loads.alias("loads")).join(specific.select("sid", (F.col("sigma") * F.col("sigma")).alias("spec_var")), "sid").join(universe.select("sid", "ticker", "mcap", "in_estu"), "sid", "left")
    group = F.when(F.col("factor") == COUNTRY, "country").when(F.col("factor").isin(list(styles)), "style").otherwise("industry")
    return Snapshot(assets.withColumns({"in_estu": F.coalesce("in_estu", F.lit(False)), "ticker": F.coalesce("ticker", F.lit(""))}), cov, factors.withColumn("group", group))


def market(snap: Snapshot) -> DataFrame:
    """sid, w: the estimation universe by market value."""
    held = snap.assets.filter(F.col("in_estu") & (F.col("mcap") > 0)).select("sid", "mcap")
    total = held.agg(F.sum("mcap").alias("t"))
    return held.crossJoin(F.broadcast(total)).select("sid", (F.col("mcap") / F.col("t")).alias("w"))


def unmatched(snap: Snapshot, holdings: DataFrame) -> DataFrame:
    """portfolio, ticker of holdings that the model doesn't have."""
    return holdings.join(snap.assets.select("ticker").distinct(), "ticker", "left_anti").select("portfolio", "ticker")


@dataclass(frozen=True)
class Report:
    """totals: a row a portfolio; factors, groups and assets: its tables."""

    totals: DataFrame
    factors: DataFrame
    groups: DataFrame
    assets: DataFrame


def portfolio_risk(snap: Snapshot, holdings: DataFrame) -> Report:
    """Risk of each portfolio, or of what it holds beyond its benchmark where it has one.

    holdings: portfolio, sid, weight, bench_weight (null throughout for portfolios without a benchmark, whose betas are to the market). Assets
    that the model doesn't have don't count, see unmatched. A portfolio that holds nothing has no risk and no marginals.
    """
    h = holdings.groupBy("portfolio", "sid").agg(F.sum("weight").alias("h"), F.sum("bench_weight").alias("own_b"))
    active = h.groupBy("portfolio").agg((F.count("own_b") > 0).alias("active"))
    h = h.join(active, "portfolio")
    base = market(snap).crossJoin(active.filter("NOT active").select("portfolio")).select("portfolio", "sid", F.col("w").alias("mb"))
    h = h.join(base, ["portfolio", "sid"], "full")
    b = F.coalesce("own_b", "mb", F.lit(0.0))
    own = F.coalesce("h", F.lit(0.0))
    w = own - F.when(F.col("active"), F.coalesce("own_b", F.lit(0.0))).otherwise(0.0)
    held = h.select("portfolio", "sid", own.alias("h"), w.alias("w"), b.alias("b")).join(snap.assets.select("sid", "loads", "spec_var"), "sid")
    long = held.select("portfolio", "w", "b", F.inline("loads"))
    x = long.groupBy("portfolio", "factor").agg(F.sum(F.col("w") * F.col("value")).alias("x"), F.sum(F.col("b") * F.col("value")).alias("xb"))
    full = mirrored(snap.cov)
    fx = full.join(x.withColumnRenamed("factor", "j"), "j").groupBy("portfolio", F.col("i").alias("factor")).agg(F.sum(F.col("cov") * F.col("x")).alias("fx"), F.sum(F.col("cov") * F.col("xb")).alias("fxb"))
    fx = fx.join(x, ["portfolio", "factor"], "left").na.fill(0.0, ["x", "xb"])
    parts = fx.groupBy("portfolio").agg(F.sum(F.col("x") * F.col("fx")).alias("factor_var"), F.sum(F.col("xb") * F.col("fxb")).alias("bench_factor"), F.map_from_entries(F.collect_list(F.struct("factor", "fx"))).alias("fx"), F.map_from_entries(F.collect_list(F.struct("factor", "fxb"))).alias("fxb"))
    specific = held.groupBy("portfolio").agg(F.sum(F.col("w") * F.col("w") * F.col("spec_var")).alias("specific_var"), F.sum(F.col("b") * F.col("b") * F.col("spec_var")).alias("bench_specific"))
    sums = active.join(parts, "portfolio").join(specific, "portfolio").withColumns({"sigma": F.sqrt(F.greatest(F.col("factor_var") + F.col("specific_var"), F.lit(0.0))), "var_b": F.col("bench_factor") + F.col("bench_specific")})
    few = F.broadcast if active.count() * max(1, snap.groups.count()) <= SENT_CELLS else lambda df: df
    dot = lambda m: F.aggregate("loads", F.lit(0.0), lambda a, v: a + v["value"] * F.coalesce(F.try_element_at(m, v["factor"]), F.lit(0.0)))
    rows = snap.assets.select("sid", "ticker", "loads", "spec_var").crossJoin(few(sums.select("portfolio", "fx", "fxb", "sigma", "var_b")))
    rows = rows.join(held.select("portfolio", "sid", "h", "w", "b"), ["portfolio", "sid"], "left").na.fill(0.0, ["h", "w", "b"])
    over = lambda value, by: F.try_divide(value, F.nullif(by, F.lit(0.0)))
    mctr = F.coalesce(over(dot(F.col("fx")) + F.col("spec_var") * F.col("w"), F.col("sigma")), F.lit(0.0))
    beta = over(dot(F.col("fxb")) + F.col("spec_var") * F.col("b"), F.col("var_b"))
    assets = rows.select("portfolio", "sid", "ticker", "h", F.col("w").alias("weight"), mctr.alias("mctr"), (F.col("w") * mctr).alias("contrib"), F.coalesce(over(F.col("w") * mctr, F.col("sigma")), F.lit(0.0)).alias("pct_risk"), beta.alias("beta"))
    betas = assets.groupBy("portfolio").agg(F.sum(F.col("h") * F.col("beta")).alias("beta"))
    totals = sums.join(betas, "portfolio").select("portfolio", "active", "sigma", "factor_var", "specific_var", "beta")
    vol = full.filter("i = j").select(F.col("i").alias("factor"), F.sqrt("cov").alias("vol"))
    total = F.col("sigma") * F.col("sigma")
    corr = F.coalesce(over(F.col("fx"), F.col("vol") * F.col("sigma")), F.lit(0.0))
    table = fx.join(vol, "factor").join(snap.groups, "factor").join(sums.select("portfolio", "sigma"), "portfolio")
    factors = table.select("portfolio", "factor", "group", F.col("x").alias("exposure"), "vol", corr.alias("corr"), (F.col("x") * F.col("vol") * corr).alias("xsr"), (F.col("x") * F.col("fx")).alias("contrib_var"), F.coalesce(over(F.col("x") * F.col("fx"), total), F.lit(0.0)).alias("pct_var"))
    groups = factors.groupBy("portfolio", "group").agg(F.sum("contrib_var").alias("contrib_var")).unionByName(totals.select("portfolio", F.lit("specific").alias("group"), F.col("specific_var").alias("contrib_var")))
    groups = groups.join(totals.select("portfolio", "sigma"), "portfolio").select("portfolio", "group", "contrib_var", F.coalesce(over(F.col("contrib_var"), total), F.lit(0.0)).alias("pct_var"))
    return Report(totals, factors, groups, assets.drop("h"))
