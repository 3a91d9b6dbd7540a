"""A snapshot of customers as assets, and the risk of two portfolios of them by asset, factor and group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import snapshot as sn
from panelforge.plans.panels import YEARS, cross_years, r, table
from panelforge.plans.registry import query
from panelforge.plans.risks import _COV, _cov
from panelforge.plans.staged import BRANDS
from panelforge.sources.store import stored

# The year's customers are the assets; the returns of the first brands stand for those of the factors.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FACTORS = dict(zip(BRANDS, ["country", *SEGMENTS, "size", "value"]))

_SNAP = f"""{_COV}, {YEARS}, names(brand, factor) AS (VALUES {', '.join(f"('{b}', '{f}')" for b, f in FACTORS.items())}),
fc AS (SELECT a.factor AS i, b.factor AS j, cov FROM cov JOIN names a ON a.brand = i JOIN names b ON b.brand = j), ff AS (SELECT i, j, cov FROM fc UNION ALL SELECT j, i, cov FROM fc WHERE i <> j),
ast AS (SELECT sid, industry, ln(cap) - 11.5 AS size, acct / 5000 AS value, pow(0.02 + mean_order / 5e6, 2) AS spec, cap, in_estu FROM p WHERE year = 1997),
ld AS (SELECT sid, 'country' AS factor, 1.0 AS v FROM ast UNION ALL SELECT sid, industry, 1.0 FROM ast UNION ALL SELECT sid, 'size', size FROM ast UNION ALL SELECT sid, 'value', value FROM ast),
ho AS (SELECT 'long' AS portfolio, sid, acct / (SELECT sum(acct) FROM p WHERE year = 1997 AND acct > 5000) AS h, NULL AS ob FROM p WHERE year = 1997 AND acct > 5000
  UNION ALL SELECT 'active', sid, CASE WHEN sid % 3 = 0 THEN 1.0 / count(*) FILTER (WHERE sid % 3 = 0) OVER () ELSE 0 END, CASE WHEN sid % 2 = 0 THEN 1.0 / count(*) FILTER (WHERE sid % 2 = 0) OVER () ELSE 0 END FROM p WHERE year = 1997),
al AS (SELECT q.portfolio, a.sid, coalesce(h, 0) AS h, coalesce(h, 0) - coalesce(ob, 0) AS w, CASE WHEN q.portfolio = 'active' THEN coalesce(ob, 0) ELSE CASE WHEN in_estu AND cap > 0 THEN cap / (SELECT sum(cap) FROM ast WHERE in_estu AND cap > 0) ELSE 0 END END AS b, spec
  FROM ast a CROSS JOIN (VALUES ('long'), ('active')) q(portfolio) LEFT JOIN ho ON ho.portfolio = q.portfolio AND ho.sid = a.sid),
ex AS (SELECT portfolio, factor, sum(w * v) AS x, sum(b * v) AS xb FROM al JOIN ld USING (sid) GROUP BY ALL),
fx AS (SELECT portfolio, i AS factor, sum(cov * x) AS fx, sum(cov * xb) AS fxb FROM ff JOIN ex ON ex.factor = j GROUP BY ALL),
sp AS (SELECT portfolio, sum(w * w * spec) AS sv, sum(b * b * spec) AS bs FROM al GROUP BY ALL),
tt AS (SELECT portfolio, sum(x * fx) AS fv, sum(xb * fxb) AS bf FROM ex JOIN fx USING (portfolio, factor) GROUP BY ALL),
rt AS (SELECT portfolio, fv, sv, sqrt(fv + sv) AS sigma, bf + bs AS vb FROM tt JOIN sp USING (portfolio)),
ma AS (SELECT al.portfolio, al.sid, h, w, (sum(v * fx) + any_value(spec * w)) / any_value(sigma) AS mctr, (sum(v * fxb) + any_value(spec * b)) / any_value(vb) AS beta, any_value(sigma) AS sigma FROM al JOIN ld USING (sid) JOIN fx USING (portfolio, factor) JOIN rt USING (portfolio) GROUP BY ALL)"""


def _report(spark: SparkSession, sf_dir: str) -> sn.Report:
    x = stored(cross_years(spark, sf_dir).filter("year = 1997"), "assets")
    named = spark.createDataFrame(list(FACTORS.items()), "brand string, factor string")
    cov = _cov(spark, sf_dir)
    for c in ("i", "j"):
        cov = cov.join(F.broadcast(named.withColumnRenamed("brand", c)), c).drop(c).withColumnRenamed("factor", c)
    cov = stored(cov.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cov"), "factor-cov")
    exposures = x.select("sid", "industry", (F.ln("cap") - 11.5).alias("size"), (F.col("acct") / 5000).alias("value"))
    universe = x.select("sid", F.concat(F.lit("C"), "sid").alias("ticker"), F.col("cap").alias("mcap"), "in_estu")
    snap = sn.assemble(exposures, x.select("sid", (F.lit(0.02) + F.col("mean_order") / 5e6).alias("sigma")), universe, cov, ["size", "value"])
    rich = x.filter("acct > 5000")
    long = rich.crossJoin(F.broadcast(rich.agg(F.sum("acct").alias("t")))).select(F.lit("long").alias("portfolio"), "sid", (F.col("acct") / F.col("t")).alias("weight"), F.lit(None).cast("double").alias("bench_weight"))
    n = x.agg(F.count_if(F.col("sid") % 3 == 0).alias("n3"), F.count_if(F.col("sid") % 2 == 0).alias("n2"))
    part = lambda k, c: F.when(F.col("sid") % k == 0, 1 / F.col(c)).otherwise(0.0)
    active = x.crossJoin(F.broadcast(n)).select(F.lit("active").alias("portfolio"), "sid", part(3, "n3").alias("weight"), part(2, "n2").alias("bench_weight"))
    return sn.portfolio_risk(snap, stored(long.unionByName(active), "holdings"))


@query(f"WITH {_SNAP} SELECT portfolio, sid, 'C' || sid AS ticker, round(w, 8) AS weight, round(mctr, 6) AS mctr, round(w * mctr, 8) AS contrib, round(w * mctr / sigma, 6) AS pct_risk, round(beta, 5) AS beta FROM ma")
def asset_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal risk, contribution and beta of every asset to two portfolios, one of them against its benchmark."""
    return _report(spark, sf_dir).assets.select("portfolio", "sid", "ticker", r("weight", 8).alias("weight"), r("mctr").alias("mctr"), r("contrib", 8).alias("contrib"), r("pct_risk").alias("pct_risk"), r("beta", 5).alias("beta"))


@query(f"""WITH {_SNAP} SELECT e.portfolio, factor, CASE WHEN factor = 'country' THEN 'country' WHEN factor IN ('size', 'value') THEN 'style' ELSE 'industry' END AS "group", round(x, 6) AS exposure, round(sqrt(cov), 6) AS vol, round(fx / sqrt(cov) / sigma, 6) AS corr,
round(x * fx / sigma, 8) AS xsr, round(x * fx, 10) AS contrib_var, round(x * fx / sigma / sigma, 6) AS pct_var FROM ex e JOIN fx USING (portfolio, factor) JOIN rt USING (portfolio) JOIN ff ON i = factor AND j = factor""")
def factor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, deviation, correlation and share of each factor in the portfolios' risk."""
    digits = {"exposure": 6, "vol": 6, "corr": 6, "xsr": 8, "contrib_var": 10, "pct_var": 6}
    return _report(spark, sf_dir).factors.select("portfolio", "factor", "group", *(r(c, d).alias(c) for c, d in digits.items()))


@query(f"""WITH {_SNAP}, g AS (SELECT e.portfolio, CASE WHEN factor = 'country' THEN 'country' WHEN factor IN ('size', 'value') THEN 'style' ELSE 'industry' END AS "group", sum(x * fx) AS c FROM ex e JOIN fx USING (portfolio, factor) GROUP BY ALL UNION ALL SELECT portfolio, 'specific', sv FROM rt)
SELECT g.portfolio, "group", round(c, 10) AS contrib_var, round(c / sigma / sigma, 6) AS pct_var, round(sigma, 8) AS sigma, round((SELECT sum(h * beta) FROM ma WHERE ma.portfolio = g.portfolio), 5) AS beta FROM g JOIN rt USING (portfolio)""")
def group_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of groups of factors and of specific risk, with the portfolios' deviation and beta."""
    report = _report(spark, sf_dir)
    totals = report.totals.select("portfolio", r("sigma", 8).alias("sigma"), r("beta", 5).alias("beta"))
    return report.groups.select("portfolio", "group", r("contrib_var", 10).alias("contrib_var"), r("pct_var").alias("pct_var")).join(totals, "portfolio")
