"""Queries on cross-sections: universes, standardised exposures, regressions, groups and shrinkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import crosssection as cs
from panelforge.operators import dense
from panelforge.plans.panels import CROSS, YEARS, cross, cross_years, r, table
from panelforge.plans.registry import query

def estu():
    """The rows of the estimation universe."""
    return F.col("in_estu")

_ROBUST = """med AS (SELECT year, median(mean_order) AS med FROM p WHERE in_estu GROUP BY year),
mad AS (SELECT year, any_value(med) AS med, median(abs(mean_order - med)) AS mad FROM p JOIN med USING (year) WHERE in_estu GROUP BY year)"""


@query(f"""WITH {YEARS}, {_ROBUST} SELECT year, sid, round(CASE WHEN mad > 0 THEN (mean_order - med) / (1.4826 * mad) ELSE 0 END, 6) AS z FROM p LEFT JOIN mad USING (year)""")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.robust_z(cross_years(spark, sf_dir), ["year"], "mean_order", estu()).select("year", "sid", r("z").alias("z"))


@query(f"""WITH {YEARS}, {_ROBUST} SELECT year, sid, round(CASE WHEN mad > 0 THEN least(greatest(mean_order, med - 2 * 1.4826 * mad), med + 2 * 1.4826 * mad) ELSE mean_order END, 4) AS clipped FROM p LEFT JOIN mad USING (year)""")
def mad_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.mad_clip(cross_years(spark, sf_dir), ["year"], "mean_order", estu(), 2.0).select("year", "sid", r("clipped", 4).alias("clipped"))


@query(f"""WITH {YEARS}, m AS (SELECT year, avg(acct) AS m, stddev_pop(acct) AS s FROM p WHERE in_estu GROUP BY year)
SELECT year, sid, round(least(greatest(acct, m - 1.5 * s), m + 1.5 * s), 4) AS trimmed FROM p LEFT JOIN m USING (year)""")
def trim_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.trim_sigma(cross_years(spark, sf_dir), ["year"], "acct", estu(), 1.5).select("year", "sid", r("trimmed", 4).alias("trimmed"))


_STD = "std AS (SELECT year, sum(cap * acct) / sum(cap) AS am, stddev_pop(acct) AS sd, sum(cap * mean_order) / sum(cap) AS om, stddev_pop(mean_order) AS so FROM p WHERE in_estu GROUP BY year)"


@query(f"""WITH {YEARS}, {_STD} SELECT year, sid, round((acct - am) / sd, 6) AS std FROM p LEFT JOIN std USING (year)""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cap-weighted mean, equal-weighted deviation, over the estimation universe, applied to all."""
    return cs.standardize(cross_years(spark, sf_dir), ["year"], "acct", "cap", estu()).select("year", "sid", r("std").alias("std"))


@query(f"""WITH {YEARS}, {_STD}, z AS (SELECT p.*, (acct - am) / sd AS za, CASE WHEN n_orders > 1 THEN (mean_order - om) / so END AS zo FROM p LEFT JOIN std USING (year))
SELECT year, sid, round((coalesce(0.6 * za, 0) + coalesce(0.4 * zo, 0)) / (CASE WHEN za IS NULL THEN 0 ELSE 0.6 END + CASE WHEN zo IS NULL THEN 0 ELSE 0.4 END), 6) AS style FROM z""")
def style_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of two standardised descriptors, renormalised where one is missing."""
    x = cs.standardize(cross_years(spark, sf_dir), ["year"], "acct", "cap", estu(), "za")
    x = cs.standardize(x, ["year"], "mean_order", "cap", estu(), "zo").withColumn("zo", F.when(F.col("n_orders") > 1, F.col("zo")))
    return x.select("year", "sid", r(cs.combine({"za": 0.6, "zo": 0.4})).alias("style"))


@query(f"""WITH {YEARS}, {_STD}, z AS (SELECT p.* EXCLUDE (y), (acct - am) / sd AS x, pow((acct - am) / sd, 3) AS y FROM p LEFT JOIN std USING (year)),
m AS (SELECT year, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my FROM z WHERE in_estu GROUP BY year),
b AS (SELECT year, any_value(mx) AS mx, any_value(my) AS my, sum(v * (x - mx) * (y - my)) / sum(v * (x - mx) * (x - mx)) AS b FROM z JOIN m USING (year) WHERE in_estu GROUP BY year)
SELECT year, sid, round(y - my - b * (x - mx), 6) AS resid FROM z LEFT JOIN b USING (year)""")
def nonlinear_orth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of a standardised style, made orthogonal to it by a weighted fit."""
    x = cs.standardize(cross_years(spark, sf_dir), ["year"], "acct", "cap", estu(), "x").withColumn("y", F.pow("x", F.lit(3)))
    return cs.orthogonalize(x, ["year"], "y", "x", "v", estu()).select("year", "sid", r("resid").alias("resid"))


@query(f"""WITH {YEARS}, q AS (SELECT *, CASE WHEN n_orders > 1 THEN mean_order / 1000 END AS x, ln(cap) AS size FROM p),
g AS (SELECT year, industry, sum(v * x) / sum(v) AS mx, sum(v * size) / sum(v) AS mc FROM q WHERE in_estu AND x IS NOT NULL GROUP BY ALL),
b AS (SELECT year, sum(v * (size - mc) * (x - mx)) / sum(v * (size - mc) * (size - mc)) AS b FROM q JOIN g USING (year, industry) WHERE in_estu AND x IS NOT NULL GROUP BY year)
SELECT year, sid, round(coalesce(x, mx + coalesce(b, 0) * (size - mc), 0), 8) AS filled FROM q LEFT JOIN g USING (year, industry) LEFT JOIN b USING (year)""")
def impute_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values from industry levels and size."""
    x = cross_years(spark, sf_dir).withColumns({"x": F.when(F.col("n_orders") > 1, F.col("mean_order") / 1000), "size": F.ln("cap")})
    return cs.impute(x, ["year"], "x", "industry", "size", "v", estu()).select("year", "sid", r("filled", 8).alias("filled"))


@query(f"""WITH {YEARS}, j AS (SELECT a.year, a.mean_order AS x, b.mean_order AS y, a.v AS w FROM p a JOIN p b ON a.sid = b.sid AND b.year = a.year - 1 WHERE a.in_estu),
s AS (SELECT year, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM j GROUP BY year)
SELECT year, round(CASE WHEN n >= 3 AND xx - mx * mx > 0 AND yy - my * my > 0 THEN (xy - mx * my) / sqrt(greatest((xx - mx * mx) * (yy - my * my), 0)) END, 6) AS stability FROM s""")
def exposure_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted correlation of an exposure with the same entities' exposure one period earlier."""
    p = cross_years(spark, sf_dir)
    now = p.filter(estu()).select("year", "sid", F.col("mean_order").alias("x"), F.col("v").alias("w"))
    before = p.select((F.col("year") + 1).alias("year"), "sid", F.col("mean_order").alias("y"))
    return now.join(before, ["year", "sid"]).groupBy("year").agg(r(cs.weighted_corr("x", "y", "w")).alias("stability"))


_FIT = """fitrows AS (SELECT * FROM p WHERE in_estu AND y IS NOT NULL),
fs AS (SELECT year, sum(cap * acct) / sum(cap) AS m, stddev_pop(acct) AS s FROM p WHERE in_estu GROUP BY year),
f0 AS (SELECT fitrows.*, (acct - m) / s AS style FROM fitrows JOIN fs USING (year)),
big AS (SELECT year FROM f0 GROUP BY year HAVING count(*) > count(DISTINCT industry) + 1),
f1 AS (SELECT * FROM f0 JOIN big USING (year)),
ind AS (SELECT year, industry, sum(v * style) / sum(v) AS mx, sum(v * y) / sum(v) AS my, sum(cap) AS icap FROM f1 GROUP BY ALL),
slope AS (SELECT year, sum(v * (style - mx) * (y - my)) / sum(v * (style - mx) * (style - mx)) AS b FROM f1 JOIN ind USING (year, industry) GROUP BY year),
lev AS (SELECT year, industry, my - b * mx AS a, icap / sum(icap) OVER (PARTITION BY year) AS w, b FROM ind JOIN slope USING (year)),
ctry AS (SELECT year, sum(w * a) AS c, any_value(b) AS b FROM lev GROUP BY year)"""


def _regression_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cs.standardize(cross_years(spark, sf_dir), ["year"], "acct", "cap", estu(), "style")
    return x.filter(estu())


@query(f"""WITH {YEARS}, {_FIT}
SELECT year, 'country' AS factor, round(c, 6) AS f FROM ctry UNION ALL SELECT year, 'style', round(b, 6) FROM ctry UNION ALL SELECT year, industry, round(a - c, 6) FROM lev JOIN ctry USING (year)""")
def factor_returns_wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country, industry and style returns of each year's constrained weighted cross-sectional fit."""
    return dense.factor_returns(_regression_input(spark, sf_dir), "year", "y", ["style"], "industry", "cap", "v").select("year", "factor", r("f").alias("f"))


@query(f"""WITH {YEARS}, {_FIT} SELECT year, sid, round(y - a - lev.b * style, 6) AS u FROM f1 JOIN lev USING (year, industry)""")
def specific_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fit leaves of each entity's return."""
    return dense.specific_returns(_regression_input(spark, sf_dir), "year", "sid", "y", ["style"], "industry", "cap", "v").select("year", "sid", r("u").alias("u"))


@query(f"""WITH {YEARS}, {_FIT}, d AS (SELECT year, v, y, a + lev.b * style AS fit FROM f1 JOIN lev USING (year, industry)), m AS (SELECT year, sum(v * y) / sum(v) AS my, count(*) AS n FROM d GROUP BY year)
SELECT year, any_value(n) AS n, round(1 - sum(v * (y - fit) * (y - fit)) / sum(v * (y - my) * (y - my)), 6) AS r2, (SELECT round(abs(sum(w * (lev.a - ctry.c))), 6) FROM lev JOIN ctry USING (year) WHERE lev.year = d.year) AS constraint_resid FROM d JOIN m USING (year) GROUP BY year""")
def regression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, weighted R2 and what is left of the constraint."""
    stats = dense.factor_returns(_regression_input(spark, sf_dir), "year", "y", ["style"], "industry", "cap", "v").groupBy("year")
    return stats.agg(F.max("n").alias("n"), r(F.max("r2")).alias("r2"), F.round(F.max(F.abs("constraint_resid")), 6).alias("constraint_resid"))


@query(f"""WITH {YEARS}, {_FIT}, d AS (SELECT f1.year, v, style - mx AS dx, y - a - lev.b * style AS u, lev.b FROM f1 JOIN lev USING (year, industry) JOIN ind USING (year, industry)),
k AS (SELECT year, count(DISTINCT industry) AS k FROM f1 GROUP BY year)
SELECT year, round(any_value(b) / sqrt(sum(v * u * u) / (count(*) - any_value(k) - 1) / sum(v * dx * dx)), 5) AS t_stat FROM d JOIN k USING (year) GROUP BY year""")
def style_t_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style's t statistic in each year's fit."""
    found = dense.factor_returns(_regression_input(spark, sf_dir), "year", "y", ["style"], "industry", "cap", "v")
    return found.filter("kind = 'style'").select("year", r("t_stat", 5).alias("t_stat"))


@query(f"""WITH {YEARS}, w AS (SELECT year, acct AS x, mean_order AS y, v AS w FROM p),
s AS (SELECT year, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY year),
k AS (SELECT year, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (y - my) * (y - my)) AS yy FROM w JOIN s USING (year) GROUP BY year)
SELECT year, style, round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif FROM k, (VALUES ('acct'), ('mean_order')) AS t(style) WHERE xx > 0 AND yy > 0""")
def variance_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.inflation(cross_years(spark, sf_dir), "year", ["acct", "mean_order"], "v")
    return found.select("year", "style", r("vif").alias("vif"))


@query(f"""WITH {YEARS}, e AS (SELECT year, {', '.join(f'quantile_cont(cap, {i / 10}) AS q{i}' for i in range(1, 10))}, count(*) AS n FROM p GROUP BY year)
SELECT year, sid, CAST(CASE WHEN n < 10 THEN -1 ELSE {' + '.join(f'(cap >= q{i})::INT' for i in range(1, 10))} END AS INTEGER) AS decile FROM p JOIN e USING (year)""")
def size_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.edge_groups(cross_years(spark, sf_dir), ["year"], "cap", 10).select("year", "sid", "decile")


@query(f"""WITH {YEARS}, s AS (SELECT year, industry, sid, cap, mean_order / 1000 AS sigma FROM p),
m AS (SELECT year, industry, sum(cap * sigma) / sum(cap) AS mu FROM s GROUP BY ALL),
d AS (SELECT year, industry, any_value(mu) AS mu, sqrt(avg((sigma - mu) * (sigma - mu))) AS delta FROM s JOIN m USING (year, industry) GROUP BY ALL)
SELECT year, sid, round(CASE WHEN delta + 0.1 * abs(sigma - mu) = 0 THEN sigma ELSE (0.1 * abs(sigma - mu) * mu + delta * sigma) / (delta + 0.1 * abs(sigma - mu)) END, 5) AS shrunk FROM s JOIN d USING (year, industry)""")
def bayes_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cross_years(spark, sf_dir).withColumn("sigma", F.col("mean_order") / 1000)
    return cs.shrink(x, ["year", "industry"], "sigma", "cap", 0.1).select("year", "sid", r("shrunk", 5).alias("shrunk"))


@query("""WITH o AS (SELECT o_custkey AS sid, o_totalprice AS x FROM orders),
s AS (SELECT sid, count(x) AS n, stddev_samp(x) AS s, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.35 AS q FROM o GROUP BY sid)
SELECT sid, round(CASE WHEN n < 2 THEN 0 ELSE least(1, greatest(0, (n - 4) / 8.0)) * CASE WHEN q > 0 THEN least(1, exp(1 - abs((s - q) / q))) ELSE 0 END END, 6) AS gamma FROM s""")
def coverage_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_totalprice").alias("x"))
    return orders.groupBy("sid").agg(r(cs.coverage_gamma("x", 4, 8)).alias("gamma"))


@query(f"""WITH {CROSS} SELECT sid, CASE WHEN cap IS NULL THEN 'no_cap' WHEN n_orders < 4 THEN 'short_history' WHEN acct < 0 THEN 'negative_equity' WHEN cap < 500000 THEN 'small' ELSE '' END AS reason FROM x""")
def universe_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that applies, in order of priority."""
    reason = F.when(F.col("cap").isNull(), "no_cap").when(F.col("n_orders") < 4, "short_history").when(F.col("acct") < 0, "negative_equity").when(F.col("cap") < 500000, "small").otherwise("")
    return cross(spark, sf_dir).select("sid", reason.alias("reason"))


@query(f"""WITH {YEARS} SELECT year, sid, round(v, 4) AS v, round(cap / sum(cap) OVER (PARTITION BY year), 8) AS capw FROM p WHERE in_estu""")
def estu_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.share(cross_years(spark, sf_dir).filter(estu()), ["year"], "cap", "capw").select("year", "sid", r("v", 4).alias("v"), r("capw", 8).alias("capw"))


@query(f"""WITH {YEARS} SELECT year, industry, round(sum(v) * sum(v) / sum(v * v), 6) AS neff, count(*) AS n, round(stddev_samp(acct), 4) AS sd, round(corr(acct, mean_order), 6) AS rho FROM p WHERE in_estu GROUP BY ALL""")
def industry_neff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_years(spark, sf_dir).filter(estu()).groupBy("year", "industry").agg(
        r(F.sum("v") * F.sum("v") / F.sum(F.col("v") * F.col("v"))).alias("neff"), F.count("*").alias("n"), r(F.stddev_samp("acct"), 4).alias("sd"), r(F.corr("acct", "mean_order")).alias("rho")
    )


@query(f"""WITH {CROSS}, b AS (SELECT CAST(least(greatest(floor((acct + 1000) / 1100.0), -1), 10) AS INTEGER) AS bin FROM x) SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins over [-1000, 10000); -1 and 10 take what lies outside."""
    place = F.least(F.greatest(F.floor((F.col("acct") + 1000) / 1100.0), F.lit(-1)), F.lit(10)).cast("int")
    return cross(spark, sf_dir).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {YEARS} UNPIVOT (SELECT year, sid, acct, mean_order, cap FROM p) ON acct, mean_order, cap INTO NAME style VALUE exposure""")
def unpivot_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_years(spark, sf_dir).unpivot(["year", "sid"], ["acct", "mean_order", "cap"], "style", "exposure")


@query(f"""WITH {YEARS}, k AS (SELECT year, sid, acct, row_number() OVER (PARTITION BY year ORDER BY abs(acct) DESC, sid) AS place FROM p)
SELECT year, sid, acct, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5""")
def top_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest absolute values of each key."""
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.abs("acct").desc(), "sid"))
    return cross_years(spark, sf_dir).withColumn("place", place).filter("place <= 5").select("year", "sid", "acct", "place")
