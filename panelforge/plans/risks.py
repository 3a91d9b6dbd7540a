"""Queries of the risk model: covariances, forecasts, decomposition, forecast tests, gates, optimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import covariance, dense, risk
from panelforge.operators import timeseries as ts
from panelforge.plans.crosssections import factor_returns_wls
from panelforge.plans.panels import BRAND, DAY, brand_month, day_panel, r, table
from panelforge.plans.registry import ORACLE, query
from panelforge.sources.store import stored
from panelforge.plans.windows import MARKET, with_market

_W = "wt AS (SELECT m, pow(0.5, (max(m) OVER () - m) / 24.0) / sum(pow(0.5, (max_m - m) / 24.0)) OVER () AS w FROM (SELECT DISTINCT m, (SELECT max(m) FROM bm WHERE ret IS NOT NULL) AS max_m FROM bm WHERE ret IS NOT NULL)), q AS (SELECT factor, m, ret FROM bm WHERE ret IS NOT NULL)"
_LAG = "SELECT a.factor AS i, b.factor AS j, {k} * sum(w * a.ret * b.ret) AS c FROM q b JOIN wt USING (m) JOIN q a ON a.m = b.m - {lag} GROUP BY ALL"
_COV = f"""{BRAND}, {_W}, t AS ({_LAG.format(k=1.0, lag=0)} UNION ALL {_LAG.format(k=2 / 3, lag=1)} UNION ALL SELECT j, i, c FROM ({_LAG.format(k=2 / 3, lag=1)}) UNION ALL {_LAG.format(k=1 / 3, lag=2)} UNION ALL SELECT j, i, c FROM ({_LAG.format(k=1 / 3, lag=2)})),
cov AS (SELECT i, j, sum(c) AS cov FROM t WHERE i <= j GROUP BY ALL)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_month(spark, sf_dir).filter("ret IS NOT NULL").select("factor", "m", "ret")


def _cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.serial_covariance(_panel(spark, sf_dir), "factor", "m", "ret", 24, 2)


@query(f"WITH {BRAND}, {_W}, t AS ({_LAG.format(k=1.0, lag=0)}) SELECT i, j, round(c, 8) AS c FROM t WHERE i <= j")
def factor_ewma_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.lag_moments(_panel(spark, sf_dir), "factor", "m", "ret", 24).filter("i <= j").select("i", "j", r("c", 8).alias("c"))


@query(f"WITH {_COV} SELECT i, j, round(cov, 8) AS cov FROM cov")
def serial_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance adjusted for two lags of serial correlation."""
    return _cov(spark, sf_dir).select("i", "j", r("cov", 8).alias("cov"))


@query(f"WITH {BRAND}, {_W} SELECT round(1 / sum(w * w), 6) AS n_eff, count(*) AS sessions FROM wt")
def effective_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = risk.ewma_weights(_panel(spark, sf_dir), "m", 24)
    return w.agg(r(1 / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), F.count("*").alias("sessions"))


@query()
def eigen_adjusted_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split half lives, serial correlation and simulated eigenvalue bias; one small matrix per date, from its trailing window."""
    panel = _panel(spark, sf_dir)
    # A session takes part in the windows of the forecasts made at it and up to 239 months later.
    last = panel.agg(F.max("m").alias("last"))
    dates = panel.select(F.col("m").alias("date")).distinct()
    windows = panel.crossJoin(F.broadcast(last)).withColumn("date", F.explode(F.sequence("m", F.least(F.col("m") + 239, "last")))).join(F.broadcast(dates), "date", "left_semi")
    found = dense.factor_covariances(windows, "date", "factor", "m", "ret", vol_half_life=24, vol_lags=2, corr_half_life=48, corr_lags=2, least=24)
    return found.select(F.col("date").alias("m"), "factor_i", "factor_j", r("cov_final", 8).alias("cov_final"), r("cov_pre_eigen", 8).alias("cov_pre_eigen"))


_SIGMA = f"""{BRAND}, k AS (SELECT factor, m, ret, CASE WHEN ret IS NOT NULL THEN pow(2.0, m / 12.0) END AS k FROM bm),
sg AS (SELECT factor, m, ret, CASE WHEN count(ret) OVER w >= 6 THEN sqrt(sum(k * ret * ret) OVER w / sum(k) OVER w) END AS sigma FROM k WINDOW w AS (PARTITION BY factor ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.one_day_sigma(brand_month(spark, sf_dir).select("factor", "m", "ret"), "factor", "m", "ret", 12, 6)


@query(f"WITH {_SIGMA} SELECT factor, m, round(sigma, 6) AS sigma FROM sg")
def one_day_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sigma(spark, sf_dir).select("factor", "m", r("sigma").alias("sigma"))


@query(f"""WITH RECURSIVE {_SIGMA}, b AS (SELECT m, avg(CASE WHEN sigma > 0 THEN pow(least(greatest(ret / sigma, -10), 10), 2) END) AS b2 FROM sg GROUP BY m),
f AS (SELECT m, b2, last_value(b2 IGNORE NULLS) OVER (ORDER BY m) AS bf FROM b), n AS (SELECT *, count(bf) OVER (ORDER BY m) AS n FROM f),
s(n, state) AS (SELECT n, bf FROM n WHERE n = 1 UNION ALL SELECT n.n, (1 - pow(0.5, 1 / 8.0)) * n.bf + pow(0.5, 1 / 8.0) * s.state FROM s JOIN n ON n.n = s.n + 1)
SELECT n.m, round(b2, 6) AS b2, round(coalesce(sqrt(state), 1), 6) AS lam FROM n LEFT JOIN s ON n.n = s.n AND n.n > 0""")
def factor_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility regime multiplier from standardised factor returns."""
    return risk.regime(_sigma(spark, sf_dir), "m", "ret", "sigma", 8).select("m", r("b2").alias("b2"), r("lam").alias("lam"))


@query(f"""WITH {DAY}, a AS (SELECT sid, s, ret AS u, row_number() OVER (PARTITION BY sid ORDER BY s DESC) - 1 AS age FROM day WHERE ret IS NOT NULL),
w AS (SELECT *, lag(u, 1) OVER o AS l1, lag(u, 2) OVER o AS l2, pow(0.5, age / 6.0) AS k, pow(0.5, age / 10.0) AS kl FROM a WHERE age < 20 WINDOW o AS (PARTITION BY sid ORDER BY s)),
g AS (SELECT sid, count(*) AS n, sum(k * u * u) / sum(k) AS v0, sum(kl * u * u) / sum(kl) AS c0, coalesce(sum(kl * u * l1) / sum(kl), 0) AS c1, coalesce(sum(kl * u * l2) / sum(kl), 0) AS c2 FROM w GROUP BY sid)
SELECT sid, n, round(v0, 6) AS v0, round(v0 * least(greatest((c0 + 4.0 / 3 * c1 + 2.0 / 3 * c2) / c0, 0.25), 4), 6) AS variance FROM g""")
def specific_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific variance from each entity's last twenty observations."""
    found = risk.specific_variance(day_panel(spark, sf_dir), "sid", "s", "ret", 20, 6, 2, 10)
    return found.select("sid", "n", r("v0").alias("v0"), r("variance").alias("variance"))


_HOLD = "h AS (SELECT p_brand AS factor, sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem JOIN part ON l_partkey = p_partkey) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    held = stored(lines.groupBy(F.col("p_brand").alias("factor")).agg(F.sum("l_extendedprice").alias("a")), "holdings")  # a row per factor
    return held.crossJoin(F.broadcast(held.agg(F.sum("a").alias("t")))).select("factor", (F.col("a") / F.col("t")).alias("x"))


@query(f"""WITH {_COV}, {_HOLD}, full_cov AS (SELECT i, j, cov FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j),
fx AS (SELECT i AS factor, sum(cov * x) AS fx FROM full_cov JOIN h ON j = factor GROUP BY 1), p AS (SELECT factor, x, fx, x * fx AS c FROM h JOIN fx USING (factor))
SELECT factor, round(x, 8) AS x, round(c, 10) AS contribution, round(fx / sqrt(sum(c) OVER ()), 6) AS mctr, round(sqrt(sum(c) OVER ()), 6) AS sigma FROM p""")
def risk_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler contributions, marginal contributions and total risk of a portfolio of factors."""
    parts = risk.decompose(_holdings(spark, sf_dir), stored(_cov(spark, sf_dir), "cov"))
    return parts.select("factor", r("x", 8).alias("x"), r("contribution", 10).alias("contribution"), r("mctr").alias("mctr"), r("sigma").alias("sigma"))


@query(f"""WITH {_COV}, {_HOLD}, act AS (SELECT factor, x - 1.0 / count(*) OVER () AS x FROM h), full_cov AS (SELECT i, j, cov FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j),
v AS (SELECT sum(a.x * cov * b.x) AS te, (SELECT sum(a.x * cov * b.x) FROM h a JOIN full_cov ON i = a.factor JOIN h b ON j = b.factor) AS hh FROM act a JOIN full_cov ON i = a.factor JOIN act b ON j = b.factor),
e AS (SELECT sum(a.x * cov / n.n) AS hb FROM h a JOIN full_cov ON i = a.factor, (SELECT count(*) AS n FROM h) n),
bb AS (SELECT sum(cov / n.n / n.n) AS bb FROM full_cov, (SELECT count(*) AS n FROM h) n)
SELECT round(sqrt(greatest(te, 0)), 6) AS tracking_error, round(sqrt(hh), 6) AS sigma, round(hb / bb, 6) AS beta FROM v, e, bb""")
def active_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking error, risk and beta against the equal-weighted portfolio."""
    h, cov = _holdings(spark, sf_dir), risk.mirrored(stored(_cov(spark, sf_dir), "cov"))
    both = h.crossJoin(F.broadcast(h.agg(F.count("*").alias("n")))).select("factor", F.col("x").alias("h"), (F.lit(1.0) / F.col("n")).alias("b"))
    left = both.select(F.col("factor").alias("i"), F.col("h").alias("hi"), F.col("b").alias("bi"))
    right = both.select(F.col("factor").alias("j"), F.col("h").alias("hj"), F.col("b").alias("bj"))
    s = lambda a, b: F.sum(a * F.col("cov") * b)
    ai, aj = F.col("hi") - F.col("bi"), F.col("hj") - F.col("bj")
    found = cov.join(left, "i").join(right, "j").agg(s(ai, aj).alias("te"), s(F.col("hi"), F.col("hj")).alias("hh"), s(F.col("hi"), F.col("bj")).alias("hb"), s(F.col("bi"), F.col("bj")).alias("bb"))
    return found.select(r(F.sqrt(F.greatest("te", F.lit(0.0)))).alias("tracking_error"), r(F.sqrt("hh")).alias("sigma"), r(F.col("hb") / F.col("bb")).alias("beta"))


@query(f"""WITH {_SIGMA}, b AS (SELECT factor, m, ret / sigma AS b FROM sg WHERE sigma > 0 AND ret IS NOT NULL),
d AS (SELECT *, CASE WHEN count(b) OVER w = 12 THEN stddev_samp(b) OVER w END AS r FROM b WINDOW w AS (PARTITION BY factor ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT factor, count(*) AS n, round(stddev_samp(b), 6) AS bias, round(avg(abs(r - 1)), 6) AS mrad, round(avg(b * b + 1e-12 - ln(b * b + 1e-12)), 6) AS qlike FROM d GROUP BY factor""")
def forecast_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias statistic, rolling deviation and likelihood loss of each factor's forecasts."""
    b = _sigma(spark, sf_dir).select("factor", "m", F.when(F.col("sigma") > 0, F.col("ret") / F.col("sigma")).alias("b"))
    found = risk.forecast_tests(b, ["factor"], "b", "m")
    return found.select("factor", "n", *(r(c).alias(c) for c in ("bias", "mrad", "qlike")))


@query(f"""WITH RECURSIVE {BRAND}, d AS (SELECT DISTINCT m FROM bm WHERE ret IS NOT NULL), s(m) AS (SELECT min(m) FROM d UNION ALL SELECT (SELECT min(d.m) FROM d WHERE d.m >= s.m + 5) FROM s WHERE s.m IS NOT NULL AND EXISTS (SELECT 1 FROM d WHERE d.m >= s.m + 5))
SELECT m FROM s""")
def spaced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions at least five apart."""
    return risk.spaced(_panel(spark, sf_dir), "m", 5)


@query(f"""WITH {MARKET} SELECT factor, round(sum(mkt * ret) / nullif(sum(mkt * mkt), 0), 6) AS beta, round(corr(ret, mkt), 6) AS rho, count(*) AS n FROM bx WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY factor""")
def market_betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_market(spark, sf_dir).filter("ret IS NOT NULL AND mkt IS NOT NULL")
    return x.groupBy("factor").agg(r(F.sum(F.col("mkt") * F.col("ret")) / F.sum(F.col("mkt") * F.col("mkt"))).alias("beta"), r(F.corr("ret", "mkt")).alias("rho"), F.count("*").alias("n"))


@query()
def optimal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only weights under a cap, from the covariance and mean returns; one small problem per date."""
    cov = _cov(spark, sf_dir).select(F.lit(1).alias("date"), F.col("i").alias("factor_i"), F.col("j").alias("factor_j"), "cov")
    alpha = _panel(spark, sf_dir).groupBy(F.lit(1).alias("date"), "factor").agg((F.avg("ret") / 10).alias("alpha"))
    return dense.optimize(cov, alpha, "date", 0.10, 4.0).select("factor", r("weight").alias("weight"))


@query()
def active_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of part types by size against their share of value: bands on exposures to brands, bounds on tracking error and trades."""
    cov = _cov(spark, sf_dir).select(F.lit(1).alias("date"), F.col("i").alias("factor_i"), F.col("j").alias("factor_j"), "cov")
    part = table(spark, sf_dir, "part").withColumn("asset", F.concat_ws("|", "p_type", F.ceil(F.col("p_size") / 5)))
    brand = part.groupBy("asset", "p_brand").agg(F.sum("p_retailprice").alias("value"))
    total = brand.groupBy("asset").agg(F.sum("value").alias("bench"), F.map_from_entries(F.collect_list(F.struct("p_brand", "value"))).alias("of"))  # 25 brands
    own = part.groupBy("asset").agg((F.var_pop("p_retailprice") / F.avg("p_retailprice") ** 2 + 0.001).alias("spec_var"), (F.avg("p_size") / 1000).alias("alpha"))
    n = F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))  # 6 types in 10 sizes
    assets = total.join(own, "asset").withColumns({"date": F.lit(1), "exposures": F.transform_values("of", lambda _, v: v / F.col("bench"))}).withColumn("prev", n)
    found = dense.optimize_active(assets, cov, "date", "asset", aversion=1.0, cap=0.05, band=0.02, tracking=0.05, turnover=0.8)
    return found.select("asset", r("weight", 5).alias("weight"), r("active", 5).alias("active"), r("tracking_error", 5).alias("tracking_error"), "status")


@query(f"""WITH {DAY}, n AS (SELECT s, count(*) AS n, count(*) FILTER (close > 0) AS priced, median(volume) AS med, max(abs(ret)) AS shock FROM day GROUP BY s)
SELECT s, 'data_freshness' AS gate, 'FAIL' AS level, priced >= 0.98 * n AS ok FROM n UNION ALL SELECT s, 'universe', 'WARN', n BETWEEN 20 AND 1000000 FROM n
UNION ALL SELECT s, 'volume_level', 'WARN', med BETWEEN 1 AND 6 FROM n UNION ALL SELECT s, 'shock', 'WARN', coalesce(shock <= 50, true) FROM n""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily checks, each a row; failing a FAIL gate keeps a session from being published."""
    day = day_panel(spark, sf_dir)
    n = day.groupBy("s").agg(F.count("*").alias("n"), F.count(F.when(F.col("close") > 0, 1)).alias("priced"), F.median("volume").alias("med"), F.max(F.abs("ret")).alias("shock"))
    checks = F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(level).alias("level"), ok.alias("ok")) for g, level, ok in [
        ("data_freshness", "FAIL", F.col("priced") >= 0.98 * F.col("n")), ("universe", "WARN", F.col("n").between(20, 1000000)),
        ("volume_level", "WARN", F.col("med").between(1, 6)), ("shock", "WARN", F.coalesce(F.col("shock") <= 50, F.lit(True))),
    ]))
    return n.select("s", F.inline(checks))


@query(f"""WITH g AS ({ORACLE['gates']}) SELECT s, CASE WHEN bool_or(level = 'FAIL' AND NOT ok) THEN 'FAIL' WHEN bool_or(NOT ok) THEN 'WARN' ELSE 'OK' END AS status FROM g GROUP BY s""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gates(spark, sf_dir).groupBy("s").agg(F.max((F.col("level") == "FAIL") & ~F.col("ok")).alias("fail"), F.max(~F.col("ok")).alias("warn"))
    return g.select("s", F.when(F.col("fail"), "FAIL").when(F.col("warn"), "WARN").otherwise("OK").alias("status"))


@query(f"""WITH f AS ({ORACLE['factor_returns_wls']}), c AS (SELECT year, max(f) FILTER (factor = 'country') AS country, max(f) FILTER (factor = 'style') AS style, count(*) AS n FROM f GROUP BY year)
SELECT year, country, style, n, round(product(1 + country) OVER (ORDER BY year) - 1, 5) AS cumulative FROM c""")
def factor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide factor returns with the cumulative country return."""
    c = factor_returns_wls(spark, sf_dir).groupBy("year").agg(F.max(F.when(F.col("factor") == "country", F.col("f"))).alias("country"), F.max(F.when(F.col("factor") == "style", F.col("f"))).alias("style"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("year")  # one row per year
    return c.select("year", "country", "style", "n", r(F.product(1 + F.col("country")).over(w) - 1, 5).alias("cumulative"))


_RUN = f"""{BRAND}, q AS (SELECT factor, m, ret FROM bm WHERE ret IS NOT NULL), d AS (SELECT DISTINCT m FROM q), w AS (SELECT d.m AS date, s.m, pow(0.5, (d.m - s.m) / 24.0) AS w FROM d JOIN d s ON s.m <= d.m),
nw AS (SELECT date, m, w / sum(w) OVER (PARTITION BY date) AS w FROM w),
pr AS (SELECT a.factor AS i, b.factor AS j, b.m, sum((CASE b.m - a.m WHEN 0 THEN CASE WHEN a.factor <= b.factor THEN 1.0 ELSE 0 END WHEN 1 THEN 2 / 3.0 ELSE 1 / 3.0 END) * a.ret * b.ret) AS p FROM q a JOIN q b ON a.m BETWEEN b.m - 2 AND b.m GROUP BY ALL),
sy AS (SELECT least(i, j) AS i, greatest(i, j) AS j, m, sum(CASE WHEN i = j THEN 2 * p - z ELSE p END) AS p FROM pr JOIN (SELECT factor AS f, m AS fm, ret * ret AS z FROM q) ON f = j AND fm = m GROUP BY ALL),
rc AS (SELECT date, i, j, sum(w * p) AS cov FROM sy JOIN nw USING (m) GROUP BY ALL)"""


@query(f"WITH {_RUN} SELECT date, i, j, round(cov, 8) AS cov FROM rc WHERE date >= 24")
def running_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariance adjusted for two lags as of every month, from one scan of running sums."""
    found = covariance.running_covariances(_panel(spark, sf_dir), "factor", "m", "ret", 24, 2)
    return found.filter("s >= 24").select(F.col("s").alias("date"), "i", "j", r("cov", 8).alias("cov"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of every sixth month, in the form of the matrix problems."""
    found = covariance.running_covariances(_panel(spark, sf_dir), "factor", "m", "ret", 24, 2).filter("s >= 24 AND s % 6 = 0")
    return stored(found.select(F.col("s").alias("date"), F.col("i").alias("factor_i"), F.col("j").alias("factor_j"), "cov"), "dated-cov")


@query()
def layered_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly covariances whose eigenvalue corrections are made anew in each quarter's first month, scaled by the regime; young ones are provisional."""
    panel = stored(_panel(spark, sf_dir), "panel")
    pre = covariance.running_covariances(panel, "factor", "m", "ret", 24, 2).filter("s >= 24").withColumnRenamed("s", "date")
    dates = panel.select(F.col("m").alias("date")).distinct()
    lam = factor_regime(spark, sf_dir).select(F.col("m").alias("date"), F.col("lam").alias("lambda"))
    windows = dates.filter("date >= 24").select("date", (F.col("date") + 1).cast("int").alias("n"))
    found = covariance.layered(pre, windows.select("date", (F.col("date") % 3 == 0).alias("refresh")), lam, "date", windows=windows, estimator=(24, 2, 24, 2), sims=200, scale=1.0, horizon=1.0, provisional=36)
    return found.select("date", "factor_i", "factor_j", r("cov_final", 8).alias("cov_final"), r("cov_pre_eigen", 8).alias("cov_pre_eigen"), r("lambda").alias("lambda"), "provisional")


@query()
def optimal_weights_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only weights under a cap of every sixth month, from that month's covariance and the mean returns up to it."""
    cov = _dated(spark, sf_dir)
    so_far = Window.partitionBy("factor").orderBy("m")
    mean = _panel(spark, sf_dir).withColumn("alpha", F.avg("ret").over(so_far) / 10)
    alpha = mean.join(cov.select(F.col("date").alias("m")).distinct(), "m", "left_semi").select(F.col("m").alias("date"), "factor", "alpha")
    return dense.optimize(cov, alpha, "date", 0.10, 4.0).select("date", "factor", r("weight").alias("weight"))


@query()
def minimum_risk_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each factor and every sixth month the portfolio of least risk with a unit of it."""
    return dense.minimum_risk(_dated(spark, sf_dir), "date").select("date", "target", "factor", r("weight").alias("weight"), r("sigma", 8).alias("sigma"))


@query()
def active_weights_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active weights of part types by size for every sixth month: a problem for each date, under that date's covariance."""
    cov = _dated(spark, sf_dir)
    part = table(spark, sf_dir, "part").withColumn("asset", F.concat_ws("|", "p_type", F.ceil(F.col("p_size") / 10)))
    brand = part.groupBy("asset", "p_brand").agg(F.sum("p_retailprice").alias("value"))
    total = brand.groupBy("asset").agg(F.sum("value").alias("bench"), F.map_from_entries(F.collect_list(F.struct("p_brand", "value"))).alias("of"))  # 25 brands
    own = part.groupBy("asset").agg((F.var_pop("p_retailprice") / F.avg("p_retailprice") ** 2 + 0.001).alias("spec_var"), (F.avg("p_size") / 1000).alias("alpha"))
    assets = total.join(own, "asset").select("asset", "bench", "spec_var", "alpha", F.transform_values("of", lambda _, v: v / F.col("bench")).alias("exposures"))
    dated = assets.crossJoin(F.broadcast(cov.select((F.col("date") + 0).alias("date")).distinct()))  # a few dates
    found = dense.optimize_active(dated, cov, "date", "asset", aversion=1.0, cap=0.1, band=0.02, tracking=0.05)
    return found.select("date", "asset", r("weight", 5).alias("weight"), r("active", 5).alias("active"), r("tracking_error", 5).alias("tracking_error"), "status")
