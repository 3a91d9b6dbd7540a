"""Queries of market values, valuation, portfolios of the model, its validation and staging reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import crosssection as cs
from panelforge.operators import dense, risk
from panelforge.operators import staging as st
from panelforge.operators import timeseries as ts
from panelforge.operators import valuation as va
from panelforge.plans.crosssections import _FIT, _regression_input, estu, factor_returns_wls, regression_stats
from panelforge.plans.panels import DAY, YEARS, brand_month, cross_years, day_panel, r, table
from panelforge.plans.registry import ORACLE, query
from panelforge.plans.relational import specific_bias, worst_coverage
from panelforge.plans.risks import _COV, _HOLD, _SIGMA, _cov, _holdings, _sigma, eigen_adjusted_cov, factor_regime, forecast_tests
from panelforge.sources.store import stored

_ITEMS = {"ni": "1-URGENT", "cfo": "2-HIGH", "pe": "3-MEDIUM", "ld": "4-NOT SPECIFIED", "cd": "5-LOW"}
_RATIOS = ["earnings_yield", "cash_yield", "book_to_price", "market_leverage", "debt_to_assets", "book_leverage"]


@query(f"""WITH f AS (SELECT o_custkey AS sid, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS mc, count(*) AS n, {', '.join(f"sum(o_totalprice) FILTER (o_orderpriority = '{p}') AS {i}" for i, p in _ITEMS.items())} FROM orders GROUP BY ALL),
g AS (SELECT f.*, CASE WHEN n > 1 THEN c_acctbal END AS be, CASE WHEN n > 2 THEN mc * 2 END AS ta FROM f JOIN customer ON sid = c_custkey),
h AS (SELECT *, be IS NOT NULL OR ta IS NOT NULL AS sheet FROM g),
k AS (SELECT *, coalesce(pe, CASE WHEN sheet THEN 0 END) AS p0, coalesce(ld, CASE WHEN sheet THEN 0 END) AS l0, coalesce(cd, CASE WHEN sheet THEN 0 END) AS c0 FROM h)
SELECT sid, year, round(ni / mc, 6) AS earnings_yield, round(cfo / mc, 6) AS cash_yield, round(be / mc, 6) AS book_to_price, round((mc + p0 + l0) / mc, 6) AS market_leverage, round((l0 + c0) / ta, 6) AS debt_to_assets,
round(CASE WHEN be > 0 THEN (be + p0 + l0) / be END, 3) AS book_leverage FROM k""")
def valuation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields and leverages of each customer's year; orders by priority stand for the items of a balance sheet."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderpriority")
    items = [F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(i) for i, p in _ITEMS.items()]
    f = orders.groupBy("sid", "year").agg(F.sum("o_totalprice").alias("mc"), F.count("*").alias("n"), *items)
    f = f.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), "c_acctbal"), "sid")
    f = f.withColumns({"be": F.when(F.col("n") > 1, F.col("c_acctbal")), "ta": F.when(F.col("n") > 2, F.col("mc") * 2)})
    found = va.ratios(*(F.col(c) for c in ("mc", "ni", "cfo", "be", "ta", "pe", "ld", "cd")))
    return f.select("sid", "year", *(r(found[c], 3 if c == "book_leverage" else 6).alias(c) for c in _RATIOS))


_SPLIT = "CASE WHEN (sid + s) % 11 = 0 THEN 2.0 ELSE 1.0 END"
_CUM = f"cu AS (SELECT *, product({_SPLIT}) OVER (PARTITION BY sid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM day)"


def _split():
    return F.when((F.col("sid") + F.col("s")) % 11 == 0, 2.0).otherwise(1.0)


@query(f"""WITH {DAY}, {_CUM}, t AS (SELECT sid, s, close, cum, CASE WHEN s % 4 > 0 THEN amount / 10 END AS filed, bool_or(volume > 2) OVER w AS known, sum(CASE WHEN volume > 1 THEN amount / volume ELSE 0 END * cum) OVER (PARTITION BY sid ORDER BY s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS trail
FROM cu WINDOW w AS (PARTITION BY sid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT sid, s, round(CASE WHEN known THEN trail / cum / nullif(close, 0) ELSE coalesce(filed / nullif(close, 0), trail / cum / nullif(close, 0)) END, 5) AS dividend_yield FROM t""")
def dividend_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split-adjusted dividends of the last ten sessions, or the filed ones before the first adjustment."""
    day = day_panel(spark, sf_dir).withColumns({"split": _split(), "dividend": F.when(F.col("volume") > 1, F.col("amount") / F.col("volume")), "filed": F.when(F.col("s") % 4 > 0, F.col("amount") / 10), "adjusts": F.col("volume") > 2})
    found = va.dividend_yield(day, "sid", "s", "dividend", "split", "close", "adjusts", "filed", 10)
    return found.select("sid", "s", r("dividend_yield", 5).alias("dividend_yield"))


_BAND = (0.002, 0.2)
_CAPS = f"""{DAY}, {_CUM}, md AS (SELECT *, (SELECT median(x) FROM unnest(v) u(x)) AS med FROM (SELECT *, list(volume) OVER (PARTITION BY sid ORDER BY s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM cu)),
ct AS (SELECT user_id AS sid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS s, max(value) * 10 AS count FROM events WHERE event_type = 'purchase' GROUP BY ALL),
fl AS (SELECT user_id AS sid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS s, max(value) * 1000 AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
gc AS (SELECT ct.sid, ct.s, count, coalesce(cum, 1) AS basis FROM ct ASOF LEFT JOIN md ON ct.sid = md.sid AND ct.s >= md.s WHERE count = 0 OR med IS NULL OR med / count BETWEEN {_BAND[0]} AND {_BAND[1]}),
gf AS (SELECT fl.sid, fl.s, CASE WHEN value > 0 AND close > 0 AND (med IS NULL OR med * close / value BETWEEN {_BAND[0]} AND {_BAND[1]}) THEN value / close END AS held, coalesce(cum, 1) AS fbasis FROM fl ASOF LEFT JOIN md ON fl.sid = md.sid AND fl.s >= md.s),
p1 AS (SELECT cu.*, CASE WHEN cu.s - gc.s <= 5 THEN gc.count / basis END AS own FROM cu ASOF LEFT JOIN gc ON cu.sid = gc.sid AND cu.s >= gc.s),
p2 AS (SELECT p1.*, CASE WHEN p1.s - gf.s <= 9 THEN held / fbasis END AS other FROM p1 ASOF LEFT JOIN gf ON p1.sid = gf.sid AND p1.s >= gf.s),
p3 AS (SELECT *, coalesce(own, other) * cum AS shares, coalesce(own, other) * cum * close AS mcap, CASE WHEN own IS NOT NULL THEN 'count' WHEN other IS NOT NULL THEN 'float' END AS source FROM p2),
p4 AS (SELECT *, lag(mcap) OVER (PARTITION BY sid ORDER BY s) AS before FROM p3)"""


@query(f"""WITH {_CAPS} SELECT sid, s, round(shares, 3) AS shares, round(mcap, 4) AS mcap, source,
CASE WHEN mcap > 0 AND before > 0 AND 1 + ret > 0 AND abs(ln(mcap / before) - ln(1 + ret)) > 0.5 THEN 'continuity' END AS flag FROM p4""")
def market_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market values from plausible share counts at today's splits, else from the float; jumps are flagged."""
    so_far = Window.partitionBy("sid").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    day = day_panel(spark, sf_dir).withColumn("cum", F.product(_split()).over(so_far)).select("sid", "s", "close", "ret", "volume", "cum")
    at = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    filed = lambda kind, scale, name: table(spark, sf_dir, "events").filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("sid"), at.alias("s")).agg((F.max("value") * scale).alias(name))
    found = va.market_caps(day, filed("purchase", 10, "count"), filed("view", 1000, "value"), "sid", "s", _BAND, 5, 5, 9, 0.5)
    return found.select("sid", "s", r("shares", 3).alias("shares"), r("mcap", 4).alias("mcap"), "source", "flag")


_KEYS = "SELECT c_custkey AS node, 'a' || c_nationkey || ' ' || CAST(floor(c_acctbal / 200) AS BIGINT) AS key FROM customer UNION ALL SELECT c_custkey, 'b' || c_mktsegment || ' ' || CAST(floor(c_acctbal / 5) AS BIGINT) FROM customer"


@query(f"""WITH RECURSIVE k AS ({_KEYS}), e AS (SELECT DISTINCT a.node AS a, b.node AS b FROM k a JOIN k b USING (key) WHERE a.node <> b.node),
c(node, reached) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT c.node, e.b FROM c JOIN e ON c.reached = e.a)
SELECT node, min(reached) AS component FROM c GROUP BY node""")
def linked_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share one of two identifiers, directly or over others, are one identity."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_nationkey", "c_mktsegment", "c_acctbal")
    part = lambda name, width: F.concat_ws(" ", name, F.floor(F.col("c_acctbal") / width).cast("string"))
    return va.linked_by_keys(c, "node", [part("c_nationkey", 200), part("c_mktsegment", 5)])


@query(f"""WITH {YEARS}, w AS (SELECT year, sid, industry, acct / 5000 AS style, cap / sum(cap) OVER (PARTITION BY year) AS w FROM p WHERE in_estu),
t AS (SELECT year, 'country' AS factor, w AS x FROM w UNION ALL SELECT year, 'style', w * style FROM w UNION ALL SELECT year, industry, w FROM w)
SELECT year, factor, round(sum(x), 6) AS x FROM t GROUP BY ALL""")
def market_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures of the cap-weighted estimation universe to each factor."""
    held = cs.share(cross_years(spark, sf_dir).filter(estu()), ["year"], "cap", "w")
    part = lambda factor, x: F.struct(factor.alias("factor"), x.alias("x"))
    w = F.col("w")
    parts = F.array(part(F.lit("country"), w), part(F.lit("style"), w * F.col("acct") / 5000), part(F.col("industry"), w))
    return held.select("year", F.inline(parts)).groupBy("year", "factor").agg(r(F.sum("x")).alias("x"))


@query("""WITH h AS (SELECT l_orderkey AS portfolio, l_partkey AS sid, sum(l_quantity) AS held FROM lineitem GROUP BY ALL)
SELECT portfolio, count(*) FILTER (p_partkey IS NOT NULL) AS matched, count(*) FILTER (p_partkey IS NULL) AS unmatched, round(coalesce(sum(held) FILTER (p_partkey IS NOT NULL), 0), 4) AS weight,
coalesce(string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid) FILTER (p_partkey IS NULL), '') AS names FROM h LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON sid = p_partkey GROUP BY portfolio""")
def holdings_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each portfolio's holdings, repeated ones added up, against the model's coverage; what isn't covered is listed."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("portfolio"), F.col("l_partkey").alias("sid")).agg(F.sum("l_quantity").alias("held"))
    covered = table(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("sid"), F.lit(True).alias("known"))
    x = lines.join(covered, "sid", "left").withColumn("missing", F.when(F.col("known").isNull(), F.col("sid")))
    return x.groupBy("portfolio").agg(
        F.count("known").alias("matched"), F.count("missing").alias("unmatched"), r(F.coalesce(F.sum(F.when(F.col("known"), F.col("held"))), F.lit(0.0)), 4).alias("weight"),
        F.array_join(F.array_sort(F.collect_list("missing")), ",").alias("names"),
    )


_PURE = f"""{YEARS}, {_FIT}, vs AS (SELECT year, industry, sum(v) AS vi FROM f1 GROUP BY ALL), dx AS (SELECT f1.year, sum(v * (style - mx) * (style - mx)) AS d FROM f1 JOIN ind USING (year, industry) GROUP BY f1.year),
wx AS (SELECT year, sum(w * mx) AS wx FROM lev JOIN ind USING (year, industry) GROUP BY year),
o AS (SELECT f1.year, f1.sid, f1.industry, v / vi AS own, w, mx, wx, v * (style - mx) / d AS so FROM f1 JOIN ind USING (year, industry) JOIN lev USING (year, industry) JOIN vs USING (year, industry) JOIN dx USING (year) JOIN wx USING (year)),
pure AS (SELECT year, 'style' AS factor, sid, so AS weight FROM o UNION ALL SELECT year, 'country', sid, w * own - wx * so FROM o
UNION ALL SELECT o.year, i.industry, sid, CASE WHEN o.industry = i.industry THEN own ELSE 0 END - i.mx * so - (w * own - o.wx * so) FROM o JOIN ind i ON i.year = o.year)"""


def _pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.pure_portfolios(_regression_input(spark, sf_dir), "year", "sid", "y", ["style"], "industry", "cap", "v")


@query(f"WITH {_PURE} SELECT year, factor, count(*) AS n, round(sum(abs(weight)), 5) AS gross, round(sum(weight), 5) AS net FROM pure GROUP BY ALL")
def pure_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross and net weight of the portfolio behind each factor return."""
    return _pure(spark, sf_dir).groupBy("year", "factor").agg(F.count("*").alias("n"), r(F.sum(F.abs("weight")), 5).alias("gross"), r(F.sum("weight"), 5).alias("net"))


@query(f"""WITH {_PURE}, k AS (SELECT *, row_number() OVER (PARTITION BY year, factor ORDER BY round(abs(weight), 9) DESC, sid) AS place FROM pure)
SELECT year, factor, place, sid, round(weight, 6) AS weight FROM k WHERE place <= 5""")
def pure_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest holdings behind each factor return; tasks keep only their own five of a factor before they shuffle."""
    largest = Window.partitionBy("year", "factor").orderBy(F.round(F.abs("weight"), 9).desc(), "sid")
    x = _pure(spark, sf_dir).withColumn("place", F.row_number().over(largest)).filter("place <= 5")
    return x.select("year", "factor", F.col("place").cast("long").alias("place"), "sid", r("weight").alias("weight"))


@query(f"""WITH {YEARS}, q AS (SELECT *, mean_order / 1000 AS sigma, acct / 5000 AS style FROM p), ok AS (SELECT *, ln(sigma) AS ly FROM q WHERE in_estu AND sigma > 0),
big AS (SELECT year FROM ok GROUP BY year HAVING count(*) > count(DISTINCT industry) + 1), f AS (SELECT * FROM ok JOIN big USING (year)),
i AS (SELECT year, industry, sum(v) AS vi, sum(v * style) / sum(v) AS mx, sum(v * ly) / sum(v) AS my FROM f GROUP BY ALL),
b AS (SELECT year, sum(v * (style - mx) * (ly - my)) / sum(v * (style - mx) * (style - mx)) AS b FROM f JOIN i USING (year, industry) GROUP BY year),
a AS (SELECT year, industry, my - b * mx AS a, vi FROM i JOIN b USING (year)), lv AS (SELECT year, sum(vi * a) / sum(vi) AS level FROM a GROUP BY year),
pr AS (SELECT q.*, coalesce(a, level) + b * style AS pred FROM q JOIN b USING (year) JOIN lv USING (year) LEFT JOIN a USING (year, industry)),
e AS (SELECT year, sum(v * exp(ln(sigma) - pred)) / sum(v) AS e FROM pr WHERE in_estu AND sigma > 0 GROUP BY year)
SELECT year, sid, round(e * exp(pred), 5) AS structural FROM pr JOIN e USING (year)""")
def structural_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific deviations told from exposures, for names whose own history is too short."""
    x = cross_years(spark, sf_dir).withColumns({"sigma": F.col("mean_order") / 1000, "style": F.col("acct") / 5000})
    return dense.structural_sigma(x, "year", "sid", "sigma", ["style"], "industry", "v", estu()).select("year", "sid", r("structural", 5).alias("structural"))


@query()
def minimum_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each factor the portfolio of least risk with a unit of it."""
    cov = _cov(spark, sf_dir).select(F.lit(1).alias("date"), F.col("i").alias("factor_i"), F.col("j").alias("factor_j"), "cov")
    return dense.minimum_risk(cov, "date").select("target", "factor", r("weight").alias("weight"), r("sigma", 8).alias("sigma"))


@query()
def eigen_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias of eigenportfolios over the month after each forecast, before and after the correction."""
    after = brand_month(spark, sf_dir).filter("ret IS NOT NULL").select((F.col("m") - 1).alias("m"), "factor", "ret")
    found = dense.eigen_battery(eigen_adjusted_cov(spark, sf_dir), after, "m")
    return found.select("k", "n", r("bias_before", 5).alias("bias_before"), r("bias_after", 5).alias("bias_after"))


@query(f"""WITH {YEARS}, e AS (SELECT year, sid, industry, cap, coalesce(y, 0) AS y FROM p WHERE in_estu), q AS (SELECT year, CAST(i AS VARCHAR) AS i, y, row_number() OVER (PARTITION BY year, i ORDER BY md5(i || '|' || year || '|' || sid)) AS k FROM e, range(8) t(i))
SELECT year, 'market' AS family, 'cap' AS name, round(sum(cap * y) / sum(cap), 6) AS ret FROM e GROUP BY year UNION ALL SELECT year, 'market', 'equal', round(avg(y), 6) FROM e GROUP BY year
UNION ALL SELECT year, 'industry', industry, round(sum(cap * y) / sum(cap), 6) FROM e GROUP BY year, industry UNION ALL SELECT year, 'random', i, round(avg(y), 6) FROM q WHERE k <= 50 GROUP BY year, i HAVING count(*) = 50""")
def asset_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of test portfolios: the market, each industry, and random ones of fifty names that a hash draws."""
    e = cross_years(spark, sf_dir).filter(estu()).select("year", "sid", "industry", "cap", F.coalesce("y", F.lit(0.0)).alias("y"))
    capped = (F.sum(F.col("cap") * F.col("y")) / F.sum("cap")).alias("ret")
    out = lambda df, family, name: df.select("year", F.lit(family).alias("family"), name.alias("name"), r("ret").alias("ret"))
    drawn = e.withColumn("i", F.explode(F.array(*(F.lit(str(i)) for i in range(8)))))
    place = F.row_number().over(Window.partitionBy("year", "i").orderBy(F.md5(F.concat_ws("|", "i", "year", "sid"))))
    random = drawn.withColumn("k", place).filter("k <= 50").groupBy("year", "i").agg(F.avg("y").alias("ret"), F.count("*").alias("n")).filter("n = 50")
    return (
        out(e.groupBy("year").agg(capped), "market", F.lit("cap")).unionByName(out(e.groupBy("year").agg(F.avg("y").alias("ret")), "market", F.lit("equal")))
        .unionByName(out(e.groupBy("year", "industry").agg(capped), "industry", F.col("industry"))).unionByName(out(random, "random", F.col("i")))
    )


@query(f"""SELECT 'coverage' AS area, 'returns of nearly all entities at every session' AS criterion, round(share, 4) AS value, CASE WHEN share < 0.95 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({ORACLE['worst_coverage']})
UNION ALL SELECT 'regression', 'constraint holds', round(c, 4), CASE WHEN c >= 0.000001 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT max(constraint_resid) AS c FROM ({ORACLE['regression_stats']}))
UNION ALL SELECT 'factor risk', 'mean bias of forecasts', round(b, 4), CASE WHEN b < 0.85 OR b > 1.15 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT sum(bias) / count(bias) AS b FROM ({ORACLE['forecast_tests']}))
UNION ALL SELECT 'factor risk', 'mean rolling deviation of the bias', round(d, 4), CASE WHEN d > 0.22 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT sum(mrad) / count(mrad) AS d FROM ({ORACLE['forecast_tests']}))
UNION ALL SELECT 'specific risk', 'worst bias of a size', round(w, 4), CASE WHEN w > 0.15 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT greatest(max(bias) - 1, 1 - min(bias)) AS w FROM ({ORACLE['specific_bias']}))
UNION ALL SELECT 'operations', 'unattended sessions', NULL, 'NOT RUN'""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validation measures, each against its criterion; what nothing measures yet is NOT RUN."""
    forecasts = stored(forecast_tests(spark, sf_dir), "forecast-tests")
    value = F.col("value")
    card = [
        ("coverage", "returns of nearly all entities at every session", worst_coverage(spark, sf_dir), F.min("share"), value >= 0.95),
        ("regression", "constraint holds", regression_stats(spark, sf_dir), F.max("constraint_resid"), value < 1e-6),
        ("factor risk", "mean bias of forecasts", forecasts, F.avg("bias"), value.between(0.85, 1.15)),
        ("factor risk", "mean rolling deviation of the bias", forecasts, F.avg("mrad"), value <= 0.22),
        ("specific risk", "worst bias of a size", specific_bias(spark, sf_dir), F.max(F.abs(F.col("bias") - 1)), value <= 0.15),
    ]
    found = spark.createDataFrame([("operations", "unattended sessions", None, "NOT RUN")], "area string, criterion string, value double, status string")
    for area, criterion, source, measure, holds in card:
        row = source.agg(measure.alias("value")).withColumn("status", F.when(holds, "PASS").otherwise("FAIL"))
        found = found.unionByName(row.select(F.lit(area).alias("area"), F.lit(criterion).alias("criterion"), r("value", 4).alias("value"), "status"))
    return found


_AREAS = f"""{_CAPS}, ex AS (SELECT 'market caps' AS area, sid, s, 'no share count' AS text FROM p4 WHERE source IS NULL UNION ALL SELECT 'market caps', sid, s, 'value moved otherwise than the return' FROM p4 WHERE mcap > 0 AND before > 0 AND 1 + ret > 0 AND abs(ln(mcap / before) - ln(1 + ret)) > 0.5
UNION ALL SELECT 'prices', sid, s, 'return of ' || CAST(round(ret * 100) AS BIGINT) || ' percent' FROM day WHERE ret > 5 UNION ALL SELECT 'prices', sid, s, 'no price' FROM day WHERE close IS NULL OR close <= 0)"""


_RETURN = "return"


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, sid, s, ret, text: a row for each odd thing. Of returns the text is _RETURN only: numbers of rows need none, and a return may be too large for a whole number."""
    day = day_panel(spark, sf_dir)
    caps = market_caps(spark, sf_dir).withColumn("ret", F.lit(None).cast("double"))
    tagged = lambda df, area, texts: df.select(F.lit(area).alias("area"), "sid", "s", "ret", F.explode(F.array_compact(F.array(*texts))).alias("text"))
    prices = [F.when(F.col("ret") > 5, _RETURN), F.when(F.col("close").isNull() | (F.col("close") <= 0), "no price")]
    own = [F.when(F.col("source").isNull(), "no share count"), F.when(F.col("flag").isNotNull(), "value moved otherwise than the return")]
    return tagged(day, "prices", prices).unionByName(tagged(caps, "market caps", own))


@query(f"WITH {_AREAS} SELECT area, sid, s, text FROM ex")
def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What staging found odd, each a row with its area and a text; each input is read once."""
    told = F.format_string("return of %d percent", F.round(F.col("ret") * 100).cast("long"))
    return _exceptions(spark, sf_dir).select("area", "sid", "s", F.when(F.col("text") == _RETURN, told).otherwise(F.col("text")).alias("text"))


@query(f"WITH {_AREAS} SELECT area, count(*) AS rows, count(DISTINCT sid) AS entities, min(s) AS first, max(s) AS last FROM ex GROUP BY area")
def staging_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the staging report."""
    return _exceptions(spark, sf_dir).groupBy("area").agg(F.count("*").alias("rows"), F.countDistinct("sid").alias("entities"), F.min("s").alias("first"), F.max("s").alias("last"))


@query(f"WITH {DAY} SELECT sid % 50 AS issuer, s, count(*) AS lines, round(sum(amount), 4) AS amount FROM day GROUP BY ALL")
def to_issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of securities under their issuers."""
    day = day_panel(spark, sf_dir)
    issuers = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid")).distinct().withColumn("issuer", F.col("sid") % 50)
    return day.join(issuers, "sid").groupBy("issuer", "s").agg(F.count("*").alias("lines"), r(F.sum("amount"), 4).alias("amount"))


@query(f"""WITH {YEARS}, st AS ({ORACLE['structural_sigma']}), l AS (SELECT p.year, p.sid, industry, cap, mean_order / 997 AS own, least(1, greatest(0, (n_orders - 1) / 3.0)) AS gamma, structural FROM p JOIN st USING (year, sid)),
b AS (SELECT *, gamma * own + (1 - gamma) * structural AS blended FROM l), m AS (SELECT year, industry, sum(cap * blended) / sum(cap) AS mu FROM b GROUP BY ALL),
d AS (SELECT year, industry, any_value(mu) AS mu, sqrt(avg((blended - mu) * (blended - mu))) AS delta FROM b JOIN m USING (year, industry) GROUP BY ALL)
SELECT year, sid, round(gamma, 6) AS gamma, round(blended, 6) AS blended, round(CASE WHEN delta + 0.1 * abs(blended - mu) = 0 THEN blended ELSE (0.1 * abs(blended - mu) * mu + delta * blended) / (delta + 0.1 * abs(blended - mu)) END, 6) AS shrunk FROM b JOIN d USING (year, industry)""")
def specific_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specific deviations through their layers: an entity's own, blended with the structural by its coverage, shrunk to its group."""
    structural = stored(structural_sigma(spark, sf_dir), "structural")  # the shrinkage reads it three times
    x = cross_years(spark, sf_dir).join(structural, ["year", "sid"])
    x = x.withColumn("gamma", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("n_orders") - 1) / 3)))
    x = x.withColumn("blended", F.col("gamma") * F.col("mean_order") / 997 + (1 - F.col("gamma")) * F.col("structural"))
    return cs.shrink(x, ["year", "industry"], "blended", "cap", 0.1).select("year", "sid", r("gamma").alias("gamma"), r("blended").alias("blended"), r("shrunk").alias("shrunk"))


@query(f"""WITH {YEARS}, {_FIT}, st AS ({ORACLE['structural_sigma']}), im AS (SELECT year, count(*) FILTER (n_orders <= 1) / count(*) AS share FROM p GROUP BY year),
mk AS (SELECT year, sum(cap * y) / sum(cap) AS mkt FROM f1 GROUP BY year), sp AS (SELECT year, bool_and(structural > 0) AS good, median(structural) * sqrt(12) AS med FROM st GROUP BY year)
SELECT year, 'imputation' AS gate, 'WARN' AS level, share <= 0.2 AS ok FROM im UNION ALL SELECT year, 'country_tracking', 'WARN', abs(c - mkt) < 0.05 FROM ctry JOIN mk USING (year)
UNION ALL SELECT year, 'specific_coverage', 'FAIL', good FROM sp UNION ALL SELECT year, 'specific_level', 'WARN', med BETWEEN 100 AND 1000 FROM sp""")
def specific_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of imputation, of the country return against the market's, and of the specific forecasts."""
    rows = lambda df, gate, level, ok: df.select("year", F.lit(gate).alias("gate"), F.lit(level).alias("level"), ok.alias("ok"))
    imputed = cross_years(spark, sf_dir).groupBy("year").agg((F.count(F.when(F.col("n_orders") <= 1, 1)) / F.count("*")).alias("share"))
    market = _regression_input(spark, sf_dir).select("year", "y", "style", "industry", "cap", "v").na.drop().groupBy("year").agg((F.sum(F.col("cap") * F.col("y")) / F.sum("cap")).alias("mkt"))
    country = factor_returns_wls(spark, sf_dir).filter("factor = 'country'").join(market, "year")
    sigma = stored(structural_sigma(spark, sf_dir), "structural")
    middle = cs.quantiles(sigma, ["year"], "structural", {"med": 0.5})
    return (
        rows(imputed, "imputation", "WARN", F.col("share") <= 0.2).unionByName(rows(country, "country_tracking", "WARN", F.abs(F.col("f") - F.col("mkt")) < 0.05))
        .unionByName(rows(sigma.groupBy("year").agg(F.min(F.col("structural") > 0).alias("good")), "specific_coverage", "FAIL", F.col("good")))
        .unionByName(rows(middle, "specific_level", "WARN", (F.col("med") * F.sqrt(F.lit(12.0))).between(100, 1000)))
    )


@query(f"""WITH RECURSIVE {_SIGMA}, vr AS ({ORACLE['factor_regime']})
SELECT m, 'factor_shock' AS gate, 'WARN' AS level, coalesce(max(abs(ret / sigma)) FILTER (sigma > 0) <= 3, true) AS ok FROM sg GROUP BY m UNION ALL SELECT m, 'vra', 'WARN', lam BETWEEN 0.5 AND 2 FROM vr""")
def forecast_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each session's factor returns against their forecasts, and of the regime multiplier."""
    shock = _sigma(spark, sf_dir).groupBy("m").agg(F.max(F.when(F.col("sigma") > 0, F.abs(F.col("ret") / F.col("sigma")))).alias("z"))
    shock = shock.select("m", F.lit("factor_shock").alias("gate"), F.lit("WARN").alias("level"), F.coalesce(F.col("z") <= 3, F.lit(True)).alias("ok"))
    return shock.unionByName(factor_regime(spark, sf_dir).select("m", F.lit("vra").alias("gate"), F.lit("WARN").alias("level"), F.col("lam").between(0.5, 2).alias("ok")))


@query(f"""WITH {_SIGMA}, h AS (SELECT *, CASE WHEN count(ret) OVER w = 3 THEN sum(ret) OVER w END AS got FROM sg WINDOW w AS (PARTITION BY factor ORDER BY m RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)),
b AS (SELECT factor, got / (sigma * sqrt(3)) AS b FROM h WHERE sigma > 0 AND got IS NOT NULL), s AS (SELECT factor, count(*) AS n, stddev_samp(b) AS bias FROM b GROUP BY factor HAVING count(*) >= 3)
SELECT factor, n, round(bias, 6) AS bias, round(1 - sqrt(2.0 / n), 6) AS low, round(1 + sqrt(2.0 / n), 6) AS high, bias BETWEEN 1 - sqrt(2.0 / n) AND 1 + sqrt(2.0 / n) AS inside FROM s""")
def horizon_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias of each factor's forecasts over three whole months, with the band that chance allows."""
    w = ts.session_frame("factor", "m", 0, 2)
    x = _sigma(spark, sf_dir).withColumn("got", F.when(F.count("ret").over(w) == 3, F.sum("ret").over(w)))
    b = x.select("factor", F.when(F.col("sigma") > 0, F.col("got") / (F.col("sigma") * F.sqrt(F.lit(3.0)))).alias("b")).filter("b IS NOT NULL")
    s = b.groupBy("factor").agg(F.count("*").alias("n"), F.stddev_samp("b").alias("bias")).filter("n >= 3")
    low, high = 1 - F.sqrt(2.0 / F.col("n")), 1 + F.sqrt(2.0 / F.col("n"))
    return s.select("factor", "n", r("bias").alias("bias"), r(low).alias("low"), r(high).alias("high"), F.col("bias").between(low, high).alias("inside"))


@query(f"""WITH {_COV}, {_HOLD}, full_cov AS (SELECT i, j, cov FROM cov UNION ALL SELECT j, i, cov FROM cov WHERE i < j),
fx AS (SELECT i AS factor, sum(cov * x) AS fx FROM full_cov JOIN h ON j = factor GROUP BY 1), p AS (SELECT factor, x, fx, sqrt(cov) AS own, sqrt(sum(x * fx) OVER ()) AS sigma FROM h JOIN fx USING (factor) JOIN cov ON i = factor AND j = factor)
SELECT factor, round(x, 8) AS x, round(own, 6) AS volatility, round(fx / (own * sigma), 6) AS rho, round(x * fx / sigma, 8) AS risk FROM p""")
def exposure_volatility_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio's risk as exposure times volatility times correlation, factor by factor."""
    c = stored(_cov(spark, sf_dir), "cov")  # a row per pair of factors
    parts = risk.decompose(_holdings(spark, sf_dir), c)
    own = c.filter("i = j").select(F.col("i").alias("factor"), F.sqrt("cov").alias("own"))
    x = parts.join(own, "factor")
    return x.select("factor", r("x", 8).alias("x"), r("own").alias("volatility"), r(F.try_divide("mctr", F.nullif("own", F.lit(0.0)))).alias("rho"), r(F.col("x") * F.col("mctr"), 8).alias("risk"))


_CHAIN = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query(f"""WITH o AS (SELECT o_custkey AS sid, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS concept, max(o_totalprice) AS value FROM orders GROUP BY ALL), d AS (SELECT DISTINCT sid, date FROM o),
c0 AS (SELECT d.*, CASE WHEN date_diff('day', o.date, d.date) <= 180 THEN value END AS v0 FROM d ASOF LEFT JOIN (SELECT * FROM o WHERE concept = '{_CHAIN[0]}') o ON d.sid = o.sid AND d.date >= o.date),
c1 AS (SELECT d.*, CASE WHEN date_diff('day', o.date, d.date) <= 180 THEN value END AS v1 FROM c0 d ASOF LEFT JOIN (SELECT * FROM o WHERE concept = '{_CHAIN[1]}') o ON d.sid = o.sid AND d.date >= o.date),
c2 AS (SELECT d.*, CASE WHEN date_diff('day', o.date, d.date) <= 180 THEN value END AS v2 FROM c1 d ASOF LEFT JOIN (SELECT * FROM o WHERE concept = '{_CHAIN[2]}') o ON d.sid = o.sid AND d.date >= o.date)
SELECT sid, date, coalesce(v0, v1, v2) AS value, CASE WHEN v0 IS NOT NULL THEN '{_CHAIN[0]}' WHEN v1 IS NOT NULL THEN '{_CHAIN[1]}' WHEN v2 IS NOT NULL THEN '{_CHAIN[2]}' END AS concept FROM c2""")
def fresh_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each date the first concept of a list whose latest value is at most 180 days old."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("concept")).agg(F.max("o_totalprice").alias("value"))
    return va.fresh_by_priority(o.select("sid", "date").distinct(), o, ["sid"], "date", "concept", "value", _CHAIN, 180)


def _predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, day = table(spark, sf_dir, "customer"), F.lit("1995-01-01").cast("date")
    issuers = customer.select(F.col("c_custkey").alias("issuer"), F.date_add(day, (F.col("c_custkey") * 37 % 1500).cast("int")).alias("first"))
    names = customer.select(F.col("c_custkey").alias("id"), F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("key"))
    date = F.col("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(date).alias("first_filed"), F.max(date).alias("last_filed"), F.count("*").alias("n"))
    return st.predecessors(issuers, names, spans, 30, 90)


@query("""WITH i AS (SELECT c_custkey AS issuer, DATE '1995-01-01' + CAST(c_custkey * 37 % 1500 AS INTEGER) AS first, concat_ws('|', c_nationkey, c_mktsegment) AS key FROM customer),
s AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS first_filed, max(o_orderdate)::DATE AS last_filed, count(*) AS n FROM orders GROUP BY 1),
late AS (SELECT i.*, s.first_filed AS own FROM i LEFT JOIN s ON id = issuer WHERE first_filed IS NULL OR first_filed > first + 30),
p AS (SELECT late.issuer, s.id, row_number() OVER (PARTITION BY late.issuer ORDER BY last_filed DESC, n DESC, s.id) AS k FROM late JOIN i AS other USING (key) JOIN s ON s.id = other.issuer
      WHERE other.issuer <> late.issuer AND last_filed >= late.first - 90 AND (own IS NULL OR s.first_filed < own))
SELECT issuer, issuer AS id, 'primary' AS role FROM i UNION ALL SELECT late.issuer, p.id, CASE WHEN p.id IS NULL THEN 'none' ELSE 'predecessor' END FROM late LEFT JOIN p ON p.issuer = late.issuer AND k = 1""")
def predecessor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers with the registrant of the same name that filed before them."""
    return _predecessors(spark, sf_dir)


#: Overrides by ticker and day; the second of ticker T3's holds, T99 is nobody's.
_OVERRIDES = [(1, "T3", "2020-02-01", "ENERGY"), (2, "T3", "2020-02-01", "TECH"), (3, "T7", "2021-01-01", "ENERGY"), (4, "T99", "2020-02-01", "TECH"), (5, "T11", "2019-01-01", "N11"), (6, "T5", "2020-01-20", "N0")]
_OVERRIDE_SQL = f"""r AS (SELECT s_suppkey AS sid, s_suppkey // 3 AS issuer, CASE WHEN s_nationkey % 5 > 0 THEN 'N' || s_nationkey END AS industry FROM supplier),
hist AS (SELECT s_suppkey AS sid, 'T' || s_nationkey AS ticker, DATE '2020-01-01' + CAST(s_suppkey AS INTEGER) AS start FROM supplier),
eras AS (SELECT *, lead(start) OVER (PARTITION BY ticker ORDER BY start) - 1 AS stop FROM hist),
o(ord, ticker, as_of, industry) AS (VALUES {', '.join(f"({k}, '{t}', DATE '{d}', '{i}')" for k, t, d, i in _OVERRIDES)}),
e AS (SELECT o.ord, o.ticker, o.industry, eras.sid, row_number() OVER (PARTITION BY ord ORDER BY coalesce(start <= as_of AND coalesce(stop, as_of) >= as_of, false) DESC, start DESC NULLS LAST, sid DESC) AS k FROM o LEFT JOIN eras ON eras.ticker = o.ticker),
oi AS (SELECT e.*, r.issuer FROM e LEFT JOIN r USING (sid) WHERE k = 1),
w AS (SELECT issuer, arg_max(industry, ord) AS to_industry, arg_max(ticker, ord) AS ticker FROM oi WHERE issuer IS NOT NULL GROUP BY issuer)"""


def _overridden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").withColumn("start", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_suppkey").cast("int")))
    rows = s.select(F.col("s_suppkey").alias("sid"), F.floor(F.col("s_suppkey") / 3).alias("issuer"), F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("N"), "s_nationkey")).alias("industry"))
    history = s.select(F.col("s_suppkey").alias("sid"), F.concat(F.lit("T"), "s_nationkey").alias("ticker"), "start")
    history = history.withColumn("end", F.date_sub(F.lead("start").over(Window.partitionBy("ticker").orderBy("start")), 1))
    overrides = spark.createDataFrame(_OVERRIDES, "ord int, ticker string, as_of string, industry string").withColumn("as_of", F.col("as_of").cast("date"))
    return st.overridden(rows, history, overrides)


@query(f"WITH {_OVERRIDE_SQL} SELECT sid, coalesce(to_industry, industry) AS industry, CASE WHEN to_industry IS NULL THEN 'code' ELSE 'override' END AS source FROM r LEFT JOIN w USING (issuer)")
def industry_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries by code, but for issuers an override names by one of their tickers on a day."""
    return _overridden(spark, sf_dir)[0]


@query(f"""WITH {_OVERRIDE_SQL} SELECT ticker, 'override_unresolved' AS issue, industry AS detail FROM oi WHERE issuer IS NULL UNION ALL
SELECT ticker, 'override_noop', CAST(sid AS VARCHAR) FROM r JOIN w USING (issuer) WHERE industry = to_industry UNION ALL SELECT NULL, 'unmapped', CAST(sid AS VARCHAR) FROM r LEFT JOIN w USING (issuer) WHERE coalesce(to_industry, industry) IS NULL""")
def override_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overridden(spark, sf_dir)[1]


@query()
def covariance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each forecast date has a covariance whose eigenvalues are all positive."""
    dates = brand_month(spark, sf_dir).filter("ret IS NOT NULL").select("m").distinct()
    found = dense.covariance_gate(dates, eigen_adjusted_cov(spark, sf_dir), "m", "cov_final")
    return found.select("m", "gate", "level", "ok")
