"""Queries of checks, calendars, histories, identifiers and the model's daily gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge import functions as fn
from panelforge.operators import crosssection as cs
from panelforge.operators import exposures as ex
from panelforge.operators import staging as st
from panelforge.operators import timeseries as ts
from panelforge.plans.crosssections import estu, exposure_stability, regression_stats, specific_returns, variance_inflation
from panelforge.plans.panels import BRAND, DAY, YEARS, brand_month, cross_years, day_panel, r, table
from panelforge.plans.registry import ORACLE, query
from panelforge.sources.store import stored

PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("SELECT o_orderkey, CAST(left(o_orderpriority, 1) AS INTEGER) AS code FROM orders")
def strict_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column by a mapping in which every value must occur."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.strict_map(F.col("o_orderpriority"), PRIORITY).cast("int").alias("code"))


@query(f"""WITH {DAY}, e AS (SELECT sid, s, lag(s) OVER (PARTITION BY sid ORDER BY s) AS x FROM day)
SELECT count(*) AS rows, count(*) FILTER (x IS NOT NULL AND x <> s - 1) AS violations FROM e""")
def point_in_time_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose exposures aren't those of the session right before their return."""
    x = day_panel(spark, sf_dir).select("sid", "s").withColumn("x", F.lag("s").over(Window.partitionBy("sid").orderBy("s")))
    return x.agg(F.count("*").alias("rows"), F.count(F.when(F.col("x").isNotNull() & (F.col("x") != F.col("s") - 1), 1)).alias("violations"))


@query("SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL) AND c_nationkey IS NOT NULL")
def unknown_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in use that the model's list of groups doesn't have."""
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nation")).filter("nation IS NOT NULL").distinct()
    return used.join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation")), "nation", "left_anti")


@query("SELECT user_id AS sid, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def filing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day, and numbers of different days and kinds, of each entity's records."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("ts").cast("date").alias("d"), "event_type")
    return e.groupBy("sid").agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.countDistinct("d").alias("days"), F.countDistinct("event_type").alias("kinds"))


@query("""WITH k AS (SELECT user_id AS sid, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT sid, round(median(value), 6) AS med FROM k WHERE k <= 5 GROUP BY sid""")
def latest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each entity's five latest values."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    last = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value").withColumn("k", k).filter("k <= 5")
    return last.groupBy(F.col("user_id").alias("sid")).agg(r(F.median("value")).alias("med"))


@query(f"""WITH {YEARS}, m AS (SELECT year, sum(cap * acct) / sum(cap) AS mu FROM p GROUP BY year)
SELECT year, round(sqrt(sum(cap * (acct - mu) * (acct - mu)) / sum(cap)), 4) AS deviation FROM p JOIN m USING (year) GROUP BY year""")
def weighted_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cap-weighted population deviation, in two passes."""
    x = cs.attach(cross_years(spark, sf_dir), ["year"], _mu=cs.weighted_mean("acct", "cap"))
    off = F.col("acct") - F.col("_mu")
    return x.groupBy("year").agg(r(F.sqrt(F.sum(F.col("cap") * off * off) / F.sum("cap")), 4).alias("deviation"))


@query(f"""WITH {DAY} SELECT sid, s, count(ret) OVER w AS history, coalesce(bool_or(ret > 0.5) OVER w, false) AS jumped FROM day WINDOW w AS (PARTITION BY sid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid returns so far, and whether any was over a half so far."""
    w = Window.partitionBy("sid").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return day_panel(spark, sf_dir).select("sid", "s", F.count("ret").over(w).alias("history"), F.coalesce(F.max(F.col("ret") > 0.5).over(w), F.lit(False)).alias("jumped"))


@query(f"""WITH {DAY} SELECT sid, s, CAST(row_number() OVER (PARTITION BY s ORDER BY ret DESC NULLS LAST, volume, sid) AS BIGINT) AS place FROM day""")
def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order by several keys, up and down, nulls last; of all sessions in one sort by ranges."""
    day = day_panel(spark, sf_dir).select("sid", "s", "volume", "ret", F.col("ret").isNull().alias("none"), (-F.col("ret")).alias("down"))
    return ts.ranked(day, ["s"], ["none", "down", "volume", "sid"], "place").select("sid", "s", F.col("place").cast("long").alias("place"))


@query("""SELECT p_partkey, replace(replace(regexp_replace(upper(trim(' brk.' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '.us ')), '\\.US$', ''), '.', '-'), '/', '-') AS vendor,
regexp_replace('X' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_OLD' WHEN p_partkey % 3 = 1 THEN '_old2' ELSE '' END, '(?i)_old\\d*$', '') AS code, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik,
'size ' || p_size || ' of ' || p_brand AS text,
CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice * pow(10.0, 2 - floor(log10(abs(p_retailprice))))) / pow(10.0, 2 - floor(log10(abs(p_retailprice)))) END AS three_digits FROM part""")
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of codes, text by template, three significant digits."""
    key = F.col("p_partkey")
    code = F.concat(F.lit("X"), key, F.when(key % 3 == 0, "_OLD").when(key % 3 == 1, "_old2").otherwise(""))
    ticker = F.concat(F.lit(" brk."), F.char(65 + key % 26), F.lit(".us "))
    return table(spark, sf_dir, "part").select(
        "p_partkey", fn.vendor_symbol(ticker).alias("vendor"), fn.without_old_suffix(code).alias("code"), fn.ten_digits(key).alias("cik"),
        F.format_string("size %d of %s", "p_size", "p_brand").alias("text"), fn.significant(F.col("p_retailprice"), 3).alias("three_digits"),
    )


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.50' WHEN 2 THEN '1e-3' ELSE p_brand END AS cell FROM part)
SELECT p_partkey, CASE WHEN trim(cell) = '' THEN 'empty' WHEN TRY_CAST(trim(cell) AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'text' END AS kind, TRY_CAST(trim(cell) AS DOUBLE) AS number FROM c""")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a CSV by what they hold."""
    k = F.col("p_partkey") % 4
    cell = F.when(k == 0, " ").when(k == 1, F.concat(F.col("p_size").cast("string"), F.lit(".50"))).when(k == 2, "1e-3").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.typed_cell(cell).alias("c")).select("p_partkey", "c.kind", "c.number")


@query(f"""WITH {BRAND} SELECT factor, round(stddev_samp(ret) * sqrt(12), 6) AS annual, round(var_samp(ret) * 21, 6) AS horizon, CAST(548 AS INTEGER) AS stale FROM bm GROUP BY factor""")
def scaled_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations by the year, variances over the horizon, and the age at which an eighteen months' fact is stale."""
    x = brand_month(spark, sf_dir).groupBy("factor").agg(F.stddev_samp("ret").alias("s"), F.var_samp("ret").alias("v"))
    return x.select("factor", r(fn.annual(F.col("s"))).alias("annual"), r(fn.monthly_variance(F.col("v"))).alias("horizon"), F.lit(fn.staleness_days(18)).cast("int").alias("stale"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM d)
SELECT a.date, a.i AS session, n.date AS next, p.date AS previous, f.date AS five_on, (SELECT count(*) FROM c WHERE c.date > a.date AND c.date <= a.date + 30) AS in_30_days FROM c a LEFT JOIN c n ON n.i = a.i + 1 LEFT JOIN c p ON p.i = a.i - 1 LEFT JOIN c f ON f.i = a.i + 5""")
def calendar_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's number, neighbours, the session five on, and the sessions of the 30 days after. A calendar: a row per session."""
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    days = Window.partitionBy(F.lit(0)).orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(1, 30)
    d = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return d.select("date", F.row_number().over(one).cast("long").alias("session"), F.lead("date").over(one).alias("next"), F.lag("date").over(one).alias("previous"), F.lead("date", 5).over(one).alias("five_on"), F.count("*").over(days).alias("in_30_days"))


@query(f"""WITH {DAY}, n AS (SELECT sid, s, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day), spells AS (SELECT sid, min(s) AS first, max(s) AS last FROM n GROUP BY sid, g)
SELECT s.s, count(*) AS members FROM (SELECT DISTINCT s FROM day) s JOIN spells ON s.s BETWEEN first AND last GROUP BY s.s""")
def daily_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each session, from spells: entries less exits up to it, so no spell is expanded into its days."""
    runs = ts.islands(day_panel(spark, sf_dir).select("sid", "s"), "sid", "s", "era").groupBy("sid", "era").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    change = runs.select(F.explode(F.array(F.struct(F.col("first").alias("s"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("s"), F.lit(-1).alias("n")))).alias("c"))
    change = change.groupBy("c.s").agg(F.sum("c.n").alias("n"))  # a row per session
    sessions = day_panel(spark, sf_dir).select("s").distinct()
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("s"))
    return sessions.withColumn("session", F.lit(True)).join(change, "s", "full").withColumn("members", so_far).filter("session").select("s", F.col("members").cast("long").alias("members"))


@query(f"""WITH {BRAND}, g AS (SELECT f.factor, m.m FROM (SELECT DISTINCT factor FROM bm) f CROSS JOIN (SELECT DISTINCT m FROM bm) m)
SELECT g.factor, g.m, round(coalesce(bm.ret, 0), 6) AS ret, bm.ret IS NOT NULL AS observed FROM g LEFT JOIN bm USING (factor, m)""")
def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel of factor returns: gaps are zero and marked. It has a row per factor and session."""
    x = brand_month(spark, sf_dir).select("factor", "m", "ret")
    grid = x.select("factor").distinct().crossJoin(x.select("m").distinct())
    return grid.join(x, ["factor", "m"], "left").select("factor", "m", r(F.coalesce("ret", F.lit(0.0))).alias("ret"), F.col("ret").isNotNull().alias("observed"))


@query(f"""WITH {DAY}, c AS (SELECT s, count(ret) / count(*) AS share, count(*) AS n FROM day WHERE s > (SELECT min(s) FROM day) GROUP BY s) SELECT s, n, round(share, 6) AS share FROM c ORDER BY share, s LIMIT 1""")
def worst_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session with the smallest share of entities that have a return."""
    day = day_panel(spark, sf_dir).groupBy("s").agg((F.count("ret") / F.count("*")).alias("share"), F.count("*").alias("n"))
    first = day.agg(F.min("s").alias("_first"))
    return day.crossJoin(F.broadcast(first)).filter(F.col("s") > F.col("_first")).orderBy("share", "s").limit(1).select("s", "n", r("share").alias("share"))


@query(f"""WITH {DAY}, n AS (SELECT sid, s, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day), seg AS (SELECT sid, min(s) AS first, max(s) AS last FROM n GROUP BY sid, g),
o AS (SELECT event_id, user_id AS sid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS at FROM events WHERE event_type = 'refund')
SELECT event_id, first, last FROM (SELECT o.event_id, seg.first, seg.last, row_number() OVER (PARTITION BY event_id ORDER BY first) AS k FROM o JOIN seg ON o.sid = seg.sid AND seg.first > o.at) WHERE k = 1""")
def later_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest segment of its entity to start after each event."""
    runs = ts.islands(day_panel(spark, sf_dir).select("sid", "s"), "sid", "s", "era").groupBy("sid", "era").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    at = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    events = table(spark, sf_dir, "events").filter("event_type = 'refund'").select("event_id", F.col("user_id").alias("sid"), at.alias("at"))
    found = ts.asof(events, runs, ["sid"], "at", "first", ["last"], forward=True, strict=True)
    return found.filter("first_asof IS NOT NULL").select("event_id", F.col("first_asof").alias("first"), "last")


_CHAIN = f"""{YEARS}, sa AS (SELECT year, sum(cap * acct) / sum(cap) AS am, stddev_pop(acct) AS sd FROM p WHERE in_estu GROUP BY year),
z AS (SELECT p.year, p.sid, p.cap, p.v, p.in_estu, (acct - am) / sd AS x, pow((acct - am) / sd, 3) AS y FROM p LEFT JOIN sa USING (year)),
m AS (SELECT year, sum(v * x) / sum(v) AS mx, sum(v * y) / sum(v) AS my FROM z WHERE in_estu GROUP BY year),
b AS (SELECT year, any_value(mx) AS mx, any_value(my) AS my, sum(v * (x - mx) * (y - my)) / sum(v * (x - mx) * (x - mx)) AS b FROM z JOIN m USING (year) WHERE in_estu GROUP BY year),
o AS (SELECT z.*, y - my - b * (x - mx) AS e FROM z JOIN b USING (year)),
t AS (SELECT year, avg(e) AS em, stddev_pop(e) AS es FROM o WHERE in_estu GROUP BY year),
tr AS (SELECT o.*, least(greatest(e, em - 3 * es), em + 3 * es) AS c FROM o JOIN t USING (year)),
m2 AS (SELECT year, sum(v * x) / sum(v) AS mx2, sum(v * c) / sum(v) AS mc FROM tr WHERE in_estu GROUP BY year),
b2 AS (SELECT year, any_value(mx2) AS mx2, any_value(mc) AS mc, sum(v * (x - mx2) * (c - mc)) / sum(v * (x - mx2) * (x - mx2)) AS bb FROM tr JOIN m2 USING (year) WHERE in_estu GROUP BY year),
o2 AS (SELECT tr.*, c - mc - bb * (x - mx2) AS e2 FROM tr JOIN b2 USING (year)),
f AS (SELECT year, sum(cap * e2) / sum(cap) AS fm, stddev_pop(e2) AS fs FROM o2 WHERE in_estu GROUP BY year),
fin AS (SELECT o2.*, (e2 - fm) / fs AS style FROM o2 JOIN f USING (year))"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stored(cross_years(spark, sf_dir).select("year", "sid", "acct", "cap", "v", "in_estu"), "panel")
    x = stored(cs.standardize(x, ["year"], "acct", "cap", estu(), "x").withColumn("y3", F.pow("x", F.lit(3))), "cubes")
    y = ex.orthogonalize_many(x, ["year"], {"y3": ["x"]}, "v", estu())
    e, m, s = ex.residual("y3", ["x"], "y3_f_"), F.col("y3_f_m"), F.col("y3_f_s")
    x = stored(y.select(*x.columns, F.least(F.greatest(e, m - 3 * s), m + 3 * s).alias("c")), "trimmed")
    y = ex.orthogonalize_many(x, ["year"], {"c": ["x"]}, "v", estu(), {"cap": F.col("cap")})
    return y.select(*x.columns, ((ex.residual("c", ["x"], "c_f_") - F.col("c_f_cap")) / F.col("c_f_s")).alias("style"))


@query(f"WITH {_CHAIN} SELECT year, sid, round(style, 5) AS style FROM fin")
def exposure_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A non-linear style through all its steps: standardise, orthogonalise, trim, orthogonalise again, standardise."""
    return _chain(spark, sf_dir).select("year", "sid", r("style", 5).alias("style"))


@query(f"WITH {_CHAIN} SELECT year, round(sum(cap * style) / sum(cap), 6) AS mean_cw, round(stddev_pop(style), 6) AS std_ew, count(*) AS n FROM fin WHERE in_estu GROUP BY year")
def exposure_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last step must leave: a cap-weighted mean of 0 and a deviation of 1."""
    x = _chain(spark, sf_dir).filter(estu())
    return x.groupBy("year").agg(r(cs.weighted_mean("style", "cap")).alias("mean_cw"), r(F.stddev_pop("style")).alias("std_ew"), F.count("*").alias("n"))


@query(f"""WITH u AS ({ORACLE['specific_returns']}), {YEARS}, b AS (SELECT year, u.sid, cap, u / (SELECT stddev_pop(u) FROM u u2 WHERE u2.year = u.year) AS b, CASE WHEN cap > 300000 THEN 'large' ELSE 'small' END AS grp FROM u JOIN p USING (year, sid))
SELECT grp AS "group", count(*) AS n, round(sqrt(sum(cap * b * b) / sum(cap)), 5) AS bias FROM b GROUP BY grp HAVING count(*) > 10""".replace("WITH u AS (WITH", "WITH u AS (WITH"))
def specific_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cap-weighted root mean square of standardised specific returns, by size, in groups of over ten."""
    u = cs.attach(specific_returns(spark, sf_dir), ["year"], _s=F.stddev_pop("u"))
    x = u.join(cross_years(spark, sf_dir).select("year", "sid", "cap"), ["year", "sid"]).withColumn("b", F.col("u") / F.col("_s"))
    by = F.when(F.col("cap") > 300000, "large").otherwise("small").alias("group")
    found = x.groupBy(by).agg(F.count("*").alias("n"), r(F.sqrt(F.sum(F.col("cap") * F.col("b") * F.col("b")) / F.sum("cap")), 5).alias("bias"))
    return found.filter("n > 10")


_GATES = f"""WITH reg AS ({ORACLE['regression_stats']}), vif AS ({ORACLE['variance_inflation']}), stab AS ({ORACLE['exposure_stability']}), mom AS ({ORACLE['exposure_moments']}),
v AS (SELECT year, max(vif) AS top FROM vif GROUP BY year), g AS (
SELECT year, 'exposure_moments' AS gate, 'FAIL' AS level, abs(mean_cw) < 0.001 AND abs(std_ew - 1) < 0.001 AS ok FROM mom
UNION ALL SELECT year, 'vif', 'FAIL', top <= 10 FROM v UNION ALL SELECT year, 'vif_warn', 'WARN', top <= 5 FROM v
UNION ALL SELECT year, 'stability', 'WARN', stability >= 0.5 FROM stab WHERE stability IS NOT NULL
UNION ALL SELECT year, 'regression', 'FAIL', abs(constraint_resid) < 0.0001 AND n >= 30 FROM reg UNION ALL SELECT year, 'fit', 'WARN', r2 BETWEEN 0.01 AND 0.95 FROM reg)"""


@query(f"{_GATES} SELECT * FROM g")
def model_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each period's model: exposures, inflation, stability, regression and fit, each a row."""
    def rows(df: DataFrame, gate: str, level: str, ok) -> DataFrame:
        return df.select("year", F.lit(gate).alias("gate"), F.lit(level).alias("level"), ok.alias("ok"))

    top = variance_inflation(spark, sf_dir).groupBy("year").agg(F.max("vif").alias("top"))
    reg = regression_stats(spark, sf_dir)
    moments = exposure_moments(spark, sf_dir)
    found = rows(moments, "exposure_moments", "FAIL", (F.abs("mean_cw") < 0.001) & (F.abs(F.col("std_ew") - 1) < 0.001))
    for part in (
        rows(top, "vif", "FAIL", F.col("top") <= 10), rows(top, "vif_warn", "WARN", F.col("top") <= 5),
        rows(exposure_stability(spark, sf_dir).filter("stability IS NOT NULL"), "stability", "WARN", F.col("stability") >= 0.5),
        rows(reg, "regression", "FAIL", (F.abs("constraint_resid") < 0.0001) & (F.col("n") >= 30)), rows(reg, "fit", "WARN", F.col("r2").between(0.01, 0.95)),
    ):
        found = found.unionByName(part)
    return found


@query(f"{_GATES} SELECT year, CASE WHEN bool_or(level = 'FAIL' AND NOT ok) THEN 'QUARANTINED' ELSE 'OK' END AS status FROM g GROUP BY year")
def model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period whose failing gates hold nothing back is OK, any other is quarantined."""
    g = model_gates(spark, sf_dir).groupBy("year").agg(F.max((F.col("level") == "FAIL") & ~F.col("ok")).alias("bad"))
    return g.select("year", F.when(F.col("bad"), "QUARANTINED").otherwise("OK").alias("status"))
