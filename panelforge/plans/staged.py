"""Queries of the staging layer: point-in-time reads, validity windows, corporate actions, names, set logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import staging as st
from panelforge.operators import timeseries as ts
from panelforge.plans.panels import BRAND, DAY, brand_month, day_panel, r, table
from panelforge.plans.registry import query
from panelforge.sources.store import stored

# Facts: an order's total is a value for the period that ends with its date, known when its line ships.
FACTS = """facts AS (SELECT o_custkey AS sid, CAST(o_orderdate AS DATE) AS period_end, CAST(l_shipdate AS DATE) AS available, max(o_totalprice) AS value
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) GROUP BY ALL),
daily AS (SELECT sid, available, max(struct_pack(p := period_end, a := available, v := value)) AS f FROM facts GROUP BY ALL),
known AS (SELECT sid, available, max(f) OVER (PARTITION BY sid ORDER BY available) AS k FROM daily)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sid"), F.col("o_orderdate").cast("date").alias("period_end"), F.col("o_totalprice").alias("value"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("available"))
    found = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).filter(F.col("available") > F.col("period_end"))
    return found.groupBy("sid", "period_end", "available").agg(F.max("value").alias("value"))


@query(f"WITH {FACTS} SELECT sid, available, k.p AS period_end, k.v AS value FROM known")
def pit_latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each entity on each day something became known."""
    return st.known_facts(facts(spark, sf_dir), ["sid"], "period_end", "available", "value")


@query(f"""WITH {FACTS}, d AS (SELECT DISTINCT o_custkey AS sid, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT d.sid, d.date, CASE WHEN date_diff('day', k.p, d.date) <= 400 THEN k.p END AS period_end, CASE WHEN date_diff('day', k.p, d.date) <= 400 THEN k.v END AS value
FROM d ASOF LEFT JOIN known ON d.sid = known.sid AND d.date >= known.available""")
def pit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts known on each order date, null once their period is over 400 days old."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderdate").cast("date").alias("date")).distinct()
    return st.as_known(dates, facts(spark, sf_dir), ["sid"], "date", "period_end", "available", "value", 400)


@query("""WITH o AS (SELECT o_custkey AS sid, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_orderpriority AS concept, o_totalprice AS v FROM orders),
c AS (SELECT *, coalesce(last_value(CASE WHEN concept = '1-URGENT' THEN v END IGNORE NULLS) OVER w, last_value(CASE WHEN concept = '2-HIGH' THEN v END IGNORE NULLS) OVER w, last_value(CASE WHEN concept = '3-MEDIUM' THEN v END IGNORE NULLS) OVER w) AS chosen
  FROM o WINDOW w AS (PARTITION BY sid ORDER BY date, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, lag(chosen) OVER (PARTITION BY sid ORDER BY date, o_orderkey) AS before FROM c)
SELECT sid, date, o_orderkey, chosen FROM b WHERE chosen IS NOT NULL AND chosen IS DISTINCT FROM before""")
def concept_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of the first concept in order of priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", F.col("o_orderpriority").alias("concept"), F.col("o_totalprice").alias("v"))
    return st.chain_value(o, ["sid"], ["date", "o_orderkey"], "concept", "v", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("sid", "date", "o_orderkey", "chosen")


@query("""WITH q AS (SELECT o_custkey AS sid, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS q, sum(o_totalprice) AS spend FROM orders GROUP BY ALL),
y AS (SELECT sid, year, q, sum(spend) OVER (PARTITION BY sid, year ORDER BY q) AS ytd FROM q)
SELECT y.sid, y.year, y.q, round(CASE WHEN y.q = 4 THEN y.ytd ELSE f.ytd + y.ytd - p.ytd END, 2) AS ttm
FROM y LEFT JOIN y f ON f.sid = y.sid AND f.year = y.year - 1 AND f.q = 4 LEFT JOIN y p ON p.sid = y.sid AND p.year = y.year - 1 AND p.q = y.q""")
def trailing_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve trailing months from full years and years to date."""
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("q")).agg(F.sum("o_totalprice").alias("spend"))
    ytd = q.withColumn("ytd", F.sum("spend").over(Window.partitionBy("sid", "year").orderBy("q"))).drop("spend")
    return st.trailing_twelve(ytd, ["sid"], "year", "q", "ytd").select("sid", "year", "q", r("ttm", 2).alias("ttm"))


# The lengths in days of a quarter, half a year, nine months and a year.
DURATIONS = [("Q", 80, 100), ("H", 170, 195), ("9M", 260, 285), ("FY", 350, 380)]


@query("""SELECT CASE WHEN d BETWEEN 80 AND 100 THEN 'Q' WHEN d BETWEEN 170 AND 195 THEN 'H' WHEN d BETWEEN 260 AND 285 THEN '9M' WHEN d BETWEEN 350 AND 380 THEN 'FY' ELSE 'none' END AS kind, count(*) AS n
FROM (SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def duration_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods between two dates by their length."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    d = F.abs(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
    kind = F.coalesce(*(F.when(d.between(lo, hi), name) for name, lo, hi in DURATIONS), F.lit("none"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {DAY}, n AS (SELECT sid, s, date, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day),
eras AS (SELECT sid, min(date) AS valid_from, max(date) AS valid_to, row_number() OVER (PARTITION BY sid ORDER BY min(s)) AS era FROM n GROUP BY sid, g)
SELECT event_id, user_id AS sid, era FROM events JOIN eras ON user_id = sid AND CAST(ts AS DATE) BETWEEN valid_from AND valid_to WHERE event_type = 'purchase'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the era of its user that holds it."""
    runs = ts.islands(day_panel(spark, sf_dir).select("sid", "s", "date"), "sid", "s", "era")
    eras = runs.groupBy("sid", "era").agg(F.min("date").alias("valid_from"), F.max("date").alias("valid_to"))
    events = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("sid"), F.col("ts").cast("date").alias("date"))
    return st.validity_join(events, eras, ["sid"], "date", "valid_from", "valid_to").select("event_id", "sid", F.col("era").cast("long").alias("era"))


RANGES = [(1, 10, 20, "metal"), (2, 1, 15, "light"), (3, 15, 35, "heavy"), (4, 30, 45, "bulk")]


@query(f"""WITH k(ord, lo, hi, industry) AS (VALUES {', '.join(map(str, RANGES))})
SELECT p_partkey, p_size, (SELECT arg_min(industry, ord) FROM k WHERE p_size BETWEEN lo AND hi) AS industry FROM part""")
def sic_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of overlapping code ranges that holds a code."""
    ranges = spark.createDataFrame(RANGES, "ord int, lo int, hi int, industry string")
    return st.first_match(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ranges, "p_size", "lo", "hi", "ord", "industry", ["p_partkey"])


@query(f"""WITH {DAY}, m AS (SELECT a.sid, a.s, a.volume, median(b.volume) AS med FROM day a LEFT JOIN day b ON a.sid = b.sid AND b.s <> a.s AND b.s BETWEEN a.s - 4 AND a.s + 4 GROUP BY ALL)
SELECT sid, s, coalesce(volume > 3 * med OR volume * 3 < med, false) AS outlier FROM m""")
def neighbour_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts more than three times off the median of the sessions around them."""
    day = day_panel(spark, sf_dir).select("sid", "s", F.col("volume").cast("double").alias("volume"))
    return day.select("sid", "s", st.neighbour_outliers(day, "sid", "s", "volume", 4, 3.0).alias("outlier"))


@query("""WITH e AS (SELECT event_id, user_id, ts, value, event_type FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase'), v AS (SELECT * FROM e WHERE event_type = 'view'),
b AS (SELECT p.*, v.value AS before, v.ts AS bts FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts),
a AS (SELECT b.*, v.value AS after, v.ts AS ats FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts <= v.ts)
SELECT event_id, coalesce(abs(ln(after / before)) < abs(ln(after / before) - ln(2)), false) AS contradicted FROM
(SELECT event_id, CASE WHEN date_diff('day', CAST(bts AS DATE), CAST(ts AS DATE)) <= 5 AND before > 0 THEN before END AS before, CASE WHEN date_diff('day', CAST(ts AS DATE), CAST(ats AS DATE)) <= 5 AND after > 0 THEN after END AS after FROM a)""")
def split_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the values just before and after an event speak for no change rather than a doubling."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    v = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("bts"), F.col("value").alias("before"))
    x = ts.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), v, ["user_id"], "ts", "bts", ["before"], strict=True)
    x = ts.asof(x, v.select("user_id", F.col("bts").alias("ats"), F.col("before").alias("after")), ["user_id"], "ts", "ats", ["after"], forward=True)
    days = lambda a, b: F.datediff(F.col(b).cast("date"), F.col(a).cast("date"))
    before = F.when((days("bts_asof", "ts") <= 5) & (F.col("before") > 0), F.col("before"))
    after = F.when((days("ts", "ats_asof") <= 5) & (F.col("after") > 0), F.col("after"))
    seen = F.ln(after / before)
    return x.select("event_id", F.coalesce(F.abs(seen) < F.abs(seen - F.ln(F.lit(2.0))), F.lit(False)).alias("contradicted"))


@query("""WITH b AS (SELECT DISTINCT user_id AS sid FROM events WHERE event_type = 'purchase'), c AS (SELECT c_custkey AS sid FROM customer), r AS (SELECT DISTINCT user_id AS sid FROM events WHERE event_type = 'refund')
SELECT 'both' AS kind, count(*) AS n FROM c SEMI JOIN b USING (sid) UNION ALL SELECT 'neither', count(*) FROM c ANTI JOIN b USING (sid)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT sid FROM b INTERSECT SELECT sid FROM r) UNION ALL SELECT 'except', count(*) FROM (SELECT sid FROM b EXCEPT SELECT sid FROM r)
UNION ALL SELECT 'union', count(*) FROM (SELECT sid FROM b UNION SELECT sid FROM c)
UNION ALL SELECT 'outer', count(*) FROM b FULL JOIN c USING (sid)""")
def set_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi, anti and full joins, intersection, difference and union of key sets."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), "event_type")
    b, refunds = (events.filter(F.col("event_type") == k).select("sid").distinct() for k in ("purchase", "refund"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"))
    parts = {"both": c.join(b, "sid", "left_semi"), "neither": c.join(b, "sid", "left_anti"), "intersect": b.intersect(refunds), "except": b.exceptAll(refunds), "union": b.union(c).distinct(), "outer": b.join(c, "sid", "full")}
    counted = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in parts.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.unionByName(x)
    return out


@query("""WITH c AS (SELECT n_name AS industry, r_name AS parent, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS m, sum(o_totalprice) AS t, sum(o_totalprice * o_totalprice) AS t2
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
g AS (SELECT i.industry, i.parent, d.m FROM (SELECT DISTINCT industry, parent FROM c) i CROSS JOIN (SELECT DISTINCT m FROM c) d),
n AS (SELECT g.*, coalesce(c.t * c.t / c.t2, 0) < 12 AS thin FROM g LEFT JOIN c USING (industry, parent, m)),
b AS (SELECT *, sum(thin::INT) OVER (PARTITION BY industry ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS breaches FROM n)
SELECT industry, m, CASE WHEN breaches > 4 THEN parent ELSE industry END AS merged FROM b""")
def thin_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries of few effective members in over four of twelve months report as their parent."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("parent"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    m = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("m")
    orders = table(spark, sf_dir, "orders").select("o_custkey", m, F.col("o_totalprice").alias("t"))
    cells = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("industry", "parent", "m").agg((F.sum("t") * F.sum("t") / F.sum(F.col("t") * F.col("t"))).alias("neff"))
    grid = cells.select("industry", "parent").distinct().crossJoin(F.broadcast(cells.select("m").distinct()))  # industries x months
    thin = grid.join(cells, ["industry", "parent", "m"], "left").withColumn("thin", (F.coalesce("neff", F.lit(0.0)) < 12).cast("int"))
    breaches = F.sum("thin").over(ts.session_frame("industry", "m", -11, 0))
    return thin.select("industry", "m", F.when(breaches > 4, F.col("parent")).otherwise(F.col("industry")).alias("merged"))


_ADJ = f"""{DAY}, a AS (SELECT sid, s, close, close * CASE WHEN s < 10 THEN 0.5 WHEN s < 20 THEN 0.98 ELSE 1 END AS adjusted FROM day),
pr AS (SELECT *, lag(close) OVER w AS pc, lag(adjusted) OVER w AS pa FROM a WINDOW w AS (PARTITION BY sid ORDER BY s)),
g AS (SELECT *, CASE WHEN pc > 0 AND close > 0 THEN (adjusted / pa) / (close / pc) END AS g FROM pr),
k AS (SELECT g.*, (SELECT arg_min(ratio, struct_pack(e := abs(g / ratio - 1), m := m)) FROM (SELECT m, CASE WHEN g >= 1 THEN round_even(g * m, 0) / m ELSE m / round_even(m / g, 0) END AS ratio FROM (VALUES (1), (2), (3), (4)) v(m)) WHERE ratio <> 1 AND isfinite(ratio) AND ratio > 0 AND (m = 1 OR (ratio > 1 / 3.0 AND ratio < 3))) AS ratio FROM g),
sp AS (SELECT *, CASE WHEN abs(g / ratio - 1) <= 0.005 AND abs(g - 1) > 0.15 THEN ratio ELSE 1.0 END AS k FROM k),
ac AS (SELECT *, coalesce(g / k, 1.0) AS rest FROM sp),
act AS (SELECT *, CASE WHEN k <> 1 THEN 'split' WHEN rest - 1 < -0.0005 THEN 'unexplained' WHEN rest - 1 > 0.15 THEN 'distribution' WHEN rest - 1 > 0.0005 THEN 'dividend' ELSE '' END AS action,
  CASE WHEN rest - 1 > 0.0005 THEN pc * (1 - 1 / rest) ELSE 0 END AS cash FROM ac)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day closes with a made-up 2:1 split and a dividend in the adjusted series."""
    w = Window.partitionBy("sid").orderBy("s")
    x = day_panel(spark, sf_dir).select("sid", "s", "close").withColumn("adjusted", F.col("close") * F.when(F.col("s") < 10, 0.5).when(F.col("s") < 20, 0.98).otherwise(1.0))
    return st.implied_actions(x.withColumns({"prev_close": F.lag("close").over(w), "prev_adjusted": F.lag("adjusted").over(w)}))


@query(f"""WITH {_ADJ} SELECT sid, s, action, round(k, 6) AS split_ratio, round(cash / k, 6) AS dividend, round((k * close + cash) / pc - 1, 6) AS ret FROM act""")
def implied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions and total returns, those on prices of 0 too: such a day has no action, and the return on a price of 0 isn't finite."""
    x = _actions(spark, sf_dir)
    now = F.col("split_ratio") * F.col("close") + F.col("dividend") * F.col("split_ratio")
    endless = F.when(now > 0, float("inf")).when(now < 0, float("-inf")).when(now == 0, float("nan"))
    ret = F.when(F.col("prev_close") == 0, endless).otherwise(now / F.col("prev_close") - 1)
    return x.select("sid", "s", F.replace("action", F.lit("bad_price")).alias("action"), r("split_ratio").alias("split_ratio"), r("dividend").alias("dividend"), r(ret).alias("ret"))


@query(f"""WITH {_ADJ} SELECT sid, s, round(product(k) OVER (PARTITION BY sid ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_split, round(coalesce(product(k) OVER (PARTITION BY sid ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1), 6) AS adj_factor FROM act""")
def adjustment_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running split product and the product still to come."""
    x = _actions(spark, sf_dir)
    return x.select("sid", "s", r(st.forward_factor("split_ratio", "sid", "s")).alias("cum_split"), r(st.backward_factor("split_ratio", "sid", "s")).alias("adj_factor"))


@query(f"""WITH {DAY} SELECT sid, s, coalesce(amount > 3 * median(amount) OVER (PARTITION BY sid ORDER BY s RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING), false) AS special FROM day""")
def special_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts over three times the median of the entity's earlier ones."""
    earlier = ts.session_frame("sid", "s", -15, -1)
    return day_panel(spark, sf_dir).select("sid", "s", F.coalesce(F.col("amount") > 3 * F.percentile("amount", F.lit(0.5)).over(earlier), F.lit(False)).alias("special"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), p AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM d),
y AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS asof, 2.0 + month(o_orderdate) / 10.0 AS y FROM orders)
SELECT p.date, date_diff('day', p.prev, p.date) AS days, round(y.y / 100 * date_diff('day', p.prev, p.date) / 360, 10) AS rf FROM p ASOF LEFT JOIN y ON p.prev >= y.asof""")
def risk_free_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A yield known at the previous session, accrued over actual days of a 360-day year."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    one = F.lit(0).alias("calendar")  # one row per session: a calendar, not data
    d = orders.distinct().select("date", one).withColumn("prev", F.lag("date").over(Window.partitionBy("calendar").orderBy("date")))
    y = orders.select(F.trunc("date", "month").alias("asof"), (F.lit(2.0) + F.month("date") / 10.0).alias("y"), one).distinct()
    found = ts.asof(d, y, ["calendar"], "prev", "asof", ["y"])
    days = F.datediff("date", "prev")
    return found.select("date", days.cast("long").alias("days"), r(F.col("y") / 100 * days / 360, 10).alias("rf"))


@query(f"""WITH {DAY}, u AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), f AS (SELECT event_id, CAST(ts AS DATE) AS filed FROM events WHERE event_type = 'refund'),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM u)
SELECT event_id, filed, (SELECT min(date) FROM c WHERE date > filed) AS available FROM f""")
def available_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first session strictly after each filing."""
    events = table(spark, sf_dir, "events")
    one = F.lit(0).alias("calendar")
    sessions = events.select(F.col("ts").cast("date").alias("session"), one).distinct()
    filed = events.filter("event_type = 'refund'").select("event_id", F.col("ts").cast("date").alias("filed"))
    # The calendar is a row per session: next sessions are looked up in it, not in the data.
    nxt = ts.asof(sessions.select(F.col("session").alias("filed"), "calendar"), sessions, ["calendar"], "filed", "session", [], forward=True, strict=True)
    return filed.join(F.broadcast(nxt.select("filed", F.col("session_asof").alias("available"))), "filed", "left").select("event_id", "filed", "available")


def _nested(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


# The part names are plain words; the suffixes added to them are all such that go.
_KEY = f"""array_to_string(list_filter(string_split(upper(p_name), ' ') || ['AND'], lambda w: w <> '' AND NOT list_contains([{', '.join(f"'{w}'" for w in st.LEGAL)}], w)), ' ')"""


@query(f"SELECT p_partkey, {_KEY} AS key FROM part")
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" & Co (The) Inc. CL A")).alias("name"))
    return named.select("p_partkey", st.name_key(F.col("name")).alias("key"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM w""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", r(st.token_similarity(F.lower("p_name"), F.lower("p_type"))).alias("jaccard"))


@query("""SELECT p_partkey, translate(regexp_replace(regexp_replace(upper(trim(' ' || replace(p_brand, '#', '-') || CASE WHEN p_partkey % 2 = 0 THEN '.us' ELSE '-202301' END || ' ')), '\\.US$', ''), '-\\d{6}$', ''), '-/', '..') AS symbol FROM part""")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, ".us").otherwise("-202301"), F.lit(" "))
    return p.select("p_partkey", st.symbol(code).alias("symbol"))


@query(f"""WITH {DAY}, i AS (SELECT sid // 4 AS issuer, sid, s, amount, dense_rank() OVER (PARTITION BY sid // 4 ORDER BY s DESC) AS k FROM day),
m AS (SELECT issuer, sid, median(amount) AS med FROM i WHERE k <= 20 GROUP BY ALL)
SELECT issuer, arg_max(sid, struct_pack(a := med, b := -sid)) AS primary_sid, count(*) AS classes FROM m GROUP BY issuer""")
def primary_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each issuer's classes the one with the largest median amount over the issuer's last twenty sessions."""
    day = stored(day_panel(spark, sf_dir).select(F.floor(F.col("sid") / 4).alias("issuer"), "sid", "s", "amount"), "classes")
    latest = F.row_number().over(Window.partitionBy("issuer").orderBy(F.col("s").desc()))
    last = day.select("issuer", "s").distinct().withColumn("k", latest).filter("k <= 20").groupBy("issuer").agg(F.min("s").alias("_from"))
    med = day.join(last, "issuer").filter("s >= _from").groupBy("issuer", "sid").agg(F.median("amount").alias("med"))
    return med.groupBy("issuer").agg(F.max_by("sid", F.struct("med", -F.col("sid"))).alias("primary_sid"), F.count("*").alias("classes"))


# The factors of the model, as columns.
BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query(f"""WITH {BRAND} SELECT m, {', '.join(f"round(max(ret) FILTER (factor = '{b}'), 6) AS b{b[-2:]}" for b in BRANDS)} FROM bm GROUP BY m""")
def pivot_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = brand_month(spark, sf_dir).groupBy("m").pivot("factor", BRANDS).agg(r(F.first("ret")))
    return wide.select("m", *(F.col(f"`{b}`").alias(f"b{b[-2:]}") for b in BRANDS))
