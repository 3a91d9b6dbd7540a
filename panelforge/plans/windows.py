"""Queries along time: as-of joins, islands, decayed windows, horizons, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.plans.panels import BRAND, DAY, brand_month, cross, day_panel, r, table
from panelforge.plans.registry import query


def _events(spark, sf_dir, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "ts", "value", "event_id")


@query("""
SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase of a user."""
    views = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    purchases = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    found = ts.asof(purchases, views, ["user_id"], "ts", "view_ts", ["view_value"])
    return found.withColumnRenamed("view_ts_asof", "view_ts")


@query("""
SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view at or after each purchase of a user."""
    views = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    purchases = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    return ts.asof(purchases, views, ["user_id"], "ts", "view_ts", ["view_value"], forward=True).withColumnRenamed("view_ts_asof", "view_ts")


@query("""
SELECT p.event_id, p.user_id, CASE WHEN date_diff('day', CAST(v.ts AS DATE), CAST(p.ts AS DATE)) <= 3 THEN v.value END AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view strictly before each purchase, null once it is over three days old."""
    views = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    purchases = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    found = ts.asof(purchases, views, ["user_id"], "ts", "view_ts", ["view_value"], strict=True)
    fresh = F.datediff(F.col("ts").cast("date"), F.col("view_ts_asof").cast("date")) <= 3
    return found.select("event_id", "user_id", F.when(fresh, F.col("view_value")).alias("view_value"))


@query(f"""WITH {DAY}, n AS (SELECT sid, s, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day)
SELECT sid, min(s) AS first_s, max(s) AS last_s, count(*) AS sessions FROM n GROUP BY sid, g""")
def eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive active sessions of each entity."""
    runs = ts.islands(day_panel(spark, sf_dir).select("sid", "s"), "sid", "s")
    return runs.groupBy("sid", "run").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("sessions")).drop("run")


@query(f"""WITH {DAY}, n AS (SELECT sid, s, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day)
SELECT sid, max(c) AS longest FROM (SELECT sid, count(*) AS c FROM n GROUP BY sid, g) GROUP BY sid""")
def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eras(spark, sf_dir).groupBy("sid").agg(F.max("sessions").alias("longest"))


@query(f"""WITH {DAY}, n AS (SELECT sid, s, s - row_number() OVER (PARTITION BY sid ORDER BY s) AS g FROM day)
SELECT sid, s, row_number() OVER (PARTITION BY sid, g ORDER BY s) AS position, count(*) OVER (PARTITION BY sid, g) AS length FROM n""")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's place in its run and the run's length."""
    runs = ts.islands(day_panel(spark, sf_dir).select("sid", "s"), "sid", "s")
    w = Window.partitionBy("sid", "run")
    return runs.select("sid", "s", F.row_number().over(w.orderBy("s")).cast("long").alias("position"), F.count("*").over(w).alias("length"))


@query(f"""WITH {DAY} SELECT a.sid, a.s, b.close AS close_lag3 FROM day a LEFT JOIN day b ON a.sid = b.sid AND b.s = a.s - 3""")
def session_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value three sessions back, null where that session is missing."""
    w = ts.session_frame("sid", "s", -3, -3)
    return day_panel(spark, sf_dir).select("sid", "s", F.first("close").over(w).alias("close_lag3"))


def _decayed(x: str, k: str, w: str = "w") -> str:
    return f"sum({k} * {x}) OVER {w} / sum({k}) OVER {w}"


@query(f"""WITH {DAY}, k AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(2.0, s / 3.0) END AS k FROM day),
m AS (SELECT sid, s, count(ret) OVER w AS n, sum(k * ret) OVER w / sum(k) OVER w AS m1, sum(k * ret * ret) OVER w / sum(k) OVER w AS m2
  FROM k WINDOW w AS (PARTITION BY sid ORDER BY s RANGE BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT sid, s, round(CASE WHEN n >= 4 THEN m1 END, 6) AS ewma_mean, round(CASE WHEN n >= 4 THEN sqrt(greatest(m2 - m1 * m1, 0)) END, 6) AS ewma_std FROM m""")
def ewma_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted mean and deviation of returns over ten sessions, half life three."""
    return ts.ewma_moments(day_panel(spark, sf_dir), "sid", "s", "ret", 10, 3, 4).select("sid", "s", r("ewma_mean").alias("ewma_mean"), r("ewma_std").alias("ewma_std"))


MARKET = f"""{BRAND}, mk AS (SELECT m, sum(CASE WHEN ret IS NOT NULL THEN qty * ret END) / sum(CASE WHEN ret IS NOT NULL THEN qty END) AS mkt FROM bm GROUP BY m),
bx AS (SELECT bm.factor, bm.m, bm.ret, mkt FROM bm JOIN mk USING (m))"""


def with_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    bm = brand_month(spark, sf_dir)
    market = bm.filter("ret IS NOT NULL").groupBy("m").agg((F.sum(F.col("qty") * F.col("ret")) / F.sum("qty")).alias("mkt"))
    return bm.join(F.broadcast(market), "m", "left").select("factor", "m", "ret", "mkt")  # one row per month


@query(f"""WITH {MARKET}, k AS (SELECT *, CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN pow(2.0, m / 6.0) END AS k FROM bx),
s AS (SELECT factor, m, count(k) OVER w AS n, {_decayed('mkt', 'k')} AS xm, {_decayed('ret', 'k')} AS ym, {_decayed('mkt * mkt', 'k')} AS xx, {_decayed('mkt * ret', 'k')} AS xy, {_decayed('ret * ret', 'k')} AS yy
  FROM k WINDOW w AS (PARTITION BY factor ORDER BY m RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT factor, m, round(CASE WHEN n >= 12 THEN (xy - xm * ym) / (xx - xm * xm) END, 6) AS beta,
  round(CASE WHEN n >= 12 THEN sqrt(greatest(yy - ym * ym - (xy - xm * ym) * (xy - xm * ym) / (xx - xm * xm), 0)) END, 6) AS sigma FROM s""")
def ewma_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed market-model beta and residual deviation over 24 months, half life six."""
    return ts.ewma_beta(with_market(spark, sf_dir), "factor", "m", "ret", "mkt", 24, 6, 12).select("factor", "m", r("beta").alias("beta"), r("sigma").alias("sigma"))


@query(f"""WITH {BRAND}, k AS (SELECT *, ln(1 + ret) AS lr, CASE WHEN ret IS NOT NULL THEN pow(2.0, m / 6.0) END AS k FROM bm),
s AS (SELECT factor, m, count(lr) OVER w AS n, sum(k * lr) OVER w / sum(k) OVER w AS v FROM k WINDOW w AS (PARTITION BY factor ORDER BY m RANGE BETWEEN 13 PRECEDING AND 2 PRECEDING))
SELECT factor, m, round(CASE WHEN n >= 6 THEN v END, 6) AS rstr FROM s""")
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed mean of log returns over twelve months, lagged by two."""
    w = ts.session_frame("factor", "m", -13, -2)
    x = brand_month(spark, sf_dir).withColumn("k", F.when(F.col("ret").isNotNull(), ts.decay("m", 6, "factor")))
    lr = F.log1p("ret")
    return x.select("factor", "m", r(F.when(F.count("ret").over(w) >= 6, F.sum(F.col("k") * lr).over(w) / F.sum("k").over(w))).alias("rstr"))


_Z = ", ".join(f"coalesce(sum(lr) OVER (PARTITION BY factor ORDER BY m RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW), 0) AS z{h}" for h in range(1, 13))


@query(f"""WITH {BRAND}, l AS (SELECT factor, m, ln(1 + ret) AS lr FROM bm),
z AS (SELECT factor, m, count(lr) OVER (PARTITION BY factor ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS n, {_Z} FROM l)
SELECT factor, m, round(CASE WHEN n >= 6 THEN ln(1 + greatest(-0.99, greatest({', '.join(f'z{h}' for h in range(1, 13))}))) - ln(1 + greatest(-0.99, least({', '.join(f'z{h}' for h in range(1, 13))}))) END, 6) AS cmra FROM z""")
def cumulative_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of cumulative log returns over one to twelve months; missing months add nothing, floor -0.99."""
    z = [F.coalesce(F.sum(F.log1p("ret")).over(ts.session_frame("factor", "m", 1 - h, 0)), F.lit(0.0)) for h in range(1, 13)]
    floor = lambda c: F.log1p(F.greatest(F.lit(-0.99), c))
    enough = F.count("ret").over(ts.session_frame("factor", "m", -11, 0)) >= 6
    return brand_month(spark, sf_dir).select("factor", "m", r(F.when(enough, floor(F.greatest(*z)) - floor(F.least(*z)))).alias("cmra"))


_B = ", ".join(f"sum(qty) OVER b{j} AS t{j}, count(qty) OVER b{j} AS n{j}" for j in range(4))
_W = ", ".join(f"b{j} AS (PARTITION BY factor ORDER BY m RANGE BETWEEN {3 * j + 2} PRECEDING AND {f'{3 * j} PRECEDING' if j else 'CURRENT ROW'})" for j in range(4))
_V = [f"CASE WHEN n{j} >= 2 THEN t{j} * 3 / n{j} END" for j in range(4)]


@query(f"""WITH {BRAND}, b AS (SELECT factor, m, {_B} FROM bm WINDOW {_W})
SELECT factor, m, round(ln(list_avg([{', '.join(_V)}])), 6) AS turnover FROM b""")
def block_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the mean of four quarterly sums, each scaled to a full quarter; a quarter needs two months."""
    blocks = []
    for j in range(4):
        w = ts.session_frame("factor", "m", -3 * j - 2, -3 * j)
        blocks.append(F.when(F.count("qty").over(w) >= 2, F.sum("qty").over(w) * 3 / F.count("qty").over(w)))
    present = F.filter(F.array(*blocks), lambda x: x.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0))
    return brand_month(spark, sf_dir).select("factor", "m", r(F.ln(mean)).alias("turnover"))


@query("""WITH y AS (SELECT o_custkey AS sid, year(o_orderdate) AS year, sum(o_totalprice) AS spend FROM orders GROUP BY ALL)
SELECT sid, round(CASE WHEN count(*) >= 3 AND avg(spend) <> 0 THEN regr_slope(spend, year) / abs(avg(spend)) END, 6) AS growth FROM y GROUP BY sid""")
def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares slope of yearly spend over its absolute mean; missing years keep their place."""
    yearly = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sid"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("spend"))
    slope = F.regr_slope("spend", "year") / F.abs(F.avg("spend"))
    return yearly.groupBy("sid").agg(r(F.when((F.count("*") >= 3) & (F.avg("spend") != 0), slope)).alias("growth"))


@query(f"""WITH {DAY} SELECT sid, s, round(CASE WHEN count(close) OVER w >= 3 THEN median(close) OVER w END, 6) AS med
FROM day WINDOW w AS (PARTITION BY sid ORDER BY s RANGE BETWEEN 8 PRECEDING AND CURRENT ROW)""")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ts.session_frame("sid", "s", -8, 0)
    return day_panel(spark, sf_dir).select("sid", "s", r(F.when(F.count("close").over(w) >= 3, F.percentile("close", F.lit(0.5)).over(w))).alias("med"))


@query(f"""WITH {DAY} SELECT sid, s, CAST(sum(CASE WHEN volume > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY s RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS breaches FROM day""")
def rolling_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_panel(spark, sf_dir).select("sid", "s", F.sum((F.col("volume") > 3).cast("int")).over(ts.session_frame("sid", "s", -9, 0)).alias("breaches"))


@query(f"""WITH {BRAND} SELECT factor, m, round(CASE WHEN count(ret) OVER w = 3 THEN sum(ret) OVER w END, 6) AS next3
FROM bm WINDOW w AS (PARTITION BY factor ORDER BY m RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def horizon_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_month(spark, sf_dir).select("factor", "m", r(ts.horizon_sum("factor", "m", "ret", 3)).alias("next3"))


@query(f"""WITH {BRAND} SELECT factor, m, round(product(1 + coalesce(ret, 0)) OVER (PARTITION BY factor ORDER BY m) - 1, 6) AS cum_ret FROM bm""")
def cumulative_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("factor").orderBy("m")
    return brand_month(spark, sf_dir).select("factor", "m", r(F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w) - 1).alias("cum_ret"))


@query(f"""WITH {DAY}, q AS (SELECT sid, s, last_value(close) OVER w AS last_close FROM day WINDOW w AS (PARTITION BY sid ORDER BY s)),
g AS (SELECT u.sid, d.s FROM (SELECT DISTINCT sid FROM day) u CROSS JOIN (SELECT DISTINCT s FROM day) d)
SELECT g.sid, g.s, last_value(d.close IGNORE NULLS) OVER (PARTITION BY g.sid ORDER BY g.s) AS filled FROM g LEFT JOIN day d USING (sid, s)""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the whole session grid, the last one carried forward."""
    day = day_panel(spark, sf_dir).select("sid", "s", "close")
    grid = day.select("sid").distinct().crossJoin(F.broadcast(day.select("s").distinct()))  # one row per session
    w = Window.partitionBy("sid").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(day, ["sid", "s"], "left").select("sid", "s", F.last("close", ignorenulls=True).over(w).alias("filled"))


@query(f"""WITH {BRAND}, n AS (SELECT factor, m, ret, row_number() OVER (PARTITION BY factor ORDER BY m DESC) AS k FROM bm WHERE ret IS NOT NULL)
SELECT factor, round(avg(ret), 6) AS mean_last, round(stddev_samp(ret), 6) AS std_last, count(*) AS n FROM n WHERE k <= 12 GROUP BY factor""")
def last_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each factor's last twelve observations, gaps skipped."""
    k = F.row_number().over(Window.partitionBy("factor").orderBy(F.col("m").desc()))
    last = brand_month(spark, sf_dir).filter("ret IS NOT NULL").withColumn("k", k).filter("k <= 12")
    return last.groupBy("factor").agg(r(F.avg("ret")).alias("mean_last"), r(F.stddev_samp("ret")).alias("std_last"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)
SELECT min(date) AS date, CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(week(date) AS INTEGER) AS iso_week FROM d GROUP BY isoyear(date), week(date)""")
def first_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    return days.groupBy(F.extract(F.lit("YEAROFWEEK"), "date").cast("int").alias("iso_year"), F.weekofyear("date").alias("iso_week")).agg(F.min("date").alias("date"))


@query("""WITH o AS (SELECT o_custkey AS sid, sum(o_totalprice) AS cap, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT sid, CAST(floor((row_number() OVER (ORDER BY cap, sid) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS "group" FROM o WHERE n_orders >= 4""")
def rank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal groups by size of the estimation universe."""
    x = cross(spark, sf_dir).filter("in_estu").select("sid", "cap", F.lit(1).alias("date"))
    return ts.equal_groups(x, ["date"], "cap", "sid", 10).select("sid", "group")


@query(f"""WITH RECURSIVE {BRAND}, p AS (SELECT factor, m, row_number() OVER (PARTITION BY factor ORDER BY m) AS n, ret * ret AS x FROM bm WHERE ret IS NOT NULL),
e(factor, m, n, state) AS (SELECT factor, m, n, x FROM p WHERE n = 1 UNION ALL SELECT p.factor, p.m, p.n, (1 - pow(0.5, 1 / 6.0)) * p.x + pow(0.5, 1 / 6.0) * e.state FROM e JOIN p ON p.factor = e.factor AND p.n = e.n + 1)
SELECT factor, m, round(state, 6) AS state FROM e""")
def ewma_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursion s = a x + (1 - a) s over squared returns, seeded by the first, as a prefix sum."""
    x = brand_month(spark, sf_dir).filter("ret IS NOT NULL").withColumn("x", F.col("ret") * F.col("ret"))
    return ts.ewma_state(x, "factor", "m", "x", 6).select("factor", "m", r("state").alias("state"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH b AS (SELECT unnest(range(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 6 DAY, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "7 days", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelforge.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "12 hours").select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n", F.round("total", 4).alias("total"))
