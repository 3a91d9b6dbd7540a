"""The panels that the queries share, from the provided tables: Spark frames and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    """A double rounded for output, under its own name where it is one."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, date, s (session number), close (the day's last known value), volume, amount, ret: a user's day as a security's session."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", F.col("ts").cast("date").alias("date"))
    known = F.when(F.col("value").isNotNull(), F.struct("ts", "event_id"))
    day = events.groupBy(F.col("user_id").alias("sid"), "date").agg(F.max_by("value", known).alias("close"), F.count("*").alias("volume"), F.sum("value").alias("amount"))
    day = day.withColumn("s", F.datediff("date", F.lit("2024-01-01").cast("date")))
    w = Window.partitionBy("sid").orderBy("s")
    gap_free = F.lag("s").over(w) == F.col("s") - 1
    return day.withColumn("ret", F.when(gap_free, F.try_divide("close", F.lag("close").over(w)) - 1))


DAY = """day0 AS (SELECT user_id AS sid, CAST(ts AS DATE) AS date, arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*) AS volume, sum(value) AS amount FROM events GROUP BY ALL),
day1 AS (SELECT *, CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER) AS s FROM day0),
day AS (SELECT *, CASE WHEN lag(s) OVER w = s - 1 THEN close / nullif(lag(close) OVER w, 0) - 1 END AS ret FROM day1 WINDOW w AS (PARTITION BY sid ORDER BY s))"""


def brand_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """factor (brand), m (month number), vwap, qty, ret: a dense panel of factor returns."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    cell = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("factor"), month.alias("m")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.sum("l_quantity").alias("qty"))
    w = Window.partitionBy("factor").orderBy("m")
    return cell.withColumn("ret", F.when(F.lag("m").over(w) == F.col("m") - 1, F.try_divide("vwap", F.lag("vwap").over(w)) - 1))


BRAND = """bm0 AS (SELECT p_brand AS factor, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS m, sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
bm AS (SELECT *, CASE WHEN lag(m) OVER w = m - 1 THEN vwap / nullif(lag(vwap) OVER w, 0) - 1 END AS ret FROM bm0 WINDOW w AS (PARTITION BY factor ORDER BY m))"""


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section of customers: sid, industry, cap, acct, n_orders, mean_order, y (growth of spend), in_estu, v."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    late = F.year("o_orderdate") >= 1998
    spend = orders.groupBy(F.col("o_custkey").alias("sid")).agg(
        F.sum("o_totalprice").alias("cap"), F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_order"),
        F.sum(F.when(late, F.col("o_totalprice")).otherwise(0.0)).alias("late"), F.sum(F.when(~late, F.col("o_totalprice")).otherwise(0.0)).alias("early"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("acct"))
    return customers.join(spend, "sid").select("sid", "industry", "acct", "cap", "n_orders", "mean_order", F.when(F.col("early") > 0, F.col("late") / F.col("early") - 1).alias("y"), (F.col("n_orders") >= 4).alias("in_estu"), F.sqrt("cap").alias("v"))


CROSS = """spend AS (SELECT o_custkey AS sid, sum(o_totalprice) AS cap, count(*) AS n_orders, avg(o_totalprice) AS mean_order,
  sum(CASE WHEN year(o_orderdate) >= 1998 THEN o_totalprice ELSE 0.0 END) AS late, sum(CASE WHEN year(o_orderdate) < 1998 THEN o_totalprice ELSE 0.0 END) AS early FROM orders GROUP BY 1),
x AS (SELECT c_custkey AS sid, c_mktsegment AS industry, c_acctbal AS acct, cap, n_orders, mean_order, CASE WHEN early > 0 THEN late / early - 1 END AS y, n_orders >= 4 AS in_estu, sqrt(cap) AS v
  FROM customer JOIN spend ON c_custkey = sid)"""


def cross_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section of customers for each order year: year, sid, industry, acct, cap, n_orders, mean_order, v, in_estu, y."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sid"), F.year("o_orderdate").alias("year"), "o_totalprice")
    spend = orders.groupBy("sid", "year").agg(F.sum("o_totalprice").alias("cap"), F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_order"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("acct"))
    w = Window.partitionBy("sid").orderBy("year")
    ret = F.when(F.lag("year").over(w) == F.col("year") - 1, F.col("cap") / F.lag("cap").over(w) - 1)
    found = spend.join(customers, "sid").withColumn("y", ret)
    return found.select("year", "sid", "industry", "acct", "cap", "n_orders", "mean_order", F.sqrt("cap").alias("v"), (F.col("cap") > 100000).alias("in_estu"), "y")


YEARS = """py AS (SELECT o_custkey AS sid, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS cap, count(*) AS n_orders, avg(o_totalprice) AS mean_order FROM orders GROUP BY ALL),
p AS (SELECT year, sid, c_mktsegment AS industry, c_acctbal AS acct, cap, n_orders, mean_order, sqrt(cap) AS v, cap > 100000 AS in_estu,
  CASE WHEN lag(year) OVER (PARTITION BY sid ORDER BY year) = year - 1 THEN cap / lag(cap) OVER (PARTITION BY sid ORDER BY year) - 1 END AS y FROM py JOIN customer ON c_custkey = sid)"""
