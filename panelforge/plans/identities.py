"""Queries of identity resolution: candidates, codes by coverage, and whole histories, on spells of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import identity as idn
from panelforge.plans.panels import r, table
from panelforge.plans.registry import query
from panelforge.plans.staged import _nested
from panelforge.sources.store import stored

# A user's days with events are a code's priced sessions; three users share a ticker, as its codes. A ticker is a member in a block of seven
# sessions from its first purchase to its last.
_CODES = """priced AS (SELECT DISTINCT 'T' || CAST(user_id // 3 AS VARCHAR) || CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_old' ELSE '_old1' END AS code,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS s FROM events),
listings AS (SELECT DISTINCT code, CASE WHEN code LIKE '%1' THEN NULL ELSE code || ' Inc' END AS name, code LIKE '%_old_' AS delisted FROM priced),
eras AS (SELECT 'T' || CAST(user_id // 3 AS VARCHAR) AS ticker, CAST(min(d) AS INTEGER) AS start, CAST(max(d) AS INTEGER) AS "end"
  FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'purchase') GROUP BY user_id // 3, d // 7)"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("s"))
    suffix = F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, "_old").otherwise("_old1")
    return e.select(F.concat(F.lit("T"), F.floor(F.col("user_id") / 3), suffix).alias("code"), "s").distinct()


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = priced(spark, sf_dir).select("code").distinct()
    return code.select("code", F.when(~F.col("code").endswith("1"), F.concat("code", F.lit(" Inc"))).alias("name"), F.col("code").like("%_old_").alias("delisted"))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d"))
    ticker = F.concat(F.lit("T"), F.floor(F.col("user_id") / 3)).alias("ticker")
    return e.groupBy(ticker, F.floor(F.col("d") / 7).alias("block")).agg(F.min("d").alias("start"), F.max("d").alias("end")).drop("block")


_CANDIDATES = """asked AS (SELECT DISTINCT ticker FROM eras UNION SELECT 'N' || ticker || '.X' FROM eras WHERE start = (SELECT min(start) FROM eras)),
hits AS (SELECT a.ticker, l.* FROM listings l JOIN asked a ON a.ticker = regexp_replace(l.code, '_old\\d*$', '')),
cands AS (SELECT * FROM hits UNION ALL SELECT ticker, replace(ticker, '.', '-'), NULL, NULL FROM asked WHERE ticker NOT IN (SELECT ticker FROM hits))"""


@query(f"WITH {_CODES}, {_CANDIDATES} SELECT ticker, code, name, delisted FROM cands")
def candidate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that may hold a ticker's history: its own, superseded ones, or one made of the ticker."""
    own = spells(spark, sf_dir)
    first = own.agg(F.min("start").alias("start"))
    asked = own.select("ticker").unionByName(own.join(F.broadcast(first), "start", "left_semi").select(F.concat(F.lit("N"), "ticker", F.lit(".X")).alias("ticker")))
    return idn.candidate_codes(asked, listings(spark, sf_dir)).select("ticker", "code", "name", "delisted")


_NAME_KEY = "trim(" + _nested("upper(p_name)", ("[^A-Z0-9]+", " "), (r"\s+", " ")) + ")"


@query(f"""WITH asked AS (SELECT DISTINCT 'T' || s_nationkey AS ticker FROM supplier WHERE s_suppkey % 2 = 0),
cur AS (SELECT 'T' || s_nationkey AS ticker, s_suppkey AS cik FROM supplier WHERE s_acctbal > 0), map AS (SELECT 'T' || c_nationkey AS ticker, c_custkey AS cik FROM customer WHERE c_acctbal < 0),
k AS (SELECT p_partkey AS cik, {_NAME_KEY} AS key, p_size FROM part),
u AS (SELECT 0 AS rank, 'current' AS via, cik FROM cur SEMI JOIN asked USING (ticker) UNION ALL SELECT 1, 'ticker', cik FROM map SEMI JOIN asked USING (ticker)
  UNION ALL SELECT 2, 'name', cik FROM k WHERE key <> '' AND key IN (SELECT key FROM k WHERE p_size < 5))
SELECT cik, arg_min(via, rank) AS via FROM u GROUP BY cik""")
def candidate_registrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrants that may stand behind tickers, each by its most trusted source."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    ticker = lambda c: F.concat(F.lit("T"), c).alias("ticker")
    current = supplier.filter("s_acctbal > 0").select(ticker("s_nationkey"), F.col("s_suppkey").alias("cik"))
    mapped = customer.filter("c_acctbal < 0").select(ticker("c_nationkey"), F.col("c_custkey").alias("cik"))
    asked = supplier.filter("s_suppkey % 2 = 0").select(ticker("s_nationkey"))
    return idn.candidate_registrants(asked, current, mapped, part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("cik")), part.filter("p_size < 5").select(F.col("p_name").alias("name")))


@query(f"""WITH {_CODES}, {_CANDIDATES}, cov AS (SELECT e.ticker, e.start, e."end", c.code, (SELECT count(*) FROM priced p WHERE p.code = c.code AND p.s BETWEEN e.start AND e."end") / (e."end" - e.start + 1) AS coverage,
  c.code SIMILAR TO '.*_old\\d*' AS old, coalesce(c.delisted, false) AS gone FROM eras e JOIN cands c USING (ticker)),
o AS (SELECT *, CASE WHEN "end" >= (SELECT max(s) FROM priced) THEN CASE WHEN NOT old AND NOT gone THEN 0 WHEN NOT old THEN 1 ELSE 2 END WHEN old THEN 0 WHEN gone THEN 1 ELSE 2 END AS liking FROM cov),
b AS (SELECT *, row_number() OVER (PARTITION BY ticker, start ORDER BY coverage < 0.5, liking, -coverage, code) AS k FROM o)
SELECT ticker, start, "end", code, round(coverage, 6) AS coverage FROM b WHERE k = 1""")
def codes_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a ticker's codes, for each spell, one that covers at least half its sessions, superseded ones first for spells that ended."""
    days, own = priced(spark, sf_dir), spells(spark, sf_dir)
    none = spark.createDataFrame([], "ord int, ticker string, start int, end int, code string, cik long")
    last = days.agg(F.max("s")).first()[0]
    found = idn.own_code(idn.cut(own, none), idn.candidate_codes(own, listings(spark, sf_dir)), days, last, idn.Rules(coverage=0.5))
    return found.select("ticker", "start", "end", "code", r("coverage").alias("coverage"))


@query()
def security_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells of all tickers with their codes, registrants and securities: renames, switches and links settled, by all rules."""
    days, own = stored(priced(spark, sf_dir), "priced"), spells(spark, sf_dir)
    calendar = stored(days.select("s").distinct().withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s"))), "calendar")
    none = spark.createDataFrame([], "ord int, ticker string, start int, end int, code string, cik long")
    named = listings(spark, sf_dir).filter("name IS NOT NULL")
    cik = F.pmod(F.xxhash64("code"), F.lit(1_000_000_007))
    registered = named.select("name", cik.alias("cik"))
    companies = named.select(cik.alias("cik"), "name", F.array("code").alias("tickers"), F.lit(1).alias("sic"), F.array().cast("array<string>").alias("former"))
    filed = days.join(calendar, "s").groupBy("code").agg(F.min("date").alias("first_filed"), F.max("date").alias("last_filed"), F.count("*").alias("n"))
    spans = filed.select(cik.alias("cik"), "first_filed", "last_filed", F.col("n").cast("int").alias("n"))
    last = days.agg(F.max("s")).first()[0]
    current = own.filter(F.col("end") == last).select("ticker", F.pmod(F.xxhash64("ticker"), F.lit(1_000_000_007)).alias("cik"))
    mapped = named.select(F.col("code").alias("ticker"), cik.alias("cik"), F.col("name").alias("title"), F.lit(1).alias("ord"))
    history, _, _ = idn.resolve(own, stored(idn.candidate_codes(own, listings(spark, sf_dir)), "candidates"), days, calendar, none, current, mapped, registered, companies, spans, last, idn.Rules(coverage=0.5, slack_days=3))
    order = Window.partitionBy("sid").orderBy("start", "ticker")
    return history.select("sid", "ticker", "start", "end", "code", r("coverage").alias("coverage"), "method", "cik", "cik_method", F.row_number().over(order).alias("spell"))
