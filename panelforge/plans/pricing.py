"""Prices end to end on day closes: two vintages of adjusted prices, a split, dividends, codes that change hands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.operators import prices as px
from panelforge.plans.panels import DAY, day_panel, r, table
from panelforge.plans.registry import query

# A user is a code. A 2:1 split on day 10 and a dividend on day 20 are in the adjusted prices, and the split is in the volumes,
# but even users' first ten days were pulled on their day. Codes change hands on day 15. Volumes count events.
_RULES = px.PriceRules(split_detect=0.15, least_dividend=0.0005, volume_window=5, stale_run=2)

_BARS = f"""{DAY}, raw AS (SELECT 'C' || sid AS code, sid AS u, s, date, close, CASE WHEN s < 10 THEN 0.5 WHEN s < 20 THEN 0.98 ELSE 1.0 END AS f, volume AS n FROM day),
l AS (SELECT *, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev_close, lag(close * f) OVER w AS late_prev FROM raw WINDOW w AS (PARTITION BY code ORDER BY s)),
bars AS (SELECT code, u, s, date, prev_date, close, prev_close, u % 2 = 0 AND s < 10 AS early, CASE WHEN u % 2 = 0 AND s < 10 THEN close ELSE close * f END AS adjusted,
  CASE WHEN u % 2 = 0 AND s < 10 THEN prev_close ELSE late_prev END AS prev_adjusted, CAST(CASE WHEN s < 10 AND u % 2 = 1 THEN 2 * n ELSE n END AS DOUBLE) AS volume FROM l),
g AS (SELECT *, CASE WHEN prev_close > 0 AND close > 0 AND adjusted > 0 AND prev_adjusted > 0 THEN (adjusted / prev_adjusted) / (close / prev_close) END AS g FROM bars),
k AS (SELECT g.*, (SELECT arg_min(ratio, struct_pack(e := abs(g / ratio - 1), m := m)) FROM (SELECT m, CASE WHEN g >= 1 THEN round_even(g * m, 0) / m ELSE m / round_even(m / g, 0) END AS ratio FROM (VALUES (1), (2), (3), (4)) v(m)) WHERE ratio <> 1 AND isfinite(ratio) AND ratio > 0 AND (m = 1 OR (ratio > 1 / 3.0 AND ratio < 3))) AS ratio FROM g),
sp AS (SELECT *, CASE WHEN abs(g / ratio - 1) <= 0.005 AND abs(g - 1) > 0.15 THEN ratio ELSE 1.0 END AS k FROM k),
ac AS (SELECT *, coalesce(g / k, 1.0) AS rest FROM sp),
act AS (SELECT *, CASE WHEN prev_close IS NOT NULL AND NOT (close > 0 AND prev_close > 0) THEN 'bad_price' WHEN k <> 1 THEN 'split' WHEN rest - 1 < -0.0005 THEN 'unexplained' WHEN rest - 1 > 0.15 THEN 'distribution' WHEN rest - 1 > 0.0005 THEN 'dividend' ELSE '' END AS action,
  CASE WHEN rest - 1 > 0.0005 THEN prev_close * (1 - 1 / rest) ELSE 0 END AS cash, row_number() OVER (PARTITION BY code ORDER BY date) AS i, coalesce(ln(g), 0) AS lg, CASE WHEN close > 0 AND adjusted > 0 THEN ln(close / adjusted) END AS tau FROM ac),
cg AS (SELECT *, sum(lg) OVER w AS cg, sum(CAST(k <> 1 AS INTEGER)) OVER w AS seg FROM act WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT code, seg, min(cg) AS lo, max(cg) AS hi, min(i) AS first, arg_min(k, i) AS ratio FROM cg GROUP BY ALL),
nr AS (SELECT cg.code, cg.i, min(struct_pack(err := round(greatest(lo - cg - tau, cg + tau - hi, 0), 9), minus := -st.seg)) AS n FROM cg JOIN st ON st.code = cg.code AND st.seg >= cg.seg WHERE tau IS NOT NULL GROUP BY ALL),
pl AS (SELECT cg.*, n.err AS basis_err, coalesce(-n.minus, seg) AS pulled FROM cg LEFT JOIN nr USING (code, i)),
pre AS (SELECT code, seg, median(volume) AS pre FROM (SELECT pl.code, st.seg, volume, row_number() OVER (PARTITION BY pl.code, st.seg ORDER BY i DESC) AS k FROM pl JOIN st ON st.code = pl.code AND i < first AND pulled >= st.seg WHERE st.seg > 0) WHERE k <= 5 GROUP BY ALL),
post AS (SELECT pl.code, st.seg, median(volume) AS post FROM pl JOIN st ON st.code = pl.code AND i BETWEEN first AND first + 4 WHERE st.seg > 0 GROUP BY ALL),
ev AS (SELECT code, seg, ln(ratio) AS lk, CASE WHEN pre > 0 AND post > 0 THEN ln(post / pre) END AS ch FROM st LEFT JOIN pre USING (code, seg) LEFT JOIN post USING (code, seg) WHERE seg > 0),
ck AS (SELECT code, seg, sum(CASE WHEN abs(ch - lk) + 0.3 < abs(ch) OR NOT coalesce(abs(ch - lk) + 0.3 >= abs(ch), true) THEN 0 ELSE lk END) OVER (PARTITION BY code ORDER BY seg) AS ck FROM ev),
vb AS (SELECT pl.* EXCLUDE (volume), volume / exp(coalesce(a.ck, 0) - coalesce(b.ck, 0)) AS volume, CASE WHEN close > 0 AND prev_close > 0 THEN (k * close + cash) / prev_close - 1 END AS total FROM pl LEFT JOIN ck a ON a.code = pl.code AND a.seg = pulled LEFT JOIN ck b ON b.code = pl.code AND b.seg = pl.seg),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n, lag(date) OVER (ORDER BY date) AS prev_session FROM (SELECT DISTINCT date FROM day)),
own AS (SELECT vb.*, u + CASE WHEN s < 15 THEN 0 ELSE 1000000 END AS sid, cal.n, prev_session FROM vb JOIN cal USING (date)),
rn AS (SELECT *, sum(CAST(coalesce(close <> pc, true) AS INTEGER)) OVER (PARTITION BY sid ORDER BY date) AS run FROM (SELECT *, lag(close) OVER (PARTITION BY sid ORDER BY date) AS pc FROM own)),
fl AS (SELECT *, CASE WHEN close IS NULL OR close <= 0 THEN 'nonpositive' WHEN abs(total) > 0.5 AND action IN ('', 'dividend', 'unexplained') THEN 'jump' WHEN prev_date <> prev_session THEN 'gap'
  WHEN count(*) OVER (PARTITION BY sid, run) >= 2 THEN 'stale' WHEN action = 'unexplained' THEN 'action_unexplained' END AS flag, cash / k AS dividend, CASE WHEN prev_close > 0 THEN (1 - cash / prev_close) / k ELSE 1 END AS step FROM rn),
px AS (SELECT *, CASE WHEN flag IS NULL OR flag NOT IN ('nonpositive', 'jump', 'gap') THEN total END AS ret, day(date) / 100000.0 AS rf,
  action = 'distribution' OR coalesce(action = 'dividend' AND dividend > 3 * median(CASE WHEN action = 'dividend' THEN dividend END) OVER (PARTITION BY sid ORDER BY n RANGE BETWEEN 252 PRECEDING AND 1 PRECEDING), false) AS special,
  coalesce(product(step) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS adj_factor, product(k) OVER (PARTITION BY sid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_split FROM fl)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("code").orderBy("date")
    x = day_panel(spark, sf_dir).select(F.concat(F.lit("C"), "sid").alias("code"), "sid", "s", "date", "close", "volume")
    late = F.col("close") * F.when(F.col("s") < 10, 0.5).when(F.col("s") < 20, 0.98).otherwise(1.0)
    early = (F.col("sid") % 2 == 0) & (F.col("s") < 10)
    x = x.withColumns({"prev_date": F.lag("date").over(w), "prev_close": F.lag("close").over(w), "late": late}).withColumn("late_prev", F.lag("late").over(w))
    volume = F.when((F.col("s") < 10) & ~early, 2 * F.col("volume")).otherwise(F.col("volume")).cast("double")
    return x.select("code", "date", "close", F.when(early, F.col("close")).otherwise(F.col("late")).alias("adjusted"), "prev_date", "prev_close", F.when(early, F.col("prev_close")).otherwise(F.col("late_prev")).alias("prev_adjusted"), volume.alias("volume"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    change = F.lit("2024-01-16").cast("date")
    halves = F.array(
        F.struct(F.lit(0).alias("more"), F.lit("1900-01-01").cast("date").alias("valid_from"), F.date_sub(change, 1).alias("valid_to")),
        F.struct(F.lit(1_000_000).alias("more"), change.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")),
    )
    codes = users.select("user_id", F.inline(halves)).select((F.col("user_id") + F.col("more")).alias("sid"), F.concat(F.lit("C"), "user_id").alias("code"), "valid_from", "valid_to")
    one = Window.partitionBy(F.lit(0)).orderBy("date")  # a calendar: a row per session
    calendar = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date")).distinct()
    sessions = calendar.select("date", (F.row_number().over(one) - 1).alias("i"), F.lag("date").over(one).alias("prev_session"))
    free = calendar.select("date", (F.dayofmonth("date") / 100000.0).alias("rf"))
    return px.build_prices(bars(spark, sf_dir), codes, free, sessions, _RULES)


@query(f"""WITH {_BARS} SELECT date, sid, code, round(close, 6) AS close, round(volume, 6) AS volume, round(adj_factor, 6) AS adj_factor, round(ret, 6) AS ret, round(ret - rf, 6) AS ret_excess, flag, round(k, 6) AS split_ratio,
round(dividend, 6) AS dividend, special, action, round(cum_split, 6) AS cum_split, round(basis_err, 6) AS basis_err FROM px""")
def built_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw bars to excess returns: actions, volumes on the day's share basis, codes' validity, flags, adjustment factors."""
    rounded = ("close", "volume", "adj_factor", "ret", "ret_excess", "split_ratio", "dividend", "cum_split", "basis_err")
    found = prices(spark, sf_dir)
    return found.select("date", "sid", "code", "flag", "special", "action", *(r(c).alias(c) for c in rounded))
