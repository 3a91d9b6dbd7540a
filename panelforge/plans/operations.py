"""Queries of daily operations: all gates of a day with one status, and runs over a source that publishes late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import gates as gt
from panelforge.plans.panels import DAY, day_panel, table
from panelforge.plans.registry import query
from panelforge.sources.store import stored
from panelforge.streaming import opendays as od

# Users' days are a day's names; event types stand for styles and factors, volume and amount for the two factors of a covariance.
_RULES = gt.GateRules(priced=0.9, universe=(20, 10_000), moment=0.9, imputed=0.3, vif_fail=60.0, vif_warn=45.0, stability=0.45, stability_slow=0.4, slow_styles=("refund",), constraint=1.0, condition=2.6, names=20, fit=(0.1, 0.9), tracking_bp=600.0, shock=2.0, regime=(0.5, 2.0), level=(0.1, 4.0))

_GATES = f"""{DAY}, e AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS date, event_type AS style, value FROM events),
nm AS (SELECT s AS date, count(*) AS n, count(*) FILTER (close > 5) AS priced, count(*) FILTER (volume > 0) AS sig, median(CASE WHEN volume >= 2 THEN volume / 2.0 END) AS level FROM day GROUP BY s),
q AS (SELECT date, style, (count(*) % 10) / 10.0 AS mean_off, (count(*) % 8) / 10.0 AS std_off, count(*) FILTER (value < 20) AS imputed, count(*) / 2.0 AS vif, avg(value) / 100 AS stability FROM e GROUP BY ALL),
qa AS (SELECT date, max(mean_off) AS mean_off, max(std_off) AS std_off, max(imputed) AS imputed, max(vif) AS vif, count(*) FILTER (stability < CASE WHEN style = 'refund' THEN 0.4 ELSE 0.45 END) AS unstable FROM q GROUP BY date),
st AS (SELECT s AS date, CASE WHEN count(*) % 13 = 0 THEN 'thin' ELSE 'ok' END AS status, count(*) AS n, avg(volume) AS condition, 0.5 AS resid, avg(CASE WHEN volume > 1 THEN 1.0 ELSE 0.0 END) AS r2, avg(ret) / 10 AS tracking FROM day GROUP BY s),
sh AS (SELECT date, count(*) FILTER (abs(z) > 2) AS shocks FROM (SELECT date, style, (avg(value) - 50) / 5 AS z FROM e GROUP BY ALL) GROUP BY date),
cv AS (SELECT s AS date, var_pop(volume) AS a, covar_pop(volume, amount) AS b, var_pop(amount) AS c FROM day GROUP BY s),
rg AS (SELECT s AS date, avg(volume) / 2 AS lf, avg(amount) / 100 AS ls FROM day GROUP BY s),
g AS (SELECT nm.date, nm.n, priced, sig, level, mean_off, std_off, imputed, vif, unstable, status, condition, resid, r2, tracking, shocks, a, b, c, lf, ls, st.n AS sn FROM nm LEFT JOIN qa USING (date) LEFT JOIN st USING (date) LEFT JOIN sh USING (date) LEFT JOIN cv USING (date) LEFT JOIN rg USING (date)),
r AS (SELECT date, 'data_freshness' AS gate, 'FAIL' AS level, priced >= 0.9 * n AS ok FROM g UNION ALL SELECT date, 'universe', 'WARN', n BETWEEN 20 AND 10000 FROM g UNION ALL SELECT date, 'exposure_moments', 'FAIL', mean_off < 0.9 AND std_off < 0.9 FROM g
UNION ALL SELECT date, 'imputation', 'WARN', imputed <= 0.3 * n FROM g UNION ALL SELECT date, 'vif', 'FAIL', vif <= 60 FROM g UNION ALL SELECT date, 'vif_warn', 'WARN', vif <= 45 FROM g UNION ALL SELECT date, 'stability', 'WARN', unstable = 0 FROM g
UNION ALL SELECT date, 'regression', 'FAIL', status = 'ok' AND resid < 1 AND condition < 2.6 AND sn >= 20 FROM g UNION ALL SELECT date, 'fit', 'WARN', r2 BETWEEN 0.1 AND 0.9 FROM g WHERE status = 'ok' UNION ALL SELECT date, 'country_tracking', 'WARN', coalesce(abs(tracking) * 10000 < 600, false) FROM g WHERE status = 'ok'
UNION ALL SELECT date, 'factor_shock', 'WARN', shocks = 0 FROM g UNION ALL SELECT date, 'factor_covariance', 'FAIL', a + c > 0 AND a * c - b * b > 0 FROM g UNION ALL SELECT date, 'vra', 'WARN', lf BETWEEN 0.5 AND 2 AND ls BETWEEN 0.5 AND 2 FROM g
UNION ALL SELECT date, 'specific_coverage', 'FAIL', n > 0 AND sig = n FROM g UNION ALL SELECT date, 'specific_level', 'WARN', coalesce(g.level * sqrt(12) BETWEEN 0.1 AND 4, false) FROM g)"""


def _inputs(spark: SparkSession, sf_dir: str) -> gt.DayInputs:
    day = stored(day_panel(spark, sf_dir).withColumn("date", F.col("s")), "day")
    e = table(spark, sf_dir, "events").select(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("date"), F.col("event_type").alias("style"), "value")
    n = F.count("*")
    qa = e.groupBy("date", "style").agg((n % 10 / 10.0).alias("mean_cw"), (1 + n % 8 / 10.0).alias("std_ew"), F.count_if(F.col("value") < 20).alias("imputed"), (n / 2.0).alias("vif"), (F.avg("value") / 100).alias("stability"))
    stats = day.groupBy("date").agg(F.when(n % 13 == 0, "thin").otherwise("ok").alias("status"), n.cast("int").alias("n"), F.avg("volume").alias("condition"), F.lit(0.5).alias("constraint_resid"), F.avg((F.col("volume") > 1).cast("double")).alias("r2"), (F.avg("ret") / 10).alias("tracking"))
    moments = day.groupBy("date").agg(F.var_pop("volume").alias("a"), F.covar_pop("volume", "amount").alias("b"), F.var_pop("amount").alias("c"))
    cell = lambda i, j, c: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("cov"))
    return gt.DayInputs(
        universe=day.select("date", "sid", (F.col("volume") >= 2).alias("in_estu")), prices=day.select("date", "sid", (F.col("close") - 5).alias("close")), qa=qa, stats=stats,
        factors=e.groupBy("date", F.col("style").alias("factor")).agg(((F.avg("value") - 50) / 5).alias("f_over_sigma")), cov=moments.select("date", F.inline(F.array(cell("v", "v", "a"), cell("v", "w", "b"), cell("w", "w", "c")))),
        regimes=day.groupBy("date").agg((F.avg("volume") / 2).alias("factor_lambda"), (F.avg("amount") / 100).alias("specific_lambda")), specific=day.select("date", "sid", (F.col("volume") / 2.0).alias("sigma")),
    )


@query(f"WITH {_GATES} SELECT date, gate, level, ok FROM r")
def day_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen checks of each day, from inputs that are each read once."""
    return gt.day_gates(_inputs(spark, sf_dir), _RULES).select("date", "gate", "level", "ok")


@query(f"WITH {_GATES} SELECT date, CASE WHEN bool_or(level = 'FAIL' AND NOT ok) THEN 'QUARANTINED' ELSE 'OK' END AS status, count(*) FILTER (WHERE NOT ok AND level = 'WARN') AS warnings FROM r GROUP BY date")
def day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's status over all its gates, and how many only warn."""
    return gt.day_status(gt.day_gates(_inputs(spark, sf_dir), _RULES)).select("date", "status", F.size("warned").cast("long").alias("warnings"))


# An index for each day that has orders of the top priority; it comes up to five days late. A run every fourth day.
_INDEX = """ix AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + CAST(min(o_orderkey) % 6 AS INTEGER) AS published FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 GROUP BY 1),
rn AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS run FROM orders WHERE day(o_orderdate) % 4 = 0)"""


@query(f"""WITH {_INDEX}, th AS (SELECT run, (SELECT max(date) FROM ix WHERE published <= run AND date <= run) AS through FROM rn), pv AS (SELECT *, lag(through) OVER (ORDER BY run) AS found FROM th)
SELECT run, through, (SELECT count(*) FROM ix WHERE published <= run AND date <= run AND (found IS NULL OR date > found)) AS taken, date_diff('day', through, run) AS still_open FROM pv""")
def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run over late indexes takes, where its watermark comes to, and how many days stay open."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("date"))
    index = o.filter("o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0").groupBy("date").agg(F.min("o_orderkey").alias("k")).select("date", F.date_add("date", (F.col("k") % 6).cast("int")).alias("published"))
    return od.replay(index, o.filter(F.dayofmonth("date") % 4 == 0).select(F.col("date").alias("run")).distinct())
