"""Company facts by kind, and growth, with orders as facts: an order's priority is its concept, its quarter the period it speaks of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import filings as fl
from panelforge.plans.panels import r, table
from panelforge.plans.registry import query
from panelforge.sources.store import stored

ITEMS = [
    fl.Item("book", "instant", ["c:1-URGENT", "c:2-HIGH"], ["c:3-MEDIUM", "c:5-LOW"]),
    fl.Item("sales", "annual", ["c:2-HIGH", "c:1-URGENT"], ["c:5-LOW", "c:3-MEDIUM"]),
    fl.Item("income", "ttm", ["c:3-MEDIUM", "c:1-URGENT", "c:2-HIGH"], ["c:5-LOW"]),
]

# Ten customers are a company. By the order's number it speaks of the quarter, the year to the quarter's end, the whole year, or a day.
_FACTS = """raw AS (SELECT o_custkey // 10 AS cik, 'c:' || o_orderpriority AS concept, o_totalprice AS val, o_orderkey % 4 AS form, CAST(o_orderdate AS DATE) + 40 AS filed, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS accn,
  CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('year', o_orderdate) AS DATE) AS y FROM orders WHERE o_orderkey % 7 <> 0),
facts AS (SELECT cik, concept, val, filed, accn, CASE form WHEN 0 THEN q WHEN 1 THEN y WHEN 2 THEN y END AS s, CASE form WHEN 2 THEN CAST(y + INTERVAL 1 YEAR AS DATE) - 1 ELSE CAST(q + INTERVAL 3 MONTH AS DATE) - 1 END AS e FROM raw),
f AS (SELECT *, date_diff('day', s, e) AS n, CASE WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 170 AND 195 THEN 'H' WHEN n BETWEEN 260 AND 285 THEN '9M' WHEN n BETWEEN 350 AND 380 THEN 'FY' END AS length FROM facts)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    form = F.col("o_orderkey") % 4
    q, y = F.trunc("day", "quarter"), F.trunc("day", "year")
    start = F.when(form == 0, q).when(form < 3, y)
    end = F.when(form == 2, F.date_sub(F.add_months(y, 12), 1)).otherwise(F.date_sub(F.add_months(q, 3), 1))
    return o.select(
        F.floor(F.col("o_custkey") / 10).cast("long").alias("cik"), F.concat(F.lit("c:"), "o_orderpriority").alias("concept"), F.lit("USD").alias("unit"), start.alias("start"), end.alias("end"),
        F.col("o_totalprice").alias("val"), F.date_add("day", 40).alias("filed"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("accn"), F.lit("10-K").alias("form"),
    )


def _chosen(item: fl.Item, where: str, start: str) -> str:
    """Changes of an item's chosen value by windows over each concept."""
    last = lambda c: f"last_value(CASE WHEN concept = '{c}' THEN val END IGNORE NULLS) OVER w"
    chain = ", ".join(f"{last(c)} AS c{k}" for k, c in enumerate(item.chain))
    fall = ", ".join(f"{last(c)} AS d{k}" for k, c in enumerate(item.fallback))
    total = " + ".join(f"coalesce(d{k}, 0)" for k in range(len(item.fallback)))
    label = ", ".join(f"CASE WHEN d{k} IS NOT NULL THEN '{c}' END" for k, c in enumerate(item.fallback))
    names = " ".join(f"WHEN c{k} IS NOT NULL THEN '{c}'" for k, c in enumerate(item.chain))
    value = f"coalesce({', '.join(f'c{k}' for k in range(len(item.chain)))}, CASE WHEN coalesce({', '.join(f'd{k}' for k in range(len(item.fallback)))}) IS NOT NULL THEN {total} END)"
    concepts = ", ".join(f"'{c}'" for c in [*item.chain, *item.fallback])
    return f"""SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY cik, s, e ORDER BY filed, accn) AS before FROM (SELECT cik, '{item.name}' AS item, s, e, length, filed, accn, {value} AS value, CASE {names} ELSE concat_ws('+', {label}) END AS concept
  FROM (SELECT cik, {start} AS s, e, length, filed, accn, {chain}, {fall} FROM f WHERE {where} AND concept IN ({concepts}) WINDOW w AS (PARTITION BY cik, {start}, e ORDER BY filed, accn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))
  WHERE value IS NOT NULL AND value IS DISTINCT FROM before"""


_ALL = f"""{_FACTS}, book AS ({_chosen(ITEMS[0], "true", "CAST(NULL AS DATE)")}), sales AS ({_chosen(ITEMS[1], "length = 'FY'", "CAST(NULL AS DATE)")}), ev AS ({_chosen(ITEMS[2], "length IS NOT NULL", "s")}),
k AS (SELECT DISTINCT cik, s, e, length FROM ev), fy AS (SELECT cik, e, min(s) AS s FROM k WHERE length = 'FY' GROUP BY ALL),
part AS (SELECT cik, e, min(s) AS s FROM k WHERE length <> 'FY' AND NOT EXISTS (SELECT 1 FROM fy WHERE fy.cik = k.cik AND fy.e = k.e) GROUP BY ALL),
ly AS (SELECT p.cik, p.e, p.s, arg_min(struct_pack(s := k.s, e := k.e), struct_pack(o := abs(date_diff('day', k.e, p.s - 1)), e := k.e, s := k.s)) AS y FROM part p JOIN k ON k.cik = p.cik AND k.length = 'FY' AND abs(date_diff('day', k.e, p.s - 1)) <= 7 GROUP BY ALL),
lp AS (SELECT p.cik, p.e, p.s, arg_min(struct_pack(s := k.s, e := k.e), struct_pack(o := abs(date_diff('day', k.e, p.e - 365)), l := abs(date_diff('day', k.s, k.e) - date_diff('day', p.s, p.e)), e := k.e, s := k.s)) AS p FROM part p JOIN k ON k.cik = p.cik AND k.length <> 'FY'
  AND abs(date_diff('day', k.e, p.e - 365)) <= 7 AND abs(date_diff('day', k.s, k.e) - date_diff('day', p.s, p.e)) <= 7 GROUP BY ALL),
need AS (SELECT cik, e, s, y, p FROM ly JOIN lp USING (cik, e, s)),
legs AS (SELECT cik, e AS t, 0 AS leg, y.s AS s, y.e AS e FROM need UNION ALL SELECT cik, e, 1, s, e FROM need UNION ALL SELECT cik, e, 2, p.s, p.e FROM need),
own AS (SELECT l.cik, l.t, l.leg, ev.filed, arg_max(ev.value, ev.accn) AS value, max(ev.accn) AS accn FROM legs l JOIN ev ON ev.cik = l.cik AND ev.s = l.s AND ev.e = l.e GROUP BY ALL),
days AS (SELECT DISTINCT cik, t, filed FROM own),
st AS (SELECT d.cik, d.t, d.filed, o.leg, arg_max(o.value, o.filed) AS value, max(struct_pack(f := o.filed, k := -o.leg, a := o.accn)) AS late FROM days d JOIN own o ON o.cik = d.cik AND o.t = d.t AND o.filed <= d.filed GROUP BY ALL),
comb AS (SELECT cik, t, filed, sum(CASE WHEN leg = 2 THEN -value ELSE value END) AS value, max(late).a AS accn FROM st GROUP BY ALL HAVING count(*) = 3),
ttm AS (SELECT *, lag(value) OVER (PARTITION BY cik, t ORDER BY filed) AS before FROM comb),
found AS (SELECT cik, item, e, filed, value, concept, accn FROM book UNION ALL SELECT cik, item, e, filed, value, concept, accn FROM sales
  UNION ALL SELECT ev.cik, item, ev.e, filed, value, concept, accn FROM ev JOIN fy ON fy.cik = ev.cik AND fy.e = ev.e AND fy.s = ev.s UNION ALL SELECT cik, 'income', t, filed, value, 'TTM', accn FROM ttm WHERE value IS DISTINCT FROM before),
cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"""


def _company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return fl.company_facts(facts(spark, sf_dir), ITEMS, ["10-K"], sessions)


@query(f"""WITH {_ALL} SELECT cik, item, e AS period_end, round(value, 2) AS value, filed, (SELECT min(date) FROM cal WHERE date > filed) AS available, concept, accn FROM found""")
def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three kinds as they became known: by chains of concepts, sums without them, and twelve months from parts."""
    return _company_facts(spark, sf_dir).select("cik", "item", "period_end", r("value", 2).alias("value"), "filed", "available", "concept", "accn")


@query(f"""WITH {_ALL}, an AS (SELECT found.cik, e, value * CASE WHEN filed >= DATE '1996-06-01' THEN 2.0 ELSE 1.0 END AS v, filed, (SELECT min(date) FROM cal WHERE date > filed) AS av FROM found WHERE item = 'sales'),
a AS (SELECT * FROM an WHERE av IS NOT NULL), tt AS (SELECT DISTINCT cik, av FROM a),
l AS (SELECT tt.cik, tt.av, a.e, arg_max(a.v, struct_pack(a := a.av, f := a.filed)) AS v FROM tt JOIN a ON a.cik = tt.cik AND a.av <= tt.av GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY cik, av ORDER BY e DESC) AS back FROM l), p AS (SELECT cik, av, e, v, row_number() OVER (PARTITION BY cik, av ORDER BY e) AS i FROM n WHERE back <= 5)
SELECT cik, av AS available, round(CASE WHEN count(*) >= 3 THEN regr_slope(v, i) / nullif(abs(avg(v)), 0) END, 6) AS growth, max(e) AS latest_fy FROM p GROUP BY cik, av""")
def growth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the last five fiscal years at each filing, on the share basis after a 2:1 split in June 1996."""
    pit = stored(_company_facts(spark, sf_dir), "company-facts")
    splits = pit.select("cik").distinct().select("cik", F.lit("1996-06-01").cast("date").alias("date"), F.lit(2.0).alias("cum"))
    found = fl.growth_events(pit, "sales", splits)
    return found.select("cik", "available", r("growth").alias("growth"), "latest_fy")
