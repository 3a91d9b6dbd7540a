"""Style exposures of customers by year: five styles through all steps, their descriptors' counts and moments, several regressors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import exposures as ex
from panelforge.plans.panels import YEARS, cross_years, r
from panelforge.plans.registry import query
from panelforge.sources.store import stored

MODEL = ex.StyleModel(
    weights={"size": {"ln_cap": 1.0}, "value": {"balance": 0.6, "mean_order": 0.4}, "activity": {"n_orders": 1.0}, "growth": {"growth": 1.0}},
    size="size", cubes={"size3": "size"}, targets={"size3": ["size"], "activity": ["size", "value"]}, unclipped=["ln_cap"],
)
STYLES = MODEL.styles
D = MODEL.descriptors


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of some customers are far off (errors), single orders have no mean, and a part isn't covered."""
    x = cross_years(spark, sf_dir).withColumn("in_cov", F.col("sid") % 50 != 7)
    balance = F.when(F.col("sid") % 97 == 0, F.col("acct") * 1e6).when(F.col("sid") % 11 != 0, F.col("acct"))
    return x.select("year", "sid", "industry", "cap", "v", "in_cov", (F.col("in_estu") & F.col("in_cov")).alias("in_estu"), F.ln("cap").alias("ln_cap"), balance.alias("balance"), F.when(F.col("n_orders") > 1, F.col("mean_order")).alias("mean_order"), F.col("n_orders").cast("double").alias("n_orders"), F.col("y").alias("growth"))


def _over(x: str, where: str = "in_estu", by: str = "year") -> str:
    return f"{x} FILTER (WHERE {where}) OVER (PARTITION BY {by})"


def _cw(x: str) -> str:
    return f"({_over(f'sum(cap * {x})', f'in_estu AND {x} IS NOT NULL')} / {_over('sum(cap)', f'in_estu AND {x} IS NOT NULL')})"


def _replace(source: str, columns: dict[str, str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{v} AS {c}' for c, v in columns.items())}) FROM {source}"


def _standard(source: str, columns: list[str]) -> str:
    def one(x: str) -> str:
        n, s = _over(f"count({x})"), _over(f"stddev_pop({x})")
        return f"CASE WHEN {x} IS NULL OR {n} < 2 THEN NULL WHEN {s} = 0 THEN 0 ELSE ({x} - {_cw(x)}) / {s} END"

    return _replace(source, {c: one(c) for c in columns})


def _clip(source: str, columns: list[str]) -> str:
    def one(x: str) -> str:
        m, s = _over(f"avg({x})"), _over(f"stddev_pop({x})")
        return f"CASE WHEN {x} IS NULL OR {_over(f'count({x})')} < 2 THEN {x} ELSE least(greatest({x}, {m} - 3 * {s}), {m} + 3 * {s}) END"

    return _replace(source, {c: one(c) for c in columns})


def _orth(source: str, y: str, zs: list[str], tag: str) -> str:
    """Residuals on one or two regressors by the closed forms, in three steps."""
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [y, *zs, "v"]) + " AND in_estu"
    mean = lambda c: f"{_over(f'sum(v * {c})', ok)} / {_over('sum(v)', ok)}"
    centred = f"SELECT *, {', '.join(f'{c} - {mean(c)} AS _{c}' for c in [y, *zs])}, {_over('count(*)', ok)} AS _n FROM {source}"
    s = lambda a, b: _over(f"sum(v * _{a} * _{b})", ok)
    if len(zs) == 1:
        b = {zs[0]: f"{s(y, zs[0])} / {s(zs[0], zs[0])}"}
    else:
        p, q = zs
        det = f"({s(p, p)} * {s(q, q)} - {s(p, q)} * {s(p, q)})"
        b = {p: f"({s(y, p)} * {s(q, q)} - {s(y, q)} * {s(p, q)}) / {det}", q: f"({s(y, q)} * {s(p, p)} - {s(y, p)} * {s(p, q)}) / {det}"}
    coefficients = f"SELECT *, {', '.join(f'{v} AS _b_{z}' for z, v in b.items())} FROM {tag}c"
    drop = ", ".join([f"_{c}" for c in [y, *zs]] + [f"_b_{z}" for z in zs] + ["_n"])
    value = f"CASE WHEN _n > {len(zs) + 1} THEN _{y} - {' - '.join(f'_b_{z} * _{z}' for z in zs)} ELSE {y} END"
    return f"{tag}c AS ({centred}), {tag}b AS ({coefficients}), {tag} AS (SELECT * EXCLUDE ({y}, {drop}), {value} AS {y} FROM {tag}b)"


def _imputed(source: str) -> str:
    okz = "in_estu AND v IS NOT NULL AND industry IS NOT NULL AND size IS NOT NULL"
    others = [s for s in STYLES if s != "size"]
    flags = ", ".join(f"{s} IS NULL AS imp_{s}" for s in STYLES)
    level = f"{_over('sum(v * size)', okz, 'year, industry')} / {_over('sum(v)', okz, 'year, industry')}"
    out = f"fl AS (SELECT *, {flags}, (SELECT count(DISTINCT industry) FROM {source} s2 WHERE s2.year = {source}.year) AS _g FROM {source}), "
    out += f"sz AS ({_replace('fl', {'size': f'coalesce(size, CASE WHEN industry IS NOT NULL AND {_over('count(*)', okz)} > _g THEN coalesce({level}, 0) END, 0)'})}), "
    ok = lambda s: f"in_estu AND v IS NOT NULL AND industry IS NOT NULL AND {s} IS NOT NULL"
    mean = lambda s, c: f"{_over(f'sum(v * {c})', ok(s), 'year, industry')} / nullif({_over('sum(v)', ok(s), 'year, industry')}, 0)"
    out += f"lv AS (SELECT *, {', '.join(f'{mean(s, s)} AS _x_{s}, {mean(s, "size")} AS _z_{s}, {_over("count(*)", ok(s))} AS _n_{s}' for s in others)} FROM sz), "
    slope = lambda s: f"{_over(f'sum(v * ({s} - _x_{s}) * (size - _z_{s}))', ok(s))} / nullif({_over(f'sum(v * (size - _z_{s}) * (size - _z_{s}))', ok(s))}, 0)"
    out += f"sl AS (SELECT *, {', '.join(f'{slope(s)} AS _b_{s}' for s in others)} FROM lv), "
    fill = lambda s: f"coalesce({s}, CASE WHEN industry IS NOT NULL AND _n_{s} > _g + 1 THEN coalesce(_x_{s}, 0) + coalesce(_b_{s}, 0) * (size - coalesce(_z_{s}, 0)) END, 0)"
    keep = ", ".join(["year", "sid", "industry", "cap", "v", "in_estu", "size", *(f"imp_{s}" for s in STYLES), *(f"{fill(s)} AS {s}" for s in others)])
    return out + f"im AS (SELECT {keep} FROM sl)"


_MEDIAN = ", ".join(f"{_over(f'median({d})')} AS _med_{d}" for d in D)
_MAD = ", ".join(f"{_over(f'median(abs({d} - _med_{d}))')} AS _mad_{d}" for d in D)
_BAD = {d: f"coalesce(abs({d} - _med_{d}) > 10 * 1.4826 * nullif(_mad_{d}, 0), false)" for d in D}
_TARGETS = [(s, list(t)) for s, t in MODEL.targets.items()]
_SQL = f"""WITH {YEARS}, p0 AS (SELECT year, sid, industry, cap, v, in_estu AND sid % 50 <> 7 AS in_estu, ln(cap) AS ln_cap, CASE WHEN sid % 97 = 0 THEN acct * 1e6 WHEN sid % 11 <> 0 THEN acct END AS balance,
  CASE WHEN n_orders > 1 THEN mean_order END AS mean_order, CAST(n_orders AS DOUBLE) AS n_orders, y AS growth FROM p WHERE sid % 50 <> 7),
p1 AS (SELECT * FROM p0 WHERE year IN (SELECT year FROM p0 WHERE in_estu GROUP BY year HAVING count(*) >= 30)),
r1 AS (SELECT *, {_MEDIAN} FROM p1), r2 AS (SELECT *, {_MAD} FROM r1),
d0 AS (SELECT year, sid, industry, cap, v, in_estu, {', '.join(f"CASE WHEN NOT {b} THEN {d} END AS {d}" for d, b in _BAD.items())} FROM r2),
d1 AS ({_clip('d0', [d for d in D if d not in MODEL.unclipped])}), d2 AS ({_standard('d1', D)}),
c0 AS (SELECT year, sid, industry, cap, v, in_estu, {', '.join("(" + " + ".join(f"coalesce({w} * {d}, 0)" for d, w in ws.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {d} IS NULL THEN 0 ELSE {w} END" for d, w in ws.items()) + f", 0) AS {s}" for s, ws in MODEL.weights.items())} FROM d2),
c1 AS ({_standard('c0', list(MODEL.weights))}), c2 AS (SELECT *, pow(size, 3) AS size3 FROM c1),
{_orth('c2', *_TARGETS[0], 'o1')}, {_orth('o1', *_TARGETS[1], 'o2')},
o3 AS ({_clip('o2', [s for s, _ in _TARGETS])}), o4 AS ({_standard('o3', [s for s, _ in _TARGETS])}), {_imputed('o4')},
{_orth('im', *_TARGETS[0], 'q1')}, {_orth('q1', *_TARGETS[1], 'q2')}, fin AS ({_standard('q2', STYLES)})"""


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ex.build_exposures(rows(spark, sf_dir), "year", "cap", "v", "industry", MODEL)


@query(f"{_SQL} SELECT year, sid, industry, {', '.join(f'round({s}, 5) AS {s}, imp_{s}' for s in STYLES)} FROM fin")
def style_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All styles of all covered customers, by the whole chain of steps."""
    return _built(spark, sf_dir)[0].select("year", "sid", "industry", *(c for s in STYLES for c in (r(s, 5).alias(s), f"imp_{s}")))


@query(f"{_SQL}, q AS ({' UNION ALL '.join(f"SELECT year, '{d}' AS descriptor, count(*) FILTER (WHERE {b}) AS n_error, count({d}) AS n_valid FROM r2 GROUP BY year" for d, b in _BAD.items())}) SELECT * FROM q")
def descriptor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid values of each descriptor, and those dropped as data errors."""
    return ex.descriptor_counts(rows(spark, sf_dir), "year", MODEL)


@query(f"""{_SQL}, l AS ({' UNION ALL '.join(f"SELECT year, sid, '{s}' AS style, {s} AS x, imp_{s} AS imputed, cap, in_estu FROM fin" for s in STYLES)})
SELECT year, style, round(sum(cap * x) FILTER (WHERE in_estu) / sum(cap) FILTER (WHERE in_estu), 6) + 0.0 AS mean_cw, round(stddev_pop(x) FILTER (WHERE in_estu), 6) AS std_ew, round(count(*) FILTER (WHERE NOT imputed) / count(*), 6) AS coverage, count(*) FILTER (WHERE imputed) AS imputed FROM l GROUP BY ALL""")
def style_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments, coverage and number of imputed values of each style."""
    x = _built(spark, sf_dir)[0]
    long = x.select("year", "cap", "in_estu", F.inline(F.array(*(F.struct(F.lit(s).alias("style"), F.col(s).alias("x"), F.col(f"imp_{s}").alias("imp")) for s in STYLES))))
    own = lambda c: F.when(F.col("in_estu"), c)
    mean = F.sum(own(F.col("cap") * F.col("x"))) / F.sum(own(F.col("cap")))
    return long.groupBy("year", "style").agg((r(mean) + 0.0).alias("mean_cw"), r(F.stddev_pop(own(F.col("x")))).alias("std_ew"), r(F.count_if(~F.col("imp")) / F.count("*")).alias("coverage"), F.count_if("imp").alias("imputed"))


@query(f"""WITH {YEARS}, x0 AS (SELECT year, sid, v, in_estu, ln(cap) AS lc, acct / 1000 AS bal, ln(mean_order) AS mo, y FROM p WHERE y IS NOT NULL),
{_orth('x0', 'mo', ['lc', 'bal'], 'w')} SELECT year, sid, round(mo, 5) AS resid FROM w""")
def orthogonal_to_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the weighted fit on two regressors at once."""
    x = cross_years(spark, sf_dir).filter("y IS NOT NULL").select("year", "sid", "v", "in_estu", F.ln("cap").alias("lc"), (F.col("acct") / 1000).alias("bal"), F.ln("mean_order").alias("mo"))
    return ex.orthogonalized(stored(x, "panel"), ["year"], "mo", ["lc", "bal"], "v", F.col("in_estu")).select("year", "sid", r("resid", 5).alias("resid"))
