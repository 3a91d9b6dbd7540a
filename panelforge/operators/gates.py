"""All gates of a day at one grain: each input read once into a row a date, checks as expressions over the joined row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARANTINED, OK = "QUARANTINED", "OK"


@dataclass(frozen=True)
class GateRules:
    priced: float = 0.98
    universe: tuple[int, int] = (495, 510)
    moment: float = 1e-6
    imputed: float = 0.1
    vif_fail: float = 10.0
    vif_warn: float = 5.0
    stability: float = 0.95
    stability_slow: float = 0.85
    slow_styles: tuple[str, ...] = ()
    constraint: float = 1e-8
    condition: float = 1e4
    names: int = 300
    fit: tuple[float, float] = (0.02, 0.9)
    tracking_bp: float = 5.0
    shock: float = 6.0
    regime: tuple[float, float] = (0.5, 2.5)
    level: tuple[float, float] = (0.1, 0.5)
    periods: float = 12.0


@dataclass(frozen=True)
class DayInputs:
    """universe: date, sid, in_estu. prices: date, sid, close. qa: date, style, mean_cw, std_ew, imputed, vif, stability. stats: date, status, n,
    condition, constraint_resid, r2, tracking (country less market). factors: date, factor, f_over_sigma. cov: date, i, j, cov (i <= j, or both). regimes:
    date, factor_lambda, specific_lambda. specific: date, sid, sigma."""

    universe: DataFrame
    prices: DataFrame
    qa: DataFrame
    stats: DataFrame
    factors: DataFrame
    cov: DataFrame
    regimes: DataFrame
    specific: DataFrame


def definite(cov: DataFrame) -> DataFrame:
    """date, symmetric, least: whether the two halves agree, and the smallest eigenvalue; a matrix of factors for each date."""
    kind = dict(cov.dtypes)["date"]

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*rows["i"], *rows["j"]})
        at = {n: k for k, n in enumerate(names)}
        i, j, c = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy(), rows["cov"].to_numpy(float)
        m, seen = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)), bool)
        m[i, j], seen[i, j] = c, True
        both = seen & seen.T
        same = bool((m[both] == m.T[both]).all()) and bool((seen | seen.T).all()) and bool(np.isfinite(c).all())
        m = np.where(seen, m, m.T)
        least = float(np.linalg.eigvalsh((m + m.T) / 2)[0]) if np.isfinite(m).all() else float("-inf")
        return pd.DataFrame({"date": [rows["date"].iloc[0]], "symmetric": [same], "least": [least]})

    return cov.select("date", "i", "j", "cov").groupBy("date").applyInPandas(check, f"date {kind}, symmetric boolean, least double")


def day_facts(inputs: DayInputs, rules: GateRules) -> DataFrame:
    """A row for each date that any input has: what its gates look at."""
    u = inputs.universe.select("date", "sid", "in_estu")
    p = inputs.prices.filter("close > 0").select("date", "sid").distinct().withColumn("priced", F.lit(True))
    s = inputs.specific.select("date", "sid", "sigma")
    # One pass over a date's names: prices and forecasts meet the universe by (date, sid).
    names = u.join(p, ["date", "sid"], "left").join(s, ["date", "sid"], "left")
    good = F.col("sigma").isNotNull() & ~F.isnan("sigma") & (F.col("sigma") > 0) & (F.col("sigma") < float("inf"))
    own = names.groupBy("date").agg(F.count("*").alias("n_cov"), F.count("priced").alias("n_priced"), F.count_if(good).alias("n_sigma"), F.median(F.when(F.col("in_estu") & ~F.isnan("sigma"), F.col("sigma"))).alias("level"))
    floor = F.when(F.col("style").isin(list(rules.slow_styles)), rules.stability_slow).otherwise(rules.stability)
    low = F.col("stability").isNotNull() & ~F.isnan("stability") & (F.col("stability") < floor)
    qa = inputs.qa.groupBy("date").agg(
        F.max(F.abs("mean_cw")).alias("mean_off"), F.max(F.abs(F.col("std_ew") - 1)).alias("std_off"), F.max(F.struct("imputed", "style")).alias("imputed"), F.max(F.when(F.col("vif").isNotNull(), F.struct("vif", "style"))).alias("vif"),
        F.array_sort(F.collect_list(F.when(low, F.concat_ws(" ", "style", F.format_string("%.2f", "stability"))))).alias("unstable"),
    )
    stats = inputs.stats.select("date", F.struct("status", "n", "condition", "constraint_resid", "r2", "tracking").alias("stats"))
    shocks = inputs.factors.groupBy("date").agg(F.array_sort(F.collect_list(F.when(F.abs("f_over_sigma") > rules.shock, F.concat_ws(" ", "factor", F.format_string("%+.1f", "f_over_sigma"))))).alias("shocks"))
    regimes = inputs.regimes.select("date", "factor_lambda", "specific_lambda")
    return reduce(lambda a, b: a.join(b, "date", "full"), [own, qa, stats, shocks, definite(inputs.cov), regimes])


def day_gates(inputs: DayInputs, rules: GateRules = GateRules()) -> DataFrame:
    """date, gate, level, ok, detail of the fifteen checks of each date; a check whose input is missing fails, one that can't apply is left out."""
    x = day_facts(inputs, rules)
    yes = lambda c: F.coalesce(c, F.lit(False))
    text = lambda form, *c: F.format_string(form, *c)
    n_cov = F.coalesce("n_cov", F.lit(0))
    share = F.coalesce(F.try_divide(F.coalesce("n_priced", F.lit(0)), F.nullif(n_cov, F.lit(0))), F.lit(0.0))
    qa, fitted = F.col("mean_off").isNotNull(), yes(F.col("stats.status") == "ok")
    s = F.col("stats")
    annual = F.col("level") * F.sqrt(F.lit(rules.periods))
    imputed = F.col("imputed.imputed") / F.greatest(n_cov, F.lit(1))
    inside = lambda c, bounds: yes(c.between(*bounds))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("none"))
    checks = [
        ("data_freshness", "FAIL", F.lit(True), share >= rules.priced, text("%d of %d names priced", F.coalesce("n_priced", F.lit(0)), n_cov)),
        ("universe", "WARN", F.lit(True), inside(n_cov, rules.universe), text("%d names", n_cov)),
        ("exposure_moments", "FAIL", F.lit(True), yes((F.col("mean_off") < rules.moment) & (F.col("std_off") < rules.moment)), F.when(qa, text("mean off by %.1e, deviation by %.1e", "mean_off", "std_off")).otherwise("no exposures")),
        ("imputation", "WARN", qa, yes(imputed <= rules.imputed), text("%.3f imputed of %s", imputed, "imputed.style")),
        ("vif", "FAIL", qa & F.col("vif").isNotNull(), yes(F.col("vif.vif") <= rules.vif_fail), text("%.2f of %s", "vif.vif", "vif.style")),
        ("vif_warn", "WARN", qa & F.col("vif").isNotNull(), yes(F.col("vif.vif") <= rules.vif_warn), text("%.2f of %s", "vif.vif", "vif.style")),
        ("stability", "WARN", qa, yes(F.size("unstable") == 0), listed(F.col("unstable"))),
        ("regression", "FAIL", F.lit(True), fitted & yes((F.abs(s["constraint_resid"]) < rules.constraint) & (s["condition"] < rules.condition) & (s["n"] >= rules.names)), F.coalesce(s["status"], F.lit("no regression"))),
        ("fit", "WARN", fitted, inside(s["r2"], rules.fit), text("%.3f", s["r2"])),
        ("country_tracking", "WARN", fitted, yes(F.abs(s["tracking"]) * 1e4 < rules.tracking_bp), text("%.1f bp", F.abs(s["tracking"]) * 1e4)),
        ("factor_shock", "WARN", F.lit(True), F.coalesce(F.size("shocks"), F.lit(0)) == 0, listed(F.coalesce("shocks", F.array().cast("array<string>")))),
        ("factor_covariance", "FAIL", F.lit(True), yes(F.col("symmetric") & (F.col("least") > 0)), F.when(F.col("symmetric").isNull(), "no covariance").otherwise(text("symmetric %s, least eigenvalue %.1e", F.col("symmetric").cast("string"), "least"))),
        ("vra", "WARN", F.lit(True), inside(F.col("factor_lambda"), rules.regime) & inside(F.col("specific_lambda"), rules.regime), F.concat_ws(", ", F.coalesce(text("%.2f", "factor_lambda"), F.lit("missing")), F.coalesce(text("%.2f", "specific_lambda"), F.lit("missing")))),
        ("specific_coverage", "FAIL", F.lit(True), (n_cov > 0) & yes(F.col("n_sigma") == n_cov), text("%d of %d names", F.coalesce("n_sigma", F.lit(0)), n_cov)),
        ("specific_level", "WARN", F.lit(True), inside(annual, rules.level), F.coalesce(text("%.3f a year", annual), F.lit("none"))),
    ]
    rows = F.array(*(F.when(applies, F.struct(F.lit(g).alias("gate"), F.lit(level).alias("level"), ok.alias("ok"), detail.alias("detail"))) for g, level, applies, ok, detail in checks))
    return x.select("date", F.inline(F.array_compact(rows)))


def day_status(gates: DataFrame) -> DataFrame:
    """date, status, failed, warned: a date with a failed FAIL gate is quarantined; the others are OK whatever warns."""
    fails = lambda level: F.array_sort(F.collect_list(F.when((F.col("level") == level) & ~F.col("ok"), F.col("gate"))))
    x = gates.groupBy("date").agg(fails("FAIL").alias("failed"), fails("WARN").alias("warned"))
    return x.select("date", F.when(F.size("failed") > 0, QUARANTINED).otherwise(OK).alias("status"), "failed", "warned")


def publishable(status: DataFrame) -> Column:
    """The latest date that passed: an aggregate over day_status."""
    return F.max(F.when(F.col("status") == OK, F.col("date")))
