"""Factor covariances of all dates at once: decayed moments as running sums, corrections refreshed by calendar, state that moves by a session.

A date's moments are those of the session before, decayed, plus its own products. So all dates come from one scan over pairs of factors, and a day's
update needs the last state and the last few sessions only, not the history. Tables follow the model's size: pairs of factors times sessions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.operators.dense import _square, eigen_adjusted, split_covariance
from panelforge.sources.store import stored


def pair_products(panel: DataFrame, factor: str, session: str, x: str, lags: int) -> DataFrame:
    """i, j (i <= j), s, p0 and p1..: products of the two factors at a session, and of each with the other's value exactly that many sessions before.

    A pair has a row at each session since both factors began; a missing value makes its products 0.
    """
    back = Window.partitionBy("f").orderBy("s")
    known = panel.select(F.col(factor).alias("f"), F.col(session).alias("s"), F.col(x).alias("x")).filter("x IS NOT NULL")
    begun = known.groupBy("f").agg(F.min("s").alias("_from"))
    grid = begun.crossJoin(F.broadcast(known.select("s").distinct())).filter("s >= _from").drop("_from")  # factors x sessions
    one = grid.join(known, ["f", "s"], "left")
    one = one.withColumns({f"x{k}": F.max("x").over(back.rangeBetween(-k, -k)) for k in range(1, lags + 1)})
    names = ["x", *(f"x{k}" for k in range(1, lags + 1))]
    a, b = (one.select("s", F.col("f").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in names)) for n in ("i", "j"))
    both = a.join(b, "s").filter("i <= j")
    cross = lambda k: F.coalesce(F.col(f"i_x{k}") * F.col("j_x"), F.lit(0.0)) + F.coalesce(F.col(f"j_x{k}") * F.col("i_x"), F.lit(0.0))
    return both.select("i", "j", "s", F.coalesce(F.col("i_x") * F.col("j_x"), F.lit(0.0)).alias("p0"), *(cross(k).alias(f"p{k}") for k in range(1, lags + 1)))


def _bartlett(lags: int, sums: str = "p") -> Column:
    return sum((F.col(f"{sums}{k}") * (1 - k / (lags + 1)) for k in range(1, lags + 1)), F.col(f"{sums}0"))


def running_covariances(panel: DataFrame, factor: str, session: str, x: str, half_life: float, lags: int) -> DataFrame:
    """s, i, j (i <= j), cov of every session, as of all up to it: decayed, with Bartlett-weighted lags both ways.

    A session where a factor has no value adds nothing to its pairs; weights are normalised over the sessions of the panel.
    """
    pairs = pair_products(panel, factor, session, x, lags)
    sessions = stored(panel.filter(F.col(x).isNotNull()).select(F.col(session).alias("s")).distinct(), "sessions")
    weight = ts.decayed_sums(sessions.withColumn("_one", F.lit(0)), ["_one"], "s", {"w": F.lit(1.0)}, half_life).select("s", "w")
    terms = {f"p{k}": F.col(f"_p{k}") for k in range(lags + 1)}
    rows = pairs.select("i", "j", "s", *(F.col(c).alias(f"_{c}") for c in terms))
    sums = ts.decayed_sums(rows, ["i", "j"], "s", terms, half_life)
    return sums.join(F.broadcast(weight), "s").select("s", "i", "j", (_bartlett(lags) / F.col("w")).alias("cov"))


def moment_state(panel: DataFrame, factor: str, session: str, x: str, half_life: float, lags: int, upto: int) -> DataFrame:
    """i, j, s, w, p0..: the decayed sums as of a session, from the whole history."""
    past = panel.filter((F.col(session) <= upto) & F.col(x).isNotNull())
    pairs = pair_products(past, factor, session, x, lags)
    keep = F.pow(F.lit(0.5), (F.lit(upto) - F.col("s")) / F.lit(float(half_life)))
    w = past.select(F.col(session).alias("s")).distinct().agg(F.sum(keep).alias("w"))
    sums = pairs.groupBy("i", "j").agg(*(F.sum(keep * F.col(f"p{k}")).alias(f"p{k}") for k in range(lags + 1)))
    return sums.crossJoin(F.broadcast(w)).select("i", "j", F.lit(upto).alias("s"), "w", *(f"p{k}" for k in range(lags + 1)))


def advance_state(state: DataFrame, recent: DataFrame, factor: str, session: str, x: str, half_life: float, lags: int) -> DataFrame:
    """The state one session on. recent: the new session's rows and those of the ``lags`` sessions before it."""
    now = recent.agg(F.max(session).alias("_now"))
    new = pair_products(recent, factor, session, x, lags).join(F.broadcast(now), F.col("s") == F.col("_now"))
    last = state.agg(F.max("s").alias("_s"), F.max("w").alias("_w")).crossJoin(now)
    both = state.drop("s", "w").join(new.select("i", "j", *(F.col(f"p{k}").alias(f"_p{k}") for k in range(lags + 1))), ["i", "j"], "full").crossJoin(F.broadcast(last))
    keep = F.pow(F.lit(0.5), (F.col("_now") - F.col("_s")) / F.lit(float(half_life)))
    moved = [(F.coalesce(F.col(f"p{k}") * keep, F.lit(0.0)) + F.coalesce(f"_p{k}", F.lit(0.0))).alias(f"p{k}") for k in range(lags + 1)]
    return both.select("i", "j", F.col("_now").alias("s"), (F.col("_w") * keep + 1).alias("w"), *moved)


def state_covariance(state: DataFrame, lags: int) -> DataFrame:
    """s, i, j, cov of a state."""
    return state.select("s", "i", "j", (_bartlett(lags) / F.col("w")).alias("cov"))


def refresh_days(dates: DataFrame, date: str, how: str) -> DataFrame:
    """date, refresh: whether its correction is made anew: each date (daily), or the first of an ISO week (weekly)."""
    if how == "daily":
        return dates.select(date, F.lit(True).alias("refresh"))
    if how != "weekly":
        raise ValueError("refresh is daily or weekly")
    week = F.date_trunc("week", F.col(date))
    return dates.select(date, week.alias("_w")).withColumn("refresh", F.row_number().over(Window.partitionBy("_w").orderBy(date)) == 1).drop("_w")


def layered(pre: DataFrame, refresh: DataFrame, lam: DataFrame, by: str, *, windows: DataFrame, estimator: Sequence[float], sims: int, scale: float, horizon: float, provisional: int, seed: int = 7) -> DataFrame:
    """by, factor_i, factor_j, cov_final, cov_pre_eigen, lambda, provisional of each date.

    pre: by, i, j, cov. refresh: by, refresh. lam: by, lambda (missing: 1). windows: by, n, the sessions a date's covariance rests on; a date with under
    ``provisional`` of them is provisional. estimator: half life and lags of deviations, then of correlations, as simulated samples are estimated. On refresh days
    the bias of each eigenvalue is simulated; other dates take the last day's, as-of. Each date's own eigenvalues are corrected by it,
    then the regime and the horizon scale the matrix. One small matrix a date; dates are spread over tasks.
    """
    kind = dict(pre.dtypes)[by]
    tri = stored(pre.select(by, F.col("i").alias("factor_i"), F.col("j").alias("factor_j"), "cov"), "pre")
    sample = lambda r: split_covariance(r, *estimator)

    def simulate(rows: pd.DataFrame) -> pd.DataFrame:
        _, f = _square(rows, "cov")
        day, n = rows[by].iloc[0], int(rows["n"].iloc[0])
        own = int.from_bytes(hashlib.sha256(f"{seed}|{day}".encode()).digest()[:8], "big")
        _, _, bias = eigen_adjusted(f, n, sims, scale, own, sample)
        return pd.DataFrame({by: [day], "bias": [bias.tolist()]})

    marked = tri.join(refresh.filter("refresh").select(by), by, "left_semi").join(windows.select(by, "n"), by)
    biases = marked.groupBy(by).applyInPandas(simulate, f"{by} {kind}, bias array<double>")
    days = windows.select(by, "n").join(lam.select(by, "lambda"), by, "left").withColumn("_all", F.lit(0))  # a row a date
    days = ts.asof(days, biases.select(F.col(by).alias("_day"), "bias", F.lit(0).alias("_all")), ["_all"], by, "_day", ["bias"])

    def correct(rows: pd.DataFrame) -> pd.DataFrame:
        names, f = _square(rows, "cov")
        values, vectors = np.linalg.eigh(f)
        bias = rows["bias"].iloc[0]
        v = np.asarray(bias, float) if bias is not None and len(bias) == len(values) else np.ones(len(values))
        gamma = scale * (v - 1) + 1
        final = (vectors * (gamma**2 * values)) @ vectors.T * float(rows["lambda"].iloc[0]) ** 2 * horizon
        out = [(rows[by].iloc[0], names[i], names[j], (final[i, j] + final[j, i]) / 2, f[i, j] * horizon) for i, j in zip(*np.triu_indices(len(names)))]
        return pd.DataFrame(out, columns=[by, "factor_i", "factor_j", "cov_final", "cov_pre_eigen"])

    full = tri.join(days.select(by, "n", F.coalesce("lambda", F.lit(1.0)).alias("lambda"), "bias"), by)
    out = full.groupBy(by).applyInPandas(correct, f"{by} {kind}, factor_i string, factor_j string, cov_final double, cov_pre_eigen double")
    return out.join(days.select(by, F.coalesce("lambda", F.lit(1.0)).alias("lambda"), (F.col("n") < provisional).alias("provisional")), by)
