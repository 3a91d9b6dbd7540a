"""Prices end to end: from a vendor's raw bars to flagged excess returns on the share basis of each day.

Rows of a code, then of a security, lie together: every step is a window, or a join with a table of a row for each
code. A code's stretches between splits are one small array beside its rows, so no row meets another code's stretches
and stretches never multiply rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import staging as st
from panelforge.sources.store import stored


@dataclass(frozen=True)
class PriceRules:
    split_detect: float = 0.2
    split_tolerance: float = 0.005
    least_dividend: float = 2e-5
    volume_window: int = 40
    volume_margin: float = 0.3
    stale_run: int = 5
    jump: float = 0.5
    special_multiple: float = 3.0
    dividend_sessions: int = 252


def _log(ratio: Column, *positive: str) -> Column:
    ok = F.lit(True)
    for c in positive:
        ok &= F.coalesce(F.col(c) > 0, F.lit(False))
    return F.when(ok, F.ln(F.when(ok, ratio)))


def volume_basis(rows: DataFrame, code: str, date: str, window: int, margin: float) -> DataFrame:
    """rows with volume_split, by which the vendor's volume is too large, and basis_err.

    Needs close, adjusted, prev_close, prev_adjusted, volume, split_ratio. Between splits the running sum of log adjusted
    over raw growth moves with cash only. A row's own log(close / adjusted) is that sum from its day to the day it was pulled, which
    lies in the stretch, its own or a later one, whose range is nearest; of equally near ones (to 1e-9) the latest. basis_err is the distance,
    null without both prices. So the splits up to that stretch are in the row's prices. They are in its volume too, unless the median
    volume of the ``window`` rows from the split on, against that of the last ``window`` rows before it that were pulled after it, is nearer to
    no change than to the ratio by ``margin`` in logs.
    """
    so_far = Window.partitionBy(code).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    growth = (F.col("adjusted") / F.col("prev_adjusted")) / (F.col("close") / F.col("prev_close"))
    x = rows.withColumns({
        "_lg": F.coalesce(_log(growth, "adjusted", "prev_adjusted", "close", "prev_close"), F.lit(0.0)),
        "_tau": _log(F.col("close") / F.col("adjusted"), "close", "adjusted"),
        "_i": F.row_number().over(Window.partitionBy(code).orderBy(date)),
    }).withColumns({"_cg": F.sum("_lg").over(so_far), "_seg": F.sum((F.col("split_ratio") != 1).cast("int")).over(so_far)})
    x = stored(x, "stretches")
    stretch = x.groupBy(code, "_seg").agg(F.min("_cg").alias("lo"), F.max("_cg").alias("hi"), F.min("_i").alias("first"), F.min_by("split_ratio", "_i").alias("ratio"))
    of_code = stretch.groupBy(code).agg(F.array_sort(F.collect_list(F.struct(F.col("_seg").alias("seg"), "lo", "hi", "first"))).alias("_all"))  # a split each
    target = F.col("_cg") + F.col("_tau")
    off = lambda s: F.round(F.greatest(s["lo"] - target, target - s["hi"], F.lit(0.0)), 9)
    near = F.array_min(F.transform(F.filter("_all", lambda s: s["seg"] >= F.col("_seg")), lambda s: F.struct(off(s).alias("err"), (-s["seg"]).alias("minus"))))
    y = x.join(of_code, code).withColumn("_near", F.when(F.col("_tau").isNotNull(), near))
    y = y.withColumn("_pulled", F.coalesce(-F.col("_near.minus"), F.col("_seg")))
    own = [code, "_i", "volume"]
    before = y.filter("_pulled > _seg").select(*own, F.explode(F.sequence(F.col("_seg") + 1, F.col("_pulled"))).alias("seg"))
    latest = F.row_number().over(Window.partitionBy(code, "seg").orderBy(F.col("_i").desc()))
    before = before.withColumn("_k", latest).filter(F.col("_k") <= window).select(code, "seg", F.col("volume").alias("pre"), F.lit(None).cast("double").alias("post"))
    met = F.filter("_all", lambda s: (s["seg"] > 0) & (F.col("_i") >= s["first"]) & (F.col("_i") < s["first"] + window))
    after = y.select(*own, F.explode(met).alias("s")).select(code, F.col("s.seg").alias("seg"), F.lit(None).cast("double").alias("pre"), F.col("volume").alias("post"))
    medians = before.unionByName(after).groupBy(code, "seg").agg(F.median("pre").alias("pre"), F.median("post").alias("post"))
    events = stretch.filter("_seg > 0").select(code, F.col("_seg").alias("seg"), F.ln("ratio").alias("lk")).join(medians, [code, "seg"], "left")
    change = _log(F.col("post") / F.col("pre"), "post", "pre")
    left = F.coalesce(F.abs(change - F.col("lk")) + margin >= F.abs(change), F.lit(True))
    steps = events.select(code, "seg", F.when(left, F.col("lk")).otherwise(0.0).alias("lk"))
    running = F.sum("lk").over(Window.partitionBy(code).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0))
    basis = steps.withColumn("ck", running).groupBy(code).agg(F.map_from_entries(F.collect_list(F.struct("seg", "ck"))).alias("_ck"))
    at = lambda seg: F.coalesce(F.try_element_at("_ck", seg), F.lit(0.0))
    found = y.join(basis, code, "left")
    return found.select(*rows.columns, F.exp(at(F.col("_pulled")) - at(F.col("_seg"))).alias("volume_split"), F.col("_near.err").alias("basis_err"))


def special_dividends(by: str, session: str, action: str, dividend: str, multiple: float, sessions: int) -> Column:
    """Whether a row pays a distribution, or a dividend over ``multiple`` times the median of those of the sessions before."""
    earlier = Window.partitionBy(by).orderBy(session).rangeBetween(-sessions, -1)
    median = F.percentile(F.when(F.col(action) == "dividend", F.col(dividend)), F.lit(0.5)).over(earlier)
    return (F.col(action) == "distribution") | F.coalesce((F.col(action) == "dividend") & (F.col(dividend) > multiple * median), F.lit(False))


def build_prices(bars: DataFrame, codes: DataFrame, free: DataFrame, sessions: DataFrame, rules: PriceRules = PriceRules(), not_splits: DataFrame | None = None) -> DataFrame:
    """date, sid, code, close, volume, adj_factor, ret, ret_excess, rf, flag, split_ratio, dividend, special, action, cum_split, basis_err.

    bars: code, date, close, adjusted, prev_date, prev_close, prev_adjusted, volume. codes: sid, code, valid_from, valid_to.
    free: date, rf. sessions: date, i, prev_session. not_splits: code, date of events that share counts contradict.

    Bars outside a code's validity or off the calendar go; of a security's bars of one day that of the smallest code stays. The first of
    nonpositive, jump (a large return without an action that tells why), gap (the bar before isn't of the session before), stale (a long run of one
    close) and action_unexplained is the flag; the first three leave no return.
    """
    if not_splits is not None:
        bars = bars.join(not_splits.select("code", "date").distinct().withColumn("_forced", F.lit(True)), ["code", "date"], "left")
    forced = F.col("_forced") if not_splits is not None else None
    x = st.implied_actions(bars, rules.split_tolerance, rules.least_dividend, big=rules.split_detect, forced=forced).drop("_forced").withColumnRenamed("ret", "_total")
    x = volume_basis(x, "code", "date", rules.volume_window, rules.volume_margin).withColumn("volume", F.col("volume") / F.col("volume_split"))
    x = st.validity_join(x, codes, ["code"], "date", "valid_from", "valid_to").join(sessions, "date")
    of = Window.partitionBy("sid").orderBy("date", "code")
    x = x.withColumn("_again", F.coalesce(F.lag("date").over(of) == F.col("date"), F.lit(False))).filter(~F.col("_again"))
    order = Window.partitionBy("sid").orderBy("date")
    x = x.withColumn("_new", F.coalesce(F.col("close") != F.lag("close").over(order), F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(order)).withColumn("_length", F.count("*").over(Window.partitionBy("sid", "_run")))
    flags = {
        "nonpositive": F.col("close").isNull() | (F.col("close") <= 0),
        "jump": (F.abs("_total") > rules.jump) & F.col("action").isin("", "dividend", "unexplained"),
        "gap": F.col("prev_date").isNotNull() & (F.col("prev_date") != F.col("prev_session")),
        "stale": F.col("_length") >= rules.stale_run,
        "action_unexplained": F.col("action") == "unexplained",
    }
    x = x.withColumn("flag", F.coalesce(*(F.when(c, name) for name, c in flags.items())))
    x = x.withColumn("ret", F.when(~F.coalesce(F.col("flag").isin("nonpositive", "jump", "gap"), F.lit(False)), F.col("_total")))
    paid = 1 - F.col("dividend") * F.col("split_ratio") / F.col("prev_close")
    x = x.withColumn("_step", F.when(F.col("prev_close") > 0, paid / F.col("split_ratio")).otherwise(1.0))
    x = x.withColumns({
        "special": special_dividends("sid", "i", "action", "dividend", rules.special_multiple, rules.dividend_sessions),
        "adj_factor": st.backward_factor("_step", "sid", "date"), "cum_split": st.forward_factor("split_ratio", "sid", "date"),
    }).join(free.select("date", "rf"), "date", "left")
    return x.select("date", "sid", "code", "close", "volume", "adj_factor", "ret", (F.col("ret") - F.col("rf")).alias("ret_excess"), "rf", "flag", "split_ratio", "dividend", "special", "action", "cum_split", "basis_err")
