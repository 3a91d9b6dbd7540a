"""Company facts by kind: what filings said about each period, when it was first said, and growth as known at each filing.

A filing counts at once: what it says of a concept replaces what was known. All is windows over a period of a company, and joins of a company's
periods with one another, of which there are a few a year; facts never meet the facts of another period.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.sources.store import stored

#: The days of a quarter, half a year, nine months, a year.
KINDS = {"Q": (80, 100), "H": (170, 195), "9M": (260, 285), "FY": (350, 380)}


@dataclass(frozen=True)
class Item:
    """A line of the accounts: kind (instant, annual, ttm, or each for every concept by itself), its concepts by priority, and those summed without them."""

    name: str
    kind: str
    chain: Sequence[str]
    fallback: Sequence[str] = ()
    unit: str = "USD"


def duration(start: Column, end: Column) -> Column:
    """Q, H, 9M or FY by the days of a period, else null."""
    days = F.datediff(end, start)
    return F.coalesce(*(F.when(days.between(lo, hi), k) for k, (lo, hi) in KINDS.items()))


def item_facts(facts: DataFrame, items: Sequence[Item], forms: Sequence[str]) -> DataFrame:
    """cik, item, kind, part, start, length, end, filed, accn, rank, place, name, val: the items' facts from periodic filings.

    facts: cik, concept, unit, start, end, val, filed, accn, form. Facts without value, end or filing day, and share counts that aren't positive,
    are left out. rank is a concept's place in chain and fallback, place that in the fallback, negative before it. Of one filing's values of a concept the largest counts.
    """
    rows = [(i.name, i.kind, c if i.kind == "each" else "", i.unit, c, k, k - len(i.chain)) for i in items for k, c in enumerate([*i.chain, *i.fallback])]
    table = facts.sparkSession.createDataFrame(rows, "item string, kind string, part string, unit string, concept string, rank int, place int")
    known = facts.filter("val IS NOT NULL AND end IS NOT NULL AND filed IS NOT NULL AND cik IS NOT NULL").filter(F.col("form").isin(list(forms))).filter("unit <> 'shares' OR val > 0")
    x = known.join(F.broadcast(table), ["concept", "unit"]).withColumn("length", duration(F.col("start"), F.col("end")))
    # Instants and single concepts are told by their end alone.
    bare = F.col("kind").isin("instant", "each", "annual")
    x = x.filter("kind IN ('instant', 'each') OR length IS NOT NULL").filter("kind <> 'annual' OR length = 'FY'")
    x = x.withColumns({"start": F.when(~bare, F.col("start")), "length": F.when(~bare, F.col("length"))})
    by = ["cik", "item", "kind", "part", "start", "length", "end", "filed", F.coalesce("accn", F.lit("")).alias("accn"), "rank", "place", F.col("concept").alias("name")]
    return x.groupBy(*by).agg(F.max(F.col("val").cast("double")).alias("val"))


def changes(rows: DataFrame, widest: int) -> DataFrame:
    """Each filing that changes a period's chosen value: by, filed, accn, value, concept.

    Chosen is the latest value of the first concept of the chain that has one so far; without any, the sum of the latest values of the
    fallback's concepts. The best rank so far only falls, so its latest value is the last one that had the best rank when it came.
    ``widest`` is the number of the longest fallback's concepts.
    """
    by = ["cik", "item", "kind", "part", "start", "length", "end"]
    so_far = Window.partitionBy(*by).orderBy("filed", "accn")
    summed = F.col("place") >= 0
    one = rows.groupBy(*by, "filed", "accn").agg(
        F.min_by(F.struct("rank", "name", "val"), F.when(~summed, F.col("rank"))).alias("c"),
        *(F.max(F.when(F.col("place") == k, F.struct("rank", "name", "val"))).alias(f"_f{k}") for k in range(widest)),
    )
    parts = [f"_f{k}" for k in range(widest)]
    x = one.withColumn("c", F.when(F.col("c.rank").isNotNull(), F.col("c")))
    order = so_far.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_best", F.min("c.rank").over(order))
    x = x.withColumn("_own", F.last(F.when(F.col("c.rank") == F.col("_best"), F.struct(F.col("c.val").alias("value"), F.col("c.name").alias("concept"), F.col("accn").alias("accn"))), ignorenulls=True).over(order))
    x = x.withColumns({c: F.last(c, ignorenulls=True).over(order) for c in parts})
    there = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<rank:int,name:string,val:double>>")
    total = F.struct(F.aggregate(there, F.lit(0.0), lambda a, v: a + v["val"]).alias("value"), F.array_join(F.transform(there, lambda v: v["name"]), "+").alias("concept"), F.col("accn").alias("accn"))
    x = x.withColumn("chosen", F.coalesce("_own", F.when(F.size(there) > 0, total)))
    before = F.lag("chosen.value").over(so_far)
    return x.withColumn("_b", before).filter(F.col("chosen").isNotNull() & ~F.col("chosen.value").eqNullSafe(F.col("_b"))).select(*by, "filed", "chosen.value", "chosen.concept", "chosen.accn")


def trailing(events: DataFrame, tolerance: int = 7) -> DataFrame:
    """cik, item, end, filed, value, concept, accn of twelve months to each period end, from the events of single periods.

    A full year that ends there is its own. Else last full year + the longest part of a year to date - the same part of the year before,
    whose ends and length may be ``tolerance`` days off (the nearest counts, then the earlier); known once all three are, and again
    whenever one changes. The three series are stacked on their union of days and carried along.
    """
    key = ["cik", "item"]
    series = stored(events.select(*key, "start", "end", "length").distinct(), "series")
    year = series.filter("length = 'FY'").groupBy(*key, "end").agg(F.min("start").alias("start"))
    whole = events.join(year, [*key, "end", "start"]).select(*key, "end", "filed", "value", "concept", "accn")
    part = series.filter("length <> 'FY'").join(year, [*key, "end"], "left_anti").groupBy(*key, "end").agg(F.min("start").alias("start"))
    years = series.filter("length = 'FY'").select(*key, F.col("start").alias("y_start"), F.col("end").alias("y_end"))
    last = part.join(years, key).withColumn("_off", F.abs(F.datediff("y_end", F.date_sub("start", 1)))).filter(F.col("_off") <= tolerance)
    last = last.groupBy(*key, "end", "start").agg(F.min_by(F.struct("y_start", "y_end"), F.struct("_off", "y_end", "y_start")).alias("y"))
    shorter = series.filter("length <> 'FY'").select(*key, F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    days = F.abs(F.datediff("p_end", F.date_sub("end", 365)))
    length = F.abs(F.datediff("p_end", "p_start") - F.datediff("end", "start"))
    prior = part.join(shorter, key).withColumns({"_off": days, "_len": length}).filter((F.col("_off") <= tolerance) & (F.col("_len") <= tolerance))
    prior = prior.groupBy(*key, "end", "start").agg(F.min_by(F.struct("p_start", "p_end"), F.struct("_off", "_len", "p_end", "p_start")).alias("p"))
    needs = last.join(prior, [*key, "end", "start"])
    legs = needs.select(*key, F.col("end").alias("to"), F.inline(F.array(
        F.struct(F.lit(0).alias("leg"), F.col("y.y_start").alias("start"), F.col("y.y_end").alias("end")),
        F.struct(F.lit(1).alias("leg"), F.col("start"), F.col("end")),
        F.struct(F.lit(2).alias("leg"), F.col("p.p_start").alias("start"), F.col("p.p_end").alias("end")),
    )))
    own = legs.join(events.drop("kind", "part", "length", "concept"), [*key, "start", "end"])
    day = own.groupBy(*key, "to", "filed").agg(*(F.max_by(F.when(F.col("leg") == k, F.struct("filed", "value", "accn")), F.when(F.col("leg") == k, F.col("accn"))).alias(f"_l{k}") for k in range(3)))
    w = Window.partitionBy(*key, "to").orderBy("filed")
    x = day.withColumns({f"_l{k}": F.last(f"_l{k}", ignorenulls=True).over(w) for k in range(3)})
    x = x.filter(" AND ".join(f"_l{k} IS NOT NULL" for k in range(3)))
    x = x.withColumn("value", F.col("_l0.value") + F.col("_l1.value") - F.col("_l2.value"))
    late = F.greatest(*(F.struct(F.col(f"_l{k}.filed").alias("filed"), F.lit(-k).alias("k"), F.col(f"_l{k}.accn").alias("accn")) for k in range(3)))
    x = x.withColumn("_b", F.lag("value").over(w)).filter(~F.col("value").eqNullSafe(F.col("_b")))
    return whole.unionByName(x.select(*key, F.col("to").alias("end"), "filed", "value", F.lit("TTM").alias("concept"), late["accn"].alias("accn")))


def company_facts(facts: DataFrame, items: Sequence[Item], forms: Sequence[str], sessions: DataFrame, tolerance: int = 7) -> DataFrame:
    """cik, item, period_end, value, filed, available, concept, accn: all items' values as they became known.

    available is the first session after the filing day, null past the calendar. sessions: date.
    """
    rows = item_facts(facts, items, forms)
    events = stored(changes(rows, max((len(i.fallback) for i in items), default=0)), "events")  # twelve months read it many times
    single = events.filter("kind <> 'ttm'").select("cik", "item", "end", "filed", "value", "concept", "accn")
    found = single.unionByName(trailing(events.filter("kind = 'ttm'"), tolerance))
    one = F.lit(0).alias("_calendar")
    days = events.select("filed", one).distinct()  # a row for each filing day, those of all values among them
    nxt = ts.asof(days, sessions.select(F.col("date").alias("session"), one), ["_calendar"], "filed", "session", [], forward=True, strict=True)
    out = found.join(F.broadcast(nxt.select("filed", F.col("session_asof").alias("available"))), "filed", "left")
    return out.select("cik", "item", F.col("end").alias("period_end"), "value", "filed", "available", "concept", "accn")


def growth_events(facts: DataFrame, item: str, splits: DataFrame, years: int = 5, least: int = 3, denominator: str | None = None) -> DataFrame:
    """cik, available, growth, latest_fy: an issuer's growth each time an annual value becomes known.

    facts: cik, item, period_end, value, filed, available, and accn where one day may bring several (the last by accn counts). splits: cik, date, cum (running product of split ratios). Values (a share's, or item over
    denominator) are multiplied by the splits up to their filing, so that all are on one basis. Growth is the slope of the last ``years`` fiscal
    years as then known, over their absolute mean; a year without a positive denominator keeps its place; under ``least`` values it is null.
    A later version of a year changes nothing before its day. The known years are folded along a company's filings, at most ``years`` at once.
    """
    wanted = [item, *([denominator] if denominator else [])]
    x = facts.filter(F.col("item").isin(wanted) & F.col("available").isNotNull()).select("cik", "item", "period_end", "value", "filed", "available", "accn" if "accn" in facts.columns else F.lit("").alias("accn"))
    x = ts.asof(x, splits.select("cik", F.col("date").alias("split_day"), "cum"), ["cik"], "filed", "split_day", ["cum"])
    x = x.withColumn("cum", F.coalesce("cum", F.lit(1.0)))
    per_share = F.when(F.lit(denominator is None), F.col("value") * F.col("cum")).otherwise(F.col("value"))
    e = x.select("cik", F.struct("available", "period_end", "filed", "accn", (F.col("item") == item).alias("top"), per_share.alias("v"), "cum").alias("e"))
    log = e.groupBy("cik").agg(F.array_sort(F.collect_list("e")).alias("all"))  # a company's annual filings
    year = "struct<period_end: date, v: double, d: double>"
    start = F.struct(F.array().cast(f"array<{year}>").alias("known"), F.array().cast(f"array<struct<available: date, known: array<{year}>>>").alias("out"))

    def step(a: Column, b: Column) -> Column:
        old = F.filter(a["known"], lambda k: k["period_end"] == b["period_end"])
        before = F.get(old, F.lit(0))
        v = F.when(b["top"], b["v"]).otherwise(before["v"])
        d = F.when(b["top"], before["d"]).otherwise(F.when(b["v"] > 0, b["cum"] / b["v"]))
        rest = F.filter(a["known"], lambda k: k["period_end"] != b["period_end"])
        known = F.array_sort(F.concat(rest, F.array(F.struct(b["period_end"].alias("period_end"), v.alias("v"), d.alias("d")))))
        # Years that only the denominator has don't count, but are kept for when the item comes.
        return F.struct(known.alias("known"), F.concat(a["out"], F.array(F.struct(b["available"].alias("available"), known.alias("known")))).alias("out"))

    states = log.select("cik", F.posexplode(F.aggregate("all", start, step, lambda a: a["out"])).alias("k", "s")).select("cik", "k", "s.available", "s.known")
    day = states.groupBy("cik", "available").agg(F.max_by("known", "k").alias("known"))
    own = F.filter("known", lambda k: k["v"].isNotNull())
    day = day.withColumn("own", F.slice(F.reverse(own), 1, years)).withColumn("own", F.reverse("own")).filter(F.size("own") > 0)
    value = lambda k: k["v"] if denominator is None else k["v"] * k["d"]
    points = F.filter(F.transform("own", lambda k, i: F.struct(i.cast("double").alias("t"), value(k).alias("y"))), lambda p: p["y"].isNotNull())
    day = day.withColumn("points", points)
    total = lambda f: F.aggregate("points", F.lit(0.0), lambda a, p: a + f(p))
    n = F.size("points")
    t, y, ty, tt = total(lambda p: p["t"]), total(lambda p: p["y"]), total(lambda p: p["t"] * p["y"]), total(lambda p: p["t"] * p["t"])
    slope = F.try_divide(n * ty - t * y, F.nullif(n * tt - t * t, F.lit(0.0)))
    growth = F.when(n >= least, F.try_divide(slope, F.nullif(F.abs(y / n), F.lit(0.0))))
    return day.select("cik", "available", growth.alias("growth"), F.element_at("own", -1)["period_end"].alias("latest_fy"))


def growth_panel(dates: DataFrame, events: DataFrame, max_age: int) -> DataFrame:
    """dates (cik, date) with the growth known then; null once the latest fiscal year is over ``max_age`` days old."""
    found = ts.asof(dates, events, ["cik"], "date", "available", ["growth", "latest_fy"])
    return found.select(*dates.columns, F.when(F.datediff("date", "latest_fy") <= max_age, F.col("growth")).alias("growth"))
