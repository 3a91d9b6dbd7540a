"""Market values and the descriptors built on them, and groups of records that share an identifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.sources.store import stored


def ratios(mcap: Column, earnings: Column, cash: Column, book: Column, assets: Column, preferred: Column, long_debt: Column, current_debt: Column) -> dict[str, Column]:
    """Yields and leverages. A missing debt or preferred item is zero where there is a balance sheet, else unknown."""
    worth = F.when(mcap > 0, mcap)
    sheet = book.isNotNull() | assets.isNotNull()
    item = lambda c: F.coalesce(c, F.when(sheet, 0.0))
    return {
        "earnings_yield": earnings / worth, "cash_yield": cash / worth, "book_to_price": book / worth,
        "market_leverage": (worth + item(preferred) + item(long_debt)) / worth,
        "debt_to_assets": F.try_divide(item(long_debt) + item(current_debt), F.nullif(assets, F.lit(0.0))),
        "book_leverage": F.when(book > 0, (book + item(preferred) + item(long_debt)) / book),
    }


def dividend_yield(days: DataFrame, sid: str, session: str, dividend: str, split: str, price: str, adjusts: str, filed: str, lookback: int, name: str = "dividend_yield") -> DataFrame:
    """Dividends of the last ``lookback`` rows on today's share basis, over today's price.

    Until the series was first adjusted for an action, its dividends cannot be told from prices; the filed
    amount a share is taken then, where there is one.
    """
    so_far = Window.partitionBy(sid).orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumns({"_cum": F.product(split).over(so_far), "_known": F.max(adjusts).over(so_far)})
    trail = F.sum(F.coalesce(F.col(dividend), F.lit(0.0)) * F.col("_cum")).over(Window.partitionBy(sid).orderBy(session).rowsBetween(1 - lookback, 0))
    own = F.nullif(F.col(price), F.lit(0.0))
    implied = trail / F.col("_cum") / own
    return x.withColumn(name, F.when(F.col("_known"), implied).otherwise(F.coalesce(F.col(filed) / own, implied))).drop("_cum", "_known")


def trailing_median(by: str, session: str, x: str, rows: int) -> Column:
    """The median of the last ``rows`` values of each entity, its own included."""
    last = F.array_sort(F.collect_list(F.col(x).cast("double")).over(Window.partitionBy(by).orderBy(session).rowsBetween(1 - rows, 0)))
    n = F.size(last)
    return F.when(n > 0, (F.get(last, F.floor((n - 1) / 2).cast("int")) + F.get(last, F.floor(n / 2).cast("int"))) / 2)


def plausible_counts(counts: DataFrame, days: DataFrame, sid: str, session: str, band: tuple[float, float], window: int) -> DataFrame:
    """sid, session, count, basis: share counts whose usual volume is a plausible part of them, with the splits up to their day.

    counts: sid, session, count. days: sid, session, volume, cum (running product of splits). Counts before the first volume stay, and those of 0; missing ones don't hide earlier ones.
    """
    volume = days.select(sid, F.col(session).alias("_s"), "cum", trailing_median(sid, session, "volume", window).alias("_med"))
    found = ts.asof(counts, volume, [sid], session, "_s", ["_med", "cum"])
    plausible = F.col("_med").isNull() | (F.col("count") == 0) | F.try_divide("_med", "count").between(*band)
    return found.filter(plausible).select(sid, session, "count", F.coalesce("cum", F.lit(1.0)).alias("basis"))


# Share counts that are dated snapshots; others are on the basis of the day they were filed.
SNAPSHOTS = ["dei:EntityCommonStockSharesOutstanding", "override"]


def basis_date(concept: Column, period_end: Column, filed: Column, snapshots: Sequence[str] = SNAPSHOTS) -> Column:
    """The day whose share basis a reported count is on: its own for dated snapshots, else the day it was filed."""
    return F.when(concept.isin(list(snapshots)), period_end).otherwise(filed)


def clean_counts(counts: DataFrame, days: DataFrame, by: str, band: tuple[float, float], window: int, factor: float, near_days: int) -> tuple[DataFrame, DataFrame]:
    """Counts that pass both tests, with norm (the count over the splits up to its basis day), and the others with a reason.

    counts: by, concept, period_end, filed, value. days: by, date, volume, cum. First the usual volume of the last ``window`` days must be a plausible
    part of the count (``turnover``; without volume it passes). Then the norm must be within ``factor`` times the median of the entity's other counts
    that are left and dated within ``near_days``, if there are two at least (``neighbours``).
    """
    volume = days.select(by, F.col("date").alias("_v"), trailing_median(by, "date", "volume", window).alias("_med"), "cum")
    x = counts.withColumn("basis", basis_date(F.col("concept"), F.col("period_end"), F.col("filed")))
    x = ts.asof(x, volume, [by], "basis", "_v", ["_med", "cum"]).drop("_v_asof")
    turnover = F.try_divide("_med", "value")
    x = x.withColumns({"norm": F.col("value") / F.coalesce("cum", F.lit(1.0)), "_odd": F.coalesce(~turnover.between(*band), F.lit(False))}).drop("_med", "cum")
    left = x.filter("NOT _odd").drop("_odd").withColumn("_day", F.datediff("period_end", F.lit("1970-01-01").cast("date")))
    around = Window.partitionBy(by).orderBy("_day").rangeBetween(-near_days, near_days)
    values = F.array_sort(F.collect_list("norm").over(around))  # bounded by the days
    others = F.concat(F.slice(values, F.lit(1), F.array_position(values, F.col("norm")).cast("int") - 1), F.slice(values, F.array_position(values, F.col("norm")).cast("int") + 1, F.size(values)))
    n = F.size("_others")
    median = (F.get("_others", F.floor((n - 1) / 2).cast("int")) + F.get("_others", F.floor(n / 2).cast("int"))) / 2
    off = (n >= 2) & (median > 0) & ~F.try_divide(F.col("norm"), median).between(1 / factor, factor)
    left = left.withColumn("_others", others).withColumn("_off", F.coalesce(off, F.lit(False))).drop("_others", "_day")
    dropped = x.filter("_odd").drop("_odd").withColumn("reason", F.lit("turnover")).unionByName(left.filter("_off").drop("_off").withColumn("reason", F.lit("neighbours")))
    return left.filter("NOT _off").drop("_off"), dropped


def market_caps(days: DataFrame, counts: DataFrame, floats: DataFrame, sid: str, session: str, band: tuple[float, float], window: int, fresh: int, float_fresh: int, jump: float) -> DataFrame:
    """sid, session, shares, mcap, source ('count', 'float' or null) and flag where mcap moves otherwise than the return tells.

    days: sid, session, close, ret, volume, cum. counts: sid, session, count. floats: sid, session, value of the freely
    held shares. The latest plausible count that is at most ``fresh`` sessions old counts, else a float through the
    close of its day; both are brought to today's splits. As-of joins on (sid, session); each entity's rows lie together.
    """
    good = plausible_counts(counts, days, sid, session, band, window).withColumnRenamed(session, "_c")
    at = days.select(sid, F.col(session).alias("_d"), "close", "cum", trailing_median(sid, session, "volume", window).alias("_med"))
    held = ts.asof(floats, at, [sid], session, "_d", ["close", "cum", "_med"])
    turnover = F.col("_med") * F.col("close") / F.nullif(F.col("value"), F.lit(0.0))
    usable = (F.col("value") > 0) & (F.col("close") > 0) & (turnover.isNull() | turnover.between(*band))
    held = held.select(sid, F.col(session).alias("_f"), F.when(usable, F.col("value") / F.col("close")).alias("_held"), F.col("cum").alias("_fbasis"))
    x = ts.asof(days, good, [sid], session, "_c", ["count", "basis"])
    x = ts.asof(x, held, [sid], session, "_f", ["_held", "_fbasis"])
    count = F.when(F.col(session) - F.col("_c_asof") <= fresh, F.col("count") / F.col("basis"))
    other = F.when(F.col(session) - F.col("_f_asof") <= float_fresh, F.col("_held") / F.coalesce("_fbasis", F.lit(1.0)))
    x = x.withColumns({"shares": F.coalesce(count, other) * F.col("cum"), "source": F.when(count.isNotNull(), "count").when(other.isNotNull(), "float")})
    x = x.withColumn("mcap", F.col("shares") * F.col("close"))
    before = F.lag("mcap").over(Window.partitionBy(sid).orderBy(session))
    moves = (F.col("mcap") > 0) & (before > 0) & (1 + F.col("ret") > 0)  # a value of 0, before or now, tells nothing
    moved = F.when(moves, F.ln(F.col("mcap") / before) - F.ln(1 + F.col("ret")))
    return x.select(sid, session, "shares", "mcap", "source", F.when(F.abs(moved) > jump, "continuity").alias("flag"))


def fresh_by_priority(dates: DataFrame, facts: DataFrame, by: Sequence[str], on: str, concept: str, value: str, chain: Sequence[str], days: int) -> DataFrame:
    """by, on, value, concept: of each concept the latest value at or before the date counts while at most ``days`` old;
    the first of the chain that has one is taken. Facts and dates are stacked and sorted once, whatever the chain's length."""
    packed = F.struct(F.col(on).alias("at"), F.col(value).alias("v"))
    known = facts.filter(F.col(concept).isin(list(chain)) & F.col(value).isNotNull())
    day = known.groupBy(*by, on).agg(*(F.max(F.when(F.col(concept) == c, packed)).alias(f"_c{k}") for k, c in enumerate(chain)))
    rows = dates.select(*by, on).withColumn("_asked", F.lit(True)).unionByName(day, allowMissingColumns=True)
    so_far = Window.partitionBy(*by).orderBy(on).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_l{k}": F.last(f"_c{k}", ignorenulls=True).over(so_far) for k in range(len(chain))}).filter("_asked")
    fresh = [F.when(F.datediff(F.col(on), F.col(f"_l{k}.at")) <= days, F.struct(F.col(f"_l{k}.v").alias("v"), F.lit(c).alias("c"))) for k, c in enumerate(chain)]
    best = F.coalesce(*fresh)
    return rows.select(*by, on, best["v"].alias(value), best["c"].alias(concept))


def linked_by_keys(rows: DataFrame, node: str, keys: Sequence[Column]) -> DataFrame:
    """node, component: the smallest node reachable over shared values of any key; null values link nothing.

    Labels go from nodes to key values and back, so a value that many nodes share costs a row each, never a pair. Every
    round also takes the label's own label. Rounds cut their lineage with a table in the shared folder.
    """
    ids = rows.select(node).filter(F.col(node).isNotNull()).distinct()
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in enumerate(keys)))
    held = rows.filter(F.col(node).isNotNull()).select(node, F.explode(parts).alias("key")).filter("key.value IS NOT NULL").distinct()
    held = stored(held, "held-keys")
    labels = stored(held.select(node).distinct().withColumn("component", F.col(node)), "components")
    while True:
        lowest = held.join(labels, node).groupBy("key").agg(F.min("component").alias("low"))
        near = held.join(lowest, "key").groupBy(node).agg(F.min("low").alias("near"))
        beyond = labels.select(F.col(node).alias("near"), F.col("component").alias("beyond"))
        met = labels.join(near.join(beyond, "near"), node)
        to = F.least("near", "beyond")
        found = stored(met.select(node, to.alias("component"), (to < F.col("component")).alias("changed")), "components")
        labels = found.drop("changed")
        if found.filter("changed").isEmpty():
            return ids.join(labels, node, "left").select(node, F.coalesce("component", node).alias("component"))
