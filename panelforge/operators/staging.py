"""Operators that turn vendor records into point-in-time tables.

Bitemporal facts (entity, period_end, available, value) are append-only; what was known on a date is read
with running maxima and as-of joins. All are window expressions over one entity, or joins on a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.timeseries import asof


def known_facts(facts: DataFrame, by: Sequence[str], period: str, available: str, value: str) -> DataFrame:
    """For each (key, available): the latest period known by then and its latest value.

    A late record of an older period never displaces a newer period.
    """
    newest = F.max(F.struct(F.col(period).alias("p"), F.col(available).alias("a"), F.col(value).alias("v")))
    daily = facts.groupBy(*by, available).agg(newest.alias("f"))
    running = F.max("f").over(Window.partitionBy(*by).orderBy(available).rowsBetween(Window.unboundedPreceding, 0))
    return daily.select(*by, available, running.alias("k")).select(*by, available, F.col("k.p").alias(period), F.col("k.v").alias(value))


def as_known(left: DataFrame, facts: DataFrame, by: Sequence[str], on: str, period: str, available: str, value: str, max_age_days: int | None = None) -> DataFrame:
    """left with period and value as known on its date; null once the period is over max_age_days old."""
    known = known_facts(facts, by, period, available, value)
    found = asof(left, known, by, on, available, [period, value]).drop(f"{available}_asof")
    if max_age_days is None:
        return found
    fresh = F.datediff(F.col(on), F.col(period)) <= max_age_days
    return found.withColumns({period: F.when(fresh, F.col(period)), value: F.when(fresh, F.col(value))})


def validity_join(rows: DataFrame, windows: DataFrame, by: Sequence[str], on: str, start: str, end: str) -> DataFrame:
    """rows with the columns of the window that holds their date; null ends are open. Windows of a key that overlap are an error.

    The last window to start by the date is carried along (one shuffle), then its end is tested: no row meets
    more than one window.
    """
    w = windows.withColumn(end, F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")))
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(start, end))
    clash = F.raise_error(F.concat_ws(" ", F.lit("overlapping windows of"), *(F.col(c).cast("string") for c in by))).cast("date")
    w = w.withColumn(end, F.when(before >= F.col(start), clash).otherwise(F.col(end)))
    others = [c for c in windows.columns if c not in (*by, start)]
    found = asof(rows, w, by, on, start, others).withColumnRenamed(f"{start}_asof", start)
    return found.filter(F.col(on) <= F.col(end))


MOST_RANGES = 10_000


def first_match(rows: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, order: str, value: str, ids: Sequence[str]) -> DataFrame:
    """The value of the first range, by order, that holds x. The range table goes to every task: at most MOST_RANGES rows."""
    if ranges.limit(MOST_RANGES + 1).count() > MOST_RANGES:
        raise ValueError(f"more than {MOST_RANGES} ranges")
    hit = rows.join(F.broadcast(ranges), F.col(x).between(F.col(lo), F.col(hi)), "left")
    return hit.groupBy(*ids, x).agg(F.min_by(value, order).alias(value))


def backward_factor(step: str, by: str, session: str) -> Column:
    """Product of the later rows' steps: 1 at the end."""
    later = Window.partitionBy(by).orderBy(session).rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.product(step).over(later), F.lit(1.0))


def forward_factor(step: str, by: str, session: str) -> Column:
    return F.product(step).over(Window.partitionBy(by).orderBy(session).rowsBetween(Window.unboundedPreceding, 0))


def nearest_split(g: Column, small_term: int, reach: float) -> tuple[Column, Column]:
    """Of the ratios a split may have, the one next to the growth factor g, and how far off it is in relative terms.

    A split is of n shares for one or the reverse, or of a for b if the smaller of the two is at most ``small_term``
    and neither is ``reach`` times the other.
    """
    up = g >= 1

    def candidate(m: int) -> Column:
        n = F.rint(F.when(up, g * m).otherwise(F.lit(float(m)) / g))
        ratio = F.when(n > 0, F.when(up, n / m).otherwise(F.lit(float(m)) / n))
        allowed = ratio.isNotNull() & (ratio != 1)
        if m > 1:
            allowed &= (ratio > 1 / reach) & (ratio < reach)
        return F.when(allowed, F.struct(F.abs(g / ratio - 1).alias("err"), F.lit(m).alias("m"), ratio.alias("ratio")))

    best = F.array_min(F.filter(F.array(*(candidate(m) for m in range(1, small_term + 1))), lambda c: c.isNotNull()))
    return best["ratio"], best["err"]


def implied_actions(days: DataFrame, tolerance: float = 0.005, least: float = 0.0005, small_term: int = 4, reach: float = 3.0, big: float = 0.15, forced: Column | None = None) -> DataFrame:
    """Splits and cash that a price and its adjusted price imply between neighbouring rows.

    Needs close, adjusted, prev_close, prev_adjusted. g is the adjusted growth over the raw growth: near an
    admissible ratio it is a split, a little above one a dividend, over ``big`` more a distribution, below one unexplained.
    ``forced`` rows, of which share counts say that they aren't splits, are distributions or unexplained.
    Adds split_ratio, dividend (per new share), action and ret (total return).
    """
    ok = (F.col("close") > 0) & (F.col("prev_close") > 0)
    has_g = ok & (F.col("adjusted") > 0) & (F.col("prev_adjusted") > 0)
    g = F.when(has_g, (F.col("adjusted") / F.col("prev_adjusted")) / (F.col("close") / F.col("prev_close")))
    df = days.withColumn("_g", g)
    ratio, err = nearest_split(F.col("_g"), small_term, reach)
    df = df.withColumns({"_ratio": ratio, "_err": err})
    far = F.abs(F.col("_g") - 1)
    split = (F.col("_err") <= tolerance) & (far > big)
    if forced is not None:
        split &= ~F.coalesce(forced, F.lit(False))
    df = df.withColumn("split_ratio", F.when(split, F.col("_ratio")).otherwise(1.0))
    rest = F.coalesce(F.col("_g") / F.col("split_ratio"), F.lit(1.0))
    action = (
        F.when(F.col("prev_close").isNotNull() & ~ok, "bad_price")
        .when(split, "split").when(rest - 1 < -least, "unexplained").when(rest - 1 > big, "distribution").when(rest - 1 > least, "dividend").otherwise("")
    )
    cash = F.when(rest - 1 > least, F.col("prev_close") * (1 - 1 / rest)).otherwise(0.0)
    df = df.withColumns({"action": action, "_cash": cash})
    total = F.when(ok, (F.col("split_ratio") * F.col("close") + F.col("_cash")) / F.col("prev_close") - 1)
    return df.withColumns({"dividend": F.col("_cash") / F.col("split_ratio"), "ret": total}).drop("_g", "_ratio", "_err", "_cash")


def neighbour_outliers(df: DataFrame, by: str, session: str, x: str, reach: int, factor: float) -> Column:
    """Whether x is more than ``factor`` times off the median of its neighbours within ``reach`` sessions, itself left out."""
    w = Window.partitionBy(by).orderBy(session).rangeBetween(-reach, reach)
    near = F.collect_list(F.struct(F.col(session).alias("s"), F.col(x).alias("x"))).over(w)  # bounded by the reach
    values = F.array_sort(F.transform(F.filter(near, lambda n: n["s"] != F.col(session)), lambda n: n["x"]))
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, F.floor(n / 2).cast("int") + 1)
    median = F.when(n > 0, (low + high) / 2)
    return F.coalesce((F.col(x) > factor * median) | (F.col(x) * factor < median), F.lit(False))


def chain_value(facts: DataFrame, by: Sequence[str], order: Sequence[str], concept: str, value: str, chain: Sequence[str]) -> DataFrame:
    """Change events of the first concept of the chain that has a value so far; rows that change nothing go."""
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    options = [F.last(F.when(F.col(concept) == c, F.col(value)), ignorenulls=True).over(so_far) for c in chain]
    found = facts.withColumn("chosen", F.coalesce(*options))
    before = F.lag("chosen").over(Window.partitionBy(*by).orderBy(*order))
    return found.withColumn("_b", before).filter(F.col("chosen").isNotNull() & ~F.col("chosen").eqNullSafe(F.col("_b"))).drop("_b")


# Words of legal forms and share classes that don't tell one company from another.
LEGAL = [
    "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COS", "LTD", "LIMITED", "PLC", "LLC", "LP", "HOLDINGS", "HOLDING", "GROUP",
    "THE", "NEW", "DEL", "NV", "SA", "AG", "CLASS", "CL", "COMMON", "STOCK", "SHS", "ORD",
]


def name_key(name: Column) -> Column:
    """A company name as its telling words, so that two sources' spellings meet; null stays null.

    The name is cut at slashes, brackets and then at all but letters and digits, and what is left is judged word by word: state
    tags (two or three letters after a slash that end the name or a pair of slashes), bracketed parts, the letter of a share class, PUBLIC
    before LIMITED COMPANY, and legal words go; an ampersand is the word AND; single letters in a row are one word.
    """
    kept = F.translate(F.upper(name), "'\u2019", "")
    parts = F.filter(F.split(kept, "/"), lambda p, i: (i == 0) | (F.length(p) < 2) | (F.length(p) > 3) | (F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "") != ""))
    opened = F.transform(F.split(F.array_join(parts, " / "), r"\("), lambda p, i: F.when((i > 0) & F.contains(p, F.lit(")")), F.substr(p, F.instr(p, F.lit(")")) + 1)).otherwise(p))
    words = F.filter(F.split(F.replace(F.array_join(opened, " "), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+"), lambda w: w != "")
    letter = lambda w: (F.length(w) == 1) & (w >= "A")

    def telling(own: Column) -> Column:
        at = lambda i: F.coalesce(F.get(own, i), F.lit(""))
        classed = lambda w, i: letter(w) & at(i - 1).isin("CL", "CLASS")
        public = lambda w, i: (w == "PUBLIC") & (at(i + 1) == "LIMITED") & (at(i + 2) == "COMPANY")
        return F.filter(own, lambda w, i: ~w.isin(LEGAL) & ~classed(w, i) & ~public(w, i))

    start = F.struct(F.lit("").alias("key"), F.lit(False).alias("single"))

    def join(a: Column, w: Column) -> Column:
        single = F.length(w) == 1
        glue = F.when((a["key"] == "") | (a["single"] & single), "").otherwise(" ")
        return F.struct(F.concat(a["key"], glue, w).alias("key"), single.alias("single"))

    kept_words = F.get(F.transform(F.array(words), telling), 0)  # the words are made once
    return F.aggregate(kept_words, start, join, lambda a: a["key"])


def symbol(code: Column) -> Column:
    """A ticker without exchange and end-of-life suffix, classes after a point."""
    s = F.regexp_replace(F.upper(F.trim(code)), r"\.US$", "")
    return F.translate(F.regexp_replace(s, r"-\d{6}$", ""), "-/", "..")


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two keys; 0 if one has none."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    both, either = F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) == 0) | (F.size(words(b)) == 0), 0.0).otherwise(both / either)


def trailing_twelve(quarters: DataFrame, by: Sequence[str], year: str, quarter: str, value: str) -> DataFrame:
    """Last full year + year to date - last year's year to date, from year-to-date values by quarter (4 is the full year)."""
    full = quarters.filter(F.col(quarter) == 4).select(*by, (F.col(year) + 1).alias(year), F.col(value).alias("_full"))
    prior = quarters.select(*by, (F.col(year) + 1).alias(year), quarter, F.col(value).alias("_prior"))
    found = quarters.join(full, [*by, year], "left").join(prior, [*by, year, quarter], "left")
    return found.withColumn("ttm", F.when(F.col(quarter) == 4, F.col(value)).otherwise(F.col("_full") + F.col(value) - F.col("_prior"))).drop("_full", "_prior")


def predecessors(issuers: DataFrame, names: DataFrame, spans: DataFrame, gap_days: int, slack_days: int) -> DataFrame:
    """issuer, id, role: every issuer's own id, and one that filed under the same name before it where it filed late.

    issuers: issuer, first (the day its security appears); names: id, key (normalised); spans: id, first_filed,
    last_filed, n. An issuer is late that never filed or first filed over ``gap_days`` after it appeared. A
    predecessor filed before it did, and at most ``slack_days`` before the security appeared at the last; of several
    the one that filed last is it, then the one with more filings, then the smaller id. Late issuers without any
    have a row with a null id and the role none. Null and empty keys, and ids without filings, match nothing.

    The best earlier registrant of a name is a running maximum over first filings, so a common name makes no pairs.
    """
    own = issuers.join(spans.select(F.col("id").alias("issuer"), F.col("first_filed").alias("own_filed")), "issuer", "left")
    late = own.filter(F.col("own_filed").isNull() | (F.col("own_filed") > F.date_add("first", gap_days)))
    keys = names.filter(F.col("key") != "").select("id", "key").distinct()
    never = F.lit("9999-12-31").cast("date")
    asks = late.join(keys.withColumnRenamed("id", "issuer"), "issuer").select("key", F.coalesce("own_filed", never).alias("at"), "issuer", "first")
    filed = spans.join(keys, "id").select("key", F.col("first_filed").alias("at"), F.struct("last_filed", "n", (-F.col("id")).alias("minus")).alias("best"))
    w = Window.partitionBy("key").orderBy(F.datediff("at", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    found = asks.unionByName(filed, allowMissingColumns=True).withColumn("best", F.max("best").over(w)).filter(F.col("issuer").isNotNull())
    found = found.filter(F.col("best.last_filed") >= F.date_sub("first", slack_days)).groupBy("issuer").agg((-F.max("best")["minus"]).alias("id"))
    before = late.join(found, "issuer", "left").select("issuer", "id", F.when(F.col("id").isNull(), "none").otherwise("predecessor").alias("role"))
    return issuers.select("issuer", F.col("issuer").alias("id"), F.lit("primary").alias("role")).unionByName(before)


def overridden(rows: DataFrame, history: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sid, industry, source (code or override) of each security, and exceptions: ticker, issue, detail.

    rows: sid, issuer, industry; history: sid, ticker, start, end (null: open); overrides: ord, ticker, as_of,
    industry. An override holds for all securities of the issuer whose ticker it was that day (of several eras, or
    of none that covers the day, the latest to start); of an issuer's overrides the last by ``ord`` holds.
    Tickers never used are ``override_unresolved``, overrides that change nothing ``override_noop`` and securities
    left without an industry ``unmapped``. Rows with a null issuer keep their code's industry.
    """
    covers = F.coalesce((F.col("start") <= F.col("as_of")) & (F.coalesce("end", F.col("as_of")) >= F.col("as_of")), F.lit(False))
    of = overrides.join(history.select(F.col("sid"), "ticker", "start", "end"), "ticker", "left")
    of = of.groupBy("ord", "ticker", "industry").agg(F.max_by("sid", F.struct(covers, "start", "sid")).alias("sid"))
    issuer = of.join(rows.select("sid", F.col("issuer").alias("_issuer")), "sid", "left")
    last = issuer.filter(F.col("_issuer").isNotNull()).groupBy("_issuer").agg(F.max_by(F.struct(F.col("industry").alias("to"), "ticker"), "ord").alias("_by"))
    joined = rows.join(last, F.col("issuer") == F.col("_issuer"), "left")
    out = joined.select("sid", F.coalesce("_by.to", "industry").alias("industry"), F.when(F.col("_by").isNull(), "code").otherwise("override").alias("source"))
    unresolved = issuer.filter(F.col("_issuer").isNull()).select("ticker", F.lit("override_unresolved").alias("issue"), F.col("industry").alias("detail"))
    noop = joined.filter(F.col("industry") == F.col("_by.to")).select("_by.ticker", F.lit("override_noop").alias("issue"), F.col("sid").cast("string").alias("detail"))
    unmapped = joined.filter(F.coalesce("_by.to", "industry").isNull()).select(F.lit(None).cast("string").alias("ticker"), F.lit("unmapped").alias("issue"), F.col("sid").cast("string").alias("detail"))
    return out, unresolved.unionByName(noop).unionByName(unmapped)


def on_or_before(days: DataFrame, sessions: DataFrame, on: str = "date") -> DataFrame:
    """days with session and number: the last session at or before each day, and its place in the calendar (from 1); null before the first.

    sessions: date, a row per session. Calendars are small, days may be many: they meet by an as-of join of the different days only.
    """
    one = F.lit(0).alias("_calendar")
    numbered = sessions.select("date").distinct().select(F.col("date").alias("session"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("number"), one)
    different = days.select(on).distinct().withColumn("_calendar", one)
    found = asof(different, numbered, ["_calendar"], on, "session", ["number"]).withColumnRenamed("session_asof", "session").drop("_calendar")
    return days.join(found, on, "left")


def available_session(days: DataFrame, sessions: DataFrame, on: str = "filed", lag: int = 1) -> DataFrame:
    """days with available: the ``lag``-th session strictly after each day, null past the calendar."""
    found = on_or_before(days, sessions, on)
    numbered = sessions.select("date").distinct().select(F.col("date").alias("available"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("_at"))
    return found.withColumn("_at", F.coalesce("number", F.lit(0)) + lag).join(F.broadcast(numbered), "_at", "left").drop("_at", "session", "number")


def merge_thin(cells: DataFrame, parents: DataFrame, sessions: DataFrame, least: float, count: int, window: int, most: int) -> tuple[DataFrame, DataFrame]:
    """group, s, merged (the parent where the group was thin on over ``most`` of the last ``window`` sessions), and exceptions.

    cells: group, s, n, neff; a group is thin where neff or n is too small, or it has none. parents: group, parent. One level only: a thin group whose
    parent is thin too still takes the parent's name, and is reported as thin_parent. Exceptions: group, issue, first, last, sessions.
    """
    grid = parents.crossJoin(F.broadcast(sessions.select("s").distinct()))  # groups x sessions, both of the model's size
    thin = (F.coalesce("neff", F.lit(0.0)) < least) | (F.coalesce("n", F.lit(0)) < count)
    breaches = F.sum("_thin").over(Window.partitionBy("group").orderBy("s").rowsBetween(1 - window, 0))
    x = grid.join(cells, ["group", "s"], "left").withColumn("_thin", thin.cast("int")).withColumn("_out", breaches > most)
    up = x.filter("_out").select(F.col("group").alias("parent"), "s", F.lit(True).alias("_both"))
    x = x.join(up, ["parent", "s"], "left")
    span = [F.min("s").alias("first"), F.max("s").alias("last"), F.count("*").alias("sessions")]
    gone = x.filter("_out")
    issues = gone.groupBy("group", F.lit("thin_merged").alias("issue")).agg(*span).unionByName(gone.filter("_both").groupBy("group", F.lit("thin_parent").alias("issue")).agg(*span))
    return x.select("group", "s", F.when(F.col("_out"), F.col("parent")).otherwise(F.col("group")).alias("merged")), issues
