"""Who a ticker was: vendor codes, registrants and securities behind spells of index membership.

A spell (ticker, start, end) is in session numbers, so neighbours differ by one. A vendor's code is judged by
its coverage: the share of a spell's sessions it has prices for. Coverage never joins spells with the sessions inside
them: a code's sessions are one row, an array as long as the calendar at most. Spells meet candidates
by ticker and registrants by name key. They never meet the entrants of a session: how well an entrant's code covers a span of sessions is
the same for all spells that ask for that span, so spans, of which the calendar has few, meet entrants, and spells read the
two best of their span, as the best may be their own ticker's. Chains of renames are settled in rounds, as many as the longest chain of open spells, each cut by
a table in the shared folder. Nothing comes to the driver but whether a round changed something.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import timeseries as ts
from panelforge.operators.staging import name_key, symbol, token_similarity
from panelforge.operators.valuation import linked_by_keys
from panelforge.sources.store import stored

#: A vendor marks codes that lost their ticker with this ending.
SUPERSEDED = r"(?i)_old\d*$"
FIRST_DAY, LAST_DAY = "1900-01-01", "2999-12-31"


@dataclass(frozen=True)
class Rules:
    coverage: float = 0.9
    similarity: float = 0.6
    slack_days: int = 365
    class_sessions: int = 63


def candidate_codes(tickers: DataFrame, listings: DataFrame) -> DataFrame:
    """ticker, code, name, delisted of all codes that may hold a ticker's history: its own and superseded ones.

    Tickers that no listing has get a code made of themselves, without a name.
    """
    known = listings.withColumn("ticker", symbol(F.regexp_replace("code", SUPERSEDED, "")))
    asked = tickers.select("ticker").distinct()
    hits = known.join(asked, "ticker").groupBy("ticker", "code").agg(F.min_by("name", F.struct(F.col("name").isNull(), "name")).alias("name"), F.bool_and("delisted").alias("delisted"))
    rest = asked.join(hits, "ticker", "left_anti").select("ticker", F.translate("ticker", ".", "-").alias("code"))
    return hits.unionByName(rest, allowMissingColumns=True)


def candidate_registrants(tickers: DataFrame, current: DataFrame, mapped: DataFrame, registered: DataFrame, names: DataFrame) -> DataFrame:
    """cik, via: registrants that may stand behind the tickers, each by its most trusted source.

    current and mapped: ticker, cik; registered: name, cik; names: name of vendors' listings. Trust falls from members
    known today over the registry's tickers to equal name keys. Null tickers, keys and ciks match nothing.
    """
    asked = tickers.select("ticker").distinct()
    own = current.select(symbol(F.col("ticker")).alias("ticker"), "cik").join(asked, "ticker", "left_semi")
    keys = names.select(name_key(F.col("name")).alias("key")).filter("key <> ''").distinct()
    named = registered.select(name_key(F.col("name")).alias("key"), "cik").join(keys, "key", "left_semi")
    sources = [("current", own), ("ticker", mapped.join(asked, "ticker", "left_semi")), ("name", named)]
    rows = [df.select(F.col("cik").cast("long").alias("cik"), F.struct(F.lit(k).alias("rank"), F.lit(via).alias("via")).alias("by")) for k, (via, df) in enumerate(sources)]
    return reduce(DataFrame.unionByName, rows).filter("cik IS NOT NULL").groupBy("cik").agg(F.min("by")["via"].alias("via"))


def sessions_of(priced: DataFrame) -> DataFrame:
    """code, sessions: the different sessions of a code as an array. priced: code, s; what has sessions stays as it is."""
    return priced if "sessions" in priced.columns else priced.groupBy("code").agg(F.collect_set("s").alias("sessions"))


def coverage(spans: DataFrame, priced: DataFrame, start: str = "start", end: str = "end", code: str = "code", name: str = "coverage") -> DataFrame:
    """spans with the share of the sessions from start to end that the code has; 0 without a code. priced: code, s (or sessions_of it)."""
    x = spans.withColumn("_of", F.col(code)).join(sessions_of(priced).withColumnsRenamed({"code": "_of", "sessions": "_days"}), "_of", "left")
    inside = F.size(F.filter("_days", lambda s: (s >= F.col(start)) & (s <= F.col(end))))
    share = F.try_divide(F.when(F.col("_days").isNotNull(), inside).otherwise(0), F.greatest(F.col(end) - F.col(start) + 1, F.lit(0)))
    return x.withColumn(name, F.coalesce(share, F.lit(0.0))).drop("_of", "_days")


def best_of_spans(spans: DataFrame, entrants: DataFrame, priced: DataFrame, rules: Rules) -> DataFrame:
    """from, to, best: of the entrants of the session after ``to`` whose code covers the span, the two best, the better first.

    spans: from, to. entrants: ticker, at, code, and what else is to be known of them; a ticker enters a session once. More coverage is better,
    then the later ticker. Two are enough for a spell to read the best that isn't its own ticker.
    """
    offers = entrants.filter("code IS NOT NULL").withColumn("to", F.col("at") - 1)
    seen = coverage(spans.select("from", "to").distinct().join(offers, "to"), priced, "from", "to", name="covers").filter(F.col("covers") >= rules.coverage)
    place = F.row_number().over(Window.partitionBy("from", "to").orderBy(F.col("covers").desc(), F.col("ticker").desc()))
    top = seen.withColumn("_place", place).filter("_place <= 2")
    fields = [c for c in seen.columns if c not in ("from", "to")]
    return top.groupBy("from", "to").agg(F.array_sort(F.collect_list(F.struct("_place", *fields))).alias("best"))  # two


def _of_others(best: str, ticker: str) -> Column:
    """The first of the best that isn't the ticker's."""
    return F.get(F.filter(best, lambda b: b["ticker"] != F.col(ticker)), 0)


def cut(eras: DataFrame, overrides: DataFrame) -> DataFrame:
    """ticker, start, end, forced_code, forced_cik: spells cut where an override of their ticker begins or ends.

    overrides: ord, ticker, start, end (sessions; null: open), code, cik. Of several that meet a piece the first by ``ord`` holds.
    """
    points = F.array(F.col("start"), F.col("end") + 1)
    cuts = overrides.select("ticker", F.explode(points).alias("at")).filter("at IS NOT NULL")
    x = eras.select("ticker", "start", "end").join(cuts, "ticker", "left")
    inside = F.collect_set(F.when((F.col("at") > F.col("start")) & (F.col("at") <= F.col("end")), F.col("at")))
    x = x.groupBy("ticker", "start", "end").agg(F.array_sort(inside).alias("cuts"))
    begins = F.concat(F.array("start"), "cuts")
    ends = F.concat(F.transform("cuts", lambda c: c - 1), F.array("end"))
    x = x.select("ticker", begins.alias("begins"), ends.alias("ends"))
    pieces = x.select("ticker", F.explode(F.transform("begins", lambda b, i: F.struct(b.alias("start"), F.get("ends", i).alias("end")))).alias("p")).select("ticker", "p.start", "p.end")
    o = overrides.select("ticker", "ord", F.col("start").alias("_from"), F.col("end").alias("_to"), "code", "cik")
    met = pieces.join(o, "ticker", "left").withColumn("_meets", (F.coalesce("_from", "start") <= F.col("end")) & (F.coalesce("_to", "end") >= F.col("start")) & F.col("ord").isNotNull())
    first = F.min_by(F.when(F.col("_meets"), F.struct("code", "cik")), F.when(F.col("_meets"), F.col("ord")))
    return met.groupBy("ticker", "start", "end").agg(first.alias("o")).select("ticker", "start", "end", F.col("o.code").alias("forced_code"), F.col("o.cik").alias("forced_cik"), F.col("o").isNotNull().alias("forced"))


def own_code(eras: DataFrame, candidates: DataFrame, priced: DataFrame, last: int, rules: Rules) -> DataFrame:
    """eras with code, coverage, vendor_name and method: of the ticker's codes one that covers the spell, else the best.

    A live spell prefers a code in use, an ended one a superseded one, then a delisted one; then coverage, then the code.
    """
    old = F.regexp_like("code", F.lit(SUPERSEDED))
    gone = F.coalesce("delisted", F.lit(False))
    live = F.col("end") >= last
    liking = F.when(live, F.when(~old & ~gone, 0).when(~old, 1).otherwise(2)).otherwise(F.when(old, 0).when(gone, 1).otherwise(2))
    pairs = coverage(eras.join(candidates.select("ticker", "code", F.col("name").alias("vendor_name"), "delisted"), "ticker"), priced)
    rank = F.struct((F.col("coverage") < rules.coverage).alias("a"), liking.alias("b"), (-F.col("coverage")).alias("c"), F.col("code").alias("d"))
    best = pairs.groupBy("ticker", "start").agg(F.min_by(F.struct("code", "coverage", "vendor_name"), rank).alias("best"))
    forced = coverage(eras.filter("forced_code IS NOT NULL").select("ticker", "start", "end", "forced_code"), priced, code="forced_code", name="forced_coverage")
    names = candidates.filter("name IS NOT NULL").groupBy(F.col("code").alias("forced_code")).agg(F.min("name").alias("forced_name"))
    x = eras.join(best, ["ticker", "start"], "left").join(forced.drop("end", "forced_code"), ["ticker", "start"], "left").join(names, "forced_code", "left")
    by_hand = F.col("forced_code").isNotNull()
    return x.select(
        "ticker", "start", "end", "forced", "forced_cik",
        F.when(by_hand, F.col("forced_code")).otherwise(F.col("best.code")).alias("code"),
        F.coalesce(F.when(by_hand, F.col("forced_coverage")).otherwise(F.col("best.coverage")), F.lit(0.0)).alias("coverage"),
        F.when(by_hand, F.col("forced_name")).otherwise(F.col("best.vendor_name")).alias("vendor_name"),
        F.when(by_hand, "override").when(F.col("best").isNotNull(), "coverage").otherwise("none").alias("method"),
    )


def _key(ticker: str | Column, start: str | Column) -> Column:
    return F.concat_ws("|", ticker, start)


def hidden_renames(open_eras: DataFrame, eras: DataFrame, candidates: DataFrame, priced: DataFrame, rules: Rules) -> DataFrame:
    """ticker, start, at, score, and the two pieces' codes: spells whose early part another entrant's code prices.

    Another ticker enters at session ``at`` inside the spell; its code covers the spell before, and a code of the spell's own ticker
    what follows. A spell asks for each of its sessions for the best entrant of the span before; the spells of a span share it.
    """
    asked = open_eras.select("ticker", "start", "end", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("at"))
    entrants = eras.filter(F.col("coverage") >= rules.coverage).select("ticker", F.col("start").alias("at"), "code", "vendor_name")
    best = best_of_spans(asked.select(F.col("start").alias("from"), (F.col("at") - 1).alias("to")), entrants, priced, rules)
    best = best.select(F.col("from").alias("start"), (F.col("to") + 1).alias("at"), "best")
    met = asked.join(best, ["start", "at"]).withColumn("b", _of_others("best", "ticker")).filter("b IS NOT NULL")
    met = met.select("ticker", "start", "end", "at", F.col("b.ticker").alias("other"), F.col("b.code").alias("early_code"), F.col("b.vendor_name").alias("early_name"), F.col("b.covers").alias("early"))
    own = met.select("ticker", "start", "end", "at").join(candidates.select("ticker", F.col("code").alias("late_code"), F.col("name").alias("late_name")), "ticker")
    own = coverage(own, priced, "at", "end", "late_code", "late")
    best = own.groupBy("ticker", "start", "at").agg(F.max_by(F.struct("late_code", "late_name", "late"), F.struct("late", (-F.length("late_code")).alias("n"), "late_code")).alias("own")).filter(F.col("own.late") >= rules.coverage)
    x = met.join(best, ["ticker", "start", "at"]).select("*", "own.*").drop("own")
    rank = F.struct((F.col("early") + F.col("late")).alias("a"), (-F.col("at")).alias("b"), F.col("other").alias("c"))
    return x.groupBy("ticker", "start").agg(F.max_by(F.struct("at", "other", "early_code", "early_name", "early", "late_code", "late_name", "late"), rank).alias("s")).select("ticker", "start", "s.*")


def code_switches(open_eras: DataFrame, candidates: DataFrame, priced: DataFrame, rules: Rules) -> DataFrame:
    """As hidden_renames, where one of the ticker's own codes hands over to another at its first session."""
    codes = candidates.select("ticker", "code", "name").distinct()
    x = open_eras.select("ticker", "start", "end").join(codes.withColumnsRenamed({"code": "late_code", "name": "late_name"}), "ticker")
    x = x.join(sessions_of(priced).withColumnRenamed("code", "late_code"), "late_code").withColumn("at", F.array_min(F.filter("sessions", lambda s: s > F.col("start")))).drop("sessions")
    x = coverage(x.filter(F.col("at") <= F.col("end")), priced, "at", "end", "late_code", "late").filter(F.col("late") >= rules.coverage)
    x = x.join(codes.withColumnsRenamed({"code": "early_code", "name": "early_name"}), "ticker").filter("early_code <> late_code").withColumn("_to", F.col("at") - 1)
    x = coverage(x, priced, "start", "_to", "early_code", "early").filter(F.col("early") >= rules.coverage)
    rank = F.struct((F.col("early") + F.col("late")).alias("a"), (-F.col("at")).alias("b"), F.col("late_code").alias("c"), F.col("early_code").alias("d"))
    best = x.groupBy("ticker", "start").agg(F.max_by(F.struct("at", F.lit(None).cast("string").alias("other"), "early_code", "early_name", "early", "late_code", "late_name", "late"), rank).alias("s"))
    return best.select("ticker", "start", "s.*")


def split_uncovered(eras: DataFrame, candidates: DataFrame, priced: DataFrame, rules: Rules) -> DataFrame:
    """Spells with key and link; those no one code covers in two pieces where a hidden rename or a code switch explains them."""
    open_eras = eras.filter((F.col("coverage") < rules.coverage) & ~F.col("forced") & (F.col("end") > F.col("start")))
    hidden = stored(hidden_renames(open_eras, eras, candidates, priced, rules), "renames")
    switched = code_switches(open_eras.join(hidden.select("ticker", "start"), ["ticker", "start"], "left_anti"), candidates, priced, rules)
    x = eras.join(hidden.unionByName(switched), ["ticker", "start"], "left")
    piece = lambda start, end, code, cov, name, method, link: F.struct(start.alias("start"), end.alias("end"), code.alias("code"), cov.alias("coverage"), name.alias("vendor_name"), method.alias("method"), link.alias("link"))
    none = F.lit(None).cast("string")
    how = F.when(F.col("other").isNull(), F.lit("code_switch")).otherwise(F.concat(F.lit("renamed_to:"), "other"))
    early = piece(F.col("start"), F.col("at") - 1, F.col("early_code"), F.col("early"), F.col("early_name"), how, F.when(F.col("other").isNotNull(), _key("other", "at")))
    late = piece(F.col("at"), F.col("end"), F.col("late_code"), F.col("late"), F.col("late_name"), F.lit("coverage"), none)
    whole = piece(F.col("start"), F.col("end"), F.col("code"), F.col("coverage"), F.col("vendor_name"), F.col("method"), none)
    found = x.select("ticker", "forced_cik", F.explode(F.when(F.col("at").isNull(), F.array(whole)).otherwise(F.array(early, late))).alias("p")).select("ticker", "forced_cik", "p.*")
    return found.withColumn("key", _key("ticker", "start"))


def settle(eras: DataFrame, priced: DataFrame, waits: Column, offers: Column, takes: Sequence[str], last: int, rules: Rules) -> DataFrame:
    """Links spells that wait to the best covering entrant of the session after their end; takes its ``takes`` columns.

    Newest first: a spell is settled once none of its entrants waits itself, so a chain of renames passes on the last code. Rounds are as
    many as the longest chain of sessions, and none pairs a session's spells with its entrants.
    """
    columns = eras.columns
    x = stored(eras.withColumn("open", waits & (F.col("end") < last) & F.col("link").isNull()), "settling")
    while not x.filter("open").isEmpty():
        open_spells = x.filter("open")
        waiting = open_spells.groupBy((F.col("start") - 1).alias("end")).agg(F.min("ticker").alias("_lo"), F.max("ticker").alias("_hi"))  # a row a session
        later = F.coalesce((F.col("_lo") != F.col("ticker")) | (F.col("_hi") != F.col("ticker")), F.lit(False))
        ready = open_spells.select("key", "ticker", "start", "end").join(F.broadcast(waiting), "end", "left").filter(~later).drop("_lo", "_hi")
        entrants = x.filter(F.coalesce(offers, F.lit(False))).select("key", "ticker", F.col("start").alias("at"), "code", "vendor_name", *(F.col(c).alias(f"_{c}") for c in takes))
        best = best_of_spans(ready.select(F.col("start").alias("from"), F.col("end").alias("to")), entrants, priced, rules).select(F.col("from").alias("start"), F.col("to").alias("end"), "best")
        ready = ready.join(best, ["start", "end"], "left").select("key", _of_others("best", "ticker").alias("to"), F.lit(True).alias("_done"))
        y = x.join(ready, "key", "left")
        hit = F.col("to").isNotNull()
        new = {"link": F.col("to.key"), "code": F.col("to.code"), "coverage": F.col("to.covers"), "vendor_name": F.col("to.vendor_name"), "method": F.concat(F.lit("renamed_to:"), F.col("to.ticker"))}
        new |= {c: F.col(f"to._{c}") for c in takes} | ({"cik_method": F.lit("rename")} if "cik" in takes else {})
        y = y.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()} | {"open": F.col("open") & F.col("_done").isNull()})
        x = stored(y.select(*columns, "open"), "settling")
    return x.drop("open")


def registrants(eras: DataFrame, current: DataFrame, mapped: DataFrame, registered: DataFrame, companies: DataFrame, spans: DataFrame, last: int, rules: Rules) -> DataFrame:
    """eras with cik and cik_method. eras need start_date and end_date.

    In order: by hand; today's member list for live spells; the registry's ticker if it filed during the spell and its title is like the
    vendor's name; else registrants of the same name key that filed then: the only one, the only one of that name today, the only one with
    that ticker, or the one with an industry code and the latest and most filings, which is reported as ambiguous.
    current: ticker, cik. mapped: ticker, cik, title, ord. registered: name, cik. companies: cik, name, tickers (array), sic, former (array of
    names). spans: cik, first_filed, last_filed, n.
    """
    live = F.col("end") >= last
    x = eras.join(current.select(symbol(F.col("ticker")).alias("ticker"), F.col("cik").alias("_now")).groupBy("ticker").agg(F.max("_now").alias("_now")), "ticker", "left")
    by_ticker = mapped.groupBy("ticker").agg(F.min_by(F.struct("cik", "title"), "ord").alias("_m"))
    x = x.join(by_ticker, "ticker", "left").withColumn("_mcik", F.col("_m.cik"))
    x = x.join(spans.select(F.col("cik").alias("_mcik"), "first_filed", "last_filed"), "_mcik", "left")
    during = lambda: (F.col("first_filed") <= F.date_add("end_date", rules.slack_days)) & (F.col("last_filed") >= F.date_sub("start_date", rules.slack_days))
    in_time = F.coalesce(during(), F.lit(False)) | (live & F.col("first_filed").isNull())
    named = F.coalesce(F.col("vendor_name") != "", F.lit(False))
    like = named & (token_similarity(name_key(F.coalesce("vendor_name", F.lit(""))), name_key(F.coalesce("_m.title", F.lit("")))) >= rules.similarity)
    x = x.withColumn("_mapped", F.when(in_time & (like | (~named & live)), F.col("_mcik"))).drop("first_filed", "last_filed", "_m", "_mcik")
    today = companies.select("cik", name_key(F.coalesce("name", F.lit(""))).alias("today"), F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"), F.col("sic").isNotNull().alias("has_sic"))
    former = companies.select(F.explode(F.concat(F.array("name"), F.coalesce("former", F.array().cast("array<string>")))).alias("name"), "cik")
    keys = registered.select("name", "cik").unionByName(former).select(name_key(F.coalesce("name", F.lit(""))).alias("name_key"), F.col("cik").cast("long").alias("cik")).filter("name_key <> ''").distinct()
    asked = x.filter(named).select("key", "ticker", "start_date", "end_date", name_key(F.col("vendor_name")).alias("name_key"))
    filers = asked.join(keys, "name_key").join(spans, "cik").filter(during()).join(today, "cik", "left")
    filers = filers.withColumns({"is_now": F.coalesce(F.col("today") == F.col("name_key"), F.lit(False)), "has_ticker": F.coalesce(F.array_contains("tickers", F.col("ticker")), F.lit(False)), "has_sic": F.coalesce("has_sic", F.lit(False))})
    now, tick = F.col("is_now"), F.col("has_ticker")
    of = lambda c: F.max(F.when(c, F.col("cik")))
    some = filers.groupBy("key").agg(
        F.count("*").alias("n"), F.count(F.when(now, 1)).alias("n_now"), F.count(F.when(tick, 1)).alias("n_tick"), F.count(F.when(now & tick, 1)).alias("n_both"),
        F.max("cik").alias("any"), of(now).alias("now"), of(tick).alias("tick"), of(now & tick).alias("both"),
        F.max_by("cik", F.struct("is_now", "has_sic", "last_filed", "n", -F.col("cik"))).alias("best"),
    )
    x = x.join(some, "key", "left")
    ticks, ticked = F.when(F.col("n_now") > 0, F.col("n_both")).otherwise(F.col("n_tick")), F.when(F.col("n_now") > 0, F.col("both")).otherwise(F.col("tick"))
    rungs = [
        (F.col("forced_cik").isNotNull(), F.col("forced_cik"), "override"),
        (live & F.col("_now").isNotNull(), F.col("_now"), "current"),
        (F.col("_mapped").isNotNull(), F.col("_mapped"), "ticker"),
        (F.col("n") == 1, F.col("any"), "name"),
        (F.col("n_now") == 1, F.col("now"), "name+current_name"),
        (ticks == 1, ticked, "name+ticker"),
        (F.col("n") > 1, F.col("best"), "name_ambiguous"),
    ]
    pick = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.struct(v.cast("long").alias("cik"), F.lit(m).alias("how"))) for c, v, m in rungs), F.struct(F.lit(None).cast("long").alias("cik"), F.lit("unresolved").alias("how")))
    return x.withColumn("_p", pick).select(*eras.columns, F.col("_p.cik").alias("cik"), F.col("_p.how").alias("cik_method"))


def follow_links(eras: DataFrame) -> DataFrame:
    """Linked spells with the registrant of the spell at the end of their links; rounds are the logarithm of the longest chain."""
    ends = stored(eras.select("key", F.coalesce("link", "key").alias("to")), "links")
    while True:
        onward = ends.select(F.col("key").alias("to"), F.col("to").alias("beyond"))
        ends = stored(ends.join(onward, "to", "left").select("key", F.coalesce("beyond", "to").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), "links")
        moved = not ends.filter("moved").isEmpty()
        ends = ends.drop("moved")
        if not moved:
            break
    roots = eras.select(F.col("key").alias("to"), F.col("cik").alias("_cik"))
    x = eras.join(ends, "key").join(roots, "to", "left")
    linked = F.col("link").isNotNull()
    return x.withColumns({"cik": F.when(linked, F.col("_cik")).otherwise(F.col("cik")), "cik_method": F.when(linked, "rename").otherwise(F.col("cik_method"))}).select(*eras.columns)


def securities(eras: DataFrame) -> DataFrame:
    """eras with sid: spells joined by links, by registrant and code, and by a registrant's spells that follow one another.

    Securities are numbered from 1 by their first session, then by ticker.
    """
    order = Window.partitionBy(F.coalesce(F.col("cik").cast("string"), "key")).orderBy("start", "ticker")  # unknown ones each by itself
    x = eras.withColumns({"_lag": F.lag("key").over(order), "_end": F.lag("end").over(order)})
    follows = F.col("cik").isNotNull() & (F.col("start") == F.col("_end") + 1)
    shared = [
        x.select("key", F.concat(F.lit("s|"), "key").alias("value")),
        x.filter("link IS NOT NULL").select("key", F.concat(F.lit("s|"), "link").alias("value")),
        x.filter(follows).select("key", F.concat(F.lit("s|"), "_lag").alias("value")),
        x.filter("cik IS NOT NULL AND code IS NOT NULL").select("key", F.concat_ws("|", F.lit("c"), "cik", "code").alias("value")),
    ]
    parts = linked_by_keys(reduce(DataFrame.unionByName, shared).withColumnRenamed("key", "spell"), "spell", [F.col("value")])
    joined = stored(eras.join(parts.withColumnRenamed("spell", "key"), "key"), "securities")
    first = joined.groupBy("component").agg(F.min("start").alias("_first"), F.min("ticker").alias("_ticker")).withColumn("_all", F.lit(0))
    numbers = ts.ranked(first, ["_all"], ["_first", "_ticker", "component"], "sid").select("component", "sid")
    return joined.join(numbers, "component").drop("component").withColumn("sid", F.col("sid").cast("long"))


def code_windows(history: DataFrame, calendar: DataFrame) -> DataFrame:
    """sid, code, valid_from, valid_to: which code prices a security when; the first and last window are open."""
    w = Window.partitionBy("sid").orderBy("start", "ticker")
    x = history.withColumns({"_first": F.row_number().over(w) == 1, "_prev": F.lag("end").over(w)}).filter("code IS NOT NULL")
    x = x.withColumn("_run", F.sum(F.when(F.col("code").eqNullSafe(F.lag("code").over(w)), 0).otherwise(1)).over(w))
    x = x.withColumn("_from", F.when(~F.col("_first"), F.col("_prev") + 1))
    runs = x.groupBy("sid", "code", "_run").agg(F.min_by("_from", "start").alias("_from"), F.max("end").alias("_to"))
    last = F.max("_run").over(Window.partitionBy("sid"))
    days = calendar.select(F.col("s"), F.col("date"))
    runs = runs.withColumn("_to", F.when(F.col("_run") < last, F.col("_to")))
    runs = runs.join(days.select(F.col("s").alias("_from"), F.col("date").alias("_a")), "_from", "left").join(days.select(F.col("s").alias("_to"), F.col("date").alias("_b")), "_to", "left")
    return runs.select("sid", "code", F.coalesce("_a", F.lit(FIRST_DAY).cast("date")).alias("valid_from"), F.coalesce("_b", F.lit(LAST_DAY).cast("date")).alias("valid_to"))


def share_classes(history: DataFrame, windows: DataFrame, traded: DataFrame, calendar: DataFrame, sessions: int) -> DataFrame:
    """sid, primary_class, linked_sid: of an issuer's securities that are members at once, the one that trades most is the primary.

    traded: code, s, amount. Most is the median over the last ``sessions`` sessions that all share; ties go to the smaller sid.
    """
    spans = history.groupBy("sid").agg(F.max_by("cik", "start").alias("cik"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    shared = spans.filter("cik IS NOT NULL").groupBy("cik").agg(F.count("*").alias("n"), F.max("lo").alias("lo"), F.min("hi").alias("hi")).filter("n > 1 AND lo <= hi")
    several = spans.select("sid", "cik").join(shared.select("cik", F.greatest("lo", F.col("hi") - sessions + 1).alias("lo"), "hi"), "cik")
    rows = traded.join(calendar, "s").select("code", "s", "date", "amount")
    # Two securities may share a code, even at once; a code has a few windows.
    priced = rows.join(windows, "code").filter("date BETWEEN valid_from AND valid_to").join(several, "sid").filter("s BETWEEN lo AND hi")
    score = priced.groupBy("sid").agg(F.median("amount").alias("score"))
    ranked = several.join(score, "sid", "left")
    best = ranked.groupBy("cik").agg(F.max_by("sid", F.struct(F.coalesce("score", F.lit(0.0)).alias("a"), (-F.col("sid")).alias("b"))).alias("best"))
    found = ranked.join(best, "cik").select("sid", F.when(F.col("sid") != F.col("best"), F.col("best")).alias("linked_sid"))
    return spans.select("sid").join(found, "sid", "left").select("sid", F.col("linked_sid").isNull().alias("primary_class"), "linked_sid")


def resolve(eras: DataFrame, candidates: DataFrame, priced: DataFrame, calendar: DataFrame, overrides: DataFrame, current: DataFrame, mapped: DataFrame, registered: DataFrame, companies: DataFrame, spans: DataFrame, last: int, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """history (a row for each spell: sid, ticker, start, end, code, coverage, method, cik, cik_method, vendor_name), the codes'
    validity windows, and exceptions (ticker, start, end, issue, detail): spells without a covering code or without a registrant, and ambiguous ones.

    eras: ticker, start, end; priced: code, s; calendar: s, date; all sessions are numbers. Spells that nothing explains stay, and are reported.
    """
    priced = stored(sessions_of(priced), "sessions")
    x = stored(own_code(cut(eras, overrides), candidates, priced, last, rules), "own-codes")
    x = split_uncovered(x, candidates, priced, rules)
    x = settle(x, priced, F.col("coverage") < rules.coverage, F.lit(True), [], last, rules)
    unpriced = x.filter(F.col("coverage") < rules.coverage)
    days = [calendar.select(F.col("s").alias(c), F.col("date").alias(f"{c}_date")) for c in ("start", "end")]
    x = x.join(days[0], "start", "left").join(days[1], "end", "left")
    x = follow_links(stored(registrants(x, current, mapped, registered, companies, spans, last, rules), "registrants"))
    x = settle(x, priced, F.col("cik").isNull(), F.col("cik").isNotNull(), ["cik"], last, rules)
    history = stored(securities(x).drop("key", "link", "forced_cik", "start_date", "end_date"), "history")
    best = F.concat(F.lit("best code "), F.coalesce("code", F.lit("none")), F.lit(" covers "), F.format_string("%.0f%%", F.col("coverage") * 100))
    name = F.concat(F.lit("vendor name "), F.coalesce("vendor_name", F.lit("none")))
    issues = [
        unpriced.select("ticker", "start", "end", F.lit("unpriced").alias("issue"), best.alias("detail")),
        history.filter("cik IS NULL").select("ticker", "start", "end", F.lit("no_registrant").alias("issue"), name.alias("detail")),
        history.filter("cik_method = 'name_ambiguous'").select("ticker", "start", "end", F.lit("ambiguous_registrant").alias("issue"), name.alias("detail")),
    ]
    return history, code_windows(history, calendar), reduce(DataFrame.unionByName, issues)
