"""Identity resolution on a small made-up index that needs every rule."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelforge.operators import identity as idn

FIRST = datetime.date(2020, 1, 1)
N, LAST = 120, 119
DAY = lambda s: FIRST + datetime.timedelta(days=s)

SPELLS = [
    ("ACME", 0, LAST),
    ("OLDN", 0, 59), ("NEWN", 60, LAST),  # renamed; the vendor moved the history to the new code
    ("TWICE", 0, 39), ("TWICE", 80, LAST),  # one ticker, two companies
    ("DUOA", 0, LAST), ("DUOB", 0, LAST),  # two classes of one issuer
    ("BACK", 0, 29), ("BACK", 90, LAST),  # left and came back
    ("GONE", 0, 99),  # known by name only
    ("VOID", 0, LAST),  # the vendor has nothing
    ("CHA", 0, 19), ("CHB", 20, 49), ("CHC", 50, LAST),  # a chain of renames
    ("HID", 0, LAST), ("HIDE", 70, LAST),  # the early part lies under a later entrant's code
    ("SWAP", 0, LAST),  # one code hands over to another
    ("HAND", 0, LAST),  # cut and set by hand
    ("SAME", 0, LAST),  # two registrants of one name
]
CODES = [  # ticker, code, name, delisted, first and last priced session
    ("ACME", "ACME", "Acme Inc", False, 0, LAST),
    ("OLDN", "OLDN", "Another Fund", False, 100, LAST),
    ("NEWN", "NEWN", "Newname Inc", False, 0, LAST),
    ("TWICE", "TWICE", "Twice New Inc", False, 70, LAST),
    ("TWICE", "TWICE_old", "Twice Works Co", True, 0, 39),
    ("DUOA", "DUOA", "Duo Inc", False, 0, LAST),
    ("DUOB", "DUOB", "Duo Inc", False, 0, LAST),
    ("BACK", "BACK", "Backagain Corp", False, 0, LAST),
    ("GONE", "GONE", "Gonebird Inc", True, 0, 99),
    ("VOID", "VOID", None, None, None, None),
    ("CHA", "CHA", None, None, None, None),
    ("CHB", "CHB", None, None, None, None),
    ("CHC", "CHC", "Chain Inc", False, 0, LAST),
    ("HID", "HID", "Hidden Inc", False, 70, LAST),
    ("HIDE", "HIDE", "Hideout Inc", False, 0, LAST),
    ("SWAP", "SWAP", "Swap Inc", False, 105, LAST),
    ("SWAP", "SWAP_old", "Swap Inc", True, 0, 104),
    ("HAND", "HAND", "Hand Inc", False, 0, LAST),
    ("SAME", "SAME", "Same Name Inc", False, 0, LAST),
]
CURRENT = [("ACME", 1), ("NEWN", 2), ("TWICE", 3), ("DUOA", 4), ("DUOB", 4), ("BACK", 5), ("CHC", 6), ("HID", 7), ("HIDE", 8), ("SWAP", 9)]
MAPPED = [(1, "ACME", "Acme Inc"), (99, "OLDN", "Another Trust"), (10, "HAND", "Hand Incorporated"), (5, "BACK", "Backagain Corp"), (9, "SWAP", "Swap Inc")]
NAMES = [("GONEBIRD, INC.", 11), ("TWICE WORKS CO /DE/", 12), ("SAME NAME INC", 13), ("SAME NAME CORP", 14)]
COMPANIES = [(c, n, t, sic) for c, n, t, sic in [(1, "Acme Inc", ["ACME"], 1), (11, "Gonebird, Inc.", [], 1), (12, "TWICE WORKS CO /DE/", [], 1), (13, "Same Name Inc", [], None), (14, "Same Name Corp", [], 7)]]
SPANS = [(c, DAY(-900), DAY(900), 40) for c in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)] + [(3, DAY(60), DAY(900), 10)]


def tables(spark):
    make = spark.createDataFrame
    eras = make(SPELLS, "ticker string, start int, end int")
    candidates = make([c[:4] for c in CODES], "ticker string, code string, name string, delisted boolean")
    priced = make([(c[1], s) for c in CODES if c[4] is not None for s in range(c[4], c[5] + 1)], "code string, s int")
    calendar = make([(s, DAY(s)) for s in range(N)], "s int, date date")
    overrides = make([(1, "HAND", None, 30, "ACME", 77), (2, "HAND", 10, 60, "NEWN", 78)], "ord int, ticker string, start int, end int, code string, cik long")
    return dict(
        eras=eras, candidates=candidates, priced=priced, calendar=calendar, overrides=overrides, current=make(CURRENT, "ticker string, cik long"),
        mapped=make([(*m, k) for k, m in enumerate(MAPPED)], "cik long, ticker string, title string, ord int"), registered=make(NAMES, "name string, cik long"),
        companies=make([(*c, []) for c in COMPANIES], "cik long, name string, tickers array<string>, sic int, former array<string>"),
        spans=make(SPANS, "cik long, first_filed date, last_filed date, n int"), last=LAST,
    )


@pytest.fixture(scope="module")
def found(spark):
    history, windows, exceptions = idn.resolve(**tables(spark))
    rows = history.collect()
    return {(r.ticker, r.start): r for r in rows}, windows, exceptions.collect(), history


def test_rename_takes_the_entrants_code_and_registrant(found):
    rows, windows, _, _ = found
    old, new = rows["OLDN", 0], rows["NEWN", 60]
    assert old.sid == new.sid and (old.code, old.method, old.cik, old.cik_method) == ("NEWN", "renamed_to:NEWN", 2, "rename")
    own = windows.filter(windows.sid == new.sid).collect()
    assert [(r.code, str(r.valid_from), str(r.valid_to)) for r in own] == [("NEWN", idn.FIRST_DAY, idn.LAST_DAY)]


def test_one_ticker_two_companies(found):
    old, new = found[0]["TWICE", 0], found[0]["TWICE", 80]
    assert old.sid != new.sid and (old.code, old.cik, old.cik_method) == ("TWICE_old", 12, "name")
    assert (new.code, new.cik, new.cik_method) == ("TWICE", 3, "current")


def test_coming_back_is_the_same_security(found):
    assert found[0]["BACK", 0].sid == found[0]["BACK", 90].sid and found[0]["BACK", 0].cik == 5


def test_known_by_name_only(found):
    assert (found[0]["GONE", 0].cik, found[0]["GONE", 0].cik_method) == (11, "name")


def test_chain_of_renames_ends_at_the_last_code(found):
    chain = [found[0][k] for k in (("CHA", 0), ("CHB", 20), ("CHC", 50))]
    assert {r.code for r in chain} == {"CHC"} and len({r.sid for r in chain}) == 1 and {r.cik for r in chain} == {6}
    assert [r.method for r in chain] == ["renamed_to:CHB", "renamed_to:CHC", "coverage"]


def test_hidden_rename_and_code_switch_cut_the_spell(found):
    rows, windows, _, _ = found
    early, late = rows["HID", 0], rows["HID", 70]
    assert (early.end, early.code, early.method, early.sid) == (69, "HIDE", "renamed_to:HIDE", rows["HIDE", 70].sid)
    assert (late.code, late.sid == early.sid) == ("HID", False)
    first, second = rows["SWAP", 0], rows["SWAP", 105]
    assert (first.end, first.code, first.method, second.code) == (104, "SWAP_old", "code_switch", "SWAP")
    own = [(r.code, str(r.valid_from), str(r.valid_to)) for r in windows.filter(windows.sid == second.sid).orderBy("valid_from").collect()]
    assert first.sid == second.sid and first.cik == second.cik == 9
    assert own == [("SWAP_old", idn.FIRST_DAY, str(DAY(104))), ("SWAP", str(DAY(105)), idn.LAST_DAY)]


def test_overrides_cut_and_decide(found):
    rows = found[0]
    assert [(k, rows[k].code, rows[k].cik, rows[k].method) for k in sorted(rows) if k[0] == "HAND"] == [
        (("HAND", 0), "ACME", 77, "override"), (("HAND", 10), "ACME", 77, "override"), (("HAND", 31), "NEWN", 78, "override"), (("HAND", 61), "HAND", 10, "coverage"),
    ]


def test_what_nothing_explains_is_kept_and_reported(found):
    rows, _, exceptions, _ = found
    assert rows["VOID", 0].sid is not None and rows["VOID", 0].cik is None
    assert {(e.ticker, e.issue) for e in exceptions} == {("VOID", "unpriced"), ("VOID", "no_registrant"), ("SAME", "ambiguous_registrant")}
    assert rows["SAME", 0].cik == 14  # the one with an industry code


def test_numbers_follow_first_appearance_whatever_the_partitions(found, spark):
    rows = found[0]
    first = {}
    for r in rows.values():
        first[r.sid] = min(first.get(r.sid, (10**9, "~")), (r.start, r.ticker))
    tickers = {s: min(r.ticker for r in rows.values() if r.sid == s) for s in first}
    order = sorted(first, key=lambda s: (first[s][0], tickers[s]))
    assert order == list(range(1, len(first) + 1))
    again = tables(spark)
    again = {k: v.repartition(5) if hasattr(v, "repartition") else v for k, v in again.items()}
    assert sorted(map(tuple, idn.resolve(**again)[0].collect()), key=repr) == sorted((tuple(r) for r in rows.values()), key=repr)


def test_share_classes_by_what_is_traded(spark, found):
    rows, windows, _, history = found
    t = tables(spark)
    from pyspark.sql import functions as F

    traded = t["priced"].withColumn("amount", F.when(F.col("code") == "DUOB", 2.0).otherwise(1.0))
    got = {r.sid: (r.primary_class, r.linked_sid) for r in idn.share_classes(history, windows, traded, t["calendar"], 63).collect()}
    a, b = rows["DUOA", 0].sid, rows["DUOB", 0].sid
    assert a != b and got[b] == (True, None) and got[a] == (False, b)
    assert got[rows["TWICE", 0].sid] == (True, None)


def test_candidates(spark):
    make = spark.createDataFrame
    listings = make([("AB", "A Inc", False), ("AB_old", "B Inc", True), ("AB_old1", None, True), ("XY.US", "X", False), ("Q_OLDER", "Q", True)], "code string, name string, delisted boolean")
    got = idn.candidate_codes(make([("AB",), ("XY",), ("N.A",), ("AB",), (None,)], "ticker string"), listings)
    assert sorted(((r.ticker, r.code, r.name) for r in got.filter("ticker IS NOT NULL").collect()), key=repr) == [("AB", "AB", "A Inc"), ("AB", "AB_old", "B Inc"), ("AB", "AB_old1", None), ("N.A", "N-A", None), ("XY", "XY.US", "X")]
    ciks = idn.candidate_registrants(make([("AB",), ("XY",)], "ticker string"), make([("AB", 1), ("ZZ", 9)], "ticker string, cik long"), make([("AB", 1), ("XY", 2)], "ticker string, cik long"), make([("B, INC.", 3), ("x inc", 2), (None, 8)], "name string, cik long"), make([("B Inc",), ("X",), (None,), ("",)], "name string"))
    assert sorted(map(tuple, ciks.collect())) == [(1, "current"), (2, "ticker"), (3, "name")]


def test_spans_read_the_two_best_entrants(spark):
    """400 tickers wait for the same session and 400 enter it: a span has two rows, not one for each entrant, and a spell takes none of its own ticker."""
    make = spark.createDataFrame
    priced = make([(f"C{k:03d}", s) for k in range(400) for s in range(10) if s < 6 + k // 100], "code string, s int").unionByName(make([("NONE", 9)], "code string, s int"))
    entrants = make([(f"T{k:03d}", 10, f"C{k:03d}") for k in range(400)], "ticker string, at int, code string")
    best = idn.best_of_spans(make([(0, 9), (0, 9), (5, 9), (3, 8)], "from int, to int"), entrants, priced, idn.Rules(coverage=0.9)).collect()
    assert {(r["from"], r["to"]): [(b.ticker, b.covers) for b in r.best] for r in best} == {(0, 9): [("T399", 0.9), ("T398", 0.9)]}
    eras = entrants.select("ticker", F.col("at").alias("start"), F.lit(20).alias("end"), "code", F.lit(0.95).alias("coverage"))
    waiting = make([(f"T{k:03d}", 0, 9) for k in range(400)], "ticker string, start int, end int").select("*", F.lit("NONE").alias("code"), F.lit(0.1).alias("coverage"))
    x = eras.unionByName(waiting).withColumns({"key": F.concat_ws("|", "ticker", "start"), "link": F.lit(None).cast("string"), "vendor_name": F.lit("x"), "method": F.lit("coverage")})
    found = {r.ticker: r.method for r in idn.settle(x, priced, F.col("coverage") < 0.9, F.lit(True), [], 20, idn.Rules(coverage=0.9)).filter("end = 9").collect()}
    assert found == {f"T{k:03d}": "renamed_to:T398" if k == 399 else "renamed_to:T399" for k in range(400)}
