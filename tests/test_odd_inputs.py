"""Queries on small tables made by hand, against their SQL: prices of 0, several filings of a day, names that many share."""

import datetime
import math

import duckdb
import pytest
from oracle import difference

from panelforge.operators import filings as fl
from panelforge.operators import valuation as va
from panelforge.plans import registry


@pytest.fixture
def compared(spark, tmp_path):
    """Writes tables, and says how a query differs from its SQL on them, in one thread as ties may be open in it."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute("SET threads = 1")
        for table, (schema, rows) in tables.items():
            path = tmp_path / f"{table}.parquet"
            con.execute(f"CREATE TABLE {table} ({schema})")
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
            con.execute(f"COPY {table} TO '{path}' (FORMAT parquet)")
        return difference(registry.QUERIES[name](spark, str(tmp_path)), con, registry.ORACLE[name])

    return run


EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE"


def days_with_zeros():
    """Values of 0 on the first day, inside, twice in a row and on the last one, each with share counts and floats around."""
    values = [[0.0, 5.0, 0.0, 0.0, 7.0, 8.0, 0.0], [3.0, 0.0, 3.1, 6.2, 6.3, 0.0, 0.0], [4.0, 4.1, 30.0, 4.0, 4.2, 4.1, 4.0]]
    rows = []
    for user, series in enumerate(values):
        for day, v in enumerate(series):
            for hour, (kind, x) in enumerate([("purchase", 0.5 + user), ("view", 0.2 + day), ("click", v)]):
                rows.append((len(rows), datetime.datetime(2024, 1, 1 + day, 8 + hour), user, kind, x))
    return rows


@pytest.mark.parametrize("name", ["market_caps", "exceptions", "staging_counters"])
def test_market_values_of_zero(compared, name):
    assert compared(name, events=(EVENTS, days_with_zeros())) is None


@pytest.mark.parametrize("name", ["market_caps", "exceptions", "staging_counters"])
def test_missing_values(compared, name):
    """A day's last value, or its share count, is missing; the value and the count before stay."""
    values = [(2.0, None, 4.0), (3.0, 5.0, None), (None, None, 6.0), (2.0, 1.0, None), (9.0, None, None)]
    rows = []
    for user in range(3):
        for day in range(8):
            for hour, (kind, x) in enumerate(zip(("view", "purchase", "click"), values[(user + day) % 5])):
                rows.append((len(rows), datetime.datetime(2024, 1, 1 + day, 8 + hour), user, kind, x))
    assert compared(name, events=(EVENTS, rows)) is None


def test_returns_too_large_for_a_whole_number_count(compared):
    """The counts need no text of a return, as in their SQL."""
    values = [[1e-18, 5.0, 6.0], [5e-324, 1e300, 0.0], [1.0, math.inf, 2.0], [1.0, math.nan, 40.0]]
    rows = [(3 * user + day, datetime.datetime(2024, 1, 1 + day, 8), user, "click", v) for user, series in enumerate(values) for day, v in enumerate(series)]
    assert compared("staging_counters", events=(EVENTS, rows)) is None


def test_a_market_value_of_zero_moves_nothing(spark):
    days = spark.createDataFrame([(1, s, c, 0.0, 10, 1.0) for s, c in enumerate([5.0, 0.0, 5.0, 50.0], 1)], "sid int, s int, close double, ret double, volume int, cum double")
    counts = spark.createDataFrame([(1, 1, 1000.0)], "sid int, s int, count double")
    floats = spark.createDataFrame([], "sid int, s int, value double")
    found = {r.s: (r.mcap, r.flag) for r in va.market_caps(days, counts, floats, "sid", "s", (0.001, 0.1), 5, 9, 9, 0.2).collect()}
    assert found == {1: (5000.0, None), 2: (0.0, None), 3: (5000.0, None), 4: (50000.0, "continuity")}


def test_actions_and_returns_on_prices_of_zero(compared, spark, tmp_path):
    assert compared("implied_actions", events=(EVENTS, days_with_zeros())) is None
    found = {(r.sid, r.s): (r.action, r.ret) for r in registry.QUERIES["implied_actions"](spark, str(tmp_path)).collect()}
    assert found[0, 0] == ("", None) and found[0, 1] == ("", math.inf) and found[0, 2] == ("", -1.0) and math.isnan(found[0, 3][1])


def test_growth_takes_the_last_filing_of_a_day(spark):
    """The larger value came first that day, so it doesn't count."""
    day = datetime.date
    facts = [(1, "eps", day(2019 + k, 12, 31), v, day(2020 + k, 2, 1), day(2020 + k, 2, 2), a) for k, v, a in [(0, 1.0, "1"), (1, 2.0, "2"), (2, 9.0, "3"), (2, 3.0, "4")]]
    pit = spark.createDataFrame(facts, "cik long, item string, period_end date, value double, filed date, available date, accn string").repartition(3)
    splits = spark.createDataFrame([], "cik long, date date, cum double")
    got = {r.available: r.growth for r in fl.growth_events(pit, "eps", splits).collect()}
    assert got[day(2022, 2, 2)] == pytest.approx(1.0 / 2.0)


def test_growth_query_on_several_filings_of_a_day(compared):
    """Five years of a company, the last with two orders of a day, of which the larger has the smaller number."""
    at = lambda y: datetime.date(y, 12, 1)
    orders = [(k * 28 + 2, 10, 100.0 * k, at(1991 + k), "1-URGENT") for k in range(1, 6)]
    orders += [(170, 11, 999.0, at(1996), "1-URGENT"), (198, 12, 555.0, at(1996), "1-URGENT"), (5, 99, 1.0, datetime.date(1999, 1, 1), "1-URGENT")]
    orders += [(9 + 4 * k, 99, 1.0, datetime.date(1992 + k, 2, 1), "1-URGENT") for k in range(8)]
    assert compared("growth_events", orders=("o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate DATE, o_orderpriority VARCHAR", orders)) is None


def test_predecessors_of_names_that_many_share(compared, spark, tmp_path):
    """Issuer 600 never filed; number 1, of the same name, did."""
    customers = [(1, 3, "AUTOMOBILE"), (600, 3, "AUTOMOBILE"), (601, 4, "AUTOMOBILE")]
    orders = [(1, 1, datetime.date(1994, 1, 1)), (2, 1, datetime.date(1998, 5, 1))]
    tables = {"customer": ("c_custkey BIGINT, c_nationkey INTEGER, c_mktsegment VARCHAR", customers), "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE", orders)}
    assert compared("predecessor_links", **tables) is None
    found = {r.issuer: r.id for r in registry.QUERIES["predecessor_links"](spark, str(tmp_path)).filter("role <> 'primary'").collect()}
    assert found == {600: 1, 601: None}
