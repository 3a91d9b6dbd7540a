"""Company facts by kind on small made-up filings, growth on a fixed basis."""

from datetime import date as d

import pytest

from panelforge.operators import filings as fl

ITEMS = [
    fl.Item("income", "ttm", ["g:NI"]), fl.Item("equity", "instant", ["g:EQ"]), fl.Item("revenue", "annual", ["g:REV", "g:SALES"], ["g:INT", "g:NONINT"]),
    fl.Item("shares", "each", ["d:COVER", "g:SHEET"], unit="shares"), fl.Item("sales_ttm", "ttm", ["g:SALES"], ["g:INT", "g:NONINT"]),
]
FORMS = ["10-K", "10-Q", "10-K/A"]
SCHEMA = "cik long, concept string, unit string, start date, end date, val double, filed date, accn string, form string"


def fact(concept, start, end, val, filed, form="10-Q", unit="USD", cik=1):
    return (cik, concept, unit, start, end, None if val is None else float(val), filed, f"a{filed}", form)


NI = [
    fact("g:NI", d(2022, 1, 1), d(2022, 12, 31), 100, d(2023, 2, 10), "10-K"),
    fact("g:NI", d(2023, 1, 1), d(2023, 3, 31), 30, d(2023, 5, 5)), fact("g:NI", d(2022, 1, 1), d(2022, 3, 31), 20, d(2023, 5, 5)),
    fact("g:NI", d(2023, 4, 1), d(2023, 6, 30), 25, d(2023, 8, 4)), fact("g:NI", d(2023, 1, 1), d(2023, 6, 30), 55, d(2023, 8, 4)),
    fact("g:NI", d(2022, 1, 3), d(2022, 7, 2), 45, d(2023, 8, 4)),  # the year before, two days off
    fact("g:NI", d(2022, 1, 1), d(2022, 12, 31), 110, d(2023, 9, 15), "10-K/A"), fact("g:NI", d(2023, 1, 1), d(2023, 6, 30), 999, d(2023, 8, 1), "8-K"),
]


def found(spark, rows, item):
    sessions = spark.createDataFrame([(d(2023, m, day),) for m, day in [(2, 13), (5, 8), (8, 7), (9, 18)]], "date date")
    facts = fl.company_facts(spark.createDataFrame(rows, SCHEMA).repartition(3), ITEMS, FORMS, sessions)
    return sorted((r.period_end, r.filed, r.value, r.concept, r.available) for r in facts.filter(facts.item == item).collect())


def test_twelve_months_and_restatements(spark):
    got = found(spark, NI, "income")
    assert [g[:3] for g in got] == [
        (d(2022, 12, 31), d(2023, 2, 10), 100), (d(2022, 12, 31), d(2023, 9, 15), 110), (d(2023, 3, 31), d(2023, 5, 5), 110), (d(2023, 3, 31), d(2023, 9, 15), 120),
        (d(2023, 6, 30), d(2023, 8, 4), 110), (d(2023, 6, 30), d(2023, 9, 15), 120),
    ]
    assert {g[1]: g[4] for g in got} == {d(2023, 2, 10): d(2023, 2, 13), d(2023, 5, 5): d(2023, 5, 8), d(2023, 8, 4): d(2023, 8, 7), d(2023, 9, 15): d(2023, 9, 18)}
    assert {g[3] for g in got} == {"g:NI", "TTM"}


def test_chain_is_by_period_and_falls_back_to_sums(spark):
    year = lambda y: (d(y, 1, 1), d(y, 12, 31))
    rows = [
        fact("g:REV", *year(2021), 1000, d(2022, 2, 10), "10-K"), fact("g:SALES", *year(2021), 990, d(2023, 2, 10), "10-K"), fact("g:SALES", *year(2022), 1100, d(2023, 2, 10), "10-K"),
        fact("g:INT", *year(2020), 70, d(2021, 2, 1), "10-K"), fact("g:NONINT", *year(2020), 30, d(2021, 3, 1), "10-K"), fact("g:INT", *year(2020), 75, d(2021, 4, 1), "10-K"), fact("g:SALES", *year(2020), 105, d(2021, 5, 1), "10-K"), fact("g:REV", *year(2020), 106, d(2021, 5, 1), "10-K"),
    ]
    assert [g[1:4] for g in found(spark, rows, "revenue")] == [
        (d(2021, 2, 1), 70, "g:INT"), (d(2021, 3, 1), 100, "g:INT+g:NONINT"), (d(2021, 4, 1), 105, "g:INT+g:NONINT"), (d(2021, 5, 1), 106, "g:REV"),
        (d(2022, 2, 10), 1000, "g:REV"), (d(2023, 2, 10), 1100, "g:SALES"),
    ]


def test_instants_single_concepts_and_what_does_not_count(spark):
    rows = [fact("g:EQ", None, d(2022, 12, 31), 480, d(2023, 2, 10), "10-K"), fact("g:EQ", None, d(2023, 3, 31), 500, d(2023, 5, 5)), fact("g:EQ", None, d(2023, 3, 31), 500, d(2023, 8, 4)), fact("g:EQ", None, d(2023, 6, 30), None, d(2023, 8, 4)), fact("g:EQ", None, None, 1, d(2023, 8, 4))]
    assert [g[:3] for g in found(spark, rows, "equity")] == [(d(2022, 12, 31), d(2023, 2, 10), 480), (d(2023, 3, 31), d(2023, 5, 5), 500)]
    rows = [fact("g:SHEET", None, d(2019, 12, 31), 0, d(2020, 2, 20), unit="shares"), fact("g:SHEET", None, d(2020, 3, 31), 295, d(2020, 5, 11), unit="shares"), fact("d:COVER", None, d(2020, 3, 31), 300, d(2020, 5, 11), unit="shares")]
    assert [(g[2], g[3]) for g in found(spark, rows, "shares")] == [(295, "g:SHEET"), (300, "d:COVER")]
    assert found(spark, [], "equity") == []


def test_growth_on_one_split_basis_and_restated_from_its_day(spark):
    """Per share 4, 2.2, 2.4 with a 2:1 split between the first two filings: 2, 2.2, 2.4 on one basis."""
    facts = [(1, "eps", d(2019 + k, 12, 31), v, d(2020 + k, 2, 1), d(2020 + k, 2, 2)) for k, v in enumerate([4.0, 2.2, 2.4, 2.6, 2.8, 3.0])]
    facts += [(1, "eps", d(2020, 12, 31), 2.0, d(2023, 6, 1), d(2023, 6, 2)), (2, "eps", d(2019, 12, 31), 1.0, d(2020, 2, 1), d(2020, 2, 2))]
    pit = spark.createDataFrame(facts, "cik long, item string, period_end date, value double, filed date, available date").repartition(3)
    splits = spark.createDataFrame([(1, d(2020, 6, 1), 2.0)], "cik long, date date, cum double")
    got = {(r.cik, r.available): (r.growth, r.latest_fy) for r in fl.growth_events(pit, "eps", splits).collect()}

    def slope(v):
        n = len(v)
        m, t = sum(v) / n, (n - 1) / 2
        return sum((i - t) * (x - m) for i, x in enumerate(v)) / sum((i - t) ** 2 for i in range(n)) / abs(m)

    assert got[1, d(2020, 2, 2)][0] is None and got[1, d(2021, 2, 2)][0] is None and got[2, d(2020, 2, 2)] == (None, d(2019, 12, 31))
    assert got[1, d(2022, 2, 2)] == (pytest.approx(slope([4.0, 4.4, 4.8])), d(2021, 12, 31))
    assert got[1, d(2023, 2, 2)] == (pytest.approx(slope([4.0, 4.4, 4.8, 5.2])), d(2022, 12, 31))
    assert got[1, d(2023, 6, 2)] == (pytest.approx(slope([4.0, 4.0, 4.8, 5.2])), d(2022, 12, 31))
    assert got[1, d(2025, 2, 2)] == (pytest.approx(slope([4.0, 4.8, 5.2, 5.6, 6.0])), d(2024, 12, 31))


def test_growth_per_share_keeps_years_without_a_count(spark):
    years = range(2019, 2023)
    facts = [(1, "sales", d(y, 12, 31), 100.0 + 10 * k, d(y + 1, 2, 1), d(y + 1, 2, 2)) for k, y in enumerate(years)]
    facts += [(1, "count", d(y, 12, 31), 0.0 if y == 2020 else 10.0, d(y + 1, 2, 1), d(y + 1, 2, 2)) for y in years]
    pit = spark.createDataFrame(facts, "cik long, item string, period_end date, value double, filed date, available date")
    splits = spark.createDataFrame([], "cik long, date date, cum double")
    events = fl.growth_events(pit, "sales", splits, denominator="count")
    got = {r.available: r.growth for r in events.collect()}
    t, y = [0, 2, 3], [10.0, 12.0, 13.0]
    mt, my = sum(t) / 3, sum(y) / 3
    assert got[d(2023, 2, 2)] == pytest.approx(sum((a - mt) * (b - my) for a, b in zip(t, y)) / sum((a - mt) ** 2 for a in t) / my)
    dates = spark.createDataFrame([(1, d(2023, 2, 1)), (1, d(2023, 2, 2)), (1, d(2025, 1, 1))], "cik long, date date")
    panel = {r.date: r.growth for r in fl.growth_panel(dates, events, 500).collect()}
    assert panel[d(2023, 2, 1)] is None and panel[d(2023, 2, 2)] == got[d(2023, 2, 2)] and panel[d(2025, 1, 1)] is None


def test_changes_are_made_once(spark, sf, monkeypatch):
    """What twelve months and filing days read is a table, so the chain of windows over facts runs once."""
    from panelforge.plans import registry

    tags = []
    monkeypatch.setattr(fl, "stored", lambda df, tag, stored=fl.stored: tags.append(tag) or stored(df, tag))
    plan = registry.QUERIES["company_facts"](spark, sf)
    assert tags == ["events", "series"]
    assert plan.count() > 0
