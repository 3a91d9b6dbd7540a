"""Prices end to end on small bars."""

import datetime

import pytest

from panelforge.operators import prices as px

DAY = lambda k: datetime.date(2024, 1, 2) + datetime.timedelta(days=k)
BARS = "code string, date date, close double, adjusted double, prev_date date, prev_close double, prev_adjusted double, volume double"


def bars(code, closes, adjusted=None, volume=None, skip=(), only=None):
    adjusted, volume = adjusted or closes, volume or [1000.0] * len(closes)
    rows, before = [], None
    for k, (c, a, v) in enumerate(zip(closes, adjusted, volume)):
        if k in skip:
            continue
        rows.append((code, DAY(k), c, a, *(before or (None, None, None)), v))
        before = (DAY(k), c, a)
    return [r for k, r in enumerate(rows) if only is None or k in only]


def built(spark, rows, n=8, codes=None, rf=0.0, **more):
    make = spark.createDataFrame
    windows = make(codes or [(k, c, None, None) for k, c in enumerate(sorted({r[0] for r in rows}), 1)], "sid int, code string, valid_from date, valid_to date").fillna({})
    from pyspark.sql import functions as F

    windows = windows.withColumn("valid_from", F.coalesce("valid_from", F.lit("1900-01-01").cast("date")))
    sessions = make([(DAY(k), k, DAY(k - 1) if k else None) for k in range(n)], "date date, i int, prev_session date")
    free = make([(DAY(k), rf) for k in range(n)], "date date, rf double")
    found = px.build_prices(make(rows, BARS).repartition(3), windows, free, sessions, **more)
    return {(r.sid, (r.date - DAY(0)).days): r for r in found.collect()}


@pytest.mark.parametrize("mixed", [False, True])
def test_volume_comes_back_to_the_days_shares(spark, mixed):
    """A later pull shows twice the shares before a 2:1 split, a pull of the day itself doesn't; both give what was traded."""
    closes, adjusted = [100.0, 102.0, 51.5, 52.0], [50.0, 51.0, 51.5, 52.0]
    rows = bars("A", closes, adjusted, [2000.0] * 4)
    if mixed:
        rows = bars("A", closes[:2], volume=[1000.0] * 2) + rows[2:]
    got = built(spark, rows)
    assert [got[1, k].volume for k in range(4)] == pytest.approx([1000, 1000, 2000, 2000])
    assert max(r.basis_err for r in got.values()) == 0
    assert [got[1, k].cum_split for k in range(4)] == [1, 1, 2, 2]
    assert [got[1, k].adj_factor for k in range(4)] == pytest.approx([0.5, 0.5, 1, 1])
    assert got[1, 2].ret == pytest.approx(51.5 * 2 / 102 - 1)


def test_reverse_split_that_volume_leaves_out(spark):
    got = built(spark, bars("A", [10.0, 10.0, 40.0, 40.0], [40.0] * 4, [4000.0, 4000.0, 1000.0, 1000.0]))
    assert (got[1, 2].action, got[1, 2].split_ratio) == ("split", 0.25)
    assert [got[1, k].volume for k in range(4)] == pytest.approx([4000, 4000, 1000, 1000])


def test_flags(spark):
    rows = bars("A", [10, 10.1, 10.2, 18.5, 18.6, 18.7, 18.8, 18.9]) + bars("B", [20, 20.5, 20.5, 20.5, 20.5, 20.5, 21, 22], skip=(6,)) + bars("C", [10.0, 10.0, 40.0], [10.0, 10.0, 10.1]) + bars("D", [5.0, 0.0, None])
    rows = [tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows]
    got = built(spark, rows, rf=0.001)
    assert (got[1, 3].flag, got[1, 3].ret) == ("jump", None) and got[1, 2].flag is None
    assert got[1, 2].ret == pytest.approx(10.2 / 10.1 - 1) and got[1, 2].ret_excess == pytest.approx(10.2 / 10.1 - 1.001)
    assert {got[2, k].flag for k in range(1, 6)} == {"stale"} and (got[2, 7].flag, got[2, 7].ret) == ("gap", None)
    assert (got[3, 2].action, got[3, 2].flag, got[3, 2].ret) == ("unexplained", "jump", None)
    assert [got[4, k].flag for k in (1, 2)] == ["nonpositive"] * 2 and got[4, 0].ret is None


def test_share_counts_turn_a_split_into_a_distribution(spark):
    rows = bars("A", [100.0, 80.0], [80.0, 80.0])
    assert built(spark, rows)[1, 1].action == "split"
    got = built(spark, rows, not_splits=spark.createDataFrame([("A", DAY(1)), ("A", DAY(1))], "code string, date date"))[1, 1]
    assert (got.action, got.split_ratio, got.special) == ("distribution", 1.0, True) and got.dividend == pytest.approx(20) and got.ret == pytest.approx(0)


def test_special_dividends(spark):
    from pyspark.sql import functions as F

    rows = [(1, i, a, d) for i, a, d in [(0, "dividend", 0.5), (63, "dividend", 0.5), (126, "dividend", 0.5), (150, "", 0.0), (189, "dividend", 0.5), (200, "dividend", 3.0), (252, "distribution", 5.0), (600, "dividend", 9.0)]]
    df = spark.createDataFrame(rows, "sid int, i int, action string, dividend double")
    got = {r.i for r in df.withColumn("x", px.special_dividends("sid", "i", "action", "dividend", 3.0, 252)).filter(F.col("x")).collect()}
    assert got == {200, 252}  # the last one has no dividend in the sessions before


def test_validity_windows_calendar_and_doubles(spark):
    rows = bars("A", [10.0, 11.0, 12.0, 13.0]) + bars("B", [20.0, 21.0, 22.0, 23.0])
    got = built(spark, rows, n=3, codes=[(1, "A", None, DAY(1)), (2, "A", DAY(2), None), (1, "B", DAY(1), None)])
    assert {(k, r.code) for k, r in got.items()} == {((1, 0), "A"), ((1, 1), "A"), ((1, 2), "B"), ((2, 2), "A")}
    assert built(spark, bars("A", [10.0])[:0] or [], n=1, codes=[(1, "A", None, None)]) == {}
