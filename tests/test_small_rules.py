"""Name keys, calendars, thin groups, share counts, readers and stores on small cases."""

import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from panelforge.operators import staging as st
from panelforge.operators import valuation as va
from panelforge.sources import readers, store

D = datetime.date


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.mark.parametrize(
    "name, key",
    [
        ("Apple Inc.", "APPLE"), ("APPLE INC /CA/", "APPLE"), ("XYZ CORP/DE", "XYZ"), ("Alphabet Inc Class A", "ALPHABET"), ("Alphabet Inc. CL. C", "ALPHABET"), ("Johnson & Johnson", "JOHNSON AND JOHNSON"), ("KOHL'S Corp", "KOHLS"), ("Kohl’s", "KOHLS"),
        ("V F Corp", "VF"), ("A O Smith", "AO SMITH"), ("17 ICE BOX/SWEETER TWITTER, LLC", "17 ICE BOX SWEETER TWITTER"), ("Aon Public Limited Company", "AON"), ("Aon plc", "AON"), ("Duff (old) & Co (The)", "DUFF AND"), ("Brink (x", "BRINK X"),
        ("Dell Technologies Holdings Group New Common Stock", "DELL TECHNOLOGIES"), ("", ""), ("The Inc", ""), (None, None), ("Class Act", "ACT"), ("3 M Co", "3M"), ("Public Storage", "PUBLIC STORAGE"),
    ],
)
def test_name_keys(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(st.name_key(F.col("n"))).first()[0] == key


def test_windows_that_overlap_are_an_error(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 5))], "k int, date date")
    good = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 5), "a"), (1, D(2024, 1, 6), None, "b")], "k int, f date, t date, v string")
    assert [r.v for r in st.validity_join(rows, good, ["k"], "date", "f", "t").collect()] == ["a"]
    bad = spark.createDataFrame([(1, D(2024, 1, 1), None, "a"), (1, D(2024, 1, 4), None, "b")], "k int, f date, t date, v string")
    with pytest.raises(Exception, match="overlapping windows of 1"):
        st.validity_join(rows, bad, ["k"], "date", "f", "t").collect()


def test_calendar_of_days_that_are_no_sessions(spark):
    sessions = spark.createDataFrame([(D(2024, 1, k),) for k in (2, 3, 5, 8)], "date date")
    days = spark.createDataFrame([(D(2024, 1, k),) for k in (1, 2, 4, 7, 8, 7)] + [(None,)], "filed date")
    got = sorted((str(r.filed), str(r.session), r.number) for r in st.on_or_before(days, sessions, "filed").collect())
    assert got == sorted([("2024-01-01", "None", None), ("2024-01-02", "2024-01-02", 1), ("2024-01-04", "2024-01-03", 2), ("2024-01-07", "2024-01-05", 3), ("2024-01-08", "2024-01-08", 4), ("2024-01-07", "2024-01-05", 3), ("None", "None", None)])
    for lag, want in ((1, {1: 2, 2: 3, 4: 5, 7: 8, 8: None}), (2, {1: 3, 2: 5, 4: 8, 7: None, 8: None})):
        got = {r.filed.day: r.available.day if r.available else None for r in st.available_session(days.filter("filed IS NOT NULL"), sessions, lag=lag).collect()}
        assert got == want


def test_thin_groups_and_thin_parents(spark):
    parents = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "p2"), ("p2", "p2")], "group string, parent string")
    sessions = spark.createDataFrame([(s,) for s in range(6)], "s int")
    cells = [("a", s, 5, 5.0) for s in range(6) if s < 2] + [("b", s, 5, 5.0) for s in range(6)] + [("p", s, 5, 1.0 if s > 3 else 5.0) for s in range(6)] + [("p2", s, 9, 9.0) for s in range(6)]
    merged, issues = st.merge_thin(spark.createDataFrame(cells, "group string, s int, n int, neff double"), parents, sessions, 2.0, 3, 3, 1)
    assert {(r.group, r.s) for r in merged.filter("group <> merged").collect()} == {("a", 3), ("a", 4), ("a", 5), ("p", 5)}
    assert {(r.group, r.issue, r.first, r["last"], r.sessions) for r in issues.collect()} == {("a", "thin_merged", 3, 5, 3), ("p", "thin_merged", 5, 5, 1), ("a", "thin_parent", 5, 5, 1)}


def test_share_counts_by_turnover_then_neighbours(spark):
    days = spark.createDataFrame([(1, D(2024, 1, 1) + datetime.timedelta(days=k), 100.0, 1.0 if k < 60 else 2.0) for k in range(120)], "cik int, date date, volume double, cum double")
    snap = va.SNAPSHOTS[0]
    counts = [(1, "other", D(2023, 12, 31), D(2024, 1, 20), 1e4), (1, snap, D(2024, 2, 1), D(2024, 3, 20), 1.1e4), (1, "other", D(2024, 2, 10), D(2024, 3, 10), 2.1e4), (1, "other", D(2024, 2, 15), D(2024, 2, 20), 5e4), (1, "other", D(2024, 3, 1), D(2024, 3, 5), 10.0), (1, snap, D(2020, 1, 1), D(2020, 1, 2), 7.0)]
    kept, dropped = va.clean_counts(spark.createDataFrame(counts, "cik int, concept string, period_end date, filed date, value double"), days, "cik", (1e-4, 0.5), 20, 3.0, 100)
    assert {(r.value, r.norm) for r in kept.collect()} == {(1e4, 1e4), (1.1e4, 1.1e4), (2.1e4, 1.05e4), (7.0, 7.0)}
    assert {(r.value, r.reason) for r in dropped.collect()} == {(5e4, "neighbours"), (10.0, "turnover")}


def test_an_empty_frame_deletes_its_dates(spark):
    path = "file://" + folder() + "/t"
    df = spark.createDataFrame([(D(2024, 1, k), k) for k in (1, 2, 3)], "date date, x int")
    store.upsert_dates(df, path)
    store.upsert_dates(df.filter("x = 3").withColumn("x", F.lit(30)), path, dates=["2024-01-02", "2024-01-03", "2024-01-09"])
    assert sorted((r.date.day, r.x) for r in store.read_table(spark, path).collect()) == [(1, 1), (3, 30)]


def test_readers_of_members_momentum_and_wanted_facts(spark):
    root = folder()
    with open(f"{root}/sp.csv", "w") as f:
        f.write('Symbol,Security,Sector,Date added,CIK,Founded\nAA,"A, Inc",x,1999-01-01,0000123,1\nBB,B,,,n/a,\n')
    rows = readers.current_members(spark, f"{root}/sp.csv").orderBy("ticker").collect()
    assert [tuple(r) for r in rows] == [("AA", "A, Inc", 123, "1999-01-01"), ("BB", "B", None, None)]
    assert readers.preferred_file(["x 1.csv", "x 2.csv", "x(new).csv", "y.csv"], "x", "(new).csv") == "x(new).csv" and readers.preferred_file(["x 1.csv", "x 2.csv"], "x", "(new).csv") == "x 2.csv"
    with pytest.raises(FileNotFoundError):
        readers.preferred_file(["y.csv"], "x", "")
    for name, head, lines in (("f", ",Mkt-RF,RF", ["20240102, 1.0, 0.02", "20240103,-0.5,0.02"]), ("m", ",Mom", ["20240103,0.7", "20240104,0.1"])):
        with open(f"{root}/{name}.csv", "w") as f:
            f.write("\n".join(["text", head, *lines, "", "Copyright"]))
    got = {(r.date.day, r.factor): r.value for r in readers.factors_with_momentum(spark, f"{root}/f.csv", f"{root}/m.csv", start="2024-01-03").collect()}
    assert got == {(3, "mkt_rf"): pytest.approx(-0.005), (3, "rf"): pytest.approx(0.0002), (3, "mom"): pytest.approx(0.007)}
    facts = spark.createDataFrame([(1, "g", "A"), (1, "g", "B"), (1, "h", "A")], "cik int, taxonomy string, concept string")
    wanted = spark.createDataFrame([("g", "A"), ("g", "A")], "taxonomy string, concept string")
    assert [tuple(r) for r in readers.wanted_facts(facts, wanted).collect()] == [(1, "g", "A")]
    with open(f"{root}/now.json", "w") as f:
        f.write('[{"Code":"A","Name":"first"},{"Code":"A","Name":"second"},{"Code":"B"}]')
    with open(f"{root}/gone.json", "w") as f:
        f.write("[]")
    assert sorted((r.code, r.name) for r in readers.listings(spark, f"{root}/now.json", f"{root}/gone.json").collect()) == [("A", "first"), ("B", None)]
