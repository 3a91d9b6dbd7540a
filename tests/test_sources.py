"""Readers, store and micro-batches on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from panelforge.sources import readers, store
from panelforge.streaming import daily
from panelforge.streaming.windows import late, sessions, tumbling

D = datetime.date


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    return write


def test_daily_prices(spark, put):
    day = lambda d, c, v: {"date": d, "open": 1, "high": 1, "low": 1, "close": c, "adjusted_close": c / 2, "volume": v}
    path = put("ABC.json", json.dumps([day("2024-01-03", 3, 5), day("2024-01-02", 2, 5), day("2024-01-03", 4, 9), day("bad", 1, 1)]))
    got = readers.daily_prices(spark, path).orderBy("date").collect()
    assert [(r.code, r.date, r.close, r.prev_close, r.prev_adjusted_close) for r in got] == [("ABC", D(2024, 1, 2), 2, None, None), ("ABC", D(2024, 1, 3), 4, 2, 1)]


def test_listings(spark, put):
    a = put("a.json", json.dumps([{"Code": "X", "Isin": None}, {"Code": "X"}, {"Code": "Y"}]))
    b = put("b.json", json.dumps([{"Code": "X", "Name": "gone"}]))
    assert sorted((r.code, r.delisted) for r in readers.listings(spark, a, b).collect()) == [("X", False), ("X", True), ("Y", False)]


def test_company_facts(spark, put):
    fact = {"end": "2024-03-31", "val": 7, "accn": "a", "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}
    body = {"label": "l", "units": {"USD": [fact, fact | {"start": "2024-01-01", "val": 8}]}}
    path = put("f.json", json.dumps({"cik": 5, "facts": {"us-gaap": {"Assets": body}, "other": {"Z": body}}}))
    got = readers.company_facts(spark, path).orderBy("val").collect()
    assert [(r.cik, r.taxonomy, r.concept, r.unit, r.start, r.end, r.val, r.filed) for r in got] == [
        (5, "us-gaap", "Assets", "USD", None, D(2024, 3, 31), 7, D(2024, 5, 1)), (5, "us-gaap", "Assets", "USD", D(2024, 1, 1), D(2024, 3, 31), 8, D(2024, 5, 1)),
    ]


def test_filings(spark, put):
    recent = {"accessionNumber": ["a", "b"], "form": ["10-K", "8-K"], "filingDate": ["2024-02-01", "2024-03-01"], "reportDate": ["2023-12-31", ""], "acceptanceDateTime": ["t", "u"]}
    got = readers.filings(spark, put("s.json", json.dumps({"cik": "0000000007", "filings": {"recent": recent}}))).orderBy("accession").collect()
    assert [(r.cik, r.accession, r.filing_date, r.report_date) for r in got] == [(7, "a", D(2024, 2, 1), D(2023, 12, 31)), (7, "b", D(2024, 3, 1), None)]


def test_text_files(spark, put):
    index = put("m.idx", "Description: x\nCIK|Company Name|Form Type|Date Filed|File Name\n-----\n12|ACME|10-K|20240205|a.txt\n13|B|C\n")
    assert [tuple(r) for r in readers.daily_index(spark, index).collect()] == [(12, "ACME", "10-K", D(2024, 2, 5), "a.txt")]
    names = put("l.txt", "A: B CO:0000000012:\n:0000000013:\nA: B CO:0000000012:\nnonsense\n")
    assert [tuple(r) for r in readers.name_lookup(spark, names).collect()] == [("A: B CO", 12)]
    yields = put("y.json", json.dumps({"observations": [{"date": "2024-01-02", "value": "5.25"}, {"date": "2024-01-03", "value": "."}]}))
    assert [tuple(r) for r in readers.observations(spark, yields).orderBy("date").collect()] == [(D(2024, 1, 2), 5.25), (D(2024, 1, 3), None)]
    factors = put("f.csv", "note\n\n,Mkt-RF,SMB\n20240102,  1.0, -99.99\n20240103, 2.0, 0.5\n\n2024, 9, 9\n")
    got = {(r.date.day, r.factor): r.value for r in readers.percent_factors(spark, factors).collect()}
    assert got == {(2, "mkt_rf"): 0.01, (2, "smb"): None, (3, "mkt_rf"): 0.02, (3, "smb"): 0.005}
    members = put("c.csv", 'date,tickers\n2024-01-02,"A, B"\n2024-01-03,A\n')
    assert sorted((r.date.day, r.ticker) for r in readers.components(spark, members).collect()) == [(2, "A"), (2, "B"), (3, "A")]
    open_end = put("s.csv", "ticker,start_date,end_date\nA,2020-01-01,\n")
    assert [tuple(r) for r in readers.spells(spark, open_end).collect()] == [("A", D(2020, 1, 1), None)]
    own = put("o.csv", "# why\nsid,industry\n1,x\n")
    assert [tuple(r) for r in readers.overrides(spark, own, "sid long, industry string").collect()] == [(1, "x")]


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = lambda *r: spark.createDataFrame([(D(2024, 1, d), v) for d, v in r], "date date, v int")
    read = lambda p: sorted((r.date.day, r.v) for r in store.read_table(spark, p).collect())
    store.replace_table(rows((1, 1), (2, 2)), f"{root}/t", "date")
    for _ in range(2):
        store.upsert_dates(rows((2, 3), (2, 4), (3, 5)), f"{root}/t")
    assert read(f"{root}/t") == [(1, 1), (2, 3), (2, 4), (3, 5)]
    store.compact_month(spark, f"{root}/t", "2024-01")
    assert read(f"{root}/t") == [(1, 1), (2, 3), (2, 4), (3, 5)]
    assert [store.write_vintage(rows(*r), f"{root}/raw", "p") for r in [((1, 1), (2, 2)), ((2, 2), (1, 1)), ((1, 9),)]] == [1, 1, 2]
    assert [(r.v, r.vintage) for r in store.latest_vintages(spark, f"{root}/raw").collect()] == [(9, 2)]
    assert [r.v for r in store.snapshot_asof(rows((1, 1), (5, 2)), "date", "2024-01-04").collect()] == [1]
    store.register(spark, {"registered": f"{root}/t"})
    assert spark.sql("SELECT count(*) FROM registered").first()[0] == 4


def test_catch_up_and_publish(spark, tmp_path):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in range(1, 9)], "date date")
    done = days.filter(F.dayofmonth("date") <= 3)
    assert [r.date.day for r in daily.pending(days, done, "2024-01-06").collect()] == [4, 5, 6]
    assert [r.date.day for r in daily.pending(days, done.limit(0), "2024-01-06", 2).collect()] == [1, 2]
    pointer = f"file://{tmp_path}/pointer"
    assert not daily.publish(spark, pointer, "2024-01-02", "FAIL") and not store.exists(spark, pointer)
    assert daily.publish(spark, pointer, "2024-01-03", "OK") and daily.publish(spark, pointer, "2024-01-02", "OK")
    assert spark.read.parquet(pointer).first().session == "2024-01-03"
    marks = [spark.createDataFrame(m, "source string, watermark string") for m in ([("a", "1"), ("b", "5")], [("a", "3")])]
    assert sorted(map(tuple, daily.merge_watermarks(*marks).collect())) == [("a", "3"), ("b", "5")]


def test_streams_agree_with_tables(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    key = lambda df: sorted((str(r[0]), r[1], r.n, round(r.total, 4)) for r in df.collect())
    assert key(drained(tumbling(late(stream, "60 days"), "1 day"), "complete", "windows")) == key(tumbling(events, "1 day"))
    assert drained(sessions(late(stream, "60 days"), "12 hours"), "complete", "sessions").count() == sessions(events, "12 hours").count()
    last = drained(daily.running_ewma(stream, "user_id", "event_id", "value", 5.0), "append", "state")
    assert last.count() == events.count()
    whole = lambda b: spark.read.parquet(f"file://{tmp_path}/in").withColumn("date", F.col("ts").cast("date")).join(b.select(F.col("ts").cast("date").alias("date")).distinct(), "date").groupBy("date").agg(F.count("*").alias("n"))
    daily.upsert_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cu", whole).awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").agg(F.sum("n")).first()[0] == events.count()


def test_last_of_a_response_counts(spark, tmp_path):
    bar = lambda d, close, volume: {"date": d, "open": 1.0, "high": 1.0, "low": 1.0, "close": close, "adjusted_close": close, "volume": volume}
    (tmp_path / "AAA.json").write_text(json.dumps([bar("2024-01-02", 5.0, 900), bar("2024-01-03", 6.0, 900), bar("2024-01-03", 7.0, 10), bar("2024-01-05", 8.0, 1)]))
    got = readers.daily_prices(spark, str(tmp_path / "AAA.json"), end="2024-01-04").orderBy("date").collect()
    assert [(str(r.date), r.close, r.prev_close) for r in got] == [("2024-01-02", 5.0, None), ("2024-01-03", 7.0, 5.0)]
    (tmp_path / "rate.json").write_text(json.dumps({"observations": [{"date": "2024-01-02", "value": v} for v in ("1e-3", "-0.1234567891", ".")]}))
    assert [r.value for r in readers.observations(spark, str(tmp_path / "rate.json")).collect()] == [1e-3, -0.1234567891, None]
    assert readers.overrides(spark, str(tmp_path / "none.csv"), "a int, b string").count() == 0


def test_late_rows_join_their_date(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda *x: spark.createDataFrame(list(x), "sid int, x int, date date").withColumn("date", F.col("date"))
    day, other = datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)
    for batch in ([(1, 10, day), (2, 20, day), (3, 30, other)], [(2, 21, day), (4, 40, day)], [(2, 21, day), (4, 40, day)]):
        store.merge_dates(rows(*batch), path, ["sid"])
    assert sorted((r.sid, r.x) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 21), (3, 30), (4, 40)]
    codes = str(tmp_path / "codes")
    for batch in ([("a", 1), ("a", 2), ("b", 3)], [("a", 5)], [("a", 5)]):
        store.replace_codes(spark.createDataFrame(batch, "code string, x int"), codes)
    assert sorted(map(tuple, spark.read.parquet(codes).collect())) == [("a", 5), ("b", 3)]
    snaps = str(tmp_path / "snaps")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert [store.write_snapshot(d, snaps, on) for d, on in ((df, "2024-01-01"), (df, "2024-01-02"), (df.limit(1), "2024-01-03"))] == [True, False, True]
