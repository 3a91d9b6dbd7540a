"""A late index is taken once; holidays close when a later day has an index."""

import datetime
import tempfile

from panelforge.sources.store import read_table
from panelforge.streaming import opendays as od

DAY = lambda k: datetime.date(2024, 3, k)


def test_late_index_is_asked_for_until_it_comes(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    asked = []

    def source(*have):
        def ask(days):
            asked.append(sorted(r.date.day for r in days.collect()))
            return spark.createDataFrame([(DAY(k), c) for k in have for c in (1, 2)], "date date, cik int")

        return ask

    run = lambda target, *have: od.take(spark, root, "index", str(DAY(target)), source(*have), lookback=4, keys=["date", "cik"])
    taken = lambda rows: sorted({r.date.day for r in rows.collect()})
    rows, still = run(8, 5, 6, 7)  # Friday's index is not out yet
    assert (taken(rows), [r.date.day for r in still.collect()]) == ([5, 6, 7], [8])
    rows, still = run(9, 5, 6, 7)  # Saturday: still not
    assert taken(rows) == [] and sorted(r.date.day for r in still.collect()) == [8, 9]
    rows, still = run(11, 8, 11)  # Monday: Friday's came, the weekend has none and closes
    assert taken(rows) == [8, 11] and still.count() == 0
    rows, still = run(11, 8, 11)
    assert taken(rows) == [] and still.count() == 0
    assert asked == [[5, 6, 7, 8], [8, 9], [8, 9, 10, 11], []]
    assert read_table(spark, f"{root}/index").count() == 2 * 5
    assert [r.watermark for r in read_table(spark, f"{root}/watermarks").collect()] == [str(DAY(11))]


def test_replay_takes_each_index_once(spark):
    index = [(DAY(1), DAY(1)), (DAY(4), DAY(6)), (DAY(5), DAY(5)), (DAY(8), DAY(12)), (DAY(11), DAY(12)), (DAY(20), DAY(25))]
    got = od.replay(spark.createDataFrame(index, "date date, published date"), spark.createDataFrame([(DAY(k),) for k in (2, 5, 7, 12, 21)], "run date"))
    assert [tuple(r) for r in got.orderBy("run").collect()] == [
        (DAY(2), DAY(1), 1, 1), (DAY(5), DAY(5), 1, 0), (DAY(7), DAY(5), 0, 2), (DAY(12), DAY(11), 2, 1), (DAY(21), DAY(11), 0, 10),
    ]
