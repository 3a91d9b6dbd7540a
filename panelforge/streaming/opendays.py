"""Days whose index has not come yet: asked again until it does, behind a watermark that passes closed days only.

A source publishes an index for some days only, and late. Whether a day without one is a holiday or late shows once a later day
has one. So the watermark is the last day that had an index, and the days after it stay open and are asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.sources.store import exists, merge_dates, read_table, replace_table, stored
from panelforge.streaming.daily import merge_watermarks


def open_days(watermark: DataFrame, source: str, target: str, lookback: int) -> DataFrame:
    """date: the days to ask for, from the one after the source's watermark (or ``lookback`` days before the target) to the target."""
    end = F.lit(target).cast("date")
    last = watermark.filter(F.col("source") == source).agg(F.max("watermark").cast("date").alias("last"))
    start = F.date_add(F.coalesce("last", F.date_sub(end, lookback)), 1)
    return last.select(F.explode(F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))).alias("date"))


def take(spark: SparkSession, root: str, source: str, target: str, ask: Callable[[DataFrame], DataFrame], lookback: int = 7, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One run: asks for the open days, stores what came, moves the watermark. Gives the new rows and the days that stay open.

    ask gets the open days and returns the rows of those that have an index (with date). Rows are stored before the watermark moves, by date
    and idempotently, so a run that dies in between is repeated without harm. A day already taken is not asked again; its index is taken once.
    """
    state, table = f"{root}/watermarks", f"{root}/{source}"
    held = read_table(spark, state) if exists(spark, state) else spark.createDataFrame([], "source string, watermark string")
    days = stored(open_days(held, source, target, lookback), "open-days")
    rows = stored(ask(days).join(days, "date", "left_semi"), "index-rows")
    through = rows.agg(F.max("date").cast("string")).first()[0]
    if through is None:
        return rows, days
    merge_dates(rows, table, keys)
    moved = merge_watermarks(held, spark.createDataFrame([(source, through)], "source string, watermark string"))
    replace_table(stored(moved, "watermarks"), state)  # a table can't be read while it is replaced
    return rows, days.filter(F.col("date") > F.lit(through).cast("date"))


def replay(index: DataFrame, runs: DataFrame) -> DataFrame:
    """run, through, taken, still_open of a series of runs over known publication days.

    index: date, published. runs: run (day). A run takes the indexes published by its day of the days after the watermark it found; those are at most
    once taken. Both tables hold a row a day. through is null until an index has come.
    """
    # A day's index is seen by the first run on or after its publication that is on or after the day.
    order = Window.partitionBy(F.lit(0)).orderBy("at", "side").rowsBetween(0, Window.unboundedFollowing)
    stacked = index.select(F.greatest("date", "published").alias("at"), F.lit(0).alias("side"), "date", F.lit(None).cast("date").alias("run")).unionByName(runs.select(F.col("run").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("date"), "run"))
    seen = stacked.withColumn("run", F.first("run", ignorenulls=True).over(order)).filter("date IS NOT NULL AND run IS NOT NULL").select("date", "run")
    newest = seen.groupBy("run").agg(F.max("date").alias("newest"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("run")
    marks = runs.join(newest, "run", "left").withColumn("through", F.max("newest").over(so_far)).withColumn("found", F.lag("through").over(so_far))
    took = seen.join(marks, "run").filter(F.col("found").isNull() | (F.col("date") > F.col("found"))).groupBy("run").agg(F.count("*").alias("taken"))
    opened: Column = F.when(F.col("through").isNotNull(), F.greatest(F.datediff("run", "through"), F.lit(0)))
    return marks.join(took, "run", "left").select("run", "through", F.coalesce("taken", F.lit(0)).alias("taken"), opened.cast("long").alias("still_open"))
